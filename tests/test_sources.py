"""Block files, dictionaries, older text forms, run files and region files."""

import gzip
import random
import struct
import zlib

import numpy as np
import pytest

from lattica.functions.codec import coordinate_bytes
from lattica.operators.blocks import last_wins
from lattica.sources import dicts, legacy, regions, runs, world


@pytest.mark.parametrize("spaces", [False, True])
def test_block_files_round_trip(spark, tmp_path, spaces):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(0, 300), rng.randint(0, 9), rng.randint(-30_000, 30_000), rng.randint(-64, 320), rng.randint(-9_000_000, 9_000_000)) for _ in range(500)]
    rows += [(0, 0, 0, -127, 127, 0), (1, 0, 0, -128, 128, -1)]
    names = ["ns", "id", "prop", "x", "y", "z"]
    df = spark.createDataFrame(rows, "ns int, id int, prop int, x int, y int, z int").select(*names[not spaces :]).repartition(3)
    files = world.write_world(df, str(tmp_path / "w"))
    assert sum(r.records for r in files.collect()) == len(rows)
    widths = world.world_layout(files.first().path)
    assert list(widths) == ["ns"] * spaces + ["code", "x", "y", "z"] and (widths["code"], widths["x"], widths["y"], widths["z"]) == (2, 2, 2, 4)
    back = world.read_world(spark, str(tmp_path / "w"))
    assert sorted(map(tuple, back.select(*names[not spaces :]).collect())) == sorted(r[not spaces :] for r in rows)
    assert world.write_world(df.where("false"), str(tmp_path / "none")).count() == 0


def test_plain_files_several_members_and_places_that_repeat(spark, tmp_path):
    header = b"id/prop bytes: 1\nx coord bytes: 1\ny coord bytes: 1\nz coord bytes: 2\n"
    record = lambda *v: struct.pack("<BBBBH", *v)
    body = record(3, 1, 0x81, 5, 0x8001) + record(4, 0, 0x81, 5, 0x8001)
    (tmp_path / "plain.world").write_bytes(header + body)
    (tmp_path / "two.world").write_bytes(gzip.compress(header + body[:3]) + gzip.compress(body[3:]))
    (tmp_path / "bare.world").write_bytes(gzip.compress(header))
    for name, n in (("plain", 2), ("two", 2), ("bare", 0)):
        got = world.read_world(spark, str(tmp_path / f"{name}.world"))
        assert [(r.pos, r.ns, r.id, r.prop, r.x, r.y, r.z) for r in got.orderBy("pos").collect()] == [(0, None, 3, 1, -1, 5, -1), (1, None, 4, 0, -1, 5, -1)][:n]
    kept = last_wins(world.read_world(spark, str(tmp_path / "plain.world")), "file", "pos").collect()
    assert [(r.id, r.prop) for r in kept] == [(4, 0)]


@pytest.mark.parametrize("data", [b"no header at all", b"id/prop bytes: 1\n", b"x coord bytes: 1\nid/prop bytes: 1\ny coord bytes: 1\nz coord bytes: 1\n", b"id/prop bytes: 1\nx coord bytes: 1\ny coord bytes: 1\nz coord bytes: 1\nabcd"])
def test_damaged_files_are_errors(spark, tmp_path, data):
    (tmp_path / "a.world").write_bytes(data)
    with pytest.raises(Exception, match="header|record"):
        world.read_world(spark, str(tmp_path / "a.world")).collect()


def test_widths_hold_what_they_say():
    for width in (1, 2, 3, 4):
        most = (1 << (8 * width - 1)) - 1
        assert coordinate_bytes(most) == width and coordinate_bytes(most + 1) == width + 1
        value = np.array([most, -most, 0, -1])
        columns = {c: value if c in "xyz" else np.abs(value) for c in ("id", "prop", "x", "y", "z")}
        widths = {"code": width, "x": width, "y": width, "z": width}
        raw = np.frombuffer(world.encoded_records(columns, widths), np.uint8).reshape(4, 5 * width)
        assert world._coordinate(raw, 2 * width, width).tolist() == value.tolist()
        with pytest.raises(ValueError, match="does not fit"):
            world.encoded_records(columns | {"y": value - 1}, widths)


def test_dictionaries(spark, tmp_path):
    path = tmp_path / "a.blockIds"
    path.write_text("0=yellow_carpet\n1=oak=log\n\nnonsense\n2=None\n")
    assert sorted(map(tuple, dicts.read_dictionary(spark, str(path)).collect())) == [(0, "yellow_carpet"), (1, "oak=log"), (2, "None")]
    assert [r.value for r in dicts.malformed(spark, str(path)).collect()] == ["nonsense"]
    path.write_text("leaves=17\n{'axis': y=z}=3\n")
    assert sorted(map(tuple, dicts.read_dictionary(spark, str(path), reverse=True).collect())) == [(3, "{'axis': y=z}"), (17, "leaves")]
    path.write_text("0=waterlogged=false,facing=east\n4=None\n")
    assert {r.prop: r.properties for r in dicts.read_properties(spark, str(path)).collect()} == {0: {"waterlogged": "false", "facing": "east"}, 4: {}}
    rows = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b=d")], "id int, name string")
    dicts.write_dictionary(rows, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["0=a", "1=b=d", "2=c"]


def test_lines(spark):
    lines = spark.createDataFrame([("17:40:124.85.-12",), ("2:17::1.-2.3",), ("bad",), ("17:40:1.2",), ("1:-1:0.0.0\r",)], "value string")
    got = sorted(map(tuple, legacy.parsed(lines).collect()), key=str)
    assert got == sorted([(None, 17, 40, 124, 85, -12), (2, 17, -1, 1, -2, 3), (None, 1, -1, 0, 0, 0)], key=str)
    assert legacy.malformed(lines).count() == 2
    assert {r.value for r in legacy.formatted(legacy.parsed(lines)).collect()} == {"17:40:124.85.-12", "2:17::1.-2.3", "1::0.0.0"}
    numbered = spark.createDataFrame([(k, f"1:1:0.{y}.0") for k, y in enumerate([3, 9, 3, -2, 9])], "line_no long, value string")
    assert [r.line_no for r in legacy.sorted_by_height(numbered).orderBy("place").collect()] == [1, 4, 0, 2, 3]
    assert [r.line_no for r in legacy.reversed_lines(numbered).orderBy("place").collect()] == [4, 3, 2, 1, 0]


def test_runs():
    text = "> py extract.py\r\nsaves\\My World\r\ndimensions\\minecraft\\overworld\r\n320\r\n-62\r\nn\r\n-12\r\n24\r\n-103\r\n-59\r\ny\r\n\r\n"
    run = runs.parse_run(text)
    assert (run.command, run.low, run.high, run.x, run.z, run.namespaces, run.dimension) == ("py extract.py", -62, 320, (-12, 24), (-103, -59), True, "overworld")
    assert run.paths["trees"] == "My World_trees.world"
    whole = runs.parse_run("> c\nw\nDIM-1\n10\n0\ny\nn")
    assert whole.x is None and not whole.namespaces and whole.dimension == "nether"
    for bad, why in (("c\nw", "begin with"), ("> c\nw", "answers"), ("> c\nw\nd\n0\n10\ny\nn", "above"), ("> c\nw\nd\n10\n0\nmaybe\nn", "y or n"), ("> c\nw\nd\n10\n0\nn\n1\n2\n3\nfour\ny", "whole number")):
        with pytest.raises(ValueError, match=why):
            runs.parse_run(bad)
    assert [runs.dimension_of(d) for d in ("DIM1", "x/the_end/", ".\\")] == ["end", "end", "overworld"]
    assert runs.run_order(["b", "a", "TEST_extreme"]) == ["TEST_extreme", "a", "b"]


# --- region files --------------------------------------------------------------------------------


def tag(kind, name, body):
    return bytes([kind]) + struct.pack(">H", len(name)) + name.encode() + body


def text(value):
    return struct.pack(">H", len(value.encode())) + value.encode()


def palette_body(names):
    entries = b""
    for name, props in names:
        inner = tag(8, "Name", text(name))
        if props:
            inner += tag(10, "Properties", b"".join(tag(8, k, text(v)) for k, v in props.items()) + b"\0")
        entries += inner + b"\0"
    return b"\x0a" + struct.pack(">i", len(names)) + entries


def packed_longs(codes, width, aligned):
    values, at, now = [], 0, 0
    if aligned:
        per = 64 // width
        for k in range(0, len(codes), per):
            values.append(sum(int(c) << (width * i) for i, c in enumerate(codes[k : k + per])))
    else:
        whole = sum(int(c) << (width * i) for i, c in enumerate(codes))
        values = [(whole >> (64 * k)) & ((1 << 64) - 1) for k in range(-(-len(codes) * width // 64))]
    return struct.pack(">i", len(values)) + b"".join(struct.pack(">Q", v) for v in values)


def chunk_bytes(sections, new, version):
    items = b""
    for y, names, codes in sections:
        longs = packed_longs(codes, max(4, (len(names) - 1).bit_length()), version >= 2529) if codes is not None else None
        inner = tag(1, "Y", struct.pack(">b", y))
        if new:
            states = tag(9, "palette", palette_body(names)) + (tag(12, "data", longs) if longs else b"")
            inner += tag(10, "block_states", states + b"\0")
        else:
            inner += tag(9, "Palette", palette_body(names)) + (tag(12, "BlockStates", longs) if longs else b"")
        items += inner + b"\0"
    body = b"\x0a" + struct.pack(">i", len(sections)) + items
    inside = tag(9, "sections" if new else "Sections", body)
    root = tag(3, "DataVersion", struct.pack(">i", version)) + (inside if new else tag(10, "Level", inside + b"\0"))
    return tag(10, "", root + b"\0")


def region_bytes(chunks):
    table, data, sector = bytearray(8192), b"", 2
    for k, (press, raw) in chunks.items():
        body = {1: gzip.compress, 2: zlib.compress, 3: bytes}[press](raw) if press in (1, 2, 3) else raw
        blob = struct.pack(">IB", len(body) + 1, 2 if press == 9 else press) + body
        n = -(-len(blob) // 4096)
        table[4 * k : 4 * k + 4] = sector.to_bytes(3, "big") + bytes([n])
        data, sector = data + blob.ljust(4096 * n, b"\0"), sector + n
    return bytes(table) + data


def test_region_files(spark, tmp_path):
    rng = random.Random(8)
    many = [("minecraft:air", {})] + [(f"mod:block{k}", {"axis": "y"} if k % 2 else {}) for k in range(20)]
    wide, four = [rng.randint(0, 20) for _ in range(4096)], [rng.randint(0, 1) for _ in range(4096)]
    pair = [("minecraft:cave_air", {}), ("minecraft:stone", {})]
    chunks = {
        0: (2, chunk_bytes([(-4, many, wide), (0, [("minecraft:air", {})], None)], True, 3000)),
        33: (1, chunk_bytes([(1, many, wide)], False, 2000)),
        5: (3, chunk_bytes([(2, pair, four), (3, [("minecraft:dirt", {})], None)], True, 2600)),
        7: (9, b"broken"),
    }
    (tmp_path / "r.-1.2.MCA").write_bytes(region_bytes(chunks))
    (tmp_path / "r.0.0.mca").write_bytes(region_bytes({}))
    (tmp_path / "level.dat").write_bytes(b"other")
    sections = regions.read_sections(spark, str(tmp_path))
    assert [(r.cx, r.cz) for r in regions.problems(sections).collect()] == [(-25, 64)]

    def places(cx, cz, sy, names, codes):
        for i in range(4096):
            name, props = names[codes[i] if codes else 0]
            if not name.endswith("air"):
                ns, bare = name.split(":")
                yield ns, bare, "axis=y" if props else "None", 16 * cx + (i & 15), 16 * sy + (i >> 8), 16 * cz + (i >> 4 & 15)

    want = [*places(-32, 64, -4, many, wide), *places(-31, 65, 1, many, wide), *places(-27, 64, 2, pair, four), *places(-27, 64, 3, [("minecraft:dirt", {})], None)]
    assert sorted(map(tuple, regions.blocks_of(sections).collect())) == sorted(want)
    assert sorted(map(tuple, regions.blocks_of(sections, 20, 40).collect())) == sorted(w for w in want if 20 <= w[4] < 40)
