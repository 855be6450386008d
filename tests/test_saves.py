"""Region files as a source with filters pushed down, and worlds that appear whole or not at all."""

import pytest
from pyspark.sql import functions as F
from test_sources import chunk_bytes, region_bytes

from lattica.operators import worlds
from lattica.sources import regions, saves


@pytest.fixture
def folder(tmp_path):
    """Nine regions with a chunk or two each, of sections 0 and 5."""
    (tmp_path / "deep").mkdir()
    for rx in (-1, 0, 1):
        for rz in (-1, 0, 1):
            sections = [(y, [("minecraft:stone", {}), ("minecraft:oak_log", {"axis": "y"})], [k % 2 for k in range(4096)]) for y in (0, 5)]
            data = region_bytes({0: (2, chunk_bytes(sections, True, 3000)), 31 + 32 * 7: (2, chunk_bytes(sections[:1], True, 3000))})
            (tmp_path / ("deep" if rx else ".") / f"r.{rx}.{rz}.mca").write_bytes(data)
    (tmp_path / "r.x.mca").write_bytes(b"none")
    (tmp_path / "other.dat").write_bytes(b"none")
    return str(tmp_path)


def rows(df):
    return sorted((r.cx, r.cz, r.section, tuple(r.names), r.problem) for r in df.collect())


def test_all_sections(spark, folder):
    got = rows(saves.read_saved(spark, folder))
    assert len(got) == 27 and {(cx // 32, cz // 32) for cx, cz, *_ in got} == {(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
    assert saves.read_saved(spark, f"{folder}/deep").count() == 18


FILTERS = ["cx = 0", "cx between 20 and 40 and cz < 0", "cx > 40", "cz in (7, 39)", "section = 5", "section <= 0 and cx >= 32", "cx < -100", "cx <=> 31 and cz = 7", "cx + cz = 7"]


@pytest.mark.parametrize("condition", FILTERS)
def test_filters(spark, folder, condition):
    every = saves.read_saved(spark, folder).collect()
    held = spark.createDataFrame(every, regions.SECTIONS)
    assert rows(saves.read_saved(spark, folder).where(condition)) == rows(held.where(condition))


def test_files_and_chunks_that_are_opened(folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    opened, chunks, real = [], [], regions.parse_tags
    monkeypatch.setattr(regions, "parse_tags", lambda data: chunks.append(1) or real(data))
    reader = saves.RegionReader(folder)
    kept = list(reader.pushFilters([GreaterThanOrEqual(("cx",), 31), LessThan(("cx",), 33), EqualTo(("cz",), 7)]))
    assert len(kept) == 3
    for part in reader.partitions():
        opened.append((part.rx, part.rz))
        list(reader.read(part))
    assert sorted(opened) == [(0, 0), (1, 0)]
    assert len(chunks) == 1  # (31, 7); the other regions' chunks are at 32 and 63
    assert len(saves.RegionReader(folder).partitions()) == 9


def test_worlds_appear_whole_or_not_at_all(spark, tmp_path):
    blocks = spark.createDataFrame([(k, 0, 0, "stone", "None") for k in range(50)], "x int, y int, z int, name string, prop string").repartition(4)
    world = worlds.encoded(blocks)
    bad = worlds.World(world.codes.withColumn("id", F.when(F.col("x") < 40, F.col("id"))), world.names, world.props)
    with pytest.raises(Exception, match="rows without id"):
        worlds.save(bad, str(tmp_path / "bad"))
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith(".")]
    files = worlds.save(world, str(tmp_path / "good"))
    assert sorted(p.name for p in (tmp_path / "good").iterdir()) == ["blocks", "ids", "properties"]
    assert all((tmp_path / "good" / "blocks").joinpath(r.path.rsplit("/", 1)[1]).stat().st_size == r.bytes for r in files.collect())
    assert worlds.load(spark, str(tmp_path / "good")).blocks().count() == 50
    with pytest.raises(FileExistsError):
        worlds.save(world, str(tmp_path / "good"))
    assert worlds.load(spark, str(tmp_path / "good")).blocks().count() == 50
