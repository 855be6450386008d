"""Region files of saved worlds (r.X.Z.mca): chunks of tagged binary data, read as blocks.

A task opens region files and gives a row per section of 16x16x16 places: its palette and a code for each place. Spark
then spreads the places and works out coordinates, filters and clips by column expressions.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import local_of_index
from .world import _system

#: From this data version on, codes do not cross from one long to the next.
_ALIGNED = 2529
_PLAIN = {1: ">b", 2: ">h", 3: ">i", 4: ">q", 5: ">f", 6: ">d"}
_ARRAYS = {7: ">i1", 11: ">i4", 12: ">i8"}
SECTIONS = "path string, cx int, cz int, section int, names array<string>, props array<string>, codes array<int>, problem string"
_SCHEMA = pa.schema([("path", pa.string()), ("cx", pa.int32()), ("cz", pa.int32()), ("section", pa.int32()), ("names", pa.list_(pa.string())), ("props", pa.list_(pa.string())), ("codes", pa.list_(pa.int32())), ("problem", pa.string())])


def parse_tags(data: bytes) -> dict:
    """The root compound of tagged binary data as dicts, lists, numbers, strings and arrays."""
    at = 0

    def text() -> str:
        nonlocal at
        (n,) = struct.unpack_from(">H", data, at)
        at += 2 + n
        return data[at - n : at].decode("utf-8", "replace")

    def value(kind: int):
        nonlocal at
        if kind in _PLAIN:
            (out,) = struct.unpack_from(_PLAIN[kind], data, at)
            at += struct.calcsize(_PLAIN[kind])
            return out
        if kind in _ARRAYS:
            (n,) = struct.unpack_from(">i", data, at)
            out = np.frombuffer(data, _ARRAYS[kind], n, at + 4)
            at += 4 + out.nbytes
            return out
        if kind == 8:
            return text()
        if kind == 9:
            of, n = struct.unpack_from(">bi", data, at)
            at += 5
            return [value(of) for _ in range(n)]
        if kind == 10:
            found = {}
            while (of := data[at]) != 0:
                at += 1
                name = text()
                found[name] = value(of)
            at += 1
            return found
        raise ValueError(f"tag of kind {kind}")

    if data[0] != 10:
        raise ValueError("the root is no compound")
    at = 1
    text()
    return value(10)


def palette_codes(longs: np.ndarray, n_palette: int, aligned: bool) -> np.ndarray:
    """4096 palette codes from packed longs."""
    width = max(4, (n_palette - 1).bit_length())
    raw = np.asarray(longs).astype(">i8").view(">u8").astype(np.uint64)
    bits = np.unpackbits(raw.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    if aligned:
        per = 64 // width
        bits = bits[:, : per * width]
    flat = bits.reshape(-1)[: 4096 * width]
    if len(flat) < 4096 * width:
        raise ValueError("too few codes in a section")
    return flat.reshape(4096, width).astype(np.int32) @ (1 << np.arange(width, dtype=np.int32))


def _sections(chunk: dict, wanted=lambda y: True):
    """(section, palette, codes) of a chunk, in either layout; sections of one kind of air, and those not wanted, are left out."""
    root = chunk.get("Level", chunk)
    for s in root.get("sections", root.get("Sections", [])):
        if not wanted(s.get("Y", 0)):
            continue
        states = s.get("block_states")
        palette, longs = (states.get("palette"), states.get("data")) if states else (s.get("Palette"), s.get("BlockStates"))
        if not palette or len(palette) == 1 and palette[0]["Name"].endswith("air"):
            continue
        codes = palette_codes(longs, len(palette), chunk.get("DataVersion", _ALIGNED) >= _ALIGNED) if longs is not None else np.zeros(4096, np.int32)
        yield s["Y"], palette, codes


def _chunks(file, wanted=lambda k: True):
    """(chunk's number in the region, tags or None, what is wrong); chunks that are not wanted are not read."""
    table = file.read_at(4096, 0)
    for k in range(len(table) // 4):
        place = int.from_bytes(table[4 * k : 4 * k + 3], "big")
        if not place or not wanted(k):
            continue
        try:
            size, press = struct.unpack(">IB", file.read_at(5, 4096 * place))
            data = file.read_at(size - 1, 4096 * place + 5)
            data = gzip.decompress(data) if press == 1 else zlib.decompress(data) if press == 2 else data
            yield k, parse_tags(data), ""
        except (ValueError, struct.error, zlib.error, OSError, EOFError, IndexError) as e:
            yield k, None, f"{type(e).__name__}: {e}"


def sections_of(path: str, rx: int, rz: int, chunk=lambda cx, cz: True, section=lambda y: True):
    """Arrow batches of SECTIONS for a region file: a row per section, and one for a chunk that cannot be read, with problem set."""
    system, own = _system(path)
    with system.open_input_file(own) as file:
        for k, tags, problem in _chunks(file, lambda k: chunk(32 * rx + k % 32, 32 * rz + k // 32)):
            place = [path, 32 * rx + k % 32, 32 * rz + k // 32]
            rows = []
            try:
                for y, palette, codes in _sections(tags, section) if tags else ():
                    props = [",".join(f"{a}={b}" for a, b in p.get("Properties", {}).items()) or "None" for p in palette]
                    rows.append([*place, y, [p["Name"] for p in palette], props, codes, None])
            except (ValueError, KeyError, TypeError) as e:
                rows, problem = [], f"{type(e).__name__}: {e}"
            if problem:
                rows = [[*place, None, None, None, None, problem]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def read_sections(spark: SparkSession, folder: str) -> DataFrame:
    """A row per section of the region files in a folder; a chunk that cannot be read is a row with problem set."""

    def read(batches):
        for batch in batches:
            for path, rx, rz in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from sections_of(path, rx, rz)

    name = r"(?i)r\.(-?\d+)\.(-?\d+)\.mca$"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][cC][aA]").load(folder).select("path")
    files = files.where(F.col("path").rlike(name)).select("path", *[F.regexp_extract("path", name, k).cast("int").alias(c) for k, c in ((1, "rx"), (2, "rz"))])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(read, SECTIONS)


def problems(sections: DataFrame) -> DataFrame:
    return sections.where("problem is not null").select("path", "cx", "cz", "problem")


def blocks_of(sections: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """(ns, name, prop, x, y, z) of sections, without air; low and high (exclusive) also leave out whole sections unread."""
    rows = sections.where("problem is null")
    if low is not None:
        rows = rows.where(F.col("section") >= low // 16)
    if high is not None:
        rows = rows.where(F.col("section") <= (high - 1) // 16)
    spread = rows.select("cx", "cz", "section", "names", "props", F.posexplode("codes").alias("index", "code"))
    lx, y, lz = local_of_index(F.col("index"), F.col("section"))
    full: Column = F.get("names", F.col("code"))
    parted = F.split(full, ":", 2)
    out = spread.select(
        F.when(F.size(parted) == 2, parted[0]).otherwise("minecraft").alias("ns"),
        F.element_at(parted, -1).alias("name"),
        F.get("props", F.col("code")).alias("prop"),
        (F.col("cx") * 16 + lx).alias("x"),
        y.alias("y"),
        (F.col("cz") * 16 + lz).alias("z"),
    ).where(~F.endswith("name", F.lit("air")))
    if low is not None:
        out = out.where(F.col("y") >= low)
    return out if high is None else out.where(F.col("y") < high)
