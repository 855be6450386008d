"""Operator 1: token ids in one wavelet-matrix file per shard.

A shard file holds the ids of whole documents in ascending doc_id order. The ids are split into bit planes, the most
significant first; after each plane the ids are stably parted by that bit, zeros first. Each plane is cut into blocks,
compressed one by one, beside a directory of the ones before each block. So access, rank, count and select read a few
blocks of one file, and a shard can also be read whole.

File: magic, header length (u32), header as JSON, document ids, document lengths, then per plane the blocks' ends, the
ones before each block, and the blocks. All numbers are little-endian.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, columns_as, encoder, new_folder, open_input, sliced, stored, write_bytes

MAGIC = b"LWMX0001"
BLOCK_BITS = 1 << 16
#: A shard ends with the first document that brings it to so many ids.
SHARD_TOKENS = 1 << 20
#: Signs of a text that order rows of one doc_id.
PREFIX = 16
#: Occurrences found at a time.
FOUND_ROWS = 1 << 16


def build(ids: np.ndarray, width: int, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard: ids of documents end to end, their doc_ids (with a null as the smallest long) and lengths."""
    press = zstandard.ZstdCompressor(level=1)
    now, planes, zeros, parts = ids, [], [], []
    for level in range(width - 1, -1, -1):
        ones = (now >> level).astype(np.uint8) & 1
        mask = ones.view(bool)
        bits = np.packbits(mask, bitorder="little").tobytes()
        blocks = [press.compress(bits[at : at + BLOCK_BITS // 8]) for at in range(0, len(bits), BLOCK_BITS // 8)]
        before = np.cumsum([0, *np.add.reduceat(ones, np.arange(0, len(ones), BLOCK_BITS), dtype=np.int64)[:-1]]) if len(ones) else np.zeros(0)
        ends = np.cumsum([len(b) for b in blocks], dtype=np.uint32) if blocks else np.zeros(0, np.uint32)
        now = np.concatenate((now[~mask], now[mask]))
        zeros.append(len(ids) - int(np.count_nonzero(mask)))
        plane = [ends.astype("<u4").tobytes(), before.astype("<u4").tobytes(), *blocks]
        planes.append(sum(map(len, plane)))
        parts += plane
    docs = [press.compress(doc_ids.astype("<i8").tobytes()), press.compress(lengths.astype("<u4").tobytes())]
    head = json.dumps({"n": len(ids), "width": width, "dtype": ids.dtype.str, "block_bits": BLOCK_BITS, "zeros": zeros, "docs": [len(doc_ids), *map(len, docs)], "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *docs, *parts])


class WaveletFile:
    """Reads a shard: from a file that can seek (only what a question needs), or whole."""

    def __init__(self, file):
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        (size,) = struct.unpack("<I", file.read(4))
        self.head = json.loads(file.read(size))
        self.n, self.width, self.zeros = self.head["n"], self.head["width"], self.head["zeros"]
        n_docs, *sizes = self.head["docs"]
        raw = [zstandard.ZstdDecompressor().decompress(file.read(s), max_output_size=8 * n_docs or 1) for s in sizes]
        self.doc_ids, self.lengths = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], "<u4")
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        at = 12 + size + sum(sizes)
        self.at = [at + sum(self.head["planes"][:k]) for k in range(self.width)]
        self.blocks = -(-self.n // self.head["block_bits"])
        self.directories: dict[int, tuple] = {}
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def _directory(self, plane: int) -> tuple[np.ndarray, np.ndarray]:
        if plane not in self.directories:
            self.file.seek(self.at[plane])
            raw = np.frombuffer(self.file.read(8 * self.blocks), "<u4")
            self.directories[plane] = raw[: self.blocks], raw[self.blocks :]
        return self.directories[plane]

    def _block(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self.kept:
            if len(self.kept) > 256:
                self.kept.clear()
            ends, _ = self._directory(plane)
            begin = int(ends[k - 1]) if k else 0
            self.file.seek(self.at[plane] + 8 * self.blocks + begin)
            self.kept[plane, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(int(ends[k]) - begin), max_output_size=self.head["block_bits"] // 8), np.uint8)
        return self.kept[plane, k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        k, rest = divmod(i, self.head["block_bits"])
        bits = np.unpackbits(self._block(plane, k), count=rest, bitorder="little") if rest else ()
        return int(self._directory(plane)[1][k]) + int(np.count_nonzero(bits))

    def access(self, i: int) -> int:
        """The id at place i of the shard."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.width):
            k, rest = divmod(i, self.head["block_bits"])
            bit = int(self._block(plane, k)[rest >> 3]) >> (rest & 7) & 1
            ones = self._ones(plane, i)
            value, i = value << 1 | bit, self.zeros[plane] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for plane in range(self.width):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            lo, hi = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (self.width - 1 - plane) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often a token occurs before place i."""
        if token >> self.width:
            return 0
        lo, hi = self._range(token, min(i, self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, plane: int, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Places in a plane of its zeros or ones number ranks, which rise: the directory names the block of each."""
        before = self._directory(plane)[1].astype(np.int64)
        if not bit:
            before = np.arange(self.blocks, dtype=np.int64) * self.head["block_bits"] - before
        block = np.searchsorted(before, ranks, side="right") - 1
        out, begins = np.empty(len(ranks), np.int64), np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(ranks)], strict=True):
            k = int(block[a])
            at = k * self.head["block_bits"]
            bits = np.unpackbits(self._block(plane, k), count=min(self.head["block_bits"], self.n - at), bitorder="little")
            out[a:b] = np.flatnonzero(bits == bit)[ranks[a:b] - before[k]] + at
        return out

    def places(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The places of a token's occurrences first to last (not included), counted from 0: down the planes once, and up once."""
        lo, hi = self._range(token, self.n) if token >> self.width == 0 else (0, 0)
        at = np.arange(lo + first, hi if last is None else min(hi, lo + last))
        for plane in range(self.width - 1, -1, -1):
            if not len(at):
                break
            bit = token >> (self.width - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """The place of a token's occurrence k, counted from 0."""
        found = self.places(token, k, k + 1) if k >= 0 else ()
        if not len(found):
            raise IndexError(k)
        return int(found[0])

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the least significant."""
        now = np.zeros(self.n, dtype=self.head["dtype"])
        for plane in range(self.width - 1, -1, -1):
            raw = b"".join(self._block(plane, k).tobytes() for k in range(self.blocks))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little")
            mask, out, z = ones.view(bool), np.empty_like(now), self.zeros[plane]
            out[~mask], out[mask] = now[:z], now[z:]
            out |= ones.astype(now.dtype) << (self.width - 1 - plane)
            now = out
        return now


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
_NULL_ID = np.iinfo(np.int64).min


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, partitions: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes whole texts, adds end_id to each, and writes shards in ascending doc_id order; returns their manifest.

    docs: doc_id (long) and text; other columns are ignored. Null text: empty, so the end id alone. Null doc_id: before
    all others. Rows that share a doc_id each keep their ids, ordered by their first PREFIX signs, then by a hash of the text,
    so that many of them are dealt over shards. An empty table has no shards.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "wavelet")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        part, seq, kept, doc_ids, lengths, n_tokens = TaskContext.get().partitionId(), 0, [], [], [], 0
        enc = encoder(tokenizer)
        width = max(enc.width, int(end_id).bit_length())
        dtype = "<u2" if width <= 16 else "<u4"

        def flush():
            nonlocal seq, kept, doc_ids, lengths, n_tokens
            path = f"{folder}/part-{part:06d}-{seq:06d}.lwm"
            write_bytes(path, [build(np.concatenate(kept), width, np.array(doc_ids, np.int64), np.array(lengths, np.uint32))])
            row = arrow_batch(_MANIFEST, [[part], [seq], [path], [len(doc_ids)], [n_tokens]])
            seq, kept, doc_ids, lengths, n_tokens = seq + 1, [], [], [], 0
            return row

        for batch in sliced(batches):
            ids, starts = enc.encode(batch.column(1))
            ids = np.insert(ids.astype(dtype, copy=False), starts[1:], end_id)
            ends = starts[1:] + np.arange(1, len(starts))
            names = batch.column(0).fill_null(int(_NULL_ID)).to_numpy(zero_copy_only=False)
            at, row = 0, 0
            while row < len(ends):
                to = min(len(ends), int(np.searchsorted(ends, at + shard_tokens - n_tokens)) + 1)
                kept.append(ids[at : ends[to - 1]].copy())
                doc_ids += names[row:to].tolist()
                lengths += np.diff(ends[row:to], prepend=at).tolist()
                n_tokens += int(ends[to - 1]) - at
                at, row = int(ends[to - 1]), to
                if n_tokens >= shard_tokens:
                    yield flush()
        if kept:
            yield flush()

    rows = columns_as(docs, id="doc_id", text="text").withColumn("id", F.col("id").cast("long"))
    order = ["id", F.substring("text", 1, PREFIX), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.select("id", "text", *[F.col(c).alias(f"k{k}") if k == 0 else c.alias(f"k{k}") for k, c in enumerate(order)])
    rows = rows.repartitionByRange(n, "k0", "k1", "k2", "k3").sortWithinPartitions("k0", "k1", "k2", "k3").select("id", "text")
    return stored(rows.mapInArrow(write, "part int, seq int, path string, docs long, tokens long"), "wavelet-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The ids before each shard: a running sum within a part, and one over parts (a row for each of them)."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("sum"))
    before = parts.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return manifest.join(before, "part").withColumn("base", F.col("before") + inside)


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_shards(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """A row per document, read from the shard files: doc_id, start, n_tokens, ids_crc32 and, unless left out, ids."""
    schema = _DOCS if with_ids else pa.schema(list(_DOCS)[:-1])

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_input(path) as file:
                    shard = WaveletFile(file)
                    ids = shard.decode()
                    wide, ends = ids.astype("<u4"), shard.starts + shard.lengths
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(shard.starts, ends, strict=True)]
                    columns = [pa.array(shard.doc_ids, mask=shard.doc_ids == _NULL_ID), base + shard.starts, shard.lengths.astype(np.int64), crc]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array([*shard.starts, len(ids)], pa.int32()), pa.array(wide.astype(np.int32))))
                    yield arrow_batch(schema, columns)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_starts(manifest).select("path", "base").repartition(n)
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


_FOUND = pa.schema([("path", pa.string()), ("doc_id", pa.int64()), ("place", pa.int64())])


def find_token(manifest: DataFrame, token: int) -> DataFrame:
    """Every occurrence of a token by select on the compressed planes: path, doc_id, place in its document.

    Null doc_ids are null here too; rows that share one are found one by one. A token that no document has, or an empty
    manifest, gives no rows. Many occurrences are found together, batch by batch.
    """

    def find(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as file:
                    shard = WaveletFile(file)
                    for first in range(0, shard.count(token), FOUND_ROWS):
                        at = shard.places(token, first, first + FOUND_ROWS)
                        doc = np.searchsorted(shard.starts, at, side="right") - 1
                        names = shard.doc_ids[doc]
                        yield arrow_batch(_FOUND, [[path] * len(at), pa.array(names, mask=names == _NULL_ID), at - shard.starts[doc]])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n).mapInArrow(find, "path string, doc_id long, place long")
