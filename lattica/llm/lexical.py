"""Operator 13: ranked lexical search by dual-sorted wavelet trees, one per shard of documents.

A shard's postings stand term after term, each term's in descending order of impact, and a wavelet matrix holds their document
numbers: its levels part the documents by number, stably, so within any node a term's postings are still in order of impact and
the first of them bounds all documents below. A search keeps, for each node, the ranges of a query's terms that are not empty;
the sum of their first impacts bounds the node, and the nodes with the highest bounds are opened first. A leaf is one document
with its exact score. What can neither reach the floor nor the k documents found so far is dropped.

Weights need the whole collection: its size and length are counted first, as impacts depend on them, and document
frequencies are summed over the shards' dictionaries. A short descent in every shard (the best few nodes of each level) gives a
floor for each query, the k-th score found anywhere; the whole search then opens only what may reach it. Queries go in blocks
of bounded size.

File: magic, header length (u32), header as JSON, then by sections, each compressed: document numbers' ids, terms, their lengths
in bytes, their numbers of postings, impacts, and the bits of each level.
"""

from __future__ import annotations

import json
import math
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, columns_as, new_folder, open_input, sliced, stored, write_bytes

MAGIC = b"LDSW0001"
#: A shard ends with the document that brings it to so many bytes, or so many documents.
SHARD_BYTES, SHARD_DOCS = 24 << 20, 1 << 17
#: Nodes of a query that are opened at once, and queries searched together.
BEAM, TOGETHER = 16, 64
#: Queries, and bytes of their terms, in a block.
BLOCK_QUERIES, BLOCK_BYTES = 1024, 4 << 20
#: Inner nodes hold impacts in steps of so many, rounded up.
STEP = 16
#: What is no term, as a class of code points.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULT = "item_id long, rank int, doc_id long, score long"

_PLAIN = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if _PLAIN[b] else 32 for b in range(256))


def terms(text: Column) -> Column:
    """A text's terms, with repeats (null: none)."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, SEPARATORS), "")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


# --- the whole collection -----------------------------------------------------------------------


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Where each text begins and ends, and all bytes, of a large_string array without nulls."""
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), data.to_pybytes() if data else b""


def term_counts(texts: pa.Array) -> np.ndarray:
    """How many terms each text has."""
    offsets, data, _ = _text_bytes(texts)
    plain = _PLAIN[data]
    begins = plain.copy()
    begins[1:] &= ~plain[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = plain[first]
    return np.diff(np.concatenate(([0], np.cumsum(begins)))[offsets])


def collection(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    schema = pa.schema([("n", pa.int64()), ("length", pa.int64())])

    def run(batches):
        n = length = 0
        for batch in sliced(batches, column=0):
            counts = term_counts(batch.column(0).cast(pa.large_string()).fill_null(""))
            n, length = n + int(np.count_nonzero(counts)), length + int(counts.sum())
        yield arrow_batch(schema, [[n], [length]])

    found = columns_as(docs, text="text").mapInArrow(run, "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    return found.n or 0, found.length or 0


# --- shards -------------------------------------------------------------------------------------


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 10 + (90 * n * documents) // max(1, length)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def build(doc_ids: np.ndarray, texts: pa.Array, documents: int, length: int) -> bytes:
    """The file of a shard: doc_ids (ascending) and their texts (large_string, no null)."""
    offsets, _, data = _text_bytes(texts)
    clean = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.translate(_TABLE))])
    lists = pc.ascii_split_whitespace(clean)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    number = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    words = coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        number, codes = number[codes != empty], codes[codes != empty]
    size = np.bincount(number, minlength=len(texts))
    pair, tf = np.unique(codes * len(texts) + number, return_counts=True)
    code, number = pair // max(1, len(texts)), pair % max(1, len(texts))
    impact = impacts(tf.astype(np.int64), size[number].astype(np.int64), documents, length)
    order = np.argsort(code << 20 | (1 << 20) - 1 - impact, kind="stable")  # an impact is less than 2 ** 20
    now, impact = number[order].astype(np.uint32), impact[order]
    kept, counts = np.unique(code, return_counts=True)
    words = words.take(pa.array(kept)).cast(pa.large_binary())
    width, levels, zeros = max(1, (len(texts) - 1).bit_length()), [], []
    for level in range(width - 1, -1, -1):
        ones = (now >> level & 1).astype(bool)
        levels.append(np.packbits(ones, bitorder="little").tobytes())
        zeros.append(int(len(now) - np.count_nonzero(ones)))
        now = np.concatenate((now[~ones], now[ones]))
    press = zstandard.ZstdCompressor(level=1)
    raw = [doc_ids.astype("<i8").tobytes(), b"".join(words.to_pylist()), pc.binary_length(words).to_numpy().astype("<u4").tobytes(), counts.astype("<u4").tobytes(), impact.astype("<u4").tobytes(), *levels]
    sections = [press.compress(s) for s in raw]
    head = json.dumps({"docs": len(texts), "terms": len(kept), "postings": len(now), "width": width, "zeros": zeros, "sections": list(map(len, sections)), "raw": list(map(len, raw))}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


class Dictionary:
    """A shard's terms and their ranges among its postings, read without the rest of the file."""

    def __init__(self, file):
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a shard of postings")
        (size,) = struct.unpack("<I", file.read(4))
        self.head = json.loads(file.read(size))
        self.at = 12 + size
        data, lengths, counts = (self.section(k) for k in (1, 2, 3))
        ends = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64)))
        self.terms = pa.Array.from_buffers(pa.large_string(), self.head["terms"], [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        self.ends = np.concatenate(([0], np.cumsum(np.frombuffer(counts, "<u4"), dtype=np.int64)))

    def section(self, k: int) -> bytes:
        sizes = self.head["sections"]
        self.file.seek(self.at + sum(sizes[:k]))
        return zstandard.ZstdDecompressor().decompress(self.file.read(sizes[k]), max_output_size=self.head["raw"][k] or 1)

    def ranges(self, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's postings begin and end; equal for a term that the shard lacks."""
        at = pc.index_in(wanted, value_set=self.terms).fill_null(-1).to_numpy()
        return np.where(at < 0, 0, self.ends[at]), np.where(at < 0, 0, self.ends[at + 1])


class Postings(Dictionary):
    """A whole shard, for searches."""

    def __init__(self, file):
        super().__init__(file)
        n, self.width, self.zeros = self.head["postings"], self.head["width"], np.array(self.head["zeros"], np.int64)
        self.doc_ids = np.frombuffer(self.section(0), "<i8")
        impact = np.frombuffer(self.section(4), "<u4")
        longs = n // 64 + 1
        self.bits = np.zeros((self.width, longs), np.uint64)
        self.before = np.zeros((self.width, longs), np.uint32)
        #: By level, the impacts of the postings as that level has them: rounded up to steps, but for the leaves.
        self.bounds = np.zeros((self.width, n), np.uint16)
        for level in range(self.width):
            raw = np.frombuffer(self.section(5 + level), np.uint8)
            self.bits[level].view(np.uint8)[: len(raw)] = raw
            self.before[level, 1:] = np.cumsum(np.bitwise_count(self.bits[level]), dtype=np.uint32)[:-1]
            self.bounds[level] = -(-impact.astype(np.int64) // STEP)
            ones = np.unpackbits(raw, count=n, bitorder="little").view(bool)
            impact = np.concatenate((impact[~ones], impact[ones]))
        self.leaves = impact

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many ones a level has before a place."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level, word].astype(np.int64) + np.bitwise_count(self.bits[level, word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, floor: np.ndarray, descent: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document number, score) of each query's first k documents by score, equal ones by number.

        queries: begins, ends and weights of their terms' ranges. Only scores from floor on, and over 0, count. A descent opens
        the best nodes of each level alone: all it gives are right scores, but there may be better ones.
        """
        floor = np.maximum(floor, 1)
        last, last_doc = np.full(len(queries), -1, np.int64), np.full(len(queries), -1, np.int64)
        found = np.zeros((3, 0), np.int64)  # query, document, score
        sizes = np.array([len(b) for b, _, _ in queries], np.int64)
        query = np.flatnonzero(sizes)
        level, prefix, count = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64), sizes[query]
        begin, end, by = (np.concatenate([q[i] for q in queries] or [[]]).astype(np.int64) for i in range(3))
        bound = np.add.reduceat(self.bounds[0, begin] * by * STEP, np.cumsum(count) - count) if len(query) else np.zeros(0, np.int64)
        while len(query):
            starts = np.cumsum(count) - count
            order = np.lexsort((prefix << (self.width - level), -bound, query))
            place = np.arange(len(order)) - np.searchsorted(query[order], query[order], side="left")
            opened = np.zeros(len(query), bool)
            opened[order[place < BEAM]] = True
            rest = ~opened & (not descent)
            take = lambda which: np.repeat(starts[which] - np.cumsum(count[which]) + count[which], count[which]) + np.arange(int(count[which].sum()))  # noqa: B023, E731
            mine, stay = take(opened), take(rest)
            of = np.repeat(np.arange(int(opened.sum())), count[opened])
            at = level[opened][of]
            low, high = self.ones(at, begin[mine]), self.ones(at, end[mine])
            sides = [(begin[mine] - low, end[mine] - high), (self.zeros[at] + low, self.zeros[at] + high)]
            # Children of one side, then those of the other; each keeps the terms that it still has.
            to_begin, to_end = (np.concatenate([s[i] for s in sides]) for i in range(2))
            to_of, to_by = np.concatenate((2 * of, 2 * of + 1)), np.tile(by[mine], 2)
            full = to_begin < to_end
            to_begin, to_end, to_of, to_by = to_begin[full], to_end[full], to_of[full], to_by[full]
            sort = np.argsort(to_of, kind="stable")
            to_begin, to_end, to_of, to_by = to_begin[sort], to_end[sort], to_of[sort], to_by[sort]
            node, first, to_count = np.unique(to_of, return_index=True, return_counts=True)
            parent = node >> 1
            to_query, to_level = query[opened][parent], level[opened][parent] + 1
            to_prefix = prefix[opened][parent] << 1 | (node & 1)
            entry_level = np.repeat(to_level, to_count)
            leaf = entry_level == self.width
            best = np.empty(len(to_begin), np.int64)
            best[leaf] = self.leaves[to_begin[leaf]]
            best[~leaf] = self.bounds[entry_level[~leaf], to_begin[~leaf]].astype(np.int64) * STEP
            to_bound = np.add.reduceat(best * to_by, first) if len(first) else np.zeros(0, np.int64)
            done = to_level == self.width
            done_ok = done & (to_bound >= floor[to_query])
            if done_ok.any():
                found = np.concatenate((found, [to_query[done_ok], to_prefix[done_ok], to_bound[done_ok]]), axis=1)
                found = found[:, np.lexsort((found[1], -found[2], found[0]))]
                place = np.arange(found.shape[1]) - np.searchsorted(found[0], found[0], side="left")
                found, place = found[:, place < k], place[place < k]
                full_list = place == k - 1
                last[found[0, full_list]], last_doc[found[0, full_list]] = found[2, full_list], found[1, full_list]
            ahead = ~done
            inner = np.repeat(ahead, to_count)
            begin, end, by = (np.concatenate((a[stay], b[inner])) for a, b in ((begin, to_begin), (end, to_end), (by, to_by)))
            query, level, prefix, count, bound = (np.concatenate((a[rest], b[ahead])) for a, b in ((query, to_query), (level, to_level), (prefix, to_prefix), (count, to_count), (bound, to_bound)))
            small = prefix << (self.width - level)
            keep = (bound >= floor[query]) & ((bound > last[query]) | ((bound == last[query]) & (small < last_doc[query])))
            if not keep.all():
                entries = np.repeat(keep, count)
                begin, end, by = begin[entries], end[entries], by[entries]
                query, level, prefix, count, bound = query[keep], level[keep], prefix[keep], count[keep], bound[keep]
        return found[0], found[1], found[2]


def write_shards(docs: DataFrame, documents: int, length: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(path, docs, postings) of the shard files written. Documents stay in the partitions in which they are read."""
    folder = new_folder(docs.sparkSession, "lexical")
    schema = pa.schema([("path", pa.string()), ("docs", pa.int64()), ("postings", pa.int64())])

    def run(batches):
        held, size = [], 0

        def close():
            table = pa.Table.from_batches(held).sort_by("id")
            uri = f"{folder}/{uuid.uuid4().hex}.ldsw"
            data = build(table.column(0).to_numpy(), table.column(1).combine_chunks(), documents, length)
            write_bytes(uri, [data])
            head = json.loads(data[12 : 12 + struct.unpack("<I", data[8:12])[0]])
            return arrow_batch(schema, [[uri], [head["docs"]], [head["postings"]]])

        for batch in sliced(batches):
            ids = batch.column(0).fill_null(-(1 << 63))
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            held.append(pa.RecordBatch.from_arrays([ids, texts], ["id", "text"]))
            size += pc.sum(pc.binary_length(texts)).as_py() or 0
            if size >= shard_bytes or sum(map(len, held)) >= SHARD_DOCS:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    rows = columns_as(docs, id="doc_id", text="text").withColumn("id", F.col("id").cast("long"))
    return stored(rows.mapInArrow(run, "path string, docs long, postings long"), "lexical-shards")


# --- searches over all shards ---------------------------------------------------------------------


def _frequencies(shards: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many documents hold each of a block's terms."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as file:
                    begin, end = Dictionary(file).ranges(pa.array(wanted, pa.large_string()))
                total += end - begin
        which = np.flatnonzero(total)
        yield arrow_batch(schema, [which.astype(np.int32), total[which]])

    found = shards.select("path").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {wanted[r.term]: r.df for r in found.collect()}


def _searched(shards: DataFrame, queries: list[tuple[int, list[str]]], weights: dict[str, int], k: int, floor: dict[int, int], descent: bool) -> DataFrame:
    """(qid, doc_id, score): each shard's first k documents of each query of a block, or what a descent finds."""
    schema = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    wanted = sorted(weights)
    place = {t: i for i, t in enumerate(wanted)}
    listed = [(qid, np.array([place[t] for t in ts if weights.get(t, 0) > 0], np.int64)) for qid, ts in queries]
    by = np.array([weights[t] for t in wanted], np.int64)
    floors = np.array([floor.get(qid, 1) for qid, _ in queries], np.int64)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as file:
                    shard = Postings(file)
                    begin, end = shard.ranges(pa.array(wanted, pa.large_string()))
                here = end > begin
                for at in range(0, len(listed), TOGETHER):
                    own = [t[here[t]] for _, t in listed[at : at + TOGETHER]]
                    query, number, score = shard.search([(begin[t], end[t], by[t]) for t in own], k, floors[at : at + TOGETHER], descent)
                    ids = shard.doc_ids[number]
                    yield arrow_batch(schema, [np.array([listed[at + q][0] for q in query.tolist()], np.int64), pa.array(ids, mask=ids == -(1 << 63)), score])

    return shards.select("path").mapInArrow(run, "qid long, doc_id long, score long")


def search(shards: DataFrame, queries: DataFrame, documents: int, k: int = 10) -> DataFrame:
    """(qid, rank, doc_id, score) from shards; queries: qid and terms (array, once each). See ranked()."""
    spark = shards.sparkSession
    about = queries.agg(F.count("*").alias("n"), F.sum(F.length(F.concat_ws(" ", "terms"))).alias("size")).first()
    blocks = max(1, -(-about.n // BLOCK_QUERIES), -(-(about.size or 0) // BLOCK_BYTES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    shards = stored(shards.repartition(max(1, shards.count())), "lexical-listed")  # a task for each shard
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    out = None
    for block in range(blocks):
        asked = [(r.qid, r.terms) for r in queries.where(F.col("block") == block).select("qid", "terms").collect()]  # of bounded size
        df = _frequencies(shards, sorted({t for _, ts in asked for t in ts}))
        weights = {t: w for t, n in df.items() if (w := weight(documents, n)) > 0}
        seen = _searched(shards, asked, weights, k, {}, True).withColumn("rank", first).where(F.col("rank") == k)
        floor = {r.qid: r.score for r in seen.select("qid", "score").collect()}
        best = _searched(shards, asked, weights, k, floor, False).withColumn("rank", first).where(F.col("rank") <= k)
        best = stored(best.select("qid", "rank", "doc_id", "score"), "lexical-found")
        out = best if out is None else out.unionByName(best)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by doc_id.

    docs: doc_id (whole number) and text; items: item_id and text; other columns are ignored. Null or empty texts have no terms.
    Rows that repeat an id, or a whole row, count each, as documents and as items. A null doc_id comes before all others
    of its score. No documents, no items or no term in common: no rows.
    """
    documents, length = collection(docs)
    asked = columns_as(items, item_id="item_id", text="text").select(F.col("item_id").cast("long").alias("item_id"), F.array_distinct(terms(F.col("text"))).alias("terms"))
    asked = stored(asked.where(F.size("terms") > 0).withColumn("qid", F.monotonically_increasing_id()), "lexical-queries")
    shards = write_shards(docs, documents, length)
    found = search(shards, asked.select("qid", "terms"), documents, k)
    return found.join(asked.select("qid", "item_id"), "qid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
