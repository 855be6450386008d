"""Operator 2: SimHash near-duplicates, candidates by the pigeonring principle.

A fingerprint is cut into three segments that form a ring. Two fingerprints that differ in at most 4 bits have, from
some segment on, chains whose differences stay in proportion: at most floor(4/3) = 1 bit in the first segment and at
most floor(8/3) = 2 in the first two. For each of the three beginnings, every fingerprint is filed under the values of
those two segments with no bit and with each one bit flipped, so fingerprints up to 2 bits apart there meet in a file.
In a file, the chain's first link is checked, then the Hamming distance of the whole.

Only distinct fingerprints are filed. A file gives a spanning forest of its links, not its pairs. Where a file outgrows
a bound, its members leave it for an exact other way: fingerprints up to 4 apart share some value at most 2 from both.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from .common import HOT_ROWS, arrow_batch, columns_as, dealt_join, fresh, sliced, stored

DISTANCE = 4
SHINGLE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
#: Members of a file beyond which the exact other way is taken for them.
CROWDED = 20_000
SEED = 42


def fingerprint(data: bytes) -> int:
    """64 bits, each set if it is in over half the XXH64 of the shingles of words, repeats included; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(line, SEED)
    hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)], dtype="<u8")
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's 64 bits as a long. Null text: no words, so 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            yield arrow_batch(schema, [batch.column(0), np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)])

    return columns_as(docs, id="doc_id", text="text").withColumn("id", F.col("id").cast("long")).mapInArrow(run, "doc_id long, fp long")


def _variants(bits: list[int], flips: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(bits, k)], dtype=np.uint64)


def _filed(batches):
    """(key, fp): a key holds the beginning, and two segments with at most one bit flipped."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    flips = []
    for k, (first, n) in enumerate(SEGMENTS):
        second, m = SEGMENTS[(k + 1) % 3]
        flips.append((k, first, n, second, m, _variants(list(range(n + m)), 1)))
    for batch in batches:
        all_fp = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(all_fp), 4096):
            fp = all_fp[at : at + 4096]
            for k, first, n, second, m, masks in flips:
                a = (fp >> np.uint64(first)) & np.uint64((1 << n) - 1)
                b = (fp >> np.uint64(second)) & np.uint64((1 << m) - 1)
                keys = ((a | b << np.uint64(n))[:, None] ^ masks[None, :]) | np.uint64(k << 44)
                yield arrow_batch(schema, [keys.ravel().view(np.int64), np.repeat(fp.view(np.int64), len(masks))])


def linked(one: np.uint64, others: np.ndarray, beginning: int) -> np.ndarray:
    """Which others the chain from this beginning, then the whole distance, leaves linked to one fingerprint."""
    differ = others ^ one
    first, n = SEGMENTS[beginning]
    out = np.bitwise_count((differ >> np.uint64(first)) & np.uint64((1 << n) - 1)) <= DISTANCE // 3
    second, m = SEGMENTS[(beginning + 1) % 3]
    both = np.uint64(((1 << n) - 1 << first) | ((1 << m) - 1 << second))
    out[out] = np.bitwise_count(differ[out] & both) <= 2 * DISTANCE // 3
    out[out] = np.bitwise_count(differ[out]) <= DISTANCE
    return out


def forest(members: np.ndarray, beginning: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links within a file: each member is compared with those not yet reached."""
    edges, rest = [], members
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            near = queue.pop()
            for one in near:
                hit = linked(one, rest, beginning)
                if hit.any():
                    found, rest = rest[hit], rest[~hit]
                    edges.append((np.full(len(found), one), found))
                    queue.append(found)
    return edges


def _links(crowded: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        """Reads (key, fp) sorted by both; gives links (a, b), or (a, null) for a member of a crowded file."""
        key, held, overfull = None, [], False

        def close():
            members = np.concatenate(held) if len(held) != 1 else held[0]
            edges = forest(members, key >> 44)
            if edges:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*edges, strict=True))
                yield arrow_batch(schema, [a, b])

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            begins = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
            ends = np.append(begins[1:], len(keys))
            # Files of two within this batch, all at once.
            two = begins[1:-1][(ends - begins)[1:-1] == 2]
            for k in range(3):
                at = two[keys[two] >> 44 == k]
                if len(at):
                    ok = linked(fps[at], fps[at + 1], k)
                    if ok.any():
                        yield arrow_batch(schema, [fps[at][ok].view(np.int64), fps[at + 1][ok].view(np.int64)])
            sizes = ends - begins
            keep = sizes > 2
            keep[0] = keep[-1] = True
            for begin, end in zip(begins[keep].tolist(), ends[keep].tolist(), strict=True):
                if keys[begin] != key:
                    if held and not overfull:
                        yield from close()
                    key, held, overfull = int(keys[begin]), [], False
                part = fps[begin:end].copy()
                if not overfull:
                    held.append(part)
                    if sum(map(len, held)) > crowded:
                        overfull, part, held = True, np.concatenate(held), []
                if overfull:
                    yield arrow_batch(schema, [part.view(np.int64), pa.nulls(len(part), pa.int64())])
        if held and not overfull:
            yield from close()

    return run


def _balls(batches):
    """(c, fp) for all values c at most 2 bits from fp."""
    schema = pa.schema([("c", pa.int64()), ("fp", pa.int64())])
    masks = _variants(list(range(64)), DISTANCE // 2)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            fp = batch.column(0).slice(at, 256).to_numpy().view(np.uint64)
            yield arrow_batch(schema, [(fp[:, None] ^ masks[None, :]).ravel().view(np.int64), np.repeat(fp.view(np.int64), len(masks))])


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough of them to join all that are linked, directly or not."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = distinct.select("fp").mapInArrow(_filed, "key long, fp long")
    found = stored(filed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_links(crowded), "a long, b long"), "simhash-links")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return found
    balls = stored(hot.mapInArrow(_balls, "c long, fp long"), "simhash-balls")
    stars = balls.groupBy("c").agg(F.min("fp").alias("a"))
    return found.where("b is not null").unionByName(balls.join(stars, "c").where("fp <> a").select("a", F.col("fp").alias("b")).distinct())


def classes(docs: DataFrame, crowded: int = CROWDED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row; root names the class of its fingerprint, component_id as below."""
    rows = stored(fingerprints(docs), "simhash-fp")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = connected_components(links(distinct, crowded), "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    whole = distinct.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = stored(whole.join(least, "root").select("fp", "n", "root", "component_id"), "simhash-classes")
    return dealt_join(rows, facts, "fp", "n", hot_rows=hot_rows).select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reached over links of at most 4 bits.

    docs: doc_id (long) and text; other columns are ignored. Null or empty text: fingerprint 0, linked like any other.
    Repeated rows: a row each. Null doc_id: not a candidate for component_id, which is null only where all are.
    """
    return classes(docs, crowded).select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def _beside_prints(docs: DataFrame, fp: str) -> DataFrame:
    """docs with their fingerprints in a column of that name."""
    plain = [f"k{k}" for k in range(len(docs.columns))]
    place = docs.columns.index("text")

    def run(batches):
        for batch in sliced(batches, column=place):
            texts = batch.column(place).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            prints = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*plain, "fp"])

    schema = T.StructType([T.StructField(k, f.dataType) for k, f in zip(plain, docs.schema.fields, strict=True)] + [T.StructField("fp", T.LongType())])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns, fp)


def _least(docs: DataFrame):
    """An order of rows: by text, then by a hash of what may be hashed."""
    plain = [f.name for f in docs.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.struct(F.col("text").alias("text"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("hash"))


def deduplicated(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """One row of docs, with its columns, for each class of near-duplicates: that whose doc_id is the class's component_id.

    Rows that share a doc_id but are in different classes stay, each for its own class; of those in one class, that with the
    least text stays (then the least hash of its columns). A class without any doc_id keeps one row likewise. Null or empty
    texts are a class of their own (fingerprint 0). An empty table gives no rows; columns may have any names.
    """
    own, fp, root, same = fresh(docs, "own", "fp", "root", "same")
    found = classes(docs, crowded).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stored(found.select(F.col("doc_id").alias(own), F.col("fp").alias(fp), F.col("root").alias(root)).distinct(), "simhash-kept")
    key = F.col("doc_id").cast("long")
    ids = docs.groupBy(key.alias(own)).agg(F.count("*").alias("n"))
    several = stored(ids.where(F.col(own).isNull() | (F.col("n") > 1)).select(own), "simhash-several")
    if several.isEmpty():
        return docs.join(kept.select(own).distinct(), key == F.col(own), "left_semi")
    single = kept.select(own).where(F.col(own).isNotNull()).distinct().join(several, own, "left_anti")
    out = docs.join(single, key == F.col(own), "left_semi")
    unsure = kept.join(several.withColumnRenamed(own, same), F.col(own).eqNullSafe(F.col(same)), "left_semi")
    rows = docs.join(several, key.eqNullSafe(F.col(own)), "left_semi")
    rows = _beside_prints(rows, fp).withColumn(own, key).join(unsure.withColumnRenamed(own, same), [fp], "inner").where(F.col(own).eqNullSafe(F.col(same)))
    every = [F.col(f"`{c}`") for c in docs.columns]
    best = rows.groupBy(own, root).agg(F.min_by(F.struct(*[c.alias(f"k{k}") for k, c in enumerate(every)]), _least(docs)).alias("best"))
    return out.unionByName(best.select(*[F.col(f"best.k{k}").alias(c) for k, c in enumerate(docs.columns)])).select(*every)


def representatives(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """For uses in which doc_id is a key: of deduplicated rows that share a doc_id only that with the least text.

    Where rows of different texts share a doc_id, this drops all but one of them; deduplicated() does not. Rows without a
    doc_id all stay.
    """
    rows = deduplicated(docs, crowded)
    own = fresh(docs, "own")[0]
    every = [F.col(f"`{c}`") for c in docs.columns]
    named = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.min_by(F.struct(*[c.alias(f"k{k}") for k, c in enumerate(every)]), _least(docs)).alias("best"))
    return named.select(*[F.col(f"best.k{k}").alias(c) for k, c in enumerate(docs.columns)]).unionByName(rows.where("doc_id is null").select(*every))
