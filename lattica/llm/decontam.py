"""Operator 8: benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask looks at some of a run of words and ignores the others, so texts that differ in ignored places share a hash. The
masks are laid over every place of every benchmark item and document; equal hashes are joined. Hits are a few numbers each and
become bits of the diagonal that they lie on before anything is shuffled, so repeats within a text, or of a text, cost no more rows.
Only then are the words of a document and an item put beside each other, once, and compared along each diagonal. A hit
counts if it lies in a span, of any length, in which enough words and a large enough share of them agree (WHOLE, as the
queries have it), or if the words within a set distance do. Such a window loses quotes from within a longer item, as the words
around them count too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_as, fresh, let, stored

WORDS = r"[^\p{L}\p{M}\p{N}]+"
#: For shares that floating point does not hold exactly.
EPSILON = 1e-9
#: Places of a diagonal that one whole number holds.
BITS = 64


@dataclass(frozen=True)
class Seeds:
    #: 1: a word that counts; each has six. Of overlaps of 12 words with 2 changed they hit 0.985 (of all choices of the changed
    #: words), of 13 with 2 all, of 15 with 3 0.987, of 20 with 4 0.9998. "1100011011" as a fourth would hit all of these.
    masks: tuple[str, ...] = ("110101011", "111001011", "1111101")
    #: Words compared on either side of a hit; None: as many as the texts have, to find the longest span that agrees enough.
    around: int | None = 12
    #: The share of the words compared, or of a span's, that must agree, and how many must at least.
    share: float = 0.8
    least: int = 12
    #: Items of fewer than least words count as a whole, but for a share of 1 - share; those of fewer than this are not looked for.
    shortest: int = 5
    #: Benchmark hashes up to which they are broadcast; beyond, both sides are shuffled by hash.
    broadcast_rows: int = 2_000_000

    @property
    def span(self) -> int:
        return max(map(len, self.masks))

    def changes(self, n: int) -> int:
        """Words of an item of n that may differ."""
        return int((1 - self.share) * n + EPSILON)

    def parts(self, n: int) -> list[tuple[int, int]]:
        """(place, length) of the parts of a short item: as many as it may have changed words, and one that must agree."""
        k = self.changes(n) + 1
        ends = [n * i // k for i in range(k + 1)]
        return [(a, b - a) for a, b in zip(ends, ends[1:])]


#: Spans of any length.
WHOLE = Seeds(around=None)


def words(text: Column) -> Column:
    """A text's words in lower case (null: none)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), "")


def _hashes(rows: DataFrame, masks: list[str]) -> DataFrame:
    """rows (with words) by mask and place: mask, place, hash. One generator over places and masks keeps it in one stage."""
    n, k = F.size("words"), len(masks)
    spots = F.explode(F.sequence(F.lit(0), n * k - 1)).alias("spot")
    spread = rows.where(n >= min(map(len, masks))).select("*", spots).select("*", (F.col("spot") % k).alias("mask"), F.expr(f"spot div {k}").cast("int").alias("place"))
    # One expression for all masks, with the words that count looked up by mask: code that is compiled must stay short.
    counts = [[i for i, c in enumerate(mask) if c == "1"] for mask in masks]
    of_mask = lambda values: F.get(F.array(*[F.lit(v).cast("int") for v in values]), F.col("mask"))
    looked = [F.get("words", F.col("place") + of_mask([c[j] if j < len(c) else None for c in counts])) for j in range(max(map(len, counts)))]
    fits = F.col("place") + of_mask(map(len, masks)) <= n
    return spread.drop("spot").withColumn("hash", F.when(fits, F.xxhash64("mask", *looked))).where("hash is not null")


def _differing(theirs: Column, ours: Column, length: Column) -> Column:
    """Places where the words differ, between one before the first and one after the last."""
    differs = F.filter(F.transform(F.zip_with(theirs, ours, lambda a, b: a != b), lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    return F.concat(F.array(F.lit(-1)), differs, F.array(length))


def _best_span(bounds: Column, length: Column, begin: Column, end: Column, share: float) -> Column:
    """(agree, compared) of the span with most equal words that holds begin to end and has that share; else null or nulls.

    A longest span begins after a differing word and ends before one (bounds). With as many words as bad before a place, a span
    has the share if (1 - share) * place - bad is not less at its end than at its begin.
    """
    score = lambda p: (1 - share) * p["at"] - p["bad"]
    begins = F.filter(F.transform(bounds, lambda b, k: F.struct((b + 1).alias("at"), k.alias("bad"))), lambda p: p["at"] <= begin)
    ends = F.filter(F.transform(bounds, lambda b, k: F.struct(b.alias("at"), (k - 1).alias("bad"))), lambda p: p["at"] >= end)

    def paired(both: Column) -> Column:
        top = F.array_max(F.transform(both["ends"], score))
        return let(F.struct(let(top, lambda t: F.filter(both["begins"], lambda p: score(p) <= t + EPSILON)).alias("begins"), both["ends"].alias("ends")), longest)

    def longest(both: Column) -> Column:
        low = F.array_min(F.transform(both["begins"], score))
        useful = let(low, lambda v: F.filter(both["ends"], lambda p: score(p) >= v - EPSILON))
        first = lambda r: F.get(F.filter(both["begins"], lambda p: score(p) <= score(r) + EPSILON), 0)
        measured = lambda r: let(first(r), lambda b: F.struct((r["at"] - b["at"] - r["bad"] + b["bad"]).alias("agree"), (r["at"] - b["at"]).alias("compared")))
        return F.array_max(F.transform(useful, measured))

    agree = length - F.size(bounds) + 2
    whole = F.struct(agree.alias("agree"), length.alias("compared"))
    return F.when(agree >= share * length - EPSILON, whole).otherwise(let(F.struct(begins.alias("begins"), ends.alias("ends")), paired))


def _key(text: Column) -> Column:
    """What tells texts apart: two hashes."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))


def _ones(bits: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("getbit", bits, i) == 1)


def _begun(blocks: Column) -> Column:
    """Places of the hits on a diagonal of which none lies one place before, from blocks (block, bits) in order."""
    def places(b: Column, i: Column) -> Column:
        last = let(F.get(blocks, i - 1), lambda p: F.when((i > 0) & (p["block"] == b["block"] - 1), F.shiftrightunsigned(p["bits"], BITS - 1)).otherwise(F.lit(0).cast("long")))
        begins = b["bits"].bitwiseAND(F.bitwise_not(F.shiftleft(b["bits"], 1).bitwiseOR(last)))
        return F.transform(_ones(begins), lambda k: (b["block"] * BITS + k).cast("int"))

    return F.flatten(F.transform(blocks, places))


def _overlaps(docs: DataFrame, benchmark: DataFrame, seeds: Seeds) -> DataFrame:
    """(key, item, hits, best): texts of docs and items that overlap; see contaminated()."""
    items = columns_as(benchmark, item="item_id", text="text").select("item", words(F.col("text")).alias("item_words")).distinct().withColumn("item_key", F.xxhash64("item_words"))
    size = F.size("item_words")
    about = items.agg(F.sum(size).alias("words"), F.collect_set(F.when((size < seeds.least) & (size >= seeds.shortest), size)).alias("short")).first()
    whole = len(seeds.masks)  # masks from here on are parts of short items
    parts = {(n, place, length) for n in about.short for place, length in seeds.parts(n)}
    masks = [*seeds.masks, *("1" * n for n in sorted({length for _, _, length in parts}))]
    bounded = F.broadcast if (about.words or 0) * len(masks) <= seeds.broadcast_rows else (lambda df: df)
    lengths = F.array(*[F.lit(len(m)) for m in masks])
    keys = _hashes(items.select("item_key", F.col("item_words").alias("words")).distinct(), masks)
    of_short = F.lit(False)
    for n, place, length in sorted(parts):
        of_short |= (F.size("words") == n) & (F.col("place") == place) & (F.col("mask") == masks.index("1" * length, whole))
    keys = keys.where((F.col("mask") < whole) | of_short)
    keys = keys.select("hash", "item_key", F.col("mask").alias("item_mask"), F.col("place").alias("item_place"))

    texts = columns_as(docs, text="text").withColumn("key", _key(F.col("text")))
    hits = _hashes(texts.select("key", words(F.col("text")).alias("words")), masks).select("key", "mask", "place", "hash")
    hits = hits.join(bounded(keys), "hash").where("mask = item_mask")
    block = F.expr(f"item_place div {BITS}").cast("int")
    line = hits.groupBy("key", "item_key", (F.col("place") - F.col("item_place")).alias("shift"), "mask", block.alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("item_place") % BITS)).alias("bits"))
    blocks = F.array_sort(F.collect_list(F.struct("block", "bits")))
    lines = line.groupBy("key", "item_key", "shift", "mask").agg(blocks.alias("blocks"), F.sum(F.bit_count("bits")).alias("hits"))
    # Parts of short items stand alone: their hits are few, and all count.
    every = F.flatten(F.transform("blocks", lambda b: F.transform(_ones(b["bits"]), lambda k: (b["block"] * BITS + k).cast("int"))))
    places = every if seeds.around is not None else F.when(F.col("mask") < whole, _begun(F.col("blocks"))).otherwise(every)
    ends = F.transform(places, lambda p: F.struct(p.alias("begin"), (p + F.get(lengths, F.col("mask"))).alias("end")))
    lines = lines.groupBy("key", "item_key", "shift").agg(F.flatten(F.collect_list(ends)).alias("seeds"), F.sum("hits").alias("hits"))
    pairs = stored(lines.groupBy("key", "item_key").agg(F.collect_list(F.struct("shift", "seeds", "hits")).alias("lines")), "decontam-pairs")

    matched = pairs.select("key").distinct()
    matched = F.broadcast(matched) if pairs.count() <= seeds.broadcast_rows else matched
    quoting = texts.join(matched, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    both = pairs.join(quoting, "key").withColumn("words", words(F.col("text"))).drop("text").join(bounded(items), "item_key")
    ours = F.size("words")
    low, end = (lambda d: F.greatest(F.lit(0), -d["shift"])), (lambda d: F.least(size, ours - d["shift"]))

    def compared(d: Column, a: Column, b: Column, body) -> Column:
        return body(F.slice("item_words", a + 1, b - a), F.slice("words", a + d["shift"] + 1, b - a))

    def spans(d: Column) -> Column:
        """The best span of a diagonal."""
        n = end(d) - low(d)
        bounds = compared(d, low(d), end(d), lambda x, y: _differing(x, y, n))
        return let(bounds, lambda v: F.struct(F.array_max(F.transform(d["seeds"], lambda s: _best_span(v, n, s["begin"] - low(d), s["end"] - low(d), seeds.share))).alias("best"), d["hits"].alias("hits")))

    def windows(d: Column) -> Column:
        """The best window of a diagonal, and how many hits have one."""
        def one(s: Column) -> Column:
            a, b = F.greatest(low(d), s["begin"] - seeds.around), F.least(end(d), s["end"] + seeds.around)
            agree = compared(d, a, b, lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same)))
            return let(agree, lambda n: F.when((n >= seeds.share * (b - a) - EPSILON) & (n >= needed), F.struct(n.alias("agree"), (b - a).alias("compared"))))

        return let(F.filter(F.transform(d["seeds"], one), lambda w: w.isNotNull()), lambda w: F.struct(F.array_max(w).alias("best"), F.size(w).cast("long").alias("hits")))

    needed = F.when(size < seeds.least, size - F.floor((1 - seeds.share) * size + EPSILON)).otherwise(seeds.least)
    found = both.select("key", "item", needed.alias("needed"), F.transform("lines", spans if seeds.around is None else windows).alias("lines"))
    found = found.withColumn("lines", F.filter("lines", lambda d: d["best"]["agree"] >= F.col("needed"))).where("size(lines) > 0")
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda n, d: n + d["hits"])
    return stored(found.select("key", "item", total.alias("hits"), F.array_max(F.transform("lines", lambda d: d["best"])).alias("best")), "decontam-found")


def contaminated(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """(doc_id, item_id, hits, agree, compared): document and item pairs that overlap, the hits of each and its best overlap's words.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null text: no words. Null ids are kept as
    such; rows that repeat an id count together. Items of fewer than seeds.least words match as a whole, but for a share of
    1 - seeds.share of their words; items of fewer than seeds.shortest words never. Empty tables give no rows.
    """
    found = _overlaps(docs, benchmark, seeds)
    few = F.broadcast if found.count() <= seeds.broadcast_rows else (lambda df: df)
    rows = columns_as(docs, doc="doc_id", text="text").select("doc", _key(F.col("text")).alias("key")).join(few(found), "key")
    pairs = rows.groupBy("doc", "item").agg(F.sum("hits").alias("hits"), F.max("best").alias("best"))
    return pairs.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "hits", "best.agree", "best.compared")


def cleaned(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """docs without the rows whose text is contaminated, whatever their doc_id: null ones go, and rows that share one with them stay."""
    found = _overlaps(docs, benchmark, seeds).select("key").distinct()
    few = F.broadcast if found.count() <= seeds.broadcast_rows else (lambda df: df)
    own = fresh(docs, "key")[0]
    kept = docs.withColumn(own, _key(F.col("`text`"))).join(few(found.withColumnRenamed("key", own)), own, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def clean(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """For uses in which doc_id is a key: docs without the rows whose doc_id is contaminated. A null doc_id stays; cleaned() goes by rows."""
    bad = contaminated(docs, benchmark, seeds).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
