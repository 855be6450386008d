"""Operator 9: secrets, by patterns and by sliding-window entropy, in DataFrame functions only.

Base spans are matches of three patterns. The method adds runs of signs that keys are made of, in which some window's
Shannon entropy reaches the limit of the run's character class. A window's entropy comes from counts that change by the
sign that enters and the one that leaves. An allow-list suppresses added spans; base spans always stay.

Matches are marked by one replacement and the text is split at the marks: a match begins where the parts before it end.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_as, fresh, let, running

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: The runs of [0-9a-f]+ that are long enough: what is shorter is dropped either way.
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: The signs of such runs.
SIGNS = string.ascii_letters + string.digits + "+/_=-"
#: Put around matches; where a text has it, it counts as another sign that is in no match.
MARK, PLAIN = "\x01", "\x02"
#: Signs of a text that are cut out together.
PIECE = 4096
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class Limits:
    assign: int = 6
    access: int = 20
    #: Signs in a window, and the bits per sign that make a run of a class a secret.
    window: int = 20
    hexadecimal: float = 3.0
    alphanumeric: float = 3.6
    other: float = 3.8
    #: Added spans whose whole text matches one of these are no secrets: UUIDs and samples from documentation.
    allow: tuple[str, ...] = (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r".*EXAMPLE(KEY)?", r"(.)\1*")


def found(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """An array of (start, kind, end, value) for the matches, leftmost and not overlapping; keep tests the group's text."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    parts = F.split(F.regexp_replace(F.translate(text, MARK, PLAIN), pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def spans(parts: Column) -> Column:
        def span(ends: Column, part: Column, k: Column) -> Column:
            value = part if group == 0 else F.regexp_extract(part, pattern, group)
            whole = F.struct((F.get(ends, k) - F.length(part)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, k).alias("end"), value.alias("value"))
            return F.when(k % 2 == 1, whole)

        every = let(running(F.transform(parts, F.length)), lambda ends: F.transform(parts, lambda part, k: span(ends, part, k)))
        return F.filter(every, lambda s: s.isNotNull() & (keep(s["value"]) if keep else F.lit(True)))

    return let(parts, lambda p: F.when(F.size(p) > 1, spans(p)).otherwise(none))


def peak_entropy(run: Column, window: int) -> Column:
    """The greatest Shannon entropy, in bits per sign, of a window of the run (of SIGNS), from counts updated sign by sign.

    Counts lie side by side in a few longs; a sign that enters or leaves adds or takes one at its place.
    """
    bits = window.bit_length()
    each = 63 // bits
    lanes = [f"c{k}" for k in range(-(-len(SIGNS) // each))]
    weigh = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])  # c log2 c

    def peak(places: Column) -> Column:
        start = F.struct(*[F.lit(0).cast("long").alias(c) for c in lanes], F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))

        def at(place):
            return F.floor(place / each).cast("int"), (place % each * bits).cast("int")

        def held(counts, place):
            lane, shift = at(place)
            return F.call_function("shiftright", F.get(F.array(*[counts[c] for c in lanes]), lane), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")

        def moved(counts, place, by):
            lane, shift = at(place)
            one = F.call_function("shiftleft", F.lit(by).cast("long"), shift)
            return [F.when(lane == k, counts[c] + one).otherwise(counts[c]).alias(c) for k, c in enumerate(lanes)]

        def leave(state, i):
            def without(place):
                n = held(state, place)
                return F.struct(*moved(state, place, -1), (state["sum"] + F.get(weigh, n - 1) - F.get(weigh, n)).alias("sum"), state["least"].alias("least"))

            return F.when(i >= window, let(F.get(places, i - window), without)).otherwise(state)

        def enter(state, i):
            def with_sign(place):
                n = held(state, place)
                total = state["sum"] + F.get(weigh, n + 1) - F.get(weigh, n)
                least = F.when(i >= window - 1, F.least(state["least"], total)).otherwise(state["least"])
                return F.struct(*moved(state, place, 1), total.alias("sum"), least.alias("least"))

            return let(F.get(places, i), with_sign)

        step = lambda state, i: let(leave(state, i), lambda left: enter(left, i))
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda s: s["least"])

    least = let(F.transform(F.split(run, ""), lambda sign: F.instr(F.lit(SIGNS), sign) - 1), peak)
    return F.lit(math.log2(window)) - least / window


def added(text: Column, limits: Limits) -> Column:
    """Spans by entropy: runs with a digit and a letter, none of them on the allow-list."""
    runs = found(text, RUN, KINDS.index("entropy"), keep=lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike("^(?:" + "|".join(limits.allow) + ")$"))

    def reaches(span):
        value = span["value"]
        limit = F.when(value.rlike("^[0-9a-fA-F]+$"), limits.hexadecimal).when(value.rlike("^[A-Za-z0-9]+$"), limits.alphanumeric).otherwise(limits.other)
        return peak_entropy(value, limits.window) >= limit

    return F.filter(runs, reaches)


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def kinds(text: Column, limits: Limits) -> dict[str, Column]:
    """The spans of each kind."""
    return {
        "assigned": found(text, ASSIGN, 0, keep=lambda v: F.length(v) >= limits.assign, group=1),
        "accesses": found(text, ACCESS, 1, keep=lambda v: F.length(v) >= limits.access),
        "hexes": found(text, HEX, 2),
        "added": added(text, limits),
    }


def scan(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row: doc_id, base and added (arrays of start, kind, end, value, in order), counts, base_sha256 and spans.

    docs: doc_id and text; other columns are ignored. Offsets are code points, ends exclusive. Null text: empty, no
    spans. Null and repeated doc_ids: a row each. An empty table gives no rows.
    """
    rows = columns_as(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", *[spans.alias(name) for name, spans in kinds(F.col("text"), limits).items()])
    rows = rows.withColumn("base", F.array_sort(F.concat("assigned", "accesses", "hexes")))
    counts = [F.size(c).cast("long").alias(n) for c, n in (("assigned", "n_assign"), ("accesses", "n_access"), ("hexes", "n_hex"))]
    rows = rows.select("doc_id", "base", "added", *counts)
    return rows.select("*", F.sha2(_line(F.col("base")).cast("binary"), 256).alias("base_sha256"), _line(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redacted(docs: DataFrame, limits: Limits = Limits(), mark: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by a mark; overlapping spans are replaced as one. Columns stay as they are.

    A null or empty text stays as it is, as does one without a span; repeated rows and ids are rows of their own. Other
    columns may have any names.
    """
    own = fresh(docs, "spans")[0]
    text, spans = F.col("text"), F.col(own)
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def without(chunks: Column) -> Column:
        def cut(begin: Column, end: Column) -> Column:
            first = F.floor(begin / PIECE).cast("int")
            some = F.array_join(F.slice(chunks, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(end > begin, F.substring(some, begin - first * PIECE + 1, end - begin)).otherwise("")

        def parts(done: Column) -> Column:
            def part(span, k):
                before = F.coalesce(F.get(done, k - 1), F.lit(0))
                return F.when(span["start"] >= before, F.concat(cut(before, span["start"]), F.lit(mark))).otherwise("")

            return F.concat(F.array_join(F.transform(spans, part), ""), cut(F.element_at(done, -1), F.length(text)))

        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), parts)

    out = docs.withColumn(own, F.when(text.isNotNull(), F.array_sort(F.concat(*kinds(text, limits).values()))))
    return out.withColumn("text", F.when(F.size(own) > 0, let(chunks, without)).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
