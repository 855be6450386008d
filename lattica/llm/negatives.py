"""Operator 12: hard negatives by a kNN join over Voronoi partitions.

Vectors of whole numbers are augmented by one component, the root of what their squared norm lacks of the largest one, and
anchors by 0: the largest inner products with an anchor are then the least distances from it. Rows and anchors go to the
nearest of a few pivots. A first join within each partition gives every anchor a bound on the distance of its last positive;
the bounds of a partition's anchors, taken together, say how far from its pivot a row may lie and still serve one of them, and
rows are replicated to those partitions alone. A second such join, with bounds from the positives' scores, finds the negatives.
Both end in exact scores, block by block, and lists that are merged.

Rows of one vector and label are a class. Ties go to the smallest ids, so a class needs no more ids than a list has places,
and anchors of a class share its lists; hence groups of copies of any size cost a row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batch, columns_as, dealt_join, stored

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Labels are told apart in the bounds up to so many remainders of their hash.
LABEL_BUCKETS = 16
#: Scores of a block that are held at once.
BLOCK_SCORES = 1 << 22
#: For rounding in distances; the joins themselves are exact.
SLACK = 1e-9


@dataclass(frozen=True)
class Mining:
    #: Each anchor's positives, and each positive's negatives.
    positives: int = 5
    negatives: int = 5
    #: A negative's score lies between low and high hundredths of its positive's.
    low: int = 80
    high: int = 100
    #: Components are multiplied by this and rounded down.
    scale: int = 256
    pivots: int = 32
    #: Rows, and anchors, of a partition beyond which it is cut.
    rows_at_once: int = 1 << 16
    anchors_at_once: int = 1 << 16

    @property
    def ids(self) -> int:
        """Ids that a class keeps: an anchor's own may be among them."""
        return max(self.positives + 1, self.negatives)


# --- classes of equal rows ----------------------------------------------------------------------


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) of rows that take part, once each: with an id, a label and a vector of finite components alone."""
    x = columns_as(rows, vec_id="vec_id", e="embedding", label="label").where("vec_id is not null and label is not null and e is not null")
    odd = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.where(~odd).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("e", lambda c: F.floor(c.cast("double") * scale)).alias("v")).distinct()


def _classes(rows: DataFrame, anchors: DataFrame, keep: int) -> DataFrame:
    """(cls, label, v, ids, anchors): a row per vector and label with its smallest ids and how many anchors it has."""
    first = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    held = rows.withColumn("n", first).where(F.col("n") <= keep).groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = anchors.groupBy("label", "v").agg(F.count("*").alias("anchors"))
    found = held.join(asked, ["label", "v"], "left").select("label", "v", "ids", F.coalesce("anchors", F.lit(0)).alias("anchors"))
    return stored(found.withColumn("cls", F.monotonically_increasing_id()), "negatives-classes")


# --- numbers in tasks ---------------------------------------------------------------------------


def _matrix(lists: pa.Array, dims: int, kind) -> np.ndarray:
    """A row per list; components that a list lacks are 0."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims).astype(kind)
    out = np.zeros((len(sizes), dims), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _kind(norm: float):
    """A type in which inner products of vectors of that squared norm are exact."""
    return np.float32 if norm < 1 << 24 else np.float64 if norm < 1 << 53 else object


def _as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], np.int64)
    return scores.astype(np.int64)


@dataclass(frozen=True)
class _Space:
    """The augmented space and its pivots."""

    pivots: np.ndarray
    norm: float  # the largest squared norm
    dims: int

    def distances(self, x: np.ndarray, norms: np.ndarray, anchors: bool) -> np.ndarray:
        """From each row, or anchor, to every pivot."""
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.norm - norms, 0))
        own = norms + last**2
        inner = x @ self.pivots[:, :-1].T + last[:, None] * self.pivots[:, -1]
        return np.sqrt(np.maximum(own[:, None] + (self.pivots**2).sum(1) - 2 * inner, 0))


def _placed(classes: DataFrame, space: _Space, anchors: bool) -> DataFrame:
    """classes with cell, the nearest pivot, away, the distance to it, and norm, the squared norm."""
    names = [f.name for f in classes.schema.fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column("v"), space.dims, np.float64)
                norms = (x * x).sum(1)
                far = space.distances(x, norms, anchors)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell]), pa.array(norms)], [*names, "cell", "away", "norm"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields]).add("cell", "integer").add("away", "double").add("norm", "double"))


def _space(classes: DataFrame, pivots: int) -> _Space | None:
    """A space whose pivots are the classes of least hash: a sample of a fixed, bounded number. None without classes."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    about = classes.agg(F.max(square).alias("norm"), F.max(F.size("v")).alias("dims")).first()
    if about.norm is None:
        return None
    chosen = classes.select("v", F.xxhash64("label", "v").alias("h")).orderBy("h", "v").limit(pivots).collect()
    x = np.zeros((len(chosen), about.dims + 1))
    for row, held in zip(x, chosen, strict=True):
        row[: len(held.v)] = held.v
    x[:, -1] = np.sqrt(np.maximum(about.norm - (x * x).sum(1), 0))
    return _Space(x, about.norm, about.dims)


# --- the join -----------------------------------------------------------------------------------


def _bucket(label: str = "label") -> Column:
    return F.pmod(F.xxhash64(label), F.lit(LABEL_BUCKETS)).cast("int")


def _cuts(rows: DataFrame, most: int) -> dict[int, int]:
    """Into how many parts each cell is cut: a number per pivot."""
    return {r.cell: -(-r.n // most) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}


def _by_cell(values: dict[int, int]) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(values.get(k, 1)) for k in range(max(values, default=0) + 1)]), F.col("cell")), F.lit(1))


def _join(anchors: DataFrame, rows: DataFrame, serve: Column, cuts: dict[int, int], shards: int, look, schema: str) -> DataFrame:
    """look(anchors, rows) for each part of a cell's anchors and shard of the rows that serve (an array of cells) gives it."""
    n = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = ["to", "part", "shard"]
    left = anchors.withColumn("to", F.col("cell")).withColumn("part", F.pmod(F.xxhash64("cls"), _by_cell(cuts)).cast("int"))
    left = left.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*to, "cls", "label", "v", "low", "marks")
    right = rows.withColumn("to", F.explode(serve)).withColumn("shard", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(shards)).cast("int"))
    parts = F.coalesce(F.get(F.array(*[F.lit(cuts.get(k, 0)) for k in range(max(cuts, default=0) + 1)]), F.col("to")), F.lit(0))
    right = right.where(parts > 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).select(*to, "cls", "label", "v", "ids")
    return left.repartition(n, *to).groupBy(*to).cogroup(right.repartition(n, *to).groupBy(*to)).applyInArrow(look, schema)


def _scored(left: pa.Table, right: pa.Table, dims: int, kind):
    """(row of left, scores with all of right), for each row of left."""
    if not left.num_rows or not right.num_rows:
        return
    b = _matrix(right.column("v"), dims, kind).T
    step = max(1, BLOCK_SCORES // right.num_rows)
    for at in range(0, left.num_rows, step):
        a = _matrix(left.column("v").slice(at, step), dims, kind)
        for k, scores in enumerate(a @ b):
            yield at + k, scores


def _expanded(order: np.ndarray, scores: np.ndarray, ids: pa.Array, most: int) -> list[tuple]:
    """The first (score, id, row) of classes in descending order of scores: ids of equal scores ascend, whichever class they are of."""
    out: list[tuple] = []
    at = 0
    while at < len(order) and len(out) < most:
        end = at
        while end < len(order) and scores[order[end]] == scores[order[at]]:
            end += 1
        out += [(scores[order[at]], *x) for x in sorted((i, k) for k in order[at:end].tolist() for i in ids[k].as_py())]
        at = end
    return out[:most]


def _leading(scores: np.ndarray, which: np.ndarray, most: int) -> np.ndarray:
    """which, cut to the first by score and all that tie with the last of them, in descending order."""
    own = scores[which]
    if len(which) > most:
        last = np.partition(own, len(own) - most)[len(own) - most] if own.dtype != object else sorted(own, reverse=True)[most - 1]
        which, own = which[own >= last], own[own >= last]
    return which[np.argsort(-own, kind="stable")]


def _same_label(most: int, dims: int, kind):
    schema = pa.schema([("cls", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("own", pa.bool_())])

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        labels, own = right.column("label").to_numpy(), left.column("label").to_numpy()
        cls, ids, out = left.column("cls").to_numpy(), right.column("ids").combine_chunks(), []
        theirs = right.column("cls").to_numpy()
        of = {label: np.flatnonzero(labels == label) for label in np.unique(own)}
        for k, scores in _scored(left, right, dims, kind):
            which = _leading(scores, of[own[k]], most)
            out += [(cls[k], s, i, theirs[row] == cls[k]) for s, i, row in _expanded(which, scores, ids, most)]
        found = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.Table.from_batches([arrow_batch(schema, [found[0], _as_long(np.array(found[1])), *found[2:]])])

    return look


def _other_labels(mining: Mining, dims: int, kind):
    schema = pa.schema([("cls", pa.int64()), ("mark", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        labels, own = right.column("label").to_numpy(), left.column("label").to_numpy()
        cls, ids, out = left.column("cls").to_numpy(), right.column("ids").combine_chunks(), []
        low, marks = left.column("low").to_numpy(), left.column("marks").combine_chunks()
        for k, scores in _scored(left, right, dims, kind):
            which = np.flatnonzero((labels != own[k]) & (scores >= low[k]))
            which = which[np.argsort(-scores[which], kind="stable")]
            sorted_scores = scores[which]
            for mark in marks[k].as_py():
                begin = int(np.searchsorted(-sorted_scores, -mark, side="left"))
                least = -(-mining.low * mark // mining.high)  # whole numbers, rounded up
                tail = which[begin:]
                tail = tail[: np.searchsorted(-sorted_scores[begin:], -least, side="right")]
                out += [(cls[k], mark, s, i) for s, i, _ in _expanded(tail, scores, ids, mining.negatives)]
        found = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.Table.from_batches([arrow_batch(schema, [found[0], found[1], _as_long(np.array(found[2])), found[3]])])

    return look


def _first(lists: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The merged lists: the highest scores of each key, equal ones by id."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return lists.withColumn("place", place).where(F.col("place") <= most)


def _reach(anchors: DataFrame, space: _Space, by_label: bool) -> list[tuple[int, int, float, float]]:
    """(cell, bucket, nearest, farthest): how far from a cell's pivot rows may be that serve one of its anchors; a few per pivot."""
    radius = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(space.norm) - 2 * F.col("low")))
    slack = SLACK * (1 + space.norm)
    about = anchors.groupBy("cell", (_bucket() if by_label else F.lit(0)).alias("bucket")).agg(F.min(F.col("away") - radius).alias("nearest"), F.max(F.col("away") + radius).alias("farthest"))
    return [(r.cell, r.bucket, r.nearest - slack - 1e-6, r.farthest + slack + 1e-6) for r in about.collect()]


def _served(rows: DataFrame, space: _Space, reach: list[tuple[int, int, float, float]], by_label: bool) -> DataFrame:
    """rows with serve: the cells whose anchors they might serve, by the distance to each pivot and, if by_label, the label's bucket."""
    names = [f.name for f in rows.schema.fields]
    shape = (len(space.pivots), LABEL_BUCKETS)
    near, far = np.full(shape, np.inf), np.full(shape, -np.inf)
    for cell, bucket, a, b in reach:
        near[cell, bucket], far[cell, bucket] = a, b

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column("v"), space.dims, np.float64)
                away = space.distances(x, (x * x).sum(1), False)
                k = part.column("bucket").to_numpy() if by_label else np.zeros(len(x), int)
                ok = (away >= near[:, k].T) & (away <= far[:, k].T)
                sizes = ok.sum(1)
                serve = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.nonzero(ok)[1].astype(np.int32)))
                keep = pa.array(sizes > 0)
                yield pa.RecordBatch.from_arrays([*part.columns, serve], [*names, "serve"]).filter(keep)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields]).add("serve", T.ArrayType(T.IntegerType())))


def hard_negatives(rows: DataFrame, every: int = 100, mining: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: vec_id (whole number), embedding (array of numbers), label (whole number); other columns are ignored. Anchors are
    rows whose id is divisible by every. An anchor's positives are the first other rows of its label by inner product, equal
    ones by id; for each, the first rows of other labels whose score is within the shares of the positive's. Rows without
    an id, label or vector, or with a component that is null or not finite, take no part. Repeats of a row count once; rows that share
    an id but not the rest count each. Components that a shorter vector lacks are 0. Scores beyond a long are ranked as they
    are and returned as the nearest long. No anchors, or none with a negative in range: no rows.
    """
    spark = rows.sparkSession
    rows = stored(whole_vectors(rows, mining.scale), "negatives-rows")
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first().m or 0
    if largest < 1 << 31:
        rows = rows.withColumn("v", F.col("v").cast("array<smallint>" if largest < 1 << 15 else "array<int>"))
    asking = rows.where(F.col("vec_id") % every == 0)
    classes = _classes(rows, asking, mining.ids)
    space = _space(classes, mining.pivots)
    if space is None:
        return spark.createDataFrame([], RESULT)
    kind = _kind(space.norm)
    placed = stored(_placed(classes, space, False).withColumn("bucket", _bucket()), "negatives-placed")
    anchors = stored(_placed(classes.where("anchors > 0"), space, True), "negatives-anchors")
    cuts = _cuts(anchors, mining.anchors_at_once)
    shards = -(-max(1, placed.count()) // mining.rows_at_once)
    most = mining.positives + 1

    # Positives: a bound from each anchor's own cell, then from all cells that are not too far for it.
    asked = anchors.withColumn("low", F.lit(0.0)).withColumn("marks", F.array().cast("array<long>"))
    same = _same_label(most, space.dims, kind)
    near = _first(_join(asked, placed.withColumn("serve", F.array("cell")), F.col("serve"), cuts, shards, same, "cls long, score long, id long, own boolean"), ["cls"], most)
    bound = near.groupBy("cls").agg(F.when(F.count("*") == most, F.min("score")).cast("double").alias("bound"))
    asked = stored(asked.join(bound, "cls", "left").withColumn("low", F.coalesce("bound", F.lit(float("-inf")))).drop("bound"), "negatives-asked")
    near = _served(placed, space, _reach(asked, space, True), True)
    found = _join(asked, near, F.col("serve"), cuts, shards, same, "cls long, score long, id long, own boolean")
    positives = _first(found, ["cls"], most).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("order"), "score", "id", "own")), asc=False).alias("positives"))
    positives = stored(positives, "negatives-positives")

    # Negatives: all with a share of the least positive score, whatever their label's bucket.
    marks = positives.select("cls", F.array_distinct(F.filter(F.transform("positives", lambda p: p["score"]), lambda s: s >= 0)).alias("marks")).where("size(marks) > 0")
    asked = anchors.join(marks, "cls").withColumn("low", F.array_min("marks") * (mining.low / mining.high) * (1 - SLACK) - SLACK)
    asked = stored(asked, "negatives-asked")
    near = _served(placed, space, _reach(asked, space, False), False)
    found = _join(asked, near, F.col("serve"), cuts, shards, _other_labels(mining, space.dims, kind), "cls long, mark long, score long, id long")
    negatives = _first(found, ["cls", "mark"], mining.negatives).groupBy("cls").agg(F.collect_list(F.struct("mark", "place", "id", "score")).alias("negatives"))

    # Back to the anchors of each class.
    facts = classes.where("anchors > 0").join(positives, "cls").join(negatives, "cls").select(F.struct("label", "v").alias("key"), "positives", "negatives", "anchors")
    own = dealt_join(asking.select(F.col("vec_id").alias("anchor"), F.struct("label", "v").alias("key")), stored(facts, "negatives-facts"), "key", "anchors")
    others = F.slice(F.filter("positives", lambda p: ~(p["own"] & (p["id"] == F.col("anchor")))), 1, mining.positives)
    own = own.select("anchor", F.col("key.label").alias("label"), F.explode(others).alias("p"), "negatives")
    own = own.select("anchor", "p", F.explode(F.filter("negatives", lambda n: n["mark"] == F.col("p.score"))).alias("n"))
    return own.select(F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("n.place").cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))
