"""Operator 10: severity grades by cumulative-link ordinal regression on sparse text features.

One weight per feature is shared by all thresholds: P(grade <= k) = sigmoid(threshold_k - weights . features). Features
are words and beginnings of words that tell grades apart, by the texts of each kind that hold them. A feature must stand
before many different words (told apart by a hash into 64), so that a word of one text and its copies is none.

Labels may carry grades of their own (column severity). Where they only say toxic or not, toxic texts are graded by how often
telling words occur in them, those words being learnt from the other half of the sample: a text's grade never rests on
evidence that the text itself gave.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, columns_as, sliced, stored

#: Labelled rows used for fitting (taken by a hash of doc_id), different words (of 64 hashes) that must follow a feature, and its least log-likelihood ratio.
SAMPLE_ROWS, CONTEXTS, EVIDENCE = 20_000, 8, 18.0
GRADES = 3
#: Beginnings of words that are features, by length; the sign that ends a whole word; signs by which unknown words are left out.
STEMS, END, HEAD = range(4, 10), "$", 4
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]


def severity(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Grades to fit: 0 not toxic, 1 toxic, 2 toxic with more places of telling words than half of the toxic texts that have any."""
    some = hits[(toxic > 0) & (hits > 0)]
    return np.where(toxic == 0, 0, 1 + (hits > (np.median(some) if len(some) else 0)))


def probabilities(z: np.ndarray, thresholds: list[float]) -> np.ndarray:
    """Grades' probabilities for linear scores z."""
    below = 1 / (1 + np.exp(np.clip(z[:, None] - np.array(thresholds)[None, :], -500, 500)))
    return np.diff(below, axis=1, prepend=0, append=1)


def features(text: str, heads: set[str] | None = None) -> set[str]:
    """A text's features: its words in lower case, marked at their end, and beginnings of words. heads: of those that are wanted."""
    words = {w + END for w in _WORD.findall(text.lower())}
    if heads is not None:
        words = {w for w in words if w[:HEAD] in heads}
    return words | {w[:k] for w in words for k in STEMS if len(w) > k + 1}


def _loss(theta: np.ndarray, row: np.ndarray, column: np.ndarray, grades: np.ndarray, n_features: int, penalty: float) -> tuple[float, np.ndarray]:
    """Penalised mean negative log-likelihood and its gradient; theta: weights, first threshold, logs of the steps to the others."""
    n, k = len(grades), GRADES - 1
    w, t = theta[:n_features], theta[n_features:]
    steps = np.exp(np.clip(t[1:], -20, 20))
    cut = np.cumsum([t[0], *steps])
    z = np.bincount(row, w[column], n)
    below = 1 / (1 + np.exp(np.clip(z[:, None] - cut[None, :], -500, 500)))
    edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
    slope = edges * (1 - edges)
    here = np.arange(n)
    p = np.maximum(edges[here, grades + 1] - edges[here, grades], 1e-12)
    up, down = slope[here, grades + 1] / p, slope[here, grades] / p
    by_cut = np.array([np.where(grades == j + 1, down, 0).sum() - np.where(grades == j, up, 0).sum() for j in range(k)]) / n
    gradient = np.concatenate([np.bincount(column, (up - down)[row], n_features) / n + penalty * w, [by_cut.sum()], [steps[j] * by_cut[j + 1 :].sum() for j in range(k - 1)]])
    return float(-np.log(p).mean() + penalty * (w @ w) / 2), gradient


def fit_ordinal(row: np.ndarray, column: np.ndarray, grades: np.ndarray, n_features: int, rounds: int = 300, penalty: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of least penalised negative log-likelihood, by limited-memory quasi-Newton steps.

    Row row[i] has feature column[i]. Steps between thresholds are kept positive by an exponential.
    """
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES)[: GRADES - 1]) / max(len(grades), 1), 1e-4, 1 - 1e-4)
    first = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(n_features), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    value, gradient = _loss(theta, row, column, grades, n_features, penalty)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, scales = gradient.copy(), []
        for s, y in reversed(past):
            scales.append((s @ way) / (y @ s))
            way -= scales[-1] * y
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(scales), strict=True):
            way += s * (a - (y @ way) / (y @ s))
        size, fall = 1.0, gradient @ way
        while size > 1e-8:
            after, slope = _loss(theta - size * way, row, column, grades, n_features, penalty)
            if after <= value - 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = -size * way, slope - gradient
        theta, gradient, before, value = theta + s, slope, value, after
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y)]
        if before - value < 1e-9:
            break
    return theta[:n_features], np.cumsum([theta[n_features], *np.exp(theta[n_features + 1 :])])


def _labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    given = {"severity": "severity"} if "severity" in labels.columns else {}
    marks = columns_as(labels, id="doc_id", toxic="toxic", **given).where("id is not null and toxic is not null")
    worst = F.max("severity") if given else F.lit(None)
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"), worst.cast("int").alias("severity"))
    n = marks.count()
    share = min(1.0, sample_rows / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = columns_as(docs, id="doc_id", text="text").where("text is not null").join(marks, "id")
    return rows.select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), "severity", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))


def _telling(found: DataFrame, halves: tuple[int, ...], sizes: dict, contexts: int) -> Column:
    """Whether a feature tells toxic texts of these halves: its log-likelihood ratio, and the words that follow it."""
    bad, good = (sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in ("bad", "good"))
    after = F.col(f"after{halves[0]}") if len(halves) == 1 else F.col("after0").bitwiseOR(F.col("after1"))
    n_bad, n_good = (sum(sizes.get((h, t), 0) for h in halves) for t in (1, 0))
    if not n_bad:
        return F.lit(False)
    share, total = n_bad / (n_bad + n_good), bad + good
    term = lambda c, p: F.when(c > 0, c * F.log(c / (total * p))).otherwise(0.0)
    ratio = 2 * (term(bad, share) + (term(good, 1 - share) if share < 1 else F.lit(0.0)))
    return F.coalesce((F.bit_count(after) >= contexts) & (bad / total > share) & (ratio > EVIDENCE), F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, contexts: int = CONTEXTS) -> Model:
    """Fits on about sample_rows labelled rows, taken by a hash of doc_id; no labels: a model that grades all rows 0.

    labels: doc_id, toxic and, if there, severity (grades 0 to 2, which are then what is fitted). A label that repeats counts
    once, with the most severe of what is said. Rows of docs without a label or text are not used. All features that tell
    are kept; they are at most those of the sample.
    """
    rows = stored(_labelled(docs, labels, sample_rows), "toxicity-rows")
    sizes = {(r.half, r.toxic): r.n for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    if not any(toxic for _, toxic in sizes):
        return Model({}, [20.0, 40.0])
    names = ["word"] + [f"{c}{h}" for h in (0, 1) for c in ("bad", "good", "after")]
    schema = pa.schema([("word", pa.string())] + [(n, pa.int64()) for n in names[1:]])

    def evidence(batches):
        bad, good, after = (Counter(), Counter()), (Counter(), Counter()), ({}, {})
        for batch in sliced(batches, column=0, size=2 << 20):
            for text, toxic, half in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                (bad if toxic else good)[half].update(features(text))
                if toxic:
                    words = _WORD.findall(text.lower())
                    for word, following in set(zip(words, [*words[1:], ""])):
                        bit = 1 << zlib.crc32(following.encode()) % 64
                        for feature in features(word):
                            after[half][feature] = after[half].get(feature, 0) | bit
        words = list(bad[0] | bad[1] | good[0] | good[1])
        if words:
            columns = [words]
            for h in (0, 1):
                columns += [[bad[h][w] for w in words], [good[h][w] for w in words], np.array([after[h].get(w, 0) for w in words], np.uint64).view(np.int64)]
            yield arrow_batch(schema, columns)

    found = rows.mapInArrow(evidence, "word string, " + ", ".join(f"{n} long" for n in names[1:])).groupBy("word")
    found = found.agg(*[(F.bit_or(n) if n.startswith("after") else F.sum(n)).alias(n) for n in names[1:]])
    kinds = {name: _telling(found, halves, sizes, contexts) for name, halves in (("all", (0, 1)), ("in0", (0,)), ("in1", (1,)))}
    telling = found.select("word", *[kind.alias(name) for name, kind in kinds.items()]).where("all or in0 or in1").collect()  # at most the sample's features
    index = {r.word: k for k, r in enumerate(sorted((r for r in telling if r["all"]), key=lambda r: r.word))}
    others = {0: {r.word for r in telling if r.in1}, 1: {r.word for r in telling if r.in0}}
    heads = {r.word[:HEAD] for r in telling}
    pairs = pa.schema([("toxic", pa.int32()), ("severity", pa.int32()), ("features", pa.list_(pa.int32())), ("hits", pa.int32()), ("n", pa.int64())])

    def sparse(batches):
        counts = Counter()
        for batch in sliced(batches, column=0, size=2 << 20):
            for text, toxic, grade, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = Counter(w for w in _WORD.findall(text.lower()) if f"{w}{END}"[:HEAD] in heads)
                own = {w: features(w) for w in words}
                places = sum(n for w, n in words.items() if toxic and own[w] & others[half])
                known = {k for of in own.values() for f in of if (k := index.get(f)) is not None}
                counts[toxic, grade, tuple(sorted(known)), places] += 1
        if counts:
            yield arrow_batch(pairs, [*zip(*counts, strict=True), list(counts.values())])

    fitted = rows.mapInArrow(sparse, "toxic int, severity int, features array<int>, hits int, n long").collect()  # at most the sample's rows
    each = [x for x in sorted(fitted, key=lambda x: (x.toxic, x.hits, x.features, x.severity or 0)) for _ in range(x.n)]
    row = np.array([k for k, x in enumerate(each) for _ in x.features], np.int64)
    column = np.array([f for x in each for f in x.features], np.int64)
    grades = severity(np.array([x.toxic for x in each]), np.array([x.hits for x in each]))
    given = np.array([-1 if x.severity is None else min(max(x.severity, 0), GRADES - 1) for x in each])
    weights, thresholds = fit_ordinal(row, column, np.where(given >= 0, given, grades), len(index))
    return Model({w: float(weights[k]) for w, k in index.items()}, thresholds.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, grade, p_toxic, expected_severity, toxic) for every row, from its whole text.

    docs: doc_id (long) and text; other columns are ignored. grade: the median, so over 0 just where p_toxic is over a half;
    p_toxic: the probability of a grade over 0; toxic: p_toxic over a half. Null text: no features. Null and repeated doc_ids: a row each. An empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("expected_severity", pa.float64())])
    known, weights = set(model.weights), model.weights
    heads = {w[:HEAD] for w in known}

    def run(batches):
        for batch in sliced(batches):
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "").to_pylist()
            z = np.array([sum(weights[w] for w in sorted(known & features(t, heads))) for t in texts])
            p = probabilities(z, model.thresholds) if len(z) else np.zeros((0, GRADES))
            yield arrow_batch(schema, [batch.column(0), (np.cumsum(p, axis=1)[:, :-1] < 0.5).sum(axis=1).astype(np.int32), 1 - p[:, 0], p @ np.arange(GRADES)])

    rows = columns_as(docs, id="doc_id", text="text").withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, grade int, p_toxic double, expected_severity double").withColumn("toxic", F.col("p_toxic") > 0.5)
