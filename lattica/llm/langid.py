"""Operator 7: language identification by unigram models whose score sums over all segmentations.

Pieces come from a fixed public vocabulary. Each language has a probability for every piece; a word's probability is the
sum over all ways to cut it into pieces, by a forward pass. Training repeats expectation (expected piece counts over all
segmentations, forward and backward, in Spark tasks) and maximisation. A text's language has the greatest posterior.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, arrow_batch, columns_as, fresh, resolved, sliced, stored

SPACE = "▁"
#: Distinct training texts taken per language (by a hash of the text), rounds of training, and what is added to each piece's count.
SAMPLE_ROWS, ROUNDS, SMOOTHING = 1500, 2, 0.05
#: A single letter that is no piece. Runs of more letters than PLAIN are summed in logarithms, as products would vanish; they
#: aren't kept for later.
FLOOR, PLAIN = 1e-9, 24
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    priors: list[float]
    pieces: dict[str, tuple[float, ...]]  # a probability for each language

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)


def vocabulary(model: str) -> list[str]:
    """The vocabulary's pieces of small letters, with or without a space before them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=resolved(model))
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    return sorted(p for p in pieces if (bare := p.removeprefix(SPACE)).isalpha() and bare == bare.lower() or p == SPACE)


def words_of(texts: pa.Array) -> pa.Array:
    """A list of each text's runs of letters, in lower case; empty parts stay."""
    return pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())), r"\P{L}+")


def forward(word: str, pieces: dict, n_lang: int, longest: int) -> list[tuple[float, ...]]:
    """For word[:0], word[:1], ...: the probability in each language, summed over all segmentations."""
    n = len(word)
    alpha = [[0.0] * n_lang for _ in range(n + 1)]
    alpha[0] = [1.0] * n_lang
    for i in range(n):
        before = alpha[i]
        for j in range(i + 1, min(n, i + longest) + 1):
            p = pieces.get(word[i:j])
            if p is None:
                if j > i + 1:
                    continue
                p = (FLOOR,) * n_lang
            to = alpha[j]
            for k in range(n_lang):
                to[k] += before[k] * p[k]
    return alpha


def log_forward(word: str, pieces: dict, n_lang: int, longest: int) -> np.ndarray:
    """The logarithms of forward(...)[-1] for a word of any length: only the last steps are held, and put to scale."""
    held = [np.ones(n_lang)]  # of the places before here, the nearest last
    scale, floor = np.zeros(n_lang), np.full(n_lang, FLOOR)
    table = _arrays(pieces)
    for j in range(1, len(word) + 1):
        here = np.zeros(n_lang)
        for back in range(1, len(held) + 1):
            p = table.get(word[j - back : j])
            if p is not None:
                here += held[-back] * p
            elif back == 1:
                here += held[-1] * floor
        held = [*held[1 - longest or len(held) :], here] if len(held) >= longest else [*held, here]
        if here.min() < 1e-150:
            held = [h / here for h in held]
            scale += np.log(here)
    return scale + np.log(held[-1])


_TABLES: dict[int, tuple[dict, dict]] = {}


def _arrays(pieces: dict) -> dict:
    """pieces with arrays for tuples; that of the last table is kept."""
    if id(pieces) not in _TABLES or _TABLES[id(pieces)][0] is not pieces:
        _TABLES.clear()
        _TABLES[id(pieces)] = pieces, {w: np.array(p, float) for w, p in pieces.items()}
    return _TABLES[id(pieces)][1]


def expected(word: str, pieces: dict, k: int, longest: int, plain: int = PLAIN) -> dict[str, float]:
    """Expected counts of pieces in a word for language k; of a long word from logarithms."""
    n = len(word)
    find = lambda i, j: pieces[word[i:j]][k] if word[i:j] in pieces else FLOOR if j == i + 1 else 0.0
    links = [(i, j, p) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if (p := find(i, j))]
    out: dict[str, float] = {}
    if n <= plain:
        ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, j, p in links:
            ahead[j] += ahead[i] * p
        for i, j, p in reversed(links):
            back[i] += back[j] * p
        shares = ((i, j, ahead[i] * p * back[j] / ahead[n]) for i, j, p in links)
    else:
        links = [(i, j, math.log(p)) for i, j, p in links]
        ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for i, j, p in links:
            ahead[j] = _log_sum(ahead[j], ahead[i] + p)
        for i, j, p in reversed(links):
            back[i] = _log_sum(back[i], back[j] + p)
        shares = ((i, j, math.exp(ahead[i] + p + back[j] - ahead[n])) for i, j, p in links)
    for i, j, share in shares:
        if word[i:j] in pieces:
            out[word[i:j]] = out.get(word[i:j], 0.0) + share
    return out


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _word_counts(rows: DataFrame) -> DataFrame:
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in sliced(batches, size=4 << 20):
            for lang in pc.unique(batch.column(0)).to_pylist():
                words = words_of(batch.column(1).filter(pc.equal(batch.column(0), lang))).flatten()
                counts = pc.value_counts(words.filter(pc.not_equal(words, "")))
                yield arrow_batch(schema, [[lang] * len(counts), counts.field(0).cast(pa.string()), counts.field(1)])

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, model: str, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """Learns from the rows of docs (text, lang) with a lang and a text: about sample_rows distinct whole texts per language.

    Texts are taken by their hash, so the same are taken however the table is laid out; copies of a text count once, and a
    language of no more distinct texts than that is taken whole. A row of numbers per language comes to the driver. No such
    rows: a model without languages.
    """
    rows = columns_as(docs, lang="lang", text="text").where("lang is not null and text is not null").withColumn("hash", F.xxhash64("text"))
    about = {r.lang: (r.n, r.texts) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash", 0.02).alias("texts")).collect()}
    languages, sizes = sorted(about), {lang: n for lang, (n, _) in about.items()}
    if not languages:
        return Model([], [], {})
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_rows / max(about[lang][1], 1)))])
    taken = rows.where(F.pmod("hash", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    taken = taken.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")
    counts = stored(_word_counts(taken), "langid-words")
    pieces = vocabulary(model)
    index = {lang: k for k, lang in enumerate(languages)}
    table = {p: (1.0 / len(pieces),) * len(languages) for p in pieces}
    schema = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("n", pa.float64())])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):

        def expect(batches, table=table):
            longest, sums = max(map(len, table)), [{} for _ in languages]
            for batch in batches:
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    into = sums[index[lang]]
                    for piece, x in expected(SPACE + word, table, index[lang], longest).items():
                        into[piece] = into.get(piece, 0.0) + n * x
            rows = [(lang, piece, x) for lang, found in zip(languages, sums, strict=True) for piece, x in found.items()]
            if rows:
                yield arrow_batch(schema, list(zip(*rows, strict=True)))

        got = counts.repartition(n).mapInArrow(expect, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()  # at most pieces x languages
        found = {(r.lang, r.piece): r.n for r in got}
        total = {lang: sum(x for (of, _), x in found.items() if of == lang) + SMOOTHING * len(pieces) for lang in languages}
        table = {p: tuple((found.get((lang, p), 0.0) + SMOOTHING) / total[lang] for lang in languages) for p in pieces}
    whole = sum(sizes.values())
    return Model(languages, [sizes[x] / whole for x in languages], table)


class Scorer:
    """Adds up words' log-probabilities; each distinct word is scored once per worker."""

    def __init__(self, model: Model):
        self.model, self.longest, self.index = model, model.longest, {}
        self.rows: list[tuple[float, ...]] = []

    def word(self, word: str) -> tuple[float, ...]:
        n = len(self.model.languages)
        if len(word) >= PLAIN:
            return tuple(log_forward(SPACE + word, self.model.pieces, n, self.longest))
        return tuple(map(math.log, forward(SPACE + word, self.model.pieces, n, self.longest)[-1]))

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the log-probabilities by language, and its number of words."""
        lists = words_of(texts)
        coded = lists.flatten().dictionary_encode()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.index) > CACHE_WORDS // 2:
            self.index, self.rows = {}, []
        index, rows, found = self.index, self.rows, []
        for w in words:
            if (k := index.get(w)) is not None:
                found.append(rows[k])
                continue
            found.append(self.word(w) if w else (0.0,) * len(self.model.languages))
            if len(w) < PLAIN:
                index[w] = len(rows)
                rows.append(found[-1])
        values = np.array(found).reshape(len(words), -1)[which]
        real = np.array([bool(w) for w in words], bool)[which]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
        sums = np.stack([np.bincount(text_of, values[:, k], len(texts)) for k in range(values.shape[1])], axis=1)
        return sums + np.log(self.model.priors), np.bincount(text_of, real, len(texts))


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, then lang_pred and score (the posterior, 0 to 1) for every row, from its whole text alone.

    und with score 0: a null text, one without a letter, or a model without languages. Null or repeated ids: a row each.
    """
    spark, table = docs.sparkSession, model
    name = f"{id(model)}-{len(_SCORERS)}-{np.random.default_rng().integers(1 << 60)}"
    shared = spark.sparkContext.broadcast(table)  # bounded by the vocabulary and the number of languages
    kept = {f"k{i}": c for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in kept.items()], F.col("text").alias("own_text"))
    fields = [f for f in rows.schema.fields if f.name != "own_text"]
    place = len(keep)

    def run(batches):
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer, languages = _SCORERS[name], np.array([*shared.value.languages, UNKNOWN], object)
        for batch in sliced(batches, column=place, size=4 << 20):
            n = batch.num_rows
            best, score = np.full(n, len(languages) - 1), np.zeros(n)
            if len(languages) > 1 and n:
                sums, words = scorer.scores(batch.column(place))
                some = words > 0
                top = sums.max(axis=1)
                best[some] = sums.argmax(axis=1)[some]
                score[some] = (1 / np.exp(sums - top[:, None]).sum(axis=1))[some]
            columns = [batch.column(i) for i in range(place)] + [pa.array(languages[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    ddl = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(run, ddl)
    return out.select(*[F.col(k).alias(c) for k, c in kept.items()], "lang_pred", "score")


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with their columns of whatever name, whose text is in a learned language, however low its posterior.

    A null text, or one without a letter, goes; repeated rows and ids stay. An empty table gives no rows.
    """
    lang, score = fresh(docs, "lang_pred", "score")
    found = predict(docs, model, keep=tuple(docs.columns)).toDF(*docs.columns, lang, score)
    return found.where(F.col(lang) != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(doc_id: str = "doc_id"):
    """Rows that training leaves out: the remainder of the id's CRC-32, as text, by 5 is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))
