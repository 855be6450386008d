"""Operator 11: language-model scores from a log-frequency Bloom filter.

Every n-gram of the training texts is put into a Bloom filter with its quantised count: once for each level up to that of its
count, levels standing for ranges that grow by a fixed factor. A count is read by probing level after level until one is
missing, so it is never too low, and too high with a probability that falls with each level. Probabilities of each order are
smoothed by those of the next lower one (a Dirichlet prior), down to single words with one added to each.

N-grams are 64-bit hashes, counted before they are shuffled and sent to one block of the filter by their leading bits; a block is
as large as its entries need. Up to a bound the blocks are broadcast. Beyond, texts are put into teams, the n-grams of a team are sent
to their blocks, where those that many teams ask for are probed once, and their levels come back in the same order: the same filter,
the same scores. Exact counts of words, for the base score, are broadcast for a bounded number of the most frequent words and joined
for the rest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import dropped, shuffles_released
from .common import arrow_batch, columns_as, give_back, lower_ascii, sliced, stored

#: The odd constants of a common 64-bit mixing function.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Bytes of a word up to which it is hashed with many others.
WORD_BYTES = 1 << 16
_POWERS: dict[int, np.ndarray] = {}
END = xxhash.xxh64_intdigest(b"", 1)
#: Bytes of text that a task takes apart at once, and n-grams and words that it adds up before it hands them on.
SLICE, HELD_GRAMS, HELD_WORDS = 2 << 20, 1 << 20, 1 << 20
#: N-grams that are probed at once: what is worked out for them stays in a processor's cache. Neighbouring blocks that are asked together.
PROBED, SHARE = 1 << 16, 4
RESULT = "key long, doc_id long, n_tokens long, n_known long, base double, score double, words array<string>, times array<long>"


@dataclass(frozen=True)
class Settings:
    order: int = 2
    #: The factor by which the ranges of levels grow; level 1 is a count of 1.
    factor: float = 1.6
    #: Bits of the filter for each entry, and hashes.
    bits: int = 10
    hashes: int = 4
    #: How many tokens of a history the lower order weighs as much as.
    prior: float = 32.0
    #: Bytes of text for each block of the filter, and of a team where the filter is not broadcast.
    block_text: int = 4 << 20
    #: Bytes up to which the filter is broadcast.
    broadcast_bytes: int = 128 << 20
    #: The counts of up to so many of the most frequent words are broadcast.
    frequent: int = 100_000

    def thresholds(self) -> np.ndarray:
        """The least count of each level from 1 on."""
        found, j = [], 0
        while self.factor**j < 1 << 60:
            found.append(int(np.ceil(self.factor**j)))
            j += 1
        return np.array(found, np.int64)

    def expected(self) -> np.ndarray:
        """The count that each level from 0 on stands for: the middle of its range."""
        least = self.thresholds()
        return np.concatenate(([0.0], (least[:-1] + np.maximum(least[1:] - 1, least[:-1])) / 2, [float(least[-1])]))


# --- n-grams of a batch ---------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """The powers of base modulo 2 ** 64 from 0 on: n of them at least."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, WORD_BYTES), base, np.uint64))))
    return _POWERS[base]


def hashed(words: pa.Array) -> np.ndarray:
    """A hash of each word of a large_string array: its bytes as a polynomial, by differences of running sums, mixed; of long words, XXH64."""
    words = pa.concat_arrays([words])
    offsets, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1], words.buffers()[2]
    sizes = np.diff(offsets)
    out, at = np.empty(len(words), np.uint64), 0
    while at < len(words):
        if sizes[at] > WORD_BYTES:
            out[at], at = xxhash.xxh64_intdigest(data[int(offsets[at]) : int(offsets[at + 1])], 1), at + 1
            continue
        long = np.flatnonzero(sizes[at : at + (1 << 16)] > WORD_BYTES)
        end = max(at + 1, min(len(words), at + (int(long[0]) if len(long) else 1 << 16), int(np.searchsorted(offsets, offsets[at] + 16 * WORD_BYTES, side="right")) - 1))
        begins = (offsets[at : end + 1] - offsets[at]).astype(np.int64)
        values = np.frombuffer(data, np.uint8)[offsets[at] : offsets[end]].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(MIX[0], len(values))[: len(values)])))
        own = (sums[begins[1:]] - sums[begins[:-1]]) * _powers(pow(MIX[0], -1, 1 << 64), len(values) + 1)[begins[:-1]]
        out[at:end] = mixed(own + sizes[at:end].astype(np.uint64) * np.uint64(MIX[2]))
        at = end
    return out


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The values once each, ascending; a place and the times of each; the place among them of every value."""
    order = np.argsort(values)
    values = values[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    times = np.diff(np.append(new, len(values)))
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.repeat(np.arange(len(new)), times)
    return values[new], order[new], inverse, times


class Grams:
    """The tokens of texts (each ending with the end), and their n-grams by order, hashed."""

    def __init__(self, texts: pa.Array, order: int, scoring: bool = True):
        lists = pc.ascii_split_whitespace(lower_ascii(texts))
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py() + 1
        text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        if empty:
            text, codes = text[codes != empty], codes[codes != empty]
        self.words = coded.dictionary  # codes are these places and one more; the end is 0
        self.sizes = np.bincount(text, minlength=len(texts)) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = np.zeros(int(self.sizes.sum()), np.int64)
        last = np.zeros(len(self.codes), bool)
        last[self.starts + self.sizes - 1] = True
        self.codes[~last] = codes
        place = np.arange(len(self.codes)) - np.repeat(self.starts, self.sizes)
        hashes = np.concatenate((np.array([END], np.uint64), hashed(self.words)))
        #: By order: the number of the n-gram that ends at each token (-1: none), the hashes, a place and the times of each.
        self.ids, self.hashes = [self.codes], [hashes]
        self.at, self.times = [np.zeros(len(hashes), np.int64)], [np.bincount(self.codes, minlength=len(hashes))]
        self.at[0][self.codes] = np.arange(len(self.codes))
        before = np.concatenate(([0], self.codes[:-1]))  # every text begins after an end
        for n in range(2, order + 1):
            if n == order and not scoring:  # for counts alone, the last order needs no places
                pair, times = np.unique((before * len(hashes) + self.codes)[place >= n - 2], return_counts=True)
                self.times.append(times)
                self.hashes.append(mixed(self.hashes[-1][pair // len(hashes)] * np.uint64(MIX[0]) + hashes[pair % len(hashes)] + np.uint64(n)))
                break
            whole = np.flatnonzero(place >= n - 2)
            pair, first, inverse, times = _distinct(before[whole] * len(hashes) + self.codes[whole])
            ids = np.full(len(self.codes), -1, np.int64)
            ids[whole] = inverse
            self.hashes.append(mixed(self.hashes[-1][pair // len(hashes)] * np.uint64(MIX[0]) + hashes[pair % len(hashes)] + np.uint64(n)))
            self.ids.append(ids)
            self.at.append(whole[first])
            self.times.append(times)
            before = np.concatenate(([0], ids[:-1]))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams' hashes and how often each occurs."""
        keys, times = np.concatenate(self.hashes), np.concatenate(self.times)
        return keys[times > 0], times[times > 0]

    def log_probabilities(self, levels, settings: Settings, tokens: int, words: int) -> np.ndarray:
        """log10 of each token's probability; levels gives those of the n-grams' distinct hashes, ascending."""
        keys, _, place, _ = _distinct(np.concatenate(self.hashes))
        counts = np.split(settings.expected()[levels(keys)][place], np.cumsum([len(h) for h in self.hashes])[:-1])
        p = (counts[0] + 1) / (tokens + words + 1)
        of = p[self.codes]
        for n in range(2, settings.order + 1):
            at, ids = self.at[n - 1], self.ids[n - 1]
            earlier = np.maximum(at - 1, 0)
            history = counts[n - 2][np.where(at == 0, 0, self.ids[n - 2][earlier])]  # before the first text, too, stands an end
            own = np.minimum(counts[n - 1], history)
            p = (own + settings.prior * of[at]) / (history + settings.prior)
            of = np.where(ids >= 0, p[ids], of)
        return np.log10(of)


# --- the filter -----------------------------------------------------------------------------------


def _start_and_step(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the places of each key at a level begin, and how far they are apart, before they are reduced to a block's bits."""
    x = mixed(keys + np.uint64(level * MIX[0] & (1 << 64) - 1))
    return x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)


def block(keys: np.ndarray, counts: np.ndarray, settings: Settings) -> tuple[bytes, int]:
    """(bits, entries) of a block that holds the keys with the levels of their counts."""
    levels = np.searchsorted(settings.thresholds(), counts, side="right")
    entries = int(levels.sum())
    size = -(-max(64, settings.bits * entries) // 64) * 64
    held = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        first, step = _start_and_step(keys[levels >= level], level)
        for i in range(settings.hashes):
            held[(first + np.uint64(i) * step) % np.uint64(size)] = 1
    return np.packbits(held, bitorder="little").tobytes(), entries


class Filter:
    """Blocks of the filter, by the leading bits of a hash."""

    def __init__(self, blocks: dict[int, bytes], shift: int, settings: Settings):
        self.shift, self.settings = shift, settings
        count = 1 << (64 - shift) if shift < 64 else 1
        sizes = np.array([len(blocks.get(k, b"")) for k in range(count)], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.bits, self.starts = (sizes * 8).astype(np.uint64), (starts * 8).astype(np.uint64)
        self.data = np.empty(int(sizes.sum()), np.uint8)
        for k in range(count):  # a block goes as soon as it has been copied
            self.data[starts[k] : starts[k] + sizes[k]] = np.frombuffer(blocks.pop(k, b""), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level up to which all are found; ascending keys take the least time, as they go from block to block."""
        out, last = np.zeros(len(keys), np.int64), len(self.settings.thresholds())
        for at in range(0, len(keys), PROBED):
            found, k = out[at : at + PROBED], keys[at : at + PROBED]
            of = (k >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(k), np.int64)
            left = np.flatnonzero(self.bits[of] > 0)
            k, bits, starts, level = k[left], self.bits[of[left]], self.starts[of[left]], 0
            while len(left) and level < last:
                level += 1
                ok = self._hit(k, level, bits, starts)
                left, k, bits, starts = left[ok], k[ok], bits[ok], starts[ok]
                found[left] = level
        return out

    def _hit(self, keys: np.ndarray, level: int, bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which keys have all bits of a level in their blocks."""
        place, step = _start_and_step(keys, level)
        place, step, ok = place % bits, step % bits, np.ones(len(keys), np.uint8)
        for i in range(self.settings.hashes):
            if i:
                place += step
                place = np.minimum(place, place - bits)  # below zero it wraps around
            at = starts + place
            ok &= self.data[(at >> np.uint64(3)).view(np.int64)] >> (at.astype(np.uint8) & np.uint8(7))
        return np.flatnonzero(ok & np.uint8(1))


@dataclass(frozen=True)
class Model:
    #: (block, bits, entries) of the filter, and (word, n) of all training tokens, the end as an empty word.
    blocks: DataFrame
    vocabulary: DataFrame
    shift: int
    tokens: int
    words: int
    size: int
    settings: Settings

    def frequent_from(self) -> int:
        """The least count, of a power of the fourth root of 2, that at most settings.frequent words have."""
        step = F.floor(F.log2("n") * 4 + 1e-9).cast("int")
        found = {r.step: r.n for r in self.vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}  # a few hundred rows
        total, least = 0, None
        for s in sorted(found, reverse=True):
            total += found[s]
            if total > self.settings.frequent:
                break
            least = s
        return (1 << 62) if least is None else math.ceil(2 ** (least / 4) - 1e-6)


def _by_block(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, begin, end) of the blocks that ascending keys lie in."""
    of = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    return of[begin], begin, np.append(begin[1:], len(keys))


def _pressed(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Pieces of whole numbers as their steps, byte by byte in planes, compressed."""
    press, values = zstandard.ZstdCompressor(level=1), values.astype("<u8")
    steps = lambda x: np.concatenate((x[:1], x[1:] - x[:-1]))
    return [press.compress(np.ascontiguousarray(steps(values[a:b]).view(np.uint8).reshape(-1, 8).T).tobytes()) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _unpressed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _large_texts(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string()).fill_null("")


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of all texts of docs (null: empty, its end alone). Repeated rows count each; no rows give a model without counts."""
    spark, texts = docs.sparkSession, columns_as(docs, text="text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shift = 64 - max(0, (-(-size // settings.block_text) - 1).bit_length()) if size else 64
    pieces = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("times", pa.binary()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])

    def added(held):
        """A row for each block that the held n-grams lie in."""
        keys, times = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, times = keys[first], np.add.reduceat(times, first)
        at, begin, end = _by_block(keys, shift)
        return arrow_batch(pieces, [at, _pressed(keys, begin, end), _pressed(times, begin, end), pa.nulls(len(at), pieces.field("words").type), pa.nulls(len(at), pieces.field("n").type)])

    def listed(held):
        """A row with the held words."""
        words = pa.concat_arrays([words for words, _ in held]).dictionary_encode()
        n = np.zeros(len(words.dictionary), np.int64)
        np.add.at(n, words.indices.to_numpy(), np.concatenate([n for _, n in held]))
        lists = [pa.ListArray.from_arrays([0, len(n)], x) for x in (words.dictionary.cast(pa.string()), pa.array(n))]
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *lists], schema=pieces)

    def count(batches):
        held, words = [], []
        for batch in sliced(batches, column=0, rows=1 << 20, size=SLICE):
            grams = Grams(_large_texts(batch.column(0)), settings.order, scoring=False)
            own = np.flatnonzero(grams.times[0])
            held.append(grams.counted())
            words.append((pa.concat_arrays([pa.array([""], pa.large_string()), grams.words]).take(pa.array(own)), grams.times[0][own]))
            if sum(len(keys) for keys, _ in held) >= HELD_GRAMS:
                yield added(held)
                held = []
                give_back()
            if sum(len(n) for _, n in words) >= HELD_WORDS:
                yield listed(words)
                words = []
        if words:
            yield listed(words)
        if held:
            yield added(held)
        held, words = [], []
        give_back()

    held = pa.schema([("block", pa.int64()), ("bits", pa.binary()), ("entries", pa.int64())])

    def fill(part: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpressed(x).cumsum(dtype=np.uint64) for x in part.column("keys").to_pylist()])
        times = np.concatenate([_unpressed(x).cumsum(dtype=np.uint64) for x in part.column("times").to_pylist()]).astype(np.int64)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        bits, entries = block(keys[first], np.add.reduceat(times, first), settings)
        give_back()
        return pa.Table.from_batches([arrow_batch(held, [[part.column("block")[0].as_py()], [bits], [entries]])])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(texts.mapInArrow(count, "block long, keys binary, times binary, words array<string>, n array<long>"), "lm-counted")
    blocks = found.where("block is not null").select("block", "keys", "times").repartition(n, "block").groupBy("block").applyInArrow(fill, "block long, bits binary, entries long")
    with shuffles_released(spark):
        blocks = stored(blocks, "lm-filter")
    words = found.where("words is not null").select(F.explode(F.arrays_zip("words", "n")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.n").alias("n"))
    with shuffles_released(spark):
        words = stored(words, "lm-words")
    dropped(found)
    about = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).first()
    return Model(blocks, words, shift, about.tokens or 0, about.words, blocks.agg(F.sum(F.octet_length("bits")).alias("n")).first().n or 0, settings)


# --- scores ---------------------------------------------------------------------------------------


def _scorer(model: Model, frequent_from: int, sent: list):
    """A function of (keys, ids, texts, levels) to a batch of RESULT: all but what rare words add to the base score."""
    spark = model.vocabulary.sparkSession
    settings, tokens, words, order = model.settings, model.tokens, model.words, model.settings.order
    frequent = model.vocabulary.where(F.col("n") >= frequent_from).collect()  # up to settings.frequent rows
    end = next((r.n for r in model.vocabulary.where("word = ''").collect()), 0)
    known = spark.sparkContext.broadcast((pa.array([r.word for r in frequent if r.word], pa.large_string()), np.array([r.n for r in frequent if r.word], np.float64)))
    sent.append(known)
    whole = tokens + 1 * (words + 1)
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])

    def score(key: pa.Array, ids: pa.Array, texts: pa.Array, levels) -> pa.RecordBatch:
        grams = Grams(texts, order)
        value = grams.log_probabilities(levels, settings, tokens, words)
        names, n = known.value
        place = pc.index_in(grams.words, value_set=names).fill_null(-1).to_numpy()
        count = np.concatenate(([float(end)], np.where(place < 0, -1, n[place] if len(n) else -1)))[grams.codes]  # -1: not among the frequent
        base = np.where(count < 0, 0.0, np.log10((np.maximum(count, 0) + 1) / whole))
        rare = np.flatnonzero(count < 0)
        text = np.repeat(np.arange(len(texts)), grams.sizes)
        pair, times = np.unique(text[rare] * (len(grams.words) + 1) + grams.codes[rare], return_counts=True)
        of, code = pair // (len(grams.words) + 1), pair % (len(grams.words) + 1)
        ends = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
        rare_words = pa.ListArray.from_arrays(pa.array(ends), grams.words.take(pa.array(code - 1)).cast(pa.string()))
        rare_times = pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64)))
        sums = lambda x: np.add.reduceat(x, grams.starts) if len(texts) else x[:0]
        return pa.RecordBatch.from_arrays([key.cast(pa.int64()), ids, pa.array(grams.sizes), pa.array(sums((count > 0).astype(np.int64))), pa.array(sums(base)), pa.array(sums(value)), rare_words, rare_times], schema=schema)

    return score, schema


def _scored_broadcast(rows: DataFrame, model: Model, frequent_from: int, sent: list) -> DataFrame:
    """RESULT for rows (key, doc_id, text), with the filter broadcast."""
    score, _ = _scorer(model, frequent_from, sent)
    blocks = {r.block: bytes(r.bits) for r in model.blocks.select("block", "bits").toLocalIterator()}  # up to settings.broadcast_bytes
    held = rows.sparkSession.sparkContext.broadcast(Filter(blocks, model.shift, model.settings))
    give_back()
    sent.append(held)

    def run(batches):
        for batch in sliced(batches, column=2, rows=1 << 20, size=SLICE):
            yield score(batch.column(0), batch.column(1), _large_texts(batch.column(2)), held.value.levels)
            give_back()

    return rows.mapInArrow(run, RESULT)


def _scored_shuffled(rows: DataFrame, model: Model, frequent_from: int, sent: list) -> DataFrame:
    """RESULT for rows (key, doc_id, text): n-grams of teams of texts are sent to their blocks, and levels come back in their order.

    A team's texts are one row, so they are stored and shuffled once. Blocks are asked together with their neighbours.
    """
    score, schema = _scorer(model, frequent_from, sent)
    settings, shift = model.settings, model.shift
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    team_schema = pa.schema([("team", pa.int64()), ("texts", pa.binary())])
    asked_schema = pa.schema([("share", pa.int64()), ("team", pa.int64()), ("keys", pa.binary())])
    answer_schema = pa.schema([("team", pa.int64()), ("share", pa.int64()), ("levels", pa.binary())])

    def gather(batches):
        press = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in sliced(batches, column=2, rows=1 << 20, size=settings.block_text):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema, options=press) as stream:
                stream.write_batch(batch)
            yield arrow_batch(team_schema, [batch.column(0).slice(0, 1), [out.getvalue().to_pybytes()]])

    def texts_of(data: pa.Scalar) -> tuple[pa.Array, pa.Array, pa.Array]:
        key, ids, texts = pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks().columns
        return key.combine_chunks(), ids.combine_chunks(), _large_texts(texts.combine_chunks())

    def ask(batches):
        for batch in batches:
            for team, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.sort(np.concatenate(Grams(texts_of(data)[2], settings.order, scoring=False).hashes))
                keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
                share, begin, end = _by_block(keys, min(64, shift + SHARE.bit_length() - 1))
                yield arrow_batch(asked_schema, [share, np.full(len(share), team), _pressed(keys, begin, end)])
                give_back()

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return answer_schema.empty_table()
        share = Filter(dict(zip(held.column("block").to_pylist(), held.column("bits").to_pylist(), strict=True)), shift, settings)
        keys = [_unpressed(x).cumsum(dtype=np.uint64) for x in asked.column("keys").to_pylist()]
        ends = np.cumsum([0, *map(len, keys)]).tolist()
        distinct, _, place, _ = _distinct(np.concatenate(keys))  # teams share most of them
        del keys
        found = share.levels(distinct).astype(np.uint8)[place].tobytes()
        give_back()
        return pa.Table.from_batches([arrow_batch(answer_schema, [asked.column("team").combine_chunks(), asked.column("share").combine_chunks(), [found[a:b] for a, b in zip(ends, ends[1:])]])])

    def join(teams: pa.Table, answers: pa.Table) -> pa.Table:
        if not teams.num_rows:
            return schema.empty_table()
        found = np.frombuffer(b"".join(answers.sort_by("share").column("levels").to_pylist()), np.uint8).astype(np.int64)
        out = score(*texts_of(teams.column("texts")[0]), lambda keys: found)
        give_back()
        return pa.Table.from_batches([out])

    teams = stored(rows.mapInArrow(gather, "team long, texts binary"), "lm-teams")
    sent.append(teams)
    asked = teams.mapInArrow(ask, "share long, team long, keys binary")
    filters = model.blocks.select("block", "bits", F.shiftright("block", SHARE.bit_length() - 1).alias("share"))
    answers = asked.repartition(n, "share").groupBy("share").cogroup(filters.repartition(n, "share").groupBy("share")).applyInArrow(answer, "team long, share long, levels binary")
    return teams.repartition(n, "team").groupBy("team").cogroup(answers.repartition(n, "team").groupBy("team")).applyInArrow(join, RESULT)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of docs.

    docs: doc_id (whole number) and text; other columns are ignored. Words are what lies between white space, A-Z in lower case,
    and each text ends with a token of its own; null or empty texts are that alone. n_known counts tokens that training has;
    base_score sums log10 of their share of the training tokens with one added to each count, and score is the model's log10
    probability. Repeated rows: a row each.
    """
    rows = columns_as(docs, doc_id="doc_id", text="text").select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    way = _scored_broadcast if model.size <= model.settings.broadcast_bytes else _scored_shuffled
    frequent_from, sent = model.frequent_from(), []
    with shuffles_released(docs.sparkSession):
        found = stored(way(rows, model, frequent_from, sent), "lm-scored")
    for x in sent:
        dropped(x) if isinstance(x, DataFrame) else x.unpersist()
    whole = model.tokens + 1 * (model.words + 1)
    rare = found.select("key", F.explode(F.arrays_zip("words", "times")).alias("w")).select("key", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare = rare.join(model.vocabulary.where(F.col("n") < frequent_from).hint("shuffle_hash"), "word", "left")  # a task's share of words is small
    added = rare.groupBy("key").agg(F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(whole))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("known"))
    out = found.drop("words", "times").join(added, "key", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def held_out() -> Column:
    """Whether the remainder of a document's crc32 (a null id: that of an empty text) is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
