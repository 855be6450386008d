"""What several operators share: the shared folder, files written by tasks, word-cached encoding."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import operator
import os
import posixpath
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import new_folder, stored  # noqa: F401

#: Entries a Python worker keeps of what it has already worked out for a word; the cache starts anew when full.
CACHE_WORDS = 800_000


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_as(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under new names, so that no other column of df can clash with an operator's own."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from df's columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a key from which it is dealt over several joins, if it also has over a thousandth of all rows; over how many.
HOT_ROWS, SHARES = 100_000, 64


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, count: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined to facts, which has a row per key and in column count how many rows have it; count does not stay.

    Rows of hot keys are dealt over SHARES parts by a hash of the row, and those keys' facts are repeated for each. Hot keys
    have over a thousandth of all rows each, so they are fewer than a thousand and may be broadcast.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = facts.where(F.col(count) > max(total // 1000, hot_rows))
    if hot.isEmpty():
        return rows.join(facts.drop(count), key, how)
    share, marked = fresh(rows.join(facts.limit(0), key), "share", "marked")
    own = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(SHARES)).cast("int")
    rows = rows.join(F.broadcast(hot.select(key, F.lit(True).alias(marked))), key, "left").withColumn(share, F.when(F.col(marked), own).otherwise(0)).drop(marked)
    parts = F.when(F.col(count) > max(total // 1000, hot_rows), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(facts.withColumn(share, F.explode(parts)).drop(count), [key, share], how).drop(share)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Values of a block of running().
BLOCK = 256


def running(values: Column, combine=operator.add, first: int = 0) -> Column:
    """What has been combined up to each of an array's integers; by blocks, as each step of a fold copies what it has so far."""

    def fold(block: Column, begin: Column) -> Column:
        def step(state, x):
            return let(combine(state["at"], x), lambda at: F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out")))

        return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))

    def joined(parts: Column) -> Column:
        ends = fold(F.transform(parts, lambda b: F.aggregate(b, F.lit(first), lambda x, y: combine(x, y))), F.lit(first))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda b, k: fold(b, F.coalesce(F.get(e, k - 1), F.lit(first))))))

    return let(values, lambda v: F.when(F.size(v) > BLOCK, let(blocks(v), joined)).otherwise(fold(v, F.lit(first))))


# --- files that tasks write -------------------------------------------------------------------


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, chunks: list[bytes]) -> int:
    """Writes a file under another name and renames it: a task that is lost or run twice leaves whole files only."""
    system, path = _file_system(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(draft, path)
    return sum(map(len, chunks))


def open_input(uri: str):
    system, path = _file_system(uri)
    return system.open_input_file(path)


def give_back() -> None:
    """Returns freed memory to the system: allocators keep it, and the workers of an executor share what there is."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


# --- Arrow batches ----------------------------------------------------------------------------


def sliced(batches, column: int = 1, rows: int = 4096, size: int = 8 << 20):
    """Arrow batches of at most so many rows and, but for single longer texts, bytes in a string or binary column."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(batch.num_rows, at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A large_string array without nulls, with A-Z alone put in lower case (in one go over its bytes)."""
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    low = pa.py_buffer(data.to_pybytes().lower() if data else b"")
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, low], offset=texts.offset)


# --- word-cached encoding ---------------------------------------------------------------------

#: Small letters of Latin-1: one word to the tokenizer, unchanged by its normalising.
_LATIN_WORD = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")


def byte_alphabet() -> dict[int, str]:
    """The public byte-level BPE alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

    Where the tokenizer drops white space before it looks for words (as the word-level BPE files do), the ids of a
    text are those of its space-separated parts in turn, so parts are looked up in a cache. Any other tokenizer
    encodes whole texts. Both give the library's ids for the whole text.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(resolved(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = self._drops_spaces(spec)
        self.width = max(1, (max(self.tokenizer.get_vocab_size() - 1, 1)).bit_length())
        self.dtype, self._code = ("<u2", "H") if self.width <= 16 else ("<u4", "I")
        self.cache: dict[str, bytes] = {"": b""}
        self.cache_words = cache_words
        self._bytes = byte_alphabet()

    @staticmethod
    def _drops_spaces(spec: dict) -> bool:
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        forms = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers") or []]
        return (
            [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"]
            and steps[0]["pattern"].get("Regex", "") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and not steps[1]["add_prefix_space"]
            and forms == ["NFC", "Replace", "Lowercase"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        )

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self._code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encodes new words. Small Latin letters are one word to the tokenizer and need no normalising."""
        cache, tokenize, code, odd = self.cache, self.tokenizer.model.tokenize, self._code, []
        for w in words:
            if w.isascii() and w.isalpha() and w.islower():
                cache[w] = array(code, [t.id for t in tokenize(w)]).tobytes()
            elif _LATIN_WORD.fullmatch(w):
                cache[w] = array(code, [t.id for t in tokenize(w.encode().decode("latin-1").translate(self._bytes))]).tobytes()
            else:
                odd.append(w)
        cache.update(zip(odd, self._encode(odd), strict=True))

    def _parts(self, texts: pa.Array) -> pa.Array:
        """Each text's parts between spaces, in which . and , after a letter stand alone, as they do for the tokenizer."""
        return pc.split_pattern(pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), "([a-z])([.,]) ", r"\1 \2 "), " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) end to end, and where each text's ids start (one more entry than texts)."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not self.by_word or pc.any(pc.match_substring(texts, "<|")).as_py():  # a special string is one only as it is spelt
            parts = self._encode(texts.to_pylist())
            return np.frombuffer(b"".join(parts), dtype=self.dtype), np.cumsum([0, *map(len, parts)]) // np.dtype(self.dtype).itemsize
        gc_on = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            lists = self._parts(lower_ascii(texts))
            coded = lists.flatten().dictionary_encode()
            words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
            if len(self.cache) > self.cache_words:
                self.cache = {"": b""}
            found = list(map(self.cache.get, words))
            if None in found:
                self._learn([w for w, ids in zip(words, found, strict=True) if ids is None])
                found = [self.cache[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        finally:
            if gc_on:
                gc.enable()
        pool = np.frombuffer(b"".join(found), dtype=self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        ids = pool[np.repeat(begins[which] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def resolved(tokenizer: str) -> str:
    """A tokenizer file's place on this machine: a bare name is looked up among the public ones, wherever the task runs."""
    return tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
