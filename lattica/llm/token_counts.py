"""Operator 5: exact token counts at every prefix of a text, by dynamic programming over prefixes.

For byte-pair encoding by merge rank, the encoding of a prefix ends in one token whose predecessor is the encoding of a
shorter prefix, and two tokens may stand side by side only if encoding their concatenation gives the two again. So the
count at prefix j is the count at prefix i plus one for the only token text[i:j] that fits behind the last token at i.
One pass gives the count at every prefix, and truncation and budget questions are answered from these counts.

Pieces never hold a space after another sign, so texts fall into units, one for each part between spaces, and a unit's
counts are worked out once per worker. Counts of runs of spaces are the library's own.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, arrow_batch, columns_as, resolved, sliced, stored

SPACE = "▁"
#: Signs of a part of a text up to which its steps are kept.
KEPT_SIGNS = 64


class PrefixCounter:
    """Token counts as the sentencepiece library gives them for a BPE model with byte fallback and a dummy prefix."""

    def __init__(self, model: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=resolved(model))
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        spaces = [p for p in self.scores if SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2)]
        if any(set(p) != {SPACE} for p in spaces) or sp.encode("a b ", out_type=str)[-1] != SPACE:
            raise ValueError("this model's pieces or normalising don't part texts at spaces")
        # Runs of spaces: the library's own counts, which grow by one for each further longest piece.
        self.run = max(map(len, spaces), default=1)
        known = 16 * self.run
        self.runs = np.array([0, *(len(sp.encode(" " * (r - 1) or "")) if r > 1 else 1 for r in range(1, known + 1))])
        if (self.runs[known // 2 + self.run :] != self.runs[known // 2 : -self.run] + 1).any():
            raise ValueError("this model's runs of spaces don't repeat")
        self.longest = max(len(p) for p in self.scores if p not in set(spaces))
        self.words: dict[str, int] = {}
        self.cache_words = cache_words
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole = {p for p in self.scores if p not in set(spaces) and (len(p) == 1 or self.merge(p) == [p])}
        joined = "".join({c for p in self.scores for a, c in zip(p, p[1:]) if a.isalpha()})
        #: Letters, then signs that no piece joins to a letter before them: two units.
        self.head = re.compile(r"([^\W\d_]+)([" + re.escape("".join(c for c in ".,!?;:#$%&*|" if c not in joined)) + r"][^\w\s]*)")
        self.heads: dict[str, int] = {}
        self.known_steps: dict[str, bytes] = {}
        self.row_of, self.row = "", ([0], [""], [False])

    def spaces(self, r):
        """Token counts of runs of r spaces (an integer or an array)."""
        more = np.maximum(0, -(-(np.asarray(r) - (len(self.runs) - 1)) // self.run))
        return self.runs[r - more * self.run] + more

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding of a short string, the best score first and the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            found = [(-s, k) for k in range(len(parts) - 1) if (s := scores.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        key = left, right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def unit(self, text: str) -> tuple[list[int], list[bool]]:
        """For text[:0], text[:1], ...: the token count, and whether the first token is a space alone.

        A prefix's row holds for every text that begins with it, so what the last text shares with this one stays.
        """
        same = 0
        for a, b in zip(self.row_of, text):
            if a != b:
                break
            same += 1
        counts, last, bare = (column[: same + 1] for column in self.row)
        whole, pairs, longest = self.whole, self.pairs, self.longest
        for j in range(same + 1, len(text) + 1):
            for i in range(j - longest if j > longest else 0, j):
                token = text[i:j]
                if j - i == 1 or token in whole and (i == 0 or (self.fits(last[i], token) if (ok := pairs.get((last[i], token))) is None else ok)):  # one always fits: the last needs no test
                    counts.append(counts[i] + (1 if token in whole else len(token.encode())))
                    last.append(token)
                    bare.append(token == SPACE if i == 0 else bare[i])
                    break
        self.row_of, self.row = text, (counts, last, bare)
        return counts, bare

    def _word(self, word: str) -> int:
        """Twice the count of a space and a part without spaces, plus 1 if its first token is the space alone."""
        if m := self.head.fullmatch(word):
            if len(self.heads) > self.cache_words:
                self.heads = {}
            if (known := self.heads.get(m[1])) is None:
                known = self.heads[m[1]] = self._word(m[1])
            return known + 2 * self.unit(m[2])[0][-1]
        first, *rest = word.split("\n")  # a line feed is a token of its own
        counts, bare = self.unit(SPACE + first)
        n = counts[-1] + len(rest) + sum(self.unit(r)[0][-1] for r in rest)
        return 2 * n + bare[-1]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Token counts of whole texts (null: empty)."""
        texts = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), SPACE, " ")
        gc_on = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            lists = pc.split_pattern(texts, " ")
            coded = lists.flatten().dictionary_encode()
            words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
            if len(self.words) > self.cache_words:
                self.words = {}
            found = list(map(self.words.get, words))
            for k, (w, known) in enumerate(zip(words, found, strict=True)):
                if known is None:
                    found[k] = self.words[w] = self._word(w) if w else 0
        finally:
            if gc_on:
                gc.enable()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        values, empty = np.array(found, np.int64)[which], np.array([not w for w in words], bool)[which]
        counts, bare = values >> 1, values & 1
        # Empty parts make runs of spaces; a run ends at a part or at the end of its text.
        sums = np.concatenate(([0], np.cumsum(counts)))
        total = sums[offsets[1:]] - sums[offsets[:-1]]
        if empty.any():
            places = np.flatnonzero(empty)
            text_of = np.searchsorted(offsets, places, side="right") - 1
            new = np.ones(len(places), bool)
            new[1:] = (np.diff(places) != 1) | (np.diff(text_of) != 0)
            begins = np.flatnonzero(new)
            length, owner = np.diff([*begins, len(places)]), text_of[begins]
            after = places[begins] + length
            joined = after < offsets[owner + 1]  # else the run ends its text
            first_bare = np.zeros(len(begins), bool)
            first_bare[joined] = bare[after[joined]] == 1
            extra = np.where(first_bare, self.spaces(length + 1) - 1, self.spaces(length))
            np.add.at(total, owner, extra)
        total[np.asarray(pc.binary_length(texts)) == 0] = 0
        return total

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ... up to the whole text, each as if encoded alone."""
        out, done = [], 0
        for spaces, word, line in re.findall(f"({SPACE}*)([^{SPACE}\n]*)(\n?)", SPACE + text.replace(" ", SPACE)):
            r = len(spaces)
            out += (done + self.spaces(np.arange(1, r + 1))).tolist()
            if word and r:
                alone, joined = int(self.spaces(r)) - 1, int(self.spaces(r - 1))
                counts, bare = self.unit(SPACE + word)
                out += [done + c + (alone if b else joined) for c, b in zip(counts[2:], bare[2:], strict=True)]
            elif word:
                out += [done + c for c in self.unit(word)[0][1:]]
            done = out[-1] if out else 0
            if line:
                done += 1
                out.append(done)
        out[0] = 0  # the dummy prefix of no text
        return np.array(out, np.int64)

    def _steps(self, part: str) -> bytes:
        """What each sign of a space and part adds to the count, as signed 16-bit integers; part begins with the further spaces of a run."""
        if (known := self.known_steps.get(part)) is not None:
            return known
        if m := self.head.fullmatch(part):
            found = self._steps(m[1]) + _differences(self.unit(m[2])[0])
        elif "\n" in part and " " not in part:  # a line feed is a token of its own
            first, *rest = part.split("\n")
            found = self._steps(first) + b"".join(array("h", [1]).tobytes() + _differences(self.unit(r)[0]) for r in rest)
        else:
            counts = self.prefixes(part).tolist() if not part or " " in part else self.unit(SPACE + part)[0][1:]
            counts[0] = 1  # the space
            found = array("h", [1]).tobytes() + _differences(counts)
        self.known_steps[part] = found
        return found

    def steps(self, text: str) -> bytes:
        return self.steps_of([text])[0]

    def steps_of(self, texts: list[str]) -> list[bytes]:
        """For each text the differences of prefixes(text), as signed 16-bit integers: those of its parts in turn.

        Each part is worked out once, in the order of the alphabet, so that a part goes on from what it shares with the last.
        """
        known = self.known_steps
        if len(known) > self.cache_words:
            known.clear()
        parts = [self._parts(text) for text in texts]
        gc_on = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            new = sorted(set().union(*parts).difference(known))
            for part in new:
                self._steps(part)
        finally:
            if gc_on:
                gc.enable()
        out = []
        for own in parts:
            joined = b"".join([known[p] for p in own])
            first = array("h", joined[:4])  # the dummy prefix and the first sign
            out.append(array("h", [sum(first)]).tobytes() + joined[4:] if len(first) == 2 else b"")
        for part in new:
            if len(part) > KEPT_SIGNS:
                known.pop(part, None)
        return out

    def _parts(self, text: str) -> list[str]:
        text = text.replace(SPACE, " ")
        parts = text.split(" ")
        return [p[1:] for p in re.findall(" +[^ ]*", " " + text)] if "" in parts else parts


def _differences(counts: list[int]) -> bytes:
    return array("h", map(sub, counts[1:], counts)).tobytes()


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    if model not in _COUNTERS:
        _COUNTERS[model] = PrefixCounter(model)
    return _COUNTERS[model]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, prefixes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and, if asked for, the prefix counts.

    docs: doc_id (long) and text; other columns are ignored. Null text: empty, 0 tokens. Null and repeated doc_ids: a row
    each. An empty table gives no rows. prefix_counts: the counts at every code point, differences as signed 16-bit
    integers, deflated (see tokens_at and truncation). n_tokens is the count at the last prefix.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())] + [("prefix_counts", pa.binary())] * prefixes)

    def run(batches):
        own = counter(model)
        for batch in sliced(batches):
            texts = batch.column(1)
            columns = [batch.column(0), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())]
            if prefixes:
                steps = own.steps_of([t or "" for t in texts.to_pylist()])
                columns += [[last_count(t) for t in steps], [zlib.compress(t, 1) for t in steps]]
            else:
                columns.append(own.count(texts))
            yield arrow_batch(schema, columns)

    rows = columns_as(docs, id="doc_id", text="text").withColumn("id", F.col("id").cast("long"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long" + ", prefix_counts binary" * prefixes)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def counted_from_table(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) as count_tokens has them, read off the last prefix of a stored prefix table."""
    table = stored(count_tokens(docs, model, limit, prefixes=True).select("doc_id", "n_bytes", "prefix_counts"), "prefix-counts")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        for batch in sliced(batches, column=2, size=1 << 20):
            yield arrow_batch(schema, [batch.column(0), batch.column(1), [last_count(zlib.decompress(b)) for b in batch.column(2).to_pylist()]])

    return table.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def last_count(steps: bytes) -> int:
    return int(np.frombuffer(steps, "<i2").sum(dtype=np.int64))


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(counts).astype("<i2").tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum([0, *np.frombuffer(zlib.decompress(blob), "<i2")])


def tokens_at(blob: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars code points, from prefix_counts."""
    counts = unpacked(blob)
    return int(counts[min(n_chars, len(counts) - 1)])


def truncation(blob: bytes, budget: int) -> int:
    """The most code points from the start whose token count is within the budget, from prefix_counts."""
    return int(np.flatnonzero(unpacked(blob) <= budget)[-1])
