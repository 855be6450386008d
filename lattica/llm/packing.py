"""Operator 3: order-preserving packing of token streams into windows by dynamic programming.

Each partition's documents form one token stream in the order in which they come. Windows are cut at the ends of
documents or sentences (and, where a sentence is long, inside it), so that the sum of padding, truncation penalties and
a fixed cost per sequence is least. The best cost up to a cut is the least of cost + place over the cuts a window back,
which a monotone queue holds; windows whose length is a power of two need no padding and are looked up one by one.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, columns_as, encoder, sliced


@dataclass(frozen=True)
class Costs:
    """In units of one padding token."""

    sequence: int = 64
    sentence_cut: int = 8
    word_cut: int = 32
    #: Where a sentence is longer, cuts inside it may be made at every such step (or at every window, if that is less).
    step: int = 96


def best_cuts(places: list[int], penalties: list[int], window: int, per_sequence: int) -> list[int]:
    """Indices of the cuts of least cost, from places[0] to places[-1]. Gaps between places must not exceed window."""
    n, first = len(places), places[0]
    best, back = [0] * n, [0] * n
    index = [-1] * (places[-1] - first + 1)
    index[0] = 0
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    queue = deque([0])
    for j in range(1, n):
        p = places[j]
        while places[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        cost = best[i] + window - (p - places[i])
        for s in powers:
            k = p - first - s
            if k < 0:
                break
            if (k := index[k]) >= 0 and best[k] < cost:
                i, cost = k, best[k]
        best[j], back[j], index[p - first] = cost + per_sequence + penalties[j], i, j
        value = best[j] + p
        while queue and best[queue[-1]] + places[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class Stream:
    """The documents of a partition that aren't packed yet, as ids end to end."""

    def __init__(self, window: int, costs: Costs, ends_sentence: np.ndarray, part: int):
        self.window, self.costs, self.ends_sentence, self.part = window, costs, ends_sentence, part
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, its tokens, tokens packed before, tokens here
        self.held, self.done = 0, 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids), 0, len(ids)))
        self.held += len(ids)

    def cut(self, last: bool) -> tuple[np.ndarray, list[int]]:
        ids = np.concatenate(self.ids)
        ends = np.cumsum([d[3] for d in self.docs])
        penalty, step = np.zeros(len(ids) + 1, np.int32), min(self.costs.step, self.window)
        seen = np.flatnonzero(self.ends_sentence[ids]) + 1
        penalty[seen] = self.costs.sentence_cut
        solid = np.unique(np.concatenate(([0], seen, ends)))
        gaps = np.diff(solid)
        inner = [np.arange(a + step, a + g, step) for a, g in zip(solid[:-1], gaps, strict=True) if g > step]
        if last:  # what is left at the end may be cut anywhere
            inner.append(np.arange(max(0, len(ids) - self.window), len(ids)))
        places = np.unique(np.concatenate([solid, *inner]))
        inside = places[~np.isin(places, solid)]
        penalty[inside] = self.costs.word_cut
        penalty[ends] = 0
        places = places.tolist()
        cuts = [places[k] for k in best_cuts(places, penalty[places].tolist(), self.window, self.costs.sequence)]
        return ids, cuts

    def pack(self, last: bool):
        """Pieces of all windows but, unless this is the last call, of the last four, which are held for the next."""
        if not self.docs:
            return
        ids, cuts = self.cut(last)
        stop = len(cuts) - 1 if last else max(len(cuts) - 5, 0)
        k, at = 0, 0  # the document, and the place, next to pack
        docs = self.docs
        for w in range(stop):
            offset = 0
            while at < cuts[w + 1]:
                name, total, before, here = docs[k]
                n = min(here, cuts[w + 1] - at)
                yield name, before, n, zlib.crc32(ids[at : at + n].astype("<u4")), total, (self.part << 32) + self.done, offset
                at, offset = at + n, offset + n
                docs[k] = (name, total, before + n, here - n)
                k += n == here
            self.done += 1
        self.docs, self.ids = docs[k:], [ids[at:].copy()]
        self.held = len(ids) - at


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, costs: Costs = Costs(), chunk: int = 1 << 18) -> DataFrame:
    """A row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id (long) and text; other columns are ignored. Documents keep their order within a partition of docs, and
    no row is moved between partitions. A partition's stream is packed chunk by chunk (of so many ids), the last windows
    of a chunk being packed anew with the next one. Null text: empty, so end_id alone. Null doc_id and repeated doc_ids:
    packed like any other row. An empty table has no pieces. sequence_id: partition number and count within it. window: 1 or
    more, whatever costs.step.
    """
    if window < 1:
        raise ValueError(f"window {window}: at least 1")

    def run(batches):
        enc = encoder(tokenizer)
        size = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        ends = np.zeros(size, bool)
        ends[[i for t, i in enc.tokenizer.get_vocab().items() if t.removesuffix("</w>").strip(".!?\"')") == "" and any(c in t for c in ".!?")]] = True
        stream = Stream(window, costs, ends, TaskContext.get().partitionId())

        def rows(last):
            found = list(stream.pack(last))
            if found:
                yield arrow_batch(_PIECES, list(zip(*found, strict=True)))

        for batch in sliced(batches):
            ids, starts = enc.encode(batch.column(1))
            tail = np.array([end_id], ids.dtype if end_id >> enc.width == 0 else np.uint32)
            for name, a, b in zip(batch.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                stream.add(name, np.concatenate((ids[a:b], tail)))
                if stream.held >= chunk:
                    yield from rows(False)
        yield from rows(True)

    rows = columns_as(docs, id="doc_id", text="text").withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
