"""Operator 13 against all scores."""

import math
import random
import re
from collections import Counter

import pytest

from lattica.llm import lexical


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    terms = [plain_terms(t) for _, t in docs]
    n_docs, total = sum(1 for x in terms if x), sum(map(len, terms))
    counts = [Counter(x) for x in terms]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c, x in zip(docs, counts, terms):
            score = 0
            for t in set(plain_terms(text)):
                if c[t]:
                    m = 10 + (90 * len(x) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, rank + 1, d if named else None, -s) for rank, (s, named, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(lexical, "BEAM", 3)
    monkeypatch.setattr(lexical, "TOGETHER", 4)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 9)


def test_ranks_of_whole_and_odd_texts(docs, rows, none, small_shards):
    spark = docs.sparkSession
    rng = random.Random(3)
    texts = [t for _, t in rows if t]
    items = [(k, " ".join(rng.choices(rng.choice(texts).split() or ["x"], k=3))) for k in range(20)]
    items += [(50, None), (51, ""), (52, "?!"), (53, "nowhere-to-be-found"), (54, texts[0]), (54, texts[1]), (55, texts[0].upper() + " 漢字 é́"), (56, texts[0])]
    asked = spark.createDataFrame([(*i, 5, "x") for i in items], "item_id long, text string, qid int, terms string")
    got = sorted(map(tuple, lexical.ranked(docs, asked, 5).collect()), key=str)
    assert got == plain(rows, items, 5)
    assert lexical.ranked(none, asked).count() == 0 and lexical.ranked(docs, asked.where("false")).count() == 0


def test_many_shards_many_copies(spark, small_shards):
    """Copies beyond any list, over many shards of few documents: the smallest ids stay, whatever their shard."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 30)))) for k in range(300)]
    texts += [(1000 + k, texts[7][1]) for k in range(150)]
    items = [(k, texts[k][1]) for k in range(0, 300, 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    n, length = lexical.collection(docs)
    assert (n, length) == (sum(1 for _, t in texts if t), sum(len(t.split()) for _, t in texts))
    asked = spark.createDataFrame([(k, k, list(dict.fromkeys(t.split()))) for k, t in items], "qid long, item_id long, terms array<string>")
    shards = lexical.write_shards(docs, n, length, 1000)
    assert shards.count() == 7 and shards.agg({"docs": "sum"}).first()[0] == len(texts)
    got = sorted(((r.qid, r["rank"], r.doc_id, r.score) for r in lexical.search(shards, asked.select("qid", "terms"), n, 10).collect()), key=str)
    assert got == plain(texts, items, 10)
