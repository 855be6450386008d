"""Very long and repetitive texts, and columns of any name beside an operator's own."""

import pathlib
import random
import re
from itertools import combinations

import pytest

from lattica.llm import decontam, lexical, lm, negatives, simhash


def names_of(module):
    """Every plain word in quotes in a module: whatever it may call a column."""
    return sorted(set(re.findall(r'"([A-Za-z_]\w*)"', pathlib.Path(module.__file__).read_text())) - {"doc_id", "text", "item_id", "vec_id", "embedding", "label"})


def beside(spark, rows, schema, module):
    names = list({n.lower(): n for n in names_of(module)}.values())
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"{schema}, {', '.join(f'`{n}` int' for n in names)}")


def test_deduplicated_beside_all_names(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "something else entirely here now"), (2, "a b c d e f g h"), (None, "no name at all for this row"), (None, None), (3, None)]
    docs = beside(spark, rows, "doc_id long, text string", simhash)
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b c d e f g h"), (1, "something else entirely here now"), (None, "no name at all for this row"), (3, None)], key=str)


def test_new_operators_beside_all_names(spark):
    rows = [(k, f"some words of text {k} and more") for k in range(20)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    for module, run in ((lm, lambda d: lm.score(d, lm.train(d))), (lexical, lambda d: lexical.ranked(d, plain.selectExpr("doc_id as item_id", "text"), 3))):
        assert sorted(map(tuple, run(beside(spark, rows, "doc_id long, text string", module)).collect())) == sorted(map(tuple, run(plain).collect()))
    vectors = [(k, [float(k % 7), float(k % 5)], k % 3) for k in range(60)]
    schema = "vec_id long, embedding array<float>, label int"
    run = lambda d: sorted(map(tuple, negatives.hard_negatives(d, 10).collect()))
    assert run(beside(spark, vectors, schema, negatives)) == run(spark.createDataFrame(vectors, schema)) != []


def test_cleaned_goes_by_rows(spark):
    rng = random.Random(3)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    rows = [(1, f"before {item} after"), (1, "a clean row of that id"), (None, f"{item} without a name"), (None, "clean and without a name"), (2, None), (2, "")]
    docs = beside(spark, rows, "doc_id long, text string", decontam)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontam.cleaned(docs, bench, decontam.WHOLE)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[k] for k in (1, 3, 4, 5)], key=str)


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
def test_long_and_repetitive_texts(spark, broadcast_rows):
    """Memory goes with texts, not with hits times texts."""
    rng = random.Random(4)
    seeds = decontam.Seeds(around=None, broadcast_rows=broadcast_rows)
    own = lambda n, mark: [f"{mark}{rng.randrange(10**9)}" for _ in range(n)]
    long, often = own(1500, "i"), own(300, "j")
    texts = {1: own(50_000, "d") + long + own(50_000, "d"), 2: sum((often + own(4700, "e") for _ in range(20)), []), 3: own(100_000, "f")}
    bench = [(10, long), (11, often)]
    if broadcast_rows:
        texts[4] = ["a", "b"] * 20_000
        bench.append((12, ["a", "b"] * 500))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string").repartition(3)
    found = decontam.contaminated(docs, spark.createDataFrame([(k, " ".join(w)) for k, w in bench], "item_id long, text string"), seeds)
    got = {(r.doc_id, r.item_id): (r.agree, r.compared) for r in found.collect()}
    # Up to a fifth of a span may differ, so it goes on into the words around.
    assert set(got) == {(1, 10), (2, 11), *([(4, 12)] if broadcast_rows else [])}
    assert got[1, 10] == (1500, 1500) and got[2, 11] == (300, 300)
    assert not broadcast_rows or got[4, 12] == (1000, 1000)


@pytest.mark.parametrize(("n", "changed", "least"), [(12, 2, 0.984), (13, 2, 1.0), (15, 3, 0.986)])
def test_recall_of_short_overlaps(spark, n, changed, least):
    """Over all choices of changed words, as many are found as the masks promise; with a fourth mask all are."""
    rng = random.Random(5)
    item = [f"w{k}" for k in range(60)]
    noise = lambda k: [f"x{rng.randrange(10**9)}" for _ in range(k)]
    docs = [" ".join(noise(10) + ["other" if k in at else w for k, w in enumerate(item[20 : 20 + n])] + noise(10)) for at in combinations(range(n), changed)]
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for masks, share in ((decontam.Seeds().masks, least), ((*decontam.Seeds().masks, "1100011011"), 1.0)):
        found = decontam.contaminated(docs, bench, decontam.Seeds(masks, around=None, least=n - changed))
        assert found.select("doc_id").distinct().count() >= share * docs.count()
