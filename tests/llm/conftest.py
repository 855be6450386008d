import random

import pytest
from sample_texts import prose

#: Columns that clash with names that operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, start int, fp string, words array<string>, media binary, hash long, `a.b` int"
@pytest.fixture(scope="session")
def docs(spark):
    """Prose, exact and near copies, null, empty and odd texts, a very long one, repeated rows, null ids, clashing columns."""
    rng = random.Random(7)
    texts = {k: ". ".join(prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 12))) for k in range(40)}
    texts |= {40: None, 41: "", 42: "   \n\t ", 43: "é́ naïve 漢字 😀 <|endoftext|> ▁ x\x85y\xa0z", 44: "word", 45: "12 34 !!", 46: texts[3], 47: texts[3], 48: texts[5].replace("the", "teh", 1)}
    texts[49] = " ".join(prose(rng, 15) for _ in range(4000))
    texts[-5] = texts[7]
    rows = [(k, t, None if k % 9 == 0 else "en", f"s{k % 3}", len(t or "")) for k, t in texts.items()]
    rows += [(3, texts[3], "en", "again", 1), (10, "another text under a known id", "en", "again", 1), (None, texts[5], None, None, None), (None, "nameless", "en", None, None)]
    rows = [(*r, 7, 1, "x", ["y"], b"z", 3, 4) for r in rows]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture
def none(docs):
    return docs.where("false")
