"""The pipeline against its stages worked out plainly, on small tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
from sample_texts import prose
from test_simhash import components, plain_fingerprint
from test_text import plain_overlaps, plain_spans

import corpus_pipeline
from lattica.llm import decontam, secrets
from lattica.llm.common import tokenizer_path


def small_tables():
    rng = random.Random(13)
    passage = lambda n: " ".join(rng.choice("amber birch cedar delta ember fjord grove harbor inlet jasper".split()) + str(rng.randint(0, 40)) for _ in range(n))
    items = [(k, passage(25)) for k in range(4)]
    texts = {k: prose(rng, rng.randint(20, 70)) for k in range(20)}
    texts |= {20: texts[3], 21: texts[3], 22: texts[5], 23: None, 24: "", 25: "12 34 -- !!", 26: f"{prose(rng, 30)} {items[1][1]}", 27: f"{prose(rng, 30)} token = abcdef0123456789abcdef01 end", 28: f"{items[2][1].upper()} {prose(rng, 10)}"}
    texts[2] = texts[22]  # a copy with a smaller id
    return [(k, t, None if k % 7 == 0 else "en", f"s{k % 2}", len(t or "")) for k, t in texts.items()], items


def test_pipeline(spark, tmp_path):
    rows, items = small_tables()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    prints = [plain_fingerprint(t) for _, t in kept]
    owners = components([d for d, _ in kept], prints)
    kept = [(d, t) for (d, t), o in zip(kept, owners) if d == o]
    bad = {d for d, _ in plain_overlaps(kept, items, decontam.Seeds())}
    assert {26, 28} <= bad
    want = {}
    for d, text in kept:
        if d in bad:
            continue
        out, last = "", 0
        for s, e in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in plain_spans(text, secrets.Limits())[2].split(",") if x)):
            if s >= last:
                out += text[last:s] + "[secret]"
            last = max(last, e)
        want[d] = out + text[last:]
    assert "[secret]" in want[27] and 3 in want and not {20, 21, 22, 23, 24, 25} & set(want)

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in want.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for found, total in [(p, len(ids[d])) for d, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 4096


def test_stages_keep_columns_of_any_name_and_rows_of_shared_ids(spark, tmp_path):
    rows, items = small_tables()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = {"_spans": "mine", "_lang": "l", "_score": "s", "kept_id": "k", "again": "a", "_row": "r", "spans": "p", "fp": "f", "own": "o", "root": "t", "hash": "h", "words": "w", "doc": "d", "item": "i"}
    rows += [(7, "an unrelated text of its own under an id that another row has as well", "en", "z", 1), (None, "a text without an id that no other row is near to, in eleven words", None, None, None)]
    docs = spark.createDataFrame([(*r, *extra.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        if name == "pack":
            assert {r.doc_id for r in got.collect()} == {r[0] for r in rows}
            continue
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert {tuple(r[c] for c in extra) for r in kept} == {tuple(extra.values())}, name
        texts = [r.text for r in kept if r.doc_id == 7]
        assert len(texts) == 2 and None in {r.doc_id for r in kept}, name
