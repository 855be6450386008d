"""Operators 1, 3 and 5 against the tokenizer libraries."""

import io
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lattica.llm import packing, token_counts, wavelet
from lattica.llm.common import WordEncoder, tokenizer_path

WORD, PIECE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["", "it's \x1cx\x85y\xa0z", "<|endoftext|>a<|startoftext|> b", "<|STARTOFTEXT|> Q", "A\tB\r\nC  D\n\n", "İstanbul ΣΑΣ 12ab34 ²x Ⅷ", "don't DON'T we'LL l'été", "a,b.c!!! $$$ x###", "word'", "ab's'd ab'", "ß ſ K ÿŸ × ÷", "x,, y. .z"]


def strange(n, seed=0):
    rng = random.Random(seed)
    signs = "aAéÉ's,. \n\t́\xa0<|>12ſİK\x1c\x85😀漢▁then "
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_librarys_ids(name):
    own, texts = WordEncoder(tokenizer_path(name), cache_words=200), ODD + strange(500)
    want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 64):  # the cache starts anew several times
        ids, starts = own.encode(pa.array(["left out", None, *texts[at : at + 64]]).slice(1))
        assert starts[1] == 0
        assert [ids[a:b].tolist() for a, b in zip(starts[1:-1], starts[2:])] == want[at : at + 64]


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(0)
    for n in (1, 7, 1000, 70_000):
        ids = rng.choice(np.array([0, 1, 5, 500, 49_407], np.uint16), n)
        shard = wavelet.WaveletFile(io.BytesIO(wavelet.build(ids, 16, np.array([3]), np.array([n]))))
        assert (shard.decode() == ids).all()
        for token in (0, 5, 49_407, 2, 1 << 17):
            places = np.flatnonzero(ids == token)
            assert shard.count(token) == len(places)
            for i in {0, n // 3, n}:
                assert shard.rank(token, i) == (places < i).sum()
            for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
                assert shard.select(token, k) == places[k]
            with pytest.raises(IndexError):
                shard.select(token, len(places))
        assert [shard.access(i) for i in range(0, n, max(1, n // 9))] == ids[:: max(1, n // 9)].tolist()
    with pytest.raises(ValueError):
        wavelet.WaveletFile(io.BytesIO(b"LWMX9999" + struct.pack("<I", 0)))


def test_wavelet_shards(docs, rows, none):
    manifest = wavelet.write_shards(docs, WORD, end_id=1, shard_tokens=900)
    assert manifest.count() > 5
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in wavelet.read_shards(manifest).collect())
    library, start = Tokenizer.from_file(WORD), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert len(got) == len(ordered)
    for (at, doc, n, check, ids), (want, text) in zip(got, ordered):
        expected = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (at, doc, n, check, ids) == (start, want, len(expected), crc(expected), expected)
        start += n
    assert wavelet.find_token(manifest, 1).count() == len(rows)
    assert wavelet.read_shards(wavelet.write_shards(none, WORD, end_id=1)).count() == 0


def cost(places, penalties, cuts, window, each):
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        n = places[b] - places[a]
        assert 0 < n <= window
        total += (0 if n & (n - 1) == 0 else window - n) + each + penalties[b]
    return total


def test_cuts_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        places = sorted({0, *(rng.randint(1, 60) for _ in range(rng.randint(3, 25)))})
        places = [p for k, p in enumerate(places)]
        filled = sorted({*places, *range(0, places[-1], 16)})
        penalties = [rng.choice([0, 3, 9]) for _ in filled]
        best = [0.0] + [float("inf")] * (len(filled) - 1)
        for j in range(1, len(filled)):
            for i in range(j):
                n = filled[j] - filled[i]
                if n <= 16:
                    best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else 16 - n) + 5 + penalties[j])
        cuts = packing.best_cuts(filled, penalties, 16, 5)
        assert cuts[0] == 0 and cuts[-1] == len(filled) - 1
        assert cost(filled, penalties, cuts, 16, 5) == best[-1]


@pytest.mark.parametrize(("window", "chunk"), [(4096, 1 << 18), (128, 700)])
def test_packing(docs, rows, none, window, chunk):
    got = packing.pack(docs, WORD, end_id=2, window=window, chunk=chunk).collect()
    library = Tokenizer.from_file(WORD)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.doc_tokens, r.start, r.length, r.ids_crc32))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append([*library.encode(text or "", add_special_tokens=False).ids, 2])
    for doc, all_ids in texts.items():
        want = sorted((len(ids), k) for k, ids in enumerate(all_ids))
        if len(all_ids) == 1:
            at = 0
            for total, start, n, check in sorted(pieces[doc], key=lambda p: p[1]):
                assert (total, start) == (len(all_ids[0]), at) and check == crc(all_ids[0][at : at + n])
                at += n
            assert at == len(all_ids[0])
        assert sum(p[2] for p in pieces[doc]) == sum(n for n, _ in want)
    total = sum(len(i) for v in texts.values() for i in v)
    assert padding < 0.1 * total
    assert packing.pack(none, WORD, end_id=2).count() == 0


def test_prefix_counts_are_the_librarys():
    own = token_counts.PrefixCounter(PIECE, cache_words=300)
    texts = ODD + strange(600, 3) + [" " * k + w + " " * j for k in range(0, 40, 5) for j in (0, 1, 17) for w in ("the", "é", " Zq", "")]
    want = [len(x) for x in own.library.encode(texts, num_threads=1)]
    assert own.count(pa.array([None, *texts]))[1:].tolist() == want
    for text in texts[::4]:
        every = [len(x) for x in own.library.encode([text[:k] for k in range(len(text) + 1)], num_threads=1)]
        assert own.prefixes(text).tolist() == every
        blob = token_counts.packed(own.prefixes(text))
        assert token_counts.tokens_at(blob, len(text)) == every[-1]
        assert token_counts.truncation(blob, 5) == max(k for k, n in enumerate(every) if n <= 5)


def test_token_counts(docs, rows, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = sorted((str(d), len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for d, t in rows)
    for prefixes in (False, True):
        got = token_counts.count_tokens(docs, PIECE, limit=50, prefixes=prefixes)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts.count_tokens(none, PIECE).count() == 0


def test_steps_of_parts_are_those_of_prefixes():
    own = token_counts.PrefixCounter(PIECE, cache_words=300)
    texts = ODD + strange(600, 5) + [" " * k + w + " " * j for k in range(0, 40, 3) for j in (0, 1, 17) for w in ("the", "é", " Zq", "", "a\n b", "▁x▁▁", "word,", "z" * 200)]
    for text in texts * 2:
        assert own.steps(text) == np.diff(own.prefixes(text)).astype("<i2").tobytes(), text


def test_the_query_stores_every_prefix(spark, tmp_path, docs, rows):
    import glob

    from lattica.functions.storage import shared_dir
    from lattica.llm import queries

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(glob.glob(f"{shared_dir(spark)}/prefix-counts-*"))
    got = queries.op5_token_counts(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    (folder,) = set(glob.glob(f"{shared_dir(spark)}/prefix-counts-*")) - before
    own = token_counts.PrefixCounter(PIECE)
    table = [(str(r.doc_id), token_counts.unpacked(bytes(r.prefix_counts)).tolist()) for r in spark.read.parquet(folder).collect()]
    assert sorted(table) == sorted((str(d), own.prefixes(t or "").tolist()) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == sorted((d, t[-1]) for d, t in table)


def test_every_occurrence_is_found_together():
    rng = np.random.default_rng(3)
    ids = rng.choice(np.array([0, 1, 5, 500, 49_407], np.uint16), 300_000, p=[0.1, 0.5, 0.2, 0.1999, 0.0001])
    shard = wavelet.WaveletFile(io.BytesIO(wavelet.build(ids, 16, np.array([3]), np.array([len(ids)]))))
    for token in (0, 1, 5, 500, 49_407, 7, 1 << 17):
        places = np.flatnonzero(ids == token)
        assert (shard.places(token) == places).all() and len(shard.places(token)) == len(places)
        assert (shard.places(token, 3, 70_003) == places[3:70_003]).all()


def test_rows_of_one_id_lie_in_several_shards(spark):
    texts = [f"text {k % 40} of {k}" for k in range(400)] + [None, "", "same", "same"]
    df = spark.createDataFrame([(None if k % 2 else 7, t) for k, t in enumerate(texts)], "doc_id long, text string")
    manifest = wavelet.write_shards(df, WORD, end_id=1, shard_tokens=200)
    assert manifest.select("part").distinct().count() == 4
    library, got = Tokenizer.from_file(WORD), wavelet.read_shards(manifest).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in df.collect())
    at = sorted((r.start, r.n_tokens, r.doc_id is not None) for r in got)
    assert [a for a, *_ in at] == [sum(n for _, n, _ in at[:k]) for k in range(len(at))] and [known for *_, known in at] == sorted(known for *_, known in at)
    where = wavelet.find_token(manifest, 1).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in where} == {7: 202, None: 202}


@pytest.mark.parametrize("window", [1, 7, 64, 96])
def test_windows_below_a_step(docs, rows, window):
    library = Tokenizer.from_file(WORD)
    small = docs.where("doc_id <> 49")
    got, sequences = defaultdict(int), defaultdict(list)
    for r in packing.pack(small, WORD, end_id=2, window=window).collect():
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(int)
    for d, t in rows:
        if d is not None and d != 49:
            want[d] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == want
    for found in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(found)]])
        assert [a for a, _ in sorted(found)] == ends[:-1].tolist() and ends[-1] <= window
