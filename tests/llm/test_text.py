"""Operators 7 to 10 against plain versions, and the pipeline."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from sample_texts import WORDS, prose

from lattica.llm import decontam, langid, secrets, toxicity
from lattica.llm.common import tokenizer_path


PIECE = tokenizer_path("piece_bpe_32k.model")


# --- 7 -------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    rng = random.Random(2)
    pieces = {"".join(p): (rng.random(), rng.random()) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n) if rng.random() < 0.7}

    def brute(word):
        total = [0.0, 0.0]
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for k, cut in enumerate(cuts, 1):
                if cut:
                    parts, at = [*parts, word[at:k]], k
            parts.append(word[at:])
            if all(p in pieces or len(p) == 1 for p in parts):
                for k in range(2):
                    total[k] += math.prod(pieces[p][k] if p in pieces else langid.FLOOR for p in parts)
        return total

    for word in ("a", "ab", "abba", "bbabab"):
        assert np.allclose(langid.forward(word, pieces, 2, 3)[-1], brute(word))
        counts = langid.expected(word, pieces, 0, 3)
        letters = sum(len(p) * n for p, n in counts.items())
        assert letters <= len(word) + 1e-9


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(4)
    make = lambda stems, n: " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))
    stems = {"aa": ["the", "ing", "er", "on", "st"], "bb": ["sch", "ung", "ge", "ei", "ü"], "cc": ["ção", "os", "ar", "que", "ía"]}
    rows = [(k, make(stems[lang], rng.randint(5, 60)).capitalize(), lang) for k, lang in enumerate(rng.choices(list(stems), k=300))]
    rows += [(300, None, "aa"), (301, "12 34 !?", "aa"), (302, "", "bb"), (303, "ungsch geei", None), (None, "osque arção", "cc")]
    return spark.createDataFrame([(*r, 1.0, "z") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")


def test_language_id(languages):
    docs = languages.withColumn("held_out", langid.held_out())
    for r in docs.collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    model = langid.train(docs.where("not held_out"), PIECE, sample_rows=60)
    assert model.languages == ["aa", "bb", "cc"]
    assert all(abs(sum(p[k] for p in model.pieces.values()) - 1) < 1e-9 for k in range(3))
    got = {r.doc_id: r for r in langid.predict(languages, model).collect()}
    truth = {r.doc_id: r for r in languages.collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (300, 301, 302))
    right = [got[k].lang_pred == r.lang for k, r in truth.items() if k is None or k < 300]
    assert np.mean(right) > 0.97 and got[303].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.recognised(languages, model)
    assert kept.columns == languages.columns and kept.count() == languages.count() - 3


def test_language_id_without_training_rows(languages):
    model = langid.train(languages.where("false"), PIECE)
    assert {(r.lang_pred, r.score) for r in langid.predict(languages, model).collect()} == {("und", 0.0)}
    assert langid.predict(languages.where("false"), langid.train(languages, PIECE, sample_rows=20)).count() == 0


# --- 8 -------------------------------------------------------------------------------------------


def plain_overlaps(docs, items, seeds):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = set()
    for item, text in items:
        own = split(text)
        masks = list(seeds.masks) if len(own) >= seeds.span else ["1" * len(own)] if len(own) >= seeds.shortest else []
        for doc, body in docs:
            words = split(body)
            for mask in masks:
                for p in range(len(words) - len(mask) + 1):
                    for q in range(len(own) - len(mask) + 1):
                        if all(m == "0" or words[p + i] == own[q + i] for i, m in enumerate(mask)):
                            low, end = max(q - seeds.around, 0, q - p), min(q + len(mask) + seeds.around, len(own), len(words) - p + q)
                            agree = sum(own[i] == words[i + p - q] for i in range(low, end))
                            if agree >= min(seeds.least, len(own)) and agree >= seeds.share * (end - low):
                                found.add((doc, item))
    return found


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
def test_decontamination(spark, broadcast_rows):
    rng = random.Random(9)
    seeds = decontam.Seeds(broadcast_rows=broadcast_rows)
    passage = lambda n: [rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n)]
    items = [(k, " ".join(passage(rng.randint(15, 60)))) for k in range(12)] + [(12, "six words of a short item"), (13, "two words"), (14, None), (15, "")]
    docs = [(k, prose(rng, 80)) for k in range(10)]

    def with_changes(text, n):
        words = text.split()
        for k in rng.sample(range(len(words)), n):
            words[k] = "changed"
        return " ".join(words)

    for k, (item, text) in enumerate(items[:12]):
        docs.append((100 + k, f"{prose(rng, 20)} {text.upper() if k % 2 else text} {prose(rng, 20)}"))
        docs.append((200 + k, f"{prose(rng, 5)} {with_changes(text, len(text.split()) // 12)}"))
        docs.append((300 + k, with_changes(text, len(text.split()) // 2)))
    docs += [(400, "Here: six WORDS, of a short item!"), (401, None), (402, ""), (None, items[0][1]), (100, "a row that repeats an id")]
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, place int, words string").repartition(3)
    bench = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, hash int")
    got = decontam.contaminated(df, bench, seeds)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert pairs == plain_overlaps(docs, items, seeds)
    assert {(100 + k, k) for k in range(12)} | {(200 + k, k) for k in range(12)} | {(400, 12), (None, 0)} <= pairs
    assert not {d for d, _ in pairs if d is not None and d < 100}
    clean = decontam.clean(df, bench, seeds)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in pairs if d is not None}
    assert decontam.contaminated(df.where("false"), bench, seeds).count() == 0
    assert decontam.contaminated(df, bench.where("false"), seeds).count() == 0


def spans_from_hits(words, own, seeds):
    """Whether a span of any length that holds a hit agrees enough: all begins and ends on all diagonals."""
    need = seeds.least if len(own) >= seeds.least else len(own) - seeds.changes(len(own))
    for shift in range(-len(own) + 1, len(words)):
        low, end = max(0, -shift), min(len(own), len(words) - shift)
        same = [own[i] == words[i + shift] for i in range(low, end)]
        hits = [(p, p + len(m)) for m in seeds.masks for p in range(len(same) - len(m) + 1) if all(c == "0" or same[p + i] for i, c in enumerate(m))]
        if len(own) < seeds.least:
            hits.append((0, 0))
        if hits and sum(same) >= need:
            sums = [0, *itertools.accumulate(same)]
            for a, b in itertools.combinations(range(len(sums)), 2):
                n = sums[b] - sums[a]
                if n >= need and 5 * n >= 4 * (b - a) and (len(own) < seeds.least or any(a <= p and q <= b for p, q in hits)):
                    return True
    return False


@pytest.mark.parametrize("broadcast_rows", [2_000_000, 0])
def test_quotes_from_within_an_item(spark, broadcast_rows):
    rng = random.Random(12)
    seeds = decontam.Seeds(around=None, broadcast_rows=broadcast_rows)
    passage = lambda n, mark: [f"{mark}{rng.randint(0, 10**6)}" for _ in range(n)]
    long = passage(80, "q")
    items = [(0, long)] + [(n, passage(n, f"s{n}x")) for n in range(4, 15)]
    docs, want = [], set()

    def add(words, *pairs):
        want.update((len(docs), item) for item in pairs)
        docs.append(passage(40, "d") + words + passage(40, "e"))

    for n in (12, 13, 16, 20, 24, 26, 27, 40, 80):
        add(long[25 : 25 + n] if n < 60 else long, 0)
    for n in (9, 10, 11):
        add(long[25 : 25 + n])
    changed = lambda words, at: ["other" if k in at else w for k, w in enumerate(words)]
    add(changed(long[20:50], {9, 14, 19, 24, 29}), 0)
    for n, own in items[1:]:
        for k in range(3 if n < 12 else 0):
            for at in itertools.combinations(range(n), k):
                add(changed(own, set(at)), *[n] * (n >= 5 and k <= n // 5))
    for _ in range(40):
        add(changed(long, set(rng.sample(range(80), rng.randint(8, 30)))))
    got = decontam.contaminated(
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string").repartition(3),
        spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"),
        seeds,
    ).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert want <= pairs
    assert pairs == {(k, i) for k, w in enumerate(docs) for i, own in items if len(own) >= seeds.shortest and set(w) & set(own) and spans_from_hits(w, own, seeds)}
    assert all(r.agree >= 0.8 * r.compared - 1e-9 and r.hits > 0 for r in got)
    assert {r.doc_id: (r.agree, r.compared) for r in got if r.doc_id < 2} == {0: (12, 15), 1: (13, 16)}


# --- 9 -------------------------------------------------------------------------------------------


def plain_spans(text, limits):
    text = text or ""
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    extra = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        v = m[0]
        if len(v) < 20 or not re.search("[0-9]", v) or not re.search("[A-Za-z]", v) or any(re.fullmatch(a, v) for a in limits.allow):
            continue
        limit = limits.hexadecimal if re.fullmatch("[0-9a-fA-F]+", v) else limits.alphanumeric if re.fullmatch("[A-Za-z0-9]+", v) else limits.other
        best = max(-sum(c / limits.window * math.log2(c / limits.window) for c in Counter(v[k : k + limits.window]).values()) for k in range(len(v) - limits.window + 1))
        if best >= limit - 1e-9:
            extra.append((m.start(), 3, m.end()))
    line = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return [sum(k == n for _, k, _ in base) for n in range(3)], hashlib.sha256(line(base).encode()).hexdigest(), line(base + extra)


def secret_texts():
    rng = random.Random(11)
    key = lambda n, signs="0123456789abcdef": "".join(rng.choice(signs) for _ in range(n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [None, "", "nothing here", f'token = "{key(40)}" and é漢😀 password: hunter22', "secret=token: abcdef", "secret = abc, token=abcdefg", f"AKIA{key(16, letters[:26])} AKIAKIA AKIA", f"x{key(23)}g {key(24)}", f"API_KEY='{key(30, letters + '+/')}'", f"{key(40, letters)}", "aaaaaaaaaaaaaaaaaaaaaaaa1", "550e8400-e29b-41d4-a716-446655440000", "wJalrXUtnFEMI0K7MDENG0bPxRfiCYEXAMPLEKEY", "paſſword=abcdefgh toKen=abcdefgh", "password==abcdef=", "secretsecret : \"'zzzzzz"]
    texts += [" ".join(rng.choice([key(rng.randint(1, 40)), key(rng.randint(5, 45), letters + "+/_=-"), "token:", "secret=", "é", "\n", "PassWord  = "]) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    return [*texts, " ".join(f"token={key(24)}" for _ in range(1500))]


def test_secrets(spark):
    texts, limits = secret_texts(), secrets.Limits()
    rows = [(k, t, 1, "s") for k, t in enumerate(texts)] + [(3, texts[3], 2, "s"), (None, texts[3], 2, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int, spans string").repartition(3)
    got = sorted((str(r.doc_id), [r.n_assign, r.n_access, r.n_hex], r.base_sha256, r.spans) for r in secrets.scan(df).collect())
    assert got == sorted((str(k), *plain_spans(t, limits)) for k, t, *_ in rows)
    assert secrets.scan(df.where("false")).count() == 0


def test_redaction(spark):
    texts = secret_texts()[:-1]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, _spans2 string")
    for r in secrets.redacted(df).collect():
        text = texts[r.doc_id]
        if text is None:
            assert r.text is None
            continue
        keep, last, out = plain_spans(text, secrets.Limits())[2], 0, ""
        for s, e in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in keep.split(",") if x)):
            if s >= last:
                out += text[last:s] + "[secret]"
            last = max(last, e)
        assert r.text == out + text[last:]


# --- 10 ------------------------------------------------------------------------------------------


def test_gradient_and_fit():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 400)
    row = np.repeat(np.arange(400), 3)
    column = np.array([rng.choice(8, 3, replace=False) + (0 if g == 0 else 4 * g - 2) for g in grades]).ravel() % 12
    theta = np.concatenate([rng.normal(size=12) / 3, [1.0, 0.3]])
    value, slope = toxicity._loss(theta, row, column, grades, 12, 1e-3)
    numeric = [(toxicity._loss(theta + e, row, column, grades, 12, 1e-3)[0] - toxicity._loss(theta - e, row, column, grades, 12, 1e-3)[0]) / 2e-5 for e in np.eye(14) * 1e-5]
    assert np.allclose(slope, numeric, atol=1e-7)
    weights, cuts = toxicity.fit_ordinal(row, column, grades, 12)
    assert cuts[0] < cuts[1]
    p = toxicity.probabilities(np.bincount(row, weights[column], 400), cuts.tolist())
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == grades).mean() > 0.6


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["vile", "nasty", "horrid", "rotten"]
    texts, labels = [], []
    for k in range(500):
        words = prose(rng, rng.randint(20, 80)).split()
        toxic = k % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        texts.append((k, " ".join(words)))
        if k < 400:
            labels.append((k, rng.randint(0, 1), int(toxic), "t"))
    texts += [(500, None), (501, ""), (501, "You NASTY, vile, rotten, horrid thing"), (None, "nothing")]
    labels += [(None, 1, 1, "t"), (3, None, None, "t"), (0, 1, 1, "t"), (9999, 1, 1, "t")]
    docs = spark.createDataFrame([(*t, 1, 0.5) for t in texts], "doc_id long, text string, grade int, p_toxic double").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = toxicity.train(docs, marks)
    assert {"vile$", "nasty$", "horrid$", "rotten$"} <= set(model.weights)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 500}
    assert all(r.toxic == (k % 6 == 0) for k, r in by.items())
    assert all(abs(r.expected_severity) <= 2 and 0 <= r.p_toxic <= 1 for r in got)
    assert {(r.toxic, r.grade > 0) for r in got if r.doc_id == 501} == {(False, False), (True, True)}
    few, many = ([by[k].expected_severity for k, t in texts[:500] if len({w.strip(".").lower() for w in t.split()} & set(bad)) == n] for n in (1, 4))
    assert np.mean(few) < np.mean(many)
    empty = toxicity.train(docs, marks.where("false"))
    assert not any(r.toxic for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_redaction_in_long_texts_and_beside_columns_of_any_name(spark):
    """Spans across the pieces that texts are cut into, marks of the scan's own in a text, clashing columns, repeated rows."""
    rng = random.Random(21)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    long = " ".join(rng.choice([f"token={key(rng.randint(6, 60))}", prose(rng, 5), "😀é" * rng.randint(1, 9), f"\x01\x02{key(30)}\x01", key(4500)]) for _ in range(60))
    texts = [None, "", "x", "\x01", f"\x01token=abcdef\x02{key(24)}\x01", long, long]
    df = spark.createDataFrame([(k, t, "mine", 1, "w") for k, t in enumerate(texts)], "doc_id long, text string, spans string, SPANS_ int, _spans string")
    got = {r.doc_id: r for r in secrets.redacted(df).collect()}
    assert secrets.redacted(df).columns == df.columns and secrets.redacted(df.where("false")).count() == 0
    for k, text in enumerate(texts):
        assert (got[k].spans, got[k].SPANS_, got[k]._spans) == ("mine", 1, "w")
        keep, last, out = plain_spans(text, secrets.Limits())[2], 0, ""
        for s, e in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in keep.split(",") if x)):
            if s >= last:
                out += text[last:s] + "[secret]"
            last = max(last, e)
        assert got[k].text == (None if text is None else out + text[last:])
    scans = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert scans == {k: plain_spans(t, secrets.Limits())[2] for k, t in enumerate(texts)}


def test_running_sums_and_maxima(spark):
    from pyspark.sql import functions as F

    from lattica.llm.common import running

    rng = random.Random(22)
    rows = [([rng.randint(-5, 9) for _ in range(n)],) for n in (1, 2, 255, 256, 257, 1000, 5000)]
    df = spark.createDataFrame(rows, "v array<int>")
    for r in df.select("v", running(F.col("v")).alias("s"), running(F.col("v"), F.greatest).alias("m")).collect():
        assert r.s == list(itertools.accumulate(r.v)) and r.m == list(itertools.accumulate([0, *r.v], max))[1:]


def test_long_runs_are_summed_whole():
    """Sums in logarithms are those of products; long words underflow nowhere; a piece across any place counts."""
    rng = random.Random(31)
    pieces = {"".join(p): (rng.random() / 9, rng.random() / 9) for n in (1, 2, 3, 4) for p in itertools.product("ab", repeat=n) if rng.random() < 0.6}
    for n in (1, 2, 5, 24, 30, 60):
        word = "".join(rng.choice("abc") for _ in range(n))
        assert np.allclose(langid.log_forward(word, pieces, 2, 4), np.log(langid.forward(word, pieces, 2, 4)[-1]))
        for k in range(2):
            plain, logs = langid.expected(word, pieces, k, 4, 100), langid.expected(word, pieces, k, 4, 0)
            assert plain.keys() == logs.keys() and all(math.isclose(plain[p], logs[p], rel_tol=1e-6) for p in plain)
    assert np.isfinite(langid.log_forward("abc" * 20_000, pieces, 2, 4)).all()
    counts = langid.expected("c" * 300, pieces, 0, 4)
    assert counts == {} and np.allclose(langid.log_forward("c" * 300, pieces, 2, 4), 300 * math.log(langid.FLOOR))


def test_a_round_of_training_and_posteriors_by_brute_force(spark, monkeypatch):
    """One round of expectation and maximisation, and every row's posterior, over all segmentations; copies train once."""
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "▁ab"]
    monkeypatch.setattr(langid, "vocabulary", lambda model: pieces)
    rows = [(1, "ab ba", "x"), (2, "ab ba", "x"), (3, "bab", "y"), (4, "Abc!", "y"), (5, None, "y"), (6, "a", None)]
    docs = spark.createDataFrame([(*r, "l", 2) for r in rows], "doc_id long, text string, lang string, lang_pred string, _score int")
    flat = dict.fromkeys(pieces, 1 / len(pieces))

    def cuts(word, table):
        for marks in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *[k + 1 for k, m in enumerate(marks) if m], len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:])]
            if all(p in table or len(p) == 1 for p in parts):
                yield parts, math.prod(table.get(p, langid.FLOOR) for p in parts)

    def words(text):
        return ["▁" + w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w]

    tables, texts = {}, {"x": ["ab ba"], "y": ["bab", "Abc!"]}
    for lang, own in texts.items():
        counts = Counter()
        for word in (w for t in own for w in words(t)):
            every = list(cuts(word, flat))
            whole = sum(p for _, p in every)
            for parts, p in every:
                for piece in parts:
                    counts[piece] += p / whole * (piece in flat)
        total = sum(counts.values()) + langid.SMOOTHING * len(pieces)
        tables[lang] = {p: (counts[p] + langid.SMOOTHING) / total for p in pieces}
    model = langid.train(docs, PIECE, rounds=1)
    assert model.languages == ["x", "y"] and np.allclose(model.priors, [0.5, 0.5])
    assert all(np.allclose(model.pieces[p], [tables["x"][p], tables["y"][p]]) for p in pieces)
    for r in langid.predict(docs, model).collect():
        text = {d: t for d, t, _ in rows}[r.doc_id]
        logs = np.array([sum(math.log(sum(p for _, p in cuts(w, tables[k]))) for w in words(text)) for k in "xy"])
        share = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert (r.lang_pred, round(r.score, 9)) == (("xy"[share.argmax()], round(share.max(), 9)) if words(text) else ("und", 0))
    kept = langid.recognised(docs, model)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.lang_pred, r._score) for r in kept.collect()) == [(k, "l", 2) for k in (1, 2, 3, 4, 6)]


def test_columns_named_like_the_recognisers_own(languages):
    from pyspark.sql import functions as F

    docs = languages.withColumn("_lang", F.lit("mine")).withColumn("_score", F.lit(1)).withColumn("LANG_PRED_", F.lit(2))
    model = langid.train(languages, PIECE, sample_rows=20)
    kept = langid.recognised(docs, model)
    assert kept.columns == docs.columns and {(r._lang, r._score, r.LANG_PRED_) for r in kept.collect()} == {("mine", 1, 2)}


def test_toxicity_by_brute_force(spark):
    """Features, halves, grades, the optimum and every score worked out plainly; then grades that labels give themselves."""
    import xxhash

    rng = random.Random(41)
    bad, rows, labels = ["vile", "nasty", "horrid", "rotten"], [], []
    for k in range(420):
        words = prose(rng, rng.randint(10, 30)).split()
        toxic = k % 4 == 0
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic), rng.choice([None, 0, 1])))
    rows += [(500, None), (501, ""), (None, "vile text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))

    marks = {d: t for d, t, _ in labels}
    seen = [(t, marks[d], np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64) % 2) for d, t in rows if d in marks]

    def telling(some):
        n = [sum(1 for _, t, _ in some if t == k) for k in (0, 1)]
        counts, after = {}, {}
        for text, toxic, _ in some:
            for f in toxicity.features(text):
                counts.setdefault(f, [0, 0])[toxic] += 1
            if toxic:
                words = re.findall(r"[^\W\d_]+", text.lower())
                for w, following in zip(words, [*words[1:], ""]):
                    for f in toxicity.features(w):
                        after.setdefault(f, set()).add(zlib.crc32(following.encode()) % 64)
        out = set()
        for f, (good, ill) in counts.items():
            share, total = n[1] / sum(n), good + ill
            ratio = 2 * sum(c * math.log(c / (total * p)) for c, p in ((ill, share), (good, 1 - share)) if c)
            if len(after.get(f, ())) >= toxicity.CONTEXTS and ill / total > share and ratio > toxicity.EVIDENCE:
                out.add(f)
        return out

    assert set(model.weights) == telling(seen)
    halves = [telling([s for s in seen if s[2] == h]) for h in (0, 1)]
    places = [sum(bool(toxicity.features(w) & halves[1 - h]) for w in re.findall(r"[^\W\d_]+", t.lower())) if toxic else 0 for t, toxic, h in seen]
    grades = toxicity.severity(np.array([t for _, t, _ in seen]), np.array(places))
    assert set(grades) == {0, 1, 2}
    index = {f: k for k, f in enumerate(sorted(model.weights))}
    pairs = [(k, index[f]) for k, (t, _, _) in enumerate(seen) for f in toxicity.features(t) & set(index)]
    row, column = (np.array(x) for x in zip(*pairs))
    cuts = model.thresholds
    theta = np.array([model.weights[f] for f in sorted(index)] + [cuts[0], math.log(cuts[1] - cuts[0])])
    loss, slope = toxicity._loss(theta, row, column, grades, len(index), 1e-6)
    near = [toxicity._loss(theta + np.random.default_rng(k).normal(size=len(theta)) * size, row, column, grades, len(index), 1e-6)[0] for k in range(20) for size in (0.01, 0.1, 1)]
    assert np.abs(slope).max() < 1e-3 and min(near) > loss - 1e-6
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for d, text in rows:
        z = sum(model.weights[f] for f in toxicity.features(text or "") & set(model.weights))
        below = [1 / (1 + math.exp(z - c)) for c in cuts]
        want = (sum(b < 0.5 for b in below), 1 - below[0], 2 - sum(below), 1 - below[0] > 0.5)
        assert np.allclose((got[d].grade, got[d].p_toxic, got[d].expected_severity, got[d].toxic), want), d

    worst = {d: 0 if not t else 2 if "vile" in dict(rows)[d].lower() else 1 for d, t, _ in labels}
    model = toxicity.train(docs, spark.createDataFrame([(d, t, worst[d]) for d, t, _ in labels], "doc_id long, toxic int, severity int"))
    got = {r.doc_id: r.grade for r in toxicity.score(docs, model).collect()}
    assert sum(got[d] == g for d, g in worst.items()) > 0.97 * len(worst)
