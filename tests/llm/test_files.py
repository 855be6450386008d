"""Operators 4 and 6: archives, what damage leaves of them, and media columns."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lattica.llm import media, warc
from lattica.llm.common import new_folder, write_bytes

PAGES = "page_id long, url string, html string, id int, payload string, sha string, least long, path string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://x/{k}?é \n", f"<p>{k % 7} {'long ' * (k % 5)}</p>") for k in range(60)]
    rows += [(60, None, None), (61, "u", ""), (62, "u", "WARC/1.1\r\n\r\nWARC/1.1"), (63, "u", "x" * 300_000), (5, "u", "<p>5 </p>"), (None, "u", "<p>1 long </p>"), (None, "u", "alone"), (64, "u", "é漢")]
    return spark.createDataFrame([(*r, 1, "p", "s", 2, "q") for r in rows], PAGES).repartition(3)


def test_round_trip(pages):
    got = warc.read_archives(warc.write_archives(pages, file_bytes=5_000))
    assert warc.quarantine(got).count() == 0
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    firsts = defaultdict(list)
    for page, payload in rows:
        firsts[payload].append(page)
    want = []
    for page, payload in rows:
        known = [p for p in firsts[payload] if p is not None]
        least = min(known) if known else None
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        response = least is None or page == least
        want.append((str(page), len(payload), own, "response" if response else "revisit", str(None if response else least)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got.collect()) == sorted(want)
    payloads = {(r.page_id, bytes(r.payload)) for r in got.where("record_type = 'response'").collect()}
    assert payloads <= set(rows)


def test_short_payloads_and_empty_tables(pages):
    every = warc.read_archives(warc.write_archives(pages, min_revisit_bytes=1 << 20))
    assert every.where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage(spark, compressed):
    plain = [warc.record(k, f"http://x/{k}", f"payload {k} ".encode() * 50) for k in range(8)]
    parts = [warc.member(p) if compressed else p for p in plain]
    whole = b"".join(parts)
    at = np.cumsum([0, *map(len, parts)])
    cases = {
        "whole": (whole, range(8), 0),
        "cut": (whole[: at[5] + 40], range(5), 1),
        "flipped": (whole[: at[3] - 20] + bytes([whole[at[3] - 20] ^ 255]) + whole[at[3] - 19 :], [0, 1, 3, 4, 5, 6, 7], 1),  # in the payload, which the digest covers
        "noise between": (whole[: at[3]] + b"\x1f\x8b\x08 noise WARC/ " * 30 + whole[at[3] :], range(8), 1),
        "head lost": (whole[25:], range(1, 8), 1),
        "bytes lost": (whole[: at[5] - 60] + whole[at[5] - 30 :], [0, 1, 2, 3, 5, 6, 7], 1),
        "nothing but noise": (b"noise" * 100, [], 1),
        "empty": (b"", [], 0),
    }
    folder = new_folder(spark, "salvage")
    for name, (data, pages, gaps) in cases.items():
        path = f"{folder}/{name.replace(' ', '-')}.warc" + ".gz" * compressed
        write_bytes(path, [data])
        got = warc.read_archives(spark.createDataFrame([(path,)], "path string"))
        assert sorted(r.page_id for r in warc.records(got).collect()) == list(pages), name
        logged = sorted((r.begin, r.end) for r in warc.quarantine(got).collect())
        assert len(logged) == gaps, name
        if gaps:
            kept = {(r.begin, r.end) for r in warc.records(got).select("begin", "end").collect()}
            assert sum(b - a for a, b in kept | set(logged)) == len(data), name


def test_wrong_length_does_not_swallow_the_next_record():
    plain = [warc.record(k, "u", b"<p>text</p>") for k in range(4)]
    worse = plain[1].replace(b"Content-Length: ", b"Content-Length: 1")
    found = list(warc.salvage(warc._Bytes(plain[0] + worse + plain[2] + plain[3]), False))
    assert [f["x-page-id"] for _, _, f, _, why in found if f] == ["0", "2", "3"]


def test_media(docs, rows, none):
    got = media.fingerprints(media.media_column(docs)).collect()
    by_text = defaultdict(set)
    want = []
    for doc, text in rows:
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.append((str(doc), len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    for r in got:
        by_text[r.payload_sha256].add((r.media_bytes, r.media_sha256, tuple(r.frames), tuple(r.codes)))
        assert r.media_bytes == r.payload_bytes + 44
    assert all(len(v) == 1 for v in by_text.values())
    assert media.fingerprints(media.media_column(none)).count() == 0


def test_peaks_are_those_of_the_whole_spectrum():
    rng = np.random.default_rng(5)
    tone = 100 + 60 * np.sin(np.arange(400_000) * 2 * np.pi * 37 / media.WINDOW) + rng.normal(0, 3, 400_000)
    data = np.clip(tone, 0, 255).astype(np.uint8).tobytes()
    time, freq = media.peaks(data)
    signal = np.frombuffer(data, np.uint8).astype(np.float32) - 128
    n = 1 + -(-(len(signal) - media.WINDOW) // media.HOP)
    signal = np.pad(signal, (0, (n - 1) * media.HOP + media.WINDOW - len(signal)))
    power = np.array([np.abs(np.fft.rfft(signal[k * media.HOP : k * media.HOP + media.WINDOW] * media._HANN))[1:] ** 2 for k in range(n)])
    want = []
    for k in range(n):
        tops = [j for j in range(1, power.shape[1] - 1) if power[k, j] > power[k, j - 1] and power[k, j] >= power[k, j + 1] and (k == 0 or power[k, j] >= power[k - 1, j]) and (k == n - 1 or power[k, j] >= power[k + 1, j])]
        want += [(k, j + 1) for j in sorted(sorted(tops, key=lambda j: -power[k, j])[: media.PEAKS])]
    assert list(zip(time.tolist(), freq.tolist())) == want
    assert (freq == 37).sum() > n / 4


def test_wav_is_lossless():
    for data in (b"", b"a", bytes(range(256)), b"\x00" * 64):
        back = media.samples(media.to_wav(data))
        assert back[: len(data)] == data and len(back) % 64 == 0 and len(back) >= 64 and not any(back[len(data) :])


@pytest.mark.parametrize("compressed", [True, False])
def test_headers_of_any_length(spark, compressed):
    """Urls of a megabyte, and one whose encoded form is longer than any step of reading, between plain records."""
    urls = ["u", "http://x/" + "é" * 30_000, "http://x/" + "a" * (1 << 20), None, "http://x/ \r\n\r\n" + "漢" * 100_000]
    rows = [(k, u, f"<p>{k}</p>") for k, u in enumerate(urls)]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.read_archives(files)
    assert warc.quarantine(got).count() == 0
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got.collect()) == [(k, h) for k, _, h in rows]
    plain = b"".join(warc.member(warc.record(k, u, h.encode())) if compressed else warc.record(k, u, h.encode()) for k, u, h in rows)
    path = f"{new_folder(spark, 'long')}/long.warc" + ".gz" * compressed
    write_bytes(path, [plain])
    for payloads in (True, False):
        found = warc.read_archives(spark.createDataFrame([(path,)], "path string"), payloads).collect()
        assert sorted((r.page_id, r.payload_bytes, r.gap) for r in found) == [(k, len(h), None) for k, _, h in rows]


def test_large_members_and_payloads_that_many_pages_have(spark, monkeypatch):
    """A member larger than what is held in memory, damage behind it, and copies dealt over tasks."""
    monkeypatch.setattr(warc, "HELD_BYTES", 1000)
    rng = np.random.default_rng(1)
    blocks = [warc.record(k, "u", rng.integers(32, 120, 700_000, dtype=np.uint8).tobytes()) for k in range(3)]
    data = b"".join(map(warc.member, blocks))
    found = list(warc.salvage(warc._Bytes(data), True))
    assert [f["x-page-id"] for *_, f, _, _ in found] == ["0", "1", "2"] and all(p.length == 700_000 == len(p.data) for _, _, _, p, _ in found)
    both = warc.member(blocks[0] + blocks[1])
    assert [f["x-page-id"] for *_, f, _, _ in warc.salvage(warc._Bytes(both), True, False)] == ["0", "1"]
    rows = [(k, "u", "the same" if k % 3 else f"own {k}") for k in range(200)] + [(200, "u", None), (201, "u", ""), (None, "u", "the same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    kinds = [sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.read_archives(warc.write_archives(pages, hot_rows=n)).collect()) for n in (5, 1 << 30)]
    assert kinds[0] == kinds[1] and len(kinds[0]) == len(rows) and ("4", "revisit", "1") in kinds[0]


def test_media_that_are_missing_or_something_else(spark):
    rows = [(1, 3, media.to_wav(b"abc")), (1, 3, media.to_wav(b"abc")), (2, None, None), (None, 0, b""), (4, 5, b"RIFF....WAVE"), (5, 1, media.to_wav(b"x")[:20])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, n_bytes long, media binary, frames int, codes string")
    got = sorted(media.fingerprints(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.payload_bytes for r in got] == [64, 64, None, None, None, None] and got[0] == got[1]
    assert [r.media_bytes for r in got] == [108, 108, None, 12, 20, 0] and got[2].frames is None


def test_pairs_are_those_of_all_near_peaks():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 200):
        peaks = sorted({(int(t), int(f)) for t, f in zip(rng.integers(0, 3 * n + 1, n), rng.integers(1, 512, n))})
        want = sorted((t, f << 14 | g << 4 | u - t) for k, (t, f) in enumerate(peaks) for u, g in peaks[k + 1 : k + 1 + media.FAN] if u - t <= media.REACH)
        time, tone = (np.array([p[i] for p in peaks], int) for i in (0, 1))
        frames, codes = media.pairs(time, tone)
        assert list(zip(frames.tolist(), codes.tolist())) == want
