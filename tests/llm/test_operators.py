"""Operators against brute force on small tables: nulls, empty texts, repeated rows, extra columns, no rows at all."""

import base64
import binascii
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from tilework.llm import audio, lm, merge_dropout, packing, pii, quality, simhash, simhash_pairs, token_counts, token_files, warc, words
from tilework.llm.common import new_folder
from tilework.llm.words import default_path

LONG = "the quick brown fox jumps over the lazy dog while many words follow here " * 40
TEXTS = [None, "", "  \n ", "one", "Hello, World! ÀÉ x", LONG, LONG, LONG.replace("lazy", "sleepy"), "don't 12345 日本 ▁ a  b\ttab", "mail a.b@c.de or x@y.z.w! ip 1.2.3.4 and 999.1.1.1, card 4111 1111 1111 1111, +49 (30) 1234567 DE89 3704 0044 0532 0130 00"]
SCHEMA = "doc_id long, text string, votes string, fp string, media string, row string, h string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "v", "f", "m", "r", "h") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "null id", "", "", "", "", "")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    t = Tokenizer.from_file(default_path())
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(docs, empty):
    lengths = [len(ids_of(r.text)) for r in docs.collect()]
    h = token_counts.length_histogram(docs)
    assert {r.n_tokens: r.n_docs for r in h.collect()} == Counter(lengths)
    sums = token_counts.suffix_sums(h)
    for r in sums.collect():
        assert (r.docs_at_least, r.truncated_tokens) == (sum(x >= r.n_tokens for x in lengths), sum(min(x, r.n_tokens) for x in lengths))
    assert {r.context_limit: r.truncated_tokens for r in token_counts.at_limits(sums, [3, 100, 10**6]).collect()} == {k: sum(min(x, k) for x in lengths) for k in (3, 100, 10**6)}
    assert token_counts.suffix_sums(token_counts.length_histogram(empty)).count() == 0


def test_audio(docs, empty):
    for r in audio.document_audio(docs).collect():
        text = TEXTS[r.doc_id] if r.doc_id is not None else "null id"
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = audio.wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert bytes(audio.samples_of(media)) == payload and r.n_frames == len(payload) // 192
        table = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        kept = np.concatenate([np.array(x, "f4").reshape(-1, audio.BANDS)[:n] for x, n in zip(table.column("log_mel").combine_chunks().storage.to_pylist(), table.column("frames").to_pylist(), strict=True)])
        mels, energy = plain_features(payload)
        assert np.allclose(kept, mels, atol=2e-3) and np.allclose(r.mean_log_mel, mels.mean(0), atol=2e-3)
        assert table.column("start_s").to_pylist() == [k * 16 * 192 / 12_000 for k in range(len(table))]
        assert [(x.start_s, x.end_s) for x in r.segments] == [(a * 192 / 12_000, b * 192 / 12_000) for a, b in audio.segments(energy)]
    assert audio.document_audio(empty).count() == 0


def plain_features(payload):
    """Resampling by inserting zeros, filtering by convolution and dropping samples; then frame by frame."""
    x = (np.frombuffer(payload, "u1").astype("f8") - 128) / 128
    taps = audio.UP * audio.TAPS
    k = np.arange(taps) - (taps - 1) / 2
    cut = 0.5 / max(audio.UP, audio.DOWN) * 0.92
    h = np.sinc(2 * cut * k) * np.hamming(taps)
    for phase in range(audio.UP):
        h[phase :: audio.UP] /= h[phase :: audio.UP].sum()
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    whole = np.concatenate([np.convolve(up, h), np.zeros(4 * taps)])
    lag = audio.UP * (audio.TAPS // 2 - 1)  # output t is led by half of the filter's inputs
    y = np.concatenate([whole[lag :: audio.DOWN], np.zeros(audio.WINDOW)])
    frames = -(-len(payload) // 192)
    window = np.hanning(audio.WINDOW + 1)[:-1]
    mels, energy = [], []
    for f in range(frames):
        w = y[f * audio.HOP : f * audio.HOP + audio.WINDOW] * window
        spectrum = np.array([abs((w * np.exp(-2j * np.pi * b * np.arange(audio.WINDOW) / audio.WINDOW)).sum()) ** 2 for b in range(audio.WINDOW // 2 + 1)])
        mels.append(np.log10(np.maximum(spectrum @ audio._mel(), 1e-10)))
        energy.append(10 * np.log10(max((w**2).mean(), 1e-10)))
    return np.array(mels), np.array(energy)


def test_resampling_keeps_a_tone():
    t = np.arange(12_000)
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 440 * t / 12_000)).astype("u1")
    y = audio.resampled(tone, 0, 8000)[200:7800]
    phase = 2 * np.pi * 440 * np.arange(len(y)) / 8000
    basis = np.stack([np.sin(phase), np.cos(phase)], 1)
    fit, *_ = np.linalg.lstsq(basis, y, rcond=None)
    assert abs(np.hypot(*fit) - 100 / 128) < 0.01 and np.abs(basis @ fit - y).max() < 0.02


def test_hysteresis():
    e = np.array([0, 0, 5, 0.2, 5, -3, 0, 0], "f4")
    assert audio.segments(e, 1.0, -0.5) == [(2, 5)]


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, empty):
    for r in quality.judge(docs).collect():
        n = base_counts(TEXTS[r.doc_id] if r.doc_id is not None else "null id")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and (not r.base_failed or not r.kept)
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).columns == docs.columns
    kept = {(r.doc_id, r.kept) for r in quality.judge(docs).collect()}
    assert quality.keep_good(docs).count() == sum(k for _, k in kept)


def test_estimation_finds_bad_texts():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    votes = np.stack([np.where(rng.random(4000) < 0.6, np.where((rng.random(4000) < 0.9) == good, 1, -1), 0) for _ in range(9)], 1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, _, share = quality.estimate(patterns, counts.astype(float))
    assert ((posterior[where.ravel()] > 0.5) == good).mean() > 0.95 and abs(share - 0.8) < 0.05


def test_token_files(spark, docs, empty):
    folder = new_folder(spark, "test")
    rows = token_files.round_trip(docs, folder).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, zlib.crc32(r.ids)) for r in rows) == sorted((r.doc_id if r.doc_id is not None else -1, len(ids_of(r.text)) + 1, crc(ids_of(r.text) + [1])) for r in docs.collect())
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert token_files.read_document(folder, 5).tolist() == ids_of(LONG) + [1] and token_files.read_document(folder, 99) is None
    assert token_files.round_trip(empty, new_folder(spark, "test")).count() == 0


def test_dictionaries_are_trained_and_used(spark):
    rng = np.random.default_rng(8)
    lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"], 12)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(lines, 12)) + f" {rng.integers(0, 10**9)}") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert token_files.train_dictionary(table)[:4] == bytes.fromhex("37a430ec")  # the magic number of a trained one
    folder = new_folder(spark, "test")
    for r in token_files.round_trip(table, folder).collect():
        assert zlib.crc32(r.ids) == crc(ids_of(rows[r.doc_id][1]) + [1])
    assert token_files.read_document(folder, 399).tolist() == ids_of(rows[399][1]) + [1]
    pages = table.selectExpr("doc_id as page_id", "'u' as url", "concat('<html>', text, '</html>') as html", "1 as payload", "2 as first")
    assert warc.train_dictionary(pages)[:4] == bytes.fromhex("37a430ec")
    folder = new_folder(spark, "test")
    files = warc.write_archives(pages, folder)
    back = {r.page_id: r.payload_digest for r in warc.read_archives(spark, folder, files).collect()}
    assert back == {i: base64.b32encode(hashlib.sha1(f"<html>{t}</html>".encode()).digest()).decode() for i, t in rows}
    few = spark.createDataFrame([(1, "alone and short"), (2, "")], "doc_id long, text string")
    assert len(token_files.train_dictionary(few)) > 0 and token_files.train_dictionary(few.limit(0)) == b""
    assert {r.doc_id: r.n_tokens for r in token_files.round_trip(few, new_folder(spark, "test")).collect()} == {1: len(ids_of("alone and short")) + 1, 2: 1}


def test_very_long_texts(spark):
    """A million characters in one text, through every operator on texts."""
    unit = "Wort für Wort, word by word: 4111 1111 1111 1111 a.b@c.de <x> 12.5 \n"
    text = unit * (1_000_000 // len(unit))
    table = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    data, ids = text.encode(), ids_of(text)
    assert token_counts.length_histogram(table).where("n_tokens > 1000").first().n_tokens == len(ids)
    assert audio.document_audio(table).where("doc_id = 1").first().n_bytes == len(data)
    assert quality.judge(table).where("doc_id = 1").first().n_words == len(data.split())
    assert {r.doc_id: r.n_tokens for r in token_files.round_trip(table, new_folder(spark, "test")).collect()}[1] == len(ids) + 1
    pages = table.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    folder = new_folder(spark, "test")
    assert {r.page_id: r.payload_bytes for r in warc.read_archives(spark, folder, warc.write_archives(pages, folder)).collect()}[1] == len(data)
    assert lm.score(table).where("doc_id = 1").first().n_tokens == len(data.split()) + 1
    assert sum(r.length for r in packing.pack(table).where("doc_id = 1").collect()) == len(ids) + 1
    assert all(r.lossless for r in merge_dropout.documents_round_trip(table).collect())
    found = pii.report(table).where("doc_id = 1").first()
    assert found.n_email == found.n_card == text.count("@") and pii.mask(table).where("doc_id = 1").first().text.count("<EMAIL>") == found.n_email
    assert simhash.near_duplicates(table).where("doc_id = 1").first().fingerprint == f"{simhash.fingerprint(text):016x}"
    assert simhash_pairs.keep_one(table).count() == 3


def test_warc(spark):
    pages = [(3, "u3", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u2", None), (5, "u 5", ""), (7, "ü", "x" * 100_000), (1, None, "<p>same</p>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = new_folder(spark, "test")
    rows = warc.read_archives(spark, folder, warc.write_archives(table, folder)).collect()
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        first.setdefault(h or "", i)
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), None if first[h or ""] == i else first[h or ""]) for i, _, h in pages)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in rows), key=str) == sorted(want, key=str)
    none = new_folder(spark, "test")
    assert warc.read_archives(spark, none, warc.write_archives(table.limit(0), none)).count() == 0


def test_ppm(docs, empty):
    rows = lm.score(docs).collect()
    assert len(rows) == docs.count()
    source = [(r.doc_id, r.text or "") for r in docs.collect()]
    held = lambda i: binascii.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + [""]
    c = Counter(w for i, t in source if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in source)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.held_out == held(r.doc_id) and r.score < 0 for r in rows) and lm.score(empty).count() == 0


def plain_ppm(train, text):
    """log10 probability of a text and its end, by method C with exclusions, from counts of every context."""
    counts = defaultdict(Counter)
    for t in train:
        s = bytes([lm.BEGIN] * lm.ORDER) + t + bytes([lm.END])
        for i in range(lm.ORDER, len(s)):
            for k in range(lm.ORDER + 1):
                counts[s[i - k : i]][s[i]] += 1
    s, out = bytes([lm.BEGIN] * lm.ORDER) + text + bytes([lm.END]), 0.0
    for i in range(lm.ORDER, len(s)):
        excluded, p = set(), 1.0
        for k in range(lm.ORDER, -1, -1):
            here = {b: n for b, n in counts.get(s[i - k : i], {}).items() if b not in excluded}
            if not here:
                continue
            escape = len(here) if len(here) < 256 - len(excluded) else 0
            total = sum(here.values()) + escape
            if s[i] in here:
                p *= here[s[i]] / total
                break
            p *= escape / total
            excluded |= set(here)
        else:
            p /= max(1, 256 - len(excluded))
        out += math.log10(p)
    return out


def test_ppm_scores_equal_a_plain_model(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab cdÄ\n"), int(rng.integers(0, 60)), p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])) for _ in range(60)] + ["", None, "zebra quux", "日本語", LONG]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low = [(t or "").encode().lower() for t in texts]
    train = [t for i, t in enumerate(low) if binascii.crc32(str(i).encode()) % 7 != 2]
    want = {i: plain_ppm(train, t) for i, t in enumerate(low)}
    for block, step in ((lm.BLOCK_BYTES, lm.STEP), (300, 50)):
        monkeypatch.setattr(lm, "BLOCK_BYTES", block)
        monkeypatch.setattr(lm, "STEP", step)
        got = {r.doc_id: r.score for r in lm.score(frame).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_ppm_without_training_text(spark):
    one = spark.createDataFrame([(next(i for i in range(99) if binascii.crc32(str(i).encode()) % 7 == 2), "abc")], "doc_id long, text string")
    assert abs(lm.score(one).first().score + 4 * math.log10(256)) < 1e-9


def test_packing(docs, empty):
    rows = packing.pack(docs, 256).collect()
    ids = {r.doc_id: ids_of(r.text) + [2] for r in docs.collect()}
    bins = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in rows) == sum(len(ids[r.doc_id]) for r in docs.collect())
    assert sorted(bins) == list(range(len(bins))) and packing.pack(empty).count() == 0


def check_plan(demand, size):
    plan = packing.make_plan(demand, size)
    got = np.zeros_like(demand)
    for p, times in plan.patterns:
        assert times > 0 and sum(c * a for c, a in p.items()) <= size
        for c, a in p.items():
            got[c] += a * times
    n = sum(t for _, t in plan.patterns)
    assert (got == demand).all() and n <= sum(t for _, t in packing.greedy_patterns(demand, size))
    return plan, n


def test_plans_hold_the_demand_and_need_no_more_than_first_fit():
    rng = np.random.default_rng(3)
    for n in (1, 30, 700, 20_000):
        demand = np.bincount(rng.integers(1, 400, n), minlength=513)
        _, used = check_plan(demand, 512)
        assert used <= math.ceil(demand @ np.arange(513) / 512) * 1.04 + 1
    check_plan(np.bincount([9] * 10_000, minlength=513), 512)
    check_plan(np.bincount([1] * 5000 + [512] * 7, minlength=513), 512)
    assert packing.make_plan(np.zeros(513, "i8"), 512).patterns == []


def test_subset_sums_fill_sequences():
    left = np.bincount([7, 7, 5, 4, 3, 3], minlength=21)
    assert packing._subset(left, 12) == {7: 1, 5: 1} and sum(c * a for c, a in packing._subset(left, 6).items()) == 6
    done = packing.subset_patterns(np.bincount([9] * 10 + [6] * 10 + [5] * 10, minlength=21), 20)
    assert sum(t for _, t in done) == 10 and all(sum(c * a for c, a in p.items()) == 20 for p, _ in done)


def test_program_is_solved_beside_a_session(spark):
    """Dense algebra in a process that has forked, behind a live session."""
    assert spark.range(10).repartition(3).count() == 10
    rng = np.random.default_rng(11)
    square = rng.random((300, 300))
    assert np.abs(np.einsum("ij,jk->ik", packing.inverted(square), square) - np.eye(300)).max() < 1e-6
    plan, used = check_plan(np.bincount(rng.integers(1, 1200, 3000), minlength=4097), 4096)
    assert plan.priced > 0 and used > 0


def test_priced_columns_beat_first_fit():
    demand = np.bincount([260] * 120 + [136] * 120 + [132] * 120 + [120] * 240, minlength=513)
    plan, n = check_plan(demand, 512)
    assert plan.knapsacks > 0 and plan.priced > 0 and n < sum(t for _, t in packing.greedy_patterns(demand, 512))


def test_column_generation_runs_on_the_documents():
    texts = [r[0] or "" for r in duckdb.sql("select text from read_parquet('/root/testdata/sf0.01/documents.parquet')").fetchall()]
    lengths = [len(words.encoder(default_path()).encode(t)) // 2 + 1 for t in texts]
    demand = np.bincount([k for n in lengths for k in [4096] * (n // 4096) + [n % 4096] if k], minlength=4097)
    plan, _ = check_plan(demand, 4096)
    assert plan.knapsacks > 0 and plan.priced > 0


def test_many_equal_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)
    rows = spark.createDataFrame([(1, "same words again")] * 300 + [(i, "a " * (i % 90)) for i in range(200)], "doc_id long, text string")
    made = packing.pack(rows, 128).collect()
    fill = defaultdict(list)
    for r in made:
        fill[r.sequence_id].append((r.offset, r.length))
    assert len(made) == 500 and all(o == sum(n for _, n in sorted(v)[:i]) for v in fill.values() for i, (o, _) in enumerate(sorted(v)))
    assert max(sum(n for _, n in v) for v in fill.values()) <= 128 and sorted(fill) == list(range(len(fill)))


def test_merge_dropout(docs, empty):
    assert all(r.lossless for r in merge_dropout.documents_round_trip(docs).collect()) and merge_dropout.documents_round_trip(empty).count() == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.default_path())
    plain, varied = merge_dropout.coder(merge_dropout.default_path(), 0.0, 0), merge_dropout.coder(merge_dropout.default_path(), 0.3, 1)
    text = "Hello there, many words of ordinary length follow."
    assert np.frombuffer(plain.encode(text), "<u2").tolist() == sp.encode(text)
    made = {varied.encode(text, k) for k in range(20)}
    assert len(made) > 5 and {varied.decode(x) for x in made} == {text}
    words = {varied.encode("segmentation", k) for k in range(500)}
    assert len(words) > 20  # every occurrence draws by itself
    back = merge_dropout.decode(merge_dropout.encode(docs)).select("text", "decoded").collect()
    assert all(r.text == r.decoded for r in back)


def agenda(coded, sp, part, key):
    """Plain merge dropout of one part: the best candidate of all, skipped ones put aside until a neighbour changes."""
    pieces, aside = [(i, c) for i, c in enumerate(part)], set()
    while True:
        found = []
        for (i, a), (j, b) in zip(pieces, pieces[1:]):
            k = sp.piece_to_id(a + b)
            if (i, a, b) not in aside and k != sp.unk_id() and sp.id_to_piece(k) == a + b:
                found.append((-sp.get_score(k), i, a, b, k))
        if not found:
            return [p for _, p in pieces]
        _, i, a, b, k = min(found)
        x = (key ^ ((i * 0x9E3779B1 + k * 0x85EBCA77) % 2**64)) * 0xC2B2AE3D27D4EB4F % 2**64
        if ((x ^ (x >> 29)) * 0x165667B19E3779F9 >> 32) % 2**32 < int(0.3 * 2**32):
            aside.add((i, a, b))
            continue
        at = [p for p, _ in pieces].index(i)
        pieces[at : at + 2] = [(i, a + b)]


def test_merge_dropout_equals_a_plain_agenda():
    path = merge_dropout.default_path()
    sp, coded = sentencepiece.SentencePieceProcessor(model_file=path), merge_dropout.MergeDropout(path, 0.3, 5)
    rng = np.random.default_rng(2)
    parts = ["▁the", "▁segmentation", "▁Überraschung", "12345", "▁a", "..."] + ["▁" + "".join(rng.choice(list("aeinrst"), int(rng.integers(1, 20)))) for _ in range(60)]
    for part in parts:
        keys = rng.integers(0, 2**63, 12).astype("u8")
        got = coded.merge_many([part] * 12, keys)
        for key, ids in zip(keys.tolist(), got, strict=True):
            want = coded._serialized(agenda(coded, sp, part, key))
            assert ids == want == coded._serialized(coded.merge(part, key))


def test_merge_dropout_memory_changes_nothing(monkeypatch):
    path, texts = merge_dropout.default_path(), [LONG, "Hello, World! " * 30, "  two  spaces ▁ x", "ab" * 40_000, ""]
    kept = merge_dropout.MergeDropout(path, 0.1, 7)
    first = [kept.encode_many(texts, [1, 2, 3, 4, 5]) for _ in range(4)]
    monkeypatch.setattr(merge_dropout, "NODES_KEPT", 0)
    monkeypatch.setattr(merge_dropout, "PARTS_KEPT", 0)
    assert kept.n_nodes > 0 and all(x == merge_dropout.MergeDropout(path, 0.1, 7).encode_many(texts, [1, 2, 3, 4, 5]) for x in first)
    assert [kept.decode(x) for x in first[0]] == texts


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def base_spans(text):
    out = []
    for kind in pii.BASE:
        for m in re.finditer(pii.PATTERNS[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(docs, empty):
    for r in pii.report(docs).collect():
        found = base_spans((TEXTS[r.doc_id] if r.doc_id is not None else "null id") or "")
        assert r.base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        if r.doc_id == 9:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_iban) == (2, 1, 1, 1, 1) and r.spans.startswith(",".join(found))
    assert pii.report(empty).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[5] == LONG and masked[0] is None and masked[9].startswith("mail <EMAIL> or <EMAIL>! ip <IP> and 999.1.1.1, card <CARD>")


def test_added_personal_data(spark):
    texts = {
        1: "pay ES9121000418450200051332 PAID", 2: "BE68539007547034 USD", 3: "DE89 3704 0044 0532 0130 00 and GB82 WEST 1234 5698 7654 32.",
        4: "this is a test DE89370400440532013000", 5: "a bank test DE89370400440532013000", 6: "DE88370400440532013000",
        7: "card 378282246310005", 8: "number 378282246310005", 9: "her ssn 123-45-6789", 10: "code 123-45-6789", 11: "ssn 000-45-6789",
    }
    found = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r.n_iban for i, r in found.items() if r.n_iban} == {1: 1, 2: 1, 3: 2, 5: 1}
    assert found[1].spans == "iban:4:28" and found[3].spans == "iban:0:27,iban:32:59"
    assert [i for i, r in found.items() if r.n_short_card] == [7] and [i for i, r in found.items() if r.n_ssn] == [9]


def test_many_spans_in_one_text(spark):
    rng = np.random.default_rng(6)
    kinds = ["a.b@c.de", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+49 (30) 1234567", "Ä\U0001f600", "DE89 3704 0044 0532 0130 00", "\ufeff"]
    text = "\n".join(str(x) for x in rng.choice(kinds, 5000))
    frame = spark.createDataFrame([(1, text, 5), (2, None, None), (3, "\ufeffx@y.de\ufeff", 8)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in pii.report(frame).collect()}
    want = base_spans(text)
    assert got[1].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and got[1].spans.startswith(",".join(want))
    spans = sorted((int(x.split(":")[1]), -int(x.split(":")[2]), x.split(":")[0]) for x in got[1].spans.split(","))
    out, at = [], 0
    for start, back, kind in spans:
        if start >= at:
            out.append(text[at:start] + f"<{kind.upper()}>")
        at = max(at, -back)
    masked = {r.doc_id: r for r in pii.mask(frame).collect()}
    assert masked[1].text == "".join(out) + text[at:] and masked[1].n_chars == len(masked[1].text)
    assert masked[2].text is None and masked[3].text == "\ufeff<EMAIL>\ufeff"


def brute_classes(rows):
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = defaultdict(list)
    for k, (i, _) in zip(label, rows, strict=True):
        least[k].append(i)
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((i, f"{f:016x}", ids[k]) for (i, _), f, k in zip(rows, fps, label, strict=True)), key=str), len(least)


def test_fingerprint():
    words = ["a", "b", "c", "d"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(2)]
    assert simhash.fingerprint(" A b\tC d") == hashes[0] & hashes[1] and simhash.fingerprint(" \n") == 0


def test_simhash(docs, empty):
    want, n = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == want
    assert simhash.near_duplicates(empty).count() == 0
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) == n


@pytest.mark.parametrize("large", [130, 2])
def test_links_keep_everything_connected(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 30)
    values = sorted({int(s) ^ int(sum(1 << int(b) for b in set(rng.integers(0, 62, k)))) for s in seeds for k in (0, 1, 1, 2, 2, 3)})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    label = {v: v for v in values}
    for _ in range(8):
        for a in values:
            label[a] = min(label[b] for b in values if (a ^ b).bit_count() <= 2)
    assert {v: roots.get(v, v) for v in values} == label
