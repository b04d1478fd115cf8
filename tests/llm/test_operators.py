import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm import boosting, components, context_mixing, embedding_dedup, html_text, licenses, ngram_join, packing, pii, piece_codec, quality, substring_dedup

from . import brute

WORDS = "the of and river stone lamp orange quickly nine walks über ça naïve Ending, token x1 go. 漢字 été".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Plain texts, exact and near copies, shared passages, edge cases."""
    rng = random.Random(5)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    base = " ".join(f"w{rng.randint(0, 999)}" for _ in range(150))
    out += [base, base, base.replace(" ", "\n", 3)]
    for k in range(12):  # near copies: one word differs
        words = base.split()
        words[10 * k + 3] = f"changed{k}"
        out.append(" ".join(words))
    shared = " ".join(f"s{rng.randint(0, 99)}" for _ in range(45))
    out += [f"{prose(rng, 30)} {shared} {prose(rng, 20)}" for _ in range(5)]
    out += [None, "", " \n\t", "one", "one two", "ONE two", "a" * 350, "ab" * 260, "é" * 120, prose(rng, 9000)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    # names that operators use themselves must not clash
    return df.select("doc_id", "text", F.lit("x").alias("_id"), F.lit(1).alias("_text"), F.lit("y").alias("spans"), F.lit(2).alias("_row")).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def plain(texts):
    return [(i, t or "") for i, t in texts]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for _ in range(6):
            c = rng.normal(size=8)
            rows += [(label, (c + rng.normal(size=8) * s).tolist()) for s in (0, 0.02, 0.06, 0.1)]
    rows += [rows[0], rows[0], (0, [0.0] * 8), (0, None), (0, []), (0, [1.0, None] * 4), (0, [float("nan")] * 8), (0, [float("inf")] * 8), (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1e30] * 8), (1, [1e30] * 8)]
    rows = [(i, label, v) for i, (label, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("_v", F.lit(1)).repartition(3)
    links = []
    for i, a, v in rows:
        for j, b, w in rows[:i]:
            if a is None or a != b or not v or not w or len(v) != len(w):
                continue
            if any(x is None or not math.isfinite(x) for x in [*v, *w]) or not any(v) or not any(w):
                continue
            x, y = np.array(v) / max(map(abs, v)), np.array(w) / max(map(abs, w))
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((i, j))
    part = brute.components([r[0] for r in rows], links)
    want = {i: (sum(i in x for x in links), part[i], part[i] == i) for i, _, _ in rows}
    for block in (1024, 4):
        got = embedding_dedup.near_duplicates(df, block=block, n_codes=4)
        assert {r._id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60) if i % 7] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(25)] + [(200, k) for k in range(201, 260)] + [(5, 5), (None, 3)]
    table = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.connected(table).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # links meet over several rounds
    try:
        assert got == {r.node: r.component for r in components.connected(table).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    real = [(a, b) for a, b in links if a is not None]
    ids = {x for pair in real for x in pair}
    want = brute.components(ids, real)
    assert {i: got.get(i, i) for i in ids} == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = (np.array(x) for x in zip(*real, strict=True))
    node, root = components.forest(a, b)
    flat = dict(zip(node.tolist(), root.tolist(), strict=True))
    assert {i: flat.get(i, i) for i in ids} == want


@pytest.mark.parametrize(("crowd", "n"), [(48, 100), (2, 100), (3, 64)])
def test_substrings_against_all_windows(spark, docs, texts, crowd, n):
    want = brute.substrings([(i, t.encode()) for i, t in plain(texts)], n)
    got = substring_dedup.deduplicate(docs, n=n, crowd=crowd)
    rows = {r._id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got.collect()}
    assert rows == want


def test_substring_edges(spark, docs, none, texts):
    assert substring_dedup.deduplicate(none).count() == 0
    twice = docs.select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame([(None, "x" * 300)], "doc_id long, text string"))
    assert substring_dedup.deduplicate(twice).where("_id = 40 AND size(spans) > 0").count() == 0
    cleaned = substring_dedup.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    rows = {r.doc_id: r.text for r in cleaned.collect()}
    assert rows[41] == "" and rows[40] == dict(texts)[40] and rows[60 + 0] is None


def test_shared_passages_send_stretches(spark):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, f"{i:05d}" + "".join(rng.choice("ijkl") for _ in range(40)) + shared) for i in range(80)]
    docs = spark.createDataFrame(rows, "_id long, _text string").coalesce(1)
    crowded = substring_dedup._crowded(docs, 100, 3, 1 << 16, 1.0)
    assert len(crowded)
    spans = substring_dedup._blobs(docs, 100, crowded, 4).where("_blob IS NULL").select("_doc", "_low", "_high").collect()
    assert len(spans) < 2 * len(rows)
    assert {r._doc for r in spans} == set(range(1, 80))
    assert all(min(r._low for r in spans if r._doc == i) <= 45 and max(r._high for r in spans if r._doc == i) == 445 for i in range(1, 80))


def test_told_anchors_follow_the_input():
    rng = np.random.default_rng(6)
    told = []
    for chunk in range(40):
        records = np.zeros(3000, substring_dedup.RECORD)
        records["doc"], records["h"] = 1000 * chunk + np.sort(rng.integers(0, 500, 3000)), rng.integers(0, 1 << 60, 3000).astype(np.uint64)
        records["h"][:40] = 7
        h, times = substring_dedup._told(records, 48)
        assert times[h == 7] == 40
        told.append(len(h))
    assert 3000 / 32 < min(told) and max(told) < 3000 / 8


def test_stretches_cover_what_their_runs_cover():
    rng = np.random.default_rng(5)
    assert [len(x) for x in substring_dedup._stretches(np.zeros(0, substring_dedup.RECORD), 100)] == [0, 0, 0]
    for _ in range(30):
        gone = np.zeros(rng.integers(1, 60), substring_dedup.RECORD)
        gone["doc"], gone["low"], gone["len"] = rng.integers(-2, 3, len(gone)), rng.integers(0, 900, len(gone)), rng.integers(0, 50, len(gone))
        got = list(zip(*(x.tolist() for x in substring_dedup._stretches(gone, 20)), strict=True))
        covered = lambda spans: {(d, k) for d, a, b in spans for k in range(a, b)}
        assert covered(got) == covered((d, a, a + m + 20) for d, a, m in zip(*(gone[c].tolist() for c in ("doc", "low", "len")), strict=True))
        assert all(x[0] < y[0] or x[2] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_long_texts_go_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcd") for _ in range(3000))
    rows = [(0, text + text[500:1500]), (1, "zz" + text[700:900])]
    monkeypatch.setattr(substring_dedup, "CHUNK", 256)
    data = [(i, t.encode()) for i, t in rows]
    for _, raw in data:
        x = np.frombuffer(raw, np.uint8)
        whole = np.concatenate([r for r, _, _ in substring_dedup._pieces(x, np.zeros(1, int), np.array([len(x)]), np.array([7]), 100)])
        starts = sorted(s for r in whole for s in range(r["low"], r["low"] + r["len"] + 1))
        assert starts == list(range(len(raw) - 99)) if len(raw) >= 100 else not starts


def test_pii_base_against_patterns(spark):
    rng = random.Random(4)
    bits = ["a@b.co", "x.y_z%+@d-e.f.g", "a@b..c", "1.2.3.4", "256.1.1.1", "001.002.003.004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111--1111 1111", "4845168114407329", "+1 (017) 555-7713", "+49 30 1234567.", "+12", "a@b.c_x@d.e", "@", ".", " ", "\n", "é", "\x01", "\x02", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "+1(2)3-", "..", "99999999999999999999999", "漢"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "."]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts += [" ".join(f"u{k}@h{k}.org 10.0.{k % 256}.7" for k in range(9000)), "1 " * 20000, "a." * 20000 + "@b.c", "a@" + "b." * 20000 + "c", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1))
    chooser = pii.Chooser.fit(spark, n_train=400)
    for r in pii.find(df, chooser).collect():
        assert [tuple(s) for s in r.base] == brute.pii(texts[r._id] or ""), texts[r._id][:200]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_pii_choices(spark):
    rows = [(0, 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" now'), (1, "a perfectly-ordinary-hyphenated-compound word"), (2, "ssn 123-45-6789 and a@b.co"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r._id: [s.kind for s in r.spans] for r in pii.find(df).collect()}
    assert found == {0: ["secret"], 1: [], 2: ["ssn", "email"], 3: []}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean == {0: 'set token = "<SECRET>" now', 1: rows[1][1], 2: "ssn <SSN> and <EMAIL>", 3: None}
    assert pii.find(df.limit(0)).count() == 0
    held = pii.examples(400, seed=77)
    made = spark.createDataFrame([(i, e[0]) for i, e in enumerate(held)], "doc_id long, text string")
    got = {r._id: {(s.start, s.end, s.kind) for s in r.spans} for r in pii.find(made).collect()}
    right = sum(((e[1], e[2], pii.NAMED.get(e[3], e[3])) in got[i]) == bool(e[4]) for i, e in enumerate(held))
    assert right / len(held) > 0.85


def test_licenses(spark, docs, texts):
    rows = {r._id: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in plain(texts):
        want = brute.licenses(t)
        places = rows[i].places
        assert (rows[i].n_words, len(places)) == want[:2]
    cases = {
        "Released under the MIT License.": ["mit"],
        "Licensed under the Apache License, Version 2.0.": ["apache-2"],
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc"],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl-3"],
        "Copyright 2020 Some One. All rights reserved.": ["reserved"],
        "Licensed under the Apache Public License": [],
        "under the mit\nlicense UNDER THE MIT LICENSE": ["mit"],
        "the mitigated license": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        text = list(cases)[r._id]
        assert sorted({p.label for p in r.places} | {s.label for s in r.spans}) == cases[text], text
        assert 0 <= r.score <= 1
        want = brute.licenses(text)
        starts = [p.start for p in r.places]
        assert (min(starts, default=None), max(starts, default=None)) == want[2:4]
    whole = licenses.TEMPLATES["mit-text"][0].replace("<<optional>>including the next paragraph<</optional>> ", "").replace("<<var 1 12>>", "the authors or copyright holders")
    words = licenses.words_of(f"MIT License\n\nCopyright (c) 2020 A B\n\n{whole.upper()}.")
    assert {x[0] for x in licenses.scan(words, licenses.TEMPLATES)[0]} == {"mit", "mit-text"}
    changed = ["every" if w == "substantial" else w for w in words]
    found, score = licenses.scan(changed, {"mit-text": licenses.TEMPLATES["mit-text"]})
    assert not found and 0.9 < score < 1
    with pytest.raises(ValueError):
        licenses.compile_template("<<optional>>a<</optional>>")
    a = licenses.compile_template("a <<optional>>b <<var 1 2>><</optional>> c")
    assert a.run("a c".split(), 0)[0] == 2 and a.run("a b x c".split(), 0)[0] == 4 and a.run("a b c".split(), 0)[0] == -1 and a.run("a b x y c".split(), 0)[0] == 5


def test_packing_round_trip(docs, texts, none):
    encode = packing.encoder()
    by: dict = {}
    seqs = []
    for r in packing.pack(docs).collect():
        by.setdefault(r._id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.length, r.doc_tokens))
        seqs.append(r.sequence_id)
        assert r.length == 1024 or r.length & (r.length - 1) == 0 and r.offset == 0
    assert len(set(seqs)) == len(seqs)
    for i, t in plain(texts):
        ids = [x for p in sorted(by[i]) for x in p[1]]
        assert ids == [*encode(t), 0] and all(p[3] == len(ids) for p in by[i])
    assert packing.pack(none).count() == 0
    assert packing.binary_lengths(2048 + 5, 1024) == [1024, 1024, 4, 1]
    assert packing.encoder()("<|endoftext|>") == [50256]
    with pytest.raises(ValueError):
        packing.pack(docs, max_len=1000)


def test_pieces_against_the_library(docs, texts, none):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    odd = ["".join(rng.choice("abcdeéß漢字 \t\n.,()▁ theing0123😀") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["  a   b    ", "</s>", "\x00", " ", "x" * 500, "漢字" * 300]
    encoder, decoder = piece_codec.Encoder(most=50), piece_codec.Decoder()
    for text, ids in zip(odd, encoder(odd), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == model.encode(text), text
        assert decoder(ids) == model.decode(model.encode(text))
    rows = piece_codec.decode(piece_codec.encode(docs)).collect()
    assert {r._id: r.decoded for r in rows} == dict(plain(texts))
    assert piece_codec.decode(piece_codec.encode(none)).count() == 0
    codes = np.array([3, 1, 2, 1, 2, 1, 3])
    order = piece_codec.suffix_array(codes, 16)
    assert order.tolist() == sorted(range(7), key=lambda i: codes[i:].tolist())


def test_mixing(spark, docs, texts, none):
    got = {r._id: r for r in context_mixing.score_documents(docs.select("doc_id", "text")).collect()}
    words = {i: [*brute.re.findall(r"[^\x20\x09-\x0D]+", brute.lower(t)), None] for i, t in plain(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts: dict = {}
    for i, ws in words.items():
        for w in ws if not held[i] else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts.get(w, 0) > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    size = {i: len(t.encode()) for i, t in plain(texts)}
    bits = -sum(got[i].score for i in held if held[i]) * math.log2(10)
    assert bits < 5.0 * sum(size[i] for i in held if held[i])
    again = {r._id: r.score for r in context_mixing.score_documents(docs.select("doc_id", "text").repartition(7)).collect()}
    assert all(again[i] == pytest.approx(got[i].score, rel=1e-4) for i in again)
    assert context_mixing.score_documents(none.select("doc_id", "text")).count() == 0


def mixed_batch(texts, train=False, counts=None):
    """A batch by itself; counts: of words and of pairs, None for the end and the begin."""
    words, pairs = counts or ({}, {})
    n = len(texts)
    batch = context_mixing.Batch(context_mixing.tokenised(texts) | {"ids": np.arange(n), "valid": np.ones(n), "keys": np.arange(n), "train": np.full(n, train)})
    batch.asks(6)
    names = [*batch.words(), None, None]
    batch.c1 = np.array([words.get(w, 0) for w in names])
    batch.c2 = np.array([pairs.get((names[a], names[b]), 0) for a, b in zip(*batch.pairs, strict=True)])
    return batch


def plain_counts(texts):
    words, pairs = {}, {}
    for t in texts:
        row = [None, *brute.lower(t.decode()).encode().split(), None]
        for x, y in zip(row, row[1:], strict=False):
            words[y] = words.get(y, 0) + 1
            pairs[x, y] = pairs.get((x, y), 0) + 1
    return words, pairs


def test_mixing_is_a_distribution():
    """All texts share one unit of probability: no set of them has more."""
    rng = np.random.default_rng(0)
    code = context_mixing.Code(np.append(np.bincount(list(b"abcd" * 9), minlength=256), 20))
    corpus = [b"a b", b"a b", b"a c", b"b A"]
    n = sum(len(t.split()) + 1 for t in corpus)
    tables, letters = rng.integers(0, 9, (3, 2, context_mixing.KINDS * context_mixing.WIDTH)), rng.integers(0, 9, (3, 2, context_mixing.SLOTS))
    mixer = context_mixing.Mixer(code, n, tables.astype(np.float32), letters.astype(np.float32))
    every = [b"", *(bytes([x]) for x in range(256)), *(bytes([x, y]) for x in b"abA \n\t" for y in b"abA \n\t"), *(b"a " + bytes([x]) for x in range(256) if not bytes([x]).isspace())]
    p = 10.0 ** mixer.score(mixed_batch(every, counts=plain_counts(corpus)))
    assert 0.01 < p.sum() <= 1.0 + 1e-6 and (p > 0).all()
    alone = mixer.score(mixed_batch([b"some text here", b""]))
    assert alone[0] == pytest.approx(mixer.score(mixed_batch([b"x", b"some text here"]))[1], rel=1e-5)


def test_mixing_counts_words_and_pairs(spark):
    """Every training text's words and neighbours are counted, whatever the batches; what is known grows with the corpus."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyZ") for _ in range(rng.randrange(80))) for _ in range(60)] + [None, "  ", "É é"]
    df = spark.createDataFrame([(i, x or "", i % 7 != 2, i) for i, x in enumerate(texts)], "_id long, _text string, _train boolean, _key long").repartition(3)
    words, pairs = plain_counts([(x or "").encode() for i, x in enumerate(texts) if i % 7 != 2])
    counted = context_mixing._with_counts(context_mixing._blobs(df, 1000), 5)
    table = counted.select("_blob", "_answers").toArrow()
    seen = 0
    for batch in context_mixing._batches(table.to_batches(), 5, words[None]):
        names = [*batch.words(), None, None]
        assert batch.c1.tolist() == [words.get(w, 0) for w in names]
        assert batch.c2.tolist() == [pairs.get((names[a], names[b]), 0) for a, b in zip(*batch.pairs, strict=True)]
        seen += len(batch.sizes)
    assert seen == len(texts)
    assert counted.agg(F.sum("_v")).first()[0] == len(words) - 1


def test_mixing_learns_within_a_short_text():
    """A text of under a kilobyte that repeats itself gets cheaper, and a counted text is scored as if it were not."""
    rng = random.Random(9)
    unit = b" ".join(bytes(rng.randrange(97, 123) for _ in range(6)) for _ in range(20)) + b" "
    code = context_mixing.Code(np.append(np.bincount(list(unit), minlength=256), 20))
    bits = lambda text: -context_mixing.Mixer(code, 0).score(mixed_batch([text]))[0]
    assert bits(unit * 6) < 1.5 * bits(unit)
    texts = [b"One two three. One two", b"two three four", b"two three five"]
    counts, others = plain_counts(texts), plain_counts(texts[1:])
    n = sum(counts[0].values())
    own = context_mixing.Mixer(code, n).score(mixed_batch(texts[:1], True, counts))[0]
    assert own == pytest.approx(context_mixing.Mixer(code, sum(others[0].values())).score(mixed_batch(texts[:1], False, others))[0], rel=1e-5)
    # spelled words of a training text are taken out of what the spelling has learnt
    batch = mixed_batch([b"zzyzx"], True, plain_counts([b"zzyzx"]))
    mixer = context_mixing.Mixer(code, 2)
    before = mixer.score(batch)[0]
    mixer.tables, mixer.letters = mixer.counts(batch)
    mixer.tables[:] = 0
    assert mixer.letters.sum() > 0 and mixer.score(batch)[0] == pytest.approx(before, rel=1e-5)
    place, owner, bit = np.array([1, 0, 1, 1, 1]), np.array([0, 0, 0, 1, 0]), np.array([1, 0, 1, 0, 0])
    known = np.array([[1, 5], [0, 7]], dtype=np.float32)
    want = [(5, 7), (1, 0), (5, 8), (5, 7), (5, 9)]
    assert context_mixing.online_odds(place, owner, bit, known, False).tolist() == pytest.approx([math.log((b + 0.4) / (a + 0.4)) for a, b in want], rel=1e-5)


def test_mixing_refines_the_spelling_and_the_mixed_odds():
    """New words get cheaper as a text spells on; a map corrects odds whose weights cannot learn."""
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(120)})
    rng.shuffle(words)
    code = context_mixing.Code(np.zeros(257, dtype=np.int64))
    cost = lambda n: -context_mixing.Mixer(code, 0).score(mixed_batch([b" ".join(words[:n])]))[0] / n
    assert cost(100) < 0.7 * cost(4)
    n, zero = 60, np.zeros(60, dtype=np.int64)
    flat = [np.zeros(n, dtype=np.float32)] * 3
    right = context_mixing.mixed(flat, zero, np.ones(n, dtype=np.uint8), zero, 1, list(range(n + 1)), 1, 1, 1.0)[0]
    assert right > 0.9 * n * math.log(0.5)


def test_mixing_learns_the_spelling_of_every_training_word_once(spark):
    """Words of several training texts teach it as well, whatever the batches; those of other texts alone do not."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") + rng.choice("XY") for _ in range(rng.randrange(60))) for _ in range(40)]
    rows = [(x, True, i) for i, x in enumerate(texts)] * 2 + [("unseen " + x, False, i) for i, x in enumerate(texts)] + [("alone", True, 99)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_id long, _text string, _train boolean, _key long").repartition(3)
    blobs = context_mixing.cut(context_mixing._blobs(df, 400))
    code = context_mixing.Code(context_mixing._histograms(blobs))
    mixer = context_mixing.Mixer(code, sum(len(x.split()) + 1 for x, train, _ in rows if train))
    letters = context_mixing._tables(context_mixing._with_counts(blobs, 5), mixer, 5, sum(train for _, train, _ in rows))[1]
    words = sorted({w for x, train, _ in rows if train for w in x.lower().encode().split()})
    _, slots, bit, _ = context_mixing._spelling(words, code)
    want = [np.bincount(s << 1 | bit, minlength=2 * context_mixing.SLOTS).reshape(-1, 2).T for s in slots]
    assert blobs.count() > 3 and (letters == np.stack(want)).all()


def test_mixing_refines_the_spelling_after_each_word():
    texts = [b" ".join(b"w%d" % k for k in range(n)) for n in (50, 3)]
    batch, code = mixed_batch(texts), context_mixing.Code(np.zeros(257, dtype=np.int64))
    owner, _, _, _, cuts = context_mixing.spelled(batch, context_mixing.Decisions(batch, 0), code)
    assert len(cuts) == 51 and [len(set(owner[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)] == [2] * 3 + [1] * 47


def test_jaccard_against_all_pairs(docs, texts, none):
    want = brute.jaccard_components(plain(texts))
    for options in ({}, {"small": 2, "block": 4}):
        got = ngram_join.ngram_join(docs, **options)
        assert {r._id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert ngram_join.ngram_join(none).count() == 0
    kept = ngram_join.keep_one_of_each(docs.select("doc_id", "text"))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_tasks_of_the_join_are_bounded(spark):
    """What the driver keeps account of: a shuffle of many partitions must not meet every small table of ids."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    base = words(60)
    rows = [(i, " ".join(base if i % 3 == 0 else [*base[: 59 - i % 5], *words(2)] if i % 3 == 1 else words(60))) for i in range(90)]
    df, sc = spark.createDataFrame(rows, "doc_id long, text string"), spark.sparkContext
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    sc.setJobGroup("tasks-of-the-join", "")
    try:
        got = {r._id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, small=2).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute.jaccard_components(rows)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("tasks-of-the-join") for s in told.getJobInfo(j).stageIds}
    assert sum(x.numCompletedTasks for s in stages if (x := told.getStageInfo(s))) < 64 * 60


def test_components_put_links_together_in_bounds(monkeypatch):
    rng = random.Random(3)
    links = [(rng.randrange(1, 300), rng.randrange(0, 300)) for _ in range(2000)]
    want = brute.components({x for pair in links for x in pair}, links)
    for most in (16, 100, 1 << 20):
        monkeypatch.setattr(components, "MOST_LINKS", most)
        batches = [pa.RecordBatch.from_pydict({"u": [a for a, _ in links[k : k + 10]], "v": [b for _, b in links[k : k + 10]]}) for k in range(0, len(links), 10)]
        parts = list(components._together(batches))
        assert all(len(a) <= 2 * most for a, _ in parts) or most == 16
        again = [p for a, b in parts for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert {k: v for k, v in brute.components(set(want), again).items()} == want


def test_sketches_never_overstate():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 60, 50).astype(np.uint64)]))
        x, y = ngram_join.sketch(a), ngram_join.sketch(b)
        w = min(len(x), len(y)) // 8
        apart = int(np.bitwise_count(ngram_join.fold(x, w) ^ ngram_join.fold(y, w)).sum())
        assert apart <= len(np.setxor1d(a, b))


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_html(spark):
    cases = [
        ("http://a.com/x/1", page("<nav><ul><li>Menu</li></ul></nav><div class=\"ad\">Buy</div><article><h1>Head &amp; all</h1><p><b>One  two\n three.<br><p>Four&nbsp;five</p><form>Name <input></form><aside>See</aside><div class='comments'><p>I agree</p></div></article><footer>&copy; x</footer>"), "Head & all\nOne two three.\nFour five"),
        ("http://a.com/x/2", page("<article><p>cut <b>short"), "cut short"),
        ("http://b.com/y/1", page("<p>Site of b</p><p>First story here</p><p>Imprint of b</p>"), "First story here"),
        ("http://b.com/y/2", page("<p>Site of b</p><p>Second story here</p><p>Imprint of b</p>"), "Second story here"),
        ("http://c.com/", page("<main><p>only</p></main><p>outside</p>"), "only"),
        ("http://a.com/x/1#again", page("<article><p>copy</p></article>"), "copy"),
        ("http://a.com/x/1?q", page("<article><p>copy</p></article>"), "copy"),
        (None, None, ""),
        ("nonsense", "plain &lt;text&gt; <i>in</i>line", "plain <text> inline"),
        ("http://d.com/1", "", ""),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(cases)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert {r._id: r.text for r in html_text.extract(df).collect()} == {i: c[2] for i, c in enumerate(cases)}
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_marks():
    def best(body):
        lines = html_text.lines_of(body)
        return [t for w, t in lines if w and w == max(w for w, _ in lines)]

    assert best('<html class="no-nav"><body class="has-sidebar"><p>text</p><div class="sidebar"><p>side</p></div></body></html>') == ["text"]
    assert best('<body><article class="post has-comments"><p>text</p><div class="comments-area">c</div></article></body>') == ["text"]
    assert best('<article id="related-work"><p>text</p></article>') == ["text"]
    assert best('<main class="nav"><p>text</p></main>') == ["text"]
    assert best('<div class="sidebar-left"><article><p>text</p><aside>a</aside></article></div>') == ["text"]
    assert best('<article><p>text</p></article><div class="comments"><article class="comment"><p>no</p></article><article><p>no</p></article></div>') == ["text"]
    assert best('<p>text</p><div class="ad-slot">no</div><div class="site-footer">no</div><div class="with-banner">too</div><div hidden>no</div><div class="x" role="banner">no</div>') == ["text", "too"]


def test_html_copies_and_slices(spark):
    """Copies do not delete each other, neighbours meet across slices, and shared lines go from marked regions too."""
    cases = [
        *[(f"http://e.com/{k}", page(f"<p>Site of e</p><p>Story {k // 2} here</p><p>Imprint of e</p>"), f"Story {k // 2} here") for k in range(40)],
        ("http://f.com/a", page("<p>Top</p><p>Twice the same</p>"), "Twice the same"),
        ("http://f.com/a?b", page("<p>Top</p><p>Twice the same</p>"), "Twice the same"),
        ("http://f.com/c", page("<p>Top</p><p>Another</p>"), "Another"),
        ("http://g.com/a", page("<article><p>Share this</p><p>First</p></article>"), "First"),
        ("http://g.com/b", page("<article><p>Share this</p><p>Second</p></article>"), "Second"),
        ("http://g.com/c", page("<div><article><p>Share this</p><p>Second</p></article><p>More</p></div>"), "Share this\nSecond"),
        ("http://h.com/a", page("<p>alone</p>"), "alone"),
        ("http://h.com/b", page("<p>alone</p>"), "alone"),
    ]
    rows = [(i, u, h) for i, (u, h, _) in enumerate(cases)]
    want = {i: c[2] for i, c in enumerate(cases)}
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for width, adaptive in (("1", "true"), ("61", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
            got = html_text.extract(df).collect()
            assert len(got) == len(rows) + 1 and {r._id: r.text for r in got} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_longest_common_subsequence(monkeypatch):
    rng = random.Random(3)
    many = [rng.randrange(9) for _ in range(700)], [rng.randrange(9) for _ in range(600)]
    whole = sum(html_text.common(*many))
    monkeypatch.setattr(html_text, "MOST_BITS", 40)  # in parts
    assert sum(html_text.common(*many)) == whole
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = [x for x, k in zip(a, html_text.common(a, b), strict=True) if k]
        it = iter(b)
        assert len(got) == table[-1][-1] and all(x in it for x in got)


def test_quality(spark, docs, texts, none):
    for r in quality.statistics(docs).collect():
        t = dict(plain(texts))[r._id]
        assert tuple(r[1:6]) == brute.quality(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["kite", "moss", "fern", "dune"]) + str(rng.randint(0, 99)) + ("***" if i % 3 == 0 else "") for _ in range(80)), int(i % 3 != 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("_y", F.lit(0))
    labels = df.where("doc_id < 200").select("doc_id", "quality").union(spark.createDataFrame([(1, None), (None, 1), (9999, 1)], "doc_id long, quality int"))
    rules = quality.QualityRules.fit(df.select("doc_id", "text"), labels)
    got = {r._id: r.kept for r in quality.statistics(df, rules).collect()}
    assert all(got[i] == bool(y) for i, _, y in rows)
    assert {r.doc_id for r in quality.filter_documents(df, rules).collect()} == {i for i, k in got.items() if k}
    assert quality.statistics(none, rules).count() == 0
    assert quality.QualityRules.fit(df.select("doc_id", "text"), labels.limit(0)).threshold == 0.0


def test_capitals_are_one_feature_at_all_lengths():
    at = list(quality.FEATURES).index("upper_share")
    for n in (1, 63, 64, 500):
        text = " ".join(["ÉÀa", "Zß漢"] * n)[: 4 * n - 1]  # n words
        assert quality.features(text, (n, len(text), 0, 0, 0, text.encode().split()))[at] == pytest.approx(sum(map(str.isupper, text)) / len(text))


def test_forest_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] + 0.3 * np.sin(5 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(size=800) * 0.5 > 0.5).astype(float)
    forest = boosting.fit(x, y, monotone=[1, 0, -1])
    grid = np.linspace(-3, 3, 200)
    for row in x[:20]:
        up, down = np.tile(row, (200, 1)), np.tile(row, (200, 1))
        up[:, 0], down[:, 2] = grid, grid
        assert (np.diff(forest.raw(up)) >= -1e-12).all() and (np.diff(forest.raw(down)) <= 1e-12).all()
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.85
    assert boosting.fit(x[:5], np.ones(5)).raw(x).tolist() == [4.0] * 800
