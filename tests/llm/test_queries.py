"""The contract queries themselves: names, types and digests against plain versions, on a small table set."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import __spark_entry__
from loomframe.llm.queries import QUERIES, SQL

from . import brute

LONG, TEXT, FLAG, REAL = "bigint", "string", "boolean", "double"
COLUMNS = {
    "op1_embedding_pq": {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": FLAG},
    "op2_suffix_dedup": {"doc_id": LONG, "n_bytes": LONG, "n_removed": LONG, "n_spans": LONG, "kept_sha256": TEXT},
    "op3_pii_boosted": {"doc_id": LONG, "n_email": LONG, "n_ip": LONG, "n_card": LONG, "n_phone": LONG, "base_sha256": TEXT, "spans": TEXT},
    "op4_license_scan": {"doc_id": LONG, "n_words": LONG, "n_base": LONG, "first_word": LONG, "last_word": LONG, "base_labels": TEXT, "labels": TEXT, "score": REAL},
    "op5_binary_packing": {"doc_id": LONG, "start": LONG, "length": LONG, "ids_crc32": LONG, "doc_tokens": LONG, "sequence_id": LONG, "offset": LONG},
    "op6_sentencepiece": {"doc_id": LONG},
    "op7_context_mixing": {"doc_id": LONG, "held_out": FLAG, "n_tokens": LONG, "n_known": LONG, "train_tokens": LONG, "base_score": REAL, "score": REAL},
    "op8_ngram_jaccard": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG},
    "op9_html_diff": {"page_id": LONG, "url": TEXT, "text": TEXT, "n_chars": LONG},
    "op10_quality_trees": {"doc_id": LONG, "n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG, "base_failed": FLAG, "kept": FLAG},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    texts = [some(rng.randint(1, 200)) for _ in range(40)]
    texts += [texts[3], texts[4] + " end", None, "", "one two", f"{some(5)} mail a.b@c.de 10.0.0.1 +1 (017) 555-7713 4111 1111 1111 1111", "Under the MIT License, CC BY-NC", "a b c\na b c\na b c # | x", "<|endoftext|> naïve 漢字\r\n\ttabs", some(3000)]
    docs = [(i, t) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    write([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(i, i % 2, 0) for i, _ in docs], "doc_id long, quality int, toxic int", "labels")
    vectors = np.random.default_rng(1).normal(size=(30, 8))
    write([(i, [float(x) for x in vectors[i % 20]], i % 3) for i in range(30)], "vec_id long, embedding array<float>, label int", "embeddings")
    write([(i, f"http://h.com/{i}", f"<body><nav>Menu</nav><p>Story {i} here</p><p>Imprint</p></body>") for i in range(9)], "page_id long, url string, html string", "pages")
    return path, [(i, t or "") for i, t in docs]


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name: QUERIES[name](spark, tables[0]) for name in COLUMNS}


def test_registered():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(COLUMNS) | {"pipeline"} <= set(queries) and set(SQL) <= set(sql) and set(SQL) <= set(queries)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(results, name):
    types = dict(results[name].dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]


def rows(results, name, key="doc_id"):
    found = results[name].collect()
    return {r[key]: r for r in found}


def test_texts(results, tables):
    docs = tables[1]
    cut = rows(results, "op2_suffix_dedup")
    assert {i: tuple(cut[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in cut} == brute.substrings([(i, t.encode()) for i, t in docs])
    found = rows(results, "op3_pii_boosted")
    for i, t in docs:
        spans = brute.pii(t)
        assert found[i].base_sha256 == brute.pii_digest(t)
        assert [found[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{s}:{e}" for s, _, e, k in spans} <= set(found[i].spans.split(","))
    licenses = rows(results, "op4_license_scan")
    for i, t in docs:
        r = licenses[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(t)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and r.labels.split(",") == sorted(set(r.labels.split(","))) and 0 <= r.score <= 1
    near = rows(results, "op8_ngram_jaccard")
    assert {i: (r.n_shingles, r.component_id) for i, r in near.items()} == brute.jaccard_components(docs)
    quality = rows(results, "op10_quality_trees")
    for i, t in docs:
        r = quality[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    scored = rows(results, "op7_context_mixing")
    assert {i: r.held_out for i, r in scored.items()} == {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}


def test_pieces_against_the_tokenizer(results, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces: dict = {}
    filled: dict = {}
    for r in results["op5_binary_packing"].collect():
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in tables[1]:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_vectors_and_pages(results):
    vectors = rows(results, "op1_embedding_pq", "vec_id")
    # a vector and its copy share a label only where their numbers are equal modulo three
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in vectors.items()} == {i: (0, i, True) for i in range(30)}
    pages = rows(results, "op9_html_diff", "page_id")
    assert {i: (r.text, r.n_chars) for i, r in pages.items()} == {i: (f"Story {i} here", 12) for i in range(9)}


def test_round_trip(results, tables):
    assert all(r.round_trip for r in results["op6_sentencepiece"].collect())
    assert hashlib.sha256(b"").hexdigest() == rows(results, "op2_suffix_dedup")[42].kept_sha256
