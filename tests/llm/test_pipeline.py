import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(90))
        if i % 5 == 0:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text, int(i % 5 != 0)))
    shared = " ".join(word() for _ in range(55))
    rows.append((60, rows[1][1] + " end", 1))  # near copy of 1
    rows.append((61, " ".join(word() for _ in range(60)) + " " + shared, 1))
    rows.append((62, shared + " " + " ".join(word() for _ in range(60)) + " write to me@example.com today", 1))
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, shared


def test_stages(spark, corpus):
    path, rows, shared = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        done[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    good = {i for i, _, y in rows if y}
    assert set(done["quality_rules"]) == good
    assert set(done["near_duplicates"]) == good - {60}
    third = done["repeated_passages"]
    assert set(third) == good - {60}
    assert shared in third[61].text and shared not in third[62].text
    assert third[62].n_chars == len(third[62].text)
    assert "<EMAIL>" in done["personal_data"][62].text and "me@example.com" not in done["personal_data"][62].text
    assert done["personal_data"][2].text == dict((i, t) for i, t, _ in rows)[2]


def test_run(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.select("doc_id").distinct().count() == len({i for i, _, y in corpus[1] if y}) - 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "personal_data", "packing"]
