"""Null ids, repeated rows, null and very long texts, empty tables and clashing names, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomframe.llm import context_mixing, html_text, licenses, ngram_join, packing, pii, piece_codec, quality, substring_dedup

rng = random.Random(31)
LONG = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(30_000))
ROWS = [(None, "one text here"), (1, "again and again"), (1, "again and again"), (2, None), (3, LONG), (4, LONG + " more"), (5, "")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.select("doc_id", "text", *(F.lit(7).alias(c) for c in ("_id", "_text", "_n", "_rep", "base", "spans", "ids", "score", "kept", "_batch", "features", "_kept")))


FITTED = {
    "pii": lambda df: pii.find(df, CHOOSER[0]),
    "licenses": licenses.scan_licenses,
    "pieces": piece_codec.encode,
    "mixing": context_mixing.score_documents,
    "quality": quality.statistics,
}
CHOOSER: list = []


@pytest.mark.parametrize("name", FITTED)
def test_every_row_has_a_result(spark, docs, name):
    if not CHOOSER:
        CHOOSER.append(pii.Chooser.fit(spark, n_train=300))
    made = FITTED[name](docs).collect()
    assert sorted((r._id is None, r._id or 0) for r in made) == sorted((i is None, i or 0) for i, _ in ROWS)
    same = [tuple(r) for r in made if r._id == 1]
    assert same[0] == same[1]
    assert FITTED[name](docs.limit(0)).count() == 0


def test_packing_of_every_row(docs):
    made = packing.pack(docs).collect()
    ends = {}
    for r in made:
        ends[r._id] = ends.get(r._id, 0) + r.length
    assert ends[2] == ends[5] == 1 and ends[3] > 30_000 and sum(r.start == 0 for r in made) == len(ROWS)


def test_pairs_and_passages(docs):
    near = {r._id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 2, 3, 5]
    assert ngram_join.keep_one_of_each(docs.limit(0)).count() == 0
    cut = {r._id: len(r.kept) for r in substring_dedup.deduplicate(docs).collect()}
    assert cut == {1: 15, 2: 0, 3: len(LONG), 4: 0 if len(" more") + 99 < 100 else cut[4], 5: 0} and cut[4] <= 104


def test_pages(spark):
    page = "<body><p>" + "</p><p>".join(LONG.split()[:3000]) + "</p></body>"
    rows = [(None, "http://a.b/c", page), (1, None, None), (1, None, None), (2, "http://a.b/d", page + "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_html", F.lit(1)).withColumn("_host", F.lit(2))
    made = {(r._id, r._url): r.text for r in html_text.extract(df).collect()}
    assert html_text.extract(df).count() == 4 and made[1, None] == "" and html_text.extract(df.limit(0)).count() == 0


def test_stages(spark, docs, tmp_path):
    whole = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(3, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (whole, whole.limit(0)):
        now, before = given, given.count()
        for name, stage in corpus_pipeline.STAGES:
            then = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert then.columns == given.columns and dict(then.dtypes) == dict(given.dtypes)
                assert then.count() <= before
                now, before = then, then.count()
            else:
                assert (then.count() > 0) == (before > 0)
