"""Every text operator and the pipeline on awkward rows: null and repeated ids, null, empty and very long texts, clashing columns, no rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from restartlab.llm import ctw, decontaminate, fim, fingerprint, htmltext, language, near_dup, pieces, pseudonyms, sharding, toxicity, warc
from restartlab.llm.queries import KEY, TOKENIZER

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, region string, block bigint, train boolean, "
          "bucket int, family bigint, shard int, form string, n bigint, component_id bigint, blocks bigint, key bigint, seed bigint, turn bigint, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = ["river", "stone", "haus", "maison", "walk", "über", "naïve", "seven", "idiot", "card"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(50_000)  # some 300,000 characters
    rows = [(i, text(40), "en" if i % 2 else "de") for i in range(12)]
    rows += [(20, long, "en"), (20, long, "en"), (21, "x" * 200_000, None), (3, text(30), "fr"), (3, None, "en"), (None, text(25), "en"), (None, None, None), (None, "", "de"), (30, "", "en"), (31, "  \n ", "xx")]
    rows += [rows[1], rows[1]]
    more = ("s", 1, 0.5, False, "r", 7, True, 3, 5, 2, "plain", 9, 8, 4, 6, 11, 13, 1)
    return spark.createDataFrame([(*r, *more) for r in rows], SCHEMA)


def same_ids(out, docs, name="doc_id"):
    ids = lambda df, c: sorted((r[0] is None, r[0] or 0) for r in df.select(c).collect())
    return ids(out, name) == ids(docs, "doc_id")


RUNS = {
    "op1": lambda d: pieces.encode(d, TOKENIZER), "op2": lambda d: htmltext.extract(d.withColumns({"page_id": F.col("doc_id"), "url": F.lit("u"), "html": F.concat(F.lit("<p>"), "text")})),
    "op3": lambda d: pseudonyms.values_of(d, KEY), "op4": fingerprint.with_edits, "op5": lambda d: ctw.scores(d, F.col("doc_id") % 2 == 0), "op6": lambda d: sharding.shards_of(d, shards=4),
    "op8": language.identify, "op9": near_dup.near_duplicates, "op13": fim.transform,
    "op10": lambda d: toxicity.scores(d, toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))),
    "op11": lambda d: warc.archive_and_index(d.withColumns({"page_id": F.col("doc_id"), "url": F.col("source"), "html": F.col("text")})),
}


@pytest.mark.parametrize("name", RUNS)
def test_awkward_rows_and_no_rows(spark, docs, name):
    column = "page_id" if name in ("op2", "op11") else "doc_id"
    assert same_ids(RUNS[name](docs), docs, column)  # a row in, a row out
    assert RUNS[name](docs.where("false")).count() == 0


def test_overlaps_of_awkward_rows(spark, docs):
    bench = docs.where("doc_id = 3 or doc_id is null").select(F.col("doc_id").alias("item_id"), "text", "lang")
    found = decontaminate.overlaps(docs, bench)
    assert {r.doc_id for r in found.collect()} >= {3} and decontaminate.without_benchmark(docs, bench).where("doc_id is null").count() == 3
    assert decontaminate.overlaps(docs.where("false"), bench).count() == 0


def test_stages_on_awkward_rows_and_no_rows(spark, docs):
    sf = "/root/testdata/sf0.001"
    own = spark.read.parquet(f"{sf}/documents.parquet").columns
    for rows in (docs.select(own), docs.select(own).where("false")):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf)
            rows = rows.cache()
            count = rows.count()
            if name != "sentencepiece":
                assert rows.columns == own
        assert rows.where("not lossless").count() == 0 and count <= docs.count()
