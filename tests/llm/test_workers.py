"""Operators run where the workers cannot import the package: their functions travel whole."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from restartlab.session import build_session
spark = build_session(2, "workers")
spark.sparkContext.setLogLevel("ERROR")
from restartlab.llm import ctw, decontaminate, fim, fingerprint, htmltext, language, near_dup, pieces, prefix_trie, warc
from restartlab.llm.queries import TOKENIZER
from pyspark.sql import functions as F
docs = spark.createDataFrame([(1, "a short text of seven plain words", "en"), (2, "ein kurzer Text", "de")], "doc_id bigint, text string, lang string")
pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text")
coded = pieces.encode(docs, TOKENIZER)
print("ROWS", [d.count() for d in (
    coded, pieces.decode(coded, TOKENIZER), htmltext.extract(pages), fingerprint.with_edits(docs), ctw.scores(docs, F.lit(True)), near_dup.near_duplicates(docs),
    language.identify(docs), fim.transform(docs), prefix_trie.prefix_trie(turns), warc.archive_and_index(pages),
    decontaminate.overlaps(docs, docs.select(F.col("doc_id").alias("item_id"), "text")))])
"""


def test_no_package_on_the_workers(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "ROWS [2, 2, 2, 2, 2, 2, 2, 2, 3, 2, 2]" in ran.stdout, ran.stdout[-500:] + ran.stderr[-3000:]
