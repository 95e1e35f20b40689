"""Archives against a plain reader of their bytes, the merge against sorting, results against brute force."""

import glob
import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from restartlab.llm import warc
from restartlab.session import scratch_path

SCHEMA = "page_id bigint, url string, html string, payload_digest string, place bigint, file string"
BIG = 9_007_199_254_740_993  # no double holds it


def pages():
    rng = random.Random(4)
    long = "é" * 600  # 1,200 bytes, 600 code points
    odd = ["", None, "x" * 999, "x" * 1000, long, "\r\n\r\n", "ends\r\n", "ends\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40, "\x00\t<p>", "y" * 200_000]
    urls = ["http://www.Example.com:80/a?q=1#top", "https://b.example.com", None, "", "no scheme/with blank 😀 and\r\nbreak", "http://example.com/a?q=1", "https://ünï.example.org/ß"]
    rows = [(i, rng.choice(urls), rng.choice(odd)) for i in range(120)]
    rows += [(200 + i, "http://hot.example.com/page", rng.choice([long, "z" * 1500])) for i in range(60)]
    rows += [(BIG + i, urls[0], "w" * 2000) for i in range(3)] + [(None, urls[1], "w" * 2000), (None, urls[1], None), (None, urls[0], "only " * 300), (None, None, "only " * 300)]
    rows += [(7, urls[0], long), (7, urls[5], long), (-3, urls[0], long)] + [(BIG + 2, urls[0], "w" * 2000)] * 2
    rng.shuffle(rows)
    return rows


def brute(rows):
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        top = best.get(html or "")
        revisit = len(data) >= 1000 and top is not None and (i is None or i < top)
        out.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", str(top) if revisit else "None"))
    return sorted(out)


def plain_records(folder):
    """Records of all files by their stated lengths, the way any reader of the format does it."""
    for path in glob.glob(folder + "/part-*"):
        data = open(path, "rb").read()
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = data[at:end].decode()
            assert head.startswith("WARC/1.1\r\n")
            fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
            size = int(fields["Content-Length"])
            yield fields, data[end + 4:end + 4 + size]
            at = end + 4 + size
            assert data[at:at + 4] == b"\r\n\r\n"
            at += 4


def test_archives_are_plain_warc_and_read_back(spark):
    rows = pages()
    folder = scratch_path(spark, "archive").replace("file:", "")
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    archive = warc.write(*warc.captures(docs), folder)
    found, infos = [], 0
    for fields, block in plain_records(folder):
        if fields["WARC-Type"] == "warcinfo":
            infos += 1
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head).group(1))
        kind = fields["WARC-Type"]
        assert len(payload) == (size if kind == "response" else 0)
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        assert kind == "revisit" or hashlib.sha1(payload).hexdigest() == digest
        name = lambda f: re.fullmatch(r"<urn:page:(-?\d*)>", fields[f]).group(1) or "None"
        found.append((name("WARC-Record-ID"), size, digest, kind, name("WARC-Refers-To") if kind == "revisit" else "None"))
    assert infos == 1 and sorted(found) == brute(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # records lie across the borders of splits
    try:
        back = warc.read(spark, folder, archive).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in back) == brute(rows)
    assert all(r.intact for r in back if r.record_type == "response") and {r.intact for r in back if r.record_type == "revisit"} == {None}
    assert sorted(hashlib.sha1(r.payload.encode()).hexdigest() for r in back if r.payload is not None) == sorted(f[2] for f in found if f[3] == "response")


@pytest.mark.parametrize("range_rows", [7, 100_000])
def test_merged_index_is_in_global_order(spark, range_rows):
    rows = pages()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(6)
    index = sorted(warc.archive_and_index(docs, range_rows=range_rows).collect(), key=lambda r: r.place)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in index) == brute(rows)
    assert [r.place for r in index] == list(range(len(rows)))
    order = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in index]
    assert order == sorted(order)
    seen = {}
    for r in index:
        seen[r.url_key] = seen.get(r.url_key, 0) + 1
        assert r.capture == seen[r.url_key]
    if range_rows == 7:
        assert len({r.part for r in index if r.url_key == "com,example,hot)/page"}) > 3  # a hot URL is cut too
    keys = {r.url: r.url_key for r in index}
    assert keys["http://www.Example.com:80/a?q=1#top"] == keys["http://example.com/a?q=1"] == "com,example)/a?q=1"
    assert keys["https://b.example.com"] == "com,example,b)/" and keys[None] == ")/"
    assert "no%20scheme/with%20blank%20😀%20and%0D%0Abreak" in keys


def test_loser_tree_equals_sorting():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(20), i, j) for j in range(rng.choice([0, 1, 9, 30]))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


def test_empty_table_and_capture_times(spark):
    assert warc.archive_and_index(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(2, "http://a.b/", "one", 50), (1, "http://a.b/", "two", 60), (3, "http://a.b/", "three", None)], "page_id bigint, url string, html string, captured_at bigint")
    index = warc.archive_and_index(docs).orderBy("place").select("page_id", "capture").collect()
    assert [tuple(r) for r in index] == [(2, 1), (1, 2), (3, 3)]
