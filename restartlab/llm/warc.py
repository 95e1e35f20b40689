"""WARC archives of captures, and their index as sorted runs merged by a loser tree.

Archives are written and read by Spark's text source, so they live wherever the
cluster's files live and follow its commit protocol. Each archive file becomes a
locally sorted run of index rows; ranges of the URL key are then merged k ways.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from restartlab.llm.common import bit_filter, set_in, split_join, stored
from restartlab.session import scratch_path

BREAK = "\r\n"
FIRST_CAPTURE = 1_704_067_200  # 2024-01-01, where a table has no capture times
FIELDS = ["url_key", "captured_at", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "file"]
# ids are text inside tasks: a column with nulls would pass through floating point
RUN = ("url_key string, captured_at bigint, page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, "
       "intact boolean, file string, run int, seq bigint")
SAMPLES = 20_000  # keys that the driver sees to choose the ranges, beside one per run


def url_key(url: Column) -> Column:
    """Sort key of a URL: host reversed by labels, lower case, without scheme, leading www, default port and fragment; then path and query."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[^/?]*", 0)), r"^www\d*\.|:(80|443)$", "")
    rest = F.regexp_replace(plain, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


def captures(pages: DataFrame, least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Rows to archive as responses (with payload) and as revisits (without), from rows page_id, url, html and, if any, captured_at.

    Of equal payloads of at least ``least`` bytes the one with the largest
    page_id is the response. Payloads are digested where they are read and not
    shuffled, but for rows that a bit filter takes for revisits.
    """
    at = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col("page_id").cast("bigint"), F.lit(0)), F.lit(1_000_000_000))
    if "captured_at" in pages.columns:
        at = F.coalesce(F.col("captured_at").cast("bigint"), at)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", at.alias("captured_at"), F.octet_length(html).cast("bigint").alias("payload_bytes"),
                        F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"), html.alias("payload"))
    keys = stored(rows.drop("payload"), "payloads")
    same = ["payload_digest", "payload_bytes"]
    groups = (keys.where(F.col("payload_bytes") >= least).groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows"))
              .where("rows > 1 and refers_to is not null"))
    revisits = split_join(keys, stored(groups, "copies"), same, "rows").where("page_id is null or page_id < refers_to")
    revisits = stored(revisits, "revisits")
    what = F.xxhash64("payload_digest", "page_id")
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(revisits.select(what.alias("hash"))))

    @F.pandas_udf("boolean")
    def perhaps(hashes: pd.Series) -> pd.Series:
        return pd.Series(set_in(bits.value, hashes.to_numpy("int64").view("uint64")) == 1)

    marked = rows.withColumn("perhaps", perhaps(what))
    gone = revisits.select(F.col("payload_digest").alias("d"), F.col("page_id").alias("i")).distinct()
    doubtful = marked.where("perhaps").join(gone, F.expr("payload_digest <=> d and page_id <=> i"), "left_anti")
    return marked.where("not perhaps").unionByName(doubtful).drop("perhaps"), revisits


def _record(kind: str, archive: str) -> Column:
    """Text of one record but for its last line break, which the text sink adds."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value.cast("string"), F.lit(BREAK))

    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    payload = F.col("payload") if kind == "response" else F.lit("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"), line("Content-Length", F.col("payload_bytes")), F.lit(BREAK))
    refers = F.lit("") if kind == "response" else F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">"))))
    # a URL is one line: control characters and blanks are percent-encoded
    url = F.coalesce(F.col("url"), F.lit(""))
    safe = F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x00-\x20\x7F]$"), F.concat(
        F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")).otherwise(url)
    target = F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", safe))
    date = F.date_format(F.timestamp_seconds("captured_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit(_start(archive)), line("WARC-Type", F.lit(kind)), line("WARC-Record-ID", name), target, line("WARC-Date", date), refers,
                    line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.lit(f"Content-Type: application/http; msgtype=response{BREAK}"),
                    line("Content-Length", F.octet_length(http) + F.octet_length(payload)), F.lit(BREAK))
    return F.concat(head, http, payload, F.lit(BREAK))


def _start(archive: str) -> str:
    return f"WARC/1.1{BREAK}WARC-Warcinfo-ID: <urn:uuid:{archive}>{BREAK}"


def write(responses: DataFrame, revisits: DataFrame, path: str) -> str:
    """Write WARC files below ``path``; returns the archive's id.

    Every record names the archive right after its version line, and the id is
    drawn after all payloads exist: no payload can hold the line by which the
    reader tells records apart.
    """
    archive = str(uuid.uuid4())
    about = f"software: restartlab{BREAK}format: WARC File Format 1.1{BREAK}"
    info = (f"{_start(archive)}WARC-Type: warcinfo{BREAK}WARC-Record-ID: <urn:uuid:{archive}>{BREAK}WARC-Date: 2024-01-01T00:00:00Z{BREAK}"
            f"Content-Type: application/warc-fields{BREAK}Content-Length: {len(about)}{BREAK}{BREAK}{about}{BREAK}")
    spark = responses.sparkSession
    rows = responses.select(_record("response", archive).alias("value")).unionByName(revisits.select(_record("revisit", archive).alias("value")))
    rows.unionByName(spark.range(1, numPartitions=1).select(F.lit(info).alias("value"))).write.option("lineSep", BREAK).text(path)
    return archive


def read(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Index rows and payloads of the records below ``path``: the columns of an index and ``payload`` (null for revisits).

    Large files are split between tasks. ``intact`` says that a response's
    payload has the stated size and digest.
    """
    raw = spark.read.option("lineSep", BREAK + BREAK + _start(archive)).text(path)
    head = F.substring_index("value", BREAK + BREAK, 1)

    def field(name: str) -> Column:
        got = F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
        return F.when(F.col("head").rlike(rf"(?:^|\r\n){name}: "), got)

    parted = raw.select(head.alias("head"), F.expr(r"substring(value, char_length(substring_index(value, '\r\n\r\n', 1)) + 5)").alias("content"), F.col("_metadata.file_name").alias("file"))
    parted = parted.withColumn("record_type", field("WARC-Type")).where("record_type in ('response', 'revisit')")
    number = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(c != "", c.cast("bigint"))
    http = F.substring_index("content", BREAK + BREAK, 1)
    size = F.regexp_extract(http, r"\r\nContent-Length: (\d+)", 1).cast("bigint")
    body = F.expr(r"substring(content, char_length(substring_index(content, '\r\n\r\n', 1)) + 5)")
    rows = parted.select(
        url_key(field("WARC-Target-URI")).alias("url_key"), F.coalesce(F.unix_timestamp(F.try_to_timestamp(field("WARC-Date"))), F.lit(0)).alias("captured_at"),
        as_id(number("WARC-Record-ID")).alias("page_id"), field("WARC-Target-URI").alias("url"), size.alias("payload_bytes"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"), "record_type", as_id(number("WARC-Refers-To")).alias("refers_to"), body.alias("body"), "file")
    over = F.octet_length("body") - F.col("payload_bytes")  # the last record of a file keeps its closing line breaks
    payload = F.when(F.col("record_type") == "response", F.when(over > 0, F.expr("left(body, char_length(body) - cast(octet_length(body) - payload_bytes as int))")).otherwise(F.col("body")))
    rows = rows.withColumn("payload", payload).drop("body")
    good = (F.octet_length("payload") == F.col("payload_bytes")) & (F.sha1(F.encode("payload", "UTF-8")) == F.col("payload_digest"))
    return rows.withColumn("intact", F.when(F.col("record_type") == "response", good))


class LoserTree:
    """k-way merge: every inner node keeps the loser of its match, so the next row costs one match per level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        size = 1
        while size < len(runs):
            size *= 2
        self.losers, winners = [-1] * size, [-1] * size + list(range(len(runs))) + [-1] * (size - len(runs))
        for node in range(size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner, self.size = winners[1] if size > 1 else (0 if runs else -1), size

    def _before(self, a: int, b: int) -> bool:
        x, y = (None if i < 0 else self.heads[i] for i in (a, b))
        return y is None or (x is not None and x <= y)

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            node, best = (run + self.size) // 2, run
            while node:
                if not self._before(best, self.losers[node]):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the rows of a sorted partition: a run."""
    at, run = 0, TaskContext.get().partitionId()
    for batch in batches:
        yield batch.assign(run=run, seq=range(at, at + len(batch)))
        at += len(batch)


def _order(rows: pd.DataFrame) -> Iterator[tuple]:
    """Sort keys of rows: URL key, capture time, page (null first), then run and place, so that no two are equal."""
    for key, at, page, run, seq in zip(rows["url_key"], rows["captured_at"], rows["page_id"], rows["run"], rows["seq"]):
        yield (key, int(at), page is not None, int(page or 0), int(run), int(seq))


def merged_index(records: DataFrame, range_rows: int = 200_000) -> DataFrame:
    """The rows of ``records`` (an index, see ``read``) in global order of URL key and capture time.

    Each partition is sorted where it is and written: a run. Every m-th key of every
    run is a sample; as all runs are sampled alike, the ranges cut by them hold
    about ``range_rows`` rows at most (and m more per run), also where one URL has a
    third of all rows, since keys end in time, page, run and place. A task takes a range's
    part of every run and merges them by a loser tree. Columns added: ``part`` (the
    range), ``place`` (from 0, over all ranges), ``capture`` (from 1, in the history of its URL key).
    """
    order = [F.col("url_key"), F.col("captured_at"), F.col("page_id").asc_nulls_first()]
    names = [F.col(c).cast("string").alias(c) if c in ("page_id", "refers_to") else F.col(c) for c in FIELDS]
    runs = stored(records.drop("payload").sortWithinPartitions(*order).select(*names).mapInPandas(_numbered, RUN), "runs")
    total = runs.count()
    key = ["url_key", "captured_at", "page_id", "run", "seq"]
    step = max(1, -(-total // SAMPLES))
    sample = sorted(_order(runs.where(F.col("seq") % step == 0).select(*key).toPandas()))
    ranges = max(1, -(-total // range_rows))
    cuts = runs.sparkSession.sparkContext.broadcast([sample[len(sample) * i // ranges] for i in range(1, ranges)])

    @F.pandas_udf("int")
    def part_of(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts.value, k) for k in _order(pd.DataFrame(dict(zip(key, (a, b, c, d, e)))))], dtype="int32")

    def merge(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["run", "seq"], ignore_index=True)  # the runs as they were written
        spans = rows.groupby("run", sort=True).indices.values()
        tree = LoserTree([((*k, i) for k, i in zip(_order(rows.iloc[span]), span)) for span in spans])
        out = rows.iloc[[k[-1] for k in tree]].reset_index(drop=True)
        return out.assign(at=range(len(out)), nth=out.groupby("url_key", sort=False).cumcount() + 1)

    located = runs.withColumn("part", part_of(*key))
    merged = stored(located.groupBy("part").applyInPandas(merge, RUN + ", part int, at bigint, nth bigint"), "index")
    counts = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min_by("url_key", "at").alias("head"), F.max_by("url_key", "at").alias("tail"), F.max_by("nth", "at").alias("open"))
    shifts, before, tail, seen = [], 0, None, 0
    for r in sorted(counts.collect()):  # one row per range
        seen = seen if r["head"] == tail else 0
        shifts.append((r["part"], before, r["head"], seen))
        seen = r["open"] + (seen if r["head"] == r["tail"] else 0)
        before, tail = before + r["n"], r["tail"]
    shift = F.broadcast(runs.sparkSession.createDataFrame(shifts, "part int, before bigint, first string, seen bigint"))
    back = [F.col(c).cast("bigint").alias(c) if c in ("page_id", "refers_to") else F.col(c) for c in FIELDS]
    return (merged.join(shift, "part")
            .select(*back, "part", (F.col("before") + F.col("at")).alias("place"),
                    (F.col("nth") + F.when(F.col("url_key") == F.col("first"), F.col("seen")).otherwise(0)).alias("capture")))


def archive_and_index(pages: DataFrame, path: str | None = None, least: int = 1000, range_rows: int = 200_000) -> DataFrame:
    """Write a WARC record per row of ``pages`` (page_id, url, html), read the archives back and return their merged index.

    Null html is an empty payload. Rows with the largest page_id of equal
    payloads of at least ``least`` bytes are responses (all of them, if the id
    repeats), the others revisit it; smaller payloads are always responses. A
    null page_id never is the one referred to, and groups without ids are all responses. A
    null url has no target and the URL key of an empty one. Captured times come from
    a column ``captured_at`` (seconds), else from page_id. Other columns are not
    read. An empty table gives an archive without captures and no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archive")
    archive = write(*captures(pages, least), path)
    return merged_index(read(spark, path, archive), range_rows)
