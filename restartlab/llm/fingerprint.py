"""Lempel-Ziv phrase fingerprints: minimum hashes of the phrases that a text is parsed into."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from restartlab.llm.common import MIX, mix64

SLOTS = 64  # minimum hashes of a fingerprint, 16 bits of each are kept


class Parse:
    """LZ78: the longest known phrase plus one character is the next phrase.

    A parse can be copied and carried on, so texts with one beginning share its work.
    """

    def __init__(self) -> None:
        self.phrases: dict[str, None] = {}
        self.open = ""

    def copy(self) -> Parse:
        other = Parse()
        other.phrases, other.open = self.phrases.copy(), self.open
        return other

    def feed(self, text: str) -> Parse:
        phrases, phrase = self.phrases, self.open
        for c in text:
            phrase += c
            if phrase not in phrases:
                phrases[phrase] = None
                phrase = ""
        self.open = phrase
        return self

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the distinct phrases, the unfinished last one included."""
        every = [*self.phrases, self.open] if self.open and self.open not in self.phrases else list(self.phrases)
        return hashed(every)


def hashed(phrases: list[str]) -> np.ndarray:
    """Hashes of many short strings at once: sums of mixed characters with their places."""
    if not phrases:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
    return mix64(np.add.reduceat(mix64((place << np.uint64(21)) + codes), starts) + sizes.astype(np.uint64) * MIX)


def minima(hashes: np.ndarray) -> np.ndarray:
    """One-permutation minimum hashes (SLOTS x 16 bits); an empty slot takes the value of a keyed other slot."""
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    if not len(hashes):
        return np.zeros(SLOTS, np.uint16)
    ordered = np.sort(hashes)
    slot = (ordered >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    low[slot[first]] = ordered[first]
    full = np.zeros(SLOTS, bool)
    full[slot[first]] = True
    turn = 1
    take = np.arange(SLOTS)
    while not full[take].all():
        empty = np.flatnonzero(~full[take])
        take[empty] = (mix64(empty.astype(np.uint64) * MIX + np.uint64(turn)) % np.uint64(SLOTS)).astype(np.int64)
        turn += 1
    mixed = mix64(low[take] + (take != np.arange(SLOTS)) * np.arange(SLOTS, dtype=np.uint64))
    return (mixed >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases: equal slots."""
    return float((a == b).mean())


def text_of(minimum: np.ndarray) -> str:
    return minimum.astype(">u2").tobytes().hex()


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    held = None
    for batch in batches:
        found = []
        for row in batch.itertuples(index=False):
            text = row.text or ""
            whole = Parse()
            half = len(text) - len(text) // 2
            start = whole.feed(text[:half]).copy()
            mark = minima(whole.feed(text[half:]).hashes())
            if held is not None and held[0] == row.bucket:
                _, doc, before, begun, own = held
                cut = len(before) // 2
                edited = before[:len(before) - cut] + text[:cut]
                other = minima(begun.feed(text[:cut]).hashes())
                found.append((doc, len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), text_of(own), text_of(other), likeness(own, other), likeness(own, mark)))
            held = (row.bucket, row.doc_id, text, start, mark)
        yield pd.DataFrame(found, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the rising ``cuts`` are below value, by halving; null for a null value."""
    table = F.lit(cuts)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.get(table, F.least(middle, F.lit(len(cuts) - 1))) < value)
        return F.struct(F.when(right, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(middle).alias("hi"))

    turns = F.array(*[F.lit(i) for i in range(len(cuts).bit_length() + 1)])
    found = F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda acc: acc["lo"])
    return F.when(value.isNotNull(), found)


def with_edits(docs: DataFrame, rows_per_bucket: int = 2000) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text, see the columns.

    The next document is the one with the next smaller id; the smallest is followed
    by the largest. Ids are dealt into ranges of about ``rows_per_bucket`` rows; the
    first document of a range is also sent to the range before it, so each range is
    sorted and read once, and texts are shuffled once. There are 10,000 ranges at
    most, so their heads may be broadcast; a range is streamed, not held. A null text
    is empty, a null id comes last, equal ids are ordered by their text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = max(1, min(10_000, -(-rows.count() // rows_per_bucket)))
    shares = [i / count for i in range(1, count)] or [0.5]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * count))).first()[0] or [])) or [0]
    bucket = F.coalesce(len(cuts) - _below(cuts, F.col("doc_id")), F.lit(len(cuts) + 1)).cast("bigint")
    placed = rows.withColumn("bucket", bucket)
    key = F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.xxhash64("text").cast("decimal(20,0)"))
    heads = placed.groupBy("bucket").agg(F.max(key).alias("head"))
    order = Window.orderBy("bucket")
    target = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = heads.select("bucket", "head", target.alias("target"))
    also = (placed.join(F.broadcast(guests), "bucket").where(key == F.col("head"))
            .groupBy("target", "head").agg(F.any_value("text").alias("text"))
            .select(F.col("target").alias("bucket"), F.col("head.doc_id").alias("doc_id"), "text", F.lit(1).alias("guest")))
    every = placed.select("bucket", "doc_id", "text", F.lit(0).alias("guest")).unionByName(also)
    dealt = every.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return dealt.select("bucket", "doc_id", "text").mapInPandas(
        _compared, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
