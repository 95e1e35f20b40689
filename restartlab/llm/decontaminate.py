"""Benchmark decontamination with spaced seeds: substitution-tolerant overlaps of documents and benchmark items."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from restartlab.llm.common import MIX, WordHash, apart, bit_filter, mix64, parts, set_in, stored

WINDOW, ERRORS = 13, 3  # words that are compared, and how many of them may differ
#: Whatever 3 of 13 neighbouring words differ, one of these masks lies on words that agree (a test tries all 286 cases).
MASKS = ("111011", "110111", "1101000011")
LEAST = 3  # one or two words say nothing about where they come from
#: ASCII punctuation separates words like white space does.
SPACES = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def errors_for(length: int) -> int:
    """Words that may differ in the window of an item: in proportion to its length, none below seven words."""
    return ERRORS if length >= WINDOW else length * ERRORS // WINDOW if length >= 7 else 0


def masks_for(length: int) -> tuple[str, ...]:
    """Masks of an item. Below 13 words the window is the item: errors + 1 masks share its places in turn, so one of them has no error."""
    if length >= WINDOW:
        return MASKS
    if length < LEAST:
        return ()
    step = errors_for(length) + 1
    return tuple("".join("1" if i % step == g else "0" for i in range(length)) for g in range(step))


def tokens_of(text: str | None, memo: WordHash) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(SPACES).split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def seeds_of(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Keyed sum of the words under the mask at every position; the other words do not count."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, zlib.crc32(mask.encode()), np.uint64)
    for i, one in enumerate(mask):
        if one == "1":
            total += tokens[i:i + n] * np.uint64((int(MIX) * (2 * i + 1)) % 2**64)
    return mix64(total)


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = WordHash()
    for part in parts(batches, "text"):
        found = []
        for item, text in zip(part["item_id"], part["text"]):
            tokens = tokens_of(text, memo)
            for mask in masks_for(len(tokens)):
                found += [(item, len(tokens), int(s), at) for at, s in enumerate(seeds_of(tokens, mask).view(np.int64))]
        yield pd.DataFrame(found, columns=["item_id", "n", "seed", "at"])


def _regions(filled, lengths: list[int]):
    masks = [*MASKS, *(m for n in lengths for m in masks_for(n))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, bits = WordHash(), filled.value
        for part in parts(batches, "text"):
            each = [tokens_of(t, memo) for t in part["text"]]
            ends = np.cumsum([len(t) for t in each])
            every = np.concatenate(each) if each else np.zeros(0, np.uint64)
            spots, seeds = [], []
            for mask in masks:
                s = seeds_of(every, mask)
                at = np.flatnonzero(set_in(bits, s))
                doc = np.searchsorted(ends, at, side="right")
                at = at[at + len(mask) <= ends[doc]] if len(at) else at  # a mask must not cross into the next document
                spots.append(at)
                seeds.append(s[at])
            at, seed = np.concatenate(spots), np.concatenate(seeds).view(np.int64)
            order = np.argsort(at, kind="stable")
            at, seed = at[order], seed[order]
            doc = np.searchsorted(ends, at, side="right")
            new = np.flatnonzero(np.concatenate([[True], (at[1:] - at[:-1] > WINDOW) | (doc[1:] != doc[:-1])])) if len(at) else at
            found, ids, starts = [], part["doc_id"].to_list(), ends - [len(t) for t in each]
            for a, b in zip(new, [*new[1:], len(at)]):
                d = doc[a]
                first, last = max(starts[d], at[a] - WINDOW), min(ends[d], at[b - 1] + 2 * WINDOW)
                found.append((ids[d], int(first - starts[d]), every[first:last].view(np.int64), (at[a:b] - first).tolist(), seed[a:b].tolist()))
            if found:
                yield pd.DataFrame(found, columns=["doc_id", "start", "words", "offsets", "seeds"])

    return run


def _best(words: pd.Series, item: pd.Series, shift: pd.Series) -> pd.DataFrame:
    """Most agreeing words in a window along one diagonal, and where in the region the window begins."""
    matched, first = [], []
    for w, b, s in zip(words, item, shift):
        size = min(WINDOW, len(b))
        lo, hi = max(0, -s), min(len(b), len(w) - s)
        if hi - lo < size:
            matched.append(0), first.append(0)
            continue
        same = np.concatenate([[0], np.cumsum(w[lo + s:hi + s] == b[lo:hi])])
        runs = same[size:] - same[:-size]
        matched.append(int(runs.max())), first.append(int(runs.argmax() + lo + s))
    return pd.DataFrame({"matched": matched, "first": first})


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = WordHash()
    for part in parts(batches, "text"):
        yield pd.DataFrame({"item_id": part["item_id"], "item": [tokens_of(t, memo).view(np.int64) for t in part["text"]]})


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched_words, window_words, first_word for every document (doc_id, text) that overlaps an item (item_id, text).

    A document overlaps an item if 13 neighbouring words of both agree in at least
    10 places; of its windows the one with most agreeing words is given, the first
    in the document on a tie. The window of a shorter item is the item: two words
    of 9 to 12 may differ, one of 7 or 8, none of 3 to 6. Words are lower-cased
    runs without white space and ASCII punctuation.

    Each side's masks are hashed; documents keep the seeds that pass a bit filter
    of fixed size and carry them, as regions, to a join on the seed; every hit's
    diagonal is verified on the words themselves. Items of one or two words, null texts
    and null ids on either side give no rows. Repeated ids count as one document.
    """
    spark: SparkSession = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    seeds = stored(items.mapInPandas(_item_rows, "item_id bigint, n int, seed bigint, at int"), "seeds")
    lengths = sorted(r["n"] for r in seeds.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most 10 values
    filled = spark.sparkContext.broadcast(bit_filter(seeds.select(F.col("seed").alias("hash"))))
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    regions = stored(texts.mapInPandas(_regions(filled, lengths), "doc_id bigint, start int, words array<bigint>, offsets array<int>, seeds array<bigint>")
                     .withColumn("region", F.xxhash64("doc_id", "start", "words")), "regions")
    spots = (regions.select("doc_id", "region", F.explode(F.arrays_zip("offsets", "seeds")).alias("s"))
             .select("doc_id", "region", F.col("s.offsets").alias("offset"), F.col("s.seeds").alias("seed")))
    lines = spots.join(seeds.select("seed", "item_id", "at"), "seed").select("doc_id", "region", "item_id", (F.col("offset") - F.col("at")).alias("shift")).distinct()
    words = items.mapInPandas(_item_words, "item_id bigint, item array<bigint>")
    compared = F.pandas_udf(_best, "struct<matched:int,first:int>")
    checked = (lines.join(regions.select("doc_id", "region", "start", "words"), ["doc_id", "region"]).join(words, "item_id")
               .select("doc_id", "item_id", "start", F.least(F.size("item"), F.lit(WINDOW)).alias("window_words"), compared("words", "item", "shift").alias("best")))
    slack = F.element_at(F.array(*[F.lit(errors_for(n)) for n in range(1, WINDOW + 1)]), F.col("window_words"))
    good = checked.where(F.col("best.matched") >= F.col("window_words") - slack)
    top = F.struct(F.col("best.matched").alias("m"), (-F.col("start") - F.col("best.first")).alias("p"), F.col("window_words").alias("w"))
    return (good.groupBy("doc_id", "item_id").agg(F.max(top).alias("t"))
            .select("doc_id", "item_id", F.col("t.m").alias("matched_words"), F.col("t.w").alias("window_words"), (-F.col("t.p")).alias("first_word")))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id has no overlap with the benchmark; columns unchanged, rows with a null id kept."""
    bad = stored(overlaps(docs, benchmark).select(F.col("doc_id").alias("__id")).distinct(), "overlapping")
    sure, rest = apart(docs, bad)
    rest = rest.join(bad, F.col("__row.doc_id") == F.col("__id"), "left_anti")
    return sure.unionByName(rest).select("__row.*")
