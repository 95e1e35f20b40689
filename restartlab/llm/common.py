"""Helpers shared by the text operators: word hashing, batching, scratch tables, connected components."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from restartlab.session import scratch_path

MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = 26  # a bit filter has 2 ** BITS bits: 8 MB, whatever goes in


class WordHash(dict):
    """64-bit hashes of words; a cache that is emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words split at ASCII white space, A-Z in lower case (bytes.lower and bytes.split do just that)."""
    return lowered(text).split()


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A value for each place of a word (64 of them, then again with other factors) and byte; white space has none.
SPELL = mix64(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * MIX)
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, split at ASCII white space, and how many each text has.

    No word becomes an object: a word's hash is the mixed sum of what its bytes
    stand for at their places.
    """
    whole = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inner = ~BLANK[whole]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    starts = np.flatnonzero(first)
    counts = np.zeros(len(texts), np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(whole), dtype=np.int32)
    place[starts[0]:] -= np.repeat(place[starts], np.diff(starts, append=len(whole)))
    place[:starts[0]] = 0
    value = SPELL[((place & 63) << 8) | whole]
    far = np.flatnonzero(place > 63)
    value[far] *= (place[far].astype(np.uint64) >> np.uint64(6)) * np.uint64(2) + np.uint64(1)
    value[~inner] = 0
    ends = np.cumsum([len(t) + 1 for t in texts])
    np.add.at(counts, np.searchsorted(ends, starts, side="right"), 1)
    return mix64(np.add.reduceat(value, starts)), counts


def let_go() -> None:
    """Give freed memory back to the machine: Python workers outlive their tasks, and those of many stages stand side by side."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def parts(batches: Iterator[pd.DataFrame], text: str, limit: int = 500_000) -> Iterator[pd.DataFrame]:
    """Cut batches into runs of rows with about ``limit`` characters, so that memory does not follow row counts; let go of memory at the end."""
    for batch in batches:
        if len(batch):
            sizes = batch[text].str.len().fillna(0).to_numpy(dtype=np.int64)
            run = np.cumsum(sizes + 64) // limit
            for _, part in batch.groupby(run, sort=True):
                yield part
    batch = part = None
    let_go()


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bits(rows: pd.DataFrame) -> pd.DataFrame:
    """One part of a bit filter, compressed."""
    part = np.zeros(1 << (BITS - 6 - 3), np.uint8)
    slot = (rows["slot"].to_numpy(np.int64) & ((1 << (BITS - 6)) - 1))
    np.bitwise_or.at(part, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    return pd.DataFrame({"part": [int(rows["slot"].iloc[0]) >> (BITS - 6)], "bits": [zlib.compress(part.tobytes(), 1)]})


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """Bit filter of a column ``hash``: 64 parts are made on the executors; 2 ** BITS bits reach the driver at most."""
    slots = hashes.select(F.shiftrightunsigned("hash", 64 - BITS).alias("slot")).distinct()
    made = slots.groupBy(F.shiftright("slot", BITS - 6).alias("group")).applyInPandas(_bits, "part int, bits binary").collect()
    whole = np.zeros((64, 1 << (BITS - 9)), np.uint8)
    for row in made:
        whole[row["part"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return whole.reshape(-1)


def set_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1 where a hash may have gone into the filter, 0 where it surely has not."""
    slot = hashes >> np.uint64(64 - BITS)
    return bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1


def perhaps_in(ids: DataFrame, doc_id: Column) -> Column:
    """False where ``doc_id`` is surely not in the one column of ``ids``; the rest needs an exact join.

    The filter spares the shuffle of most rows. Its size is fixed: more ids make
    it less sharp, never wrong.
    """
    filled = ids.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64(F.col(ids.columns[0]).cast("bigint")).alias("hash"))))

    @F.pandas_udf("boolean")
    def found(hashes: pd.Series) -> pd.Series:
        return pd.Series(set_in(filled.value, hashes.to_numpy(np.int64).view(np.uint64)) == 1)

    return found(F.xxhash64(doc_id.cast("bigint")))


def apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (as one struct ``__row``) whose doc_id is null or surely not in the first column of ``ids``, and the rest."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    held = F.col("__row.doc_id").isNotNull() & perhaps_in(ids, F.col("__row.doc_id"))
    return named.where(~held), named.where(held)


def split_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, share: int = 1000) -> DataFrame:
    """Inner join with a table of distinct keys whose column ``rows`` says how many rows of ``left`` have the key.

    Keys with more than 1 / ``share`` of all these rows are fewer than ``share``:
    they are broadcast, so no hot key is shuffled into one task. ``left`` is read
    twice and should be a written table; ``rows`` is dropped.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    heavy = F.broadcast(right.where(F.col(rows) > total // share).drop(rows))
    light = right.where(F.col(rows) <= total // share).drop(rows)
    return left.join(heavy, on).unionByName(left.join(heavy.select(*on), on, "left_anti").join(light, on))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (a, b): columns node, root.

    Alternating large-star and small-star steps: each joins nodes with the
    smallest neighbour, so no neighbour list is ever gathered, and a hub is an
    ordinary skewed join. Every round is a written table.
    """
    cols = [F.col("a"), F.col("b")]
    now = stored(edges.where("a <> b").select(F.greatest(*cols).alias("a"), F.least(*cols).alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), "edges")
        digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == before:
            break
        before = digest
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
