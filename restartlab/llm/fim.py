"""Fill-in-the-middle transformation: texts are cut at unit ranks found in an indexable skip list."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from restartlab.llm.common import mix64, parts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORM = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit of ``text``: a run of A-Z and a-z, or any other single code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((codes | 32) >= 97) & ((codes | 32) <= 122)
    begins = np.flatnonzero(~(letter & np.concatenate([[False], letter[:-1]])))
    return np.diff(begins, append=len(codes))


class SkipList:
    """Indexable skip list over units; every link carries how many units and how many code points it passes.

    A unit is a tower whose height follows from a hash of its place: a quarter of
    the towers of a lane reach the next one. Lanes are arrays of widths, lowest
    first; ``down`` gives the place of a tower in the lane below. The head stands
    before the first unit in every lane.
    """

    def __init__(self, widths: np.ndarray, seed: int = 1):
        self.units, self.points, self.down = [np.ones(len(widths), np.int64)], [np.asarray(widths, np.int64)], [np.arange(len(widths))]
        towers = mix64(np.arange(len(widths), dtype=np.uint64) + np.uint64(seed))
        place = np.arange(len(widths))
        while len(place) > 8:
            tall = (towers & np.uint64(3)) == 0
            spots = np.flatnonzero(tall)
            if not len(spots):
                break
            # the link that ends at a tower passes everything since the tower before it
            ends = np.concatenate([[0], spots + 1])
            self.units.append(np.diff(np.concatenate([[0], np.cumsum(self.units[-1])])[ends]))
            self.points.append(np.diff(np.concatenate([[0], np.cumsum(self.points[-1])])[ends]))
            self.down.append(spots)
            place, towers = place[spots], towers[spots] >> np.uint64(2)

    def seek(self, rank: int) -> int:
        """Code points before the cut after ``rank`` units, by descending the lanes with accumulated widths."""
        passed = points = at = 0
        for lane in range(len(self.units) - 1, -1, -1):
            units, widths = self.units[lane], self.points[lane]
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                points += int(widths[at])
                at += 1
            if lane:  # stand on the same tower one lane below, behind it
                at = int(self.down[lane][at - 1]) + 1 if at else 0
        if passed != rank:
            raise ValueError(f"no cut after {rank} of {passed} units")
        return points


def arranged(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "plain":
        return prefix + middle + suffix
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The exact text of an output; a text with a sentinel is always plain, so the sentinels found are the written ones."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws of a document: the first 8-digit groups of sha256 of seed and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def _cut(rate: int, spm: int):
    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        widths = unit_widths(text)
        n = len(widths)
        if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
            return n, "plain", None, None, text
        units = SkipList(widths)
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = units.seek(low), units.seek(high)
        form = "spm" if h4 % 100 < spm else "psm"
        return n, form, a, b - a, arranged(form, text[:a], text[a:b], text[b:])

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts(batches, "text", 1_000_000):
            texts = [t or "" for t in part["text"]]
            rows = [one(*r) for r in zip(texts, part["h1"], part["h2"], part["h3"], part["h4"])]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out = out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            out["output_sha256"] = [digest(o) for o in out["output"]]
            out["restored_sha256"] = [digest(restored(o, f)) for o, f in zip(out["output"], out["form"])]
            yield out

    return run


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and digests of every row of ``docs`` (doc_id, text).

    A text of n units is cut after two ranks drawn from its id; ``rate`` of 100
    texts are rearranged, ``spm`` of 100 of these with the suffix first. Texts that
    are empty, null (as empty) or hold a sentinel stay plain, with null widths.
    ``output`` is the training text, ``restored_sha256`` the digest of the text
    rebuilt from output and form alone. One row out per row in: repeated rows and
    ids give repeated results, a null id draws as an empty one, columns besides
    doc_id and text are not read, an empty table gives no rows. Nothing is
    shuffled; a text and its lanes are the most that a task holds at once beside
    a run of about a million characters.
    """
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *draws(F.col("doc_id"), seed))
    return named.mapInPandas(_cut(rate, spm), FORM)


def restore(transformed: DataFrame) -> DataFrame:
    """doc_id, text rebuilt from rows (doc_id, form, output); null outputs give null texts."""

    @F.pandas_udf("string")
    def back(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restored(o, f) for o, f in zip(output, form)], dtype=object)

    return transformed.select("doc_id", back("output", "form").alias("text"))
