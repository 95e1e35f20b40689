"""Toxicity by compression distance: windows compressed with a zstandard dictionary trained on toxic and one trained on ordinary text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from restartlab.llm.common import stored

SPAN, STEP = 72, 54  # bytes of a window, bytes to the next one
BLANK = b"  "  # stands for white space: a dictionary entry at the beginning of a word matches longer than inside one
LEAD = bytes(range(128, 144))  # begins every window and both dictionaries, which thus both pay for a first match
STEPS = (3, 4, 5, 6, 8)  # savings in bytes, as thresholds of the features
WORD = re.compile(rb"[^ ]+")
FEATURES = 4 + 2 * len(STEPS)
TABLES = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])  # ends the header of a trained dictionary: the format's three start offsets
#: Segment lengths of the trainer, and bytes that a sample has behind the beginning of a word: the KEPT pairs of dictionaries that calibrate best are kept.
TRAINED = tuple((k, tail) for tail in (1, 2) for k in (9, 10, 11, 12, 14))
KEPT = 2
AGAIN = 64  # samples of each marked beginning


@dataclass
class Model:
    """Pairs of a toxic and an ordinary dictionary, and the logistic curve over a text's features under all of them."""

    pairs: list[tuple[bytes, bytes]]
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """The fast strategy leaves literals as they are, so lengths differ by matches alone."""
    data = zstandard.ZstdCompressionDict(LEAD + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=14, search_log=1, min_match=7, target_length=1, strategy=zstandard.STRATEGY_FAST,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


def _plain(text: str | None) -> bytes:
    """Lower case, white space of one form, also at both ends."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return BLANK + BLANK.join(words) + BLANK


def distances(toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor, text: str | None) -> np.ndarray:
    """Bytes that the toxic dictionary saves against the ordinary one, for every window of the whole text."""
    data = _plain(text)
    windows = [LEAD + data[i:i + SPAN] for i in range(0, max(1, len(data) - SPAN + STEP), STEP)]
    return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows], np.float64)


def features(d: np.ndarray) -> list[float]:
    """The three largest savings (10 at most), the number of windows, and how many and which share save 3, 4, 5, 6, 8 bytes or more; logarithms."""
    top = np.minimum(np.sort(np.append(d, [0, 0]))[::-1][:3], 10)
    marked = np.array([(d >= k).sum() for k in STEPS])
    return [*map(float, top), float(np.log(len(d))), *np.log1p(marked).tolist(), *np.log((marked + 0.5) / (len(d) + 10)).tolist()]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with a small ridge."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = ridge * np.diag([*np.ones(x.shape[1]), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (p - y) + keep @ w)
    return w[:-1], float(w[-1])


def _beginnings(rows: DataFrame, shortest: int, longest: int) -> DataFrame:
    """start, hits: in how many different places (word and the word before it) a word begins with ``start``."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = rows.select(F.split(low, r"[\x20\x09-\x0D]+").alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), F.col("w")).alias("before"))
    places = cut.select(F.explode(pairs).alias("p")).select("p.word", "p.before").where(F.length("word") >= shortest).distinct()
    sizes = F.sequence(F.lit(shortest), F.least(F.length("word"), F.lit(longest)))
    starts = places.select("word", F.explode(sizes).alias("n")).select(F.expr("left(word, n)").alias("start"))
    return starts.groupBy("start").agg(F.count(F.lit(1)).alias("hits"))


def contrast_stems(toxic: DataFrame, ordinary: DataFrame, least: int = 5, ratio: float = 8.0, relative: float = 0.1,
                   most: int = 400, shortest: int = 3, longest: int = 12) -> list[str]:
    """Beginnings of words that mark toxic rows, strongest last; whole words are beginnings too.

    A beginning is weighed by the number of different places it has, so a text that
    was copied a thousand times counts once, and inflected forms count together. Of
    beginnings that contain each other the one with the most weight stays, the
    longest on a tie. Those far weaker than the strongest are chance and go. At most
    5,000 rows, the heaviest, reach the driver and at most ``most`` are returned.
    """
    seen = _beginnings(toxic, shortest, longest).where(F.col("hits") >= least)
    other = _beginnings(ordinary, shortest, longest).withColumnRenamed("hits", "others")
    size = lambda rows: rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double")).first()[0] or 1.0
    odds = F.col("hits") / ((F.coalesce("others", F.lit(0)) + 1) * F.lit(size(toxic) / size(ordinary)))
    rows = (seen.join(other, "start", "left").where(odds >= ratio).select("start", (F.log(odds) * F.col("hits")).alias("w"))
            .orderBy(F.desc("w"), F.desc(F.length("start")), "start").limit(5000).collect())
    kept: list[str] = []
    for r in rows:
        if r["w"] >= relative * rows[0]["w"] and len(kept) < most and not any(r["start"].startswith(k) or k.startswith(r["start"]) for k in kept):
            kept.append(r["start"])
    return kept[::-1]


def _first(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``size`` rows of each group by the order of ``turn``, doc_id; first within 256 parts of a group, then among those."""
    parts = [*keys, F.pmod("turn", F.lit(256))]
    for by in (parts, keys):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("turn", "doc_id"))).where(F.col("n") <= size)
    return rows


def _samples(stems: list[bytes]):
    """Samples for the trainer, one per word: which beginning it has (-1: none is asked for), a turn, and the word's beginning with what stands around it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                data = _plain(text)
                for word in WORD.finditer(data):
                    at, own = word.start(), word.group()
                    near = xxhash.xxh3_64_intdigest(data[max(0, at - 24):at + 24]) >> 1
                    if not stems:
                        if len(own) >= 5 and near % 20 == 0:
                            found.append((-1, near, data[at - 2:at + 6 + 2]))
                        continue
                    for i, stem in enumerate(stems):
                        if own.startswith(stem):
                            found.append((i, near, data[at - 2:at + max(len(stem), 6) + 2]))
            yield pd.DataFrame(found, columns=["mark", "near", "part"])

    return run


def samples(rows: DataFrame, stems: list[str], most: int) -> list[bytes]:
    """Samples of texts: AGAIN of every marked beginning (fewer are repeated), or ``most`` of any words; picked by the hash of where they stand."""
    found = rows.select("text").mapInPandas(_samples([s.encode("utf-8", "surrogatepass") for s in stems]), "mark int, near bigint, part binary").distinct()
    if not stems:
        return [bytes(r["part"]) for r in found.orderBy("near", "part").limit(most).collect()]
    first = F.row_number().over(Window.partitionBy("mark").orderBy("near", "part"))
    kept = found.withColumn("n", first).where(F.col("n") <= AGAIN).orderBy("mark", "near", "part").collect()
    out: list[bytes] = []
    for mark in range(len(stems)):
        own = [bytes(r["part"]) for r in kept if r["mark"] == mark]
        out += (own * (AGAIN // max(1, len(own)) + 1))[:AGAIN] if own else []
    return out


def trained(parts: list[bytes], segment: int, tail: int, size: int) -> bytes:
    """Content of a dictionary that zstandard trains on samples; of too few samples, the samples themselves."""
    cut = [p[:len(p) - 2 + tail] for p in parts]
    try:
        return zstandard.train_dictionary(size, cut, k=segment, d=6).as_bytes().split(TABLES, 1)[-1]
    except zstandard.ZstdError:
        return b"".join(sorted(set(cut)))[-size:]


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = 1000, base: int = 2048, reading: int = 5000) -> Model | None:
    """Dictionaries and thresholds from labelled rows; null if one label is missing.

    Half of the labelled texts (by hash) gives the dictionaries, from at most
    ``reading`` whole texts per label. Both are trained on beginnings of words with
    what stands around them. Samples of ordinary text are spread evenly; samples of
    toxic text are weighted by contrast: those that begin as toxic words far more
    often do than ordinary ones (all words, if there are none). Each pair of
    settings in ``TRAINED`` gives a pair of dictionaries of one length. At most
    ``sample`` rows per label of the other half calibrate the score of each pair;
    the KEPT pairs with the smallest losses there are calibrated together.
    """
    texts = docs.select("doc_id", "text").where("text is not null")
    texts = (texts.where(allowed) if allowed is not None else texts).withColumn("turn", F.xxhash64("text"))
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keys = texts.select("doc_id", "turn").distinct().join(marked, "doc_id")  # texts themselves are not shuffled
    keys = stored(keys.withColumn("half", F.pmod("turn", F.lit(2))), "labels")
    chosen = _first(keys, ["toxic", "half"], max(reading, sample)).where(F.expr("half = 0") | (F.col("n") <= sample))
    rows = texts.join(F.broadcast(chosen), ["doc_id", "turn"])  # at most 2 * (reading + sample) keys
    rows = stored(rows.select("doc_id", "text", "turn", "toxic", "half", "n"), "labelled")
    first, second = rows.where("half = 0"), rows.where("half = 1")
    stems = contrast_stems(first.where(F.col("toxic") == 1), first.where(F.col("toxic") == 0))
    toxic = samples(first.where(F.col("toxic") == 1), stems, AGAIN * 16)
    ordinary = samples(first.where(F.col("toxic") == 0), [], max(len(toxic), AGAIN))
    pairs = []
    for segment, tail in TRAINED:
        pair = [trained(parts, segment, tail, base) for parts in (toxic, ordinary)]
        size = min(map(len, pair))  # dictionaries of one length: matches cost the same
        pairs.append(tuple(c[len(c) - size:] for c in pair))
    got = second.select("toxic", _features(pairs)(F.col("text")).alias("f")).collect()
    y = np.array([r["toxic"] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    every = np.array([r["f"] for r in got]).reshape(len(got), len(pairs), FEATURES)
    losses = sorted((round(_calibrated(every[:, i], y)[-1], 9), i) for i in range(len(pairs)))
    kept = sorted(i for _, i in losses[:KEPT])
    mean, scale, weight, bias, _ = _calibrated(every[:, kept].reshape(len(got), -1), y, 3.0)
    share = keys.where("half = 1").agg(F.avg("toxic")).first()[0]
    bias += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))  # the sample is drawn per label: put the odds back
    return Model([pairs[i] for i in kept], mean, scale, weight, bias)


def _calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple:
    """Mean, scale, weight and bias of a logistic curve, and its mean loss."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    weight, bias = logistic(z, y, ridge=ridge)
    p = np.clip(1 / (1 + np.exp(-(z @ weight + bias))), 1e-9, 1 - 1e-9)
    return mean, scale, weight, bias, -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def _under(pairs: list[tuple[bytes, bytes]]):
    """Features of a text under each pair of dictionaries, one after the other."""
    both = [(_compressor(t), _compressor(o)) for t, o in pairs]
    return lambda text: sum((features(distances(*pair, text)) for pair in both), [])


def _features(pairs: list[tuple[bytes, bytes]]):
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        told = _under(pairs)
        for texts in batches:
            yield pd.Series([told(t) for t in texts], dtype=object)

    return run


def scores(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs`` (doc_id, text).

    The score is the calibrated chance of label 1; whole texts are compressed,
    window by window. A null or empty text has one blank window. Without a model
    (no labels of both kinds) every score is 0. Repeated rows and ids are scored
    each on its own, equal texts alike; other columns are not read.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        told = _under(model.pairs)
        for texts in batches:
            x = np.array([told(t) for t in texts]).reshape(len(texts), len(model.mean))
            z = (((x - model.mean) / model.scale) * model.weight).sum(axis=1) + model.bias  # a product would round by the batch's shape
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    found = docs.select("doc_id", scored(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
