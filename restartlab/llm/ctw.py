"""Language model scores by context-tree weighting over bytes, counted and looked up on Spark.

Texts are dealt into blocks. A block sends its distinct byte windows (context and
next byte) and words, with training counts, to buckets of contexts and words once;
a bucket adds the counts of all blocks and keeps which of its windows each block
asked for. Then it weighs its part of the context tree and answers every block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from restartlab.llm.common import MIX, hashed_words, mix64, stored

END = 255  # no byte of UTF-8: fills the first contexts and ends every text
END_WORD = np.uint64(0xE0D0E0D0E0D0E0D1)
BUCKETS = 64  # at least


def pack(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Compressed integers, byte plane by byte plane; rising ones as differences."""
    v = np.diff(values.astype(np.uint64), prepend=np.uint64(0)) if sorted_ else values.astype(np.uint64)
    return zstandard.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes, sorted_: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    v = np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(np.uint64)
    return np.cumsum(v, dtype=np.uint64) if sorted_ else v


def pack_floats(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.astype(np.float32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_floats(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view(np.float32)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def windows(texts: list[bytes], depth: int) -> np.ndarray:
    """One key per byte and text end: the context, nearest byte first, then the byte that follows it."""
    pad = bytes([END]) * depth
    whole = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    key = np.zeros(len(whole) - depth, np.uint64)
    for back in range(1, depth + 1):
        key <<= np.uint64(8)
        key |= whole[depth - back:len(whole) - back]
    key <<= np.uint64(8)
    key |= whole[depth:]
    keep = np.ones(len(key) + depth, bool)
    sizes = np.array([len(t) + 1 + depth for t in texts])
    starts = np.cumsum(sizes) - sizes
    for i in range(depth):
        keep[starts + i] = False
    return key[keep[depth:]]


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (words, then one end for each text) and the text that each stands in."""
    words, counts = hashed_words(texts)
    every = np.arange(len(texts))
    return np.concatenate([words, np.full(len(texts), END_WORD)]), np.concatenate([np.repeat(every, counts), every])


def bucket_of(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Bucket of a window by its two nearest context bytes, so the subtrees of a bucket are whole."""
    return (mix64((keys >> np.uint64(8 * depth - 8)) * MIX) % np.uint64(buckets)).astype(np.int64)


def word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(words) % np.uint64(buckets)).astype(np.int64)


def firsts(rising: np.ndarray) -> np.ndarray:
    """Where a value of a sorted array stands for the first time."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(rising)), bool), rising[1:] != rising[:-1]]))


def distinct(values: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each stands where ``learned`` holds; plain sorts need no order of places."""
    rising = np.sort(values)
    one = rising[firsts(rising)]
    trained = np.sort(values[learned])
    at = firsts(trained)
    counts = np.zeros(len(one), np.int64)
    counts[np.searchsorted(one, trained[at])] = np.diff(at, append=len(trained))
    return one, counts


def _asked(depth: int, buckets: int, salts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        texts = [text_bytes(t) for t in rows["text"]]
        train = rows["train"].to_numpy(bool)
        found = []
        one, counts = distinct(windows(texts, depth), np.repeat(train, [len(t) + 1 for t in texts]))
        tokens, owner = tokens_of(texts)
        words, times = distinct(tokens, train[owner])
        for kind, values, many, bucket in ((0, one, counts, bucket_of(one, depth, buckets)), (1, words, times, word_bucket(words, buckets))):
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                pick = order[edges[b]:edges[b + 1]]
                if len(pick):
                    found.append((kind, b, block % salts, block, pack(values[pick], True), pack(many[pick])))
        return pd.DataFrame(found, columns=["kind", "bucket", "salt", "block", "keys", "counts"])

    return run


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of several rows of one bucket added up."""
    every = np.concatenate([unpack(k, True) for k in rows["keys"]])
    keys, inverse = np.unique(every, return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([unpack(c) for c in rows["counts"]]).astype(np.float64), minlength=len(keys))
    return pd.DataFrame({"kind": [key[0]], "bucket": [key[1]], "keys": [pack(keys, True)], "counts": [pack(counts.astype(np.uint64))]})


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of the blocks of one salt and bucket added up, and the places of each block's keys among all."""
    lists = [unpack(k, True) for k in rows["keys"]]
    keys, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([unpack(c) for c in rows["counts"]]).astype(np.float64), minlength=len(keys))
    places = [pack(p, True) for p in np.split(inverse, np.cumsum([len(k) for k in lists])[:-1])]
    return pd.DataFrame({"kind": [key[0]], "bucket": [key[1]], "salt": [key[2]], "keys": [pack(keys, True)], "counts": [pack(counts.astype(np.uint64))],
                         "blocks": [rows["block"].tolist()], "places": [places]})


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log of gamma(n + 1/2) / gamma(1/2)."""
    x = n + 0.5
    shift = np.where(n < 16, np.prod([x + i for i in range(8)], axis=0), 1.0)
    y = np.where(n < 16, x + 8, x)
    big = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return big - np.log(shift) - 0.5 * math.log(math.pi)


def log_gamma(n: np.ndarray) -> np.ndarray:
    """log of n! for counts."""
    x = n + 1.0
    shift = np.where(n < 16, np.prod([x + i for i in range(8)], axis=0), 1.0)
    y = np.where(n < 16, x + 8, x)
    big = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return big - np.log(shift)


SMALL = np.arange(4096.0)
HALF_OF, WHOLE_OF = log_gamma_half(SMALL), log_gamma(SMALL)


def krichevsky_trofimov(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of a sequence of n0 zeros and n1 ones; small counts are looked up."""
    both = n0 + n1
    a, b, c = (np.minimum(n, len(SMALL) - 1).astype(np.int64) for n in (n0, n1, both))
    out = HALF_OF[a] + HALF_OF[b] - WHOLE_OF[c]
    big = np.flatnonzero(both >= len(SMALL))
    out[big] = log_gamma_half(n0[big]) + log_gamma_half(n1[big]) - log_gamma(both[big])
    return out


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: list[np.ndarray] | None = None):
    """Context-tree weighting of windows whose contexts share bucket-mates.

    It holds the contexts of two bytes and, byte by byte, up to ``depth``; every
    byte is coded as eight bits, each with its own tree. Without ``top`` it
    returns, per nearest byte and bit node (1 to 255), zeros, ones and the log
    weight of all two-byte contexts; with it, the log probability of each window's
    byte. ``top`` has the levels above, root first: zeros, ones and the share of
    the own estimate of every nearest byte (the root repeats itself) and bit node.
    A context without training counts takes the estimate of the context above it.
    """
    levels = list(range(depth, 1, -1))
    symbol = (keys & np.uint64(255)).astype(np.int64)
    # distinct (context, byte) per level; the deepest level is the keys themselves
    tables, up = [(keys >> np.uint64(8), symbol, counts.astype(np.float64))], []
    for d in levels[1:]:
        context, sym, n = tables[-1]
        joined = ((context >> np.uint64(8)) << np.uint64(8)) | sym.astype(np.uint64)
        one, inverse = np.unique(joined, return_inverse=True)
        tables.append((one >> np.uint64(8), (one & np.uint64(255)).astype(np.int64), np.bincount(inverse, weights=n, minlength=len(one))))
        up.append(inverse)
    totals = np.zeros((256 * 256, 3))
    logp = np.zeros(len(keys))
    for k in range(8):
        child = below = guess = None
        for level, (context, sym, n) in enumerate(tables):
            node = (context << np.uint64(8)) | (sym >> (8 - k)).astype(np.uint64)
            start = np.concatenate([[True], node[1:] != node[:-1]])
            group = np.cumsum(start) - 1
            bit = (sym >> (7 - k)) & 1
            ones = np.bincount(group, weights=n * bit, minlength=group[-1] + 1)
            both = np.bincount(group, weights=n, minlength=group[-1] + 1)
            own = krichevsky_trofimov(both - ones, ones)
            if level == 0:
                weighted, local = own, None
                path = [(group, np.zeros(0), ones, both)]
            else:
                parent = group[up[level - 1]][np.flatnonzero(below)]  # node of every child node
                inner = np.bincount(parent, weights=child, minlength=len(own))
                weighted = np.logaddexp(own, inner) - math.log(2)
                local = np.exp(np.minimum(own - math.log(2) - weighted, 0))  # share of this node's own estimate
                path.append((group, local, ones, both))
            child, below = weighted, start
        prefix = (tables[-1][1] >> (8 - k)) + (1 << k)  # bit node of each top-level row
        first = np.flatnonzero(below)
        if top is None:
            _, _, ones, both = path[-1]
            spot = ((tables[-1][0][first] >> np.uint64(8)) << np.uint64(8)).astype(np.int64) | prefix[first]
            for i, x in enumerate((both - ones, ones, child)):
                totals[:, i] += np.bincount(spot, weights=x, minlength=len(totals))
            continue
        spot = ((tables[-1][0] >> np.uint64(8)) << np.uint64(8)).astype(np.int64) | prefix
        total, left, last = np.zeros(len(spot)), np.ones(len(spot)), np.full(len(spot), 0.5)
        for table in top:
            zeros, ones, share = table.reshape(-1, 3)[spot].T
            seen = zeros + ones > 0
            here = np.where(seen, (ones + 0.5) / (zeros + ones + 1), last)
            share = np.where(seen, share, 1.0)
            total = total + left * share * here
            left, last = left * (1 - share), here
        # walk down: 'total' gathers weighted estimates, 'left' the weight that goes on to deeper contexts
        for level in range(len(tables) - 1, -1, -1):
            group, local, ones, both = path[level]
            if level < len(tables) - 1:
                total, left, last = total[up[level]], left[up[level]], last[up[level]]
            seen = both[group] > 0
            here = np.where(seen, (ones[group] + 0.5) / (both[group] + 1), last)
            share = local[group] if level else np.ones(len(group))
            share = np.where(seen, share, 1.0)
            total = total + left * share * here
            left = left * (1 - share)
            last = here
        bit = (symbol >> (7 - k)) & 1
        logp += np.log(np.clip(np.where(bit == 1, total, 1 - total), 1e-300, 1))
    return totals.reshape(256, 256, 3) if top is None else logp


def upper_levels(totals: np.ndarray) -> list[np.ndarray]:
    """The levels above two bytes for ``subtree`` from its totals summed over all buckets."""
    def shared(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = krichevsky_trofimov(t[..., 0].ravel(), t[..., 1].ravel()).reshape(t.shape[:-1])
        weighted = np.logaddexp(own, t[..., 2]) - math.log(2)
        return weighted, np.stack([t[..., 0], t[..., 1], np.exp(np.minimum(own - math.log(2) - weighted, 0))], -1)

    weighted, level = shared(totals)  # contexts of one byte
    near = np.concatenate([totals[..., :2], weighted[..., None]], -1)
    return [np.broadcast_to(shared(near.sum(0))[1], (256, 256, 3)).copy(), level]


def _top_parts(depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"]):
                t = subtree(unpack(keys, True), unpack(counts), depth).reshape(-1, 3)
                spot = np.flatnonzero(t[:, 0] + t[:, 1])
                yield pd.DataFrame({"spot": spot, "zeros": t[spot, 0], "ones": t[spot, 1], "inner": t[spot, 2]})

    return run


def _said(kind: int, bucket: int, values: np.ndarray, blocks, places) -> pd.DataFrame:
    out = [pack_floats(values[unpack(p, True)]) if kind == 0 else pack(values[unpack(p, True)]) for p in places]
    return pd.DataFrame({"block": list(blocks), "kind": kind, "bucket": bucket, "values": out})


def _valued(kind: int, keys: np.ndarray, counts: np.ndarray, depth: int, top: list[np.ndarray]) -> np.ndarray:
    return subtree(keys, counts, depth, top).astype(np.float32) if kind == 0 else counts


def _answers(depth: int, top: list[np.ndarray]):
    """Of buckets with a single salt: model and asked places are in one row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield _said(r.kind, r.bucket, _valued(r.kind, unpack(r.keys, True), unpack(r.counts), depth, top), r.blocks, r.places)

    return run


def _salted_answers(depth: int, top: list[np.ndarray]):
    def run(key: tuple, model: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"block": [], "kind": [], "bucket": [], "values": []})
        keys = unpack(model["keys"].iloc[0], True)
        values = _valued(key[0], keys, unpack(model["counts"].iloc[0]), depth, top)
        one = asked.iloc[0]
        return _said(key[0], key[1], values[np.searchsorted(keys, unpack(one["keys"], True))], one["blocks"], one["places"])

    return run


def answered(one: np.ndarray, bucket: np.ndarray, said: dict, kind: int, buckets: int) -> np.ndarray:
    """A block's answers in the order of its sorted distinct values ``one``."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    table = np.zeros(len(one))
    for b in range(buckets):
        pick = order[edges[b]:edges[b + 1]]
        if len(pick):
            data = said[kind, b]
            table[pick] = unpack_floats(data) if kind == 0 else unpack(data)
    return table


def text_sums(keys: np.ndarray, sizes: np.ndarray, one: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of ``table`` over the windows of each text (``sizes`` of them each).

    Windows leave the lowest byte of a word free once shifted: 256 texts at a time
    carry their number there, so that one plain sort brings equal windows
    together and still tells whose they are.
    """
    sums, ends = np.zeros(len(sizes)), np.cumsum(sizes)
    for at in range(0, len(sizes), 256):
        own = sizes[at:at + 256]
        lo, hi = ends[at] - own[0], ends[at + len(own) - 1]
        mixed = np.sort((keys[lo:hi] << np.uint64(8)) | np.repeat(np.arange(len(own), dtype=np.uint64), own))
        value, owner = mixed >> np.uint64(8), (mixed & np.uint64(255)).astype(np.int64)
        first = firsts(value)
        worth = np.repeat(table[np.searchsorted(one, value[first])], np.diff(first, append=len(value)))
        sums[at:at + len(own)] = np.bincount(owner, weights=worth, minlength=len(own))
    return sums


def _summed(depth: int, buckets: int):
    def run(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts = [text_bytes(t) for t in rows["text"]]
        said = {(k, b): v for k, b, v in zip(answers["kind"], answers["bucket"], answers["values"])}
        sizes = np.array([len(t) + 1 for t in texts])
        keys = windows(texts, depth)
        rising = np.sort(keys)
        one = rising[firsts(rising)]
        logp = text_sums(keys, sizes, one, answered(one, bucket_of(one, depth, buckets), said, 0, buckets))
        tokens, owner = tokens_of(texts)
        words, back = np.unique(tokens, return_inverse=True)
        c = answered(words, word_bucket(words, buckets), said, 1, buckets)[back]
        total = lambda w: np.bincount(owner, weights=w, minlength=len(texts))
        return pd.DataFrame({"doc_id": rows["doc_id"], "train": rows["train"], "n_tokens": np.bincount(owner, minlength=len(texts)),
                             "n_known": total(c > 0).astype(np.int64), "n_bytes": sizes - 1, "word_part": total(np.log10(c + 0.1)), "score": logp / math.log(10)})

    return run


def scores(docs: DataFrame, train: Column, depth: int = 6, block_bytes: int = 6_000_000, bucket_bytes: int = 64_000_000) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of ``docs`` (doc_id, text).

    The model learns from the rows where ``train`` holds: its context counts and
    word counts cover all of them. ``score`` is log10 of the probability of the
    lower-cased bytes and the end of a text, ``bits_per_byte`` the code length;
    ``base_score`` that of a word model with additive smoothing. Null texts are
    empty; an empty text has its end only. Without training rows every bit has
    probability one half. Contexts of 0 to ``depth`` bytes (2 to 6) are mixed. Repeated
    rows and ids are scored as rows of their own; other columns are not read.
    Work and shuffled tables grow with the texts; a bucket holds distinct windows,
    whose counts reach it pre-added per salt, and there is one more bucket for
    every ``bucket_bytes`` of text beyond 64 times that.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = max(BUCKETS, -(-size // bucket_bytes))
    salts = max(1, -(-blocks // 64))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)))
    shape = "kind int, bucket int, keys binary, counts binary"
    asked = dealt.groupBy("block").applyInPandas(_asked(depth, buckets, salts), "kind int, bucket int, salt int, block bigint, keys binary, counts binary")
    part = stored(asked.groupBy("kind", "bucket", "salt").applyInPandas(
        _merged, "kind int, bucket int, salt int, keys binary, counts binary, blocks array<bigint>, places array<binary>"), "windows")
    counted = part.select("kind", "bucket", "keys", "counts")
    model = stored(counted.groupBy("kind", "bucket").applyInPandas(_added, shape), "counts") if salts > 1 else counted
    sums = (model.where("kind = 0").mapInPandas(_top_parts(depth), "spot int, zeros double, ones double, inner double")
            .groupBy("spot").agg(F.sum("zeros").alias("z"), F.sum("ones").alias("o"), F.sum("inner").alias("s")).toPandas())  # 256 x 255 rows at most
    totals = np.zeros((256 * 256, 3))
    totals[sums["spot"].to_numpy(np.int64)] = sums[["z", "o", "s"]].to_numpy(float)
    top = upper_levels(totals.reshape(256, 256, 3))

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for counts in batch["counts"]:
                c = unpack(counts)
                yield pd.DataFrame({"n": [int(c.sum())], "v": [int((c > 0).sum())]})

    total = model.where("kind = 1").mapInPandas(known, "n bigint, v bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    form = "block bigint, kind int, bucket int, values binary"
    if salts > 1:
        spread = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        said = (spread.groupBy("kind", "bucket", "salt").cogroup(part.drop("counts").groupBy("kind", "bucket", "salt"))
                .applyInPandas(_salted_answers(depth, top), form))
    else:
        said = part.mapInPandas(_answers(depth, top), form)
    found = dealt.groupBy("block").cogroup(said.groupBy("block")).applyInPandas(
        _summed(depth, buckets), "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, n_bytes bigint, word_part double, score double")
    smooth = math.log10(total["n"] + 0.1 * (total["v"] + 1))
    return found.select("doc_id", "train", "n_tokens", "n_known", F.lit(total["n"]).cast("bigint").alias("train_tokens"),
                        (F.col("word_part") - F.col("n_tokens") * smooth).alias("base_score"), "score",
                        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
