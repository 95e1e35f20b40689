"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from restartlab.llm.common import let_go

UNKNOWN = "und"
LETTER = r"\p{L}"
GATES = 3  # update, reset, candidate
SHORT = 64  # bytes that one window spans
WIDE = 4096  # windows in one step of prediction


@dataclass
class Network:
    """Weights of both directions: byte tables (2, 3, 256, h), recurrent (2, 3, h, h), outputs (2, h, labels), bias."""

    labels: list[str]
    table: np.ndarray
    turn: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _step(table, turn, codes, h):
    """One gated step for all rows; also gives what the backward pass needs."""
    z = np.tanh(table[0][codes] + h @ turn[0]) * 0.5 + 0.5
    r = np.tanh(table[1][codes] + h @ turn[1]) * 0.5 + 0.5
    u = h @ turn[2]
    n = np.tanh(table[2][codes] + r * u)
    return h + z * (n - h), (z, r, u, n, h)


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray):
    """Cross entropy at every position of windows x (rows, time), by backpropagation through time."""
    rows, time = x.shape
    hidden, kept = np.empty((2, time, rows, net.turn.shape[-1]), np.float32), [[None] * time for _ in range(2)]
    for side in range(2):
        h = np.zeros((rows, net.turn.shape[-1]), np.float32)
        for t in (range(time) if side == 0 else range(time - 1, -1, -1)):
            h, kept[side][t] = _step(net.table[side], net.turn[side], x[:, t], h)
            hidden[side, t] = h
    logits = hidden[0] @ net.out[0] + hidden[1] @ net.out[1] + net.bias
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    weight = mask.T / max(mask.sum(), 1)
    loss = -(np.log(np.take_along_axis(p, y[None, :, None], 2)[..., 0] + 1e-9) * weight).sum()
    d = p.copy()
    d[:, np.arange(rows), y] -= 1
    d *= weight[..., None]
    flat = x.T.reshape(-1)
    grads = [np.zeros_like(net.table), np.zeros_like(net.turn), np.zeros_like(net.out), d.sum((0, 1))]
    for side in range(2):
        grads[2][side] = np.einsum("trh,trl->hl", hidden[side], d)
        back = np.zeros((rows, net.turn.shape[-1]), np.float32)
        pushed = np.empty((GATES, time, rows, net.turn.shape[-1]), np.float32)
        for t in (range(time - 1, -1, -1) if side == 0 else range(time)):
            z, r, u, n, h = kept[side][t]
            g = back + d[t] @ net.out[side].T
            dn = g * z * (1 - n * n)
            pre = ((g * (n - h)) * 2 * z * (1 - z), dn * u * 2 * r * (1 - r), dn)
            back = g * (1 - z)
            for k, (a, b) in enumerate(((pre[0], pre[0]), (pre[1], pre[1]), (dn, dn * r))):
                pushed[k][t] = a
                grads[1][side, k] += h.T @ b
                back += b @ net.turn[side, k].T
        for k in range(GATES):
            for unit in range(net.turn.shape[-1]):
                grads[0][side, k, :, unit] = np.bincount(flat, weights=pushed[k, :, :, unit].reshape(-1), minlength=256)
    return loss, grads


def train(texts: list[bytes], labels: list[str], hidden: int = 8, epochs: int = 4, rate: float = 0.03, seed: int = 7) -> Network:
    """Fit the network to labelled byte snippets with Adam; the same rows give the same weights."""
    names = sorted(set(labels))
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Network(names, rng.normal(0, 0.3, (2, GATES, 256, hidden)).astype(np.float32),
                  rng.normal(0, 0.3, (2, GATES, hidden, hidden)).astype(np.float32),
                  rng.normal(0, 0.3, (2, hidden, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    if len(names) < 2:
        return net
    cut = [(t[i:i + SHORT], l) for t, l in zip(texts, labels) for i in range(0, len(t), SHORT) if t[i:i + SHORT].strip()]
    x = np.zeros((len(cut), SHORT), np.uint8)
    for i, (t, _) in enumerate(cut):
        x[i, :len(t)] = np.frombuffer(t, np.uint8)
    y = np.array([names.index(l) for _, l in cut])
    mask = (x != 0).astype(np.float32)
    weights = [net.table, net.turn, net.out, net.bias]
    one, two, n = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    steps = epochs * -(-len(cut) // 256)
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for at in range(0, len(order), 256):
            pick = order[at:at + 256]
            _, grads = _gradients(net, x[pick], y[pick], mask[pick])
            n += 1
            now = rate * min(1, 2 * (1 - (n - 1) / steps))
            for w, g, m, v in zip(weights, grads, one, two):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= now * (m / (1 - 0.9 ** n)) / (np.sqrt(v / (1 - 0.99 ** n)) + 1e-7)
    return net


def _side(net: Network, side: int, codes: np.ndarray, logits: np.ndarray) -> None:
    """Add one direction's share to the logits (time, labels, rows) of windows codes (time, rows)."""
    (tz, tr, tn), (uz, ur, un), out = net.table[side], net.turn[side], net.out[side]
    h = np.zeros((codes.shape[1], net.turn.shape[-1]), np.float32)
    for t in (range(len(codes)) if side == 0 else range(len(codes) - 1, -1, -1)):
        c = codes[t]
        z = tz.take(c, axis=0)
        z += h @ uz
        np.tanh(z, out=z)
        z *= 0.5
        z += 0.5
        r = tr.take(c, axis=0)
        r += h @ ur
        np.tanh(r, out=r)
        r *= 0.5
        r += 0.5
        r *= h @ un
        r += tn.take(c, axis=0)
        np.tanh(r, out=r)
        r -= h
        r *= z
        h += r
        logits[t] += out.T @ h.T


def positions(net: Network, windows: np.ndarray) -> np.ndarray:
    """Label probabilities (rows, labels) summed over the non-zero bytes of each window (rows, time)."""
    total = np.zeros((len(windows), len(net.labels)), np.float32)
    for at in range(0, len(windows), WIDE):
        codes = np.ascontiguousarray(windows[at:at + WIDE].T)
        p = np.empty((len(codes), len(net.labels), codes.shape[1]), np.float32)
        p[:] = net.bias[:, None]
        _side(net, 0, codes, p)
        _side(net, 1, codes, p)
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p *= ((codes != 0) / p.sum(1))[:, None]
        total[at:at + WIDE] = p.sum(0).T
    return total


def document_probabilities(net: Network, texts: list, run: int = 500_000) -> np.ndarray:
    """Mean label probability over all byte positions of each whole text; zeros for an empty one."""
    pooled = np.zeros((len(texts), len(net.labels)))
    held, rows, size = [], [], 0

    def flush() -> None:
        codes = np.zeros((sum(rows_of for _, rows_of in rows), SHORT), np.uint8)
        at = 0
        for (_, count), data in zip(rows, held):
            codes[at:at + count].reshape(-1)[:len(data)] = np.frombuffer(data, np.uint8)
            at += count
        sums = positions(net, codes)
        owner = np.repeat([i for i, _ in rows], [c for _, c in rows])
        np.add.at(pooled, owner, sums)
        held.clear(), rows.clear()

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, len(data), run):  # a very long text goes in runs of whole windows
            piece = data[at:at + run - run % SHORT] if len(data) > run else data
            held.append(piece)
            rows.append((i, -(-len(piece) // SHORT)))
            size += len(piece)
            if size >= run:
                flush()
                size = 0
            if len(data) <= run:
                break
    if rows:
        flush()
    return pooled / np.maximum(pooled.sum(1, keepdims=True), 1e-12)


def fit(docs: DataFrame, allowed: Column | None = None, per_language: int = 800, snippet: int = 256) -> Network:
    """Train on a bounded sample: at most ``per_language`` labelled rows of each language, one snippet of each.

    ``docs`` has doc_id, text, lang; ``allowed`` says which rows may be learned
    from. Rows are picked by the hash of text and id, snippets by the hash of the text.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    rows = rows.where(allowed) if allowed is not None else rows
    turn = F.xxhash64(F.col("doc_id"), F.col("text"))
    start = F.pmod(turn, F.greatest(F.length("text") - snippet, F.lit(0)) + 1) + 1
    picked = (rows.select("lang", turn.alias("turn"), F.substring("text", start.cast("int"), F.lit(snippet)).alias("part"))
              .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "part"))).where(F.col("n") <= per_language)
              .select("lang", "turn", "part").collect())
    picked.sort(key=lambda r: (r["lang"], r["turn"], r["part"]))
    return train([r["part"].encode("utf-8", "surrogatepass") for r in picked], [r["lang"] for r in picked])


def language_of(net: Network, text: Column) -> Column:
    """struct(lang, score) of each whole text; the network runs in numpy over Arrow batches."""

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*net.labels, UNKNOWN], object)
        for texts in batches:
            if not net.labels or not len(texts):
                yield pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
                continue
            p = document_probabilities(net, texts.tolist())
            yield pd.DataFrame({"lang": names[p.argmax(1)], "score": np.clip(p.max(1), 0, 1)})
        texts = None
        let_go()

    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    return F.when(F.coalesce(text.rlike(LETTER), F.lit(False)), predicted(text)).otherwise(none)


def identify(docs: DataFrame, allowed: Column | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text, lang).

    Every byte position gets label probabilities from both directions of the
    network; a document's are their mean. Null texts and texts without a letter
    are ``und`` with score 0, and so is every text if there is nothing to learn from.
    """
    net = fit(docs, allowed)
    found = docs.select("doc_id", language_of(net, F.col("text")).alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_known(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Rows whose text has a known language with at least ``min_score``; columns unchanged."""
    net = fit(docs)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*cols).alias("__row"), language_of(net, F.col("text")).alias("__found"))
    return named.where((F.col("__found.lang") != UNKNOWN) & (F.col("__found.score") >= min_score)).select("__row.*")
