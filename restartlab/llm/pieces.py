"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, functions as F

from restartlab.llm.common import MIX, let_go, mix64, parts

GAP = "▁"  # how a space is written inside pieces


class Vocabulary:
    """Pieces of a BPE model file: ids, merge ranks and the bytes that each id stands for."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(count)]
        plain = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.rank = {names[i]: -model.get_score(i) for i in plain}
        self.byte_ids = [0] * 256
        self.bytes_of = [b""] * count
        for i in plain:
            self.bytes_of[i] = names[i].replace(GAP, " ").encode()
        for i in range(count):
            if model.is_byte(i):
                value = int(names[i][3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
        self.code = np.full(0x110000, -1, np.int32)  # id of every single character
        for i in plain:
            if len(names[i]) == 1 and names[i] != GAP:
                self.code[ord(names[i])] = i
        self.code[32] = self.ids.get(GAP, -1)
        pairs, results = array("q"), array("i")
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = self.ids.get(p[:k]), self.ids.get(p[k:])
                if left is not None and right is not None:
                    pairs.append(left * count + right)
                    results.append(i)
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pair, self.result = np.array(pairs, np.int64)[order], np.array(results, np.int32)[order]
        if not len(self.pair):
            self.pair, self.result = np.array([-1], np.int64), np.array([0], np.int32)
        self.order = np.full(count, np.inf, np.float32)
        self.order[plain] = [self.rank[names[i]] for i in plain]
        self.count = count
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.buffer = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        if any(GAP in p[1:] and p.strip(GAP) and GAP in p.lstrip(GAP) for p in self.ids):
            raise ValueError("a piece spans a letter and a following space; units would not be independent")
        if 0 in self.byte_ids:
            raise ValueError("the model has no byte pieces, so decoding could not be lossless")
        del model, names
        let_go()

    def segment(self, unit: str, dropout: float, seed: int) -> list[int]:
        """Ids of one unit. Candidate merges leave the agenda by rank, then from left to right.

        A candidate is skipped if the keyed hash of (seed, place, piece) is below
        ``dropout``; it returns only if a neighbour changes. With 0 this is plain BPE.
        """
        # a literal U+2581 is no space: it has no piece here and goes out as bytes
        parts_: list[str | None] = [GAP if c == " " else "\0" + c if c == GAP else c for c in unit]
        n, rank = len(parts_), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            both = parts_[i] + parts_[i + 1]
            if both in rank:
                agenda.append((rank[both], i, both))
        heapify(agenda)
        bound = int(dropout * 2**32)
        while agenda:
            _, i, both = heappop(agenda)
            left = parts_[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or left + parts_[j] != both:
                continue
            if bound and _chance_of(seed, i, self.ids[both]) < bound:
                continue
            parts_[i], parts_[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = both + parts_[k]
                if new in rank:
                    heappush(agenda, (rank[new], i, new))
            h = before[i]
            if h >= 0:
                new = parts_[h] + both
                if new in rank:
                    heappush(agenda, (rank[new], h, new))
        out = []
        for p in parts_:
            if p is not None:
                at = self.ids.get(p)
                out += [at] if at is not None else [self.byte_ids[b] for b in p.lstrip("\0").encode("utf-8", "surrogatepass")] if p != "\0" else [self.byte_ids[0]]
        return out

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two neighbours make, or -1."""
        key = left.astype(np.int64) * self.count + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.result[at], -1)

    def segment_many(self, symbols: np.ndarray, dropout: float, seeds: np.ndarray, path: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``segment`` for many short units at once: in every round each unit takes the head of its agenda.

        ``symbols`` (units, width) has the ids of the characters, -2 - code point
        for those without a piece, -1 beyond a unit's end. Gives all ids in one
        array, and how many each unit has. ``path`` takes (unit, place, piece) of
        the merges of every round.
        """
        count, wide = symbols.shape
        width = wide + 2  # a column before and one after, without merges
        grid = np.full((count, width), -1, np.int32)
        grid[:, 1:-1] = symbols
        coming = np.full((count, width), -1, np.int32)  # piece that a symbol makes with the next one
        coming[:, :-1] = self.merged(grid[:, :-1], grid[:, 1:])
        order = np.where(coming >= 0, self.order[coming], np.inf).astype(np.float32)
        after = np.broadcast_to(np.arange(1, width + 1), grid.shape).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), grid.shape).copy()
        bound, rows = int(dropout * 2**32), np.flatnonzero((coming >= 0).any(1))
        while len(rows):
            at = order[rows].argmin(1)
            going = order[rows, at] < np.inf
            rows, at = rows[going], at[going]
            r, a = rows, at
            if bound:
                skip = chance(seeds[rows], at - 1, coming[rows, at]) < bound
                order[rows[skip], at[skip]] = np.inf
                r, a = rows[~skip], at[~skip]
            if path is not None:
                path.append((r, a - 1, coming[r, a]))
            new, gone = coming[r, a], after[r, a]
            follow, ahead = after[r, gone], before[r, a]
            grid[r, a], grid[r, gone], order[r, gone] = new, -1, np.inf
            after[r, a], before[r, follow] = follow, a
            for spot, made in ((a, self.merged(new, grid[r, follow])), (ahead, self.merged(grid[r, ahead], new))):
                coming[r, spot] = made
                order[r, spot] = np.where(made >= 0, self.order[made], np.inf)
        kept = grid != -1
        return self._with_bytes(grid[kept], kept.sum(1))

    def _with_bytes(self, flat: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece are written as their bytes."""
        bare = np.flatnonzero(flat < 0)
        if not len(bare):
            return flat, many
        point = -2 - flat[bare]
        size = np.ones(len(flat), np.int64)
        size[bare] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        out = np.repeat(flat, size)
        start = np.cumsum(size) - size
        for one in np.unique(point):
            spots = start[bare[point == one]]
            for k, b in enumerate(chr(one).encode("utf-8", "surrogatepass")):
                out[spots + k] = self.byte_ids[b]
        return out, np.add.reduceat(size, np.cumsum(many) - many)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ``ids``; the space put before every text is taken away again."""
        return self.decode_all(np.asarray(ids, np.int32), [len(ids)])[0]

    def decode_all(self, ids: np.ndarray, counts: list[int]) -> list[str]:
        """Texts of consecutive runs of ``ids``: the bytes of all pieces are gathered at once."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        whole = self.buffer[ragged(self.starts[ids], size)].tobytes()
        stops = np.concatenate([[0], ends])[np.cumsum([0, *counts])].tolist()
        return [whole[b + 1:e].decode("utf-8", "surrogatepass") for b, e in zip(stops, stops[1:])]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... of runs with the given sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def chance(seed, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Keyed 32-bit hash of a candidate merge."""
    start = np.asarray(seed).astype(np.uint64) * MIX
    return mix64(mix64(start + place.astype(np.uint64)) + piece.astype(np.uint64)) >> np.uint64(32)


def _chance_of(seed: int, place: int, piece: int) -> int:
    """``chance`` of a single candidate."""
    full = 2**64 - 1
    def mix(x: int) -> int:
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)
    return mix((mix((seed * int(MIX) + place) & full) + piece) & full) >> 32


class Encoder:
    """Encodes texts; every place of every document has its own seed.

    Remembered while the cache is small is only what no seed changes: the ids of
    a unit without dropout, and the merges that lead there. A place whose seed
    skips none of these merges has those ids; all others are segmented anew.
    """

    def __init__(self, path: str, dropout: float, seed: int, cached: int = 100_000, short: int = 64):
        self.words, self.dropout, self.seed, self.short, self.cached = Vocabulary(path), dropout, seed, short, cached
        self._forget()

    def _forget(self) -> None:
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.place, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)  # merges of all units
        self.first, self.steps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _segment(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, dropout: float, seeds: np.ndarray, merges: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the given units of ``codes`` in one array, how many each has, and where they begin; ``merges`` takes (unit, place, piece)."""
        runs, counts, place = [np.zeros(0, np.int32)], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        done = 0
        for i in np.flatnonzero(sizes > self.short):
            unit = codes[starts[i]:starts[i] + sizes[i]].tobytes().decode("utf-32-le", "surrogatepass")
            runs.append(np.array(self.words.segment(unit, dropout, int(seeds[i])), np.int32))
            counts[i], place[i] = len(runs[-1]), done
            done += len(runs[-1])
        rest = np.flatnonzero(sizes <= self.short)
        rest = rest[np.argsort(sizes[rest], kind="stable")]
        for at in range(0, len(rest), 8192):
            pick = rest[at:at + 8192]
            wide = int(sizes[pick[-1]])
            part = codes[np.minimum(starts[pick][:, None] + np.arange(wide), len(codes) - 1)]
            ids = self.words.code[part]
            ids = np.where(ids < 0, -2 - part.astype(np.int32), ids)
            ids[np.arange(wide)[None, :] >= sizes[pick][:, None]] = -1
            path = None if merges is None else []
            flat, many = self.words.segment_many(ids, dropout, seeds[pick], path)
            if path:
                merges += [(pick[r], a, made) for r, a, made in path]
            counts[pick], place[pick] = many, done + np.cumsum(many) - many
            runs.append(flat)
            done += len(flat)
        return np.concatenate(runs), counts, place

    def _learn(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> None:
        """Put units into the cache."""
        merges = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        ids, counts, place = self._segment(codes, starts, sizes, 0.0, np.zeros(len(starts), np.uint64), merges)
        unit, spot, piece = (np.concatenate(m) for m in zip(*merges))
        by_unit = np.argsort(unit, kind="stable")
        steps = np.bincount(unit, minlength=len(starts))
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every)
        self.starts = np.concatenate([self.starts, len(self.flat) + place])[order]
        self.sizes = np.concatenate([self.sizes, counts])[order]
        self.first = np.concatenate([self.first, len(self.place) + np.cumsum(steps) - steps])[order]
        self.steps = np.concatenate([self.steps, steps])[order]
        self.keys, self.flat = every[order], np.concatenate([self.flat, ids])
        self.place = np.concatenate([self.place, spot[by_unit].astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece[by_unit]])

    def _skips(self, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Whether a seed skips any of the merges of a cached unit."""
        out = np.zeros(len(at), bool)
        steps = self.steps[at]
        spots = ragged(self.first[at], steps)
        hit = chance(np.repeat(seeds, steps), self.place[spots], self.piece[spots]) < int(self.dropout * 2**32)
        out[np.repeat(np.arange(len(at)), steps)[hit]] = True
        return out

    def encode(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; ``keys`` (of the documents) and the place of a unit are its seed."""
        total = np.zeros(len(texts), np.int64)
        codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), total
        full = np.array([i for i, t in enumerate(texts) if t])
        lengths = np.array([len(texts[i]) + 1 for i in full])
        begin = np.cumsum(lengths) - lengths
        gap = codes == 32
        first = gap.copy()
        first[1:] &= ~gap[:-1]
        first[begin] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(starts, append=len(codes))
        doc = np.searchsorted(begin, starts, side="right") - 1
        nth = (np.arange(len(starts)) - np.searchsorted(starts, begin)[doc]).astype(np.uint64)
        key = (np.array([keys[i] for i in full], np.uint64) ^ mix64(np.array([self.seed & (2**64 - 1)], np.uint64) * MIX))[doc]
        seeds = mix64(nth * MIX + key)
        inner = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
        unit = np.add.reduceat(mix64((inner << np.uint64(21)) + codes), starts)
        unit = mix64(unit + (sizes.astype(np.uint64) << np.uint64(40)))
        plain = np.ones(len(starts), bool) if self.dropout <= 0 else sizes <= self.short  # a long unit almost surely skips a merge
        wanted, where, back = np.unique(unit[plain], return_index=True, return_inverse=True)
        where = np.flatnonzero(plain)[where]
        if len(self.keys) > self.cached:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        new = where if not len(self.keys) else where[self.keys[at] != wanted]
        if len(new):
            self._learn(codes, starts[new], sizes[new], unit[new])
        at = np.searchsorted(self.keys, wanted)[back]
        anew = ~plain
        if self.dropout > 0:
            anew[plain] = self._skips(at, seeds[plain])
        begins, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begins[plain], size[plain] = self.starts[at], self.sizes[at]
        ids, size[anew], place = self._segment(codes, starts[anew], sizes[anew], self.dropout, seeds[anew])
        begins[anew] = len(self.flat) + place
        total[full] = np.add.reduceat(size, np.searchsorted(doc, np.arange(len(full))))
        return np.concatenate([self.flat, ids])[ragged(begins, size)], total


def _encoded(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, dropout, seed)
        for part in parts(batches, "text", 250_000):
            texts = [t or "" for t in part["text"].tolist()]
            ids, counts = encoder.encode(texts, [xxhash.xxh3_64_intdigest(str(d)) for d in part["doc_id"].tolist()])
            same = [a == b for a, b in zip(encoder.words.decode_all(ids, counts.tolist()), texts)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "pieces": np.split(ids, np.cumsum(counts)[:-1]), "n_pieces": counts, "lossless": same})

    return run


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, pieces, n_pieces, lossless for every row of ``docs`` (doc_id, text).

    Each candidate merge of a word is skipped with chance ``dropout`` by a keyed
    hash. The seed of a word is a hash of its document and place, so every
    occurrence of a word is cut on its own and every run repeats it.
    ``lossless`` says that the decoded pieces give the text back. Null and
    empty texts have no pieces. Whole texts are encoded; nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInPandas(
        _encoded(model, dropout, seed), "doc_id bigint, pieces array<int>, n_pieces bigint, lossless boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows (doc_id, pieces); null pieces give a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Vocabulary(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [None if p is None else words.decode(p) for p in batch["pieces"]]})

    return encoded.select("doc_id", "pieces").mapInPandas(run, "doc_id bigint, text string")
