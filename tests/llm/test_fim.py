"""Fill-in-the-middle cuts against a plain regular expression, every rank of small lists, exact round trips."""

import hashlib
import re

import numpy as np
import pytest

from restartlab.llm import fim

SCHEMA = "doc_id bigint, text string, n bigint, form string, h1 string"
TEXTS = ["", None, "a", "ab cd", "über straße 12\nx", "𝒳𝒴 mixed é́ combining", "has <P> inside", "ends with <", "<", "P>", "S> odd <", "1234567890",
         "word " * 20_000, "z" * 100_000, "\r\n\t\x00\x1c", "<M", "tie", "tie"]


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_every_rank_is_reached_through_the_lanes():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 8, 9, 40, 700):
        widths = rng.integers(1, 9, n)
        units = fim.SkipList(widths)
        assert [units.seek(r) for r in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
        for lane in range(1, len(units.units)):  # a lane's links add up to the same places as the towers they end at
            ends = np.cumsum(units.units[lane])
            assert np.array_equal(np.cumsum(units.units[lane - 1])[units.down[lane]], ends)
    assert len(fim.SkipList(np.ones(20_000)).units) > 4
    with pytest.raises(ValueError):
        fim.SkipList(np.ones(3)).seek(4)


def test_rows_equal_a_plain_cut_and_are_restored(spark):
    rows = [(i, t, 7, "x", "y") for i in range(0, 400, 20) for i, t in zip(range(i, i + 40), TEXTS)] + [(None, "no id here", 1, "", ""), (3, "again", 1, "", "")] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    out = fim.transform(docs).cache()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    want = sorted((i is None, i or 0, *plain(i, t)) for i, t, *_ in rows)
    assert [tuple(str(x) for x in g) for g in got] == [tuple(str(x) for x in w) for w in want]
    assert {g[3] for g in got} == {"plain", "psm", "spm"}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.restored_sha256 for r in out.collect()) == sorted(digest(t) for _, t, *_ in rows)
    assert all(digest(r.output) == r.output_sha256 for r in out.collect())
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in fim.restore(out).collect())
    assert back == sorted((i is None, i or 0, t or "") for i, t, *_ in rows)
    out.unpersist()


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []
