"""Text operators against brute force, public libraries and exact round trips; nulls, empty tables, repeated rows, clashing columns."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from restartlab.llm import ctw, decontaminate, fingerprint, htmltext, language, near_dup, pieces, pseudonyms, sharding, toxicity
from restartlab.llm.common import WordHash
from restartlab.llm.queries import KEY, NEAR_DUPLICATES_SQL, TOKENIZER
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, region string"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = ["la", "der", "the", "of", "une", "und", "river", "haus", "maison", "stone", "green", "blau", "rouge", "tree", "walk", "seven"]
    texts = []
    for i in range(n):
        texts.append(" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 120))))
    for i in range(0, n, 4):  # near copies
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[1], texts[1].upper(), "", None, "one", "one two", "word " * 3000, "\x1c odd\x85space\xa0here now"]
    return texts


def frame(spark, texts, ids=None):
    rows = [(i, t, ["en", "de", None][k % 3], f"s{k % 4}", 1, 0.5, False, "x") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k, percent):
    sets, root = [shingles(t, k) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("k,percent,block", [(3, 85, 256), (5, 80, 4)])
def test_near_duplicates_equal_brute_force(spark, k, percent, block):
    texts = corpus() + [" ".join(f"w{j}" if j != c else f"x{c}" for j in range(90)) for c in range(25)]
    rows = near_dup.near_duplicates(frame(spark, texts), k, percent, block=block).orderBy("doc_id").collect()
    roots, sizes = brute_components(texts, k, percent)
    assert [r.component_id for r in rows] == roots
    assert [r.n_shingles for r in rows] == sizes
    assert [r.kept for r in rows] == [i == c for i, c in enumerate(roots)]


def test_signature_guarantee():
    chunks, rng = near_dup.chunks_for(85), random.Random(1)
    assert chunks == 8
    for _ in range(200):  # at most 2 * chunks - 1 errors leave a chunk with one at most
        errors = Counter(s // near_dup.SLOTS for s in rng.sample(range(chunks * near_dup.SLOTS), 2 * chunks - 1))
        assert min(errors.get(c, 0) for c in range(chunks)) <= 1


def test_keep_one_with_nulls_and_repeats(spark):
    texts = ["a b c d e f", "a b c d e f", "a b c d e f", None, None, "", "z y x w v u"]
    df = frame(spark, texts, [5, 5, 2, None, None, 7, 8])
    got = near_dup.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 2), (False, 7), (False, 8), (True, 0), (True, 0)]
    assert near_dup.keep_one(df.where("false")).count() == 0


def test_masks_cover_all_substitutions():
    size, errors = decontaminate.WINDOW, decontaminate.ERRORS
    for bad in itertools.combinations(range(size), errors):
        assert any(all(at + i not in bad for i, one in enumerate(m) if one == "1") for m in decontaminate.MASKS for at in range(size - len(m) + 1))
    for n in range(1, 13):  # and whatever words of a shorter item differ, as many as it may
        masks = decontaminate.masks_for(n)
        assert bool(masks) == (n > 2)
        for bad in itertools.combinations(range(n), decontaminate.errors_for(n)) if masks else ():
            assert any(all(i not in bad for i, one in enumerate(m) if one == "1") for m in masks)


def test_overlaps_equal_brute_force(spark):
    rng, memo = random.Random(5), WordHash()
    items = [" ".join(f"q{rng.randrange(400)}" for _ in range(n)) for n in (30, 18, 13, 9, 6, 4, 7, 12, 2, 3)] + [None, ""]
    docs = []
    for i in range(100):
        w = [f"q{rng.randrange(400)}" for _ in range(80)]
        item = items[i % 10].split()
        part = item[:13] if len(item) > 13 and i % 2 else item
        for s in rng.sample(range(len(part)), min(i // 20, len(part))):
            part[s] = "other"
        w[10:10 + len(part)] = part
        docs.append(" ".join(w).upper() if i % 3 else ", ".join(w))
    docs += [None, "", "q1"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.matched_words, r.first_word) for r in decontaminate.overlaps(frame(spark, docs), bench).collect()}
    want = {}
    for d, text in enumerate(docs):
        w = decontaminate.tokens_of(text, memo)
        for b, item in enumerate(items):
            x = decontaminate.tokens_of(item, memo)
            size = min(13, len(x))
            if len(x) < 3 or len(w) < size:
                continue
            best = max((int((w[i:i + size] == x[j:j + size]).sum()), -i) for i in range(len(w) - size + 1) for j in range(len(x) - size + 1))
            if best[0] >= size - (3 if len(x) >= 13 else 2 if len(x) > 8 else 1 if len(x) > 6 else 0):
                want[d, b] = (best[0], -best[1])
    assert got == want and len(want) > 40 and {b for _, b in want} == {0, 1, 2, 3, 4, 5, 6, 7, 9}
    df = frame(spark, docs)
    left = decontaminate.without_benchmark(df, bench)
    assert left.columns == df.columns and left.count() == len(docs) - len({d for d, _ in want})
    assert decontaminate.overlaps(df, bench.where("false")).count() == 0
    assert decontaminate.overlaps(df.where("false"), bench).count() == 0


def test_pseudonyms_validate_and_return(spark):
    texts = ["card 4111 1111 1111 1111, 4111111111111111 not 4111111111111112.", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000",
             "ssn 123-45-6789 not 666-45-6789", "1.2.3.4 not 300.1.1.1", "2021-03-04 04.03.2021 3/4/2021 not 2021-02-30", "+1 (415) 555-7713 415-555-1234",
             "mail ab.92@mail6.example.com", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "nothing\nhere\n", "", None]
    df = frame(spark, texts)
    once = pseudonyms.pseudonymise(df, KEY)
    new = [r.text for r in once.orderBy("doc_id").collect()]
    back = [r.text for r in pseudonyms.pseudonymise(once, KEY, inverse=True).orderBy("doc_id").collect()]
    assert once.columns == df.columns and back == texts and new[8:] == texts[8:]
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10
    one, two, bad = new[0].split(",")[0][5:].replace(" ", ""), new[0].split(",")[1].split()[0], new[0].split()[-1]
    assert one == two != "4111111111111111" and luhn(one) == 0 and bad == "4111111111111112."
    iban = new[1].split(" and ")[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "GB"
    assert "666-45-6789" in new[2] and "123-45-6789" not in new[2] and "300.1.1.1" in new[3] and "2021-02-30" in new[4]
    a, b = new[4].split()[:2]
    assert a.split("-") == b.split(".")[::-1] and len({v for v in new[4].split()}) == 5
    counts = pseudonyms.values_of(df, KEY).orderBy("doc_id").collect()
    assert counts[0].found == 3 and counts[0].changed == 2 and counts[10].text is None and counts[10].found == 0
    assert pseudonyms.pseudonymise(df.where("false"), KEY).count() == 0


def test_dates_are_permuted_and_come_back(spark):
    """Every day of some years in every notation: one to one, back again, equal days equal, the reading kept."""
    import datetime

    days = [datetime.date(y, 1, 1) + datetime.timedelta(d) for y in (1900, 1999, 2000, 2024, 2099) for d in range(366)]
    days = sorted({d for d in days if d.year in (1900, 1999, 2000, 2024, 2099)})
    forms = [lambda d: f"{d:%Y-%m-%d}", lambda d: f"{d:%d.%m.%Y}", lambda d: f"{d:%m/%d/%Y}", lambda d: f"{d.day}.{d.month}.{d.year}", lambda d: f"{d.month}/{d.day}/{d.year}",
             lambda d: f"{d:%d/%m/%Y}" if d.day > 12 else f"{d:%Y/%m/%d}"]
    texts = [" ".join(f(d) for f in forms) for d in days]
    df = frame(spark, texts)
    once = pseudonyms.pseudonymise(df, KEY)
    new = [r.text for r in once.orderBy("doc_id").collect()]
    assert [r.text for r in pseudonyms.pseudonymise(once, KEY, inverse=True).orderBy("doc_id").collect()] == texts
    seen = set()
    for old, line in zip(days, new):
        parts = line.split()
        day = datetime.date.fromisoformat(parts[0])
        last = f"{day:%d/%m/%Y}" if old.day > 12 else f"{day:%Y/%m/%d}"
        assert parts == [*[f(day) for f in forms[:5]], last] and (day.day > 12) == (old.day > 12)
        seen.add(day)
    assert len(seen) == len(days) and sum(a == b for a, b in zip(days, sorted(seen))) < len(days) / 2


def test_feistel_permutes_small_sets_and_mail_keeps_its_case(spark):
    rows = spark.range(60).select("id", pseudonyms.permute_pair(F.col("id") % 6, 6, F.floor(F.col("id") / 6), 10, "k", "x").alias("p"))
    got = {(r.p.a, r.p.b) for r in rows.collect()}
    assert len(got) == 60 and max(a for a, _ in got) == 5 and max(b for _, b in got) == 9
    words = [f"{a}{b}" for a in "0123456789" for b in "0123456789"]
    new = {r.v for r in spark.createDataFrame([(w,) for w in words], "w string").select(pseudonyms.permute_string(F.col("w"), "0123456789", "k", "y").alias("v")).collect()}
    assert new == set(words)
    texts = ["Jörg.Müller7@Mail.example.org", "jörg.müller7@mail.example.org", "ÀÉ@a.de", "x@a.de", "иван.7@a.ru", "secret: abcdef0123456789"]
    df = frame(spark, texts)
    once = pseudonyms.pseudonymise(df, KEY)
    new = [r.text for r in once.orderBy("doc_id").collect()]
    assert [r.text for r in pseudonyms.pseudonymise(once, KEY, inverse=True).orderBy("doc_id").collect()] == texts
    assert new[0].split("@")[1] == "Mail.example.org" and new[0].split("@")[0].lower() == new[1].split("@")[0] and new[1] != texts[1]
    assert [c.isupper() for c in new[0]] == [c.isupper() for c in texts[0]] and new[2] != texts[2] and new[4].startswith("иван.")
    assert new[5] != texts[5] and len(new[5]) == len(texts[5])


def test_pseudonyms_find_values_before_other_signs(spark):
    """A card with a code, a date or a number beside it, and an IBAN with capitals after it; the way back finds the same reading."""
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    rest = lambda b: int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97
    rng, texts, values = random.Random(5), [], []

    def add(value, form):
        texts.append(form.format(value))
        values.append(value)

    add("4111 1111 1111 1111", "{} 123")
    add("4111111111111111", "pay {} 12/25")
    add("4111111111111111", "12 {}")
    add("ES9121000418450200051332", "{} BIC: X")
    add("ES91 2100 0418 4502 0005 1332", "{} BANK OF")
    for _ in range(40):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        code = next(c for c in "0123456789" if luhn(body + c))
        add(body + code, "{}" + f"-{rng.randrange(1000):03d}")
    texts.append("4111111111111112 123")
    df = frame(spark, texts)
    once = pseudonyms.pseudonymise(df, KEY)
    new = [r.text for r in once.orderBy("doc_id").collect()]
    assert [r.text for r in pseudonyms.pseudonymise(once, KEY, inverse=True).orderBy("doc_id").collect()] == texts
    assert all(v not in n and len(n) == len(t) for v, n, t in zip(values, new, texts)) and new[-1] == texts[-1]
    assert rest(new[3][:24]) == 1 and new[3].endswith(" BIC: X") and rest(new[4][:29].replace(" ", "")) == 1 and new[4].endswith(" BANK OF")


def test_pieces_equal_the_library_and_decode(spark):
    import sentencepiece

    texts = [*[t or "" for t in corpus(20)], "  two  spaces ", "a▁b ▁", "tab\tnew\nline \0 x", "日本語 😀 é", "x" * 300, "qé\n" * 40]
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    plain = pieces.Encoder(TOKENIZER, 0.0, 1, 4)
    ids, counts = plain.encode(texts, list(range(len(texts))))
    assert plain.words.decode_all(ids, counts.tolist()) == texts
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert "▁" in text or got.tolist() == library.encode(text)
    fast, slow = pieces.Encoder(TOKENIZER, 0.2, 9, 4), pieces.Encoder(TOKENIZER, 0.2, 9, 4, short=0)
    assert all((a == b).all() for a, b in zip(fast.encode(texts, [4] * len(texts)), slow.encode(texts, [4] * len(texts))))
    df = frame(spark, [*texts, None])
    rows = pieces.encode(df, TOKENIZER).orderBy("doc_id").collect()
    assert all(r.lossless for r in rows) and rows[-1].n_pieces == 0
    assert len({tuple(r.pieces[:40]) for r in pieces.encode(frame(spark, [texts[0]] * 8), TOKENIZER, dropout=0.3).collect()}) > 1
    again = pieces.decode(pieces.encode(df, TOKENIZER), TOKENIZER).orderBy("doc_id").collect()
    assert [r.text for r in again] == [*texts, ""]


def test_every_occurrence_has_its_own_cut():
    encoder = pieces.Encoder(TOKENIZER, 0.1, 1)
    ids, counts = encoder.encode([" ".join(["international"] * 3000)] * 2, [5, 6])
    words = encoder.words
    cuts = Counter()
    for part in np.split(ids, np.cumsum(counts)[:-1]):
        one = []
        for i in part.tolist():
            if one and words.bytes_of[i].startswith(b" "):
                cuts[tuple(one)] += 1
                one = []
            one.append(i)
        cuts[tuple(one)] += 1
    plain = pieces.Encoder(TOKENIZER, 0.0, 1)
    whole, _ = plain.encode(["international"], [5])
    merges = int(plain.steps[0])
    share = cuts[tuple(whole.tolist())] / cuts.total()
    # plain at least when no merge on the way is skipped; a skipped one may lead there by another way
    assert cuts.total() == 6000 and len(cuts) > 10 and share > 0.9**merges - 0.03 and share < 0.9


def test_language_learns_and_rejects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(90001, None, "en"), (90002, "", "en"), (90003, "123 !!", None)], "doc_id bigint, text string, lang string")
    found = language.identify(docs.unionByName(odd), F.pmod("doc_id", F.lit(3)) != 1).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in found if r.doc_id % 3 == 1 and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    assert {(r.lang_pred, r.score) for r in found if r.doc_id in (90001, 90002, 90003)} == {("und", 0.0)}
    nothing = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang_pred == "und" for r in nothing)
    df = frame(spark, ["le chat", None, "99"])
    assert language.keep_known(df.where("false")).count() == 0 and language.keep_known(df).columns == df.columns


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = language.train([b"abc", b"xyz"], ["a", "b"], hidden=3, epochs=1)
    x, y, mask = rng.integers(1, 200, (4, 6)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((4, 6), np.float32)
    net.table, net.turn, net.out, net.bias = (w.astype(np.float64) for w in (net.table, net.turn, net.out, net.bias))
    _, grads = language._gradients(net, x, y, mask)
    for w, g in zip((net.turn, net.out, net.bias), grads[1:]):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        old = w[at]
        w[at] = old + 1e-3
        up = language._gradients(net, x, y, mask)[0]
        w[at] = old - 1e-3
        down = language._gradients(net, x, y, mask)[0]
        w[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 0.02 * max(0.02, abs(g[at]))


def test_main_text():
    model = htmltext.learn()
    page = ("<html><body><nav><a href=x>Home</a></nav><div class=ad>Buy now</div><article><h1>T &amp; U</h1><p><b>One&nbsp;two <br> three<p>Four.</p>"
            "<script>var x='<p>';</script></article><section class=comments><p>Nice article, thanks a lot</section><footer>&copy; me</footer>")
    assert htmltext.main_text(page, model) == "T & U\n\nOne two three\n\nFour."
    assert htmltext.main_text(None, model) == htmltext.main_text("", model) == htmltext.main_text("<p", model) == ""
    tree = htmltext.parse("<div><p>a<p>b</div><span>c")
    x = htmltext.described(tree)
    chance, _ = htmltext.marginals(model, tree, x)
    own, total, sums = x @ model.weight, 0.0, np.zeros(len(tree.tag))
    for state in itertools.product((0, 1), repeat=len(tree.tag)):  # all labellings
        w = math.exp(sum(s * o for s, o in zip(state, own)) + sum(model.pair[state[p], state[i]] for i, p in enumerate(tree.parent) if i))
        total, sums = total + w, sums + w * np.array(state)
    assert np.allclose(chance, sums / total)


def test_main_text_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<article><p>Hello there</p></article>"), (2, None, "")], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in htmltext.extract(pages).collect())
    assert got == [(1, "", 0), (2, "", 0), (2, "Hello there", 11)]
    assert htmltext.extract(pages.where("false")).count() == 0


def test_phrases_and_edits(spark):
    texts = corpus(30)
    rows = {r.doc_id: r for r in fingerprint.with_edits(frame(spark, texts), rows_per_bucket=7).collect()}
    order = sorted(range(len(texts)), reverse=True)
    mark = lambda t: fingerprint.minima(fingerprint.Parse().feed(t).hashes())
    for at, i in enumerate(order):
        text, other = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        cut = len(text) // 2
        edited = text[:len(text) - cut] + other[:cut]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint.text_of(mark(text)) and r.edited_fingerprint == fingerprint.text_of(mark(edited))
        assert r.near_next == fingerprint.likeness(mark(text), mark(other))
    assert fingerprint.with_edits(frame(spark, ["abc"])).first().near_next == 1.0
    assert fingerprint.with_edits(frame(spark, ["abc"]).where("false")).count() == 0
    assert fingerprint.with_edits(frame(spark, ["a", None, "b"], [None, None, 3]), 1).count() == 3


def test_context_tree_equals_plain_trees(spark):
    texts = ["abab abac", "the cat", "abab abab abad", "The bat", "", None, "zebra the"]
    df = frame(spark, texts)
    rows = {r.doc_id: r for r in ctw.scores(df, F.col("doc_id") != 6, depth=4, block_bytes=20).collect()}
    train = [(t or "").lower().encode() for t in texts[:6]]
    words = Counter(w for t in train for w in [*t.split(), "end"])
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        data = (t or "").lower().encode()
        tokens = [*data.split(), "end"]
        assert math.isclose(rows[i].score, all_depths(train, data, 4), rel_tol=1e-5)
        assert math.isclose(rows[i].base_score, sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(tokens), sum(words[w] > 0 for w in tokens), n)
    assert ctw.scores(df.where("false"), F.lit(True)).count() == 0
    blank = ctw.scores(df, F.lit(False)).where("doc_id = 1").first()
    assert math.isclose(blank.score, 8 * 8 * math.log10(0.5), rel_tol=1e-6) and blank.n_known == 0


def test_context_tree_mixes_every_depth(spark):
    """The registered model: contexts of 0 to 6 bytes, one byte included; also with blocks of several salts."""
    texts = ["abab abac", "the cat", "abab abab abad", "The bat", "", None, "zebra the", *[f"row {i} of the bat" for i in range(70)]]
    train = [(t or "").lower().encode() for t in texts if t != "zebra the"]
    for size in (10**6, 10):
        rows = {r.doc_id: r.score for r in ctw.scores(frame(spark, texts), F.col("doc_id") != 6, block_bytes=size).collect()}
        assert len(rows) == len(texts)
        for i in (0, 2, 4, 5, 6, 40):
            assert math.isclose(rows[i], all_depths(train, (texts[i] or "").lower().encode(), 6), rel_tol=1e-5)


def test_sums_of_windows_by_text():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abc \xc3\xa9") for _ in range(rng.choice([0, 1, 40]))) for _ in range(700)]
    keys, sizes = ctw.windows(texts, 6), np.array([len(t) + 1 for t in texts])
    plain = [int.from_bytes(((b"\xff" * 6 + t + b"\xff")[i:i + 6])[::-1] + (t + b"\xff")[i:i + 1], "big") for t in texts for i in range(len(t) + 1)]
    assert keys.tolist() == plain
    learned = np.repeat(np.arange(len(texts)) % 3 > 0, sizes)
    one, counts = ctw.distinct(keys, learned)
    want = Counter(k for k, ok in zip(plain, learned) if ok)
    assert one.tolist() == sorted(set(plain)) and counts.tolist() == [want[k] for k in one.tolist()]
    table = np.arange(len(one)) * 0.5
    place = {k: i for i, k in enumerate(one.tolist())}
    sums = ctw.text_sums(keys, sizes, one, table)
    at = np.cumsum(sizes) - sizes
    assert np.allclose(sums, [sum(0.5 * place[k] for k in plain[a:a + n]) for a, n in zip(at, sizes)])


def all_depths(train, text, depth):
    """Plain recursion over contexts of every length: no byte, one byte and so on."""
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    counts, below = {}, {}

    def bits(data, i):
        return [((1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1) for k in range(8)]

    pad = bytes([255]) * depth
    for t in train:
        data = pad + t + bytes([255])
        for i in range(depth, len(data)):
            for node, bit in bits(data, i):
                for d in range(depth + 1):
                    counts.setdefault((data[i - d:i], node), [0, 0])[bit] += 1
                    if d:
                        below.setdefault((data[i - d + 1:i], node), set()).add((data[i - d:i], node))
    weights = {}

    def weight(c):
        if c not in weights:
            own = kt(*counts[c])
            weights[c] = own if len(c[0]) == depth else float(np.logaddexp(own, sum(map(weight, below[c])))) - math.log(2)
        return weights[c]

    def chance(data, i, node, d):
        pair = counts[data[i - d:i], node]
        mine = (pair[1] + 0.5) / (sum(pair) + 1)
        if d == depth:
            return mine
        share = math.exp(kt(*pair) - math.log(2) - weight((data[i - d:i], node)))
        deeper = chance(data, i, node, d + 1) if (data[i - d - 1:i], node) in counts else mine
        return share * mine + (1 - share) * deeper

    data, total = pad + text + bytes([255]), 0.0
    for i in range(depth, len(data)):
        for node, bit in bits(data, i):
            p = chance(data, i, node, 0) if (b"", node) in counts else 0.5
            total += math.log(p if bit else 1 - p)
    return total / math.log(10)


def test_curve_and_shards(spark):
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = sharding.hilbert(points, 3)
    assert sorted(index) == list(range(512)) and (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1) == 1).all()
    df = frame(spark, corpus(100) + ["same"] * 50)
    rows = sharding.shards_of(df, 7).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == df.count() and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in ordered)
    assert sharding.shards_of(df.where("false")).count() == 0


def test_toxicity(spark):
    rng = random.Random(2)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti", "vo", "ze"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(60)]
        if i % 3 == 0:
            for at in rng.sample(range(60), 5):
                w[at] = rng.choice(["idiot", "scumbag", "worthless"])
        rows.append(" ".join(w))
        labels.append((i, int(i % 3 == 0)))
    df = frame(spark, [*rows, None, ""])
    marked = spark.createDataFrame([*labels, (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, marked, F.col("doc_id") < 400)
    got = {r.doc_id: r for r in toxicity.scores(df, model).collect()}
    held = range(400, 600)
    assert sum(got[i].predicted == int(i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert got[600].score == got[601].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.fit(df, marked.where("false")) is None and toxicity.scores(df, None).where("score > 0").count() == 0
    assert toxicity.scores(df.where("false"), model).count() == 0
    # scores again from plain compressed lengths, on whole texts, and with repeated and null ids
    texts = [*rows, None, ""]
    twice = frame(spark, texts[:3] + texts[:2], [0, 1, 2, 0, None]).withColumn("predicted", F.lit(5))
    again = sorted(r.score for r in toxicity.scores(twice, model).collect())
    assert again == sorted(got[i].score for i in (0, 1, 2, 0, 1))
    for i in (0, 1, 450, 600):
        x = []
        for toxic, ordinary in model.pairs:
            data = b"  " + b"  ".join((texts[i] or "").lower().encode().split()) + b"  "
            windows = [toxicity.LEAD + data[at:at + 72] for at in range(0, max(1, len(data) - 72 + 54), 54)]
            assert b"".join(w[len(toxicity.LEAD):][:54] for w in windows[:-1]) + windows[-1][len(toxicity.LEAD):] == data
            saved = [len(toxicity._compressor(ordinary).compress(w)) - len(toxicity._compressor(toxic).compress(w)) for w in windows]
            top = sorted([*saved, 0, 0], reverse=True)[:3]
            more = [sum(s >= k for s in saved) for k in toxicity.STEPS]
            x += [*[min(t, 10) for t in top], math.log(len(saved)), *[math.log1p(m) for m in more], *[math.log((m + 0.5) / (len(saved) + 10)) for m in more]]
        z = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weight)) + model.bias
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert len(model.pairs) == 2 and all(len(a) == len(b) and a != b for a, b in model.pairs)


def test_pipeline_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "personal_data", "sentencepiece"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = docs.withColumn("__row", F.lit(1)).withColumn("node", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, extra, "/root/testdata/sf0.001")
        assert kept.columns == extra.columns and 0 < kept.count() <= extra.count()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("not lossless").count() == 0 and 100 < out.count() <= docs.count()


def test_near_duplicates_sql(spark):
    from tools.check import compare, connect
    from restartlab.llm.queries import op9_near_duplicates

    text, _, good = compare(spark, connect("/root/testdata/sf0.001"), "op9", op9_near_duplicates, NEAR_DUPLICATES_SQL, "/root/testdata/sf0.001")
    assert good, text
