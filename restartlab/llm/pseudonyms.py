"""Format-preserving pseudonyms by keyed Feistel permutations, in Spark SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
FIRST_YEAR, YEARS = 1900, 200
#: Dates keep what their notation may show: whether month and day have one digit, and whether the day can be a month.
#: Each group is months x days of every year: months, first day, number of days.
GROUPS = tuple((tuple(m for m in months if not (first > 28 and m == 2) and not (first == 31 and m in (4, 6, 9, 11))), first, count)
               for months in (range(1, 10), range(10, 13)) for first, count in ((1, 9), (10, 3), (13, 16), (29, 1), (30, 1), (31, 1)))
AREAS, SERIALS = 898, 99 * 9999  # social security numbers that can be given out

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
TOKEN = r"(?=[0-9a-f]{16})(?<=(?:token|secret|password|key) {0,2}[=:] {0,2}[\"']?)[0-9a-f]{16,128}(?![0-9A-Za-z])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE = r"(?<![\d./\-])(?:(?:19|20)\d\d(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{1,2}|\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)(?:19|20)\d\d)(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = (r"(?<![\d\p{L}+])(?:\+\d{1,3}[ .\-]?)?\(\d{3}\) ?\d{3}[ .\-]?\d{4}(?!\d)|(?<![\d\p{L}+])\+\d(?:[ .\-]?\d){7,14}(?!\d)"
         r"|(?<![\d.\-])\d{3}([.\-])\d{3}[.\-]\d{4}(?![\d\-])")
CARD = r"(?<![\d\p{L}])\d(?:[ \-]?\d){12,18}(?![\d\p{L}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
#: A look at the next characters comes first, so that a position inside a word costs little.
ANY = rf"(?=[\d(+])(?:{'|'.join((SSN, DATE, IPV4, PHONE, CARD))})|(?=[A-Z]{{2}}\d\d){IBAN}|{TOKEN}|{EMAIL}"

SIGNS = "[0-9@]"

DIGITS, HEX, LETTERS, ACCENTED = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"


def _digest(key: str, label: str, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), turn.cast("string"), other.cast("string")), 256)


def _turns(inverse: bool) -> Column:
    return F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))])


def permute_pair(a: Column, size_a: int | Column, b: Column, size_b: int | Column, key: str, label: str, inverse: bool = False) -> Column:
    """struct(a, b) permuted on Z(size_a) x Z(size_b): turns change one number by a keyed digest of the other."""
    sign = -1 if inverse else 1
    size_a, size_b = (x if isinstance(x, Column) else F.lit(x) for x in (size_a, size_b))

    def moved(x: Column, size: Column, turn: Column, other: Column) -> Column:
        step = F.conv(F.substring(_digest(key, label, turn, other), 1, 12), 16, 10).cast("bigint")
        return F.pmod(x + sign * (step % size), size).cast("bigint")

    def step(acc: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(F.when(even, moved(acc["a"], size_a, turn, acc["b"])).otherwise(acc["a"]).alias("a"),
                        F.when(even, acc["b"]).otherwise(moved(acc["b"], size_b, turn, acc["a"])).alias("b"))

    return F.aggregate(_turns(inverse), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def permute_string(value: Column, alphabet: str, key: str, label: str, inverse: bool = False) -> Column:
    """A string over ``alphabet`` permuted among those of its length; halves swap roles each turn."""
    letters, size, sign = F.lit(alphabet), len(alphabet), -1 if inverse else 1

    def added(x: Column, digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            step = F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return F.substr(letters, F.pmod(F.instr(letters, c) - 1 + sign * step, F.lit(size)) + 1, F.lit(1))

        return F.when(F.length(x) == 0, x).otherwise(F.array_join(F.transform(F.split(x, ""), one), ""))

    def forth(acc: Column, turn: Column) -> Column:
        return F.struct(acc["b"].alias("a"), added(acc["a"], _digest(key, label, turn, acc["b"])).alias("b"))

    def back(acc: Column, turn: Column) -> Column:
        return F.struct(added(acc["b"], _digest(key, label, turn, acc["a"])).alias("a"), acc["a"].alias("b"))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1).alias("b"))
    return F.aggregate(_turns(inverse), start, back if inverse else forth, lambda acc: F.concat(acc["a"], acc["b"]))


def _none() -> Column:
    return F.lit(0).cast("bigint")


def _only(m: Column, kept: str) -> Column:
    return F.regexp_replace(m, f"[^{kept}]", "")


def _refill(m: Column, kept: str, new: Column) -> Column:
    """The characters of class ``kept`` in m replaced one by one by those of ``new``; separators stay."""
    def one(c: Column, i: Column) -> Column:
        at = F.length(_only(F.substr(m, F.lit(1), i + 1), kept))
        return F.when(c.rlike(f"[{kept}]"), F.substr(new, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), one), "")


def _luhn(digits: Column) -> Column:
    def weight(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weight), F.lit(0), lambda a, x: a + x) % 10


def _with(value: Column, body) -> Column:
    """let value in body: the value is computed once."""
    return F.transform(F.array(value), body)[0]


def _first_valid(m: Column, kept: str, marks: str, least: int, good, inside: bool) -> Column:
    """struct(a, n): where the first reading of m that is ``good`` begins and how long it is, or null.

    Readings end at the end or before a separator; ``inside``, they may also begin
    after one. Early ones come first, and of these the longest.
    """
    size, mark = F.length(m), lambda i: F.instr(F.lit(marks), F.substr(m, i, F.lit(1))) > 0
    ends = F.reverse(F.filter(F.sequence(F.lit(2), size + 1), lambda i: (i > size) | mark(i)))
    starts = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | mark(i - 1)) if inside else F.array(F.lit(1))
    pairs = F.flatten(F.transform(starts, lambda a: F.transform(F.filter(ends, lambda e: e > a), lambda e: F.struct(a.alias("a"), (e - a).alias("n")))))
    fits = lambda d: (F.length(d) >= least) & good(d)
    return F.get(F.filter(pairs, lambda p: _with(_only(F.substr(m, p["a"], p["n"]), kept), fits)), F.lit(0))


TURNS = 64


def _inside(m: Column, first, one) -> Column:
    """m with its first valid reading replaced; the rest stays.

    The reading is permuted again until it is the first valid one of the result
    too, so that the way back finds it (one turn in most cases).
    """
    def walked(p: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            v, after = acc["v"], p["a"] + p["n"]
            new = F.concat(F.substr(v, F.lit(1), p["a"] - 1), one(F.substr(v, p["a"], p["n"])), F.substr(v, after))
            judged = lambda x: F.struct(x.alias("v"), F.coalesce(first(x) == p, F.lit(False)).alias("done"))
            return F.when(acc["done"], acc).otherwise(_with(new, judged))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), F.struct(m.alias("v"), F.lit(False).alias("done")), step, lambda acc: acc["v"])

    return _with(first(m), lambda p: F.when(p.isNull(), m).otherwise(walked(p)))


def _card(m: Column, key: str, inverse: bool) -> Column:
    """Luhn-valid numbers: first digit and grouping stay, the check digit is made anew."""
    def changed(d: Column) -> Column:
        inner = permute_string(F.substr(d, F.lit(2), F.length(d) - 2), DIGITS, key, "card", inverse)
        def closed(body: Column) -> Column:
            check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
            return _refill(m, "0-9", F.concat(body, check.cast("string")))
        return F.when(_luhn(d) == 0, _with(F.concat(F.substr(d, F.lit(1), F.lit(1)), inner), closed)).otherwise(m)

    return _with(_only(m, "0-9"), changed)


def _rest97(text: Column) -> Column:
    """Remainder modulo 97 of letters and digits read as in an IBAN."""
    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(m: Column, key: str, inverse: bool) -> Column:
    """IBANs with right check digits: country, letters and grouping stay; digits are permuted and checked anew."""
    def changed(plain: Column) -> Column:
        rest, country = F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(2))
        moved = _refill(rest, "0-9", permute_string(_only(rest, "0-9"), DIGITS, key, "iban", inverse))
        def closed(body: Column) -> Column:
            check = F.lpad((98 - _rest97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
            return _refill(m, "A-Z0-9", F.concat(country, check, body))
        good = _rest97(F.concat(rest, F.substr(plain, F.lit(1), F.lit(4)))) == 1
        return F.when(good, _with(moved, closed)).otherwise(m)

    return _with(_only(m, "A-Z0-9"), changed)


def _cards(m: Column, key: str, inverse: bool) -> Column:
    """The card number that a match is or holds between separators, as before an expiry date or a security code."""
    first = lambda x: _first_valid(x, "0-9", " -", 13, lambda d: _luhn(d) == 0, True)
    return F.when(_luhn(_only(m, "0-9")) == 0, _card(m, key, inverse)).otherwise(_inside(m, first, lambda v: _card(v, key, inverse)))


def _ibans(m: Column, key: str, inverse: bool) -> Column:
    """The IBAN that a match is or begins with; capitals or digits may follow after a space."""
    good = lambda x: _rest97(F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))) == 1
    first = lambda x: _first_valid(x, "A-Z0-9", " ", 15, good, False)
    return F.when(good(_only(m, "A-Z0-9")), _iban(m, key, inverse)).otherwise(_inside(m, first, lambda v: _iban(v, key, inverse)))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    part = lambda at, n: F.substr(m, F.lit(at), F.lit(n)).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    a = area - F.when(area > 666, 2).otherwise(1)
    moved = permute_pair(a, AREAS, (group - 1) * 9999 + serial - 1, SERIALS, key, "ssn", inverse)
    def shown(p: Column) -> Column:
        new_area = p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)
        return F.format_string("%03d-%02d-%04d", new_area, F.floor(p["b"] / 9999) + 1, p["b"] % 9999 + 1)
    return F.when(valid, _with(moved, shown)).otherwise(m)


def _ipv4(m: Column, key: str, inverse: bool) -> Column:
    def changed(o: Column) -> Column:
        n = [o[i].cast("int") for i in range(4)]
        shown = lambda p: F.format_string("%d.%d.%d.%d", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)
        moved = permute_pair(n[0] * 256 + n[1], 65536, n[2] * 256 + n[3], 65536, key, "ipv4", inverse)
        return F.when((n[0] < 256) & (n[1] < 256) & (n[2] < 256) & (n[3] < 256), _with(moved, shown)).otherwise(m)

    return _with(F.split(m, r"\."), changed)


def _moved_date(year: Column, month: Column, day: Column, key: str, inverse: bool) -> Column:
    """struct(y, m, d): a date of 1900 to 2099 permuted among those of its group; February 29 among leap years."""
    table = F.array(*[F.struct(F.array(*map(F.lit, months)).alias("months"), F.lit(first).alias("first"), F.lit(count).alias("count")) for months, first, count in GROUPS])
    leap = (month == 2) & (day == 29)

    def changed(g: Column) -> Column:
        rank = (F.array_position(g["months"], month) - 1) * g["count"] + day - g["first"]
        a, b = year - FIRST_YEAR, rank
        size_b = F.size(g["months"]) * g["count"]
        turn = F.floor((year - 1904) / 4)  # 49 leap years
        moved = permute_pair(F.when(leap, F.floor(turn / 7)).otherwise(a), F.when(leap, 7).otherwise(YEARS), F.when(leap, turn % 7).otherwise(b),
                             F.when(leap, 7).otherwise(size_b), key, "date", inverse)
        told = lambda q: F.struct(
            F.when(leap, 1904 + 4 * (q["a"] * 7 + q["b"])).otherwise(q["a"] + FIRST_YEAR).cast("int").alias("y"),
            F.when(leap, month).otherwise(F.element_at(g["months"], (F.floor(q["b"] / g["count"]) + 1).cast("int"))).alias("m"),
            F.when(leap, day).otherwise((q["b"] % g["count"] + g["first"]).cast("int")).alias("d"))
        return _with(moved, told)

    fits = lambda g: (day >= g["first"]) & (day < g["first"] + g["count"]) & ((month < 10) == (g["months"][0] < 10))
    return _with(F.filter(table, fits)[0], changed)


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Dates of 1900 to 2099: equal days stay equal in every notation, and a notation stays readable in one way."""
    mark = F.regexp_extract(m, r"([-./])", 1)
    def changed(p: Column) -> Column:
        year_first = F.length(p[0]) == 4
        one, two = p[1].cast("int"), F.when(year_first, p[2]).otherwise(p[0]).cast("int")
        us = ~year_first & (mark == "/") & (two <= 12)  # month first
        month, day = F.when(us, two).otherwise(one), F.when(us, one).otherwise(two)
        year = F.when(year_first, p[0]).otherwise(p[2]).cast("int")
        valid = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd").isNotNull()
        narrow = (F.length(p[1]) == 1) | (F.length(F.when(year_first, p[2]).otherwise(p[0])) == 1)
        def shown(q: Column) -> Column:
            width = lambda x: F.when(narrow, x.cast("string")).otherwise(F.format_string("%02d", x))
            y, mo, d = q["y"].cast("string"), width(q["m"]), width(q["d"])
            return F.when(year_first, F.concat(y, mark, mo, mark, d)).when(us, F.concat(mo, mark, d, mark, y)).otherwise(F.concat(d, mark, mo, mark, y))
        return F.when(F.coalesce(valid, F.lit(False)), _with(_moved_date(year, month, day, key, inverse), shown)).otherwise(m)

    return _with(F.split(m, "[-./]"), changed)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    """The last ten digits at most are permuted; a country code stays."""
    def changed(d: Column) -> Column:
        size = F.least(F.length(d), F.when(m.startswith("+"), F.greatest(F.length(d) - 1, F.lit(1))).otherwise(F.length(d)), F.lit(10))
        head, tail = F.substr(d, F.lit(1), F.length(d) - size), F.substr(d, F.length(d) - size + 1)
        return _refill(m, "0-9", F.concat(head, permute_string(tail, DIGITS, key, "phone", inverse)))

    return _with(_only(m, "0-9"), changed)


def _email(m: Column, key: str, inverse: bool) -> Column:
    """Letters and digits of the local part are permuted, each among its kind and in its case; other signs and the domain stay.

    Kinds are a-z, digits and the accented letters of Latin-1; letters of other scripts stay.
    """
    local, domain = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    low = F.translate(local, LETTERS.upper() + ACCENTED.upper(), LETTERS + ACCENTED)

    def changed(plain: Column) -> Column:
        new = plain
        for kind, letters, label in (("a-z", LETTERS, "email"), ("0-9", DIGITS, "email digits"), (ACCENTED, ACCENTED, "email accents")):
            new = F.when(plain.rlike(f"[{kind}]"), _refill(new, kind, permute_string(_only(plain, kind), letters, key, label, inverse))).otherwise(new)
        cased = lambda old, small, c: F.when(old != small, F.translate(c, LETTERS + ACCENTED, LETTERS.upper() + ACCENTED.upper())).otherwise(c)
        signs = lambda x: F.split(x, "")
        told = F.zip_with(F.zip_with(signs(local), signs(plain), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), signs(new), lambda x, c: cased(x["a"], x["b"], c))
        return F.concat(F.array_join(told, ""), domain)

    return _with(low, changed)


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one matched value; values that fail their check (Luhn, modulo 97, octets, calendar) are returned as they are."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (F.when(F.instr(m, F.lit("@")) > 0, _email(m, key, inverse))
            .when(whole("[0-9a-f]{16,128}") & m.rlike("[a-f]"), permute_string(m, HEX, key, "token", inverse))
            .when(whole(r"\d{3}-\d{2}-\d{4}"), _ssn(m, key, inverse))
            .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), _ipv4(m, key, inverse))
            .when(whole(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4}"), _date(m, key, inverse))
            .when(m.rlike(r"^[+(]") | whole(r"\d{3}[.-]\d{3}[.-]\d{4}"), _phone(m, key, inverse))
            .when(m.rlike("^[A-Z]"), _ibans(m, key, inverse))
            .otherwise(_cards(m, key, inverse)))


def _line(line: Column, key: str, inverse: bool) -> Column:
    """struct(text, found, changed) of one line: pieces between matches are taken over unchanged."""
    def rebuilt(pair: Column) -> Column:
        new = F.transform(pair["m"], lambda m: pseudonym(m, key, inverse))
        def joined(n: Column) -> Column:
            whole = F.array_join(F.zip_with(F.split(line, ANY, -1), n, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
            changed = F.aggregate(F.zip_with(pair["m"], n, lambda a, b: (a != b).cast("bigint")), _none(), lambda s, x: s + x)
            return F.struct(whole.alias("text"), F.size(pair["m"]).cast("bigint").alias("found"), changed.alias("changed"))
        return F.when(F.size(pair["m"]) > 0, _with(new, joined)).otherwise(_as_it_is(line))

    return _with(F.struct(F.regexp_extract_all(line, F.lit(ANY), F.lit(0)).alias("m")), rebuilt)


def _as_it_is(text: Column) -> Column:
    return F.struct(text.alias("text"), _none().alias("found"), _none().alias("changed"))


def pseudonymised(text: Column, key: str, inverse: bool = False) -> Column:
    """struct(text, found, changed): the text with its values replaced, how many matched a pattern and how many were changed.

    No value spans lines, and each has a digit or an @: other texts and lines are
    passed over after a look for these signs. A null text stays null with counts 0.
    """
    def one(line: Column) -> Column:
        return F.when(line.rlike(SIGNS), _line(line, key, inverse)).otherwise(_as_it_is(line))

    def joined(lines: Column) -> Column:
        total = lambda name: F.aggregate(lines[name], _none(), lambda s, x: s + x)
        return F.struct(F.array_join(lines["text"], "\n").alias("text"), total("found").alias("found"), total("changed").alias("changed"))

    whole = _with(F.transform(F.split(text, "\n", -1), one), joined)
    return F.when(F.coalesce(text.rlike(SIGNS), F.lit(False)), whole).otherwise(_as_it_is(text))


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """``docs`` with the values in column text replaced; other columns and rows stay as they are.

    E-mail names, secrets in assignments, social security numbers, dates, IPv4
    addresses, phone numbers, payment cards and IBANs are replaced by values of the
    same format. Each is a keyed permutation, so equal values stay equal in all
    documents and the key holder can undo it with ``inverse``. Numbers that fail
    their check are no such values and stay. Null and empty texts stay.
    """
    found = pseudonymised(F.col("text"), key, inverse)["text"]
    return docs.select(*[found.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def values_of(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with pseudonyms), found, changed of every row of ``docs``."""
    made = docs.select("doc_id", pseudonymised(F.col("text"), key).alias("made"))
    return made.select("doc_id", "made.text", "made.found", "made.changed")
