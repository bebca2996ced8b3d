"""Personal data replaced by format-preserving Feistel pseudonyms, in Spark expressions only.

One pattern finds candidates; each kind has a check (Luhn, IBAN remainder, octets, calendar), and what
fails its check stays as it is. A valid value is permuted by a keyed Feistel network within its own
format, so the pseudonym has the same shape, equal values get equal pseudonyms in every document, and
different values of a shape get different ones:

* card numbers: all digits but the last are permuted, the last is the new Luhn digit;
* IBANs: the account part is permuted class by class, the check digits are computed anew;
* phone and social security numbers: their digits are permuted, a leading +country code stays;
* IPv4 addresses: permuted as 32-bit numbers;
* dates, of years 1 to 9999: permuted within their century, in the way they are written;
* e-mail addresses: letters and digits of the local part are permuted, the domain stays.

Equality is that of the value, not of its spelling: separators don't count, nor does case in addresses.
The key is a parameter; who has it can invert every pseudonym, so it isn't a constant in production.

All of it is one narrow projection over whole texts. Texts without a digit or @ skip the work.

Defined results. Null text: null, no finds. Empty text: itself. Very long texts: whole. Finds that tie: the
leftmost, of several kinds there the first of ``KINDS``. Repeated rows: each on its own, alike. Empty table: no
rows. Other columns, whatever their names, are carried along; one with the name of a column made here gives
way to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sylvan.llm.columns import named, without

#: Characters of an IBAN by country. Other countries, and those whose length has changed, have no bound.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """By the country's length, else as many groups as there are; ``_iban`` then finds where it ends."""
    ends = "(?![A-Za-z0-9])"
    of = lambda n: r"\d{2}(?: ?[A-Z0-9]{4}){%d}" % (n // 4 - 1) + (r" ?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "")
    bound = "|".join(f"(?:{c.replace(' ', '|')}){of(n)}{ends}" for n, c in IBAN_COUNTRIES.items())
    return r"(?<![A-Za-z0-9])(?=[A-Z]{2}\d{2})(?:" + bound + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + ends + ")"


KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    "iban": _iban_pattern(),
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d|[./-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    "phone": r"(?:(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|(?<![\d+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,4}|(?<![\d+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<![\d+])(?:\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|\d{13,19})(?!\d)",
}
ROUNDS = 8
#: Sizes whose product is the days of a century: of the first, which begins with year 1, of one whose first year is a leap year, and of any other.
FIRST_CENTURY, LONG_CENTURY, CENTURY = (51, 709), (75, 487), (92, 397)


def _any_pattern() -> str:
    return "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _stream(key: Column, kind: str | Column, turn: Column, other: Column, size: Column) -> Column:
    """128 hexadecimal digits that depend on the key, the round and the other half."""
    return F.sha2(F.concat_ws("|", key, F.lit(kind) if isinstance(kind, str) else kind, turn.cast("string"), size.cast("string"), other.cast("string")), 512)


def _moved(half: Column, stream: Column) -> Column:
    """Each character moved within its class by its own byte of the stream."""

    def one(st: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(st, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            a = F.ascii(c)
            cycle = lambda first, n: F.char(F.lit(first) + F.pmod(a - first + by, F.lit(n)))
            return F.when(a.between(48, 57), cycle(48, 10)).when(a.between(65, 90), cycle(65, 26)).when(a.between(97, 122), cycle(97, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), char), "")

    return F.when(F.length(half) == 0, half).otherwise(_let(stream, one))


def permuted(value: Column, kind: str, key: Column) -> Column:
    """The Feistel permutation of the strings of value's shape (which character is of which class)."""

    def network(v: Column) -> Column:
        n = F.length(v)
        start = F.struct(F.substring(v, F.lit(1), F.floor(n / 2).cast("int")).alias("l"), F.substring(v, F.floor(n / 2).cast("int") + 1, n).alias("r"))

        def turn(at: Column, i: Column) -> Column:
            left = F.struct(_moved(at["l"], _stream(key, kind, i, at["r"], n)).alias("l"), at["r"].alias("r"))
            right = F.struct(at["l"].alias("l"), _moved(at["r"], _stream(key, kind, i, at["l"], n)).alias("r"))
            return F.when(i % 2 == 0, left).otherwise(right)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda at: F.concat(at["l"], at["r"]))

    return _let(value, network)


def permuted_number(value: Column, left: int, right: int, kind: str | Column, key: Column) -> Column:
    """The Feistel permutation of the numbers below left * right, its halves moved modulo left and right."""
    start = F.struct(F.floor(value / right).cast("bigint").alias("l"), (value.cast("bigint") % right).alias("r"))

    def turn(at: Column, i: Column) -> Column:
        move = lambda x, by, n: (x + F.conv(F.substring(_stream(key, kind, i, by, F.lit(left * right)), 1, 14), 16, 10).cast("bigint")) % n
        l, r = at["l"], at["r"]
        return F.when(i % 2 == 0, F.struct(move(l, r, left).alias("l"), r.alias("r"))).otherwise(F.struct(l.alias("l"), move(r, l, right).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda at: at["l"] * right + at["r"])


def _refilled(spelling: Column, value: Column, kept: str = "0-9") -> Column:
    """The spelling with its characters of the class ``kept`` replaced in turn by those of value."""
    other = f"[^{kept}]"
    fill = lambda c, i: F.when(c.rlike(other), c).otherwise(F.substring(value, F.length(F.regexp_replace(F.substring(spelling, F.lit(1), i), other, "")) + 1, F.lit(1)))
    return F.array_join(F.transform(F.split(spelling, ""), fill), "")


def luhn_digit(payload: Column) -> Column:
    def weigh(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    total = F.aggregate(F.transform(F.split(F.reverse(payload), ""), weigh), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def remainder_97(text: Column) -> Column:
    """Of the number that digits, and letters as 10 to 35, spell."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _card(m: Column, key: Column) -> Column:
    def use(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        new = _let(permuted(body, "card", key), lambda p: F.concat(p, luhn_digit(p)))
        return F.when(luhn_digit(body) == F.substring(d, F.length(d), F.lit(1)), _let(new, lambda v: _refilled(m, v)))

    return _let(_digits(m), use)


def _iban(m: Column, key: Column) -> Column:
    def remainder(v: Column) -> Column:
        return remainder_97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4)))

    def use(spelling: Column) -> Column:
        v = F.regexp_replace(spelling, " ", "")
        country = F.substring(v, 1, 2)

        def made(p: Column) -> Column:
            check = F.lpad((F.lit(98) - remainder_97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0")
            return _let(F.concat(country, check, p), lambda x: F.concat(_refilled(spelling, x, "A-Z0-9"), F.substring(m, F.length(spelling) + 1, F.length(m))))

        return F.when(spelling.isNotNull(), _let(permuted(F.substring(v, F.lit(5), F.length(v)), "iban", key), made))

    def longest(tokens: Column) -> Column:
        """The candidate without as few of its last tokens as it takes to pass the check; whole, if its country has a length."""
        bound = F.substring(m, 1, 2).isin(" ".join(IBAN_COUNTRIES.values()).split())
        tries = F.when(bound, F.array(m)).otherwise(F.transform(F.sequence(F.size(tokens), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(tokens, F.lit(1), k), " ")))
        return F.get(F.filter(tries, lambda t: _let(F.regexp_replace(t, " ", ""), lambda v: (F.length(v) >= 12) & (remainder(v) == 1))), F.lit(0))

    return _let(longest(F.split(m, " ")), use)


def _ip(m: Column, key: Column) -> Column:
    def use(o: Column) -> Column:
        number = F.aggregate(o, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
        back = lambda v: F.concat_ws(".", *[(F.shiftright(v, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])
        return F.when(F.forall(o, lambda x: x <= 255), _let(permuted_number(number, 1 << 16, 1 << 16, "ip", key), back))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("bigint")), use)


def _date(m: Column, key: Column) -> Column:
    def moved(day: Column, form: str) -> Column:
        century = F.floor(F.year(day) / 100).cast("int")

        def within(first: Column) -> Column:
            place, kind = F.datediff(day, first), F.concat(F.lit("date"), century * 100)
            new = lambda sizes: permuted_number(place, *sizes, kind, key)
            number = F.when(century == 0, new(FIRST_CENTURY)).when(century % 4 == 0, new(LONG_CENTURY)).otherwise(new(CENTURY))
            return F.date_format(F.date_add(first, number.cast("int")), form)

        return _let(F.make_date(F.greatest(century * 100, F.lit(1)), F.lit(1), F.lit(1)), within)

    def read(form: str, other: Column | None = None) -> Column:
        return _let(F.try_to_date(m, form), lambda d: F.when(F.year(d) >= 1, moved(d, form)).otherwise(F.lit(None).cast("string") if other is None else other))

    slash = read("MM/dd/yyyy", read("dd/MM/yyyy"))
    return F.when(m.contains("-"), read("yyyy-MM-dd")).when(m.contains("."), read("dd.MM.yyyy")).otherwise(slash)


def _ssn(m: Column, key: Column) -> Column:
    valid = ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$")
    return F.when(valid, _let(permuted(_digits(m), "ssn", key), lambda v: _refilled(m, v)))


def _phone(m: Column, key: Column) -> Column:
    def use(code: Column) -> Column:
        rest = F.substring(m, F.length(code) + 1, F.length(m))
        n = F.length(_digits(m))
        return F.when(n.between(7, 15), F.concat(code, _let(permuted(_digits(rest), "phone", key), lambda v: _refilled(rest, v))))

    return _let(F.when(m.rlike(r"^\+1\d{10}$"), F.lit("+1")).otherwise(F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)), use)


def _email(m: Column, key: Column) -> Column:
    return F.concat(permuted(F.lower(F.substring_index(m, "@", 1)), "email", key), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one match of the pattern, or null if it isn't valid."""
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(m.rlike("^[A-Z]"), _iban(m, key))
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), _ip(m, key))
        .when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})$"), _date(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(m, key))
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), _phone(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymised(text: Column, key: str | Column) -> Column:
    """A struct: the text with its valid finds replaced, and how many they are."""
    pattern, secret = _any_pattern(), F.lit(key) if isinstance(key, str) else key

    def of(finds: Column) -> Column:
        def with_names(names: Column) -> Column:
            spelled = F.zip_with(finds, names, lambda m, p: F.coalesce(p, m))
            pairs = F.zip_with(F.split(text, pattern), spelled, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
            return F.struct(F.array_join(pairs, "").alias("text"), F.size(F.array_compact(names)).cast("long").alias("n"))

        return F.when(F.size(finds) == 0, F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(_let(F.transform(finds, lambda m: pseudonym(m, secret)), with_names))

    none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    return F.when(F.coalesce(text.rlike("[0-9@]"), F.lit(False)), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(none)


def pseudonymise(docs: DataFrame, key: str | Column) -> DataFrame:
    """The documents with valid personal data replaced in ``text``, and ``n_pseudonyms``.

    A key given as text stands in plans and event logs; ``spark.sql.redaction.string.regex`` can hide it, or the
    key is given as a column, which a job joins from a table that only it may read.
    """
    docs = without(docs, ["n_pseudonyms", "_p"])
    rows = docs.withColumn("_p", pseudonymised(F.col("text"), key))
    return rows.select(*[F.col("_p.text").alias("text") if c == "text" else named(c) for c in docs.columns], F.col("_p.n").alias("n_pseudonyms"))
