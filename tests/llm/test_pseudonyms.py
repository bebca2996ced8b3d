"""Pseudonyms against a plain version of the same permutations, text by text."""

import datetime
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from sylvan.llm import catalogue, pii

SF = "/root/testdata/sf0.001"


def stream(key, kind, turn, other, size):
    return hashlib.sha512(f"{key}|{kind}|{turn}|{size}|{other}".encode()).hexdigest()


def moved(half, st):
    out = []
    for i, c in enumerate(half):
        by, a = int(st[i % 64 * 2 : i % 64 * 2 + 2], 16), ord(c)
        for first, n in ((48, 10), (65, 26), (97, 26)):
            if first <= a < first + n:
                c = chr(first + (a - first + by) % n)
        out.append(c)
    return "".join(out)


def permuted(v, kind, key):
    n = len(v)
    l, r = v[: n // 2], v[n // 2 :]
    for i in range(8):
        if i % 2 == 0:
            l = moved(l, stream(key, kind, i, r, n))
        else:
            r = moved(r, stream(key, kind, i, l, n))
    return l + r


def number(v, sizes, kind, key):
    (left, right), (l, r) = sizes, divmod(v, sizes[1])
    for i in range(8):
        by = int(stream(key, kind, i, r if i % 2 == 0 else l, left * right)[:14], 16)
        l, r = ((l + by) % left, r) if i % 2 == 0 else (l, (r + by) % right)
    return l * right + r


def refill(spelling, value, kept="0-9"):
    it = iter(value)
    return re.sub(f"[{kept}]", lambda _: next(it), spelling)


def luhn(body):
    s = 0
    for i, c in enumerate(reversed(body)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        s += v - 9 if v > 9 else v
    return str(-s % 10)


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def card(m, key):
    d = re.sub("[^0-9]", "", m)
    if luhn(d[:-1]) != d[-1]:
        return None
    p = permuted(d[:-1], "card", key)
    return refill(m, p + luhn(p))


def iban(m, key):
    known = " ".join(pii.IBAN_COUNTRIES.values()).split()
    tokens = m.split(" ")
    for k in range(len(tokens), 0, -1) if m[:2] not in known else [len(tokens)]:
        spelling = " ".join(tokens[:k])
        v = spelling.replace(" ", "")
        if len(v) >= 12 and mod97(v[4:] + v[:4]) == 1:
            p = permuted(v[4:], "iban", key)
            return refill(spelling, f"{v[:2]}{98 - mod97(p + v[:2] + '00'):02d}{p}", "A-Z0-9") + m[len(spelling) :]
    return None


def ip(m, key):
    o = list(map(int, m.split(".")))
    if max(o) > 255:
        return None
    n = number(sum(x << s for x, s in zip(o, (24, 16, 8, 0))), (1 << 16, 1 << 16), "ip", key)
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def date(m, key):
    a = re.split("[-./]", m)
    forms = {"-": [(0, 1, 2)], ".": [(2, 1, 0)], "/": [(2, 0, 1), (2, 1, 0)]}[re.search("[-./]", m)[0]]
    for y, mo, d in forms:
        try:
            day = datetime.date(int(a[y]), int(a[mo]), int(a[d]))
        except ValueError:
            continue
        c = day.year // 100
        first = datetime.date(max(c * 100, 1), 1, 1)
        sizes = pii.FIRST_CENTURY if c == 0 else pii.LONG_CENTURY if c % 4 == 0 else pii.CENTURY
        new = first + datetime.timedelta(number((day - first).days, sizes, f"date{c * 100}", key))
        parts = [""] * 3
        parts[y], parts[mo], parts[d] = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        return re.search("[-./]", m)[0].join(parts)
    return None


def phone(m, key):
    code = "+1" if re.fullmatch(r"\+1\d{10}", m) else (re.match(r"\+\d{1,3}(?=[ .(-])", m) or [""])[0]
    rest, n = m[len(code) :], len(re.sub("[^0-9]", "", m))
    return code + refill(rest, permuted(re.sub("[^0-9]", "", rest), "phone", key)) if 7 <= n <= 15 else None


def pseudonym(m, key):
    if "@" in m:
        return permuted(m.split("@")[0].lower(), "email", key) + "@" + m.rsplit("@", 1)[1]
    if re.match("[A-Z]", m):
        return iban(m, key)
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        return ip(m, key)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}", m):
        return date(m, key)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        return None if re.match("000|666|9", m) or re.search("-00-|-0000$", m) else refill(m, permuted(m.replace("-", ""), "ssn", key))
    if re.match(r"[+(]|\d{3}[.-]\d{3}[.-]\d{4}$", m):
        return phone(m, key)
    return card(m, key)


PATTERN = re.compile(pii._any_pattern(), re.A)


def plain(text, key):
    if text is None:
        return None, 0
    n = 0

    def one(m):
        nonlocal n
        p = pseudonym(m[0], key)
        n += p is not None
        return m[0] if p is None else p

    return PATTERN.sub(one, text), n


ODD = [
    None, "", "no numbers", "born 1850-01-01, 31.12.0099, 02/29/2000 and 29/02/2096, due 2101-05-05 or 9999-12-31, not 1900-02-29, 0000-01-01 or 13/13/2013",
    "a.B-c_9@x.org, B.b@x.org +49 (30) 1234 5678 call 555-123-4567 (555) 123-4567 +15551234567 000-12-3456 123-45-6789 999-99-9999",
    "4952935900253052 4952-9359-0025-3052 4952 9359 0025 3053 378282246310005 3782 822463 10005", "DE89 3704 0044 0532 0130 00 BE68539007547034 BIC KREDBEBB GB29NWBK60161331926819 ZZ12 1234 5678 9012",
    "1.2.3.4 255.255.255.255 256.1.1.1 1.2.3.4.5 0.0.0.0", "4952935900253052 x " * 3000,
]


def test_texts_against_the_plain_version(spark):
    rows = list(enumerate(ODD * 2))
    for key in ("k", "another"):
        out = {r[0]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()}
        for k, t in rows:
            assert (out[k]["text"], out[k]["n_pseudonyms"]) == plain(t, key), t


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_query_against_the_plain_version(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = catalogue.op4_feistel_pii(spark, SF).collect()
    assert len(out) == len(docs) and sum(r["n_pseudonyms"] for r in out) > 0
    for r in out:
        assert (r["text"], r["n_pseudonyms"]) == plain(docs[r["doc_id"]], catalogue.PII_KEY)


def test_every_date_moves_within_its_century_and_none_meet(spark):
    for year, sizes in ((0, pii.FIRST_CENTURY), (1800, pii.CENTURY), (2000, pii.LONG_CENTURY)):
        days = spark.range(sizes[0] * sizes[1]).select(F.date_format(F.date_add(F.make_date(F.lit(max(year, 1)), F.lit(1), F.lit(1)), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
        out = days.select("d", pii.pseudonym(F.col("d"), F.lit("k")).alias("p"))
        assert out.select("p").distinct().count() == sizes[0] * sizes[1] and out.where("p is null or substr(p, 1, 2) <> substr(d, 1, 2)").isEmpty()


def test_the_key_may_be_a_column(spark):
    docs = spark.createDataFrame([(1, ODD[4], "secret")], "doc_id long, text string, k string")
    out = pii.pseudonymise(docs, F.col("k")).first()
    assert out["text"] == plain(ODD[4], "secret")[0] and out["text"] == pii.pseudonymise(docs, "secret").first()["text"]
