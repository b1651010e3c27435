"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

A pattern finds candidates; validation decides: card numbers by their check digit, IBANs by their remainder, social
security numbers by their areas, addresses of version 4 by their octets, dates by the calendar. A valid value becomes a
list of symbols, each with its own base, and a Feistel network permutes the list: alternately one half is shifted,
symbol by symbol, by values derived from the key and the other half. So equal values get equal pseudonyms in all
documents, different values different ones, separators stay, check digits are made to fit again, and all kinds keep
their length but addresses (octets of one to three digits) and dates written without leading zeros.

Cards and IBANs are parts of longer runs of digits or words: every start in a run has its own window, and the window's
beginnings that end with a group are tried, so that a failing one hides no valid one.

Kinds: email (local part, permuted under its domain), phone, card, ssn, iban, ip, date (from 1800-01-01 to 2199-07-11; year-month-day, and
day, month, year with dots or slashes, month first where only that is a date) and secret (access keys, and values given
to names such as token or password). Dates outside that range and calendar stay as they are.

The key is the setting spark.quillmesh.pii.key of the session; without it an example key holds, which hides nothing from
readers of this file.

Defined cases: null text stays null; empty text and text without valid values stay as they are; very long texts are taken
whole; of overlapping candidates the first start wins, at a tie the kinds' order and then the longer value; repeated rows
are treated alike; an empty table gives no rows; all other columns are passed along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import table

#: The key where the session's KEY_SETTING is unset.
KEY = "quillmesh-example-key"
KEY_SETTING = "spark.quillmesh.pii.key"
ROUNDS = 8
DATE_FROM, DATE_SIDE = "1800-01-01", 382
DATE_DAYS = DATE_SIDE * DATE_SIDE

_NAME = r"(?i:(?:token|password|passwd|secret(?:[_\-]?(?:access[_\-]?)?key)?|api[_\-]?key)(?:\\?[\"'])?[ \t]*+(?:=>|:=|[=:])[ \t]*+(?:\\?[\"'])?)"
_PART = r"[A-Za-z0-9+/_\-]"
_DIGIT = r"[ .\-()]{0,2}[0-9]"

#: Kinds in the order in which they are tried, and their patterns (Java).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "secret": rf"\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b|\bsk-[A-Za-z0-9_\-]{{20,}}+|\bgh[pousr]_[A-Za-z0-9]{{36,}}+|{_NAME}(?![A-Za-z0-9._%+\-]{{1,64}}+@[A-Za-z0-9\-]++\.[A-Za-z])(?:{_PART}|\.(?={_PART})){{8,}}+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){8,31}\b",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9\-/.])(?:(?:1[89]|2[01])[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9\-/]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])(?<=\+" + _DIGIT * 10 + f"(?:{_DIGIT})?" * 5 + r")|(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9])",
}

#: Kinds whose values are parts of longer runs: their windows, from every start, overlap.
RUNS = ["iban", "card"]
WINDOWS = "(?=(" + "|".join(PATTERNS[k] for k in RUNS) + "))"
#: What is tried at a place of the text before the valid values of runs.
SINGLE = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k not in RUNS)

#: Something of this is in every text with a candidate; texts without skip the dearer patterns.
GUARD = r"@|(?:AKIA|ASIA)[0-9A-Z]|\bsk-|\bgh[pousr]_|(?i:token|passw|secret|api[_\-]?key)|[0-9][./\-][0-9]{1,3}[./\-][0-9]|[0-9](?:[ .\-()]{0,2}[0-9]){9}|\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){8}"

#: Length of an IBAN by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

#: What of a secret is kept.
SECRET_HEAD = rf"^(?:(?:AKIA|ASIA)(?=[0-9A-Z]{{16}}$)|sk-|gh[pousr]_|{_NAME})"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _ints(s: Column) -> Column:
    """Digits of a string of digits as an array; empty for the empty string."""
    return F.when(s == "", F.expr("cast(array() as array<int>)")).otherwise(F.transform(F.split(s, ""), lambda c: c.cast("int")))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def luhn(digits: Column) -> Column:
    """Remainder of the check sum of a string of digits (0: valid)."""
    return _total(F.transform(F.reverse(_ints(digits)), lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))) % 10


def _mod97(chars: Column) -> Column:
    """An IBAN moved to its check order, modulo 97."""
    moved = F.concat(F.substring(chars, 5, 40), F.substring(chars, 1, 4))
    step = lambda x, c: F.when(c.rlike("[0-9]"), (x * 10 + c.cast("int")) % 97).otherwise((x * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda x, c: F.when(c == "", x).otherwise(step(x, F.when(c == "", F.lit("0")).otherwise(c))))


def feistel(symbols: Column, bases: Column, tweak: Column, key: str = KEY) -> Column:
    """A keyed permutation of arrays of symbols (each 0 to its base - 1)."""
    half = F.floor(F.size(symbols) / 2).cast("int")

    def step(acc: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(acc, half + 1, F.size(acc) - half)).otherwise(F.slice(acc, 1, half))
        secret = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)
        # bound by a transform of one element, so it is made once a round and not once a symbol
        moved = lambda h: F.transform(acc, lambda x, i: F.when((i < half) == left, F.pmod(x + F.pmod(F.xxhash64(h, i), F.get(bases, i).cast("long")).cast("int"), F.get(bases, i))).otherwise(x))
        return F.get(F.transform(F.array(secret), moved), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), symbols, step)


def _text_symbols(s: Column) -> tuple[Column, Column]:
    """Symbols and bases of letters and digits; other characters have base 1."""
    code = lambda c: F.ascii(c)
    symbol = lambda c: F.when(c.rlike("[0-9]"), code(c) - 48).when(c.rlike("[a-z]"), code(c) - 97).when(c.rlike("[A-Z]"), code(c) - 65).otherwise(0)
    base = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1)
    return F.transform(F.split(s, ""), symbol), F.transform(F.split(s, ""), base)


def _text_from(s: Column, symbols: Column) -> Column:
    back = lambda c, i: F.when(c.rlike("[0-9]"), F.char(F.get(symbols, i) + 48)).when(c.rlike("[a-z]"), F.char(F.get(symbols, i) + 97)).when(c.rlike("[A-Z]"), F.char(F.get(symbols, i) + 65)).otherwise(c)
    return F.array_join(F.transform(F.split(s, ""), back), "")


def _days(m: Column) -> Column:
    """struct of days since DATE_FROM (null if not a date of the range) and form of a date's text."""
    parts = F.split(m, "[/.]")
    x, y, z = (F.get(parts, k) for k in range(3))
    form = F.when(m.contains("-"), F.lit("ymd")).when(y.cast("int") <= 12, F.lit("dmy")).otherwise(F.lit("mdy"))
    iso = lambda a, b: F.concat_ws("-", z, F.lpad(a, 2, "0"), F.lpad(b, 2, "0"))
    text = F.when(form == "ymd", m).when(form == "dmy", iso(y, x)).otherwise(iso(x, y))
    days = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(DATE_FROM).cast("date"))
    return F.struct(days.alias("days"), form.alias("form"))


def _date_text(days: Column, form: Column, old: Column) -> Column:
    date = F.date_add(F.lit(DATE_FROM).cast("date"), days)
    sep = F.when(old.contains("/"), F.lit("/")).otherwise(F.lit("."))
    part = lambda p: F.when(F.length(old) == 10, F.date_format(date, p + p)).otherwise(F.date_format(date, p))
    first, second = F.when(form == "dmy", part("d")).otherwise(part("M")), F.when(form == "dmy", part("M")).otherwise(part("d"))
    return F.when(form == "ymd", F.date_format(date, "yyyy-MM-dd")).otherwise(F.concat_ws("", first, sep, second, sep, F.date_format(date, "yyyy")))


def _redigit(old: Column, digits: Column) -> Column:
    """old with its digits replaced in order."""
    at = lambda i: F.length(_digits(F.substring(old, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(old, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), "")


def _kind(m: Column) -> Column:
    tried = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        tried = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(tried)
    return tried


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("int"))


def _parsed(x: Column) -> Column:
    """x (m, kind) with digits, date and whether the value is valid."""
    m, kind = x["m"], x["kind"]
    d = F.when(kind.isin("card", "ssn", "phone"), _digits(m)).otherwise("")
    area = F.substring(m, 1, 3)
    date = F.when(kind == "date", _days(m))
    valid = (
        F.when(kind == "card", luhn(_digits(m)) == 0)
        .when(kind == "iban", _mod97(F.regexp_replace(m, " ", "")) == 1)
        .when(kind == "ip", F.forall(_octets(m), lambda v: v < 256))
        .when(kind == "date", F.coalesce(_days(m)["days"].between(0, DATE_DAYS - 1), F.lit(False)))
        .when(kind == "ssn", ~area.isin("000", "666") & (area < "900") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"))
        .when(kind == "phone", F.length(_digits(m)).between(10, 15))
        .otherwise(kind.isNotNull())
    )
    return F.struct(m.alias("m"), F.when(valid, kind).alias("kind"), d.alias("d"), date.alias("date"))


def _parted(x: Column) -> Column:
    """x with head (kept), s (permuted as text) and whole (the value without its separators)."""
    m, kind, d = x["m"], x["kind"], x["d"]
    head = (
        F.when(kind == "secret", F.regexp_extract(m, SECRET_HEAD, 0))
        .when(kind == "card", F.substring(d, 1, 1))
        .when(kind == "phone", F.substring(d, F.lit(1), F.greatest(F.length(d) - 9, F.lit(1))))
        .otherwise("")
    )
    s = (
        F.when(kind == "email", F.substring_index(m, "@", 1))
        .when(kind == "secret", F.substring(m, F.length(F.regexp_extract(m, SECRET_HEAD, 0)) + 1, F.length(m)))
        .when(kind == "card", F.substring(d, F.lit(2), F.length(d) - 2))
        .when(kind == "phone", F.substring(d, F.greatest(F.length(d) - 9, F.lit(1)) + 1, F.length(d)))
        .when(kind == "iban", F.substring(F.regexp_replace(m, " ", ""), 5, 40))
        .otherwise("")
    )
    return F.struct(m.alias("m"), kind.alias("kind"), d.alias("d"), x["date"].alias("date"), head.alias("head"), s.alias("s"))


def _listed(x: Column) -> Column:
    """x with its symbols and bases."""
    m, kind = x["m"], x["kind"]
    symbols, bases = _text_symbols(x["s"])
    ints = lambda *v: F.array(*(c.cast("int") if isinstance(c, Column) else F.lit(c) for c in v))
    area = F.substring(m, 1, 3).cast("int")
    days = x["date"]["days"]
    v = (
        F.when(kind == "ip", _octets(m))
        .when(kind == "date", ints(F.floor(days / DATE_SIDE), days % DATE_SIDE))
        .when(kind == "ssn", ints(area - F.when(area > 666, 2).otherwise(1), F.substring(m, 5, 2).cast("int") - 1, F.substring(m, 8, 4).cast("int") - 1))
        .otherwise(symbols)
    )
    b = F.when(kind == "ip", ints(256, 256, 256, 256)).when(kind == "date", ints(DATE_SIDE, DATE_SIDE)).when(kind == "ssn", ints(898, 99, 9999)).otherwise(bases)
    return F.struct(m.alias("m"), kind.alias("kind"), x["date"].alias("date"), x["head"].alias("head"), x["s"].alias("s"), v.alias("v"), b.alias("b"))


def _permuted(key: str):
    def run(x: Column) -> Column:
        tweak = F.when(x["kind"] == "email", F.concat(x["kind"], F.lower(F.substring_index(x["m"], "@", -1)))).otherwise(x["kind"])
        v = F.when(x["kind"].isNotNull(), feistel(x["v"], x["b"], tweak, key)).otherwise(x["v"])
        return F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["date"].alias("date"), x["head"].alias("head"), x["s"].alias("s"), v.alias("v"))

    return run


def _written(x: Column) -> Column:
    """x with its symbols as text; a step of its own, so that they aren't permuted again for each of them."""
    text = F.when(x["kind"].isin("email", "secret", "card", "phone", "iban"), _text_from(x["s"], x["v"])).otherwise("")
    return F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["date"].alias("date"), x["head"].alias("head"), x["v"].alias("v"), text.alias("t"))


def _rendered(x: Column) -> Column:
    m, kind, v, t = x["m"], x["kind"], x["v"], x["t"]
    body = F.concat(x["head"], t)
    card = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    country = F.substring(m, 1, 2)
    bank = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), t))).cast("string"), 2, "0"), t)
    gaps = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), " ", ""))
    iban = F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(bank, gaps(i), F.lit(1)))), "")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    ssn = F.concat_ws("-", pad(F.get(v, 0) + F.when(F.get(v, 0) >= 665, 2).otherwise(1), 3), pad(F.get(v, 1) + 1, 2), pad(F.get(v, 2) + 1, 4))
    return (
        F.when(kind == "email", F.concat(t, F.lit("@"), F.substring_index(m, "@", -1)))
        .when(kind == "secret", body)
        .when(kind == "card", _redigit(m, card))
        .when(kind == "phone", _redigit(m, body))
        .when(kind == "iban", iban)
        .when(kind == "ip", F.array_join(F.transform(v, lambda x: x.cast("string")), "."))
        .when(kind == "date", _date_text(F.get(v, 0) * DATE_SIDE + F.get(v, 1), x["date"]["form"], m))
        .when(kind == "ssn", ssn)
        .otherwise(m)
    )


def _card(window: Column) -> Column:
    """The valid card number a window begins with: of its issuer's length if that is fixed, else the longest; or null."""
    groups = F.regexp_extract_all(window, F.lit("[ -]?[0-9]+"), 0)
    starts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, 1, n), ""))
    valid = F.filter(starts, lambda m: F.length(_digits(m)).between(13, 19) & (luhn(_digits(m)) == 0))
    first = F.substring(_digits(window), 1, 2)
    usual = F.when(first.isin("34", "37"), 15).when(first.isin("30", "36", "38", "39"), 14)
    return F.coalesce(F.get(F.filter(valid, lambda m: F.length(_digits(m)) == usual), F.lit(0)), F.get(valid, F.size(valid) - 1))


def _iban(window: Column) -> Column:
    """The valid IBAN a window begins with: of its country's length if there is one, else the longest; or null."""
    words = F.split(window, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    plain = lambda m: F.replace(m, F.lit(" "), F.lit(""))
    valid = F.filter(starts, lambda m: (F.length(plain(m)) >= 12) & (_mod97(plain(m)) == 1))
    usual = F.try_element_at(F.create_map(*(F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv)), F.substring(window, 1, 2))
    return F.coalesce(F.get(F.filter(valid, lambda m: F.length(plain(m)) == usual), F.lit(0)), F.get(valid, F.size(valid) - 1))


def _run_values(text: Column) -> Column:
    """The valid values of runs in a text; each start has its own window, so none hides another."""
    windows = F.array_distinct(F.regexp_extract_all(text, F.lit(WINDOWS), 1))
    return F.array_distinct(F.array_compact(F.transform(windows, lambda w: F.when(w.rlike("^[0-9]"), _card(w)).otherwise(_iban(w)))))


def _any(values: Column) -> Column:
    """The pattern of all candidates of a text from its valid values of runs, the longest first."""
    listed = F.array_join(F.transform(F.reverse(F.array_sort(values)), lambda v: F.concat(v, F.when(v.rlike("^[0-9]"), F.lit("(?![0-9])")).otherwise(F.lit(r"\b")))), "|")
    runs = F.concat(F.lit(rf"|(?={'|'.join(PATTERNS[k] for k in RUNS)})(?:"), listed, F.lit(")"))
    return F.when(F.size(values) > 0, F.concat(F.lit(SINGLE), runs)).otherwise(F.lit(SINGLE))


def pseudonymised(docs: DataFrame, column: str = "text", key: str | None = None) -> DataFrame:
    """row (all columns of docs), text (with pseudonyms) and kinds (an array with the kind of each replaced value).

    key: else that of the session's KEY_SETTING.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    df = docs.select(F.struct("*").alias("row"), F.col(column).alias("text"))
    df = df.withColumn("any", F.when(F.col("text").rlike(GUARD), _run_values(F.col("text"))))
    df = df.withColumn("any", F.when(F.col("any").isNotNull(), _any(F.col("any"))))
    df = df.withColumn("found", F.when(F.col("any").isNotNull(), F.regexp_extract_all("text", F.col("any"), 0)).when(F.col("text").isNotNull(), F.expr("cast(array() as array<string>)")))
    df = df.withColumn("x", F.transform("found", lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"))))
    for step in (_parsed, _parted, _listed, _permuted(key), _written):
        df = df.withColumn("x", F.transform("x", step))
    df = df.withColumn("new", F.transform("x", _rendered))
    pieces = F.zip_with(F.split("text", F.col("any"), -1), "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.size("found") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    return df.select("row", text.alias("text"), F.array_compact(F.col("x.kind")).alias("kinds"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("kinds", lambda k: k == kind)), F.lit(0)).alias(f"n_{kind}")

    return df.select("row.doc_id", "text", *map(count, PATTERNS))
