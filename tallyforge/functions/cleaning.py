"""Cell cleaning as columns (F1-F11, F15): a value or null, never a default."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spaces, minus signs, blank words, date forms, currency words, currency suffixes.
SPACES = "          "
MINUS = "-−–—"
BLANKS = ("", "-", "--", "—", "–", "−", "n/a", "na", "нет", "null", "none")
DATE_FORMS = (("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"), ("d.M.yy", r"^\d{1,2}\.\d{1,2}\.\d{2}$"), ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("yyyy.M.d", r"^\d{4}\.\d{1,2}\.\d{1,2}$"))
CURRENCIES = {
    "RUB": ("RUB", "RUR", "643", "РУБ", "РУБ.", "РУБЛЬ", "РУБЛИ", "РОССИЙСКИЙ РУБЛЬ", "₽"),
    "USD": ("USD", "840", "$", "ДОЛЛАР", "ДОЛЛАР США", "ДОЛЛ.США"),
    "EUR": ("EUR", "978", "€", "ЕВРО"),
    "CNY": ("CNY", "156", "ЮАНЬ", "КИТАЙСКИЙ ЮАНЬ"),
}
CURRENCY_SUFFIX = r"(?i)(₽|руб\.?|rub|rur|usd|\$|eur|€|cny)$"
PUNCTUATION = r"""[«»"'()\[\]:;,.]+"""
#: What most cells look like. They are read at once; the rest goes through all steps, which give the same for these.
PLAIN_NUMBER, PLAIN_DATE = r"^-?\d+([.,]\d+)?\z", r"^\d{2}\.\d{2}\.[1-9]\d{3}\z"


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def split_code(name: str) -> Column:
    """The column as it is, by a step that Spark leaves out of whole-stage code: a projection that has it is compiled as many
    small methods. As one method of over 8,000 bytes it would run uncompiled by the JVM."""
    return let(F.col(name), lambda x: x).alias(name)


def normalize_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), f"[ \\t\\r\\n{SPACES}]+", " "))


def is_blank(x: Column) -> Column:
    t = F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t\r\n" + SPACES))
    return (F.length(t) <= max(map(len, BLANKS))) & F.lower(t).isin(*BLANKS)


def number_digits(x: Column) -> Column:
    """The unsigned number with a dot for the decimal mark; empty where separators make no number."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(x, "[ ']", ""), CURRENCY_SUFFIX, ""))

    def of(t: Column) -> Column:
        drop = lambda mark: F.replace(t, F.lit(mark), F.lit(""))
        comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
        comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
        both = F.when(comma_last, F.replace(drop("."), F.lit(","), F.lit("."))).otherwise(drop(","))
        one = F.when(F.regexp_like(t, F.lit(r"^[^.,]*[.,][^.,]*$")), F.replace(t, F.lit(","), F.lit(".")))
        one = one.when(F.regexp_like(t, F.lit(r"^[^.,]*([.,]\d{3}){2,}$")), F.regexp_replace(t, "[.,]", "")).otherwise("")
        return F.when(comma & dot, both).when(comma | dot, one).otherwise(t)

    return let(bare, of)


def parse_decimal(x: Column, kind: str = "decimal(28,10)") -> Column:
    """Locale number; null where blank or not a number (tell them apart with ``is_blank``)."""
    def unsigned(t: Column) -> Column:
        bracket = F.regexp_like(t, F.lit(r"^\(.*\)$"))
        return F.struct(bracket.alias("bracket"), F.when(bracket, F.trim(F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t).alias("t"))

    def digits(s: Column) -> Column:
        minus = F.regexp_like(s["t"], F.lit(f"^[{MINUS}]"))
        plain = F.trim(F.regexp_replace(F.trim(F.regexp_replace(s["t"], f"^[{MINUS}]", "")), r"^\+", ""))
        return F.struct((s["bracket"] != minus).alias("negative"), number_digits(plain).alias("n"))

    def value(s: Column) -> Column:
        n = F.when(F.regexp_like(s["n"], F.lit(r"^(\d*\.?\d+|\d+\.?\d*)$")), s["n"]).try_cast(kind)
        return F.when(s["negative"], -n).otherwise(n).cast(kind)

    plain = lambda t: F.replace(t, F.lit(","), F.lit(".")).try_cast(kind)
    joint = F.regexp_replace(x, f"[ {SPACES}]+", "")
    is_plain = lambda t: F.regexp_like(t, F.lit(PLAIN_NUMBER))
    return F.when(is_plain(x), plain(x)).when(is_plain(joint), plain(joint)).when(~is_blank(x), let(let(let(normalize_text(x), unsigned), digits), value))


def parse_date(x: Column) -> Column:
    head = F.split(normalize_text(x), "[ T]")[0]
    out = None
    for form, like in DATE_FORMS:
        d = F.when(F.regexp_like(head, F.lit(like)), F.try_to_timestamp(head, F.lit(form)).cast("date"))
        if form == "d.M.yy":  # two digits from 69 on are the last century
            d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
        out = d if out is None else F.coalesce(out, d)
    iso = F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2))
    return F.when(F.regexp_like(x, F.lit(PLAIN_DATE)), iso.try_cast("date")).otherwise(out)


def parse_currency(x: Column) -> Column:
    t = F.upper(normalize_text(x))
    alias = F.create_map(*[F.lit(v) for v in chain.from_iterable((a, code) for code, names in CURRENCIES.items() for a in names)])
    return F.coalesce(F.try_element_at(alias, t), F.when(F.regexp_like(t, F.lit("^[A-Z]{3}$")), t))


def format_decimal(x: Column, places: int) -> Column:
    return F.translate(F.format_number(x, places), ",.", " ,")


def normalize_signature(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(normalize_text(x)), "ё", "е"), PUNCTUATION, " "), " +", " "))


def isin(x: Column) -> Column:
    t = F.upper(normalize_text(x))
    return F.when(F.regexp_like(t, F.lit(r"^[A-Z]{2}[A-Z0-9]{9}\d$")), t)


def ticker(x: Column) -> Column:
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


def exchange_date(x: Column) -> Column:
    return F.when(~F.startswith(x, F.lit("0000")), x).try_cast("date")


def exchange_decimal(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("decimal(28,10)")


def exchange_currency(x: Column) -> Column:
    return F.when(F.upper(x) == "SUR", "RUB").otherwise(F.upper(x))


def known_coupon(value: Column, rate: Column) -> Column:
    """Zero means unknown unless the rate is zero too."""
    return F.when(value.isNotNull() & ((value != 0) | F.coalesce(rate == 0, F.lit(False))), value)
