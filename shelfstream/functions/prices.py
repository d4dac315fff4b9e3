"""Price bounds that a query states, read from its words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_marks

# Words before a number that bound the price, and whether the number itself is allowed.
UPPER_BEFORE = {"duoi": False, "khong qua": True, "khong hon": True, "khong tren": True, "toi da": True, "den": True, "under": False, "below": False, "less than": False, "up to": True, "at most": True, "<=": True}
LOWER_BEFORE = {"tren": False, "hon": False, "khong duoi": True, "tu": True, "it nhat": True, "toi thieu": True, "over": False, "above": False, "more than": False, "at least": True, "from": True, ">=": True}
# Words behind a number that bound the price; the number itself is allowed.
UPPER_AFTER = ("tro xuong", "or less", "or lower", "maximum", "max")
LOWER_AFTER = ("tro len", "or more", "or higher", "minimum", "min")
# Words around the two numbers of a range, the word that may stand before a number, units and currencies.
RANGE_OPEN, RANGE_WORDS, RANGE_SIGNS = ("tu", "from", "between"), ("den", "toi", "to", "and"), ("-", "–", "—")
FILLER = "gia"
UNITS = {"k": 1000, "nghin": 1000, "ngan": 1000, "trieu": 1_000_000, "tr": 1_000_000, "million": 1_000_000, "m": 1_000_000}
UNIT_CURRENCY = {"k": "VND", "nghin": "VND", "ngan": "VND", "trieu": "VND", "tr": "VND"}
CURRENCIES = {"vnd": "VND", "usd": "USD", "d": "VND"}

_TOKEN = r"\d+(?:[.,]\d+)*|\p{L}+|[$]|<=|>=|[-–—]"


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _value(digits: Column, factor: Column) -> Column:
    """Groups of three digits without a unit are thousands; else the first point or comma is a decimal mark."""
    grouped = (factor == 1) & digits.rlike(r"^\d{1,3}([.,]\d{3})+$")
    decimal = F.regexp_extract(F.replace(digits, F.lit(","), F.lit(".")), r"^\d+(?:\.\d+)?", 0)
    return F.floor(F.when(grouped, F.regexp_replace(digits, "[.,]", "")).otherwise(decimal).cast("double") * factor + 0.5).cast("long")


def _amount(words: Column, word: Column, i: Column) -> Column:
    """The number at place i with its unit and currency, and what the words before and behind it say."""
    at = lambda j: F.coalesce(F.get(words, j), F.lit(""))
    two = lambda j: F.concat_ws(" ", at(j), at(j + 1))
    dollar = at(i - 1) == "$"
    unit = F.when(at(i + 1).isin(*UNITS), at(i + 1))
    named = i + 1 + F.when(unit.isNotNull(), 1).otherwise(0)
    money = _lookup(CURRENCIES, at(named))
    start, end = i - dollar.cast("int"), named + money.isNotNull().cast("int")  # first word, and the word after the last
    before = start - F.when(at(start - 1) == FILLER, 1).otherwise(0)
    side = {**dict.fromkeys(UPPER_BEFORE, "max"), **dict.fromkeys(LOWER_BEFORE, "min")}
    phrase = F.when(two(before - 2).isin(*[p for p in side if " " in p]), two(before - 2)).otherwise(at(before - 1))
    behind = lambda phrases: at(end).isin(*phrases) | two(end).isin(*phrases)
    return F.when(
        word.rlike(r"^\d"),
        F.struct(
            _value(word, F.coalesce(_lookup(UNITS, unit), F.lit(1))).alias("value"),
            F.coalesce(_lookup(UNIT_CURRENCY, unit), money, F.when(dollar, "USD")).alias("currency"),
            start.alias("start"), end.alias("end"),
            _lookup(side, phrase).alias("side"), _lookup(UPPER_BEFORE | LOWER_BEFORE, phrase).alias("inclusive"),
            F.when(behind(UPPER_AFTER), "max").when(behind(LOWER_AFTER), "min").alias("side_after"),
            at(start - 1).isin(*RANGE_OPEN).alias("opens"), at(end).isin(*RANGE_WORDS).alias("joins"), at(end).isin(*RANGE_SIGNS).alias("dash"),
        ),
    )


def _bounds(low: Column, high: Column, low_in: Column, high_in: Column, money: Column) -> Column:
    return F.struct(low.cast("long").alias("min"), high.cast("long").alias("max"), low_in.alias("min_inclusive"), high_in.alias("max_inclusive"), money.alias("currency"))


def price_constraint(c: Column) -> Column:
    """struct(min, max, min_inclusive, max_inclusive, currency) that a text asks for, or null.

    The words become a list of amounts, each with what is said around it. In
    this order: a range in words, a range by a dash, a bound from above before
    and then behind a number, a bound from below before and then behind one.
    """
    words = F.regexp_extract_all(F.translate(strip_marks(F.lower(c)), "đ", "d"), F.lit(_TOKEN), F.lit(0))
    yes, none = F.lit(True), F.lit(None)

    def of(amounts: Column) -> Column:
        first = lambda test: F.get(F.filter(amounts, test), F.lit(0))
        pairs = F.transform(amounts, lambda a, i: F.struct(a.alias("a"), F.get(amounts, i + 1).alias("b")))
        meets = lambda p: p["b"]["start"] == p["a"]["end"] + 1
        spans = [F.get(F.filter(pairs, test), F.lit(0)) for test in (lambda p: meets(p) & p["a"]["opens"] & p["a"]["joins"], lambda p: meets(p) & p["a"]["dash"])]
        out = F.when(F.lit(False), _bounds(none, none, yes, yes, none.cast("string")))
        for s in spans:
            a, b = s["a"], s["b"]
            out = out.when(s.isNotNull(), _bounds(F.least(a["value"], b["value"]), F.greatest(a["value"], b["value"]), yes, yes, F.coalesce(a["currency"], b["currency"])))
        for side in ("max", "min"):
            for x, inclusive in ((first(lambda a: a["side"] == side), True), (first(lambda a: a["side_after"] == side), False)):  # noqa: B023
                own = x["inclusive"] if inclusive else yes
                out = out.when(x.isNotNull(), _bounds(none, x["value"], yes, own, x["currency"]) if side == "max" else _bounds(x["value"], none, own, yes, x["currency"]))
        return out

    # Outer one-element arrays: their variables are evaluated once.
    amounts = lambda w: F.filter(F.transform(w, lambda t, i: _amount(w, t, i)), lambda a: a.isNotNull())
    return F.transform(F.transform(F.array(words), amounts), of)[0]


def price_matches(price: Column, currency: Column, want: Column) -> Column:
    """Whether a lowest price meets a ``price_constraint``; no constraint is met by all."""
    low, high = want["min"], want["max"]
    above = low.isNull() | F.when(want["min_inclusive"], price >= low).otherwise(price > low)
    below = high.isNull() | F.when(want["max_inclusive"], price <= high).otherwise(price < high)
    return want.isNull() | ((want["currency"].isNull() | (want["currency"] == currency)) & above & below)
