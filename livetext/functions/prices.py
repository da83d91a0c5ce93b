"""Spoken prices: digits, number words and spoken digit groups, completed to the price nearest to the market."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words, scales, words without a value, and words that part groups.
NUMBERS = {
    "zero": 0, "oh": 0, "o": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALES, FILLERS, PARTS = {"hundred": 100, "thousand": 1000}, ("and", "the", "a", "an"), ("oh", "o")
#: Ways to part two to four words into groups of one or two.
GROUPINGS = {2: [(1, 1)], 3: [(1, 1, 1), (1, 2), (2, 1)], 4: [(1, 1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2)]}


def _once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _value(word: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word)


def plain_number(tokens: Column) -> Column:
    """The number that words say by the usual rules (twenty five thousand twenty); null where they don't."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"), F.lit(False).alias("some"), F.lit(True).alias("fine"))

    def step(a, t):
        number, scale, filler = _value(t, NUMBERS), _value(t, SCALES), t.isin(*FILLERS)
        scaled = F.greatest(a["now"], F.lit(1)) * scale
        total = F.when(scale == 1000, a["total"] + scaled).otherwise(a["total"])
        now = F.when(filler, a["now"]).when(number.isNotNull(), a["now"] + number).when(scale == 100, scaled).otherwise(0)
        return F.struct(total.alias("total"), now.alias("now"), (a["some"] | ~filler).alias("some"), (a["fine"] & ~t.isin(*PARTS)).alias("fine"))

    return _once(F.aggregate(tokens, start, step), lambda a: F.when(a["some"] & a["fine"], a["total"] + a["now"]))


def grouped_numbers(tokens: Column) -> Column:
    """Numbers that two to four words say in groups of digits (nineteen fifty): later groups may stand for two or three digits."""
    words = F.filter(tokens, lambda t: ~t.isin(*FILLERS))
    values = F.transform(words, lambda t: F.when(t.isin(*PARTS), -1).otherwise(_value(t, NUMBERS)))
    none = F.array().cast("array<long>")

    def of(v):
        def grouping(sizes):
            groups, at = [], 0
            for size in sizes:
                first, last = F.get(v, F.lit(at)), F.get(v, F.lit(at + size - 1))
                both = F.when((first < 0) | (last < 0), F.lit(1000)).otherwise(first + last) if size == 2 else F.when(first < 0, F.lit(None)).otherwise(first)
                groups.append(both)
                at += size
            kept = F.filter(F.array(*groups), lambda g: g.isNotNull())
            longer = lambda acc, g: F.flatten(F.transform(acc, lambda s: F.array(*[F.concat(s, x) for x in (g.cast("string"), F.lpad(g.cast("string"), 2, "0"), F.lpad(g.cast("string"), 3, "0"))])))
            texts = F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(F.element_at(kept, 1).cast("string")), longer)
            fine = (F.size(kept) >= 2) & F.forall(kept, lambda g: g < 100)
            return F.when(fine, F.transform(texts, lambda s: s.cast("long"))).otherwise(none)

        cases = [(F.size(v) == n, F.concat(*map(grouping, ways))) for n, ways in GROUPINGS.items()]
        return reduce(lambda w, c: w.when(*c), cases[1:], F.when(*cases[0])).otherwise(none)

    return F.when(F.exists(words, lambda t: t.isin(*SCALES)), none).otherwise(_once(values, of))


def resolve_price(raw: Column, market: Column) -> Column:
    """The price that a spoken one means. Numbers below 1,000 are the end of a price: of all completions within 500 points of
    the market and one more place the nearest to the market counts. Quarter, half and three quarter add their part."""
    t = F.regexp_replace(F.replace(F.lower(F.trim(raw)), F.lit("-"), F.lit(" ")), r"(?<=[0-9]),(?=[0-9])", "")
    known = [*NUMBERS, *SCALES, *FILLERS]

    def candidates(rest):
        digits = F.nullif(F.regexp_extract(rest, r"([0-9]{1,5}(?:\.[0-9]{1,2})?)", 1), F.lit("")).cast("double")
        tokens = F.filter(F.transform(F.split(rest, r"\s+"), lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: w.isin(*known))
        found = _once(tokens, lambda w: F.concat(F.array(plain_number(w).cast("double")), F.transform(grouped_numbers(w), lambda x: x.cast("double"))))
        return F.array_distinct(F.filter(F.concat(F.array(digits), found), lambda x: x.isNotNull()))

    def expanded(value, market, part):
        whole = F.floor(value)
        place = F.pow(F.lit(10), F.least(F.length(whole.cast("string")), F.lit(3))).cast("long")

        def near(k, x):
            base = F.bround(market).cast("long") + k * 100
            ends = lambda end: F.filter(F.array(end, F.when(end - x["place"] > 0, end - x["place"]), end + x["place"]), lambda e: e.isNotNull())
            return _once(base - F.pmod(base, x["place"]) + x["whole"], ends)

        fixed = F.struct(whole.alias("whole"), place.alias("place"))
        many = _once(fixed, lambda x: F.transform(F.flatten(F.transform(F.sequence(F.lit(-5), F.lit(5)), lambda k: near(k, x))), lambda e: e + part))
        return F.when((value >= 1000) | market.isNull(), F.array(value + part)).otherwise(many)

    def nearest(t, market):
        part = F.when(t.contains("three quarter"), 0.75).when(t.contains("quarter"), 0.25).when(t.contains("half"), 0.5).otherwise(0.0)
        rest = F.when(t.contains("three quarter"), F.replace(t, F.lit("three quarter"), F.lit(""))).when(t.contains("quarter"), F.replace(t, F.lit("quarter"), F.lit(""))).otherwise(F.replace(t, F.lit("half"), F.lit("")))
        prices = lambda x: F.flatten(F.transform(candidates(x["rest"]), lambda v: expanded(v, market, x["part"])))
        best = lambda found: F.array_min(F.transform(found, lambda p, k: F.struct(F.abs(p - F.coalesce(market, p)).alias("d"), k.alias("k"), p.alias("p"))))
        return best(_once(F.struct(part.alias("part"), rest.alias("rest")), prices))

    # text, part and market are computed once, not in the functions of each completion
    best = _once(F.struct(t.alias("t"), market.alias("market")), lambda x: nearest(x["t"], x["market"]))
    return F.round(best["p"], 2)
