"""Which instruments a text is about: phrases of a symbol table, instruments named in a trade, and talk of other holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Results depend on these lists.
FAMILIES = [
    (["NQ", "MNQ"], ["nq", "mnq"]),
    (["ES", "MES"], ["es", "mes"]),
    (["YM", "MYM"], ["ym", "mym"]),
    (["RTY", "M2K"], ["rty", "m2k"]),
    (["CL", "MCL"], ["cl", "mcl", "oil", "crude"]),
    (["GC", "MGC"], ["gc", "mgc", "gold"]),
    (["SI", "SIL"], ["si", "silver"]),
]
OTHER_INSTRUMENTS = (
    "aapl amd amzn bitcoin btc crude eth ethereum gold hood meta msft nflx netflix nvda oil orcl oracle paypal silver tsla unh"
).split()
OTHER_HOLDINGS = [
    r"\bmulti year\b",
    r"\bmy swings?\b",
    r"\bsoftware companies\b",
    r"\ball the software\b",
    r"\bstocks that i m long in\b",
    r"\bstill holding this long on\b",
]
IN_A_TRADE = [
    r"\b(?:i m|i am|was|were)\s+(?:long|short)\s+in\s+([a-z][a-z0-9]{2,})\b",
    r"\b(?:started\s+getting|get(?:ting)?|got)\s+(?:long|short)\s+in\s+([a-z][a-z0-9]{2,})\b",
]
NO_INSTRUMENT = "all back front here it my one that the there this".split()
# End of the fixed values.

WORD = r"[\p{L}\p{N}_]+"


def symbol_root(symbol: Column) -> Column:
    """The contract root of a symbol: its first run of one to five letters, in capitals; null where there is none."""
    return F.nullif(F.upper(F.regexp_extract(symbol, "[A-Za-z]{1,5}", 0)), F.lit(""))


def known_aliases(spark, roots: DataFrame | None = None) -> DataFrame:
    """(root, alias) of the known families; of ``roots`` (root), those without a family are their own alias."""
    rows = [(root, alias) for members, names in FAMILIES for root in members for alias in names]
    known = spark.createDataFrame(rows, "root string, alias string")
    if roots is None:
        return known
    families = F.array(*[F.lit(r) for members, _ in FAMILIES for r in members])
    rest = roots.filter("root is not null").filter(~F.array_contains(families, F.col("root"))).distinct()
    return known.unionByName(rest.select("root", F.lower("root").alias("alias")))


def _keyed(aliases: DataFrame, *keep: str) -> DataFrame:
    """Aliases by their words: ``key`` holds the first two of them, or the only one; ``phrase`` all."""
    words = F.regexp_extract_all(F.lower("alias"), F.lit(WORD), F.lit(0))
    split = aliases.select(*keep, words.alias("w")).filter(F.size("w") > 0).distinct()
    phrase = F.array_join("w", " ")
    return split.select(*keep, F.array_join(F.slice("w", 1, 2), " ").alias("key"), phrase.alias("phrase"), F.size("w").alias("n"))


def alias_matches(rows: DataFrame, id_col: str, text: str, aliases: DataFrame) -> DataFrame:
    """(id, start, n, phrase): where aliases of ``aliases`` (alias) stand in a text, counted in words from 0.

    An alias may have any number of words. A match inside a longer one is none ("crude" in "crude oil"); matches that only overlap
    both count. Each place of a text is looked up by one word and by two, so texts meet only aliases that begin alike; further
    words are compared then. A word of a text is a run of letters, digits and underscores, whatever its case. Null and empty texts
    have no match, and so have aliases without a word.
    """
    table = _keyed(aliases)
    longest = table.agg(F.coalesce(F.max("n"), F.lit(1))).scalar()
    words = rows.select(id_col, F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("w"))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("start")
    # a place carries as many words as the longest alias has, not its text
    here = words.filter(F.size("w") > 0).select(id_col, "w", at)
    here = here.select(id_col, "start", F.slice("w", F.col("start") + 1, F.greatest(longest, F.lit(2))).alias("next"))
    keys = F.array_distinct(F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.array_join(F.slice("next", F.lit(1), k), " ")))
    looked = here.select(id_col, "start", "next", F.explode(keys).alias("key"))
    met = looked.join(table.hint("merge"), "key").filter(F.array_join(F.slice("next", F.lit(1), F.col("n")), " ") == F.col("phrase"))
    # of the matches that begin together the longest stays, unless an earlier one reaches as far
    best = met.groupBy(id_col, "start").agg(F.max("n").alias("n"), F.max_by("phrase", "n").alias("phrase"))
    before = Window.partitionBy(id_col).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    reach = best.withColumn("reach", F.max(end).over(before))
    return reach.filter(F.col("reach").isNull() | (end > F.col("reach"))).drop("reach")


def trade_instrument(rows: DataFrame, id_col: str, text: str, root: str, aliases: DataFrame, patterns: list[str], excluded: list[str]) -> DataFrame:
    """(id, inline): the instrument that the first pattern with a fit one names; own aliases and ``excluded`` words are none.
    A pattern counts by its first match only."""
    said = F.array(*[F.nullif(F.regexp_extract(F.col(text), p, 1), F.lit("")) for p in patterns])
    named = rows.select(id_col, F.col(root).alias("root"), F.posexplode(said).alias("pos", "alias"))
    named = named.filter(F.col("alias").isNotNull() & ~F.col("alias").isin(*excluded))
    own = aliases.select("root", F.lower("alias").alias("alias")).filter("root is not null").distinct()
    return named.join(own.hint("merge"), ["root", "alias"], "left_anti").groupBy(id_col).agg(F.min_by("alias", "pos").alias("inline"))


def symbol_scope(
    rows: DataFrame,
    id_col: str,
    text: str,
    root: str,
    aliases: DataFrame,
    others: DataFrame | None = None,
    context: list[str] = OTHER_HOLDINGS,
    trades: list[str] = IN_A_TRADE,
    excluded: list[str] = NO_INSTRUMENT,
) -> DataFrame:
    """``rows`` (one row an id) with what each text is about:

    - ``own``: it names an alias of its root; ``named``: an instrument that isn't its own, the first one in the text
    - ``inline``: an instrument that it says to be long or short in; ``context``: it speaks of other holdings
    - ``foreign``: "swing_context" for the latter, else ``inline``, else ``named``, else null

    ``aliases`` is (root, alias); several roots may share an alias, which is own for each of them. ``others`` is (alias), the
    names of other instruments; without it all aliases are. A text without a root has no own alias. Texts are normalised ones; null
    texts name nothing.
    """
    pairs = aliases.select("root", "alias")
    table = pairs.select("alias") if others is None else pairs.select("alias").unionByName(others.select("alias"))
    found = alias_matches(rows, id_col, text, table).join(rows.select(id_col, F.col(root).alias("root")).hint("merge"), id_col)
    own = _keyed(pairs.filter("root is not null"), "root").select("root", "phrase", F.lit(True).alias("mine"))
    found = found.join(own.hint("merge"), ["root", "phrase"], "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
    if others is None:
        found = found.withColumn("other", ~F.col("mine"))
    else:
        listed = _keyed(others).select("phrase", F.lit(True).alias("listed"))
        found = found.join(listed.hint("merge"), "phrase", "left")
        found = found.withColumn("other", F.coalesce("listed", F.lit(False)) & ~F.col("mine"))
    first = F.min_by(F.when(F.col("other"), F.col("phrase")), F.when(F.col("other"), F.col("start")))
    seen = found.groupBy(id_col).agg(F.max("mine").alias("own"), first.alias("named"))
    inline = trade_instrument(rows, id_col, text, root, pairs, trades, excluded)
    out = rows.join(seen.hint("merge"), id_col, "left").join(inline.hint("merge"), id_col, "left")
    about = F.coalesce(F.col(text).rlike("|".join(f"(?:{p})" for p in context)), F.lit(False)) if context else F.lit(False)
    out = out.withColumn("own", F.coalesce("own", F.lit(False))).withColumn("context", about)
    return out.withColumn("foreign", F.when(F.col("context"), "swing_context").otherwise(F.coalesce("inline", "named")))
