"""Scalar text functions as Column expressions; ordered rule lists are data."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Corrections of misheard words, applied in this order to lower-cased text.
ASR_RULES = [
    (r"\bv\s*w\s*a\s*p\b", "vwap"),
    (r"\b(?:view|vw)\s+up\b", "vwap"),
    (r"\bbreak\s+even\b", "breakeven"),
    (r"\bbroke\s+even\b", "breakeven"),
    (r"\bgot my ad on\b", "got my add on"),
    (r"\bm\s+n\s+q\b", "mnq"),
    (r"\bn\s+q\b", "nq"),
    (r"\bm\s+e\s+s\b", "mes"),
    (r"\be\s+s\b", "es"),
    (r"\bpaying myself(?:\s+a)?\s+peace\b", "paying myself piece"),
    (r"\bpaying ourselves(?:\s+a)?\s+peace\b", "paying ourselves piece"),
    (r"\bpaid myself(?:\s+a)?\s+peace\b", "paid myself piece"),
    (r"\bpaid ourselves(?:\s+a)?\s+peace\b", "paid ourselves piece"),
    (r"\bpeace(?=\s+(?:on|here|there|at|versus|long|short)\b)", "piece"),
]


def asr_correct(text: Column, rules: list[tuple[str, str]] = ASR_RULES) -> Column:
    """Lower case, straight apostrophes, digits without grouping commas, then each rule in order."""
    base = F.regexp_replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), r"(?<=[0-9]),(?=[0-9])", "")
    return reduce(lambda t, r: F.regexp_replace(t, "(?U)" + r[0], r[1]), rules, base)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column, rules: list[tuple[str, str]] = ASR_RULES) -> Column:
    t = F.replace(asr_correct(text, rules), F.lit("-"), F.lit(" "))
    t = F.regexp_replace(t, r"(?U)\bpoint of\b", "point")
    return squeeze(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s.]", " "))


def normalize_variant(text: Column, kind: str) -> Column:
    """review keeps apostrophes and drops dots; fallback keeps letters, digits and dots; label is an upper-case token."""
    if kind == "review":
        return squeeze(F.regexp_replace(F.replace(F.lower(text), F.lit("vwop"), F.lit("vwap")), r"(?U)[^\p{L}\p{N}_\s']", " "))
    if kind == "fallback":
        return squeeze(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s.]", " "))
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def clean_markup(text: Column) -> Column:
    """Every HTML character reference decoded (Spark has no function for these), then tags taken out without a space, then white
    space squeezed."""
    decoded = F.pandas_udf(_unescaped, "string")(text)
    return squeeze(F.regexp_replace(F.translate(decoded, "\u200b\ufeff", "  "), "<[^>]+>", ""))


def compact_repeats(text: Column) -> Column:
    """Sentences with runs of the same sentence cut to one (up to four words) or two."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.trim(s)), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"), F.lit(0).alias("run"))

    def step(acc, s):
        run = F.when(acc["last"] == s, acc["run"] + 1).otherwise(1)
        keep = run <= F.when(F.size(F.split(s, " ")) <= 4, 1).otherwise(2)
        return F.struct(F.when(keep, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"), s.alias("last"), run.alias("run"))

    return F.array_join(F.aggregate(parts, start, step)["out"], ". ")


def most_common_count(items: Column) -> Column:
    """How often the commonest item of an array stands in it; one sort and one pass."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(items), start, step)["best"]


def repeats(w: Column, size: int, times: int) -> Column:
    """Whether a run of ``size`` words stands ``times`` times in a row: words equal those ``size`` later for long enough."""
    n = F.size(w)
    same = F.zip_with(F.slice(w, F.lit(1), n - size), F.slice(w, F.lit(size + 1), n - size), lambda a, b: a == b)
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(x, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.when(n >= size * times, F.aggregate(same, start, step)["best"] >= size * (times - 1)).otherwise(False)


def degenerate_text(text: Column) -> Column:
    """Ten words or more, and one of them makes 55 %, or a run of n words repeats (1 x5, 2 x4, 3 x3, 4 x3)."""

    def judged(w):
        repeated = reduce(lambda a, b: a | b, [repeats(w, *x) for x in ((1, 5), (2, 4), (3, 3), (4, 3))])
        return (F.size(w) >= 10) & ((most_common_count(w) >= 0.55 * F.size(w)) | repeated)

    # the words are split once: an array of one is mapped
    return F.element_at(F.transform(F.array(words(F.lower(text))), judged), 1)


def latency_metrics(started: Column, captured: Column, finished: Column) -> Column:
    """Milliseconds of capture, processing and both, each at least 0, from times in seconds."""
    ms = lambda a, b: F.greatest(F.lit(0), ((b - a) * 1000).cast("long"))
    return F.struct(ms(started, captured).alias("speech_capture_ms"), ms(captured, finished).alias("processing_ms"), ms(started, finished).alias("total_latency_ms"))


def keyword_gate(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(k) for k in keywords])


def group_pattern(patterns: list[str]) -> str:
    """One alternation for a rule group, so that a group is one scan of the text."""
    return "|".join(f"(?:{p})" for p in patterns)


def match_rules(text: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups that hit, in the groups' order."""
    return F.filter(F.array(*[F.when(text.rlike(group_pattern(p)), F.lit(g)) for g, p in groups.items()]), lambda g: g.isNotNull())


def detect_signal(text: Column, groups: dict[str, list[str]], tags: dict[str, str], position: Column | None = None) -> Column:
    """The tag of the first group that hits, in order; null when nothing hits. With a position (LONG, SHORT or null) an entry on
    its side is an ADD."""
    first = None
    for g, p in groups.items():
        hit, tag = text.rlike(group_pattern(p)), F.lit(tags[g])
        if position is not None and tags[g] in ("ENTER_LONG", "ENTER_SHORT"):
            tag = F.when(position == tags[g].removeprefix("ENTER_"), "ADD").otherwise(tag)
        first = F.when(hit, tag) if first is None else first.when(hit, tag)
    return first


def actionable(text: Column, commentary: list[str], automatic: list[str], mode: Column) -> Column:
    """Whether a text is no commentary; a second list of patterns counts in automatic mode only."""
    return ~text.rlike(group_pattern(commentary)) & ~((mode == "auto") & text.rlike(group_pattern(automatic)))


def side_hint(text: Column, long: str, short: str) -> Column:
    a, b = text.rlike(long), text.rlike(short)
    return F.when(a & ~b, "LONG").when(b & ~a, "SHORT")


def quantity_hint(text: Column) -> Column:
    t = F.lower(text)
    some = F.when(t.contains("all") | t.contains("whole position"), "all").when(t.contains("most my size"), "most")
    return some.when(t.rlike(r"\bhalf\b"), "half").when(t.rlike(r"\bone\b"), "one")


def entry_size_hint(text: Column, seeds: list[str]) -> Column:
    """The size of an entry: feelers, little pieces and seeds are one contract, all else as in ``quantity_hint``."""
    t = F.lower(text)
    small = t.contains("feeler") | t.rlike(r"\b(?:little|small)\s+(?:piece|peace)\b") | t.rlike(group_pattern(seeds))
    return F.when(small, "one").otherwise(quantity_hint(text))


#: Confidence by tag before price, hedge and guard corrections.
BASE_SCORES = {
    "ENTER_LONG": 0.88, "ENTER_SHORT": 0.88, "ADD": 0.86, "TRIM": 0.87, "EXIT_ALL": 0.93, "MOVE_STOP": 0.88, "MOVE_TO_BREAKEVEN": 0.91,
    "SETUP_LONG": 0.72, "SETUP_SHORT": 0.72, "CANCEL_SETUP": 0.8,
}


def intent_score(tag: Column, text: Column, entry: Column, stop: Column, target: Column, guard: Column, base: dict[str, float] = BASE_SCORES) -> Column:
    """Confidence of an intent: its tag's base, prices add to it, hedges and a guard reason take from it; 0 to 0.99."""
    known = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    plus = lambda when, x: F.when(when, F.lit(x)).otherwise(0.0)
    score = F.coalesce(F.element_at(known, tag), F.lit(0.7)) + plus(entry.isNotNull(), 0.03) + plus(stop.isNotNull(), 0.05) + plus(target.isNotNull(), 0.02)
    score = score - plus(text.contains("maybe") | text.contains("could"), 0.15) - plus(guard.isNotNull(), 0.08)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.round(score, 3)))


def best_candidate(options: list[tuple[str, float, Column]]) -> Column:
    """(p, rank, source) of the highest probability among those whose condition holds; ties go to the earlier one."""
    found = [F.when(ok, F.struct(F.lit(p).alias("p"), F.lit(-k).alias("rank"), F.lit(name).alias("source"))) for k, (name, p, ok) in enumerate(options)]
    return F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))


#: Patterns of intents that need a second look, on lower-cased text.
SUSPICIOUS = [
    r"\blooking for (?:the |a )?(?:long|short)\b",
    r"\binterested in (?:the |a )?(?:long|short)\b",
    r"\btempted to put\b",
    r"\bthink about\b",
    r"\bif you\b",
    r"\byou can\b",
    r"\byou could\b",
    r"\bwould i\b",
    r"\bthey are\b",
    r"\bthey re\b",
    r"\bhaven t\b",
    r"\bnot paying myself\b",
    r"\bone break ?even\b",
    r"\bi took the\b",
    r"\bi was\b",
    r"\bwe ve had\b",
    r"\bmy swings?\b",
    r"\bsoftware companies\b",
]


def pattern_hits(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that hit, joined by commas; the empty text where none does."""
    return F.array_join(F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull()), ",")


def suspicious_flag(text: Column, patterns: list[str] = SUSPICIOUS) -> Column:
    return F.lower(text).rlike(group_pattern(patterns))


def clip_words(text: Column, n: int = 48) -> Column:
    w = words(text)
    return F.array_join(F.when(F.size(w) > n, F.slice(w, -n, n)).otherwise(w), " ")


def render_context(**fields: Column) -> Column:
    """key=value lines; fields that are null or empty are left out."""
    return F.concat_ws("\n", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(k + "="), c)) for k, c in fields.items()])


def stable_key(*cols: Column, size: int = 64) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256), 1, size)


def resolve_digits(raw: Column, market: Column) -> Column:
    """A spoken price in digits: up to three digits are the end of a price, completed to the nearest to the market."""
    x = F.regexp_replace(raw, ",", "").try_cast("double")
    near = lambda base: F.array_min(F.transform(F.sequence(F.lit(-5), F.lit(5)), lambda k: F.struct(F.abs((F.floor(market / base) + k) * base + x - market).alias("d"), ((F.floor(market / base) + k) * base + x).alias("p"))))["p"]
    return F.when(x.isNull() | market.isNull(), x).when(x < 100, near(100.0)).when(x < 1000, near(1000.0)).otherwise(x)


def logprob_confidence(mean_logprob: Column) -> Column:
    """Confidence from a mean log-probability: 1 + mean / 5 within 0.3 and 0.99; 0.85 without one."""
    return F.coalesce(F.least(F.lit(0.99), F.greatest(F.lit(0.3), 1 + mean_logprob / 5)), F.lit(0.85))


def rebuild_prompt(prompt: Column, fields: list[str]) -> Column:
    """A prompt of key=value lines with the named fields only, in their order; empty ones are left out."""
    return render_context(**{f: F.regexp_extract(prompt, f"(?m)^{f}=(.*)$", 1) for f in fields})


def frame_energy(values: Column, scale: float = 32768.0, least: float = 0.012) -> tuple[Column, Column]:
    """Root mean square of a frame's values and whether it is voiced (fixed value: 0.012 of the scale), as aggregates."""
    rms = F.sqrt(F.avg(values * values)) / scale
    return rms, rms >= least
