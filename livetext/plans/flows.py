"""Queries of the spoken intent cascade, as tables and as streams, each beside its DuckDB equivalent where SQL can express it.

The given texts are invented prose, so a surrogate lexicon of short words stands for the spoken phrases: the cascade's steps, state
and timing are the operator's own. A turn is spoken every two seconds. A price is ten times the length of the word it is read from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from livetext.functions import text as tx
from livetext.operators import evaluation as ev
from livetext.operators import flow as fl
from livetext.operators.ordered import CONTINUES, UNFINISHED
from livetext.plans import streams
from livetext.plans.queries import conv, query, read
from livetext.plans.texts import NORMAL
from livetext.sources.transcripts import scratch
from livetext.streaming import flow as sf
from livetext.streaming import sessions as st

#: Words of a normalised text stand between blanks, full stops and its ends, in both engines.
word = lambda *w: [f"(?:^|[ .])(?:{'|'.join(w)})(?:[ .]|$)"]
SURROGATE = fl.lexicon(own=word("que"), foreign=word("der"), **{g: [] for g in fl.lexicon() if g not in ("own", "foreign")}) | {
    "seed": word("ing", "on"), "direct_long": word("was"), "direct_short": word("for"), "long": word("re"), "short": word("ed"), "long_versus": word("ly"), "short_versus": word("ble"), "up": word("st"), "down": word("he"),
    "cancel": word("thnd"), "exit": word("by"), "conditional_exit": word("ou"), "breakeven": word("es"), "trim": word("with"), "runner": word("wh"), "trim_command": word("r", "la"), "no_trim_command": word("or"),
    "move_stop": word("at"), "risk_word": word("nt"), "heavy": word("thti"), "add": word("th", "an"), "tentative_add": word("tion"), "setup_long": word("ea"), "setup_short": word("ha"), "follow_up": word("it"), "no_follow_up": word("be"),
    "hedge": word("are"), "commentary": word("nd"), "automatic_commentary": word("ti"), "entry_commentary": word("thre"), "exit_commentary": word("thth"), "candidate_seed": word("en"), "candidate_continues": ["^in "],
    "risk_price": [r"(?:^|[ .])to ([a-z]+)", r"(?:^|[ .])de ([a-z]+)"], "cut_price": [r"(?:^|[ .])thin ([a-z]+)"], "target_price": [r"(?:^|[ .])this ([a-z]+)"], "entry_price": [r"(?:^|[ .])from ([a-z]+)"], "in_long": word("und"), "in_short": word("die"), "not_my_position": word("sh"),
}
MARKET = 60.0


def spoken(spark, d):
    c = conv(spark, d)
    return c.select("conv_id", "turn", (F.col("turn") * 2).cast("double").alias("at"), tx.normalize_text(F.col("text")).alias("text"), F.lit(MARKET).alias("market"))


def by_length(raw, market):
    return F.length(raw) * F.lit(10.0)


# --- the cascade in SQL: hits, flags, then a recursive fold over them -----------------------------------------------


def _in_sql() -> str:
    groups = fl.groups_of(SURROGATE)
    # the fixed beginnings and ends, with the same bounds of words as above
    bounded = lambda p: "|".join(f"(?:{x})" for x in p).replace(r")\b", ")(?:[ .]|$)").replace(r"\b(", "(?:^|[ .])(")
    hit = lambda x, g: f"regexp_matches({x}, '{tx.group_pattern(groups[g])}')" if groups[g] else "FALSE"
    hit_of = lambda x, g: f"regexp_matches({x}, '{bounded(UNFINISHED)}')" if g == "unfinished" else hit(x, g)
    source = {"text": "x", "analysis": "a", "entry_text": "e"}
    hits = ", ".join(f"{hit_of(source[s], g)} AS {source[s]}_{g}" for s, names in fl._ON.items() for g in names.split())
    first = lambda x, patterns: "coalesce(" + ", ".join([f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in patterns] + ["NULL"]) + ")"
    prices = ", ".join(f"(length({first(source[s], groups[g])}) * 10)::DOUBLE AS p_{n}" for n, (s, g) in fl._PRICED.items())

    def side(h, target=None):
        cases = [(f"{h}_strong_long", "LONG"), (f"{h}_strong_short", "SHORT")]
        cases += [(f"{h}_in_{s} AND NOT {h}_not_my_position", s.upper()) for s in ("long", "short")] + [(f"{h}_{s}_here AND ({h}_bare_{s} OR {h}_seed)", s.upper()) for s in ("long", "short")]
        cases += [(f"{h}_seed AND {h}_{s}", s.upper()) for s in ("long", "short")]
        if target:
            cases += [(f"{h}_seed AND {h}_up AND coalesce({target} > {MARKET}, false)", "LONG"), (f"{h}_seed AND {h}_down AND coalesce({target} < {MARKET}, false)", "SHORT")]
        return f"CASE WHEN {h}_entry_commentary OR {h}_unfinished THEN NULL " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in cases) + " END"

    trigger = lambda h: f"(NOT {h}_entry_commentary AND NOT {h}_unfinished AND (({side(h)}) IS NOT NULL OR {h}_seed))"
    said = {
        "own": "a_own", "foreign": "a_foreign", "candidate": "a_talk", "commentary": "(a_commentary OR a_automatic_commentary OR a_entry_commentary)", "own_commentary": "(x_commentary OR x_automatic_commentary OR x_entry_commentary)",
        "trigger_text": trigger("x"), "cancel": "x_cancel", "exit_commentary": "a_exit_commentary", "conditional_exit": "a_conditional_exit", "conditional_price": "p_conditional_stop IS NOT NULL", "risk": "(a_risk_word OR a_heavy OR a_move_stop)",
        "exit": "e_exit", "cut": "p_cut_stop IS NOT NULL", "breakeven": "e_breakeven", "trim_command": "(e_trim_command AND NOT e_no_trim_command)", "trim": "(e_trim OR e_runner)", "most": "(contains(e, 'most my size') OR e_runner)",
        "add": "(e_add AND NOT e_tentative_add)", "entry_trigger": trigger("e"), "stop_price": "p_stop IS NOT NULL", "entry_risk": "(e_risk_word OR e_move_stop)", "setup_long": "x_setup_long", "setup_short": "x_setup_short",
        "follow_up": "(x_follow_up AND NOT x_no_follow_up)", "hedge": "x_hedge",
    }
    bits = " + ".join(f"CASE WHEN {c} THEN {fl.BIT[n]} ELSE 0 END::BIGINT" for n, c in said.items())
    quantity = lambda x: f"CASE WHEN contains({x}, 'all') OR contains({x}, 'whole position') THEN 'all' WHEN contains({x}, 'most my size') THEN 'most' WHEN regexp_matches({x}, '(?:^|[ .])half(?:[ .]|$)') THEN 'half' WHEN regexp_matches({x}, '(?:^|[ .])one(?:[ .]|$)') THEN 'one' END"
    size = lambda x: f"CASE WHEN {x}_seed OR {hit(x, 'small')} THEN 'one' ELSE {quantity(x)} END"
    text_side = "CASE WHEN x_entry_commentary THEN NULL WHEN x_long_versus THEN 'LONG' WHEN x_short_versus THEN 'SHORT' WHEN x_direct_long THEN 'LONG' WHEN x_direct_short THEN 'SHORT' END"
    # one expression for each field of a step, chosen by the step's number
    by_step = lambda value: "CASE step " + " ".join(f"WHEN {k} THEN {v}" for k, s in enumerate(fl.STEPS) if (v := value(s))) + " END"
    sides = {"held": "position", "text": "text_side", "last": "last2", "entry": "entry_side", "setup": "NULL", "LONG": "'LONG'", "SHORT": "'SHORT'"}
    worth = {"market": str(MARKET), "held_stop": "held_stop"} | {n: f"p_{n}" for n in fl.PRICES}
    any_of = lambda names, of: f"coalesce({', '.join([of[n] for n in names.split()] + ['NULL'])})" if names else ""
    sizes = {"quantity": "quantity", "size": "size", "text_size": "text_size"}
    numbers = lambda keep: "(" + ", ".join(str(k) for k, s in enumerate(fl.STEPS) if keep(s)) + ")"
    alike = " AND ".join(f"(({p} IS NULL AND l_{p} IS NULL) OR coalesce(abs({p} - l_{p}) < 0.01, false))" for p in ("entry", "stop", "target"))
    family = "('ENTER_LONG', 'ENTER_SHORT', 'ADD')"
    base = "CASE tag " + " ".join(f"WHEN '{t}' THEN {x}" for t, x in tx.BASE_SCORES.items()) + " END"
    plain = "(tag LIKE 'SETUP%' OR tag LIKE 'CANCEL%')"
    score = f"greatest(0.0, least(0.99, round(({base})::DOUBLE + CASE WHEN {plain} THEN 0 ELSE CASE WHEN entry IS NULL THEN 0 ELSE 0.03 END + CASE WHEN stop IS NULL THEN 0 ELSE 0.05 END + CASE WHEN target IS NULL THEN 0 ELSE 0.02 END - CASE WHEN x_hedge THEN 0.15 ELSE 0 END - CASE WHEN guard IS NULL THEN 0 ELSE 0.08 END END, 3)))"
    near = lambda t, s: f"coalesce(tm - {t} <= {s}, false)"
    return f"""WITH RECURSIVE n AS (SELECT conv_id, turn, (turn * 2)::DOUBLE AS tm, trim({NORMAL}) AS x FROM conversations), s AS (SELECT * FROM n WHERE coalesce(x, '') <> ''),
b AS (SELECT *, lag(x) OVER w AS px, lag(tm) OVER w AS pat, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY tm, turn)),
v AS (SELECT *, CASE WHEN {near("pat", fl.STITCH)} THEN trim(px || ' ' || x) ELSE x END AS a, CASE WHEN {near("pat", fl.STITCH)} AND (regexp_matches(x, '{bounded(CONTINUES)}') OR regexp_matches(px, '{bounded(UNFINISHED)}')) THEN trim(px || ' ' || x) ELSE x END AS e FROM b),
h AS (SELECT *, {hits}, {prices} FROM v),
f AS (SELECT *, {bits} AS bits, {text_side} AS text_side, {side("e", "p_entry_target")} AS entry_side, {quantity("e")} AS quantity, {size("e")} AS size, {size("x")} AS text_size FROM h),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, NULL::BIGINT AS turn, NULL::VARCHAR AS tag, NULL::VARCHAR AS side, NULL::DOUBLE AS entry, NULL::DOUBLE AS stop, NULL::DOUBLE AS target, NULL::VARCHAR AS size, NULL::VARCHAR AS guard, NULL::DOUBLE AS score, NULL::VARCHAR AS before,
NULL::VARCHAR AS position, NULL::DOUBLE AS average, NULL::DOUBLE AS held_stop, NULL::VARCHAR AS last_side, NULL::DOUBLE AS mg, NULL::DOUBLE AS ex, NULL::DOUBLE AS away, NULL::VARCHAR AS l_tag, NULL::VARCHAR AS l_side, NULL::DOUBLE AS l_at, NULL::DOUBLE AS l_entry, NULL::DOUBLE AS l_stop, NULL::DOUBLE AS l_target FROM f
UNION ALL SELECT conv_id, k, turn, tag, side, entry, stop, target, size, guard, score, position AS before,
CASE WHEN tag IN ('ENTER_LONG', 'ENTER_SHORT') OR (tag = 'ADD' AND position IS NULL) THEN side WHEN tag = 'EXIT_ALL' THEN NULL ELSE position END,
CASE WHEN tag IN ('ENTER_LONG', 'ENTER_SHORT') OR (tag = 'ADD' AND position IS NULL) THEN coalesce(entry, {MARKET}) WHEN tag = 'EXIT_ALL' THEN NULL ELSE average END,
CASE WHEN tag IN ('ENTER_LONG', 'ENTER_SHORT') OR (tag = 'ADD' AND position IS NULL) THEN stop WHEN tag = 'EXIT_ALL' THEN NULL WHEN tag = 'MOVE_STOP' AND position IS NOT NULL AND stop IS NOT NULL THEN stop WHEN tag = 'MOVE_TO_BREAKEVEN' AND position IS NOT NULL THEN average ELSE held_stop END,
last3, mg2, ex2, away2, coalesce(tag, l_tag), CASE WHEN tag IS NULL THEN l_side ELSE side END, CASE WHEN tag IS NULL THEN l_at ELSE tm END, CASE WHEN tag IS NULL THEN l_entry ELSE entry END, CASE WHEN tag IS NULL THEN l_stop ELSE stop END, CASE WHEN tag IS NULL THEN l_target ELSE target END
FROM (SELECT * REPLACE (CASE WHEN repeated THEN NULL ELSE tag END AS tag, CASE WHEN repeated THEN NULL ELSE side END AS side, CASE WHEN repeated THEN NULL ELSE entry END AS entry, CASE WHEN repeated THEN NULL ELSE stop END AS stop, CASE WHEN repeated THEN NULL ELSE target END AS target, CASE WHEN repeated THEN NULL ELSE size END AS size, CASE WHEN repeated THEN NULL ELSE guard END AS guard), CASE WHEN repeated OR tag IS NULL THEN NULL ELSE {score} END AS score
FROM (SELECT *, coalesce(tag IS NOT NULL AND side IS NOT DISTINCT FROM l_side AND {alike} AND ((tag = l_tag AND {near("l_at", fl.REPEAT)}) OR (tag IN {family} AND l_tag IN {family} AND bits & {fl.BIT["follow_up"]} <> 0 AND {near("l_at", fl.ENTRY_REPEAT)})), false) AS repeated
FROM (SELECT * REPLACE (CASE WHEN NOT says THEN NULL ELSE side END AS side, CASE WHEN says THEN entry END AS entry, CASE WHEN says THEN stop END AS stop, CASE WHEN says THEN target END AS target, CASE WHEN says THEN size END AS size), CASE WHEN NOT says THEN NULL WHEN tag0 = 'ENTER' AND position = side THEN 'ADD' WHEN tag0 = 'ENTER' THEN 'ENTER_' || side ELSE tag0 END AS tag,
CASE WHEN says AND step IN {numbers(lambda s: s.turns)} THEN side ELSE last2 END AS last3, CASE WHEN says AND step IN {numbers(lambda s: s.marks == "management")} THEN tm ELSE mg END AS mg2, CASE WHEN says AND step IN {numbers(lambda s: s.marks == "exit")} THEN tm ELSE ex END AS ex2,
CASE WHEN says AND step IN {numbers(lambda s: s.guarded)} THEN CASE WHEN {near("mg", fl.GUARD)} THEN 'recent management cue detected' WHEN {near("ex", fl.GUARD)} THEN 'recent exit cue detected' END END AS guard
FROM (SELECT *, coalesce(tag0 IS NOT NULL AND (tag0 <> 'ENTER' OR side IS NOT NULL), false) AS says FROM (SELECT * EXCLUDE (size), {by_step(lambda s: f"'{s.tag}'" if s.tag else "")} AS tag0, {by_step(lambda s: any_of(s.side, sides))} AS side,
{by_step(lambda s: any_of(s.entry, worth))} AS entry, {by_step(lambda s: any_of(s.stop, worth))} AS stop, {by_step(lambda s: any_of(s.target, worth))} AS target, {by_step(lambda s: sizes.get(s.size, f"'{s.size}'") if s.size else "")} AS size
FROM (SELECT *, CASE WHEN step >= 2 OR step = -1 THEN coalesce(text_side, position, last_side) ELSE coalesce(position, last_side) END AS last2
FROM (SELECT *, CASE {" ".join(f"WHEN bits2 & {s.mask} = {s.value} THEN {k}" for k, s in enumerate(fl.STEPS))} ELSE -1 END AS step
FROM (SELECT *, bits + CASE WHEN position IS NULL THEN 0 ELSE {fl.BIT["held"]} END + CASE WHEN {near("away2", fl.INSTRUMENT)} THEN {fl.BIT["away"]} ELSE 0 END AS bits2
FROM (SELECT f.*, r.position, r.average, r.held_stop, r.last_side, r.mg, r.ex, r.l_tag, r.l_side, r.l_at, r.l_entry, r.l_stop, r.l_target, CASE WHEN a_own THEN NULL WHEN a_foreign THEN f.tm ELSE r.away END AS away2 FROM r JOIN f ON f.conv_id = r.conv_id AND f.k = r.k + 1))))))))))
SELECT conv_id, turn, tag, side, entry, stop, target, size, guard, score, coalesce(before, 'FLAT') AS before, coalesce(position, 'FLAT') AS after FROM r WHERE k > 0"""


@query(_in_sql())
def parse_intent(spark, d):
    """What each turn says by the whole cascade, read against the position that earlier turns left."""
    found = fl.interpret(spoken(spark, d), SURROGATE, "conv_id", "at", "turn", "text", windows=False, resolve=by_length)
    return found.drop("recovered")


@query(f"""WITH i AS (SELECT r.conv_id, r.turn, r.tag, regexp_matches(lower(c.text), '\\bthe th[a-z]*\\b') AS bad FROM ({_in_sql()}) AS r JOIN conversations AS c ON c.conv_id = r.conv_id AND c.turn = r.turn WHERE r.tag IS NOT NULL),
k AS (SELECT conv_id, string_agg(tag || '=' || n, ',' ORDER BY tag) AS counts FROM (SELECT conv_id, tag, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1)
SELECT conv_id, count(*)::BIGINT AS intents, any_value(counts) AS counts, array_to_string((list(turn || ':' || tag ORDER BY turn))[:5], ',') AS first_hits, sum(bad::INTEGER)::BIGINT AS n_suspicious,
coalesce(array_to_string((list(tag ORDER BY turn) FILTER (bad))[:5], ','), '') AS suspicious FROM i JOIN k USING (conv_id) GROUP BY conv_id""")
def replay_report(spark, d):
    """Conversations replayed as files: each turn is read against the position that its file's earlier intents left, repeats
    are suppressed, and what remains is a report a file."""
    turns = conv(spark, d).select("conv_id", "turn", F.col("text").alias("raw"))
    found = fl.interpret(spoken(spark, d), SURROGATE, "conv_id", "at", "turn", "text", windows=False, resolve=by_length).filter("tag is not null")
    hits = found.select("conv_id", "turn", "tag").join(turns.hint("merge"), ["conv_id", "turn"]).withColumn("hit", F.concat("turn", F.lit(":"), "tag"))
    report = ev.file_report(hits, "conv_id", "turn", "tag", F.lower("raw").rlike(r"\bthe th[a-z]*\b"), listed="hit")
    counts = F.array_join(F.transform("counts", lambda x: F.concat(x["tag"], F.lit("="), x["n"].cast("string"))), ",")
    plain_tags = F.transform("suspicious", lambda x: F.substring_index(x, ":", -1))
    return report.select("conv_id", "intents", counts.alias("counts"), F.array_join("first_hits", ",").alias("first_hits"), "n_suspicious", F.array_join(plain_tags, ",").alias("suspicious"))


#: Streams begin after the epoch, where a watermark starts.
STARTS = 1_000_000
#: The parts of a given table come file by file, so that sessions are far apart in time: no row is late.
LATE = "10000000 seconds"
SCHEMA = "session_id string, segment_id string, received_at timestamp, at double, status string, text string, market double"


def segments(spark, d):
    rows = spoken(spark, d).select(F.col("conv_id").cast("string").alias("session_id"), F.format_string("%08d", "turn").alias("segment_id"), "at", F.lit("final").alias("status"), "text", "market")
    return rows.withColumn("received_at", F.timestamp_seconds(F.col("at") + STARTS))


@query()
def interpret_stream(spark, d):
    """The cascade with candidate windows as a stream: equal to ``interpret`` on the same rows (tests)."""
    stream = streams.as_stream(segments(spark, d), SCHEMA)
    return streams.drained(sf.stream_interpret(stream, SURROGATE, late=LATE, market=F.col("market"), resolve=by_length))


@query("""WITH g AS (SELECT conv_id::VARCHAR AS session_id, lpad(turn::VARCHAR, 8, '0') AS id, (turn * 8)::DOUBLE AS tm, CASE turn % 3 WHEN 0 THEN 'preview' WHEN 1 THEN CASE WHEN length(text) % 2 = 0 THEN 'strong' ELSE 'weak' END ELSE 'none' END AS kind, length(text) % 2 AS stop FROM conversations),
p AS (SELECT *, (SELECT min_by({'id': f.id, 'tm': f.tm, 'kind': f.kind, 'stop': f.stop}, f.tm) FROM g f WHERE f.session_id = g.session_id AND f.tm > g.tm AND f.kind IN ('strong', 'weak')) AS nx FROM g WHERE kind = 'preview')
SELECT session_id, id, CASE WHEN coalesce(nx.tm - tm <= 12, false) THEN CASE WHEN nx.kind = 'strong' AND nx.stop = stop THEN 'confirmed' ELSE 'flattened' END ELSE 'expired' END AS outcome, CASE WHEN coalesce(nx.tm - tm <= 12, false) AND nx.kind = 'strong' AND nx.stop = stop THEN nx.id END AS confirmed_by FROM p""")
def expire_previews(spark, d):
    """Outcomes of previews as a stream. A last row far in the future lets the open ones expire."""
    c = read(spark, d, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "preview").when(F.col("turn") % 3 == 1, F.when(F.length("text") % 2 == 0, "strong").otherwise("weak")).otherwise("none")
    rows = c.select(F.col("conv_id").cast("string").alias("session_id"), F.format_string("%08d", "turn").alias("segment_id"), (F.col("turn") * 8).cast("double").alias("at"), kind.alias("kind"), (F.length("text") % 2).cast("double").alias("stop"))
    ends = rows.agg(F.max("at").alias("at")).select(F.lit("").alias("session_id"), F.lit("").alias("segment_id"), (F.col("at") + 100_000_000).alias("at"), F.lit("none").alias("kind"), F.lit(None).cast("double").alias("stop"))
    rows = rows.unionByName(ends).withColumn("received_at", F.timestamp_seconds(F.col("at") + STARTS))
    stream = streams.as_stream(rows, "session_id string, segment_id string, received_at timestamp, at double, kind string, stop double")
    kind = F.col("kind")
    return streams.drained(sf.stream_confirm_preview(stream, kind == "preview", kind.isin("strong", "weak"), kind == "strong", F.col("stop"), late=LATE))


@query("""WITH e AS (SELECT event_id, user_id, epoch(ts) AS tm, least(3, event_id * 4 // (SELECT max(event_id) + 1 FROM events)) AS part FROM events), shuffled AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN least(3, part + 1) ELSE part END AS arrives FROM e),
marks AS (SELECT arrives, max(tm) OVER (ORDER BY arrives ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600 AS mark FROM (SELECT arrives, max(tm) AS tm FROM shuffled GROUP BY arrives))
SELECT event_id, coalesce(tm <= mark, false) AS late FROM shuffled JOIN marks USING (arrives)""")
def late_rows(spark, d):
    """Events in four deliveries, some of them one delivery late: those after the watermark and those before it."""
    e = read(spark, d, "events")
    n = e.agg((F.max("event_id") + 1).alias("n"))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    part = F.least(F.lit(3), F.floor(F.col("event_id") * 4 / F.col("n"))).cast("long")
    rows = e.join(F.broadcast(n)).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("received_at"), part.alias("part"), at.alias("at"))  # one row
    rows = rows.withColumn("arrives", F.when(F.col("event_id") % 11 == 0, F.least(F.lit(3), F.col("part") + 1)).otherwise(F.col("part")))
    path = scratch(spark, "late")
    for k in range(4):
        rows.filter(F.col("arrives") == k).select("event_id", "received_at", "at").write.mode("append").json(f"{path}/in/{k}")
    for k in range(4):  # a delivery is a trigger
        source = st.segment_source(spark, f"{path}/in/{{{','.join(map(str, range(k + 1)))}}}", "event_id long, received_at timestamp, at double")
        streams.run(sf.split_late(source, "at", 3600.0, f"{path}/out", f"{path}/checkpoint"))
    of = lambda name, late: spark.read.schema("event_id long, at double").parquet(f"{path}/out/{name}").select("event_id", F.lit(late).alias("late"))
    return of("on_time", False).unionByName(of("late", True))
