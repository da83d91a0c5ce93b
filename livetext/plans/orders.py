"""Queries on session state, chunks, risk and positions, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from livetext.functions import prices
from livetext.functions import text as tx
from livetext.operators import cascade
from livetext.operators import ordered as od
from livetext.operators import relational as rel
from livetext.operators import risk
from livetext.plans.queries import EV, P, conv, events, plain, query, read

TAGS = {"signup": "ENTER_LONG", "purchase": "ENTER_SHORT", "click": "ADD", "error": "EXIT_ALL", "view": "MOVE_TO_BREAKEVEN"}
TAG = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + " END"


def tag_of():
    return F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), F.col("event_type"))


def listed(patterns: list[str], x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


CONTINUES, UNFINISHED = [*od.CONTINUES, r"^(?:the)\b"], [*od.UNFINISHED, r"\b(?:the)$"]


@query(f"""WITH t AS (SELECT conv_id, turn, turn * (1 + conv_id % 3) * 2 AS s, {P} AS p FROM conversations), b AS (SELECT *, lag(p) OVER w AS before, s - lag(s) OVER w AS gap FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN gap <= 4 THEN trim(concat_ws(' ', before, p)) ELSE p END AS analysis_text,
CASE WHEN gap <= 4 AND ({listed(od.CONTINUES, 'p')} OR {listed(od.UNFINISHED, 'before')}) THEN trim(concat_ws(' ', before, p)) ELSE p END AS entry_text FROM b""")
def stitch_context(spark, d):
    """Rows of a conversation stand 2, 4 or 6 seconds apart."""
    c = conv(spark, d).withColumn("p", plain(F.col("text"))).withColumn("s", F.col("turn") * (1 + F.col("conv_id") % 3) * 2)
    return od.stitch_context(c, F.col("p"), "conv_id", "turn", F.col("s")).select("conv_id", "turn", "analysis_text", "entry_text")


@query(f"""WITH {EV}, t AS (SELECT *, {TAG} AS tag, CASE WHEN event_id % 4 = 0 THEN 'LONG' WHEN event_id % 4 = 1 THEN 'SHORT' END AS side FROM ev), e AS (SELECT *, CASE WHEN tag IN ('ENTER_LONG', 'ENTER_SHORT', 'ADD') THEN coalesce(side, CASE tag WHEN 'ENTER_LONG' THEN 'LONG' WHEN 'ENTER_SHORT' THEN 'SHORT' END) END AS entered FROM t),
h AS (SELECT *, last_value(CASE WHEN tag = 'EXIT_ALL' THEN event_id WHEN entered IS NOT NULL THEN event_id END IGNORE NULLS) OVER w AS eff, last_value(coalesce(side, entered) IGNORE NULLS) OVER w AS last_side FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT h.*, CASE WHEN x.tag = 'EXIT_ALL' THEN 'FLAT' ELSE x.entered END AS held, CASE WHEN x.tag <> 'EXIT_ALL' THEN x.value END AS price FROM h LEFT JOIN e x ON x.event_id = h.eff),
m AS (SELECT *, CASE WHEN tag = 'EXIT_ALL' OR entered IS NOT NULL THEN {{'s': NULL::DOUBLE}} WHEN tag = 'MOVE_TO_BREAKEVEN' AND held <> 'FLAT' THEN {{'s': price}} END AS moved FROM j)
SELECT event_id, coalesce(held, 'FLAT') AS position, last_side, (last_value(moved IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)).s AS stop FROM m""")
def session_state(spark, d):
    side = F.when(F.col("event_id") % 4 == 0, "LONG").when(F.col("event_id") % 4 == 1, "SHORT")
    found = od.label_state(events(spark, d), "user_id", ["sec", "event_id"], tag_of(), side, F.col("value"))
    return found.select("event_id", "position", "last_side", "stop")


CHUNKS = "c AS (SELECT conv_id, k::BIGINT AS chunk, (turn + 1)::BIGINT AS line, length(text) AS chars FROM (SELECT *, unnest(range(greatest(0, (turn // 3) - 1)::BIGINT, (turn // 3 + 1)::BIGINT)) AS k FROM (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)) WHERE turn >= k * 3 AND turn < k * 3 + 4 AND k <= greatest(0, ceil((n - 1) / 3.0) - 1))"


@query(f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER w AS i, sum(chars + 1) OVER w - 1 AS total FROM c WINDOW w AS (PARTITION BY conv_id, chunk ORDER BY line)) SELECT conv_id, chunk, line FROM r WHERE i <= 2 OR total <= 400")
def chunk_lines(spark, d):
    """Chunks of four lines that share one, cut at 400 characters but for two lines."""
    lines = conv(spark, d).select("conv_id", (F.col("turn") + 1).alias("line"), "text")
    return od.shrink_chunks(od.chunk_lines(lines, "conv_id", 4, 1), lines, "conv_id", "text", 400, 2)


@query("""WITH x AS (SELECT conv_id, turn - 1 AS s, turn + 1 AS e FROM conversations WHERE role = 'assistant'), y AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY conv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS n FROM x),
z AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM y), i AS (SELECT conv_id, min(s) AS s, max(e) AS e FROM z GROUP BY conv_id, g)
SELECT conv_id, a AS start, least(a + 3, e) AS "end" FROM (SELECT *, unnest(range(s, e + 1, 4)) AS a FROM i)""")
def candidate_chunks(spark, d):
    merged = od.merge_intervals(conv(spark, d).filter("role = 'assistant'"), "conv_id", F.col("turn") - 1, F.col("turn") + 1, 0)
    return od.cut_intervals(merged, "conv_id", 4)


@query("""WITH r AS (SELECT user_id, event_id % 9 AS line, event_type AS label, CASE event_type WHEN 'purchase' THEN 9 WHEN 'click' THEN 7 ELSE 3 END AS priority, floor(value / 10) AS confidence, event_id FROM events),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, line, label ORDER BY confidence DESC, priority DESC, event_id) = 1)
SELECT user_id, line, label, event_id FROM a QUALIFY row_number() OVER (PARTITION BY user_id, line ORDER BY confidence DESC, priority DESC, event_id) = 1""")
def select_best_per_key(spark, d):
    priority = F.when(F.col("event_type") == "purchase", 9).when(F.col("event_type") == "click", 7).otherwise(3)
    r = read(spark, d, "events").select("user_id", (F.col("event_id") % 9).alias("line"), F.col("event_type").alias("label"), priority.alias("priority"), F.floor(F.col("value") / 10).alias("confidence"), "event_id")
    return od.select_best(r, ["user_id", "line"], ["label"], [F.desc("confidence"), F.desc("priority"), "event_id"]).select("user_id", "line", "label", "event_id")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN value > 20 THEN round(value, 2)::VARCHAR END AS v FROM events)
SELECT user_id, (arg_max({'v': v}, event_id) FILTER (event_type = 'purchase')).v AS price, coalesce((arg_max({'v': v}, event_id) FILTER (event_type = 'click')).v, CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN '' END) AS note,
arg_max(v, event_id) FILTER (event_type = 'view' AND v IS NOT NULL) AS market FROM e GROUP BY user_id""")
def materialize_session(spark, d):
    name = F.when(F.col("event_type") == "purchase", "price").when(F.col("event_type") == "click", "note").when(F.col("event_type") == "view", "market").otherwise("other")
    value = F.when(F.col("value") > 20, F.format_string("%s", F.round("value", 2)))
    patches = read(spark, d, "events").select("user_id", "event_id", F.create_map(name, value).alias("patch"))
    return od.materialize_session(patches, "user_id", "event_id", {"price": "null", "note": "empty", "market": "keep"})


REMAP = f"""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'SETUP_LONG' ELSE {TAG} END AS label, CASE WHEN event_id % 5 = 0 THEN 'LONG' WHEN event_id % 5 = 1 THEN 'x' END AS original, CASE WHEN event_id % 7 = 0 THEN 'SHORT' END AS reviewed,
CASE WHEN event_id % 3 = 0 THEN 'LONG' END AS position, CASE WHEN event_id % 2 = 0 THEN 'SHORT' END AS last_side FROM events)"""


@query(f"""{REMAP}, s AS (SELECT *, coalesce(nullif(original, 'x'), reviewed, position, last_side) AS side FROM e)
SELECT event_id, CASE WHEN label = 'SETUP_LONG' THEN 'NO_ACTION' WHEN label = 'ADD' THEN 'ENTER_' || side ELSE label END AS label, CASE WHEN label = 'ADD' AND side IS NULL THEN 'add_without_side' END AS dropped FROM s""")
def remap_labels(spark, d):
    k = F.col("event_id")
    rows = read(spark, d, "events").select(
        k, F.when(F.col("event_type") == "view", "SETUP_LONG").otherwise(tag_of()).alias("label"), F.when(k % 5 == 0, "LONG").when(k % 5 == 1, "x").alias("original"),
        F.when(k % 7 == 0, "SHORT").alias("reviewed"), F.when(k % 3 == 0, "LONG").alias("position"), F.when(k % 2 == 0, "SHORT").alias("last_side"),
    )
    return cascade.remap_labels(rows, ["original", "reviewed", "position", "last_side"]).select("event_id", "label", "dropped")


# --- risk and positions ---------------------------------------------------------------------------------------

INTENTS = f"""{EV}, i AS (SELECT event_id, {TAG.replace("'MOVE_TO_BREAKEVEN'", "'TRIM'")} AS tag, sec, value, (event_id * 37 % 6000)::BIGINT AS age, (event_id * 91 % 25000)::BIGINT AS latency, 0.7 + (event_id % 11) / 30.0 AS confidence,
CASE WHEN event_id % 13 = 0 THEN 'recent cue' END AS guard, CASE WHEN event_id % 17 <> 0 THEN 100 + value END AS last, CASE WHEN event_id % 3 <> 0 THEN (event_id % 6)::BIGINT END AS held, CASE WHEN event_id % 4 = 0 THEN 90.0 END AS held_stop,
CASE WHEN event_id % 2 = 0 THEN 100 + value + event_id % 12 END AS entry, CASE WHEN event_id % 5 <> 0 THEN 80.0 END AS stop FROM ev)"""


@query(f"""WITH {INTENTS}, e AS (SELECT *, tag IN ('ENTER_LONG', 'ENTER_SHORT', 'ADD') AS en FROM i) SELECT event_id, CASE WHEN age > least(event_id % 9000, 5000) THEN 'Intent is stale.' WHEN confidence < 0.74 THEN 'Confidence below threshold.'
WHEN en AND age + latency > 20000 THEN 'Entry signal too old (' || (age + latency) || ' ms).' WHEN en AND guard IS NOT NULL THEN 'Entry blocked by context guard: ' || guard || '.' WHEN en AND last IS NULL THEN 'No market price available.'
WHEN en AND tag <> 'ADD' AND held IS NOT NULL THEN 'Position already open.' WHEN en AND stop IS NULL AND held_stop IS NULL THEN 'Stop price is required for entries.' WHEN en AND abs(coalesce(entry, last) - last) > 8 THEN 'Entry too far from current market.'
WHEN en AND coalesce(held, 0) + 1 > 4 THEN 'Position would exceed max contract size.' WHEN tag IN ('TRIM', 'EXIT_ALL') AND held IS NULL THEN 'No open position to manage.' ELSE 'Approved.' END AS reason FROM e""")
def risk_gate(spark, d):
    k, some = F.col("event_id"), lambda c, v: F.when(c, v)
    tag = F.when(F.col("event_type") == "view", "TRIM").otherwise(tag_of())
    last = some(k % 17 != 0, 100 + F.col("value"))
    x = {
        "tag": tag, "age_ms": k * 37 % 6000, "stale_after_ms": k % 9000, "latency_ms": k * 91 % 25000, "confidence": 0.7 + (k % 11) / 30.0, "guard": some(k % 13 == 0, F.lit("recent cue")), "last": last,
        "held": some(k % 3 != 0, k % 6), "held_stop": some(k % 4 == 0, F.lit(90.0)), "entry": some(k % 2 == 0, 100 + F.col("value") + k % 12), "stop": some(k % 5 != 0, F.lit(80.0)), "size": F.lit(1),
    }
    return events(spark, d).select("event_id", risk.risk_gate(x).alias("reason"))


BRACKETS = f"""SELECT event_id, {TAG} AS tag, CASE WHEN event_id % 6 = 0 THEN 'SHORT' END AS side, CASE WHEN event_id % 2 = 0 THEN value END AS entry, CASE WHEN event_id % 3 = 0 THEN value + 1 END AS last,
CASE WHEN event_id % 5 < 3 THEN 'LONG' END AS held_side, CASE WHEN event_id % 5 < 3 THEN value + 2 END AS average FROM events"""


@query(f"""WITH b AS ({BRACKETS}), s AS (SELECT event_id, coalesce(entry, last, average) AS ref, CASE WHEN tag IN ('ENTER_LONG', 'ENTER_SHORT', 'ADD') THEN CASE coalesce(side, CASE tag WHEN 'ENTER_LONG' THEN 'LONG' WHEN 'ENTER_SHORT' THEN 'SHORT' WHEN 'ADD' THEN held_side END) WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 END END AS sign FROM b)
SELECT event_id, round(ref - 120 * sign, 4) AS stop, round(ref + 240 * sign, 4) AS target FROM s""")
def wide_brackets(spark, d):
    k, v = F.col("event_id"), F.col("value")
    b = risk.wide_brackets(tag_of(), F.when(k % 6 == 0, "SHORT"), F.when(k % 2 == 0, v), F.when(k % 3 == 0, v + 1), F.when(k % 5 < 3, "LONG"), F.when(k % 5 < 3, v + 2))
    return read(spark, d, "events").select(k, b.alias("b")).select("event_id", F.round("b.stop", 4).alias("stop"), F.round("b.target", 4).alias("target"))


@query("""WITH q AS (SELECT event_id, event_id % 2 = 0 AS long, CASE WHEN event_id % 3 = 0 THEN value END AS entry, CASE WHEN event_id % 5 = 0 THEN value - 5 END AS stop0, CASE WHEN event_id % 7 = 0 THEN value + 5 END AS target0, CASE WHEN event_id % 4 <> 0 THEN value + 0.1 END AS last, CASE WHEN event_id % 6 <> 0 THEN value - 0.2 ELSE 0 END AS bid, CASE WHEN event_id % 9 <> 0 THEN value + 0.3 END AS ask, value FROM events),
p AS (SELECT *, coalesce(CASE WHEN entry > 0 THEN entry END, CASE WHEN long THEN coalesce(ask, last, CASE WHEN bid > 0 THEN bid END) ELSE coalesce(CASE WHEN bid > 0 THEN bid END, last, ask) END) AS ref FROM q),
s AS (SELECT *, coalesce(CASE WHEN stop0 > 0 THEN stop0 END, CASE WHEN long THEN floor((ref - 120) / 0.25) ELSE ceil((ref + 120) / 0.25) END * 0.25) AS stop, coalesce(CASE WHEN target0 > 0 THEN target0 END, CASE WHEN long THEN ceil((ref + 240) / 0.25) ELSE floor((ref - 240) / 0.25) END * 0.25) AS target FROM p),
m AS (SELECT *, greatest(abs(stop - value), 10) AS away FROM s)
SELECT event_id, round(stop, 4) AS stop, round(target, 4) AS target, round(CASE WHEN long THEN floor((CASE WHEN stop >= value - 0.5 THEN value - away ELSE stop END) / 0.25) ELSE ceil((CASE WHEN stop <= value + 0.5 THEN value + away ELSE stop END) / 0.25) END * 0.25, 4) AS seated FROM m""")
def protective_prices(spark, d):
    k, v = F.col("event_id"), F.col("value")
    side = F.when(k % 2 == 0, "LONG").otherwise("SHORT")
    quote = (F.when(k % 4 != 0, v + 0.1), F.when(k % 6 != 0, v - 0.2).otherwise(0.0), F.when(k % 9 != 0, v + 0.3))
    made = risk.protective_prices(side, F.when(k % 3 == 0, v), F.when(k % 5 == 0, v - 5), F.when(k % 7 == 0, v + 5), *quote)
    x = read(spark, d, "events").select(k, "value", side.alias("side"), made.alias("b"))
    seated = risk.reseat(F.col("side"), F.col("b.stop"), F.col("value"), F.col("value"), True)
    return x.select("event_id", F.round("b.stop", 4).alias("stop"), F.round("b.target", 4).alias("target"), F.round(seated, 4).alias("seated"))


HINTS = "['all', ' Half', 'most', 'one', 'two', 'three', '5', '-1', '', 'some']"


@query(f"""WITH h AS (SELECT event_id, lower(trim({HINTS}[event_id % 10 + 1])) AS h, event_id % 7 AS held FROM events) SELECT event_id, (CASE WHEN held <= 0 THEN 0 WHEN h = 'all' THEN held WHEN h = 'half' THEN greatest(1, held // 2) WHEN h = 'most' THEN greatest(1, held - 1)
WHEN h = 'one' THEN 1 WHEN h = 'two' THEN least(2, held) WHEN h = 'three' THEN least(3, held) WHEN h = '5' THEN least(5, held) WHEN h = '-1' THEN 0 ELSE least(1, held) END)::BIGINT AS contracts FROM h""")
def trim_quantity(spark, d):
    hint = F.get(F.array(*[F.lit(x) for x in ("all", " Half", "most", "one", "two", "three", "5", "-1", "", "some")]), (F.col("event_id") % 10).cast("int"))
    return read(spark, d, "events").select("event_id", risk.trim_quantity(hint, F.col("event_id") % 7).alias("contracts"))


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'BUY' WHEN 'purchase' THEN 'SELL' ELSE 'CLOSE' END AS action, CASE event_id % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' END AS p FROM events), s AS (SELECT *, CASE action WHEN 'BUY' THEN 'LONG' WHEN 'SELL' THEN 'SHORT' END AS side FROM e)
SELECT event_id, 0 AS step, CASE WHEN action = 'CLOSE' OR p <> side THEN 'EXIT_ALL' WHEN p = side THEN 'ADD' ELSE 'ENTER_' || side END AS tag, CASE WHEN action = 'CLOSE' OR p <> side THEN p ELSE side END AS side FROM s
UNION ALL SELECT event_id, 1, 'ENTER_' || side, side FROM s WHERE action <> 'CLOSE' AND p <> side""")
def expand_manual(spark, d):
    action = F.when(F.col("event_type") == "signup", "BUY").when(F.col("event_type") == "purchase", "SELL").otherwise("CLOSE")
    position = F.when(F.col("event_id") % 3 == 0, "LONG").when(F.col("event_id") % 3 == 1, "SHORT")
    steps = read(spark, d, "events").select("event_id", F.posexplode(risk.expand_manual(action, position)).alias("step", "s"))
    return steps.select("event_id", "step", "s.tag", "s.side")


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 4 = 1 THEN 'A1' END, CASE WHEN event_id % 6 = 0 THEN 'S' || user_id END, 'CFG') AS account,
CASE WHEN event_id % 5 = 1 THEN event_type WHEN event_id % 7 = 0 THEN 'OVR' WHEN event_id % 2 = 0 THEN 'MES 06-26' ELSE 'MNQ 09-26' END AS symbol FROM events""")
def route_symbol(spark, d):
    k = F.col("event_id")
    account = [F.when(k % 4 == 1, " A1 ").otherwise(" "), F.when(k % 6 == 0, F.concat(F.lit("S"), F.col("user_id").cast("string"))), F.lit("CFG")]
    given, override = F.when(k % 5 == 1, F.col("event_type")).when(k % 5 == 0, "  "), F.when(k % 7 == 0, "OVR")
    routed = risk.route(account, given, override, F.when(k % 2 == 0, "MES 06-26").otherwise("MES"), F.lit("MNQ 09-26"))
    return read(spark, d, "events").select("event_id", routed.alias("r")).select("event_id", "r.account", "r.symbol")


@query("""WITH RECURSIVE c AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'STOP' ELSE 'BREAKEVEN' END WHEN event_type = 'signup' THEN 'ENTER' WHEN event_type = 'purchase' THEN 'ADD' WHEN event_type = 'click' THEN 'TRIM' ELSE 'EXIT' END AS kind,
CASE WHEN event_id % 11 <> 0 THEN (1 + event_id % 3)::INTEGER END AS q, value AS price, value - 3 AS st, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
s AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 0 AS qty, 0.0::DOUBLE AS avg, NULL::DOUBLE AS stop, false AS ok FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, rn, event_id, qty2, CASE WHEN qty2 = 0 THEN 0 WHEN ok2 AND more > 0 THEN (avg * qty + price * more) / qty2 ELSE avg END, CASE WHEN qty2 = 0 THEN NULL WHEN NOT ok2 THEN stop WHEN kind = 'BREAKEVEN' THEN avg WHEN kind IN ('STOP', 'ENTER', 'ADD') THEN st ELSE stop END, ok2
FROM (SELECT *, CASE WHEN ok2 THEN qty + more ELSE qty END AS qty2 FROM (SELECT c.user_id, c.rn, c.event_id, c.kind, c.price, c.st, s.qty, s.avg, s.stop, CASE WHEN c.kind IN ('ENTER', 'ADD', 'TRIM') AND c.q IS NULL THEN false WHEN c.kind = 'ENTER' THEN s.qty = 0 ELSE s.qty > 0 END AS ok2,
CASE WHEN c.kind IN ('ENTER', 'ADD') THEN c.q WHEN c.kind = 'TRIM' THEN -least(c.q, s.qty) WHEN c.kind = 'EXIT' THEN -s.qty ELSE 0 END AS more FROM s JOIN c ON c.user_id = s.user_id AND c.rn = s.rn + 1)))
SELECT user_id, event_id, qty, ok, CASE WHEN qty = 0 THEN 'FLAT' ELSE 'LONG' END AS side, floor(avg * 1000 + 0.5) / 1000 AS avg_price, floor(stop * 1000 + 0.5) / 1000 AS stop FROM s WHERE rn > 0""")
def position_ledger(spark, d):
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", F.when(k % 2 == 0, "STOP").otherwise("BREAKEVEN")).when(F.col("event_type") == "signup", "ENTER").when(F.col("event_type") == "purchase", "ADD").when(F.col("event_type") == "click", "TRIM").otherwise("EXIT")
    c = read(spark, d, "events").select("user_id", k, kind.alias("kind"), F.lit("LONG").alias("side"), F.when(k % 11 != 0, 1 + k % 3).alias("qty"), F.col("value").alias("price"), (F.col("value") - 3).alias("stop"))
    short = lambda x: (F.floor(F.col(x) * 1000 + 0.5) / 1000).alias(x)
    return risk.position_ledger(c, "user_id", "event_id").select("user_id", "event_id", "qty", "ok", "side", short("avg_price"), short("stop"))


@query("""WITH e AS (SELECT event_id, 5000 + value AS market, floor(value)::BIGINT % 1000 AS v, CASE event_id % 4 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 0.75 ELSE 0 END AS part FROM events), n AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 60 ELSE v END AS x FROM e),
m AS (SELECT *, (10 ** least(length(x::VARCHAR), 3))::BIGINT AS place, unnest(range(-5, 6)) AS k FROM n), b AS (SELECT *, round_even(market, 0)::BIGINT + k * 100 AS base FROM m), c AS (SELECT *, base - base % place + x AS e FROM b),
p AS (SELECT event_id, market, k, unnest([0, 1, 2]) AS j, unnest([e, CASE WHEN e - place > 0 THEN e - place END, e + place]) + part AS p FROM c)
SELECT event_id, round(arg_min(p, {'d': abs(p - market), 'k': k, 'j': j}), 2)::DOUBLE AS price FROM p WHERE p IS NOT NULL GROUP BY event_id""")
def resolve_price(spark, d):
    """Digits or a number word with a fraction; grouped words are in the tests."""
    k = F.col("event_id")
    part = F.when(k % 4 == 1, " quarter").when(k % 4 == 2, "-half").when(k % 4 == 3, " three quarter").otherwise("")
    raw = F.concat(F.when(k % 7 == 0, "Sixty").otherwise((F.floor("value").cast("long") % 1000).cast("string")), part)
    return read(spark, d, "events").select(k, prices.resolve_price(raw, 5000 + F.col("value")).alias("price"))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t, CASE event_type WHEN 'signup' THEN 'ENTER_LONG' WHEN 'purchase' THEN 'ADD' ELSE 'TRIM' END AS tag, CASE WHEN event_id % 4 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
CASE WHEN event_id % 3 = 0 THEN 1.0 END AS stop, event_id % 2 = 0 AS fol, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS rn FROM events),
f AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS lt, NULL::VARCHAR AS ltag, NULL::VARCHAR AS ls, NULL::DOUBLE AS lstop, false AS keep FROM (SELECT DISTINCT user_id FROM r)
UNION ALL SELECT user_id, rn, event_id, CASE WHEN keep THEN t ELSE lt END, CASE WHEN keep THEN tag ELSE ltag END, CASE WHEN keep THEN side ELSE ls END, CASE WHEN keep THEN stop ELSE lstop END, keep FROM (SELECT r.*, f.lt, f.ltag, f.ls, f.lstop,
NOT coalesce(r.side = f.ls AND r.stop IS NOT DISTINCT FROM f.lstop AND ((r.t - f.lt <= 43200 AND r.tag = f.ltag) OR (r.t - f.lt <= 86400 AND r.tag <> 'TRIM' AND f.ltag <> 'TRIM' AND r.fol)), false) AS keep FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1))
SELECT user_id, event_id FROM f WHERE keep""")
def suppress_duplicates(spark, d):
    tag = F.when(F.col("event_type") == "signup", "ENTER_LONG").when(F.col("event_type") == "purchase", "ADD").otherwise("TRIM")
    k, none = F.col("event_id"), F.lit(None).cast("double")
    rows = events(spark, d).select("user_id", "sec", k, tag.alias("tag"), F.when(k % 4 == 0, "LONG").otherwise("SHORT").alias("side"), none.alias("entry"), F.when(k % 3 == 0, 1.0).alias("stop"), none.alias("target"))
    return od.suppress_duplicates(rows, "user_id", "sec", "event_id", k % 2 == 0, 43200, 86400).select("user_id", "event_id")


# --- moved from the query bodies ------------------------------------------------------------------------------


@query("SELECT user_id, round(least(0.99, greatest(0.3, 1 + avg(-value / 100) / 5)), 6) AS confidence FROM events GROUP BY user_id")
def logprob_confidence(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.round(tx.logprob_confidence(F.avg(-F.col("value") / 100)), 6).alias("confidence"))


@query("SELECT conv_id, turn, 'recent=' || role || CASE WHEN text <> '' THEN chr(10) || 'current=' || replace(text, chr(10), ' ') ELSE '' END AS prompt FROM conversations")
def rebuild_prompt(spark, d):
    old = F.concat(F.lit("entry=x\ncurrent="), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\nrecent="), F.col("role"))
    return conv(spark, d).select("conv_id", "turn", tx.rebuild_prompt(old, ["recent", "analysis", "current"]).alias("prompt"))


@query("SELECT user_id, event_id // 50 AS frame, round(sqrt(avg(value * value)) / 32768, 9) AS rms, sqrt(avg(value * value)) / 32768 >= 0.012 AS voiced FROM (SELECT user_id, event_id, value * 10 AS value FROM events) GROUP BY ALL")
def frame_energy(spark, d):
    rms, voiced = tx.frame_energy(F.col("value") * 10)
    return read(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 50).alias("frame")).agg(F.round(rms, 9).alias("rms"), voiced.alias("voiced"))


@query(f"""WITH {EV}, s AS (SELECT event_id, sec, last_value(CASE WHEN event_type = 'error' THEN sec WHEN event_type = 'signup' THEN -1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM ev)
SELECT event_id, coalesce(since >= 0 AND sec - since <= 36000, false) AS suppressed FROM s""")
def instrument_context(spark, d):
    kind = F.col("event_type")
    return od.instrument_context(events(spark, d), "user_id", ["sec", "event_id"], "sec", kind == "error", kind == "signup", 36000, "suppressed").select("event_id", "suppressed")


@query(f"""WITH {EV}, x AS (SELECT *, floor(value)::BIGINT % 3 AS stop, event_id % 2 = 0 AS strong FROM ev), n AS (SELECT p.user_id, p.event_id AS id, any_value(p.sec) AS sec, any_value(p.stop) AS stop, min((f.sec, f.event_id, f.strong, f.stop)) AS f FROM x p
LEFT JOIN x f ON f.user_id = p.user_id AND f.event_type = 'purchase' AND (f.sec, f.event_id) > (p.sec, p.event_id) WHERE p.event_type = 'view' GROUP BY 1, 2), o AS (SELECT *, coalesce(f[1] - sec <= 7200, false) AS timely, coalesce(f[3] AND f[4] = stop, false) AS same FROM n)
SELECT user_id, id, CASE WHEN timely THEN CASE WHEN same THEN 'confirmed' ELSE 'flattened' END ELSE 'expired' END AS outcome, CASE WHEN timely AND same THEN f[2] END AS confirmed_by FROM o""")
def confirm_preview(spark, d):
    kind = F.col("event_type")
    return rel.confirm_preview(events(spark, d), "user_id", "sec", "event_id", kind == "view", kind == "purchase", F.col("event_id") % 2 == 0, F.floor("value").cast("long") % 3, 7200)


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, sec, event_id, event_type, event_id % 100 / 100.0 AS p, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS rn FROM ev),
f AS (SELECT *, CASE WHEN p >= 0.43 THEN event_id END AS win, sec AS last FROM r WHERE rn = 1
UNION ALL SELECT r.*, CASE WHEN f.win IS NOT NULL AND r.sec - f.last <= 21600 THEN f.win WHEN r.p >= 0.43 THEN r.event_id END, CASE WHEN r.p >= 0.28 THEN r.sec WHEN f.win IS NOT NULL AND r.sec - f.last <= 21600 THEN f.last ELSE r.sec END FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1),
m AS (SELECT * FROM f WHERE win IS NOT NULL AND p >= 0.28), w AS (SELECT user_id, win, min(sec) AS s, max(sec) AS e, count(*) AS n FROM m GROUP BY ALL),
a AS (SELECT user_id, win, sec, event_id, event_type FROM m UNION ALL SELECT w.user_id, w.win, r.sec, r.event_id, r.event_type FROM w JOIN r ON r.user_id = w.user_id AND r.sec < w.s AND r.sec >= w.s - 7200), b AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY sec DESC, event_id DESC) AS back FROM a)
SELECT w.user_id, w.win AS "window", w.s AS start, w.e AS "end", w.n::BIGINT AS n, string_agg(event_type, ' ' ORDER BY sec, event_id) FILTER (back <= 5) AS text FROM w JOIN b ON b.win = w.win GROUP BY ALL""")
def candidate_windows(spark, d):
    return cascade.candidate_windows(events(spark, d), "user_id", "sec", "event_id", F.col("event_id") % 100 / 100.0, F.col("event_type"), 21600, before=7200)


#: A rule that two rows may meet together.
PAIR = "CASE WHEN regexp_matches({0}, '\\bwas\\b') THEN 'NO_ACTION' WHEN regexp_matches({0}, '\\bthe\\b.*\\bof\\b') THEN 'TRIM' END"


@query(f"""WITH RECURSIVE g AS (SELECT conv_id, turn, p, {PAIR.format('p')} AS own, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM (SELECT conv_id, turn, {P} AS p FROM conversations)),
f AS (SELECT conv_id, 0::BIGINT AS rn, NULL::BIGINT AS turn, []::VARCHAR[] AS parts, NULL::VARCHAR AS tag, false AS hit FROM (SELECT DISTINCT conv_id FROM g)
UNION ALL SELECT conv_id, rn, turn, CASE WHEN hit OR acts THEN [] ELSE now END, tag, hit FROM (SELECT *, coalesce(tag NOT IN ('NO_ACTION', 'SETUP'), false) AS hit FROM (SELECT *, CASE WHEN own IS NULL THEN {PAIR.format("array_to_string(now, ' ')")} END AS tag
FROM (SELECT g.conv_id, g.rn, g.turn, g.own, coalesce(g.own NOT IN ('NO_ACTION', 'SETUP'), false) AS acts, list_append(f.parts[-4:], g.p) AS now FROM f JOIN g ON g.conv_id = f.conv_id AND g.rn = f.rn + 1))))
SELECT conv_id, turn, tag FROM f WHERE hit""")
def recover_windows(spark, d):
    groups, tags = {"past": [r"\bwas\b"], "pair": [r"\bthe\b.*\bof\b"]}, {"past": "NO_ACTION", "pair": "TRIM"}
    return cascade.recover_windows(conv(spark, d).withColumn("p", plain(F.col("text"))), "p", groups, tags, "conv_id", "turn")


@query(f"""WITH b AS (SELECT user_id, event_type, {TAG} AS label, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id // 50 ORDER BY (event_type <> 'view') DESC, value DESC, event_id) = 1)
SELECT label, CASE WHEN event_type = 'view' THEN 'pending' WHEN value > 10 THEN 'reviewed' ELSE 'dropped' END AS status, count(*)::BIGINT AS n FROM b GROUP BY ALL""")
def export_review(spark, d):
    e = read(spark, d, "events").withColumn("line", F.floor(F.col("event_id") / 50)).withColumn("label", tag_of())
    done = F.col("event_type") != "view"
    return cascade.export_review(e, ["user_id", "line"], [F.desc(done), F.desc("value"), "event_id"], done, F.col("value") <= 10)[1]


@query(f"""WITH c AS (SELECT user_id AS file, event_id % 7 AS line, event_id % 3 AS ordinal, event_id AS row, {TAG} AS tag, CASE WHEN value > 60 THEN 'LONG' END AS position FROM events), l AS (SELECT *, CASE WHEN tag = 'ADD' THEN 'ENTER_' || position ELSE tag END AS label FROM c),
m AS (SELECT * FROM l WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY ordinal DESC, row DESC) = 1) SELECT label, ordinal, count(*)::BIGINT AS n FROM m GROUP BY ALL""")
def dataset_build(spark, d):
    position = F.when(F.col("value") > 60, "LONG").alias("position")
    c = read(spark, d, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 7).alias("line"), (F.col("event_id") % 3).alias("ordinal"), F.col("event_id").alias("row"), tag_of().alias("label"), position)
    return cascade.dataset_build(c, ["position"])[1]


@query("""WITH e AS (SELECT event_id, 5000 + value AS market, CASE WHEN event_id % 3 < 2 THEN floor(value)::BIGINT % 1000 END AS x FROM events), m AS (SELECT *, (10 ** least(length(x::VARCHAR), 3))::BIGINT AS place, unnest(range(-5, 6)) AS k FROM e),
c AS (SELECT *, (round_even(market, 0)::BIGINT + k * 100) // place * place + x AS e FROM m), p AS (SELECT event_id, market, k, unnest([0, 1, 2]) AS j, unnest([e, CASE WHEN e - place > 0 THEN e - place END, e + place]) AS p FROM c)
SELECT event_id, arg_min(p, {'d': abs(p - market), 'k': k, 'j': j})::DOUBLE AS price FROM p GROUP BY event_id""")
def extract_price(spark, d):
    k, digits = F.col("event_id") % 3, (F.floor("value").cast("long") % 1000).cast("string")
    text = F.concat(F.when(k == 0, "stop at ").when(k == 1, "near ").otherwise("hold "), digits)
    price = cascade.extract_price(text, [r"stop at (\d+)", r"near (\d+)"], 5000 + F.col("value"))
    return read(spark, d, "events").select("event_id", price.alias("price"))
