"""Queries of the intent cascade and the curation compositions, each beside its DuckDB equivalent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from livetext.functions import text as tx
from livetext.operators import cascade as cc
from livetext.operators import corpora as co
from livetext.operators import instruments as ins
from livetext.operators import relational as rel
from livetext.operators import review as rv
from livetext.operators import scoring as sc
from livetext.plans import texts
from livetext.plans.queries import CASCADE, EV, GROUPS, TAG, TAGS, P, conv, events, plain, query, read, tag_of
from livetext.sources.transcripts import read_reviewed, scratch

TURNS = f"t AS (SELECT conv_id, turn, role, {P} AS p FROM conversations), g AS (SELECT *, {CASCADE.format('p')} AS raw FROM t)"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
HELD = f"h AS (SELECT *, coalesce(last_value(CASE raw WHEN 'ENTER_LONG' THEN 'LONG' WHEN 'ENTER_SHORT' THEN 'SHORT' WHEN 'EXIT_ALL' THEN 'FLAT' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn {BEFORE}), 'FLAT') AS position FROM g)"


@query(f"WITH {TURNS}, {HELD} SELECT conv_id, turn, position, CASE WHEN raw IN ('TRIM', 'MOVE_STOP', 'EXIT_ALL') AND position = 'FLAT' THEN NULL WHEN raw = 'ENTER_' || position THEN 'ADD' ELSE raw END AS tag FROM h")
def first_hit_intent(spark, d):
    c = conv(spark, d).withColumn("p", plain(F.col("text")))
    return cc.parse_intent(c, F.col("p"), GROUPS, TAGS, "conv_id", "turn").select("conv_id", "turn", "position", "tag")


@query(r"""WITH s AS (SELECT doc_id, [trim(x) FOR x IN regexp_split_to_array(text, '[.!?\n]') IF trim(x) <> ''] AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS x, unnest(range(len(parts))) AS i FROM s), v AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS g FROM u),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x, g ORDER BY i) AS run FROM v)
SELECT doc_id, coalesce(string_agg(x, '. ' ORDER BY i) FILTER (run <= CASE WHEN len(string_split(x, ' ')) <= 4 THEN 1 ELSE 2 END), '') AS text FROM w GROUP BY doc_id""")
def compact_repeats(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.compact_repeats(F.col("text")).alias("text")).filter("text <> ''")


@query(f"WITH t AS (SELECT conv_id, turn, {P} AS p FROM conversations), h AS (SELECT *, regexp_matches(p, '\\bwas\\b') AS l, regexp_matches(p, '\\bwith\\b') AS s, regexp_matches(p, '\\bthe\\b') AS seed, length(p) AS target FROM t) SELECT conv_id, turn, CASE WHEN l AND NOT s THEN 'LONG' WHEN s AND NOT l THEN 'SHORT' WHEN seed AND target > 200 THEN 'LONG' WHEN seed AND target < 200 THEN 'SHORT' END AS side FROM h")
def entry_side(spark, d):
    c = conv(spark, d).withColumn("p", plain(F.col("text")))
    return c.select("conv_id", "turn", cc.entry_side(F.col("p"), {"LONG": r"\bwas\b", "SHORT": r"\bwith\b"}, r"\bthe\b", F.length("p"), F.lit(200)).alias("side"))


@query(r"""WITH r AS (SELECT p_partkey, p_brand AS root, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'i m long in ' || p_name
  WHEN 2 THEN 'my swing ' || p_name ELSE p_name || ' got short in ' || string_split(p_name, ' ')[1] END AS x FROM part),
al AS (SELECT arg_min(p_brand, p_partkey) AS root, p_name AS alias FROM part GROUP BY p_name
  UNION ALL SELECT arg_min(p_brand, p_partkey), string_split(p_name, ' ')[2] AS alias FROM part GROUP BY 2),
w AS (SELECT p_partkey, root, string_split(x, ' ') AS w, unnest(range(len(string_split(x, ' ')))) AS s FROM r),
g AS (SELECT p_partkey, root, s, n, array_to_string(w[s + 1:s + n], ' ') AS phrase FROM w, (VALUES (1), (2)) AS k(n) WHERE s + n <= len(w)),
m AS (SELECT * FROM g WHERE phrase IN (SELECT alias FROM al)),
b AS (SELECT *, EXISTS (SELECT 1 FROM al WHERE al.root = m.root AND al.alias = m.phrase) AS mine FROM m
  WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.p_partkey = m.p_partkey AND o.s <= m.s AND o.s + o.n >= m.s + m.n AND o.n > m.n)),
f AS (SELECT p_partkey, bool_or(mine) AS own, arg_min(phrase, s) FILTER (NOT mine) AS named FROM b GROUP BY ALL),
i AS (SELECT p_partkey, root, nullif(regexp_extract(x, '\b(?:long|short) in ([a-z][a-z0-9]{2,})\b', 1), '') AS inline, regexp_matches(x, '\bmy swings?\b') AS context FROM r),
j AS (SELECT p_partkey, context, CASE WHEN NOT EXISTS (SELECT 1 FROM al WHERE al.root = i.root AND al.alias = i.inline) THEN inline END AS inline FROM i)
SELECT p_partkey, coalesce(own, false) AS own, named, inline, context, CASE WHEN context THEN 'swing_context' ELSE coalesce(inline, named) END AS "foreign"
FROM j LEFT JOIN f USING (p_partkey)""")
def symbol_scope(spark, d):
    """Parts as texts of their brands: a name of two words, and its last word, are aliases of the brand of the first part that has it."""
    part, name = read(spark, d, "part"), F.col("p_name")
    turn, words = F.col("p_partkey") % 4, F.split("p_name", " ")
    said = F.when(turn == 0, name).when(turn == 1, F.concat(F.lit("i m long in "), name)).when(turn == 2, F.concat(F.lit("my swing "), name))
    rows = part.select("p_partkey", F.col("p_brand").alias("root"), said.otherwise(F.concat(name, F.lit(" got short in "), words[0])).alias("said"))
    first = lambda alias: part.groupBy(alias.alias("alias")).agg(F.min_by("p_brand", "p_partkey").alias("root")).select("root", "alias")
    out = ins.symbol_scope(rows, "p_partkey", "said", "root", first(name).unionByName(first(words[1])))
    return out.select("p_partkey", "own", "named", "inline", "context", "foreign")


@query(f"""WITH {EV}, s AS (SELECT *, coalesce(last_value(CASE event_type WHEN 'signup' THEN 'LONG' WHEN 'purchase' THEN 'SHORT' WHEN 'error' THEN 'FLAT' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sec, event_id {BEFORE}), 'FLAT') AS position, CASE WHEN event_type = 'view' THEN 'ADD' ELSE {TAG} END AS tag FROM ev),
o AS (SELECT event_id, position, CASE WHEN tag = 'EXIT_ALL' AND value > 20 AND NOT value > 60 THEN 'TRIM' WHEN tag = 'ADD' AND position = 'FLAT' THEN 'ENTER_LONG' ELSE tag END AS tag FROM s)
SELECT event_id, CASE WHEN tag IN ('TRIM', 'EXIT_ALL') AND position = 'FLAT' THEN NULL ELSE tag END AS tag FROM o""")
def safety_override(spark, d):
    from livetext.operators.ordered import session_state

    e = session_state(events(spark, d), "user_id", ["sec", "event_id"], cc.position_effect(tag_of()), "position")
    tag = F.when(F.col("event_type") == "view", "ADD").otherwise(tag_of())
    return e.select("event_id", cc.safety_override(tag, F.lit("LONG"), F.col("position"), F.col("value") > 20, F.col("value") > 60).alias("tag"))


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, sec, event_id, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS rn FROM ev WHERE value > 3),
f AS (SELECT *, sec AS began, sec AS last FROM r WHERE rn = 1 UNION ALL SELECT r.*, CASE WHEN r.sec - f.last >= 36000 OR r.sec - f.began > 86400 THEN r.sec ELSE f.began END, r.sec FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
SELECT user_id, min(sec) AS start, max(sec) AS "end", count(*)::BIGINT AS n FROM f GROUP BY user_id, began HAVING count(*) >= 2""")
def segment_utterances(spark, d):
    return cc.segment_utterances(events(spark, d), "user_id", "sec", "event_id", F.col("value") > 3, 36000, 86400, 2)


@query(f"""WITH c AS (SELECT event_id, nullif({TAG}, 'NO_ACTION') AS tag, value > 60 AS strong, event_id % 100 / 100.0 AS p, event_id % 89 / 88.0 AS p_none, event_id % 71 / 70.0 AS confidence FROM events),
x AS (SELECT *, CASE WHEN tag IS NOT NULL AND p >= 0.7 THEN 'support' WHEN tag IS NOT NULL AND strong THEN 'rule' WHEN tag IS NOT NULL AND p_none >= 0.84 THEN 'block' WHEN tag IS NOT NULL THEN 'keep' WHEN p >= 0.7 THEN 'promote' ELSE 'none' END AS decision FROM c)
SELECT event_id, decision, CASE WHEN decision IN ('block', 'none') THEN NULL WHEN decision = 'promote' THEN 'TRIM' ELSE tag END AS final_tag,
CASE WHEN decision IN ('block', 'none') THEN NULL WHEN decision = 'promote' THEN p ELSE greatest(confidence, p) END AS final_confidence FROM x""")
def classifier_gate(spark, d):
    p = F.col("event_id") % 100 / 100.0
    c = read(spark, d, "events").select("event_id", F.nullif(tag_of(), F.lit("NO_ACTION")).alias("tag"), (F.col("value") > 60).alias("strong"), p.alias("p"), (F.col("event_id") % 89 / 88.0).alias("p_none"), F.lit("TRIM").alias("guess"), p.alias("p_guess"), F.lit(0.7).alias("threshold"), (F.col("event_id") % 71 / 70.0).alias("confidence"))
    return cc.classifier_gate(c).select("event_id", "decision", "final_tag", "final_confidence")


SCORED = ["NO_ACTION", "SETUP_LONG", "ENTER_LONG", "ENTER_SHORT", "TRIM"]
#: A label's weights: of one, of a text's length and of the places of "th" in it.
WEIGHTS = [[0.2, 0.004, -0.02], [0.1, 0.001, 0.01], [-0.3, 0.002, 0.08], [0.0, -0.001, 0.06], [0.4, -0.002, 0.03]]


def by_weights():
    """A scorer as ``score_fn`` takes it: softmax of linear weights on two features of a text."""
    w = np.array(WEIGHTS)

    def scorer(rows):
        text = rows["text"]
        z = np.column_stack([np.ones(len(text)), text.str.len(), text.str.count("th")]).astype(float) @ w.T
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return scorer


Z = ", ".join(f"exp({a} + {b} * n + ({c}) * h) AS e{k}" for k, (a, b, c) in enumerate(WEIGHTS))
SUM = " + ".join(f"e{k}" for k in range(len(WEIGHTS)))


@query(f"""WITH {TURNS}, f AS (SELECT g.conv_id, g.turn, raw AS tag, g.turn % 3 = 0 AS strong, length(c.text) AS n, (length(c.text) - length(replace(c.text, 'th', ''))) / 2 AS h
  FROM g JOIN conversations AS c ON c.conv_id = g.conv_id AND c.turn = g.turn), e AS (SELECT *, {Z} FROM f),
p AS (SELECT conv_id, turn, tag, strong, (e0 + e1) / ({SUM}) AS p_none, e2 / ({SUM}) AS p2, e3 / ({SUM}) AS p3, e4 / ({SUM}) AS p4, e1 / ({SUM}) AS p1, e0 / ({SUM}) AS p0 FROM e),
q AS (SELECT *, CASE tag WHEN 'NO_ACTION' THEN p0 WHEN 'SETUP_LONG' THEN p1 WHEN 'ENTER_LONG' THEN p2 WHEN 'ENTER_SHORT' THEN p3 WHEN 'TRIM' THEN p4 WHEN NULL THEN NULL ELSE 0 END AS px, greatest(p2, p3, p4) AS p_guess,
  CASE WHEN p2 >= greatest(p3, p4) THEN 'ENTER_LONG' WHEN p3 >= p4 THEN 'ENTER_SHORT' ELSE 'TRIM' END AS guess FROM p),
r AS (SELECT *, CASE WHEN tag IS NOT NULL THEN px END AS p, CASE coalesce(tag, guess) WHEN 'ENTER_LONG' THEN 0.45 WHEN 'TRIM' THEN 0.3 ELSE 0.4 END AS threshold FROM q),
s AS (SELECT *, CASE WHEN tag IS NOT NULL AND p >= threshold THEN 'support' WHEN tag IS NOT NULL AND strong THEN 'rule' WHEN tag IS NOT NULL AND p_none >= 0.84 THEN 'block' WHEN tag IS NOT NULL THEN 'keep' WHEN p_guess >= threshold THEN 'promote' ELSE 'none' END AS decision FROM r)
SELECT conv_id, turn, round(p, 6) AS p, round(p_none, 6) AS p_none, guess, round(p_guess, 6) AS p_guess, decision, CASE WHEN decision IN ('block', 'none') THEN NULL WHEN decision = 'promote' THEN guess ELSE tag END AS final_tag FROM s""")
def score_fn(spark, d):
    """Turns scored by a classifier outside Spark, and what the gate makes of their intents."""
    c, keys = conv(spark, d), ["conv_id", "turn"]
    intents = c.select(*keys, tx.detect_signal(plain(F.col("text")), GROUPS, TAGS).alias("tag"), (F.col("turn") % 3 == 0).alias("strong"))
    scores = sc.score_fn(c, keys, ["text"], by_weights, SCORED)
    out = sc.gated(intents, scores, keys, SCORED, {"ENTER_LONG": 0.45, "TRIM": 0.3}, 0.4)
    return out.select(*keys, *[F.round(x, 6).alias(x) for x in ("p", "p_none")], "guess", F.round("p_guess", 6).alias("p_guess"), "decision", "final_tag")


@query(f"""WITH k AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'confirmed' END AS status FROM events WHERE event_id % 2 = 0), i AS (SELECT event_id, {TAG} AS tag, value > 10 AS strong, CASE WHEN event_id % 3 > 0 THEN value END AS stop, 1 - event_id % 11 / 50.0 AS confidence, CASE WHEN event_id % 13 = 0 THEN 'cue' END AS guard FROM events)
SELECT event_id, tag NOT LIKE 'ENTER\\_%' ESCAPE '\\' OR coalesce(status = 'confirmed' OR (status = 'failed' AND strong AND stop IS NOT NULL AND confidence >= 0.9 AND guard IS NULL), false) AS passes FROM i LEFT JOIN k USING (event_id)""")
def confirmation_gate(spark, d):
    e, k = read(spark, d, "events"), F.col("event_id")
    intents = e.select("event_id", tag_of().alias("tag"), (F.col("value") > 10).alias("strong"), F.when(k % 3 > 0, F.col("value")).alias("stop"), (1 - k % 11 / 50.0).alias("confidence"), F.when(k % 13 == 0, "cue").alias("guard"))
    answers = e.filter("event_id % 2 = 0").select("event_id", F.when(k % 5 == 0, "failed").otherwise("confirmed").alias("status"))
    return cc.confirmation_gate(intents, answers, "event_id").select("event_id", "passes")


RULES = [("ENTER_LONG", r"\bwas\b", "rejected"), ("ENTER_LONG", r"\bthe\b", "accepted"), ("TRIM", r"\bof\b", "corrected")]


@query(f"WITH {TURNS}, c AS (SELECT conv_id, turn, raw AS label, p, turn % 10 / 10.0 AS confidence FROM g WHERE raw IS NOT NULL) SELECT conv_id, turn, CASE " + " ".join(f"WHEN label = '{a}' AND regexp_matches(p, '{b}') THEN '{s}'" for a, b, s in RULES) + " WHEN confidence >= 0.3 THEN 'accepted' ELSE 'pending' END AS status FROM c")
def first_rule_review(spark, d):
    c = conv(spark, d).withColumn("p", plain(F.col("text"))).withColumn("label", tx.detect_signal(F.col("p"), GROUPS, TAGS)).filter("label is not null")
    return cc.auto_review(c.withColumn("confidence", F.col("turn") % 10 / 10.0), F.col("p"), RULES, 0.3).select("conv_id", "turn", "status")


@query(f"""WITH t AS (SELECT conv_id AS file, turn AS line, role, {P} AS p FROM conversations), f AS (SELECT *, CASE WHEN regexp_matches(p, '\\bwas\\b') THEN 'past' WHEN regexp_matches(p, '\\bfor\\b') THEN 'plan' WHEN regexp_matches(p, '\\b(?:de|der)\\b') THEN 'talk' END AS family FROM t),
x AS (SELECT file, line, family FROM f WHERE family IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f AS q WHERE q.file = f.file AND q.role = 'system' AND abs(q.line - f.line) <= 1)) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY family ORDER BY file, line) <= 40""")
def hard_negative_lines(spark, d):
    t = conv(spark, d).select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "role", plain(F.col("text")).alias("p"))
    families = {"past": [r"\bwas\b"], "plan": [r"\bfor\b"], "talk": [r"\b(?:de|der)\b"]}
    return cc.mine_hard_negatives(t, F.col("p"), families, t.filter("role = 'system'"))


@query(f"""WITH {TURNS}, {HELD}, s AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY conv_id ORDER BY turn) || ' ' || p, p) AS analysis FROM h)
SELECT conv_id AS file, turn AS line, CASE WHEN turn % 2 = 1 THEN 'TRIM' ELSE 'NO_ACTION' END AS label, concat_ws(chr(10), CASE WHEN position <> 'FLAT' THEN 'position=' || position END, CASE WHEN analysis <> '' THEN 'analysis=' || analysis END, CASE WHEN p <> '' THEN 'current=' || p END) AS prompt FROM s""")
def build_examples(spark, d):
    t = conv(spark, d).select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "text")
    labels = t.filter("line % 2 = 1").select("file", "line", F.lit("TRIM").alias("label"))
    return cc.build_examples(t, labels, plain(F.col("text")), GROUPS, TAGS)


@query(f"""WITH RECURSIVE x AS (SELECT event_id AS id, user_id AS file, event_id // 10 AS line, {TAG} AS label, event_id % 3 AS s, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY file, label ORDER BY line, id) AS rn FROM x),
f AS (SELECT *, line AS last, true AS keep FROM r WHERE rn = 1 UNION ALL SELECT r.*, CASE WHEN r.line - f.last > 40 THEN r.line ELSE f.last END, r.line - f.last > 40 FROM f JOIN r ON r.file = f.file AND r.label = f.label AND r.rn = f.rn + 1)
SELECT id, label, CASE WHEN label IN ('TRIM', 'EXIT_ALL') AND s = 1 THEN 'FLAT' WHEN s = 2 OR (label IN ('TRIM', 'EXIT_ALL') AND s = 0) THEN 'LONG' ELSE 'FLAT' END AS side, CASE WHEN label IN ('TRIM', 'EXIT_ALL') AND s = 1 THEN 'impossible' WHEN value > 15 THEN 'advice' ELSE 'clean' END AS flag FROM f WHERE keep""")
def repair_and_flag(spark, d):
    k = F.col("event_id") % 3
    x = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("file"), F.floor(F.col("event_id") / 10).alias("line"), tag_of().alias("label"), F.when(k == 2, "LONG").otherwise("FLAT").alias("side"), F.when(k == 0, "LONG").otherwise("FLAT").alias("last_side"), "value")
    return cc.cleanup_examples(x, F.col("value") > 15, 40).select("id", "label", "side", "flag")


@query("""WITH c AS (SELECT conv_id AS file, turn // 4 AS chunk, turn AS line FROM conversations), l AS (SELECT conv_id AS file, turn // 3 AS chunk, turn AS line, role FROM conversations)
SELECT file, chunk, line, role FROM l JOIN c USING (file, chunk, line)""")
def resolve_chunk_refs(spark, d):
    chunk = lambda n: conv(spark, d).select(F.col("conv_id").alias("file"), F.floor(F.col("turn") / n).alias("chunk"), F.col("turn").alias("line"), "role")
    return rel.resolve_chunk_refs(chunk(3), chunk(4).drop("role"))


@query("""WITH s AS (SELECT event_type AS label, least(1, value / 100) AS score, event_id % 2 = 0 AS hit FROM events), k AS (SELECT unnest(range(31)) AS k)
SELECT label, k, count(*) FILTER (hit AND round((score - 0.30) / 0.02, 6) >= k)::BIGINT AS tp, count(*) FILTER (round((score - 0.30) / 0.02, 6) >= k)::BIGINT AS n FROM s, k GROUP BY ALL""")
def threshold_grid(spark, d):
    s = read(spark, d, "events").select(F.col("event_type").alias("label"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"), (F.col("event_id") % 2 == 0).alias("hit"))
    return rel.threshold_grid(s)


OVER = "OVER (PARTITION BY user_id ORDER BY sec, event_id"


@query(f"""WITH RECURSIVE {EV}, x AS (SELECT user_id, sec, event_id, value > 20 AS v, row_number() {OVER}) AS rn, sum((value > 20)::INTEGER) {OVER} ROWS 2 PRECEDING) AS k, first_value(sec) {OVER} ROWS 2 PRECEDING) AS fst,
max(CASE WHEN value > 20 THEN sec END) {OVER} ROWS UNBOUNDED PRECEDING) AS heard FROM ev), y AS (SELECT *, k = 0 AND coalesce(sec - heard >= 36000, true) AS dead FROM x),
z AS (SELECT *, max(CASE WHEN dead THEN sec END) {OVER} ROWS UNBOUNDED PRECEDING) AS bound, lead(rn) {OVER}) IS NULL AS fin FROM y),
f AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS b, 0::HUGEINT AS n, NULL::BIGINT AS last, NULL::BIGINT AS ended, NULL::BIGINT AS now, NULL::BIGINT AS es, NULL::BIGINT AS ee, NULL::HUGEINT AS en FROM (SELECT DISTINCT user_id FROM z)
UNION ALL SELECT user_id, rn, CASE WHEN ends THEN NULL ELSE b2 END, n2, last2, CASE WHEN dead THEN NULL WHEN ends THEN sec ELSE ended END, CASE WHEN dead THEN NULL ELSE sec END, CASE WHEN dead THEN b WHEN ends OR fin THEN b2 END, CASE WHEN dead THEN now ELSE sec END, CASE WHEN dead THEN n ELSE n2 END
FROM (SELECT *, NOT dead AND b IS NOT NULL AND (sec - last2 >= 36000 OR sec - b2 >= 86400) AS ends FROM (SELECT *, CASE WHEN dead THEN NULL WHEN opens THEN greatest(fst, coalesce(bound, fst), coalesce(ended, fst)) ELSE b END AS b2,
CASE WHEN dead THEN 0 WHEN opens THEN k WHEN b IS NULL THEN 0 ELSE n + v::INTEGER END AS n2, CASE WHEN opens OR v THEN sec ELSE last END AS last2 FROM (SELECT z.user_id, z.rn, z.sec, z.v, z.k, z.fst, z.bound, z.dead, z.fin, f.b, f.n, f.last, f.ended, f.now, NOT z.dead AND f.b IS NULL AND z.k >= 2 AS opens
FROM f JOIN z ON z.user_id = f.user_id AND z.rn = f.rn + 1))))
SELECT user_id, es AS start, ee AS "end", en::BIGINT AS n FROM f WHERE es IS NOT NULL AND en >= 2""")
def windowed_utterances(spark, d):
    """Utterances that two voiced frames of three open; events stand for frames."""
    return cc.windowed_utterances(events(spark, d), "user_id", "sec", "event_id", F.col("value") > 20, 3, 2, 36000, 86400, 2)


#: Words that stand for the phrases of the review rules in the given texts.
REVIEWED = {
    "other_instrument": "wher", "setup_short": "er", "setup_long": "ly", "explicit_add": "an", "future_add": "for", "first_person_entry": "the",
    "ambiguous_action": "of", "second_person_trim": "ha", "first_person_trim": "and", "exit_target": "is", "explicit_exit": "to", "stop_move": "in",
}
TOLD = ["ENTER_LONG", "ADD", "TRIM", "EXIT_ALL", "MOVE_STOP", "NO_ACTION", "SETUP_SHORT", "ENTER_SHORT", "MOVE_TO_BREAKEVEN", "TARGET", "OTHER"]
SIDES = ["LONG", " sell", "none", "SHORT"]
H = ", ".join(f"regexp_matches(x, '\\b{w}\\b') AS {g}" for g, w in REVIEWED.items())


@query(f"""WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '') || ' ' || CASE WHEN turn % 4 = 0 THEN 'an end' ELSE '' END) AS low, {TOLD}[((conv_id + turn) % {len(TOLD)} + 1)::INTEGER] AS label,
  {SIDES}[(turn % 4 + 1)::INTEGER] AS side, CASE WHEN conv_id % 9 = 0 THEN 'corrected' WHEN conv_id % 9 > 2 THEN 'pending' END AS status FROM conversations),
n AS (SELECT *, trim(regexp_replace(regexp_replace(replace(low, 'vwop', 'vwap'), '[^a-z0-9\\s'']', ' ', 'g'), '\\s+', ' ', 'g')) AS x, CASE upper(trim(side)) WHEN 'LONG' THEN 'LONG' WHEN 'BUY' THEN 'LONG' WHEN 'SELL' THEN 'SHORT' WHEN 'SHORT' THEN 'SHORT' END AS sd FROM t),
h AS (SELECT *, {H}, label LIKE 'ENTER%' AS entry FROM n), r AS (SELECT *, CASE WHEN status = 'corrected' OR label = 'OTHER' THEN NULL WHEN other_instrument THEN 'rejected/other instrument' WHEN label LIKE 'SETUP%' THEN 'accepted/auto setup'
  WHEN (entry OR label = 'ADD') AND setup_short THEN 'corrected/auto setup short' WHEN (entry OR label = 'ADD') AND setup_long THEN 'corrected/auto setup long' WHEN entry AND explicit_add THEN 'corrected/explicit add'
  WHEN label = 'ADD' AND future_add THEN 'rejected/future or conditional add' WHEN label = 'ADD' AND explicit_add THEN 'accepted/explicit add' WHEN entry AND first_person_entry THEN 'accepted/explicit entry'
  WHEN entry AND ambiguous_action THEN 'rejected/ambiguous market action' WHEN label = 'TRIM' AND second_person_trim THEN 'rejected/second person advice' WHEN label = 'TRIM' AND first_person_trim THEN 'accepted/explicit trim'
  WHEN label = 'EXIT_ALL' AND exit_target THEN 'rejected/future exit target' WHEN label = 'EXIT_ALL' AND explicit_exit THEN 'accepted/explicit exit' WHEN label LIKE 'MOVE%' AND stop_move THEN 'accepted/explicit stop move'
  WHEN label = 'NO_ACTION' THEN 'accepted/already no action' WHEN label = 'TARGET' AND sd IS NOT NULL AND first_person_entry THEN 'accepted/explicit side action' END AS hit FROM h),
s AS (SELECT *, split_part(hit, '/', 1) AS did, nullif(split_part(hit, '/', 2), '') AS note FROM r)
SELECT conv_id, turn, coalesce(nullif(did, ''), status, 'pending') AS status, note,
  CASE did WHEN 'accepted' THEN label WHEN 'rejected' THEN 'NO_ACTION' WHEN 'corrected' THEN CASE note WHEN 'auto setup short' THEN 'SETUP_SHORT' WHEN 'auto setup long' THEN 'SETUP_LONG' ELSE 'ADD' END END AS reviewed_label,
  CASE did WHEN 'accepted' THEN side WHEN 'corrected' THEN CASE note WHEN 'auto setup short' THEN 'SHORT' WHEN 'auto setup long' THEN 'LONG' ELSE sd END END AS reviewed_side FROM s""")
def auto_review(spark, d):
    """Turns as candidates: a label and a side of their own, each fourth with evidence, some reviewed before."""
    c, pick = conv(spark, d), lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    told = pick(TOLD, (F.col("conv_id") + F.col("turn")) % len(TOLD)).alias("label")
    status = F.when(F.col("conv_id") % 9 == 0, "corrected").when(F.col("conv_id") % 9 > 2, "pending").alias("status")
    evidence = F.when(F.col("turn") % 4 == 0, "an end").alias("evidence_text")
    rows = c.select("conv_id", "turn", F.col("text").alias("current_text"), evidence, told, pick(SIDES, F.col("turn") % 4).alias("side"), status)
    out = rv.auto_review(rows, patterns={g: [rf"\b{w}\b"] for g, w in REVIEWED.items()})
    return out.select("conv_id", "turn", "status", "note", "reviewed_label", "reviewed_side")


EXAMPLES = f"""x AS (SELECT event_id AS id, user_id AS file, event_id // 10 AS line, {TAG} AS label, CASE event_id % 4 WHEN 2 THEN 'LONG' WHEN 3 THEN NULL ELSE 'FLAT' END AS was, CASE event_id % 5 WHEN 1 THEN 'SHORT' WHEN 2 THEN 'none' END AS orig,
  CASE event_id % 3 WHEN 0 THEN 'LONG' END AS last, 'position=FLAT' || chr(10) || 'market_price=' || event_id || chr(10) || 'recent=r' || event_id % 7 || chr(10) || 'current=' || event_type AS prompt, value FROM events),
y AS (SELECT *, label IN ('TRIM', 'EXIT_ALL') AND coalesce(was, 'FLAT') = 'FLAT' AND (coalesce(orig, '') = 'SHORT' OR last IS NOT NULL) AS repaired FROM x),
z AS (SELECT *, CASE WHEN NOT repaired THEN coalesce(was, 'FLAT') WHEN orig = 'SHORT' THEN 'SHORT' ELSE last END AS position_side, (lag(label) OVER w IS DISTINCT FROM label)::INTEGER AS new FROM y WINDOW w AS (PARTITION BY file ORDER BY line, id)),
u AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY line, id) AS run FROM z), v AS (SELECT *, row_number() OVER (PARTITION BY file, run ORDER BY line, id) AS rn FROM u),
f AS (SELECT file, run, rn, line, id, line AS kept_at, true AS keep FROM v WHERE rn = 1 UNION ALL SELECT v.file, v.run, v.rn, v.line, v.id, CASE WHEN v.line - f.kept_at > 60 THEN v.line ELSE f.kept_at END, v.line - f.kept_at > 60 FROM f JOIN v ON v.file = f.file AND v.run = f.run AND v.rn = f.rn + 1),
c AS (SELECT v.*, CASE WHEN label IN ('TRIM', 'EXIT_ALL', 'ENTER_LONG', 'ENTER_SHORT') AND NOT keep THEN 'duplicate_same_action_within_60_lines' WHEN label IN ('TRIM', 'EXIT_ALL') AND position_side = 'FLAT' THEN label || '_while_FLAT'
  WHEN label IN ('TRIM', 'EXIT_ALL', 'ENTER_LONG', 'ENTER_SHORT') AND value > 15 THEN 'advice_pattern: high' END AS flag_reason FROM v JOIN f USING (id))"""


def cleaned(spark, d):
    k = F.col("event_id")
    prompt = F.concat(F.lit("position=FLAT\nmarket_price="), k, F.lit("\nrecent=r"), k % 7, F.lit("\ncurrent="), "event_type")
    rows = read(spark, d, "events").select(
        k.alias("id"), F.col("user_id").alias("file"), F.floor(k / 10).alias("line"), tag_of().alias("label"), F.when(k % 4 == 2, "LONG").when(k % 4 != 3, "FLAT").alias("position_side"),
        F.when(k % 5 == 1, "SHORT").when(k % 5 == 2, "none").alias("original_side"), F.when(k % 3 == 0, "LONG").alias("last_side"), prompt.alias("prompt"), F.lit(None).cast("string").alias("symbol"), "value",
    )
    return rv.cleanup_examples(rows, F.when(F.col("value") > 15, "high"), 60)


@query(f"""WITH RECURSIVE {EXAMPLES} SELECT id, label, position_side, repaired, flag_reason, 'symbol=MNQ 03-26' || chr(10) || 'position=' || position_side || chr(10) || 'last_side=' || coalesce(last, 'NONE') || chr(10) || split_part(prompt, chr(10), 3) || chr(10) || split_part(prompt, chr(10), 4) AS prompt FROM c""")
def cleanup_examples(spark, d):
    """Events as examples with a prompt each, repaired, written anew and flagged."""
    return cleaned(spark, d).select("id", "label", "position_side", "repaired", "flag_reason", "prompt")


@query(f"""WITH RECURSIVE {EXAMPLES}, t AS (SELECT 'input_examples' AS measure, '' AS name, count(*)::BIGINT AS n FROM c UNION ALL SELECT 'position_side_repaired', '', count(*) FILTER (repaired) FROM c UNION ALL SELECT 'prompts_rebuilt', '', count(*) FROM c
UNION ALL SELECT 'duplicates_removed', '', count(*) FILTER (flag_reason LIKE 'dup%') FROM c UNION ALL SELECT 'impossible_state_flagged', '', count(*) FILTER (flag_reason LIKE '%FLAT') FROM c UNION ALL SELECT 'advice_pattern_flagged', '', count(*) FILTER (flag_reason LIKE 'adv%') FROM c
UNION ALL SELECT 'output_clean', '', count(*) FILTER (flag_reason IS NULL) FROM c UNION ALL SELECT 'output_flagged', '', count(flag_reason) FROM c)
SELECT * FROM t UNION ALL SELECT CASE WHEN flag_reason IS NULL THEN 'clean_label' ELSE 'flagged_label' END, label, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'flag_reason', flag_reason, count(*) FROM c WHERE flag_reason IS NOT NULL GROUP BY ALL""")
def cleanup_report(spark, d):
    return rv.cleanup_report(cleaned(spark, d))


@query(f"""WITH t AS (SELECT conv_id AS file, turn AS line, role, text, coalesce(text, '') AS x FROM conversations), w AS (SELECT *, {texts.corrected('x')} AS p, lag(x, 2) OVER o AS a, lag(x) OVER o AS b, lead(x) OVER o AS c FROM t WINDOW o AS (PARTITION BY file ORDER BY line)),
f AS (SELECT *, CASE WHEN regexp_matches(p, '\\bwas\\b') THEN 'past' WHEN regexp_matches(p, '\\bfor\\b') THEN 'plan' WHEN regexp_matches(p, '\\b(?:de|der)\\b') THEN 'talk' END AS family FROM w),
k AS (SELECT *, concat_ws(' ', a, b) AS r0, concat_ws(' ', a, b, x, c) AS a0, concat_ws(' ', b, x) AS e0 FROM f WHERE family IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t AS q WHERE q.file = f.file AND q.role = 'system' AND (q.line = f.line OR (q.line % 2 = 0 AND abs(q.line - f.line) <= 1))) AND file % 7 <> 3
  QUALIFY row_number() OVER (PARTITION BY family ORDER BY file, line) <= 40),
n AS (SELECT file, line, family, CASE WHEN b IS NOT NULL THEN {texts.corrected('r0')} END AS recent_text, {texts.corrected('a0')} AS analysis_text, {texts.corrected('e0')} AS entry_text FROM k)
SELECT *, CASE WHEN regexp_matches(analysis_text, '\\bthe\\b') AND NOT regexp_matches(analysis_text, '\\bthat\\b') THEN 'LONG' WHEN regexp_matches(analysis_text, '\\bthat\\b') AND NOT regexp_matches(analysis_text, '\\bthe\\b') THEN 'SHORT' ELSE 'FLAT' END AS position_side FROM n""")
def mine_hard_negatives(spark, d):
    """Turns of a family with their context; system turns are reviewed, those in even places as actions, and some files are covered."""
    t = conv(spark, d).select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "role", "text")
    reviewed = t.filter("role = 'system'").select("file", "line", F.when(F.col("line") % 2 == 0, "TRIM").otherwise("NO_ACTION").alias("label"))
    families = {"past": [r"\bwas\b"], "plan": [r"\bfor\b"], "talk": [r"\b(?:de|der)\b"]}
    out = co.mine_hard_negatives(t.drop("role"), reviewed, t.filter("file % 7 = 3"), families, hints=(r"\bthe\b", r"\bthat\b"))
    return out.select("file", "line", "family", "recent_text", "analysis_text", "entry_text", "position_side")


@query(f"""WITH c AS (SELECT user_id AS file, event_id % 7 AS line, event_id % 2 AS ordinal, event_id AS row, CASE WHEN event_type = 'view' THEN 'ADD' ELSE {TAG} END AS raw, CASE WHEN value > 20 THEN 'LONG' END AS side FROM events),
l AS (SELECT *, CASE raw WHEN 'ADD' THEN 'ENTER_' || side ELSE raw END AS label FROM c), m AS (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY ordinal DESC, row DESC) AS rn FROM l WHERE label IS NOT NULL)
SELECT 'input' AS measure, ordinal::VARCHAR AS name, count(*)::BIGINT AS n FROM c GROUP BY ALL UNION ALL SELECT 'raw_label', raw, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'output_label', label, count(*) FROM m WHERE rn = 1 GROUP BY ALL
UNION ALL SELECT 'dropped', 'add_without_side', count(*) FROM l WHERE label IS NULL HAVING count(*) > 0 UNION ALL SELECT 'replaced_same_line_examples', '', count(*) FROM m WHERE rn > 1 UNION ALL SELECT 'exported_examples', '', count(*) FROM m WHERE rn = 1""")
def dataset_summary(spark, d):
    """Two corpora written as reviewed files, found by their folders (one named twice, one that isn't there), and counted."""
    path, k = scratch(spark, "corpora"), F.col("event_id")
    label, side = F.when(F.col("event_type") == "view", "ADD").otherwise(tag_of()), F.when(F.col("value") > 20, "LONG")
    rows = read(spark, d, "events").select(F.col("user_id").alias("file"), (k % 7).alias("line"), k.alias("row"), label.alias("label"), side.alias("side"))
    for part in (0, 1):
        rows.filter(F.col("row") % 2 == part).write.json(f"{path}/{part}/reviewed_examples.jsonl")
    found = co.resolve_inputs(spark, [f"{path}/0", f"{path}/1/reviewed_examples.jsonl", f"{path}/0/", f"{path}/2"])
    corpora = read_reviewed(spark, found, "file long, line long, row long, label string, side string").withColumnRenamed("input_ordinal", "ordinal")
    return co.dataset_summary(corpora.filter("_corrupt_record is null"), ["side"])
