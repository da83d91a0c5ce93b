"""Queries over the given tables, each beside its DuckDB equivalent.

Transcript roles: ``conversations`` (a file is a conversation, a line a turn), ``documents`` split at line breaks (numbered
lines of a file), ``events`` (a session is a user; event types stand for action tags).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetext.functions import text as tx
from livetext.operators import ordered as od
from livetext.operators import relational as rel

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def conv(spark, d) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def docs(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text", "lang", "source")


def lines(spark, d) -> DataFrame:
    """(file, line, text): blank lines are dropped but counted."""
    split = docs(spark, d).select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return split.select("file", (F.col("pos") + 1).cast("long").alias("line"), "text").filter(F.trim("text") != "")


LINES = "lines AS (SELECT doc_id AS file, i::BIGINT AS line, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(parts[i]) <> '')"


def events(spark, d) -> DataFrame:
    """Events with whole seconds ``sec``."""
    e = read(spark, d, "events")
    return e.select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), "event_type", "value", "props")


#: DuckDB's view of ``events`` above.
EV = "ev AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS sec, event_type, value, props FROM events)"

#: A surrogate lexicon for invented prose, in cascade order (group, pattern, tag).
LEXICON = [
    ("setup", r"\bis that\b", "SETUP"), ("historical", r"\bwas\b", "NO_ACTION"), ("hypothetical", r"\bfor\b", "NO_ACTION"), ("exit", r"\bby the\b", "EXIT_ALL"),
    ("trim", r"\bwith\b", "TRIM"), ("stop", r"\bat\b", "MOVE_STOP"), ("long", r"\bthe\b", "ENTER_LONG"), ("short", r"\bof\b", "ENTER_SHORT"),
]
GROUPS, TAGS = {g: [p] for g, p, _ in LEXICON}, {g: t for g, _, t in LEXICON}
ASCII = "[^a-z0-9 .]"
#: Lower-case ASCII words of a text, the same in both engines.
plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), "[^ -~]", "")), ASCII, " "), " +", " "))
PLAIN = "trim(regexp_replace(regexp_replace(lower(regexp_replace(replace({0}, chr(10), ' '), '[^ -~]', '', 'g')), '[^a-z0-9 .]', ' ', 'g'), ' +', ' ', 'g'))"
P = PLAIN.format("text")
CASCADE = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN '{t}'" for _, p, t in LEXICON) + " END"


# --- sources and text ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE WHEN o_orderkey % 4 = 2 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) ELSE DATE '2026-03-01' END AS file_date FROM orders")
def file_date(spark, d):
    from livetext.sources.transcripts import file_date as op

    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("a "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".txt"))).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "'x_'dd.MM.yy")).otherwise(F.lit("none.txt"))
    return read(spark, d, "orders").select("o_orderkey", op(name, "2026-03-01").alias("file_date"))


@query(f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY file, text ORDER BY line) AS rn, max(line) OVER (PARTITION BY file, text) AS last_line FROM lines) SELECT file, line, text, last_line FROM r WHERE rn = 1")
def dedupe_caption_lines(spark, d):
    return lines(spark, d).groupBy("file", "text").agg(F.min("line").alias("line"), F.max("line").alias("last_line"))


KEYWORDS = ["trim", "add", "flat", "ther", "tion", "stop"]


@query("SELECT conv_id, turn FROM conversations WHERE " + " OR ".join(f"contains(lower(text), '{k}')" for k in KEYWORDS))
def keyword_gate(spark, d):
    return conv(spark, d).filter(tx.keyword_gate(F.col("text"), KEYWORDS)).select("conv_id", "turn")


@query(f"WITH t AS (SELECT conv_id, turn, {P} AS p FROM conversations) SELECT conv_id, turn, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(p, '{p}') THEN '{g}' END" for g, p, _ in LEXICON) + ") AS groups FROM t")
def match_rules(spark, d):
    return conv(spark, d).select("conv_id", "turn", F.array_join(tx.match_rules(plain(F.col("text")), GROUPS), ",").alias("groups"))


BASE = {"signup": 0.82, "purchase": 0.82, "click": 0.74, "error": 0.9, "view": 0.5}


@query(f"WITH t AS (SELECT conv_id, turn, {P} AS p FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(p, '\\bwas\\b') AND NOT regexp_matches(p, '\\bwith\\b') THEN 'LONG' WHEN regexp_matches(p, '\\bwith\\b') AND NOT regexp_matches(p, '\\bwas\\b') THEN 'SHORT' END AS side FROM t")
def side_hint(spark, d):
    return conv(spark, d).select("conv_id", "turn", tx.side_hint(plain(F.col("text")), r"\bwas\b", r"\bwith\b").alias("side"))


@query("SELECT conv_id, turn, concat_ws(chr(10), 'role=' || role, CASE WHEN turn > 0 THEN 'line=' || turn::VARCHAR END, CASE WHEN text <> '' THEN 'current=' || text END) AS prompt FROM conversations")
def render_context(spark, d):
    return conv(spark, d).select("conv_id", "turn", tx.render_context(role=F.col("role"), line=F.when(F.col("turn") > 0, F.col("turn").cast("string")), current=F.col("text")).alias("prompt"))


ALIASES = {"SIGNUP": "ENTER_LONG", "PURCHASE": "ENTER_SHORT", "CLICK": "TRIM", "ERROR": "EXIT_ALL"}
TAG = "CASE event_type WHEN 'signup' THEN 'ENTER_LONG' WHEN 'purchase' THEN 'ENTER_SHORT' WHEN 'click' THEN 'TRIM' WHEN 'error' THEN 'EXIT_ALL' ELSE 'NO_ACTION' END"


def tag_of(c="event_type"):
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[F.upper(c)], F.lit("NO_ACTION"))


@query("SELECT event_id, sha256(concat_ws('|', event_type, user_id::VARCHAR, coalesce(props, '')))[:16] AS id FROM events")
def stable_key(spark, d):
    return read(spark, d, "events").select("event_id", tx.stable_key(F.col("event_type"), F.col("user_id"), F.col("props"), size=16).alias("id"))


# --- joins --------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT file, line, toxic FROM lines LEFT JOIN labels ON labels.doc_id = lines.file")
def attach_labels(spark, d):
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("file"), "toxic")
    return rel.attach_labels(lines(spark, d), labels, ["file"]).select("file", "line", "toxic")


@query("SELECT e.event_id, e.user_id FROM events e WHERE e.event_type = 'click' AND e.user_id NOT IN (SELECT user_id FROM events WHERE value > 400 AND user_id IS NOT NULL)")
def exclude_covered(spark, d):
    e = read(spark, d, "events").withColumnRenamed("user_id", "file")
    return rel.exclude_covered(e.filter("event_type = 'click'"), e.filter("value > 400")).select("event_id", F.col("file").alias("user_id"))


@query("SELECT conv_id AS file, turn AS line FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn = c.turn AND r.role = 'system')")
def exclude_reviewed(spark, d):
    c = conv(spark, d).select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "role")
    return rel.exclude_reviewed(c, c.filter("role = 'system'")).select("file", "line")


@query("SELECT conv_id AS file, turn AS line FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND abs(r.turn - c.turn) <= 1 AND r.role = 'system')")
def guard_neighbours(spark, d):
    c = conv(spark, d).select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "role")
    return rel.guard_neighbours(c, c.filter("role = 'system'")).select("file", "line")


@query("""WITH j AS (SELECT l.conv_id AS file, l.turn AS "at", r.turn AS line, length(r.text)::BIGINT AS score, row_number() OVER (PARTITION BY l.conv_id, l.turn ORDER BY length(r.text) DESC, abs(r.turn - l.turn), r.turn) AS rn
FROM conversations l JOIN conversations r ON r.conv_id = l.conv_id AND abs(r.turn - l.turn) <= 2 WHERE l.role = 'assistant') SELECT file, "at", line, score FROM j WHERE rn = 1""")
def align_labels(spark, d):
    c = conv(spark, d).select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "role", "text")
    return rel.align_labels(c.filter("role = 'assistant'").select("file", "line"), c.select("file", "line", "text"), F.length("text").cast("long"), 2)


@query("SELECT user_id, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'reviewed' ELSE event_type END AS event_type FROM events WHERE value > 20")
def merge_review_state(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "event_type", "value")
    earlier = e.filter("id % 3 = 0").select("id", F.lit("reviewed").alias("event_type"))
    return rel.merge_review_state(e.filter("value > 20").drop("value"), earlier, ["event_type"])


@query(f"WITH {EV}, q AS (SELECT user_id, sec, arg_max(value, event_id) AS value FROM ev WHERE event_type = 'view' GROUP BY ALL) SELECT e.user_id, e.event_id AS id, q.value FROM (SELECT * FROM ev WHERE event_type = 'purchase') e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.sec >= q.sec")
def asof_state(spark, d):
    e = events(spark, d)
    quotes = e.filter("event_type = 'view'").groupBy("user_id", "sec").agg(F.max_by("value", "event_id").alias("value"))
    return rel.asof_state(e.filter("event_type = 'purchase'").select("user_id", "sec", F.col("event_id").alias("id")), quotes, "user_id", "sec", "value")


@query("""SELECT v.vec_id, round(max(least(1, greatest(0, list_dot_product(v.embedding::DOUBLE[], c.embedding::DOUBLE[]) / ((sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + 1e-9) * (sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) + 1e-9))))), 6) AS best
FROM embeddings v, (SELECT arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) c GROUP BY v.vec_id HAVING best >= 0.4""")
def similarity_gate(spark, d):
    v = read(spark, d, "embeddings")
    canon = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))  # the first vector of each label
    return rel.similarity_gate(v, canon).select("vec_id", F.round("best", 6).alias("best"))


@query(f"WITH t AS (SELECT conv_id, turn, {P} AS p FROM conversations), r(name, pattern) AS (VALUES " + ", ".join(f"('{g}', '{p}')" for g, p, _ in LEXICON) + ") SELECT name, count(*)::BIGINT AS n FROM t, r WHERE regexp_matches(p, pattern) GROUP BY name")
def rule_join(spark, d):
    rules = spark.createDataFrame([(g, p) for g, p, _ in LEXICON], "name string, pattern string")  # a fixed list
    t = conv(spark, d).select(plain(F.col("text")).alias("p"))
    return t.join(F.broadcast(rules), F.expr("p rlike pattern")).groupBy("name").agg(F.count("*").alias("n"))


# --- aggregates and evaluation --------------------------------------------------------------------------------


@query("SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def label_counts(spark, d):
    return docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))


PRED = "(quality + doc_id) % 2"


@query(f"WITH r AS (SELECT toxic AS y, ({PRED})::INTEGER AS p FROM labels), g(y, p) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) SELECT g.y, g.p, count(r.y)::BIGINT AS n FROM g LEFT JOIN r USING (y, p) GROUP BY ALL")
def confusion_matrix(spark, d):
    r = read(spark, d, "labels").select(F.col("toxic").alias("y"), F.expr(PRED).cast("int").alias("p"))
    return rel.confusion_matrix(r, [0, 1])


SCORES = "s AS (SELECT label, ((vec_id * 7919) % 997) / 997.0 AS score, (vec_id % 3 = label % 3) AS hit FROM embeddings)"


@query(f"""WITH {SCORES}, g AS (SELECT unnest(range(0, 31)) AS k), c AS (SELECT label, k, sum(hit::INTEGER) AS pos, sum((hit AND round((score - 0.30) / 0.02, 6) >= k)::INTEGER) AS tp, sum((round((score - 0.30) / 0.02, 6) >= k)::INTEGER) AS n FROM s, g GROUP BY ALL),
f AS (SELECT label, k, round(2 * tp / greatest(n + pos, 1), 9) AS f1 FROM c) SELECT label, round(0.30 + 0.02 * k, 2) AS threshold, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, k) = 1""")
def calibrate_thresholds(spark, d):
    s = read(spark, d, "embeddings").select("label", (((F.col("vec_id") * 7919) % 997) / 997.0).alias("score"), (F.col("vec_id") % 3 == F.col("label") % 3).alias("hit"))
    return rel.calibrate_thresholds(s)


@query("SELECT lang, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight FROM documents GROUP BY lang")
def class_weights(spark, d):
    return rel.class_weights(docs(spark, d), "lang")


# --- windows and folds ----------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, string_agg(role, ' | ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS context FROM conversations")
def context_window(spark, d):
    return od.context_window(conv(spark, d), "conv_id", "turn", "role", -2, 1, "context").select("conv_id", "turn", "context")


@query(f"WITH {EV} SELECT event_id, coalesce(sec - last_value(CASE WHEN event_type = 'click' THEN sec END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3600, false) AS guarded FROM ev")
def entry_guard(spark, d):
    return od.recent_cue(events(spark, d), "user_id", ["sec", "event_id"], F.col("event_type") == "click", "sec", 3600, "guarded").select("event_id", "guarded")


FOLD = """WITH RECURSIVE r AS ({rows}), f AS (SELECT k, rn, t, id, t AS last, true AS keep FROM r WHERE rn = 1
UNION ALL SELECT r.k, r.rn, r.t, r.id, CASE WHEN r.t - f.last > {reach} THEN r.t ELSE f.last END, r.t - f.last > {reach} FROM f JOIN r ON r.k = f.k AND r.rn = f.rn + 1)
SELECT {out} FROM f WHERE keep"""


@query(FOLD.format(rows="SELECT conv_id::VARCHAR || role AS k, turn AS t, conv_id * 100000 + turn AS id, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations", reach=3, out="id // 100000 AS conv_id, id % 100000 AS turn"))
def dedupe_near(spark, d):
    c = conv(spark, d).withColumn("id", F.col("conv_id") * 100000 + F.col("turn"))
    return od.greedy_keep(c, ["conv_id", "role"], "turn", "id", 3).select("conv_id", (F.col("id") % 100000).alias("turn"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'view') DESC, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END DESC, value DESC, event_id) = 1")
def collapse_reviews(spark, d):
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return rel.first_by(read(spark, d, "events"), ["user_id"], [F.desc(F.col("event_type") != "view"), F.desc(rank), F.desc("value"), "event_id"]).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 25")
def last_n(spark, d):
    return rel.first_by(read(spark, d, "events"), ["user_id"], [F.desc("event_id")], 25).select("user_id", "event_id")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value FROM events), n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), g AS (SELECT user_id, n, unnest(range(0, greatest(1, floor(n * 0.5))::BIGINT)) AS j FROM n),
x AS (SELECT *, j / 0.5 AS x, least(floor(j / 0.5), n - 1)::BIGINT AS i, least(least(floor(j / 0.5), n - 1) + 1, n - 1)::BIGINT AS i2 FROM g)
SELECT x.user_id, x.j::BIGINT AS j, round(a.value + (b.value - a.value) * (x.x - x.i), 6) AS value FROM x JOIN s a ON a.user_id = x.user_id AND a.i = x.i JOIN s b ON b.user_id = x.user_id AND b.i = x.i2""")
def resample_series(spark, d):
    from pyspark.sql import Window

    s = read(spark, d, "events").withColumn("i", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    return od.resample_series(s, "user_id", "i", "value", 0.5)


@query(f"""WITH {EV}, s AS (SELECT user_id, sec, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) <= 21600 THEN 0 ELSE 1 END AS n, event_id FROM ev), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, count(*)::BIGINT AS n, (max(sec) - min(sec))::BIGINT AS seconds, min(event_id) AS first_event FROM g GROUP BY user_id, k""")
def sessionize_gap(spark, d):
    """Runs of a user's events without a gap longer than six hours: one of exactly six hours goes on."""
    s = events(spark, d).withColumn("at", F.timestamp_seconds("sec"))
    g = s.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("n"), (F.max("sec") - F.min("sec")).alias("seconds"), F.min("event_id").alias("first_event"))
    return g.select("user_id", "n", "seconds", "first_event")


# --- samples, splits, sets ------------------------------------------------------------------------------------


@query("SELECT doc_id FROM labels ORDER BY sha256(doc_id::VARCHAR) LIMIT 100")
def stable_sample(spark, d):
    return rel.stable_sample(read(spark, d, "labels"), F.col("doc_id").cast("string"), 100).select("doc_id")


@query("WITH p AS (SELECT greatest(1, least(6000, round(sum((toxic = 1)::INTEGER) * 2.0)))::BIGINT AS b FROM labels), n AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR)) AS rn FROM labels WHERE toxic = 0) SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, toxic FROM n, p WHERE rn <= b")
def rebalance(spark, d):
    return rel.rebalance(read(spark, d, "labels").select("doc_id", "toxic"), F.col("toxic") == 0, 2.0, F.col("doc_id").cast("string"))


@query("WITH f AS (SELECT DISTINCT conv_id AS file FROM conversations), r AS (SELECT file, row_number() OVER (ORDER BY sha256(file::VARCHAR)) AS rn, count(*) OVER () AS n FROM f) SELECT file, floor((rn - 1) / ceil(n / 5))::INTEGER AS fold FROM r")
def assign_folds(spark, d):
    return rel.assign_folds(conv(spark, d).select(F.col("conv_id").alias("file")), 5)


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 10")
def top_k_per_group(spark, d):
    return rel.first_by(read(spark, d, "events"), ["event_type"], [F.desc("value"), "event_id"], 10).select("event_type", "event_id")


@query("SELECT event_type, user_id, event_id FROM events WHERE value > 10 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) <= 40")
def cap_per_family(spark, d):
    return rel.first_by(read(spark, d, "events").filter("value > 10"), ["event_type"], ["user_id", "event_id"], 40).select("event_type", "user_id", "event_id")


@query("SELECT user_id, max(event_id) AS last_event FROM events GROUP BY user_id")
def list_sessions(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last_event")).orderBy(F.desc("last_event"))


@query("WITH c AS (SELECT user_id AS file, event_id % 7 AS line, event_id % 3 AS ordinal, event_id AS row FROM events) SELECT file, line, ordinal, row FROM c QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY ordinal DESC, row DESC) = 1")
def merge_corpora(spark, d):
    c = read(spark, d, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 7).alias("line"), (F.col("event_id") % 3).alias("ordinal"), F.col("event_id").alias("row"))
    return rel.merge_corpora(c)


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value > 50) DESC, event_id) = 1")
def dedupe_examples(spark, d):
    return rel.first_by(read(spark, d, "events"), ["user_id", "event_type"], [F.desc(F.col("value") > 50), "event_id"]).select("event_id")


@query("SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents WHERE lang = 'xx'")
def distinct_files(spark, d):
    return docs(spark, d).select("source").distinct().exceptAll(docs(spark, d).filter("lang = 'xx'").select("source").distinct())


# --- risk and positions ---------------------------------------------------------------------------------------
