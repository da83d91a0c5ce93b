"""Queries on evaluation, reports and splits, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from livetext.operators import evaluation as ev
from livetext.operators import ordered as od
from livetext.plans.queries import CASCADE, GROUPS, TAGS, P, conv, docs, plain, query, read
from livetext.functions import text as tx

KINDS = ["view", "click", "purchase", "signup", "error"]
GUESS = "CASE WHEN value > 80 THEN 'purchase' WHEN value > 40 THEN 'click' WHEN event_id % 4 = 0 THEN 'error' ELSE 'view' END"
SCORED = f"r AS (SELECT event_type AS y, {GUESS} AS p, user_id % 5 AS fold, user_id, event_id, value FROM events)"


def scored(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("y"), F.expr(GUESS).alias("p"), (F.col("user_id") % 5).alias("fold"), "user_id", "event_id", "value")


LABELLED = "l(label) AS (VALUES " + ", ".join(f"('{k}')" for k in KINDS) + ")"


def per_label(by: str) -> str:
    return f"""s AS (SELECT {by} label, sum((y = label)::INTEGER) AS t, sum((p = label)::INTEGER) AS pp, sum((y = label AND p = label)::INTEGER) AS tp FROM r, l GROUP BY ALL),
m AS (SELECT *, tp / greatest(pp, 1) AS pr, tp / greatest(t, 1) AS re FROM s), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)"""


def overall(by: str, on: str) -> str:
    return f"""c AS (SELECT {by} count(*) AS n, sum((y = p)::INTEGER) AS same, sum((y <> 'view' AND p <> 'view')::INTEGER) AS tp, sum((y = 'view' AND p <> 'view')::INTEGER) AS fp, sum((y <> 'view' AND p = 'view')::INTEGER) AS fn FROM r GROUP BY ALL),
a AS (SELECT {by} sum(f1) / {len(KINDS)} AS macro FROM f GROUP BY ALL), o AS (SELECT *, tp / greatest(1, tp + fp) AS ap, tp / greatest(1, tp + fn) AS ar FROM c JOIN a {on}),
metrics AS (SELECT {by} round(same / greatest(1, n), 4) AS accuracy, round(macro, 4) AS macro_f1, round(ap, 4) AS action_precision, round(ar, 4) AS action_recall, round(CASE WHEN ap + ar > 0 THEN 2 * ap * ar / (ap + ar) ELSE 0 END, 4) AS action_f1 FROM o)"""


@query(f"WITH {SCORED}, {LABELLED}, {per_label('')}, {overall('', 'ON true')} SELECT label, round(pr, 4) AS precision, round(re, 4) AS recall, round(f1, 4) AS f1, t::BIGINT AS support, metrics.* FROM f, metrics")
def classification_metrics(spark, d):
    """Metrics of each label beside those of all rows."""
    one = ev.overall_metrics(scored(spark, d), KINDS, "view")
    return ev.classification_metrics(scored(spark, d), KINDS).join(F.broadcast(one))  # one row


@query(f"""WITH {SCORED}, {LABELLED}, {per_label('fold,')}, {overall('fold,', 'USING (fold)')}, u AS (UNPIVOT metrics ON COLUMNS(* EXCLUDE fold) INTO NAME metric VALUE v),
w AS (SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*)::BIGINT AS folds FROM u GROUP BY metric),
z AS (UNPIVOT (WITH {per_label('')}, {overall('', 'ON true')} SELECT * FROM metrics) ON COLUMNS(*) INTO NAME metric VALUE pooled) SELECT metric, mean, std, pooled, folds FROM w JOIN z USING (metric)""")
def cv_summary(spark, d):
    return ev.cv_summary(scored(spark, d), KINDS, "view")


WEIGHT = "CASE WHEN event_type = 'view' THEN 1.0 WHEN event_type = 'purchase' THEN 3.0 WHEN event_type = 'signup' THEN 2.0 ELSE 1.0 END"


@query(f"WITH w AS (SELECT event_type, {WEIGHT} AS raw, avg({WEIGHT}) OVER () AS mean, sum({WEIGHT}) OVER () AS total FROM events) SELECT event_type, round(any_value(raw / mean), 6) AS weight, round(sum(raw) / any_value(total), 4) AS share FROM w GROUP BY 1")
def sample_weights(spark, d):
    weighted = ev.sample_weights(read(spark, d, "events"), {"view": 9.0, "purchase": 3.0, "signup": 2.0}, "event_type", "event_type", "view")
    by = weighted.groupBy("event_type").agg(F.round(F.first("weight"), 6).alias("weight"), F.sum("weight").alias("w"), F.count("*").alias("n"))
    # the weights have mean 1, so their sum is the number of rows
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("event_type", "weight", F.round(F.col("w") / F.col("total"), 4).alias("share"))


WORDS = r"regexp_extract_all(lower(text), '[\pL\pN_\pM]{2,}')"


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT doc_id, list_distinct(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM w), t AS (SELECT unnest(g) AS term FROM g)
SELECT term, count(*)::BIGINT AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM t GROUP BY term ORDER BY df DESC, term LIMIT 2000""")
def tfidf_stats(spark, d):
    return ev.tfidf_stats(docs(spark, d), "text", 2000)


@query(f"""WITH {SCORED}, c AS (SELECT y || ' -> ' || p AS pattern, event_id FROM r WHERE y <> p)
SELECT pattern, count(*)::BIGINT AS n, array_to_string(list(event_id ORDER BY event_id)[:3], ',') AS examples FROM c GROUP BY 1 ORDER BY n DESC, pattern LIMIT 20""")
def error_patterns(spark, d):
    return ev.error_patterns(scored(spark, d), "y", "p", "event_id").withColumn("examples", F.array_join("examples", ","))


@query("""WITH f AS (SELECT event_type AS model, user_id % 5 AS fold, avg(value) AS v FROM events GROUP BY ALL), d AS (SELECT x.model AS a, y.model AS b, x.v - y.v AS d FROM f x JOIN f y USING (fold) WHERE x.model < y.model),
g AS (SELECT a, b, avg(d) AS m, stddev_samp(d) AS s, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT *, m / (s / sqrt(n)) AS t FROM g),
q AS (SELECT *, abs(t) / 2 AS h, atan(abs(t) / 2) AS th FROM t)
SELECT a AS model_a, b AS model_b, round(m, 4) AS mean_difference, round(t, 4) AS t_statistic, round(1 - (sin(th) + 0.5 * sin(th) * cos(th) * cos(th)), 4) AS p_value,
round(m - 2.7764451051977987 * s / sqrt(n), 4) AS ci_lower, round(m + 2.7764451051977987 * s / sqrt(n), 4) AS ci_upper, 1 - (sin(th) + 0.5 * sin(th) * cos(th) * cos(th)) < 0.05 AS significant, n::BIGINT AS n_folds FROM q""")
def paired_t_test(spark, d):
    """Five folds: with four degrees of freedom p is 1 - sin(a)(1 + cos(a)^2 / 2) for tan(a) = t / 2, as the SQL has it."""
    f = read(spark, d, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("value"))
    return ev.paired_t(f)


@query(f"""WITH t AS (SELECT conv_id, turn, coalesce({CASCADE.format(P)}, 'NONE') AS tag, regexp_matches(lower(text), '\\bthe th[a-z]*\\b') AS bad FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM t),
c AS (SELECT conv_id, string_agg(tag || '=' || n, ',' ORDER BY tag) AS counts FROM (SELECT conv_id, tag, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1)
SELECT conv_id, count(*)::BIGINT AS intents, any_value(counts) AS counts, string_agg(tag, ',' ORDER BY turn) FILTER (rn <= 5) AS first_hits, sum(bad::INTEGER)::BIGINT AS n_suspicious,
coalesce(array_to_string((list(tag ORDER BY turn) FILTER (bad))[:5], ','), '') AS suspicious FROM n JOIN c USING (conv_id) GROUP BY conv_id""")
def file_report(spark, d):
    c = conv(spark, d)
    tag = F.coalesce(tx.detect_signal(plain(F.col("text")), GROUPS, TAGS), F.lit("NONE"))
    found = ev.file_report(c.withColumn("tag", tag), "conv_id", "turn", "tag", F.lower("text").rlike(r"\bthe th[a-z]*\b"))
    counts = F.array_join(F.transform("counts", lambda x: F.concat(x["tag"], F.lit("="), x["n"].cast("string"))), ",")
    return found.select("conv_id", "intents", counts.alias("counts"), F.array_join("first_hits", ",").alias("first_hits"), "n_suspicious", F.array_join("suspicious", ",").alias("suspicious"))


@query("""WITH r AS (SELECT user_id, user_id % 7 AS grp, event_type AS label, count(*) AS n FROM events GROUP BY ALL), h AS (SELECT DISTINCT user_id, grp, CASE WHEN user_id % 3 = 0 THEN 'm' || user_id END AS model FROM r),
s AS (SELECT grp, label, sum(n) AS n FROM r GROUP BY ALL) SELECT h.grp AS batch, h.model, h.files, s.counts, s.example_count FROM (SELECT grp, arg_min(model, user_id) FILTER (model IS NOT NULL) AS model, count(*)::BIGINT AS files FROM h GROUP BY grp) h
JOIN (SELECT grp, string_agg(label || '=' || n, ',' ORDER BY label) AS counts, sum(n)::BIGINT AS example_count FROM s GROUP BY grp) s USING (grp)""")
def aggregate_reports(spark, d):
    each = read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    reports = each.groupBy("user_id").agg(F.collect_list(F.struct("label", "n")).alias("counts"))
    reports = reports.select("user_id", (F.col("user_id") % 7).alias("batch"), F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("m"), F.col("user_id").cast("string"))).alias("model"), "counts")
    found = ev.aggregate_reports(reports, ["batch"], "user_id", ["model"], "counts")
    return found.withColumn("counts", F.array_join(F.transform("counts", lambda x: F.concat(x["label"], F.lit("="), x["n"].cast("string"))), ","))


@query("""WITH c AS (SELECT conv_id, turn // 3 AS chunk, bool_or(role = 'system') AS bad FROM conversations GROUP BY ALL)
SELECT conv_id AS file, count(*)::BIGINT AS total_rows, (SELECT count(*) FROM c WHERE c.conv_id = v.conv_id)::BIGINT AS chunk_count, sum((role = 'assistant')::INTEGER)::BIGINT AS annotations,
coalesce((SELECT string_agg('chunk ' || chunk || ': system', '; ' ORDER BY chunk) FROM c WHERE c.conv_id = v.conv_id AND bad), '') AS errors FROM conversations v GROUP BY conv_id""")
def annotation_report(spark, d):
    c = conv(spark, d).select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.floor(F.col("turn") / 3).alias("chunk"), "role")
    results = c.groupBy("file", "chunk").agg(F.max(F.when(F.col("role") == "system", "system")).alias("error"))
    return ev.annotation_report(c, c, c.filter("role = 'assistant'"), results).withColumn("errors", F.array_join("errors", "; "))


def splitted(order: str, again: str) -> str:
    """Test: 8 files; validation: 15 % of the others (which both come first by action)."""
    return f"""f AS (SELECT conv_id, max((role = 'system')::INTEGER) AS act, max(turn) AS day FROM conversations GROUP BY 1), n AS (SELECT count(*) AS n, sum(act) AS a FROM f),
k AS (SELECT least(least(8, greatest(0, n - 2)), CASE WHEN a > 0 THEN a ELSE n END) AS k, n FROM n), t AS (SELECT conv_id FROM f QUALIFY row_number() OVER (ORDER BY act DESC, {order}) <= (SELECT k FROM k)),
r AS (SELECT * FROM f ANTI JOIN t USING (conv_id)), v AS (SELECT conv_id FROM r QUALIFY row_number() OVER (ORDER BY {again}, {order}) <= (SELECT greatest(1, least(round_even((n - k) * 0.15, 0), n - k - 1)) FROM k)),
s AS (SELECT conv_id, CASE WHEN conv_id IN (FROM t) THEN 'test' WHEN conv_id IN (FROM v) THEN 'validation' ELSE 'train' END AS split FROM f)"""


BY_HASH, BY_DATE = splitted("sha256(conv_id::VARCHAR)", "act DESC"), splitted("day DESC, conv_id DESC", "act")


@query(f"WITH h AS (WITH {BY_HASH} SELECT * FROM s), d AS (WITH {BY_DATE} SELECT * FROM s) SELECT h.conv_id, h.split AS by_hash, d.split AS by_date FROM h JOIN d USING (conv_id)")
def split_by_group(spark, d):
    """Files by hash and by date; the last turn stands for a date."""
    args = (conv(spark, d), "conv_id", F.col("role") == "system")
    by_hash = ev.split_by_group(*args, None, 8, 0.15).withColumnRenamed("split", "by_hash")
    return by_hash.join(ev.split_by_group(*args, F.col("turn"), 8, 0.15).withColumnRenamed("split", "by_date"), "conv_id")


@query(f"WITH {BY_HASH} SELECT split, count(DISTINCT conv_id)::BIGINT AS files, count(*)::BIGINT AS n FROM conversations JOIN s USING (conv_id) GROUP BY split")
def split_summary(spark, d):
    c = conv(spark, d)
    return ev.split_summary(c, ev.split_by_group(c, "conv_id", F.col("role") == "system", None, 8, 0.15), "conv_id")


@query("SELECT conv_id AS file, count(*)::BIGINT AS lines, count(*)::BIGINT AS covered, greatest(1, ceil((count(*) - 1) / 3.0))::BIGINT AS chunks FROM conversations GROUP BY conv_id")
def coverage_report(spark, d):
    """Chunks of four lines that share one cover every line."""
    numbered = conv(spark, d).select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line"))
    return ev.coverage_report(numbered, od.chunk_lines(numbered, "file", 4, 1))
