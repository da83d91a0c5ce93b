"""Queries on text functions and transcript files: whole texts of the given tables, each beside its DuckDB equivalent."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from livetext.functions import text as tx
from livetext.operators import cascade
from livetext.operators import labels as lb
from livetext.operators import ordered as od
from livetext.plans.queries import CASCADE, EV, GROUPS, TAGS, P, conv, docs, events, plain, query, read
from livetext.sources import transcripts as src

#: DuckDB's class for Java's (?U)\s, and what is no letter, number, underscore or white space.
WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def other(keep: str) -> str:
    return rf"[^\pL\pN_{WS}{keep}]"


def corrected(x: str) -> str:
    """The corrections in DuckDB: commas twice for overlapping digits, and the last rule's look-ahead as a group."""
    out = f"replace(lower({x}), '’', '''')"
    for _ in range(2):
        out = f"regexp_replace({out}, '([0-9]),([0-9])', '\\1\\2', 'g')"
    for pattern, new in tx.ASR_RULES[:-1]:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"regexp_replace({out}, '\\bpeace(\\s+(?:on|here|there|at|versus|long|short)\\b)', 'piece\\1', 'g')"


NORMAL = squeezed(f"regexp_replace(regexp_replace(replace({corrected('text')}, '-', ' '), '\\bpoint of\\b', 'point', 'g'), '{other('.')}', ' ', 'g')")


@query(f"SELECT doc_id, {corrected('text')} AS text FROM documents")
def asr_correct(spark, d):
    return docs(spark, d).select("doc_id", tx.asr_correct(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {NORMAL} AS text FROM documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


REVIEW, FALLBACK = f"regexp_replace(replace(lower(text), 'vwop', 'vwap'), '{other(chr(39) * 2)}', ' ', 'g')", f"regexp_replace(lower(text), '{other('.')}', ' ', 'g')"


@query(f"""SELECT conv_id, turn, {squeezed(REVIEW)} AS review, {squeezed(FALLBACK)} AS fallback,
trim(regexp_replace(upper(replace(trim(text), 'ß', 'SS')), '[^A-Z0-9]+', '_', 'g'), '_') AS label FROM conversations""")
def normalize_variant(spark, d):
    kinds = [tx.normalize_variant(F.col("text"), k).alias(k) for k in ("review", "fallback", "label")]
    return conv(spark, d).select("conv_id", "turn", *kinds)


#: What starts at each & is a reference or plain text; each reference is decoded once, by the rules of HTML 5.
TOKEN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def sql_text(x: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in x) or "''"


def sql_names(names) -> str:
    return ", ".join(f"('{n}', {sql_text(html5[n])})" for n in names)


#: Names that count without a semicolon too, also as the start of a longer name; the longest first.
LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Numbers that mean another character: the C1 range as in Windows-1252. Those of no character come out empty, those out of range as a mark.
MEANT = {128: 8364, 130: 8218, 131: 402, 132: 8222, 133: 8230, 134: 8224, 135: 8225, 136: 710, 137: 8240, 138: 352, 139: 8249, 140: 338, 142: 381, 145: 8216, 146: 8217, 147: 8220, 148: 8221, 149: 8226, 150: 8211, 151: 8212, 152: 732, 153: 8482, 154: 353, 155: 8250, 156: 339, 158: 382, 159: 376}
NUMBER = f"""CASE WHEN n IS NULL THEN NULL WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533)
WHEN n IN ({", ".join(map(str, MEANT))}) THEN chr(CASE n {" ".join(f"WHEN {k} THEN {v}" for k, v in MEANT.items())} END) WHEN n IN (129, 141, 143, 144, 157, 13) THEN chr(n)
WHEN n BETWEEN 1 AND 8 OR n IN (11) OR n BETWEEN 14 AND 31 OR n BETWEEN 127 AND 159 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n) END"""
DECODED = f"""names(name, meant) AS (VALUES {sql_names(html5)}), p AS (SELECT row_number() OVER () AS r, page_id, html FROM pages),
l AS (SELECT r, regexp_extract_all(html, '{TOKEN}|[^&]+|&') AS l FROM p), t AS (SELECT r, unnest(l) AS token, unnest(range(1, len(l) + 1)) AS i FROM l),
f AS (SELECT DISTINCT token, regexp_extract(token, '^&({"|".join(LEGACY)})', 1) AS legacy, CASE WHEN token LIKE '&#%' THEN ltrim(rtrim(substr(token, CASE WHEN lower(substr(token, 3, 1)) = 'x' THEN 4 ELSE 3 END), ';'), '0') END AS digits FROM t WHERE token LIKE '&_%'),
c AS (SELECT token, legacy, (CASE WHEN digits IS NULL THEN NULL WHEN digits = '' THEN 0 WHEN length(digits) > 8 THEN 99999999 WHEN lower(substr(token, 3, 1)) = 'x' THEN ('0x' || digits)::BIGINT ELSE digits::BIGINT END)::INTEGER AS n FROM f),
v AS (SELECT token, coalesce({NUMBER}, whole.meant, part.meant || substr(token, length(legacy) + 2), token) AS meant FROM c LEFT JOIN names AS whole ON whole.name = substr(token, 2) LEFT JOIN names AS part ON part.name = legacy),
u AS (SELECT r, string_agg(coalesce(meant, token), '' ORDER BY i) AS html FROM t LEFT JOIN v USING (token) GROUP BY r),
decoded AS (SELECT page_id, coalesce(u.html, left(p.html, 0)) AS html FROM p LEFT JOIN u USING (r))"""
STRIPPED = "regexp_replace(translate(html, chr(8203) || chr(65279), '  '), '<[^>]+>', '', 'g')"


@query(f"WITH {DECODED} SELECT page_id, {squeezed(STRIPPED)} AS text FROM decoded")
def clean_markup(spark, d):
    """Pages with every character reference decoded, also those that end without a semicolon, and without tags."""
    return read(spark, d, "pages").select("page_id", tx.clean_markup(F.col("html")).alias("text"))


def same_later(size: int, times: int) -> str:
    """Words that equal the word ``size`` later."""
    return f"SELECT doc_id, i, {size} AS size, {size * (times - 1)} AS need, x = lead(x, {size}) OVER (PARTITION BY doc_id ORDER BY i) AS same FROM u"


SAME = " UNION ALL ".join(same_later(*x) for x in ((1, 5), (2, 4), (3, 3), (4, 3)))


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[{WS}]+'), lambda x: x <> '') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), e AS ({SAME}),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, size ORDER BY i) AS g FROM e), r AS (SELECT doc_id, count(*) >= any_value(need) AS hit FROM g WHERE same GROUP BY doc_id, size, g),
t AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, x, count(*) AS c FROM u GROUP BY ALL) GROUP BY 1), h AS (SELECT doc_id, bool_or(hit) AS hit FROM r GROUP BY 1)
SELECT doc_id, len(w) >= 10 AND (coalesce(top, 0) >= 0.55 * len(w) OR coalesce(hit, false)) AS degenerate FROM w LEFT JOIN t USING (doc_id) LEFT JOIN h USING (doc_id)""")
def degenerate_text(spark, d):
    return docs(spark, d).select("doc_id", tx.degenerate_text(F.col("text")).alias("degenerate"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda x: x <> '')[-48:], ' ') AS text FROM conversations")
def clip_words(spark, d):
    return conv(spark, d).select("conv_id", "turn", tx.clip_words(F.col("text")).alias("text"))


@query(f"""WITH {EV}, t AS (SELECT event_id, sec AS a, sec + floor(value)::BIGINT % 7 - 1 AS b, sec + floor(value)::BIGINT % 11 - 2 AS c FROM ev)
SELECT event_id, greatest(0, (b - a) * 1000)::BIGINT AS speech_capture_ms, greatest(0, (c - b) * 1000)::BIGINT AS processing_ms,
greatest(0, (c - a) * 1000)::BIGINT AS total_latency_ms FROM t""")
def latency_metrics(spark, d):
    step = F.floor("value").cast("long")
    e = events(spark, d).select("event_id", tx.latency_metrics(F.col("sec"), F.col("sec") + step % 7 - 1, F.col("sec") + step % 11 - 2).alias("m"))
    return e.select("event_id", "m.*")


@query(f"""WITH t AS (SELECT conv_id, turn, {P} AS p, CASE turn % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' END AS side FROM conversations),
s AS (SELECT *, {CASCADE.format('p')} AS tag FROM t) SELECT conv_id, turn, CASE WHEN tag = 'ENTER_' || side THEN 'ADD' ELSE tag END AS tag FROM s""")
def detect_signal(spark, d):
    side = F.when(F.col("turn") % 3 == 0, "LONG").when(F.col("turn") % 3 == 1, "SHORT")
    return conv(spark, d).select("conv_id", "turn", tx.detect_signal(plain(F.col("text")), GROUPS, TAGS, side).alias("tag"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {P} AS p FROM conversations) SELECT conv_id, turn FROM t
WHERE NOT regexp_matches(p, '\\bwas\\b') AND NOT (role = 'user' AND regexp_matches(p, '\\bfor\\b'))""")
def non_actionable_filter(spark, d):
    mode = F.when(F.col("role") == "user", "auto").otherwise("review")
    return conv(spark, d).filter(tx.actionable(plain(F.col("text")), [r"\bwas\b"], [r"\bfor\b"], mode)).select("conv_id", "turn")


HINT = r"""CASE WHEN contains(p, 'all') OR contains(p, 'whole position') THEN 'all' WHEN contains(p, 'most my size') THEN 'most'
WHEN regexp_matches(p, '\bhalf\b') THEN 'half' WHEN regexp_matches(p, '\bone\b') THEN 'one' END"""


@query(f"""WITH t AS (SELECT conv_id, turn, lower(text) AS p FROM conversations) SELECT conv_id, turn, {HINT} AS hint,
CASE WHEN contains(p, 'feeler') OR regexp_matches(p, '\\b(?:little|small)\\s+(?:piece|peace)\\b') OR regexp_matches(p, '\\bwith\\b') THEN 'one' ELSE {HINT} END AS entry_hint FROM t""")
def quantity_hint(spark, d):
    return conv(spark, d).select("conv_id", "turn", tx.quantity_hint(F.col("text")).alias("hint"), tx.entry_size_hint(F.col("text"), [r"\bwith\b"]).alias("entry_hint"))


EVENT_TAGS = {"signup": "ENTER_LONG", "purchase": "ADD", "click": "TRIM", "error": "EXIT_ALL"}
EVENT_TAG = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TAGS.items()) + " END"
SCORES = "CASE tag " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tx.BASE_SCORES.items()) + " ELSE 0.7 END"


def event_tag():
    return F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TAGS.items() for x in kv]), F.col("event_type"))


@query(f"""WITH e AS (SELECT event_id, value, {EVENT_TAG} AS tag FROM events) SELECT event_id, greatest(0, least(0.99, round(({SCORES} + CASE WHEN value > 20 THEN 0.03 ELSE 0 END
+ CASE WHEN value > 50 THEN 0.05 ELSE 0 END + CASE WHEN value > 80 THEN 0.02 ELSE 0 END - CASE WHEN value < 10 THEN 0.15 ELSE 0 END
- CASE WHEN event_id % 5 = 0 THEN 0.08 ELSE 0 END)::DOUBLE, 3)))::DOUBLE AS score FROM e""")
def intent_score(spark, d):
    price = lambda least: F.when(F.col("value") > least, F.col("value"))
    text, guard = F.when(F.col("value") < 10, "maybe").otherwise("now"), F.when(F.col("event_id") % 5 == 0, "cue")
    return read(spark, d, "events").select("event_id", tx.intent_score(event_tag(), text, price(20), price(50), price(80), guard).alias("score"))


@query("""SELECT event_id, CASE WHEN value % 7 > 4.8 THEN 'classifier' WHEN event_type = 'error' THEN 'explicit' WHEN event_type = 'view' THEN 'setup' ELSE 'seed' END AS source,
CASE WHEN value % 7 > 4.8 THEN 0.97 WHEN event_type = 'error' THEN 0.96 WHEN event_type = 'view' THEN 0.74 ELSE 0.58 END::DOUBLE AS score FROM events""")
def candidate_score(spark, d):
    options = [("classifier", 0.97, F.col("value") % 7 > 4.8), ("explicit", 0.96, F.col("event_type") == "error"), ("setup", 0.74, F.col("event_type") == "view"), ("seed", 0.58, F.lit(True))]
    best = read(spark, d, "events").select("event_id", tx.best_candidate(options).alias("b"))
    return best.select("event_id", "b.source", F.col("b.p").alias("score"))


@query(f"""WITH t AS (SELECT conv_id, turn, {P} AS p FROM conversations), h AS (SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches(p, '\\bare\\b') THEN 'are' END,
CASE WHEN regexp_matches(p, '\\bfrom\\b') THEN 'from' END) AS hits FROM t) SELECT * FROM h WHERE hits <> ''""")
def advice_flag(spark, d):
    hits = tx.pattern_hits(plain(F.col("text")), {"are": r"\bare\b", "from": r"\bfrom\b"})
    return conv(spark, d).select("conv_id", "turn", hits.alias("hits")).filter("hits <> ''")


#: The reference list and one pattern that the invented prose of the given tables meets.
SUSPECTS = [*tx.SUSPICIOUS, r"\bthe th[a-z]*\b"]


@query("SELECT conv_id, turn, " + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in SUSPECTS) + " AS suspicious FROM conversations")
def suspicious_flag(spark, d):
    return conv(spark, d).select("conv_id", "turn", tx.suspicious_flag(F.col("text"), SUSPECTS).alias("suspicious"))


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'ENTER_LONG' WHEN 'purchase' THEN 'ENTER_SHORT' WHEN 'click' THEN 'TRIM' WHEN 'error' THEN 'EXIT_ALL'
ELSE CASE WHEN user_id % 3 = 0 THEN 'ENTER_LONG' WHEN user_id % 3 = 1 THEN 'ENTER_SHORT' ELSE 'NO_ACTION' END END AS tag,
CASE WHEN user_id % 3 = 0 THEN 'LONG' WHEN user_id % 3 = 1 THEN 'SHORT' END AS side, round(least(1, greatest(0, value / 100)), 6) AS confidence FROM events""")
def coerce_labels(spark, d):
    side = F.when(F.col("user_id") % 3 == 0, " bull!").when(F.col("user_id") % 3 == 1, "SELL").otherwise("?")
    rows = read(spark, d, "events").select("event_id", F.initcap("event_type").alias("label"), side.alias("side"), (F.col("value") / 100).cast("string").alias("confidence"))
    tags = {"SIGNUP": "ENTER_LONG", "PURCHASE": "ENTER_SHORT", "CLICK": "TRIM", "ERROR": "EXIT_ALL"}
    found = lb.coerce_labels(rows, tags, {"BULL": "LONG", "BUY": "LONG", "SELL": "SHORT"})
    return found.select("event_id", "tag", "side", F.round("confidence", 6).alias("confidence"))


@query("""WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, k AS line, 'view' AS label FROM e WHERE k IS NOT NULL UNION ALL SELECT event_id, k + 1, 'next' FROM e WHERE k IS NOT NULL""")
def parse_label_payload(spark, d):
    k = F.get_json_object("props", "$.k")
    item = lambda line, label: F.concat(F.lit('{"line": "'), line, F.lit(f'", "label": "{label}"'), F.lit("}"))
    two = F.concat(item(k, "view"), F.lit(", "), item((k.cast("long") + 1).cast("string"), "next"))
    body = F.concat(F.lit('Sure: {"events": ['), two, F.lit(', {"line": "x", "label": "bad"}]} done'))
    return lb.parse_label_payload(read(spark, d, "events").select("event_id", body.alias("payload")), "payload", ["label"])


# --- captions and transcript files --------------------------------------------------------------------------

PARTS = "(SELECT doc_id, i, string_split(text, chr(10))[i] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, i::BIGINT AS t, x, i AS rn FROM {PARTS}), f AS (SELECT doc_id, rn, t AS kt, x AS kx, 1 AS g FROM c WHERE rn = 1
UNION ALL SELECT c.doc_id, c.rn, CASE WHEN f.kx = c.x OR (c.t <= f.kt + 1 AND starts_with(c.x, f.kx)) THEN f.kt ELSE c.t END, c.x,
CASE WHEN f.kx = c.x OR (c.t <= f.kt + 1 AND starts_with(c.x, f.kx)) THEN f.g ELSE f.g + 1 END FROM f JOIN c ON c.doc_id = f.doc_id AND c.rn = f.rn + 1)
SELECT doc_id, kt AS line, arg_max(kx, rn) AS text FROM f GROUP BY doc_id, kt, g""")
def collapse_rolling_captions(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return od.collapse_captions(rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), "text"), "doc_id", "line", "text")


CUE_TEXT = squeezed("regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&amp;', '&'), '<[^>]+>', '', 'g')")
CUES = f"WITH c AS (SELECT doc_id AS file, i, {CUE_TEXT} AS text FROM {PARTS}) SELECT file, i::BIGINT AS seq, (2 * (i - 1))::BIGINT AS ts_s, text FROM c WHERE text <> ''"


@query(CUES)
def parse_vtt(spark, d):
    """One caption file for each document: a cue for each of its lines, two seconds apart."""
    at = lambda k: F.format_string("%02d:%02d:%02d.000", F.floor(k * 2 / 3600), F.floor(k * 2 % 3600 / 60), F.floor(k * 2 % 60))
    cue = lambda x, k: F.concat(F.lit("\n"), at(k), F.lit(" --> "), at(k + 1), F.lit("\n"), x, F.lit("\n"))
    body = F.array_join(F.transform(F.split("text", "\n"), cue), "")
    return src.parse_vtt(docs(spark, d).select(F.col("doc_id").alias("file"), F.concat(F.lit("WEBVTT\n"), body).alias("text")))


@query(CUES)
def parse_json3(spark, d):
    cue = lambda x, k: F.struct((k * 2000).cast("long").alias("tStartMs"), F.array(F.struct(x.alias("utf8"))).alias("segs"))
    body = F.to_json(F.struct(F.transform(F.split("text", "\n"), cue).alias("events")))
    return src.parse_json3(docs(spark, d).select(F.col("doc_id").alias("file"), body.alias("text")))


SAFE = "left(regexp_replace(trim(regexp_replace(arg_min(text, turn), '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), '-{2,}', '-', 'g'), 80)"


@query(f"""SELECT conv_id AS file, string_agg('[' || lpad((turn * 40 // 3600)::VARCHAR, 2, '0') || ':' || lpad((turn * 40 % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 40 % 60)::VARCHAR, 2, '0') || '] ' || text,
chr(10) ORDER BY turn) || chr(10) AS text, '2026-03-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || '__' || coalesce(nullif({SAFE}, ''), 'v' || conv_id) || '__v' || conv_id || '.txt' AS name FROM conversations GROUP BY conv_id""")
def render_transcript(spark, d):
    c = conv(spark, d)
    captions = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("seq"), (F.col("turn") * 40).alias("ts_s"), "text")
    title = c.groupBy(F.col("conv_id").alias("file")).agg(F.min_by("text", "turn").alias("title"))
    name = src.transcript_name(F.format_string("202603%02d", F.col("file") % 28 + 1), F.col("title"), F.concat(F.lit("v"), F.col("file").cast("string")))
    return src.transcript_files(src.render_transcript(captions)).join(title.select("file", name.alias("name")), "file")


TRACK = """SELECT o_custkey AS video, CASE o_orderkey % 3 WHEN 0 THEN 'manual' ELSE 'automatic' END AS kind,
['en', 'en-US', 'fr', 'de-orig', 'en-orig', 'live_chat_en', 'es'][o_orderkey % 7 + 1] AS lang FROM orders"""


@query(f"""WITH t AS (SELECT * FROM ({TRACK}) WHERE NOT contains(lang, 'live_chat')), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY kind <> 'manual', NOT (lang = 'en' OR starts_with(lang, 'en-')),
lang <> 'en', NOT starts_with(lang, 'en-'), contains(lang, 'orig'), lang) AS rn FROM t) SELECT video, kind, lang FROM r WHERE rn = 1""")
def rank_caption_tracks(spark, d):
    names = F.array(*[F.lit(x) for x in ("en", "en-US", "fr", "de-orig", "en-orig", "live_chat_en", "es")])
    kind = F.when(F.col("o_orderkey") % 3 == 0, "manual").otherwise("automatic")
    tracks = read(spark, d, "orders").select(F.col("o_custkey").alias("video"), kind.alias("kind"), F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("lang"))
    return src.rank_tracks(tracks)


@query("SELECT event_type AS status, count(*)::BIGINT AS n, array_to_string(list(event_id ORDER BY event_id), ',') AS items FROM events GROUP BY 1")
def ingest_manifest(spark, d):
    found = src.ingest_manifest(read(spark, d, "events").select(F.col("event_type").alias("status"), F.col("event_id").alias("item")))
    return found.select("status", "n", F.array_join("items", ",").alias("items"))


EXAMPLES = "SELECT o_orderkey AS id, o_orderstatus AS label, o_orderkey % 7 = 0 AS flagged FROM orders"


def examples(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), (F.col("o_orderkey") % 7 == 0).alias("flagged"))


@query(f"SELECT id, label FROM ({EXAMPLES}) WHERE NOT flagged")
def write_examples(spark, d):
    """The clean part as it is read back from the JSON lines written."""
    return src.written_examples(examples(spark, d), F.col("flagged"), "clean").select("id", "label")


@query(f"SELECT id, label FROM ({EXAMPLES}) WHERE flagged")
def write_flagged(spark, d):
    return src.written_examples(examples(spark, d), F.col("flagged"), "flagged").select("id", "label")


@query(f"SELECT id, label, 0 AS input_ordinal FROM ({EXAMPLES}) WHERE NOT flagged UNION ALL SELECT id, label, 1 FROM ({EXAMPLES}) WHERE flagged")
def read_reviewed_corpora(spark, d):
    path = src.scratch(spark, "reviewed")
    src.write_examples(examples(spark, d), F.col("flagged"), path)
    paths = [f"{path}/part=clean", f"{path}/part=flagged", f"{path}/part=clean"]
    return src.read_reviewed(spark, paths, "id long, label string").filter("_corrupt_record is null").select("id", "label", "input_ordinal")


@query("""WITH t AS (SELECT 'talk 2026-03-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || ' no ' || conv_id || '.txt' AS file, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line, conv_id, replace(text, chr(10), ' ') AS text FROM conversations)
SELECT file, line::BIGINT AS line, lpad((turn * 40 // 3600)::VARCHAR, 2, '0') || ':' || lpad((turn * 40 % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 40 % 60)::VARCHAR, 2, '0') AS timecode, regexp_replace(text, '^\\s+', '') AS text,
(epoch(make_date(2026, 3, (conv_id % 28 + 1)::INTEGER)) + turn * 40)::BIGINT AS received_at FROM t WHERE turn % 4 <> 3""")
def read_transcripts(spark, d):
    """Conversations as transcript files with their date in the name; each fourth line has no time and only counts."""
    t = F.col("turn") * 40
    stamp = F.format_string("[%02d:%02d:%02d] ", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60)
    line = F.concat(F.when(F.col("turn") % 4 != 3, stamp).otherwise(""), F.replace("text", F.lit("\n"), F.lit(" ")))
    lines = conv(spark, d).select(F.format_string("talk 2026-03-%02d no %d.txt", F.col("conv_id") % 28 + 1, F.col("conv_id")).alias("file"), F.col("turn").alias("seq"), line.alias("value"))
    return src.parse_transcripts(src.transcript_files(lines)).withColumn("received_at", F.unix_seconds("received_at"))


SETTLED = "CASE WHEN raw IN ('TRIM', 'MOVE_STOP', 'EXIT_ALL') AND position = 'FLAT' THEN NULL WHEN raw = 'ENTER_' || position THEN 'ADD' ELSE raw END"


@query(f"""WITH t AS (SELECT conv_id, turn, {P} AS p FROM conversations), s AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t), i AS (SELECT conv_id, turn, {CASCADE.format("coalesce(trim(b || ' ' || p), p)")} AS raw FROM s),
h AS (SELECT *, coalesce(last_value(CASE raw WHEN 'ENTER_LONG' THEN 'LONG' WHEN 'ENTER_SHORT' THEN 'SHORT' WHEN 'EXIT_ALL' THEN 'FLAT' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'FLAT') AS position FROM i),
g AS (SELECT conv_id, turn, position, coalesce({SETTLED}, 'NONE') AS tag FROM h) SELECT conv_id, tag, position, count(*)::BIGINT AS n FROM g GROUP BY ALL""")
def replay_counts(spark, d):
    """Actions of stitched transcript lines, read against the position that earlier lines left, counted by transcript."""
    c = conv(spark, d).withColumn("p", plain(F.col("text")))
    parsed = cascade.parse_intent(od.stitch_context(c, F.col("p"), "conv_id", "turn"), F.col("analysis_text"), GROUPS, TAGS, "conv_id", "turn")
    return parsed.groupBy("conv_id", F.coalesce("tag", F.lit("NONE")).alias("tag"), "position").agg(F.count("*").alias("n"))
