"""The registered queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import datetime
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import patterns as P
from .fixtures import EXACT, MASKED
from .functions import extract as X
from .operators import evaluation as E
from .operators import usage as U
from .operators.chunking import chunks
from .operators.spans import find
from .plans.masking import PipelineConfig, mapping_rows, mask_documents
from .rules import BY_NAME
from .sources.readers import FORM_FEATURES, form_features

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = datetime.datetime(2024, 1, 31, tzinfo=datetime.timezone.utc)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule_spans(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    found = F.concat(*[X.spans(F.col("text"), BY_NAME[n]) for n in names])
    return docs.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.start", "s.end", "s.label", "s.text")


EMAIL_SQL = "(?i)" + P.EMAIL
SPANS_SQL = """
WITH m AS (SELECT doc_id, regexp_extract_all("text", '{p}') AS ms, regexp_split_to_array("text", '{p}') AS gaps FROM documents WHERE "text" IS NOT NULL),
e AS (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT doc_id, ms[i] AS v, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS INTEGER) AS b FROM e)
"""


@query(SPANS_SQL.format(p=EMAIL_SQL) + """SELECT doc_id, CAST(b + length(v) - length(ltrim(v, '_-%+ .')) AS INTEGER) AS "start", CAST(b + length(rtrim(v, ' .')) AS INTEGER) AS "end", 'EMAIL' AS label, trim(v, '_- .') AS "text" FROM s""")
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_spans(spark, sf_dir, "EMAIL")


@query(SPANS_SQL.format(p=r"\d+") + """SELECT doc_id, b AS "start", b + 16 AS "end", 'CREDIT_CARD' AS label, v AS "text" FROM s WHERE length(v) = 16""")
def card_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_spans(spark, sf_dir, "CREDIT_CARD")


# RE2 has no lookaround: of each run of characters that may not stand before an address, the address that begins it.
RUN_SQL = r"[\p{L}\p{M}\p{Nd}\p{Pc}.:]+"
IP_SQL = r"^((?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}|(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4})(?:$|\.$|\.[^\p{Nd}])"


@query(SPANS_SQL.format(p=RUN_SQL) + f"""SELECT doc_id, b AS "start", CAST(b + length(regexp_extract(v, '{IP_SQL}', 1)) AS INTEGER) AS "end", 'IP_ADDRESS' AS label, regexp_extract(v, '{IP_SQL}', 1) AS "text" FROM s WHERE regexp_matches(v, '{IP_SQL}')""")
def ip_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_spans(spark, sf_dir, "IP_ADDRESS")


# The character before a number is matched with it, then taken off; only the text's first match may have none.
PHONE_SQL = P.PHONE.replace(r"(?<![\w+])", "").replace(r"(?![\w])", r"\b")
BEFORE_SQL = r"[^\p{L}\p{M}\p{Nd}\p{Pc}+]"
LED_SQL = f"""CASE WHEN b = 0 AND regexp_matches(v, '^(?:{PHONE_SQL})$') THEN v ELSE substring(v, 2) END"""


@query(SPANS_SQL.format(p=f"(?:^|{BEFORE_SQL})(?:{PHONE_SQL})") + f""", n AS (SELECT doc_id, b, v AS whole, {LED_SQL} AS v FROM s)
SELECT doc_id, CAST(b + length(whole) - length(v) AS INTEGER) AS "start", CAST(b + length(whole) AS INTEGER) AS "end", 'PHONE' AS label, v AS "text" FROM n""")
def phone_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_spans(spark, sf_dir, "PHONE")


@query()
def overlap_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    found = F.concat(*[X.spans(F.col("text"), BY_NAME[n]) for n in ("EMAIL", "IP_ADDRESS", "CREDIT_CARD", "PHONE", "BANK_ACCOUNT_FMT", "FILE")])
    # Most documents have none: the greedy choice runs on the others.
    some = docs.select("doc_id", found.alias("found")).where(F.size("found") > 0)
    return some.select("doc_id", F.explode(X.resolved(F.col("found"))).alias("s")).select("doc_id", "s.start", "s.end", "s.label", "s.text")


MASKED_SQL = f"""
WITH m AS (SELECT doc_id, "text", regexp_extract_all("text", '{EMAIL_SQL}') AS ms, regexp_split_to_array("text", '{EMAIL_SQL}') AS gaps FROM documents WHERE "text" IS NOT NULL),
e AS (SELECT doc_id, gaps, len(ms) AS n0, unnest(ms) AS v, generate_subscripts(ms, 1) AS i FROM m),
keyed AS (SELECT *, replace(lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))), 'ß', 'ss') AS key FROM e),
r AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n, arg_min(v, i) AS original, count(*) AS hits FROM keyed GROUP BY doc_id, key)
"""


@query(MASKED_SQL + """SELECT k.doc_id, string_agg(gaps[i] || '[EMAIL_' || r.n || ']', '' ORDER BY i) || any_value(gaps[n0 + 1]) AS masked
FROM keyed k JOIN r ON k.doc_id = r.doc_id AND k.key = r.key GROUP BY k.doc_id""")
def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have an address, with addresses masked: expressions alone, no shuffle."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.instr("text", "@") > 0).where(F.col("text").rlike(BY_NAME["EMAIL"].java)).select("doc_id", X.masked_by(F.col("text"), BY_NAME["EMAIL"]).alias("masked"))


@query(MASKED_SQL + "SELECT doc_id, '[EMAIL_' || n || ']' AS placeholder, original FROM r")
def email_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    values = F.filter(X.pieces(F.col("text"), BY_NAME["EMAIL"].java), lambda p, i: i % 2 == 1)
    each = docs.select("doc_id", F.posexplode(values).alias("i", "original")).withColumn("key", F.element_at(X.keys(F.array("original")), 1))
    first = each.groupBy("doc_id", "key").agg(F.min(F.struct("i", "original")).alias("x"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("x.i"))
    return first.select("doc_id", F.concat(F.lit("[EMAIL_"), n.cast("string"), F.lit("]")).alias("placeholder"), F.col("x.original").alias("original"))


@query("""SELECT doc_id, "text" AS restored FROM documents WHERE regexp_matches("text", '""" + EMAIL_SQL + "')")
def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks addresses by place and restores them: the texts come back."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(BY_NAME["EMAIL"].java))
    parts = X.pieces(F.col("text"), BY_NAME["EMAIL"].java)
    numbered = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("[EMAIL_"), ((i + 1) / 2).cast("int").cast("string"), F.lit("]"))).otherwise(p))
    pairs = F.filter(F.transform(parts, lambda p, i: F.struct(F.concat(F.lit("[EMAIL_"), ((i + 1) / 2).cast("int").cast("string"), F.lit("]")).alias("k"), p.alias("v"), (i % 2).alias("o"))), lambda x: x["o"] == 1)
    mapping = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))))
    return docs.select("doc_id", X.restored(F.array_join(numbered, ""), mapping).alias("restored"))


@query("""
WITH t AS (SELECT doc_id, '[EMAIL_' || (doc_id % 4) || '] and [PHONE_1]' AS masked FROM documents)
SELECT doc_id, '[EMAIL_' || (doc_id % 4) || ']' AS unknown FROM t WHERE doc_id % 4 <> 1
""")
def unknown_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[EMAIL_"), (F.col("doc_id") % 4).cast("string"), F.lit("] and [PHONE_1]")).alias("masked"))
    known = spark.createDataFrame([("[EMAIL_1]",), ("[PHONE_1]",)], "unknown string")
    return docs.select("doc_id", F.explode(X.unknown_placeholders(F.col("masked"), F.create_map().cast("map<string,string>"))).alias("unknown")).join(F.broadcast(known), "unknown", "left_anti").select("doc_id", "unknown")


# Words of digits with single separators between, as long as they go; those of ten digits count.
RESIDUAL_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_replace("text", '{P.PLACEHOLDER_ANY}', '    ', 'g') AS t FROM documents WHERE "text" IS NOT NULL),
v AS (SELECT doc_id, 'DIGITS' AS kind, unnest(regexp_extract_all(t, '\b\d+(?:[ \t.\-]\d+)*\b')) AS "value" FROM t
  UNION ALL SELECT doc_id, 'EMAIL', trim(unnest(regexp_extract_all(t, '{P.EMAIL_LIKE}'))) FROM t)
SELECT DISTINCT doc_id, kind, "value" FROM v WHERE kind = 'EMAIL' OR length(regexp_replace("value", '[^0-9]', '', 'g')) >= 10
"""


@query(RESIDUAL_SQL)
def residual_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.explode(X.residual(F.col("text"))).alias("r")).select("doc_id", "r.kind", "r.value")


@query()
def mask_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan on all documents: masked text, number of entities and of warnings."""
    found = mask_documents(table(spark, sf_dir, "documents"), PipelineConfig())
    return found.select("doc_id", "masked", F.size("mapping").alias("n_entities"), F.size("spans").alias("n_spans"), F.size("warnings").alias("n_warnings"))


@query()
def mask_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_rows(mask_documents(table(spark, sf_dir, "documents"), PipelineConfig()))


@query()
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mask_documents(table(spark, sf_dir, "documents"), PipelineConfig())
    return found.select(F.explode("summary").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n_spans"), F.count(F.lit(1)).alias("n_documents"))


@query()
def conversations_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping for each conversation: its turns in order are one text."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    texts = turns.select("conv_id", F.array_join(F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    return mask_documents(texts, PipelineConfig(), "conv_id").select("conv_id", "masked", F.size("mapping").alias("n_entities"))


# Line by line: a part ends before the line that would take it over the limit.
CHUNK_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce("text", '') AS t, string_split(coalesce("text", ''), chr(10)) AS ls FROM documents),
w AS (SELECT id, 0 AS i, 0 AS p, 0 AS b, 0 AS size FROM d
  UNION ALL
  SELECT w.id, w.i + 1, w.p + length(ls[w.i + 1]) + 1, CASE WHEN w.p > w.b AND w.size + length(ls[w.i + 1]) > 3000 THEN w.p ELSE w.b END,
    CASE WHEN w.p > w.b AND w.size + length(ls[w.i + 1]) > 3000 THEN 0 ELSE w.size END + length(ls[w.i + 1]) + 1 FROM w JOIN d ON w.id = d.id WHERE w.i < len(ls)),
c AS (SELECT id, b, max(p) - b - 1 AS n FROM w WHERE i > 0 GROUP BY id, b)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY b) - 1 AS INTEGER) AS k, CAST(b AS INTEGER) AS "at", CAST(n AS INTEGER) AS "size"
FROM c JOIN d USING (id) WHERE regexp_matches(substring(t, b + 1, n), '[^\\s]')
"""


@query(CHUNK_SQL)
def chunk_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<struct<at:int,size:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"at": a, "size": len(c)} for a, c in chunks(t or "", 3000)])

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(cut("text")).alias("k", "c")).select("doc_id", "k", "c.at", "c.size")


EVAL_SQL = """
WITH g AS (SELECT row_number() OVER () AS id, l_orderkey AS row, l_linenumber * 10 AS s, l_linenumber * 10 + 5 AS e, CASE WHEN l_returnflag = 'N' THEN 'PERSON' ELSE 'LOCATION' END AS c FROM lineitem),
p AS (SELECT row_number() OVER () AS id, l_orderkey AS row, l_linenumber * 10 + l_suppkey % 8 AS s, l_linenumber * 10 + l_suppkey % 8 + 3 AS e, CASE WHEN l_linestatus = 'O' THEN 'PERSON' ELSE 'LOCATION' END AS c FROM lineitem WHERE l_partkey % 3 > 0),
a AS (SELECT g.id, g.row, g.s, g.e, g.c, coalesce(bool_or(p.c = g.c), false) AS hit, count(p.row) > 0 AS cov FROM g LEFT JOIN p ON g.row = p.row AND g.s < p.e AND p.s < g.e GROUP BY ALL),
b AS (SELECT p.id, p.row, p.s, p.e, p.c, coalesce(bool_or(p.c = g.c), false) AS hit FROM p LEFT JOIN g ON g.row = p.row AND g.s < p.e AND p.s < g.e GROUP BY ALL),
u AS (SELECT 'gold' AS side, c, hit, cov FROM a UNION ALL SELECT 'pred', c, hit, false FROM b),
n AS (SELECT unnest(['ALL', 'PERSON+LOCATION', c]) AS name, * FROM u)
SELECT name, count(*) FILTER (side = 'gold') AS n_gold, count(*) FILTER (side = 'pred') AS n_pred, count(*) FILTER (side = 'gold' AND hit) AS gold_hit,
  count(*) FILTER (side = 'pred' AND hit) AS pred_hit, count(*) FILTER (side = 'gold' AND cov) AS gold_covered FROM n GROUP BY name
"""


@query(EVAL_SQL)
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join of two span tables that are made of lineitem, and counts by category and in all."""
    rows = table(spark, sf_dir, "lineitem")
    at = F.col("l_linenumber") * 10
    gold = rows.select(F.col("l_orderkey").alias("row"), at.alias("start"), (at + 5).alias("end"), F.when(F.col("l_returnflag") == "N", "PERSON").otherwise("LOCATION").alias("category"))
    start = at + F.col("l_suppkey") % 8
    pred = rows.where("l_partkey % 3 > 0").select(F.col("l_orderkey").alias("row"), start.alias("start"), (start + 3).alias("end"), F.when(F.col("l_linestatus") == "O", "PERSON").otherwise("LOCATION").alias("category"))
    return E.scores(E.matches(gold, pred)).select("name", "n_gold", "n_pred", "gold_hit", "pred_hit", "gold_covered")


@query("""SELECT event_type AS kind, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events QUALIFY n <= 5""")
def first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", n.cast("long")).where("n <= 5").select(F.col("event_type").alias("kind"), "event_id", "n")


@query("""SELECT event_type AS kind, count(*) AS calls, round(sum("value"), 4) AS seconds FROM events GROUP BY event_type""")
def usage_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("seconds"))


@query("""
WITH b AS (SELECT max(ts) AS now FROM events),
p AS (SELECT unnest(list_filter([CASE WHEN CAST(ts AS DATE) = CAST(now AS DATE) THEN 'today' END, CASE WHEN ts >= now - INTERVAL 7 DAY THEN 'last_7_days' END, 'all_time'], lambda x: x IS NOT NULL)) AS period, "value" FROM events, b)
SELECT period, count(*) AS requests, round(sum("value"), 4) AS seconds FROM p GROUP BY period
""")
def usage_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0] or NOW
    periods = U.in_periods(events.withColumn("ts", F.col("ts").cast("string")), now.replace(tzinfo=datetime.timezone.utc), 7)
    return periods.groupBy("period").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 4).alias("seconds"))


@query("""SELECT event_type AS kind, round(quantile_cont("value", 0.5), 9) AS p50, round(quantile_cont("value", 0.95), 9) AS p95, max("value") AS most FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.round(U.percentile("value", 0.5), 9).alias("p50"), F.round(U.percentile("value", 0.95), 9).alias("p95"), F.max("value").alias("most"))


@query("""SELECT sha256("text") AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE "text" IS NOT NULL GROUP BY 1""")
def doc_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(r"""SELECT doc_id, length("text") AS chars, len(regexp_extract_all("text", '\d+')) AS numbers, len(regexp_extract_all("text", '_{3,}|\.{5,}')) AS placeholders FROM documents WHERE "text" IS NOT NULL""")
def content_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    n = lambda p: ((F.size(X.pieces(F.col("text"), p)) - 1) / 2).cast("long")
    return docs.select("doc_id", F.length("text").cast("long").alias("chars"), n(r"\d+").alias("numbers"), n(r"_{3,}|\.{5,}").alias("placeholders"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1).alias("host"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\n\\r]+", " ")).alias("body"))


@query("""
WITH t AS (SELECT l_shipmode_level AS level, count(*) AS client_count, count(*) FILTER (l_linestatus = 'O') AS ok, quantile_cont(l_quantity, 0.5) AS wait_p50, quantile_cont(l_quantity, 0.95) AS wait_p95, max(l_quantity) AS wait_max,
  count(*) FILTER (l_suppkey % 97 = 0 AND l_linenumber % 7 = 4) AS bad FROM (SELECT *, l_linenumber % 7 AS l_shipmode_level FROM lineitem) GROUP BY 1)
SELECT CAST(level AS BIGINT) AS level, client_count, ok, client_count - ok AS error, round(wait_p50, 9) AS wait_p50, round(wait_p95, 9) AS wait_p95, wait_max,
  CASE WHEN bad > 0 THEN 'http_5xx' WHEN (client_count - ok) / client_count > 0.2 THEN 'error_rate' END AS abort_reason FROM t
""")
def load_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 7).cast("long").alias("level"), F.lit(60.0).alias("duration"), F.lit(1800.0).alias("doc_chars"), F.col("l_tax").alias("submit_latency"), F.col("l_quantity").alias("wait_time"),
        F.when(F.col("l_linestatus") == "O", "done").otherwise("error").alias("status"), F.when((F.col("l_suppkey") % 97 == 0) & (F.col("l_linenumber") % 7 == 4), 503).alias("http_status"),
    )
    out = U.load_levels(rows)
    return out.select("level", "client_count", "ok", "error", F.round("wait_p50", 9).alias("wait_p50"), F.round("wait_p95", 9).alias("wait_p95"), "wait_max", "abort_reason")


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Each value that was written down for a text, at its first place after the value before.
RULE_SQL = "WITH f(rule, body, vals) AS (VALUES " + ", ".join(f"({literal(r)}, {literal(t)}, [{', '.join(map(literal, v))}])" for r, t, v in EXACT) + """),
v AS (SELECT rule, body, unnest(vals) AS value, generate_subscripts(vals, 1) AS k FROM f)
SELECT rule, body, CAST(k AS INTEGER) AS k, value, CAST(strpos(body, value) - 1 + length(value) AS INTEGER) AS "end" FROM v
"""


@query(RULE_SQL)
def rule_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule finds in the hand-written texts."""

    @F.pandas_udf("array<struct<value:string,end:int>>")
    def found(rules: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"value": s.text.lstrip("№ "), "end": s.end} for s in find(BY_NAME[r], t)] for r, t in zip(rules, texts, strict=True)])

    rows = spark.createDataFrame([(r, t) for r, t, _ in EXACT], "rule string, body string")
    return rows.select("rule", "body", F.posexplode(found("rule", "body")).alias("k", "x")).select("rule", "body", (F.col("k") + 1).alias("k"), "x.value", "x.end")


@query("SELECT * FROM (VALUES " + ", ".join(f"({literal(t)}, {literal(m)}, {literal(t)})" for t, m in MASKED) + ") AS f(body, masked, restored)")
def mask_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan on the hand-written texts, and the texts restored from its mappings."""
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(MASKED)], "doc_id long, text string")
    done = mask_documents(rows, PipelineConfig()).select("doc_id", "masked", X.restored(F.col("masked"), F.col("mapping")).alias("restored"))
    return done.join(rows, "doc_id").select(F.col("text").alias("body"), "masked", "restored")


FORM_SQL = "SELECT doc_id, length(t) AS chars, sha256(\"text\") AS sha256, " + ", ".join(f"len(regexp_extract_all(t, {literal(p)})) AS {k}" for k, p in FORM_FEATURES.items()) + """ FROM (SELECT *, coalesce("text", '') AS t FROM documents)"""
FORM_SQL = f"""
WITH n AS ({FORM_SQL})
SELECT *, fio + dates + money + requisites AS pii, CASE WHEN chars < 120 THEN NULL WHEN fio + dates + money + requisites >= 4 THEN true
  WHEN fio + dates + money + requisites >= 2 AND placeholders <= 3 AND markers = 0 THEN true WHEN placeholders + markers >= 6 OR fio + dates + money + requisites = 0 THEN false END AS filled FROM n
"""


@query(FORM_SQL)
def form_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the signs of filled and blank forms, and what they say."""
    found = form_features(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("chars").cast("long").alias("chars"), "sha256", *(F.col(k).cast("long").alias(k) for k in (*FORM_FEATURES, "pii")), "filled")


SPANS_OF_LINES = """
WITH g AS (SELECT row_number() OVER () AS id, l_orderkey AS row, l_linenumber * 10 AS s, l_linenumber * 10 + 5 AS e, CASE WHEN l_returnflag = 'N' THEN 'PERSON' ELSE 'LOCATION' END AS c FROM lineitem),
p AS (SELECT row_number() OVER () AS id, l_orderkey AS row, l_linenumber * 10 + l_suppkey % 8 AS s, l_linenumber * 10 + l_suppkey % 8 + 3 AS e, CASE WHEN l_linestatus = 'O' THEN 'PERSON' ELSE 'LOCATION' END AS c FROM lineitem),
a AS (SELECT g.id, g.row, g.s, g.e, g.c, coalesce(bool_or(p.c = g.c), false) AS hit, count(p.row) > 0 AS cov FROM g LEFT JOIN p ON g.row = p.row AND g.s < p.e AND p.s < g.e GROUP BY ALL),
b AS (SELECT p.id, p.row, p.s, p.e, p.c, coalesce(bool_or(p.c = g.c), false) AS hit FROM p LEFT JOIN g ON g.row = p.row AND g.s < p.e AND p.s < g.e GROUP BY ALL)
"""


def spans_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of lineitem as a gold and as a predicted span, matched."""
    rows = table(spark, sf_dir, "lineitem")
    at = (F.col("l_linenumber") * 10).cast("long")
    start = at + F.col("l_suppkey") % 8
    gold = rows.select(F.col("l_orderkey").alias("row"), at.alias("start"), (at + 5).alias("end"), F.when(F.col("l_returnflag") == "N", "PERSON").otherwise("LOCATION").alias("category"))
    pred = rows.select(F.col("l_orderkey").alias("row"), start.alias("start"), (start + 3).alias("end"), F.when(F.col("l_linestatus") == "O", "PERSON").otherwise("LOCATION").alias("category"))
    return E.matches(gold, pred)


@query(SPANS_OF_LINES + """, u AS (SELECT 'gold' AS side, c, hit FROM a UNION ALL SELECT 'pred', c, hit FROM b),
n AS (SELECT unnest(['ALL', 'PERSON+LOCATION', c]) AS name, * FROM u),
k AS (SELECT name, count(*) FILTER (side = 'gold') AS ng, count(*) FILTER (side = 'pred') AS np, count(*) FILTER (side = 'gold' AND hit) AS gh, count(*) FILTER (side = 'pred' AND hit) AS ph FROM n GROUP BY name),
r AS (SELECT name, ph / np AS p, gh / ng AS r FROM k)
SELECT name, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM r""")
def eval_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.scores(spans_of_lines(spark, sf_dir))
    return found.select("name", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(SPANS_OF_LINES + """, x AS (SELECT c AS category, CASE WHEN NOT cov THEN 'TRUEMISS' WHEN NOT hit THEN 'MISMATCH' END AS kind, row, s, e FROM a UNION ALL SELECT c, CASE WHEN NOT hit THEN 'FP' END, row, s, e FROM b)
SELECT category, kind, CAST(row_number() OVER (PARTITION BY category, kind ORDER BY row, s, e) AS INTEGER) AS n, row, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM x WHERE kind IS NOT NULL QUALIFY n <= 20""")
def error_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 errors of each category and kind: a report, so the limit is its feature."""
    return E.errors(spans_of_lines(spark, sf_dir))
