"""Usage, cost and audit records as DataFrames, over JSON lines."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prices for a million tokens, characters for a token, tokens for a call, characters for a page, audit events.
PRICE_IN, PRICE_OUT, PRICE_NER, CHARS_PER_TOKEN, TOKENS_PER_CALL, CHARS_PER_PAGE = 14.79, 43.15, 14.79, 2.27, 20.0, 1800.0
EVENTS = ("depersonalize", "key_issued", "key_withheld", "result_issued", "job_destroyed")
TOKENS = "struct<prompt_tokens:string,completion_tokens:string>"
RECORD = (
    "ts string, kind string, request_id string, filename string, chars long, pages double, seconds double, calls map<string,string>, "
    f"tokens_by_kind map<string,{TOKENS}>, seconds_by_kind map<string,string>, prompt_tokens_total long, completion_tokens_total long, "
    "gliner_tokens_est long, cost_rub double, cost_rub_llm double, cost_rub_gliner double, stages map<string,boolean>"
)


def request_totals(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """One request_total for each request. calls: request_id, kind, chars, seconds, prompt_tokens, completion_tokens (failed ones count);
    requests: request_id, ts, filename, chars, seconds, stages. Seconds of a kind are sums over calls, not wall time."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    by_kind = calls.groupBy("request_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(z("prompt_tokens")).alias("p"), F.sum(z("completion_tokens")).alias("c"), F.bround(F.sum(z("seconds")), 3).alias("s"), F.sum(z("chars")).alias("chars")
    )
    ner = F.col("kind") == "gliner"
    entries = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", v.alias("v")))))
    totals = by_kind.groupBy("request_id").agg(
        entries(F.col("n")).alias("calls"),
        entries(F.struct(F.col("p").alias("prompt_tokens"), F.col("c").alias("completion_tokens"))).alias("tokens_by_kind"),
        entries(F.col("s")).alias("seconds_by_kind"),
        F.sum(F.when(~ner, F.col("p")).otherwise(0)).alias("prompt_tokens_total"),
        F.sum(F.when(~ner, F.col("c")).otherwise(0)).alias("completion_tokens_total"),
        F.sum(F.when(ner, F.col("chars") / CHARS_PER_TOKEN + TOKENS_PER_CALL * F.col("n")).otherwise(0.0)).alias("__ner"),
    )
    out = requests.join(totals, "request_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.from_json(F.lit("{}"), out.schema[c].dataType))
    llm = cost_llm(z("prompt_tokens_total"), z("completion_tokens_total"))
    est = F.bround(z("__ner"), 0).cast("long")
    return out.select(
        "ts", F.lit("request_total").alias("kind"), "request_id", "filename", "chars", pages(F.col("chars")).alias("pages"), F.bround("seconds", 3).alias("seconds"),
        *(empty(c).alias(c) for c in ("calls", "tokens_by_kind", "seconds_by_kind")), z("prompt_tokens_total").alias("prompt_tokens_total"),
        z("completion_tokens_total").alias("completion_tokens_total"), est.alias("gliner_tokens_est"), F.bround(llm + cost_ner(est), 4).alias("cost_rub"),
        llm.alias("cost_rub_llm"), cost_ner(est).alias("cost_rub_gliner"), "stages",
    )


def pages(chars: Column) -> Column:
    return F.bround(chars / CHARS_PER_PAGE, 1)


def cost_llm(prompt: Column, completion: Column) -> Column:
    return F.bround(prompt / 1e6 * PRICE_IN + completion / 1e6 * PRICE_OUT, 4)


def cost_ner(tokens: Column) -> Column:
    return F.bround(tokens / 1e6 * PRICE_NER, 4)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """request_total records of JSON-line files; lines that aren't JSON objects, and other kinds, are skipped."""
    lines = spark.read.text(path).select(F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r"))
    return lines.where("r.kind = 'request_total'").select("r.*")


def by_stage(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """kind, calls, seconds, avg_seconds, tokens; missing or malformed entries count as 0."""
    keys = F.array_distinct(F.flatten(F.array_compact(F.array(F.map_keys("calls"), F.map_keys("seconds_by_kind"), F.map_keys("tokens_by_kind")))))
    each = records.withColumn("kind", F.explode(keys))
    at = lambda m: F.try_element_at(F.col(m), F.col("kind"))
    whole = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    out = each.groupBy(*by, "kind").agg(
        F.sum(whole(at("calls"))).alias("calls"),
        F.bround(F.sum(F.coalesce(at("seconds_by_kind").try_cast("double"), F.lit(0.0))), 3).alias("seconds"),
        F.sum(whole(at("tokens_by_kind")["prompt_tokens"]) + whole(at("tokens_by_kind")["completion_tokens"])).alias("tokens"),
    )
    return out.select(*by, "kind", "calls", "seconds", F.when(F.col("calls") > 0, F.bround(F.col("seconds") / F.col("calls"), 3)).otherwise(0.0).alias("avg_seconds"), "tokens")


def in_periods(records: DataFrame, now: datetime.datetime, days: int = 30) -> DataFrame:
    """records with `period`: today (UTC), last_N_days, all_time; a bad ts counts in all_time alone."""
    at, ref = F.try_to_timestamp("ts"), F.lit(now.astimezone(datetime.timezone.utc).replace(tzinfo=None).isoformat()).cast("timestamp")
    names = F.array_compact(F.array(F.when(F.to_date(at) == F.to_date(ref), "today"), F.when(at >= ref - F.make_dt_interval(F.lit(days)), f"last_{days}_days"), F.lit("all_time")))
    return records.withColumn("period", F.explode(names))


def summary(records: DataFrame, now: datetime.datetime, days: int = 30) -> DataFrame:
    """One row for each period, also for empty ones."""
    spark = records.sparkSession
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0))
    own = in_periods(records, now, days).groupBy("period").agg(
        F.count(F.lit(1)).alias("requests"), total("pages").cast("double").alias("__pages"), total("prompt_tokens_total").alias("prompt_tokens"), total("completion_tokens_total").alias("completion_tokens"),
        total("gliner_tokens_est").alias("gliner_tokens_est"), *(F.bround(total(c).cast("double"), 4).alias(c) for c in ("cost_rub", "cost_rub_llm", "cost_rub_gliner")), total("seconds").cast("double").alias("__seconds"),
    )
    every = spark.createDataFrame([("today",), (f"last_{days}_days",), ("all_time",)], "period string").join(own, "period", "left").na.fill(0)
    per_page = lambda c, d: F.when(F.col("__pages") > 0, F.bround(c / F.col("__pages"), d)).otherwise(0.0)
    return every.select(
        "period", "requests", F.bround("__pages", 1).alias("pages"), "prompt_tokens", "completion_tokens", "gliner_tokens_est", "cost_rub", "cost_rub_llm", "cost_rub_gliner",
        per_page(F.col("__seconds"), 3).alias("avg_seconds_per_page"), per_page(F.col("prompt_tokens") + F.col("completion_tokens"), 1).alias("avg_tokens_per_page"),
    )


def to_log(calls: DataFrame, policy: str = "errors") -> DataFrame:
    """Which single calls are written: errors, all or off. Totals always count all."""
    return {"all": calls, "errors": calls.where(~F.coalesce("ok", F.lit(True))), "off": calls.where(F.lit(False))}[policy]


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def source_ref(filename: Column) -> Column:
    return F.when(F.length(filename) > 0, F.substring(F.sha2(filename, 256), 1, 16))


def audit_operations(results: DataFrame, actor: str, method: str, irreversible: bool = False) -> DataFrame:
    """Counts and a hash of the name only. results: request_id, filename, summary, chars, seconds, ok, error_type, ts."""
    replaced = F.aggregate(F.map_values("summary"), F.lit(0), lambda a, x: a + x)
    return results.select(
        "ts", F.lit("depersonalize").alias("event"), "request_id", F.lit(actor).alias("actor"), source_ref(F.col("filename")).alias("source_ref"), F.lit(method).alias("method"),
        F.lit(irreversible).alias("irreversible"), F.col("summary").alias("labels"), replaced.alias("replacements_total"), "chars", F.bround("seconds", 3).alias("seconds"), "ok", "error_type",
    )


def audit_events(events: DataFrame) -> DataFrame:
    """Known events only."""
    return events.where(F.col("event").isin(*EVENTS)).select("ts", "event", "request_id", "actor", "detail")


# --- load tests and profiles ------------------------------------------------------------------------------


def percentile(column: str, share: float) -> Column:
    """Linear interpolation; 0 for no values."""
    return F.coalesce(F.percentile(column, share), F.lit(0.0))


def load_levels(records: DataFrame, chars_per_page: float = CHARS_PER_PAGE) -> DataFrame:
    """records: level, duration, doc_chars (of the level), submit_latency, wait_time, status, http_status. One row for each level, with the reason to
    stop after it: server errors, then timeouts, then more than a fifth of errors."""
    n = F.col("client_count")
    counted = records.groupBy("level").agg(
        F.count(F.lit(1)).alias("client_count"), F.sum((F.col("status") == "done").cast("long")).alias("ok"), percentile("submit_latency", 0.5).alias("submit_p50"),
        percentile("wait_time", 0.5).alias("wait_p50"), percentile("wait_time", 0.95).alias("wait_p95"), F.coalesce(F.max("wait_time"), F.lit(0.0)).alias("wait_max"),
        F.max("duration").alias("duration"), F.max("doc_chars").alias("doc_chars"),
        F.sum((F.coalesce("http_status", F.lit(0)) >= 500).cast("long")).alias("server_errors"), F.sum((F.col("status") == "timeout").cast("long")).alias("timeouts"),
    )
    per_minute = F.when(F.col("duration") > 0, n / (F.col("duration") / 60.0)).otherwise(0.0)
    reason = F.when(F.col("server_errors") > 0, "http_5xx").when(F.col("timeouts") > 0, "timeout").when((n - F.col("ok")) / n > 0.2, "error_rate")
    return counted.select(
        "level", "client_count", "ok", (n - F.col("ok")).alias("error"), "submit_p50", "wait_p50", "wait_p95", "wait_max", per_minute.alias("docs_per_min"),
        (per_minute * F.col("doc_chars") / chars_per_page).alias("pages_per_min"), reason.alias("abort_reason"),
    )


def ramp(levels: DataFrame) -> DataFrame:
    """The levels up to the first with a reason to stop, that one included."""
    before = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)  # a handful of levels
    return levels.withColumn("__stopped", F.max(F.col("abort_reason").isNotNull()).over(before)).where(~F.coalesce("__stopped", F.lit(False))).drop("__stopped")


def warning_histogram(records: DataFrame) -> DataFrame:
    return records.select("level", F.explode("warning_kinds").alias("kind")).groupBy("level", "kind").agg(F.count(F.lit(1)).alias("n"))


def stage_profile(stages: DataFrame) -> DataFrame:
    """stages: stage, inclusive, exclusive seconds of each call. Sums, and the share of all exclusive time."""
    out = stages.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("inclusive").alias("inclusive"), F.sum("exclusive").alias("exclusive"))
    total = out.agg(F.sum("exclusive").alias("__all"))
    return out.join(F.broadcast(total)).select("stage", "calls", "inclusive", "exclusive", F.when(F.col("__all") > 0, F.col("exclusive") / F.col("__all")).otherwise(0.0).alias("share"))


def slowest(calls: DataFrame, n: int = 5) -> DataFrame:
    return calls.orderBy(F.desc("seconds")).limit(n)
