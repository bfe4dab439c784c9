"""Precision and recall of spans against token labels, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import patterns as P


def coarse(label: Column) -> Column:
    table = F.create_map(*[x for k, v in P.COARSE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, label), label)


def aligned(text: Column, tokens: Column) -> Column:
    """For each token its start and end in the text: searched on from the last one's end, else from the start; null if it isn't there."""
    low = F.lower(text)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        here = F.call_function("locate", F.lower(token), low, acc["at"] + 1)
        any_ = F.call_function("locate", F.lower(token), low, F.lit(1))
        at = F.when(here > 0, here).otherwise(any_)
        place = F.when(at > 0, F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(token)).cast("int").alias("end")))
        return F.struct(F.when(at > 0, at - 1 + F.length(token)).otherwise(acc["at"]).cast("int").alias("at"), F.array_append(acc["out"], place).alias("out"))

    return F.aggregate(tokens, zero, step)["out"]


def gold_spans(rows: DataFrame) -> DataFrame:
    """rows: row, text, tokens, ner_tags (BIO). row, start, end, category: neighbouring tokens of one category, unless a B- begins anew.
    Rows with different numbers of tokens and tags are left out."""
    good = rows.where(F.size("tokens") == F.size("ner_tags"))
    each = good.select("row", F.posexplode(F.arrays_zip(aligned(F.col("text"), F.col("tokens")).alias("place"), F.col("ner_tags").alias("tag"))).alias("k", "x"))
    tag = F.col("x.tag")
    base = F.when((tag != "O") & F.col("x.place").isNotNull(), coarse(F.substring(tag, 3, 1000)))
    each = each.select("row", "k", F.col("x.place.start").alias("start"), F.col("x.place.end").alias("end"), base.alias("category"), tag.startswith("B-").alias("begins"))
    order = Window.partitionBy("row").orderBy("k")
    fresh = F.col("begins") | F.col("category").isNull() | ~F.col("category").eqNullSafe(F.lag("category").over(order))
    islands = each.withColumn("island", F.sum(fresh.cast("int")).over(order)).where(F.col("category").isNotNull())
    return islands.groupBy("row", "island", "category").agg(F.min_by("start", "k").alias("start"), F.max_by("end", "k").alias("end")).select("row", "start", "end", "category")


def merge_adjacent(spans: DataFrame, gap: int = 2) -> DataFrame:
    """Joins neighbours of one category with at most `gap` characters between."""
    order = Window.partitionBy("row").orderBy("start", "end")
    fresh = ~(F.col("category").eqNullSafe(F.lag("category").over(order)) & (F.col("start") - F.lag("end").over(order) <= gap))
    return spans.withColumn("island", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order)).groupBy("row", "island", "category").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def matches(gold: DataFrame, predicted: DataFrame, by: tuple[str, ...] = ("row",)) -> DataFrame:
    """side (gold, pred), category, hit (an overlapping span of the same category) and covered (of any) for each span. The join
    is on `by` and overlap; a row's spans are few."""

    def one(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
        a = a.withColumn("__id", F.monotonically_increasing_id())
        other = b.select(*(F.col(c).alias(f"o_{c}") for c in (*by, "start", "end", "category")))
        on = (F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end"))
        for c in by:
            on = on & (F.col(c) == F.col(f"o_{c}"))
        found = a.join(other, on, "left").groupBy("__id", *by, "start", "end", "category").agg(F.max(F.coalesce(F.col("o_category") == F.col("category"), F.lit(False))).alias("hit"), F.max(F.col("o_category").isNotNull()).alias("covered"))
        return found.select(F.lit(side).alias("side"), *by, "start", "end", "category", "hit", "covered")

    return one(gold, predicted, "gold").unionByName(one(predicted, gold, "pred"))


def scores(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """By category, for PERSON+LOCATION and for ALL: gold, pred, precision, recall, f1, covered share, missed. 0 where nothing is there."""
    named = F.explode(F.array_compact(F.array("category", F.when(F.col("category").isin("PERSON", "LOCATION"), F.lit("PERSON+LOCATION")), F.lit("ALL")))).alias("name")
    n = lambda side, cond=None: F.sum(((F.col("side") == side) & (F.lit(True) if cond is None else F.col(cond))).cast("long"))
    counted = found.select(*by, "side", "hit", "covered", named).groupBy(*by, "name").agg(
        n("gold").alias("n_gold"), n("pred").alias("n_pred"), n("gold", "hit").alias("gold_hit"), n("pred", "hit").alias("pred_hit"), n("gold", "covered").alias("gold_covered")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = counted.withColumn("precision", ratio("pred_hit", "n_pred")).withColumn("recall", ratio("gold_hit", "n_gold"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))).withColumn("covered", ratio("gold_covered", "n_gold")).withColumn("missed", F.col("n_gold") - F.col("gold_covered"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Scores of two variants side by side, with the differences."""
    pick = lambda df, x: df.select("name", *(F.col(c).alias(f"{c}_{x}") for c in ("precision", "recall", "f1")))
    both = pick(a, "a").join(pick(b, "b"), "name", "full")
    return both.select("name", *both.columns[1:], *((F.coalesce(f"{c}_b", F.lit(0.0)) - F.coalesce(f"{c}_a", F.lit(0.0))).alias(f"{c}_delta") for c in ("precision", "recall", "f1")))


def errors(found: DataFrame, n: int = 20) -> DataFrame:
    """The first n of each category and kind: TRUEMISS (nothing overlaps), MISMATCH (only other categories do), FP."""
    kind = F.when((F.col("side") == "gold") & ~F.col("covered"), "TRUEMISS").when((F.col("side") == "gold") & ~F.col("hit"), "MISMATCH").when((F.col("side") == "pred") & ~F.col("hit"), "FP")
    order = Window.partitionBy("category", "kind").orderBy("row", "start", "end")
    return found.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("category", "kind", "n", "row", "start", "end")


def demo(results: DataFrame, n: int = 5) -> DataFrame:
    """Masked text and mapping of n rows, to look at."""
    return results.select("masked", "mapping").limit(n)
