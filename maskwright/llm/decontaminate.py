"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows (n consecutive words of an item; a shorter item is one window) are hashed into a
broadcast hash table. One pass over the documents forms a hash of every window of their words and
probes that table; a hit counts only if the words themselves are equal. The probe and the comparison
run inside one stage, so no text is shuffled: only hits are.

The broadcast has a stated bound, BLOCK windows: a larger benchmark is taken in blocks of BLOCK windows, one after
the other, each against all documents.

Words are runs of digits, letters and all characters beyond ASCII; A-Z are lower-cased. Rows: null text has no words; null or wordless
benchmark items have no windows; repeated documents (also under one doc_id) each give a row; a null doc_id is
an id like others; null item_ids count as the text 'null'. Empty tables give no hits. A word in several windows is hit once, an
item with several is listed once. Texts may be of any length: each is one row of words, whose windows are probed in place.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, stored

#: What a word doesn't contain: ASCII other than letters and digits. (Words are compared with A-Z lower-cased.)
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, BLOCK = 10, 200_000


def words(text: Column) -> Column:
    """The words in order, as they stand; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    """A-Z lower-cased. For a word of ASCII alone lower() does that, and is faster."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(lower_ascii(word))


def with_window_hashes(df: DataFrame, n: int) -> DataFrame:
    """df (with `w`, lower-cased words) with `hashes`: a hash of every n consecutive words, in about 2 log2(n) passes over the array.
    A window's hash is that of its two parts' hashes. Each pass is a projection of its own: Spark evaluates it once."""

    def joined(a: str, b: str, shift: int) -> Column:
        size = F.greatest(F.size(b) - shift, F.lit(0))
        return F.zip_with(F.slice(a, 1, size), F.slice(b, shift + 1, size), lambda x, y: F.xxhash64(x, y))

    rest = df.columns
    df = df.withColumn("__doubled", F.transform("w", lambda w: F.xxhash64(w)))
    length, done = 1, 0
    while True:
        if n & length:
            # `hashes` covers the first `done` words of the window, then come `length` more.
            df = df.withColumn("hashes", joined("hashes", "__doubled", done) if done else F.col("__doubled"))
            done += length
        if done == n:
            return df.select(*rest, "hashes")
        df = df.withColumn("__doubled", joined("__doubled", "__doubled", length))
        length *= 2


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """length, window (its words), items: one row for each different window."""
    of = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.transform(words(F.col("text")), lowered).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    starts = of.select("item", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"))
    return starts.select("item", "length", F.slice("w", F.col("at"), F.col("length")).alias("window")).groupBy("length", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find_hits(docs: DataFrame, windows: DataFrame, n: int, with_rows: bool) -> DataFrame:
    """doc_id, text_key, at (the window's first word, from 0), length, items, n_words for each occurrence of a window of n words;
    with_rows: also a row with null `at` for each row of docs. windows: at most BLOCK."""
    own = with_window_hashes(windows.where(F.col("length") == n).select(F.col("window").alias("w"), "items"), n)
    own = own.select(F.col("w").alias("window"), "items", F.element_at("hashes", 1).alias("hash"))
    hashed = with_window_hashes(docs, n)
    if with_rows:
        # The row of the document itself: a last element, without a hash.
        hashed = hashed.withColumn("hashes", F.array_append("hashes", F.lit(None).cast("long")))
    # The outer form: else Spark pushes a filter on the size of `hashes`, with all it is made of, down to the scan.
    each = hashed.select("doc_id", "text_key", "w", F.posexplode_outer("hashes").alias("at", "hash"))
    # Without lambdas from here on: probe and comparison are compiled into the loop over positions, which copies no `w`.
    same = F.slice(F.col("w"), F.col("at") + 1, F.lit(n)) == F.col("window")
    joined = each.join(F.broadcast(own), "hash", "left" if with_rows else "inner")
    hit = joined.where(F.col("hash").isNull() | F.col("window").isNotNull()).where(F.col("hash").isNull() | same)
    return hit.select("doc_id", "text_key", F.when(F.col("hash").isNotNull(), F.col("at")).alias("at"), F.lit(n).alias("length"), "items", F.size("w").alias("n_words"))


def keyed_docs(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, which tells apart texts that repeat a doc_id, and the words, lower-cased."""
    split = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text")).alias("w"))
    return split.withColumn("w", F.transform("w", lowered))


def by_document(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """For each different document: doc_id, text_key, copies (its rows), n_words, hit_at (sorted positions of hit
    words), items (sorted as strings)."""
    windows = stored(benchmark_windows(benchmark, n), "windows")
    sizes = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = max(1, -(-sum(sizes.values()) // block))
    source, hits = keyed_docs(docs), None
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        for length in sorted(sizes, reverse=True) or [n]:
            found = find_hits(source, part, length, with_rows=hits is None)
            hits = found if hits is None else hits.unionByName(found)
    at = F.col("at")
    grouped = hits.groupBy("doc_id", "text_key").agg(
        F.count(F.when(at.isNull(), 1)).alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(at.isNotNull(), F.struct("at", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hit_at = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    return grouped.select("doc_id", "text_key", "copies", "n_words", hit_at.alias("hit_at"), "items")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = by_document(docs, benchmark, n)
    rows = found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("hit_at").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_at") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, largest_share: float = 0.5) -> DataFrame:
    """Removes hit words from documents, with the text between neighbouring hit words, and drops documents of
    whose words more than largest_share are hit. Returns the columns of docs; all others stay as they are."""
    id_, key, at, drop, own_key, lead, tail = fresh(docs, "id", "text_key", "hit_at", "drop", "key", "lead", "tail")
    found = by_document(docs, benchmark, n).where(F.size("hit_at") > 0)
    found = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("hit_at").alias(at), (F.size("hit_at") > largest_share * F.col("n_words")).alias(drop))
    found = stored(found, "hits")
    # Where hits are few (at most 16 MB of rows and positions) the texts stay where they are.
    few = found.agg(F.sum(F.size(at) + 10)).first()[0] or 0
    found = F.broadcast(found) if few <= 4_000_000 else found
    own = docs.withColumn(own_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_key) == F.col(key)), "left")
    # Words and the gaps around them: gap 0, word 0, gap 1, ... A hit word goes together with the gap after it.
    hit = joined.where(F.coalesce(~F.col(drop), F.lit(True))).withColumn(lead, F.regexp_extract("text", f"^{BETWEEN}", 0))
    hit = hit.withColumn(tail, F.col("text").substr(F.length(lead) + 1, F.length("text")))
    kept = F.array_join(F.filter(F.transform(F.split(tail, f"(?<={BETWEEN[:-1]})(?!{BETWEEN[:-1]})"), lambda w, i: F.when(~F.array_contains(at, i), w)), lambda w: w.isNotNull()), "")
    return hit.withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(F.concat(lead, kept))).select(*docs.columns)
