"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosine, connected components.

Vectors of one label that are equal become one representative with a count. Each representative gets, in each of
several tables, the signs of its products with random hyperplanes; those that share label, table and signs form a bucket.
Within a bucket all pairs are compared by cosine in double precision; a pair counts in the first table in which it
meets, so no pair counts twice and no shuffle of pairs is needed. A bucket answers with how many vectors each of its own links to and
with a spanning forest of its links, never with the links: rows grow with the bucket, not with its square. Buckets of more than BLOCK
vectors are dealt as pairs of blocks over many tasks.

The number of hyperplanes grows with the logarithm of the largest label's size and the number of tables with it,
so that a pair at the threshold is missed with a probability of at most MISS.

Rows: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label, link with nothing.
Vectors of different lengths don't compare. Rows that repeat a vec_id count as one vector if label and embedding are equal;
otherwise each is compared and the id carries the sum of its links. A null vec_id links with nothing. Labels may be of any type that
casts to text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored
from .components import components

LEAST_COSINE, MISS, BLOCK, SEED = 0.93, 1e-4, 1000, 20
#: Vectors of a label that one bucket should hold on average.
PER_BUCKET = 8


def plan(largest: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """Hyperplanes of a table, and tables."""
    same = 1 - math.acos(cosine) / math.pi
    bits = min(60, max(4, math.ceil(math.log2(max(largest, 2) / PER_BUCKET))))
    return bits, math.ceil(math.log(miss) / math.log1p(-(same**bits)))


def hyperplanes(length: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, n))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows that can link."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), v.alias("embedding")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return own.where(~bad & F.exists("embedding", lambda x: x != 0))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def signatures(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """reps (rep, label, embedding, copies) with `signs`: an array of one long for each table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for frame in frames:
            signs = [None] * len(frame)
            lengths = frame["embedding"].map(len)
            for n in lengths.unique():
                at = np.flatnonzero(lengths == n)
                side = (_unit(np.array(frame["embedding"].iloc[at].tolist(), np.float64)) @ hyperplanes(int(n), bits * tables)) > 0
                codes = side.reshape(len(at), tables, bits) @ powers
                for k, c in zip(at, codes, strict=True):
                    signs[k] = c
            yield frame.assign(signs=signs)

    return reps.mapInPandas(run, "rep long, label string, embedding array<double>, copies long, signs array<long>")


def links(reps: DataFrame, cosine: float, tables: int) -> DataFrame:
    """reps: rep, label, embedding, copies, signs. What the pairs of one label tell that some table brings together, with cosine >= `cosine`:
    rows a, n (b null), whose sum over a is the number of copies that a links to, and rows a, b (n null), which join the same representatives
    as the pairs do."""
    size = F.size("embedding")
    key = ["label", "length", "t", "code"]
    codes = reps.select("label", size.alias("length"), F.posexplode("signs").alias("t", "code"))
    big = stored(codes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "big")
    rows = reps.select("rep", "label", "embedding", "copies", "signs", size.alias("length"), F.posexplode("signs").alias("t", "code"))
    dealt = rows.join(big, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A row of block i goes to the tasks (i, j) and (j, i) of its bucket; in a small bucket to (0, 0) only.
    pairs = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(*key, "rep", "embedding", "copies", "signs", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # Buckets are small and many: a task sorts its own and cuts them in the stream, which costs far less than a call for each.
    together = pairs.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")
    return together.mapInArrow(_compared(cosine), "a long, b long, n long")


def _compared(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows]).combine_chunks()
            if not len(rows):
                continue
            starts = _starts(rows)
            left = rows.slice(starts[-1])
            yield _of_buckets(rows, starts, cosine)
        if left is not None and len(left):
            left = left.combine_chunks()
            yield _of_buckets(left, np.array([0, len(left)]), cosine)

    return run


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a block's rows begin."""
    labels = rows["label"].combine_chunks()
    label = labels.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = label[1:] != label[:-1]
    for name in ("length", "t", "code", "i", "j"):
        x = rows[name].to_numpy()
        new |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _lists(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's values begin, and the values of all rows."""
    column = rows[name].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy()


def _of_buckets(rows: pa.Table, starts: np.ndarray, cosine: float) -> pa.RecordBatch:
    """The answers of the blocks that begin at all of starts but the last, which ends the one before it."""
    rep, copies, own, t, i, j = (rows[name].to_numpy() for name in ("rep", "copies", "own", "t", "i", "j"))
    (v_at, vectors), (s_at, signs) = _lists(rows, "embedding"), _lists(rows, "signs")
    out = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if hi - lo > 1:
            v, sign = vectors[v_at[lo] : v_at[hi]].reshape(hi - lo, -1), signs[s_at[lo] : s_at[hi]].reshape(hi - lo, -1)
            n, tree = _of_bucket(rep[lo:hi], copies[lo:hi], own[lo:hi], _unit(v), sign[:, : t[lo]], int(i[lo]), int(j[lo]), cosine)
            some, tied = np.flatnonzero(n), np.flatnonzero(tree != np.arange(hi - lo))
            if len(some):
                out[0].append(np.stack([rep[lo + some], n[some]]))
                out[1].append(np.stack([rep[lo + tied], rep[lo + tree[tied]]]))
    counts, ties = (np.concatenate(x, 1) for x in out)
    none = lambda x: pa.nulls(x.shape[1], pa.int64())
    b, n = pa.concat_arrays([none(counts), pa.array(ties[1])]), pa.concat_arrays([pa.array(counts[1]), none(ties)])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([counts[0], ties[0]])), b, n], names=["a", "b", "n"])


def _of_bucket(rep: np.ndarray, copies: np.ndarray, own: np.ndarray, v: np.ndarray, before: np.ndarray, i: int, j: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For the pairs of blocks i and j: how many copies each row links to, and the least row of its component. before: signs of the earlier tables."""
    left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j))
    n, tree = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        x, y = np.nonzero(v[rows] @ v[right].T >= cosine - 1e-9)
        x, y = rows[x], right[y]
        once = rep[x] != rep[y] if i != j else rep[x] < rep[y]
        x, y = x[once], y[once]
        for k in range(0, len(x), 20_000):
            p, q = x[k : k + 20_000], y[k : k + 20_000]
            ok = np.einsum("ij,ij->i", v[p], v[q]) >= cosine
            if before.shape[1]:
                ok &= ~(before[p] == before[q]).any(axis=1)
            p, q = p[ok], q[ok]
            np.add.at(n, p, copies[q])
            np.add.at(n, q, copies[p])
            tree = _joined(tree, p, q)
    return n, tree


def _joined(tree: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """tree: the least node of each node's component. The same after the links p, q."""
    while True:
        x, y = tree[p], tree[q]
        apart = x != y
        if not apart.any():
            return tree
        tree = tree.copy()
        np.minimum.at(tree, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := tree[tree], tree):
            tree = up


def near_duplicates(rows: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """One row for each row of the table: vec_id, n_links, component_id, kept."""
    good = stored(usable(rows).distinct().withColumn("key", F.xxhash64("label", "embedding")), "vectors")
    classes = good.groupBy("key", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # One id may stand in several classes (it repeats with different vectors), so classes have their own numbers.
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan(largest, cosine)
    signed = stored(signatures(classes.select(F.col("c").alias("rep"), "label", "embedding", "copies"), bits, tables), "signatures")
    found = stored(links(signed, cosine, tables), "links")
    linked = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    info = classes.select("key", "label", "embedding", "c", "rep", "copies").join(linked, F.col("c") == F.col("a"), "left")
    info = info.select("key", "label", "embedding", "rep", "c", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    member = stored(good.join(info, ["key", "label", "embedding"]).select("vec_id", "rep", "c", "n"), "members")
    removed(signed)
    # Components of ids: a class ties its members to its smallest id, a link ties two classes.
    reps = classes.select("c", "rep")
    class_links = found.where("b IS NOT NULL").join(reps.select(F.col("c").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("c").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    own = member.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    comp = components(class_links.unionByName(own))
    per_id = member.groupBy("vec_id").agg(F.sum("n").cast("long").alias("n_links"))
    out = rows.select(F.col("vec_id").cast("long")).join(per_id, "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
