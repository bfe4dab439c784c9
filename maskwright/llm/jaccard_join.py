"""N-gram Jaccard join by vertical partitioning.

1. Which n-grams stand in one document only? Blocks of documents cut their n-grams (hashes shortened to about 7 bits
   more than their number needs, which can only make an n-gram look more common) into fragments of the hash range;
   each fragment is merged on its own and answers with one bit for each n-gram.
2. In the global n-gram order, rarest first, a document that links with another must share one of its first
   n - ceil(t n) + 1 n-grams (t: the least similarity). Documents with as many n-grams that nobody shares are done.
3. The others are read again. Equal sets become one class. Their n-grams, ordered by (document frequency, hash), are
   cut by pivots into FRAGMENTS vertical fragments. Classes that share an n-gram of their prefixes are candidates;
   their overlap is counted in each fragment on its own and summed for each pair.
4. Each list of classes that share a prefix n-gram first compares its members with one member of its largest component.
   Once that has tied a large group together, its other pairs can't change the components; after ROUNDS rounds, the members
   outside each list's largest component are compared with all members of other components.
   Two parity bitmaps differ in at most as many bits as the sets differ in n-grams, which rules out most candidates.

Exact up to collisions of 64-bit hashes. Rows: null and wordless texts have empty sets and link with nothing; repeated
rows each give a row; rows of one doc_id are one node of the components; a null doc_id links with nothing and has no
component. An empty table gives no rows. Texts may be of any length: a set is never cut, and a block holds one long text at least.
Ties in the n-gram order go by hash; no result depends on them. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, fresh, input_bytes, let_go, removed, stored, texts_in_batches
from .components import components
from .shingles import pack, pack_sorted, shingle_set, unpack, unpack_sorted, word_hashes

WIDTH, PERCENT = 5, 80
#: Shingles of a block; hashes that a fragment should hold on average; bytes of input (as files) for each shingle.
BLOCK, PER_FRAGMENT, BYTES_A_SHINGLE = 1_200_000, 2_000_000, 4
FRAGMENTS = 4
#: Longs of a set's parity bitmap.
WORDS = 8
ROUNDS = 3
#: Ids that may be broadcast to where their texts are read again (16 MB); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
BLOCK_SCHEMA = "kind int, block long, fragment int, doc_id long, n long, payload binary"


def needed(percent: int, n: np.ndarray) -> np.ndarray:
    """The least overlap with any other set: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def _blocks(width: int, bits: int, fragments: int):
    """Rows of kind 0: a document and its number of shingles; 1: a block's sets; 2: a block's shingles of a fragment."""

    def rows(kind: int, block: int, fragment: list[int], doc_id: list, n: list[int], payload: list) -> pa.RecordBatch:
        m = max(len(doc_id), len(payload))
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * m, pa.int32()), pa.array([block] * m, pa.int64()), pa.array(fragment or [None] * m, pa.int32()), pa.array(doc_id or [None] * m, pa.int64()), pa.array(n or [None] * m, pa.int64()), pa.array(payload or [None] * m, pa.binary())],
            names=["kind", "block", "fragment", "doc_id", "n", "payload"],
        )

    def flush(block: int, ids: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.int64)
        yield rows(0, block, [], ids, sizes.tolist(), [])
        keep = [k for k, s in enumerate(sets) if len(s) and ids[k] is not None]
        if not keep:
            return
        short = np.concatenate([sets[k] >> np.uint64(64 - bits) for k in keep])
        unique, place, count = np.unique(short, return_inverse=True, return_counts=True)
        sizes = sizes[keep]
        step = np.diff(place, prepend=0)
        starts = np.cumsum(sizes) - sizes
        step[starts] = place[starts]
        body = [pack(np.array([ids[k] for k in keep], np.int64).astype(np.uint64)), pack(sizes), pack(step)]
        yield rows(1, block, [], [], [], [b"".join(len(x).to_bytes(8, "little") + x for x in body)])
        cut = np.searchsorted(unique, (np.arange(fragments + 1, dtype=np.float64) / fragments * 2.0**bits).astype(np.uint64) if bits < 64 else np.linspace(0, 2**64 - 1, fragments + 1).astype(np.uint64))
        cut[0], cut[-1] = 0, len(unique)
        some = [f for f in range(fragments) if cut[f] < cut[f + 1]]
        for f in some:
            a, b = cut[f], cut[f + 1]
            body = [pack_sorted(unique[a:b]), np.packbits(count[a:b] > 1).tobytes()]
            yield rows(2, block, [f], [], [], [b"".join(len(x).to_bytes(8, "little") + x for x in body)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("shingles")
        block = TaskContext.get().partitionId() << 32
        ids, sets, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sets.append(shingle_set(text.as_py(), width))
                ids.append(doc_id)
                size += len(sets[-1])
                if size >= BLOCK or len(ids) >= 200_000:
                    yield from flush(block, ids, sets)
                    block, ids, sets, size = block + 1, [], [], 0
        if ids:
            yield from flush(block, ids, sets)
        del ids, sets
        word_hashes.cache_clear()
        let_go()

    return run


def parts(payload: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(payload):
        n = int.from_bytes(payload[at : at + 8], "little")
        out.append(payload[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """For one fragment: of each block's shingles, a bit that says if any other document has it."""
    bodies = [parts(p) for p in frame["payload"]]
    each = [unpack_sorted(b[0]) for b in bodies]
    every = np.concatenate(each)
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for values, body in zip(each, bodies, strict=True):
        at = np.searchsorted(twice, values)
        found = np.zeros(len(values), bool) if not len(twice) else twice[np.minimum(at, len(twice) - 1)] == values
        found |= np.unpackbits(np.frombuffer(body[1], np.uint8), count=len(values)).astype(bool)
        out.append(len(values).to_bytes(8, "little") + np.packbits(found).tobytes())
    del each, every, twice
    let_go()
    return pd.DataFrame({"block": frame["block"], "fragment": frame["fragment"], "answer": out})


def _survivors(percent: int):
    def run(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or answers.empty:
            return pd.DataFrame({"doc_id": np.zeros(0, np.int64)})
        ids, sizes, step = (unpack(x) for x in parts(docs["payload"].iloc[0]))
        ids, sizes, step = ids.astype(np.int64), sizes.astype(np.int64), step.astype(np.int64)
        answers = answers.sort_values("fragment")["answer"]
        shared = np.concatenate([np.unpackbits(np.frombuffer(a[8:], np.uint8), count=int.from_bytes(a[:8], "little")) for a in answers]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        total = np.cumsum(step)
        place = total - np.repeat(total[starts] - step[starts], sizes)
        alone = np.add.reduceat(1 - shared[place], starts)
        return pd.DataFrame({"doc_id": ids[alone < sizes - needed(percent, sizes) + 1]})

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sets = [shingle_set(t, width) for t in some.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                sign = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                odd = np.array([np.packbits(np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1).view(np.int64) for s in sets]).reshape(-1)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * WORDS), pa.array(odd))
                yield pa.RecordBatch.from_arrays([some.column(0), sign, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), bits], names=["doc_id", "sign", "grams", "bits"])
        word_hashes.cache_clear()
        let_go()

    return run


def partial_overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs (a, b) with overlap: the sum of the overlaps in each vertical fragment. segments: rep, fragment, grams."""
    left = segments.select(F.col("rep").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("rep").alias("b"), F.col("fragment").alias("fb"), F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, "b").where(F.col("fragment") == F.col("fb"))
    return both.select("a", "b", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part")).groupBy("a", "b").agg(F.sum("part").alias("overlap"))


def similar_pairs(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    counted = partial_overlaps(pairs, segments)
    na, nb = sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb"))
    o = F.col("overlap")
    return counted.join(na, "a").join(nb, "b").where(100 * o >= percent * (F.col("na") + F.col("nb") - o)).select("a", "b")


def class_links(classes: DataFrame, percent: int) -> DataFrame:
    """classes: rep, n, grams, bits (different sets). Links a, b that have the same components as all similar pairs."""
    sizes = classes.select("rep", "n")
    grams = classes.select("rep", F.explode("grams").alias("gram"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    postings = grams.join(df, "gram").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("ordered"))
    # Of a set's prefix only what others have can bring candidates; the n-grams that nobody shares come first.
    allowed = (F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 - (F.col("n") - F.size("ordered"))).cast("int")
    own = stored(postings.join(sizes, "rep").withColumn("prefix", allowed).where("prefix > 0"), "ordered")
    lists = stored(own.select("rep", "n", F.posexplode(F.transform(F.slice("ordered", 1, F.col("prefix")), lambda x: x["gram"])).alias("at", "gram")), "lists")
    rank = lambda o: o["df"] * F.lit(1 << 20) + F.pmod(o["gram"], F.lit(1 << 20))
    pivots = own.select(F.explode("ordered").alias("o")).agg(F.percentile_approx(rank(F.col("o")), [k / FRAGMENTS for k in range(1, FRAGMENTS)], 1000)).first()[0] or []
    edges = [None, *pivots, None]

    def fragment(lo: int | None, hi: int | None):
        inside = lambda o: (rank(o) > lo if lo is not None else F.lit(True)) & (rank(o) <= hi if hi is not None else F.lit(True))
        return F.transform(F.filter("ordered", inside), lambda o: o["gram"])

    cut = F.array(*[fragment(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)])
    segments = stored(own.select("rep", F.posexplode(cut).alias("fragment", "grams")).where(F.size("grams") > 0), "segments")
    own_bits = classes.select("rep", "bits")

    def close(na: str, nb: str, x: str, y: str):
        """Sizes and bitmaps allow an overlap of percent of the union: 2 percent (na + nb) <= (100 + percent) (na + nb - differing bits)."""
        apart = sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(WORDS)), F.lit(0))
        both = F.col(na) + F.col(nb)
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (2 * percent * both <= (100 + percent) * (both - apart))

    found, tested, done = None, None, []
    comp = sizes.select("rep", F.col("rep").alias("component"))
    for r in range(ROUNDS):
        tied = lists.select("gram", "rep").join(comp, "rep")
        largest = _largest(tied, r)
        # One member of each list's largest component, the same for most lists of a group.
        pairs = tied.join(largest, "gram").where("component <> most").select(F.least("rep", "pick").alias("a"), F.greatest("rep", "pick").alias("b")).distinct()
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        info = sizes.join(own_bits, "rep")
        pairs = pairs.join(info.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a").join(info.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
        done.append(pairs := stored(pairs.where(close("na", "nb", "xa", "xb")).select("a", "b"), "pairs"))
        new = stored(similar_pairs(pairs, segments, sizes, percent), "links")
        found = new if found is None else found.unionByName(new)
        tested = pairs if tested is None else tested.unionByName(pairs)
        comp = stored(_merged(comp, new), "tied")
    tied = lists.select("gram", "at", "rep", "n").join(comp, "rep")
    largest = _largest(tied, ROUNDS)
    mixed = largest.where("m < total").select("gram", "most")
    tied = tied.join(mixed, "gram")
    heads = tied.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("at", "gram"))).alias("h")).select("rep", F.transform("h", lambda x: x["gram"]).alias("head"))
    tied = stored(tied.join(heads, "rep").join(own_bits, "rep"), "tied")
    x = tied.where("component <> most").select("gram", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("head").alias("ha"), F.col("bits").alias("xa"))
    y = tied.select(F.col("gram").alias("g2"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), (F.col("component") == F.col("most")).alias("main"), F.col("head").alias("hb"), F.col("bits").alias("xb"))
    # A pair counts once: at the first n-gram that the two prefixes share.
    first = F.element_at(F.array_intersect("ha", "hb"), 1) == F.col("gram")
    on = (F.col("gram") == F.col("g2")) & (F.col("ca") != F.col("cb")) & (F.col("main") | (F.col("a") < F.col("b"))) & close("na", "nb", "xa", "xb") & first
    rest = x.join(y, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = stored(rest.join(tested, ["a", "b"], "left_anti"), "pairs")
    new = stored(similar_pairs(rest, segments, sizes, percent), "links")
    removed(own, lists, segments, tied, rest, comp, *done)
    return stored(found.unionByName(new), "links")


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (rep, component) after the components that `links` join have merged, as far as the smallest within two links goes. What
    remains apart only costs comparisons; components() closes over all links at the end."""
    a, b = comp.select(F.col("rep").alias("a"), F.col("component").alias("x")), comp.select(F.col("rep").alias("b"), F.col("component").alias("y"))
    ties = links.join(a, "a").join(b, "b").where("x <> y").select("x", "y")
    ties = ties.unionByName(ties.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    one = ties.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m"))
    two = ties.join(one.select(F.col("x").alias("y"), "m"), "y").groupBy("x").agg(F.min("m").alias("m2"))
    moved = one.join(two, "x").select(F.col("x").alias("component"), F.least("m", "m2").alias("to"))
    return comp.join(moved, "component", "left").select("rep", F.coalesce("to", "component").alias("component"))


def _largest(tied: DataFrame, r: int) -> DataFrame:
    """For each gram of tied (gram, rep, component): most (the component with most members in its list), m (how many), total, and
    pick, a member of it. Two aggregations that Spark combines before their shuffles."""
    counts = tied.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("m"), F.min_by("rep", F.xxhash64("rep", F.lit(r))).alias("pick"))
    best = F.max(F.struct("m", F.xxhash64("pick", F.lit(r)).alias("h"), "component", "pick"))
    return counts.groupBy("gram").agg(best.alias("x"), F.sum("m").alias("total")).select("gram", F.col("x.component").alias("most"), F.col("x.m").alias("m"), F.col("x.pick").alias("pick"), "total")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    expected = max(1 << 16, input_bytes(docs) // BYTES_A_SHINGLE)
    bits, fragments = min(64, math.ceil(math.log2(expected)) + 7), max(2, math.ceil(expected / PER_FRAGMENT))
    texts_in_batches(docs)
    blocks = stored(docs.mapInArrow(_blocks(width, bits, fragments), BLOCK_SCHEMA), "blocks")
    asked = blocks.where("kind = 2").select("block", "fragment", "payload")
    answers = asked.groupBy("fragment").applyInPandas(_shared, "block long, fragment int, answer binary")
    sets = blocks.where("kind = 1").select("block", "payload")
    left = sets.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_survivors(percent), "doc_id long")
    left = stored(left.distinct(), "survivors")
    rows = stored(blocks.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles")), "rows")
    removed(blocks)
    chosen = F.broadcast(left) if left.count() <= MOST_BROADCAST else left
    again = docs.join(chosen, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(width), "doc_id long, sign binary, grams array<long>, bits array<long>")
    again = stored(again.where(F.size("grams") > 0), "sets")
    # One row of each class carries the set; all others only their sign.
    reps = again.groupBy("sign").agg(F.min("doc_id").alias("rep"))
    member = again.select("doc_id", "sign").distinct().join(reps, "sign")
    holder = again.join(reps, "sign").where(F.col("doc_id") == F.col("rep")).select("sign", "rep", "grams", "bits").dropDuplicates(["sign"])
    classes = stored(holder.withColumn("c", F.monotonically_increasing_id()), "classes")
    found = class_links(classes.select(F.col("c").alias("rep"), F.size("grams").cast("long").alias("n"), "grams", "bits"), percent)
    names = classes.select("c", "rep")
    named = found.join(names.select(F.col("c").alias("a"), F.col("rep").alias("ra")), "a").join(names.select(F.col("c").alias("b"), F.col("rep").alias("rb")), "b")
    ties = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionByName(ties))
    return rows.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of docs, whatever their names, whose doc_id is its component's smallest (or null); of rows that repeat a doc_id
    all stay, and so do null and empty texts. An empty table gives none."""
    (name,) = fresh(docs, "gone")
    gone = stored(jaccard_components(docs, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti").select(*docs.columns)
