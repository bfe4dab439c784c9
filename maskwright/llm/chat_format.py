"""Reply trees to conversations, with DataFrame functions only.

A reply tree is a table of messages: tree, node, parent (null: a root), role, text, score. Self-joins
that double their reach find each message's distance from its root and the score of its path; leaves are
ranked by the score of their root-to-leaf path; the same jumps, taken back, list the messages of each chosen
path; each path becomes one formatted conversation. Depth d takes about log2(d) joins, so a thread of
thousands of replies needs a dozen.

Format of a message: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash follows the
first character of every control string and precedes every backslash, which undoes exactly; so no control
string, of this template or of the others in CONTROL, can come out of a text.

Rows: null role and null text are empty; null scores are 0; ties between branches go to the smaller
node. A message whose parent is missing from its tree is a root. Messages on a cycle have no root and
form no path. Rows that repeat a node: the first by (parent, role, text) counts in a tree; in a table of turns
all rows stay, ordered by (turn, role, text). A null tree is a tree of its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that no text may contain once it is escaped.
CONTROL = [START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def message(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), escape(text), F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), as they were before formatting."""
    bodies = F.filter(F.split(formatted, r"\Q<|im_end|>\E\n"), lambda p: p != "")
    # A role ends at the first line break that no backslash precedes.
    head = lambda p: F.regexp_extract(F.substring(p, len(START) + 1, 2_147_483_647), r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
    text = lambda p: F.substring(p, F.length(head(p)) + len(START) + 2, F.lit(2_147_483_647))
    return F.transform(bodies, lambda p: F.struct(unescape(head(p)).alias("role"), unescape(text(p)).alias("text")))


def jump_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For k = 0, 1, ...: (tree, node, up) with up the ancestor 2^k above, and at the end one row for each node
    that a root reaches: tree, node, root, depth, path_score."""
    from .common import stored

    step = nodes.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("far"), F.col("score").alias("sum"))
    tables: list[DataFrame] = []
    ended: DataFrame | None = None
    # No path is longer than the number of messages: what then still jumps runs in a cycle.
    for k in range(nodes.count().bit_length() + 1):
        step = stored(step, f"jumps-{k}")
        # A node whose jump passed its root has no `up`: its distance and sum are complete.
        done, active = step.where(F.col("up").isNull()), step.where(F.col("up").isNotNull())
        ended = done if ended is None else ended.unionByName(done)
        if active.isEmpty():
            break
        tables.append(active.select("tree", "node", "up"))
        every = ended.unionByName(active)
        above = every.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("sum").alias("sum2"))
        step = active.join(above, active["tree"].eqNullSafe(above["t2"]) & (active["up"] == above["n2"])).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), (F.col("sum") + F.col("sum2")).alias("sum")
        )
    return tables, ended.select("tree", "node", F.col("far").alias("depth"), F.col("sum").alias("path_score"))


def choose_paths(messages: DataFrame, paths: int | None = 1) -> DataFrame:
    """The messages of the `paths` best root-to-leaf paths of each tree (all, for None): tree, path (its rank
    from 1), path_score, depth (1 at the root), role, text."""
    from .common import stored

    rows = messages.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).where(F.col("node").isNotNull())
    first = Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")
    rows = stored(rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n"), "messages")
    known = rows.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    linked = stored(rows.join(known, rows["tree"].eqNullSafe(known["t2"]) & (rows["parent"] == known["n2"]), "left").select("tree", "node", F.col("n2").alias("parent"), "score"), "linked")
    tables, ended = jump_tables(linked)
    parents = linked.where(F.col("parent").isNotNull()).select(F.col("tree").alias("t2"), F.col("parent").alias("n2")).distinct()
    leaves = ended.join(parents, ended["tree"].eqNullSafe(parents["t2"]) & (ended["node"] == parents["n2"]), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("path_score").desc(), "node")
    leaves = leaves.withColumn("path", F.row_number().over(best).cast("long"))
    leaves = leaves if paths is None else leaves.where(F.col("path") <= paths)
    on_path = stored(leaves.select("tree", "path", "path_score", "node", "depth"), "paths")
    for k in reversed(range(len(tables))):
        ups = tables[k].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        above = on_path.join(ups, on_path["tree"].eqNullSafe(ups["t2"]) & (on_path["node"] == ups["n2"])).select("tree", "path", "path_score", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        on_path = stored(on_path.unionByName(above), "paths")  # else the plan doubles in each round
    texts = rows.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "role", "text")
    return on_path.join(texts, on_path["tree"].eqNullSafe(texts["t2"]) & (on_path["node"] == texts["n2"])).select("tree", "path", "path_score", "depth", "role", "text")


def format_conversations(chosen: DataFrame) -> DataFrame:
    """One row for each path: tree, path, path_score, formatted, loss_mask (array of start and end, in code points
    of `formatted`: the texts of TRAINED_ROLE)."""
    one = chosen.select("tree", "path", "path_score", F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), message(F.col("role"), F.col("text")).alias("m"), F.length(escape(F.col("text"))).alias("n")).alias("turn"))
    grouped = one.groupBy("tree", "path", "path_score").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        after = acc["at"] + F.length(t["m"])
        last = after - len(END) - 1
        span = F.struct((last - t["n"]).alias("start"), last.alias("end"))
        return F.struct(after.alias("at"), F.when(t["role"] == TRAINED_ROLE, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return grouped.select("tree", "path", "path_score", F.array_join(F.transform("turns", lambda t: t["m"]), "").alias("formatted"), F.aggregate("turns", zero, step)["spans"].alias("loss_mask"))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(conversations: DataFrame) -> DataFrame:
    """What the formatted rows say when they are read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = conversations.withColumn("__turns", parse(F.col("formatted"))).withColumn("__loss", masked_text(F.col("formatted"), F.col("loss_mask")))
    lines = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def turns_as_trees(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as reply trees: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select("conv_id", "turn", "role", "text").withColumn("node", node).select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def own_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: texts that look like control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))


def chat_digest(turns: DataFrame) -> DataFrame:
    """Formats all conversations plus conversation -7 and reads them back from the written output."""
    from .common import stored

    rows = turns.select("conv_id", "turn", "role", "text").unionByName(own_conversation(turns.sparkSession))
    return digest(stored(format_conversations(choose_paths(turns_as_trees(rows))), "conversations"))
