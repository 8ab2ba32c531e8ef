"""Chat formatting as a prefix tree: shared turns once, depth first, with positions and ancestor attention intervals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm import bpe
from kestrel.session import cut

#: A turn as tokens are made of it.
TEMPLATE = "<|{role}|>\n{text}\n"


def _read(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, own, role, text) of the rows that have a conv_id; own is the digest of role and text."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    c = conversations.where(conversations["conv_id"].isNotNull())
    return c.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), own.alias("own"), role.alias("role"), text.alias("text"))


def _encoded(rows: DataFrame, ranks: str | None, name: str) -> DataFrame:
    """rows with tokens, or their number as size, in place of text; role stays if it is only counted."""
    path, count = ranks or bpe.default_ranks(), name == "size"
    keep = [c for c in rows.columns if c != "text" and (count or c != "role")]

    def run(batches):
        enc = bpe.encoding(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                role, text = (part.column(part.schema.get_field_index(x)).to_pylist() for x in ("role", "text"))
                ids = [bpe.encode(TEMPLATE.format(role=r, text=t), enc) for r, t in zip(role, text, strict=True)]
                made = pa.array([len(x) for x in ids], pa.int64()) if count else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), made], [*keep, name])

    fields = ", ".join(f"{c} {t}" for c, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(run, f"{fields}, {name} {'long' if count else 'array<int>'}")


def _number(value: Column) -> Column:
    return F.lpad(F.hex(value), 8, "0")


def _chain(conversations: DataFrame, ranks: str | None) -> DataFrame:
    """(conv_id, depth, tree, own, size, a, b, up_a, up_b, last): each turn with its node's id and the one above it.

    A node's id is its depth and 128 bits (a, b): the exclusive or of a hash of
    each turn up to it at its place, a running sum that takes no more room
    however deep the node is. tree is the digest of the first turn.
    """
    ids = _encoded(_read(conversations), ranks, "size").distinct()  # combined before it is shuffled, without the texts
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "own")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = ids.withColumn("depth", F.row_number().over(order) - 1).withColumn("last", F.lead("own").over(order).isNull())
    rows = rows.withColumn("h", F.xxhash64("own", "depth", F.lit(1))).withColumn("k", F.xxhash64("own", "depth", F.lit(2)))
    rows = rows.withColumn("a", F.bit_xor("h").over(upto)).withColumn("b", F.bit_xor("k").over(upto)).withColumn("tree", F.first("own").over(upto))
    return cut(rows.select("conv_id", "depth", "tree", "own", "size", "a", "b", F.col("a").bitwiseXOR(F.col("h")).alias("up_a"), F.col("b").bitwiseXOR(F.col("k")).alias("up_b"), "last"), "turns")


def _running(nodes: DataFrame) -> DataFrame:
    """nodes with start, the tokens before each in its tree's depth-first order, and node, its number there.

    Rows are range-partitioned by (tree, path), so a tree of any size spreads
    over partitions; each partition's last tree hands its sum on through a
    table of one row a partition and tree.
    """
    rows = cut(nodes.repartitionByRange("tree", "path").sortWithinPartitions("tree", "path").withColumn("part", F.spark_partition_id()), "nodes")
    w = Window.partitionBy("part", "tree").orderBy("path")
    sums = rows.groupBy("tree", "part").agg(F.sum("size").alias("s"), F.count("*").alias("k"))
    upto = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("tree", "part", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("s"), F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("k"))
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = [F.col(c) for c in nodes.columns]
    return rows.join(carry, ["tree", "part"]).select(*own, (F.col("s") + before).alias("start"), (F.col("k") + F.row_number().over(w) - 1).alias("node"))


def prefix_tree(conversations: DataFrame, ranks: str | None = None) -> DataFrame:
    """One row a node, that is a distinct sequence of initial turns: (tree, node, depth, conv_ids, start, tokens, positions, attend).

    Conversations of one first turn make a tree, named by its digest. Node
    numbers and starts follow the tree's depth-first order, of siblings the
    one that most conversations take last and the others by digest. `start` is
    the node's place in the tree's token sequence; `positions` count from the
    root along the node's own path, so they equal those of the conversation
    alone; `attend` has the intervals [from, to) of the sequence that its
    tokens see: each ancestor's, and last its own, within which attention is
    causal, so it is as long as the node is deep. `conv_ids` are the
    conversations that end here.

    A conversation's turns are ordered by (turn, role, digest), nulls first,
    and numbered anew, so tied turns follow one another. Rows without a
    conv_id are left out, repeated rows of a turn count once, a null role or
    text is an empty one, texts of any length are encoded whole, an empty
    table gives no rows, and other columns are ignored.
    """
    chain, place = _chain(conversations, ranks), ["depth", "a", "b"]
    # Every node once, its least conversation to stand for it, and how many conversations pass.
    nodes = cut(chain.groupBy(*place, "up_a", "up_b").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("own").alias("own"), F.array_sort(F.collect_list(F.when(F.col("last"), F.col("conv_id")))).alias("conv_ids")), "tree")
    # A node's most taken child goes on its path; each other one adds its digest, so a path has at most log2(conversations) of them.
    heavy = nodes.groupBy("depth", "up_a", "up_b").agg(F.max_by(F.struct("a", "b"), F.struct("n", "own")).alias("x")).select("depth", "x.a", "x.b", F.lit(True).alias("heavy"))
    known = nodes.select(*place, F.col("conv_id").alias("by")).join(heavy, place, "left")
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("heavy").isNull() & (F.col("depth") > 0), F.concat(_number(F.col("depth") - 1), F.hex("own")))
    paths = chain.join(known, place).withColumn("path", F.concat(F.array_join(F.collect_list(turn).over(upto), ""), _number(F.col("depth"))))
    placed = cut(_running(paths.where("conv_id = by").select("tree", *place, "conv_id", "path", "size")).select(*place, F.col("conv_id").alias("by"), "start", "node"), "placed")
    span = F.struct(F.col("start").alias("from"), (F.col("start") + F.col("size")).alias("to"))
    seen = chain.join(placed, place).withColumn("attend", F.collect_list(span).over(upto)).withColumn("base", F.sum("size").over(upto) - F.col("size"))
    seen = seen.where("conv_id = by").select(*place, "conv_id", "tree", "own", "size", "node", "start", "attend", "base")
    # Texts move once, to the conversation that stands for their node.
    texts = _read(conversations).select("conv_id", "own", "role", "text").dropDuplicates(["conv_id", "own"])
    told = _encoded(seen.join(nodes.select(*place, "conv_ids"), place).join(texts, ["conv_id", "own"]).select("tree", "node", "depth", "conv_ids", "start", "size", "base", "attend", "role", "text"), ranks, "tokens")
    return told.select(
        F.lower(F.hex("tree")).alias("tree"), F.col("node").cast("long").alias("node"), "depth", "conv_ids", "start", "tokens",
        F.when(F.col("size") > 0, F.sequence("base", F.col("base") + F.col("size") - 1)).otherwise(F.array().cast("array<bigint>")).alias("positions"), "attend",
    )
