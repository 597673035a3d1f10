"""Prefix trie of conversations, built level by level and rolled up in reverse.

A node is a sequence of first turns (role and text) that some conversations share; it is named
by its depth and its smallest conversation. Per depth, the live conversations are grouped by
their parent node and next turn; the smallest conversation of a group names the new node, and a
join tells each conversation its node. A conversation that is alone at its node leaves the
levels: the rest of its branch is its own turns, a row each, without any grouping. Going back
up, each level's nodes are summed up by parent and joined to the level above: children, leaves
and saved characters. There are as many levels as the deepest turn that two conversations share.

Turns are numbered in a range partitioning by conversation and turn, with totals by partition
added, so that a conversation of any length is numbered by many tasks. Texts are hashed in the
scan; only digests are shuffled. Conversations that end at a node are joined to strings in
blocks of ids first; SHA-256 then reads the blocks of a node in order, one after the other,
without holding them.

Defined results: turns are ordered by turn (null first), turns of the same number by digest;
repeated rows are turns each; null role or text is empty; rows without a conv_id take no part;
conversations left without turns end at the root; extra columns are ignored; an empty table has
no nodes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.arrowmap import give_back
from corpusloom.columns import pick
from corpusloom.storage import materialize, shared_dir

#: Conversation ids of one block when the ends of a node are hashed.
BLOCK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the length of the role parts role and text."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 1, digest, chars) and conversations (conv_id, n).

    Rows go to ranges of (conv_id, turn, digest, row), so equal rows are parted as well.
    """
    spark = messages.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = pick(messages, "conv_id", "turn", "role", "text").where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = materialize(rows.repartitionByRange(ranges, "conv_id", F.col("turn").asc_nulls_first(), "digest", "row").withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest", "row")
    placed = rows.withColumn("nth", F.row_number().over(within)).join(before, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")))
    turns = placed.select("conv_id", (F.col("before") + F.col("nth")).cast("long").alias("pos"), "digest", "chars")
    return turns, counts.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n"))


def rebuilt(messages: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of their block's first one: turns and conversations.

    Conversation c takes the first h turns of c - c % block, with h = crc32(c) % most, in the
    place of its own first h. Turns: conv_id, depth, digest, chars. Conversations: conv_id, len.
    """
    turns, sizes = numbered_turns(messages)
    turns, sizes = materialize(turns), materialize(sizes)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    head = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base")).join(head, "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = materialize(plan.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    heads = turns.where((F.col("pos") < most) & (F.col("conv_id") % block == 0)).withColumnRenamed("conv_id", "base")
    first = heads.join(plan, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    # h comes from the id alone; the few conversations whose head is short of it are shifted.
    short = plan.where("taken < h").select(F.col("conv_id").alias("c"), (F.col("taken") - F.col("h")).alias("shift"))
    own = turns.where(F.col("pos") > h).join(short, F.col("conv_id") == F.col("c"), "left")
    own = own.select("conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("depth"), "digest", "chars")
    return first.unionByName(own), plan.select("conv_id", "len")


def levels(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """All live conversations of every depth: conv_id, len, depth, parent, node, n, chars.

    One written table a depth; the next depth reads those that share their node and go on.
    """
    spark = turns.sparkSession
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # Rows of one depth lie together, so that a level reads only its own row groups.
    turns = materialize(turns.repartitionByRange(n_ranges, "depth", "conv_id").sortWithinPartitions("depth", "conv_id"))
    root = conversations.agg(F.min("conv_id").alias("c"), F.count("*").alias("n")).first()
    live = conversations.select("conv_id", "len", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(root["c"]).cast("long").alias("node"), F.lit(root["n"]).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"))
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    paths: list[str] = []
    depth, schema = 0, live.schema
    while True:
        paths.append(f"{folder}/{depth}")
        live.write.parquet(paths[-1])
        live = spark.read.schema(schema).parquet(paths[-1])
        going = live.where("n > 1 or depth = 0").where("len > depth")
        if going.isEmpty():
            return spark.read.schema(schema).parquet(*paths), turns
        depth += 1
        ahead = turns.where(F.col("depth") == depth).select("conv_id", "digest", "chars")
        step = going.select("conv_id", "len", F.col("node").alias("parent")).join(ahead, "conv_id")
        groups = step.groupBy("parent", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"))
        joined = step.join(groups, ["parent", "digest"])
        live = joined.select("conv_id", "len", F.lit(depth).cast("long").alias("depth"), "parent", "node", "n", "chars")


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """Nodes with n_children, n_leaves and saved_tokens, summed up level by level.

    ``nodes`` has node, depth, parent, n, chars of all nodes of the levels; those of one
    conversation (below the root) are branches of one leaf that save nothing.
    """
    spark = nodes.sparkSession
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    shared = nodes.where("n > 1 or depth = 0")
    alone = nodes.where("n = 1 and depth > 0").select("depth", "parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
    below, paths = None, []
    for depth in range(deepest, -1, -1):
        own = shared.where(F.col("depth") == depth)
        branches = alone.where(F.col("depth") == depth + 1)
        if below is not None:
            branches = branches.unionByName(below.select("depth", "parent", "n_leaves", F.col("saved_tokens").alias("saved")))
        sums = branches.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
        done = own.join(sums, "node", "left").select(
            "node", "depth", "parent", "n",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            ((F.col("n") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"),
        )
        paths.append(f"{folder}/{depth}")
        done.write.parquet(paths[-1])
        below = spark.read.schema(done.schema).parquet(paths[-1])
    return spark.read.schema(below.schema).parquet(*paths)


def end_hashes(ends: DataFrame) -> DataFrame:
    """Columns node, depth, ends_sha256 for rows (node, depth, conv_id) of ends.

    Blocks of at most BLOCK ids are joined to strings first. Nodes with one block are hashed
    there; the blocks of others are read in order.
    """
    block = F.expr(f"conv_id div {BLOCK} - if(conv_id % {BLOCK} < 0, 1, 0)")
    per = ends.groupBy("node", "depth", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    per = materialize(per)
    blocks = per.groupBy("node", "depth").agg(F.count("*").alias("n_blocks"), F.first("ids").alias("ids"))
    single = blocks.where("n_blocks = 1").select("node", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    several = per.join(blocks.where("n_blocks > 1").select("node", "depth"), ["node", "depth"], "left_semi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for frame in frames:
            out = []
            for node, depth, ids in zip(frame["node"].tolist(), frame["depth"].tolist(), frame["ids"].tolist(), strict=True):
                if (node, depth) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (node, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pd.DataFrame(out, columns=["node", "depth", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["node", "depth", "ends_sha256"])
        give_back()

    ordered = several.repartition("node", "depth").sortWithinPartitions("node", "depth", "block")
    return single.unionByName(ordered.mapInPandas(run, "node bigint, depth bigint, ends_sha256 string"))


def build(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie over turns (conv_id, depth, digest, chars) and conversations (conv_id, len)."""
    spark = turns.sparkSession
    conversations = materialize(conversations)
    if conversations.isEmpty():
        return spark.createDataFrame([], NODES)
    found, turns = levels(turns, conversations)
    nodes = found.where("conv_id = node").select("node", "depth", "parent", "n", "chars")
    deepest = nodes.where("n > 1 or depth = 0").agg(F.max("depth")).first()[0]
    shared = rolled_up(nodes, deepest)
    hashes = end_hashes(found.where("n > 1 or depth = 0").where("len = depth").select("node", "depth", "conv_id"))
    shared = shared.join(hashes, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )
    alone = found.where("n = 1 and depth > 0").select(F.col("conv_id").alias("c"), "len", F.col("depth").alias("from_depth"), "parent")
    last = F.col("depth") == F.col("len")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    branches = turns.join(alone, (F.col("conv_id") == F.col("c")) & (F.col("depth") >= F.col("from_depth"))).select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("from_depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return shared.unionByName(branches)


NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def conversation_trie(messages: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """The trie of rebuilt conversations: a row a node."""
    return build(*rebuilt(messages, block, most))
