"""The prefix trie of conversations, by truncation peeling.

A conversation is a sequence of turns; each distinct sequence of its first d turns is a node of depth d. The
trie is never walked from the root: the descent starts at the greatest depth that two conversations can
share. At each depth the conversations that end there join the nodes that survived from below, all are
grouped by their sequence, and every group is one node whose sums are complete at once; then the last
turn is stripped and the next depth regroups what is left. Groups are sums with map-side combine, so a
first turn that a third of all conversations share costs one row per task.

Below that depth a conversation is alone: its nodes are written from its turns without any exchange, so
one endless conversation neither adds a round nor travels as an array. Its turns are one sequence and are
numbered in one task, which streams over them and spills.

A turn is known by 128 bits of the SHA-256 of its role and text. Texts leave the scan only as these and
their number of words.

Defined results: a null role or text counts as empty; turns without a conversation id belong to none and
are left out; turns are ordered by number, null first, equal numbers by that hash (repeated rows are
turns of their own); an empty table gives an empty trie; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.session import stored

WORD = r"[^\x20\x09-\x0D]+"
SLOTS = 256  # parts into which the children of one node are dealt when they look up their parent
BLOCK = 4096  # neighbouring conversation ids that are written out together for a digest


def number_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, said, words): turns numbered from 1, each as 16 bytes and its number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(said), 1, 16).alias("said"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "said")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("at"), "said", "words")


def share_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of a common one: conversation c takes the first h turns of
    c - c % every, h = crc32(decimal c) % most, and goes on with its own turns after its first h.

    Returns (conv_id, n) of every conversation and its rebuilt turns. The join meets at most `every`
    conversations and `most` turns on a key.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    plan = sizes.withColumns({"h": heads, "base": F.col("conv_id") - F.col("conv_id") % every})
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("at") < most)).select(
        F.col("conv_id").alias("base"), "at", "said", "words")
    taken = (plan.filter("h > 0").join(first, "base").filter("at <= h").select("conv_id", "at", "said", "words"))
    n_taken = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    plan = plan.join(n_taken, "conv_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    rest = (turns.withColumn("h", heads).filter("at > h")
            .join(plan.select("conv_id", "taken"), "conv_id")
            .select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "said", "words"))
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return lengths, taken.union(rest)


def _ends(lengths: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, ends_sha256): digest of the sorted ids of the conversations that end at a node.

    Ids are joined in blocks first; a digest is sequential by nature, so the blocks of one node stream
    through one task with a state of fixed size.
    """
    ended = keys.join(lengths.withColumnRenamed("n", "at"), ["conv_id", "at"])
    blocks = (ended.groupBy("k", F.floor(F.col("conv_id") / BLOCK).alias("block"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())],
                                              names=["k", "ends_sha256"])
        key, state, done = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column("k").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
                if len(done) >= 4000:
                    yield batch_of(done)
                    done = []
        if state is not None:
            done.append((key, state.hexdigest()))
        if done:
            yield batch_of(done)
    return (blocks.repartition("k").sortWithinPartitions("k", "block").select("k", "ids")
            .mapInArrow(run, "k binary, ends_sha256 string"))


def _key() -> Column:
    """A node's key: 128 bits of its sequence of turns, which no other sequence shares."""
    running = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    mixed = [F.bit_xor(F.xxhash64(*part)).over(running) for part in (("at", "said"), ("said", F.lit(7), "at"))]
    return F.unhex(F.concat(*[F.lpad(F.hex(m), 16, "0") for m in mixed]))


def trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``lengths`` has every conversation with its number n of turns (0 included), ``turns`` the rows
    (conv_id, at from 1 to n, said, words).
    """
    lengths = stored(lengths.select("conv_id", "n"), "trie-lengths")
    placed = stored(turns.select("conv_id", "at", "said", "words").withColumn("k", _key()), "trie-turns")
    root_key = F.unhex(F.lit("0" * 32))
    # the greatest depth at which two conversations still share a node; one row
    deepest = (placed.groupBy("k", "at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
               .agg(F.max("at")).first()[0] or 0)

    # a conversation's path: as many of its turns as can be shared, and one more
    step = F.struct("at", "k", "words")
    paths = lengths.join(
        placed.filter(F.col("at") <= deepest + 1).groupBy("conv_id")
        .agg(F.transform(F.sort_array(F.collect_list(step)), lambda s: F.struct(s["k"].alias("k"), s["words"].alias("words"))).alias("path")),
        "conv_id", "left")
    none = F.array().cast("array<struct<k:binary,words:bigint>>")
    paths = stored(paths.withColumn("path", F.coalesce("path", none)), "trie-paths")

    def row(depth: int, rows: DataFrame) -> DataFrame:
        """Nodes of a depth with their own key and their parent's."""
        own, up = (F.coalesce(F.try_element_at("path", F.lit(d))["k"], root_key) if d > 0 else root_key for d in (depth, depth - 1))
        return rows.select("path", "conv_id", F.lit(depth).cast("long").alias("depth"), own.alias("k"), up.alias("up"),
                           "n_convs", "n_children", "n_leaves", "saved_tokens", "slots")

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    # below the shared depth every conversation is alone
    level = stored(row(deepest + 1, paths.filter(F.col("n") > deepest).select(
        "path", "conv_id", one.alias("n_convs"), (F.col("n") > deepest + 1).cast("long").alias("n_children"), one.alias("n_leaves"),
        zero.alias("saved_tokens"), F.array().cast("array<int>").alias("slots"))), "trie-level")
    levels = [level]
    for depth in range(deepest, -1, -1):
        ended = paths.filter(F.col("n") == depth).select(
            "path", "conv_id", one.alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"),
            F.lit(None).cast("int").alias("slot"))
        # strip the last turn of what survived
        survived = level.select(F.slice("path", 1, depth).alias("path"), "conv_id", "n_convs", one.alias("n_children"),
                                "n_leaves", "saved_tokens", F.pmod(F.xxhash64("k"), F.lit(SLOTS)).cast("int").alias("slot"))
        words = F.coalesce(F.try_element_at("path", F.lit(depth))["words"], zero) if depth else zero
        grouped = ended.union(survived).groupBy("path").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
            F.greatest(F.sum("n_leaves"), one).alias("n_leaves"), F.sum("saved_tokens").alias("below"),
            F.collect_set("slot").alias("slots"))
        level = stored(row(depth, grouped.withColumn("saved_tokens", F.col("below") + (F.col("n_convs") - 1) * words)), "trie-level")
        levels.append(level)

    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.union(level)
    # children find their parent's member; a parent stands in the slots that its children use, so no
    # node's children have to meet in one task
    parents = nodes.select(F.col("k").alias("up"), (F.col("depth") + 1).alias("depth"), F.explode("slots").alias("slot"),
                           F.col("conv_id").alias("parent_conv_id"))
    children = nodes.withColumn("slot", F.pmod(F.xxhash64("k"), F.lit(SLOTS)).cast("int"))
    shared = children.join(parents, ["up", "depth", "slot"], "left")
    keys = placed.filter(F.col("at") <= deepest + 1).select("conv_id", "at", "k").union(
        lengths.filter("n = 0").select("conv_id", F.col("n").alias("at"), root_key.alias("k")))
    ends = _ends(lengths, keys)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = shared.join(ends, "k", "left").select(*columns, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    alone = placed.filter(F.col("at") > deepest + 1).join(lengths, "conv_id").select(
        "conv_id", F.col("at").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        (F.col("at") < F.col("n")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("at") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return shared.union(alone)
