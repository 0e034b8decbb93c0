"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of first d turns (role, text); its members are the conversations that start with it and the smallest one owns it. A conversation that
owns a node owns all that follow on its path, as their members are among the node's. So each conversation owns a suffix of its path, every node is owned once, and what
a subtree holds can be summed over occurrences, with no walk of the tree: an occurrence of node P in conversation c adds c's tokens from P on, less those
of nodes that c owns (a node that n conversations pass is counted n times, its owner's turn is taken off once), whether the child of P on c's path is c's own, and whether
c owns a leaf. Windows over prefixes mark the owned occurrences, one group-by over prefixes makes all the sums.

A prefix is known by 128 bits: the exclusive or of its turns' hashes, each made with its depth. They are running values in a conversation, so that a very long
conversation is cut over tasks (``operators.scans``). A prefix that very many conversations share, the root first of all, takes its owner from a small table of such prefixes,
counted before, and meets the window in salted groups. Texts are moved once, to number the turns; after that a turn is two hashes and a length.

A digest of the conversations that end in a node has to see their ids in order. They are joined in chunks of ``CHUNK`` consecutive ids at most, then the chunks
are hashed as a stream, in constant memory.

Turns are ordered by turn (null first), then role, then text; null role or text becomes empty, repeated rows are turns each. Rows with a null conv_id belong to no conversation and are
left out. Very long texts are one row's value until they are hashed. Conversations without a turn are members of the root only. Extra columns are
ignored, whatever their names. No conversation: no node, not even the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrail.llm.shared import written
from calltrail.operators import scans

CHUNK = 4096
_STEP = ["conv_id", "depth", "a", "b", "n_bytes", "n_turns"]


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hot_rows: int = 1_000_000) -> DataFrame:
    """conv_id, pos (from 1), role, text of every turn."""
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return scans.running(rows, ["conv_id"], F.col("turn"), [F.col("role"), F.col("text")], {"pos": ("count", F.lit(1))}, hot_rows).drop("turn")


def hashed(turns: DataFrame) -> DataFrame:
    """conv_id, pos, a, b (a turn's hashes) and n_bytes (of its text), as a table."""
    key = lambda seed: F.xxhash64(F.lit(seed), "role", "text")
    return written(turns.select("conv_id", "pos", key(1).alias("a"), key(2).alias("b"), F.octet_length("text").cast("long").alias("n_bytes")), "turns")


def steps_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paths of the conversations as they are: steps and ids for prefix_trie, from a table as of hashed."""
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return turns.withColumnRenamed("pos", "depth").join(ids, "conv_id").select(*_STEP), ids


def rebuilt(turns: DataFrame, group: int, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Steps and ids of conversations that begin with the first ``head`` (0 to most, of conv_id) turns of the first conversation of their group of ids, then go on with their own after as many."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    ids = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": head.cast("long")}).join(first, "base", "left").withColumn("taken", taken)
    ids = written(ids.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "conversations")
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(ids, "base").where("pos <= h").withColumn("depth", F.col("pos"))
    tails = turns.join(ids, "conv_id").where("pos > h").withColumn("depth", F.col("taken") + F.col("pos") - F.col("h"))
    return heads.select(*_STEP).unionByName(tails.select(*_STEP)), ids.select("conv_id", "n_turns")


def _owners(occurrences: DataFrame) -> DataFrame:
    """Adds owner and deepest (the longest member's length) of each occurrence's prefix, as a table."""
    spark, prefix = occurrences.sparkSession, ["depth", "p", "q"]
    counts = occurrences.groupBy(*prefix).agg(F.count("*").alias("_n"), F.min("conv_id").alias("_owner"), F.max("n_turns").alias("_deepest"))
    # hot: more than a shuffle partition's share of all occurrences; so there are fewer hot prefixes than partitions
    share = max(100, occurrences.count() // int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = written(counts.where(F.col("_n") > share).select(*prefix, "_owner", "_deepest"), "hot")
    rows = occurrences.join(F.broadcast(hot), prefix, "left")
    salt = F.when(F.col("_owner").isNotNull(), F.pmod("conv_id", F.lit(4096))).otherwise(-1)
    w = Window.partitionBy(*prefix, "_salt")
    marked = rows.withColumn("_salt", salt).withColumns({"owner": F.coalesce("_owner", F.min("conv_id").over(w)), "deepest": F.coalesce("_deepest", F.max("n_turns").over(w))})
    return written(marked.select("conv_id", "depth", "n_bytes", "n_turns", "so_far", "owner", "deepest"), "owners")


def ends_digest(ends: DataFrame) -> DataFrame:
    """owner, depth and ends_sha256 from rows (owner, depth, conv_id)."""
    chunk = F.floor(F.col("conv_id") / CHUNK).alias("chunk")
    parts = ends.groupBy("owner", "depth", chunk).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    rows = parts.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "chunk").select("owner", "depth", "text")

    def run(batches):
        at, sha = None, None
        for b in batches:
            done = []
            for owner, depth, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (owner, depth) != at:
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (owner, depth), hashlib.sha256(text.encode())
                else:
                    sha.update(f",{text}".encode())
            yield _rows(done)
        if at is not None:
            yield _rows([(*at, sha.hexdigest())])

    return rows.mapInArrow(run, "owner long, depth long, ends_sha256 string")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*done, strict=True)) if done else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["owner", "depth", "ends_sha256"])


def prefix_trie(steps: DataFrame, ids: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """A row per node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    steps: conv_id, depth (1, 2, ... without a gap), a, b, n_bytes, n_turns; ids: conv_id, n_turns of every conversation.
    """
    turn = lambda seed: F.xxhash64(F.lit(seed), "depth", "a", "b")
    paths = scans.running(written(steps, "steps"), ["conv_id"], F.col("depth"), [], {"p": ("xor", turn(1)), "q": ("xor", turn(2)), "so_far": ("sum", F.col("n_bytes"))}, hot_rows)
    cols = ["conv_id", "depth", "n_bytes", "n_turns", "p", "q", "so_far"]
    zero = F.lit(0).cast("long")
    roots = ids.select("conv_id", *[zero.alias(c) if c != "n_turns" else F.col(c) for c in cols[1:]])
    marked = _owners(written(paths.withColumn("depth", F.col("depth").cast("long")).select(*cols).unionByName(roots.select(*cols)), "paths"))
    own, last = F.col("owner") == F.col("conv_id"), F.col("depth") == F.col("n_turns")
    # others: the last depth at which another one owns the path (-1: none), the text up to there, and who owns it
    per = written(marked.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(~own, F.col("depth"))), F.lit(-1)).alias("others"), F.max(F.when(~own, F.col("so_far"))).alias("others_bytes"), F.max_by(F.when(~own, F.col("owner")), F.when(~own, F.col("depth"))).alias("joins"),
        F.bool_or(own & last & (F.col("deepest") == F.col("n_turns"))).cast("long").alias("leaf"), F.max_by("owner", "depth").alias("end"), F.max("depth").alias("end_depth"),
    ), "own")
    rows = marked.join(per.select("conv_id", "others", "others_bytes", "joins", "leaf"), "conv_id")
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") - 1 > F.col("others"), F.col("conv_id")).otherwise(F.col("joins"))
    shared = F.when(F.col("depth") <= F.col("others"), F.col("others_bytes") - F.col("so_far") + F.col("n_bytes")).otherwise(0)
    nodes = rows.groupBy("owner", "depth").agg(
        F.max(F.when(own, parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.count_if((F.col("depth") < F.col("n_turns")) & (F.col("depth") + 1 > F.col("others"))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(shared).alias("saved_tokens"),
    )
    ends = ends_digest(per.select(F.col("end").alias("owner"), F.col("end_depth").alias("depth"), "conv_id"))
    return nodes.join(ends, ["owner", "depth"], "left").select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def trie(turns: DataFrame, **names: str) -> DataFrame:
    """The prefix trie of the conversations of turns (conv_id, turn, role, text)."""
    return prefix_trie(*steps_of(hashed(numbered(turns, **names))))


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes of trie(turns) with the role and text of their last turn (the root: null), for readers."""
    last = numbered(turns).select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")
