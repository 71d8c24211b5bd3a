"""The prefix trie of conversations, built level by level and rolled up by joins from the last level back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm import kernels as K
from panelforge.llm.skew import lookup
from panelforge.llm.storage import parts, stored

#: Conversations that stand together, of which each begins like the first of them, and how many first turns at most that is.
FAMILY, SHARED = 20, 4
#: Turns ahead in which members of a node are compared at first, and how much further each time that they agree in all.
AHEAD, FURTHER = 4, 8
#: Ids in one piece of a list that is hashed.
PIECE_IDS = 8192
BLANK = "[^\\x20\\x09-\\x0D]+"


def turn_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, key, words): what says whether two turns are equal, SHA-256 of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256))
    return conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(BLANK)).cast("long").alias("words"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, nth, key, words, upto): turns from 1 on by turn, null first, equal ones by key; upto: words so far, these included.

    Rows are cut into ranges, so that no task holds a long conversation; each runs on its own, what comes before is one row
    a range and conversation.
    """
    order = [F.asc_nulls_first("turn"), F.asc("key")]
    cut = stored(turns.repartitionByRange(parts(turns.sparkSession), "conv", *order).withColumn("range", F.spark_partition_id()), "turns")
    own = Window.partitionBy("range", "conv").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("range", "conv").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    base = sums.select("range", "conv", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    ran = cut.select("*", F.count(F.lit(1)).over(own).alias("i"), F.sum("words").over(own).alias("w"))
    return ran.join(base, ["range", "conv"]).select("conv", (F.col("n0") + F.col("i")).alias("nth"), "key", "words", (F.col("w0") + F.col("w")).alias("upto"))


def borrowed_turns(conv: Column) -> Column:
    """How many first turns a conversation takes over from the first of its family."""
    return F.pmod(F.crc32(F.encode(conv.cast("string"), "utf-8")), F.lit(SHARED))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, key, words, upto) of the rebuilt conversations, and (conv, len) of each, turnless ones too."""
    own = stored(numbered_turns(turns).withColumn("h", borrowed_turns(F.col("conv"))), "numbered")
    facts = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("h"), F.coalesce(F.sum(F.when(F.col("nth") <= F.col("h"), F.col("words"))), F.lit(0)).alias("left_out"))
    facts = facts.withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    heads = own.filter(F.col("nth") < SHARED).select(F.col("conv").alias("base"), F.col("nth").alias("depth"), "key", "words", "upto")
    taken = facts.select("conv", "base", "h").join(heads, "base").filter("depth <= h").select("conv", "depth", "key", "words", "upto")
    counts = taken.groupBy("conv").agg(F.max("depth").alias("b"), F.max("upto").alias("bw"))
    facts = stored(facts.join(counts, "conv", "left").select("conv", "n", "h", "left_out", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("bw", F.lit(0)).alias("bw")), "conversations")
    rest = lookup(own.filter("nth > h").drop("h"), facts, ["conv"], "n")
    rest = rest.select("conv", (F.col("b") + F.col("nth") - F.col("h")).alias("depth"), "key", "words", (F.col("bw") + F.col("upto") - F.col("left_out")).alias("upto"))
    return stored(taken.unionByName(rest), "rebuilt"), facts.select("conv", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


PIECES = "node long, depth long, first long, ids string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, depth, conv), sorted, of one range -> its ids in pieces of bounded length, comma-joined."""
    now, first, held = None, None, []
    done: list[tuple] = []
    for batch in batches:
        for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (node, depth) != now or len(held) >= PIECE_IDS:
                if held:
                    done.append((*now, first, ",".join(held)))
                now, first, held = (node, depth), conv, []
            held.append(str(conv))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "depth", "first", "ids"])
            done = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, first, ",".join(held))], ["node", "depth", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node, depth and first id -> SHA-256 of each list, one piece in memory at a time."""
    now, state = None, None
    done: list[tuple] = []
    for batch in batches:
        for node, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (node, depth) != now:
                if state is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (node, depth), hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        done.append((*now, state.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of the conversations (node, depth, conv) that end in each node. A hot node's ids are joined
    in ranges; only the hashing of the joined pieces, which has one order, is one task's."""
    n = parts(ends.sparkSession)
    cut = ends.select("node", "depth", "conv").repartitionByRange(n, "node", "depth", "conv").sortWithinPartitions("node", "depth", "conv")
    pieces = stored(cut.mapInArrow(K.tidy(_pieces), PIECES), "end-pieces")
    return pieces.repartition(n, "node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(K.tidy(_digests), "node long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id (null
    for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation begins with the first turns of the first of its family (see rebuilt), then come its own. Every node is a
    distinct sequence of first turns. saved_tokens is what a prefix cache saves in the subtree: of each node the words of its
    last turn, once for each member but one. ends_sha256 digests the ids of the members that end in the node.

    Level by level, the live conversations are grouped by (node, next turn), which gives each child its smallest conv_id and
    its size. A child of one member is a chain to its end and leaves. Members of the others are compared a few turns ahead, by
    counts and extremes a depth: turns in which all agree are a chain of nodes that the next level skips. So levels are as many
    as branchings lie above one another, however long the conversations. Leaves and savings are then joined from
    the last level back to the first; chains become nodes in the last join.

    Turns are ordered by turn, null first, equal ones by content; null role and text are empty. Rows without a conv_id belong to
    no conversation. An empty table has no node. Repeated rows are turns of their own. Other columns are not read.
    """
    turns, convs = rebuilt(turn_rows(conversations, conv_col, turn_col, role_col, text_col))
    top = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    root = F.lit(top["conv"]).cast("long")
    sized = stored(lookup(turns, convs, ["conv"], "len"), "turns-of-conversations")
    rest = sized.select("conv", "depth", "key", "len", root.alias("node"), F.lit(0).cast("long").alias("at"), F.lit(AHEAD).alias("look"))
    ends = [convs.filter("len = 0").select(root.alias("node"), F.lit(0).cast("long").alias("depth"), "conv")]
    levels: list[DataFrame] = []
    while top["n"]:
        first = rest.filter(F.col("depth") == F.col("at") + 1)
        groups = stored(first.groupBy("node", "at", "key").agg(F.min("conv").alias("child"), F.count(F.lit(1)).alias("n"), F.max("look").alias("look"), F.max("len").alias("last")), "level")
        if not groups.limit(1).count():
            break
        joint = lookup(first.select("conv", "node", "key", "at", "len", "look"), groups.filter("n > 1").select("node", "key", "child", "n"), ["node", "key"], "n").drop("key", "node")
        joint = stored(joint, "members")
        ahead = rest.select("conv", "depth", "key").join(joint.select("conv", "child", "n", "at", "look"), "conv").filter("depth > at + 1 AND depth <= at + 1 + look")
        agreed = ahead.groupBy("child", "depth").agg(((F.count(F.lit(1)) == F.max("n")) & (F.min("key") == F.max("key"))).alias("same"))
        upto = agreed.groupBy("child").agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("depth"))) - 1, F.max("depth")).alias("to"))
        chains = groups.join(upto, "child", "left").withColumn("to", F.when(F.col("n") == 1, F.col("last")).otherwise(F.coalesce("to", F.col("at") + 1)))
        chains = stored(chains.select("child", F.col("node").alias("parent"), (F.col("at") + 1).alias("lo"), "to", "n", F.when(F.col("to") == F.col("at") + 1 + F.col("look"), F.col("look") * FURTHER).otherwise(F.lit(AHEAD)).alias("look")), "chains")
        levels.append(chains)
        placed = stored(lookup(joint.select("conv", "len", "child"), chains.filter("n > 1").select("child", "to", "n", "look"), ["child"], "n"), "placed")
        ends.append(chains.filter("n = 1").select(F.col("child").alias("node"), F.col("to").alias("depth"), F.col("child").alias("conv")))
        ends.append(placed.filter(F.col("len") == F.col("to")).select(F.col("child").alias("node"), F.col("to").alias("depth"), "conv"))
        live = placed.filter(F.col("len") > F.col("to")).select("conv", F.col("child").alias("node"), F.col("to").alias("at"), "look")
        rest = stored(rest.select("conv", "depth", "key", "len").join(live, "conv").filter(F.col("depth") > F.col("at")), "rest")
    return _rolled_up(turns, levels, ends, root, top["n"])


def _rolled_up(turns: DataFrame, levels: list[DataFrame], ends: list[DataFrame], root: Column, n: int) -> DataFrame:
    spark = turns.sparkSession
    zero = F.lit(0).cast("long")
    below = spark.createDataFrame([], "parent long, children long, leaves long, saved long")
    chains = spark.createDataFrame([], "child long, parent long, lo long, to long, n long, children long, leaves long, below long, words long")
    if levels:
        everything = levels[0]
        for more in levels[1:]:
            everything = everything.unionByName(more)
        shared = everything.filter("n > 1").select("child", "lo", "to")
        words = stored(turns.select(F.col("conv").alias("child"), "depth", "words", "upto").join(shared, "child").filter("depth BETWEEN lo AND to").groupBy("child", "lo").agg(F.sum("words").alias("words"), F.max("upto").alias("upto")), "chain-words")
        for level in reversed(levels):
            held = level.join(words, ["child", "lo"], "left").join(below.withColumnRenamed("parent", "child"), "child", "left")
            held = held.select("child", "parent", "lo", "to", "n", F.coalesce("children", zero).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", zero).alias("below"), F.coalesce("words", zero).alias("words"), F.coalesce("upto", zero).alias("upto"))
            held = stored(held, "rolled-up")
            below = held.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum(F.col("below") + (F.col("n") - 1) * F.col("words")).alias("saved"))
            chains = held if "upto" not in chains.columns else chains.unionByName(held)
    ended = ends[0]
    for more in ends[1:]:
        ended = ended.unionByName(more)
    digest = stored(end_digests(ended), "end-digests").select(F.col("node").alias("conv_id"), "depth", "ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    one = spark.range(1 if n else 0)
    crown = one.crossJoin(F.broadcast(below.filter(F.col("parent") == root).agg(F.sum("children").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))))
    nodes = crown.select(root.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"), F.coalesce("c", zero).alias("n_children"), F.coalesce("l", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("s", zero).alias("saved_tokens"))
    if levels:
        saved = F.when(F.col("n") > 1, F.col("below") + (F.col("n") - 1) * (F.col("last") - F.col("upto") + F.col("words"))).otherwise(zero)
        each = turns.select("conv", "depth", "words", "upto").join(chains.select("child", "parent", "lo", "to", "n", "children", "leaves", "below", F.col("upto").alias("last")), F.col("conv") == F.col("child")).filter("depth BETWEEN lo AND to")
        each = each.select("conv", "depth", F.when(F.col("depth") == F.col("lo"), F.col("parent")).otherwise(F.col("conv")), "n", F.when(F.col("depth") == F.col("to"), F.col("children")).otherwise(F.lit(1)), "leaves", saved).toDF(*columns)
        nodes = nodes.unionByName(each)
    return nodes.join(digest, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
