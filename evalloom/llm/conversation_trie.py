"""Prefix trie of conversations, peeled by truncation from its deepest turn.

A node is a distinct sequence of first turns, named by its depth and three 40-bit
sums of hashes of (place, role, text): a prefix's name is a running sum, and
stripping the last turn is a subtraction.  Texts are hashed at the scan and not
moved.

Equal conversations merge first, as one row with their number.  The part of a
sequence that no other sequence shares is a chain whose figures are known at once, so
it is stripped in one step; what is left starts at the deepest shared prefix.  Then
the peel: at each depth the conversations that newly end or join there meet the nodes
that survived from below, one grouping adds up members, children, leaves and saved
tokens, the depth's nodes are written, and their last turn is stripped.  A level is
one aggregation with partial sums, so a prefix that a third of all conversations
share costs a row a task.  There are as many levels as the longest prefix that two
different conversations share, each one written round.

The digest of the conversations that end at a node needs their ids in order: ids are
joined to strings of at most ``IDS`` neighbouring ids, and these stream through one
running hash.  SHA-256 cannot be split, so the ids (not the turns) of one node pass
one task, in constant memory.

Cases: rows without a conversation are left out; a null turn comes first; null roles
and texts are empty; turns with equal numbers are ordered by the hash of role and
text; repeated rows are turns of their own; an empty table gives no node; columns
besides the four are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom import session
from evalloom.llm.common import cut_lineage

IDS = 1024
BLOCK = 4096
KEY = ["depth", "k1", "k2", "k3"]
EMPTY = hashlib.sha256(b"").hexdigest()


def coded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, code, words): each turn as the SHA-256 of its role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    code = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), code.alias("code"), words.cast("bigint").alias("words")).filter("conv_id IS NOT NULL")


def placed_turns(turns: DataFrame) -> DataFrame:
    """``place`` of each turn in its conversation, from 0.

    Turns are numbered inside buckets of turn numbers, so a conversation that holds very many is sorted by several tasks.
    """
    bucket = F.when(F.col("turn").isNull(), F.lit(-(1 << 62))).otherwise(F.shiftright("turn", BLOCK.bit_length() - 1)).cast("bigint")
    order = [F.asc_nulls_first("turn"), F.asc("code")]
    local = turns.withColumn("bucket", bucket).withColumn("place", F.row_number().over(W.partitionBy("conv_id", "bucket").orderBy(*order)).cast("bigint") - 1)
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    ahead = local.groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "bucket", before.alias("ahead")).filter("ahead > 0")
    rows = local.join(ahead, ["conv_id", "bucket"], "left")
    return rows.select("conv_id", (F.col("place") + F.coalesce("ahead", F.lit(0))).alias("place"), "code", "words")


def shared_heads(placed: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from the first one of their group.

    Conversation c takes the first h turns of c - c % group, h = crc32(c) % most, and its
    own turns after its first h.  Returns the turns (with ``place``) and all conversations.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    others = F.transform(F.sequence(F.lit(1 - group), F.lit(group - 1)), lambda i: F.col("conv_id") + i)
    followers = F.filter(others, lambda c: c - c % group == F.col("conv_id"))  # % keeps the sign, so 0 also leads negative ids
    heads = placed.filter((F.col("place") < most - 1) & (F.col("conv_id") % group == 0)).withColumn("conv_id", F.explode(followers))
    both = placed.filter(F.col("place") >= head).withColumn("own", F.lit(True)).unionByName(heads.filter(F.col("place") < head).withColumn("own", F.lit(False)))
    # heads of conversations that are not there are dropped; a head shorter than h moves the own turns up
    convs = placed.groupBy("conv_id").agg(F.lit(True).alias("there"))
    taken = both.groupBy("conv_id").agg(F.count_if(~F.col("own")).alias("taken"))
    sizes = convs.join(taken, "conv_id", "left").select("conv_id", F.coalesce("taken", F.lit(0)).alias("taken"))
    turns = both.join(sizes, "conv_id")
    place = F.when(F.col("own"), F.col("place") - head + F.col("taken")).otherwise(F.col("place"))
    return turns.select("conv_id", place.alias("place"), "code", "words"), convs.select("conv_id")


def _named(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """Each turn with the name of the prefix that it ends: ``depth``, ``k1..k3``; its own part ``x1..x3``; ``upto``, the words so far.

    Every conversation also has its empty prefix, of depth 0.
    """
    at = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("code")).cast("binary"), 256)
    parts = [F.conv(F.substring("at", 1 + 10 * i, 10), 16, 10).cast("bigint").alias(f"x{i + 1}") for i in range(3)]
    rows = placed.withColumn("at", at).select("conv_id", (F.col("place") + 1).alias("depth"), "words", *parts)
    root = convs.select("conv_id", *[F.lit(0).cast("bigint").alias(c) for c in ("depth", "words", "x1", "x2", "x3")])
    rows = rows.unionByName(root).withColumn("bucket", F.shiftright("depth", BLOCK.bit_length() - 1))
    sums = {"k1": "x1", "k2": "x2", "k3": "x3", "upto": "words"}
    inside = W.partitionBy("conv_id", "bucket").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(x).over(inside).alias(k) for k, x in sums.items()])
    before = W.partitionBy("conv_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ahead = local.groupBy("conv_id", "bucket").agg(*[F.sum(x).alias(k) for k, x in sums.items()])
    ahead = ahead.select("conv_id", "bucket", *[F.sum(k).over(before).alias(f"ahead_{k}") for k in sums]).filter("ahead_k1 IS NOT NULL")
    joined = local.join(ahead, ["conv_id", "bucket"], "left")
    return joined.select("conv_id", "depth", "words", "x1", "x2", "x3", *[(F.col(k) + F.coalesce(f"ahead_{k}", F.lit(0))).alias(k) for k in sums])


def _ends(last: DataFrame) -> DataFrame:
    """One row for each distinct whole conversation: ``conv_id`` (smallest), ``copies``, ``ends_sha256``, ``words`` of all turns."""
    runs = last.groupBy(*KEY, F.shiftright("conv_id", IDS.bit_length() - 1).alias("run")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.max("upto").alias("upto"))
    runs = runs.select(*KEY, "run", F.col("ids")[0].alias("least"), F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("listed"), "upto")

    def digest(batches):
        key, held = None, None
        for batch in batches:
            out: list[tuple] = []
            for *k, _, least, n, listed, upto in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    if held:
                        out.append((*key, held[0], held[1], held[2].hexdigest(), held[3]))
                    key, held = k, [least, n, hashlib.sha256(listed.encode()), upto]
                else:
                    held[1] += n
                    held[2].update(b"," + listed.encode())
            yield pack(out)
        if held:
            yield pack([(*key, held[0], held[1], held[2].hexdigest(), held[3])])

    names = [*KEY, "conv_id", "copies", "ends_sha256", "whole"]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    kinds = ", ".join(f"{n} {'string' if n == 'ends_sha256' else 'bigint'}" for n in names)
    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "run").mapInArrow(digest, kinds)


def prefix_trie(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of the conversations ``convs`` (also those without turns), whose turns ``placed`` have a ``place`` from 0.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    named = cut_lineage(_named(placed, convs), "prefixes")
    deepest = named.groupBy("conv_id").agg(F.max(F.struct(*KEY, "upto")).alias("end")).select("conv_id", "end.*")
    ends = cut_lineage(_ends(deepest), "ends")

    # every prefix of the distinct conversations, with the number of these that share it
    paths = named.filter("depth > 0").join(ends.select("conv_id"), "conv_id", "left_semi")
    nodes = paths.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sharing"), F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("x1", "x2", "x3", "words", "upto")])
    nodes = cut_lineage(nodes, "nodes")
    alone = nodes.filter("sharing = 1")
    whole = ends.withColumnRenamed("depth", "length").join(alone.groupBy("conv_id").agg((F.min("depth") - 1).alias("shared")), "conv_id", "left")
    whole = session.cut_lineage(whole.withColumn("shared", F.coalesce("shared", "length")), "whole")

    # chains that one distinct conversation has for itself
    chain = alone.join(whole.select("conv_id", "length", "shared", "copies", "ends_sha256", "whole"), "conv_id")
    last = F.col("depth") == F.col("length")
    chain = chain.select(
        "conv_id", "depth", "shared", *[(F.col(f"k{i}") - F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2, 3)], F.col("copies").alias("n_convs"), F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), ((F.col("copies") - 1) * (F.col("whole") - F.col("upto") + F.col("words"))).alias("saved_tokens"), F.when(last, F.col("ends_sha256")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    chain = cut_lineage(chain, "chains")
    names = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    levels = peel(nodes.filter("sharing > 1"), chain, whole)
    if not levels:
        return chain.limit(0).select("conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), *names)
    shared = reduce(DataFrame.unionByName, levels)
    up = [f"p{i}" for i in (1, 2, 3)]
    joins = F.col("depth") == F.col("shared") + 1
    open_ = shared.select("conv_id", "depth", *[(F.col(f"k{i}") - F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2, 3)], *names).unionByName(chain.filter(joins).drop("shared")).withColumn("up", F.col("depth") - 1)
    parents = shared.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("up"), *[F.col(f"k{i}").alias(f"p{i}") for i in (1, 2, 3)])
    found = open_.join(parents, ["up", *up], "left").select("conv_id", "depth", "parent_conv_id", *names)
    return chain.filter(~joins).select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *names).unionByName(found)


def peel(shared: DataFrame, chain: DataFrame, whole: DataFrame) -> list[DataFrame]:
    """The nodes that several distinct conversations share, and the root, one written frame a depth, deepest first.

    A distinct conversation (``whole``) enters the peel at the depth ``shared``: as its own end, or as the child that the
    first node of its ``chain`` is.
    """
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    parts = [zero.alias(c) for c in ("x1", "x2", "x3", "words")]
    one = F.lit(1).cast("bigint")
    ended = whole.filter("shared = length").select(F.col("length").alias("depth"), *KEY[1:], "conv_id", F.col("copies").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256", *parts)
    joining = chain.filter("depth = shared + 1").select(F.col("shared").alias("depth"), *[F.col(f"p{i}").alias(f"k{i}") for i in (1, 2, 3)], "conv_id", "n_convs", one.alias("n_children"), "n_leaves", "saved_tokens", none.alias("ends_sha256"), *parts)
    known = shared.select(*KEY, F.lit(None).cast("bigint").alias("conv_id"), *[zero.alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], none.alias("ends_sha256"), "x1", "x2", "x3", "words")
    entering = ended.unionByName(joining)
    deepest = entering.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    surviving = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        met = entering.filter(F.col("depth") == depth).unionByName(known.filter(F.col("depth") == depth))
        met = met.unionByName(surviving) if surviving is not None else met
        level = met.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends_sha256").alias("ends_sha256"), *[F.max(c).alias(c) for c in ("x1", "x2", "x3", "words")],
        )
        level = level.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1))).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
        level = session.cut_lineage(level.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "level")
        levels.append(level)
        surviving = level.select(
            (F.col("depth") - 1).alias("depth"), *[(F.col(f"k{i}") - F.col(f"x{i}")).alias(f"k{i}") for i in (1, 2, 3)], "conv_id", "n_convs", one.alias("n_children"), "n_leaves", "saved_tokens", none.alias("ends_sha256"), *parts,
        )
    return levels


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of :func:`shared_heads`."""
    turns, convs = shared_heads(cut_lineage(placed_turns(coded_turns(conversations)), "turns"))
    return prefix_trie(turns, convs)


def plain_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    placed = placed_turns(coded_turns(conversations))
    return prefix_trie(placed, placed.select("conv_id").distinct())
