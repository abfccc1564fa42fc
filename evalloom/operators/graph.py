"""Graphs too large for one machine: reachability, chains, components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.session import cut_lineage


def reachable_from(starts: DataFrame, edges: DataFrame, keys: list[str] | None = None, block_links: int = 500_000) -> DataFrame:
    """Nodes reachable from the starts with the number of hops, per key when keys are given.

    Whole-number nodes without keys are cut into ranges with about ``block_links`` link
    ends each, and a round walks every range inside a task as far as it leads (see
    ``_reach_by_blocks``).  Otherwise breadth-first: each round joins the frontier with
    the links, drops what was seen and writes the new nodes.  Rounds never grow a plan,
    and a cycle ends by itself.  A whole-number node that is null is no node.
    """
    keys = keys or []
    columns = [starts.schema["node"], edges.schema["src"], edges.schema["dst"]]
    if not keys and all(isinstance(c.dataType, T.IntegralType) for c in columns):
        return _reach_by_blocks(starts, edges, block_links).select(F.col("node").cast(columns[0].dataType).alias("node"), "hops")
    on = [k for k in keys if k in edges.columns]
    links = cut_lineage(edges.select(*on, "src", "dst").distinct(), "links")
    frontier = cut_lineage(starts.select(*keys, "node").distinct().withColumn("hops", F.lit(0).cast("bigint")), "hops")
    seen, hop = [(1, frontier)], 0
    while frontier.limit(1).count():
        hop += 1
        known = reduce(DataFrame.unionByName, [rows for _, rows in seen])
        step = (
            frontier.withColumnRenamed("node", "src")
            .join(links.hint("merge"), [*on, "src"])
            .select(*keys, F.col("dst").alias("node"))
            .distinct()
            .join(known.select(*keys, "node").hint("merge"), [*keys, "node"], "left_anti")
            .withColumn("hops", F.lit(hop).cast("bigint"))
        )
        frontier = cut_lineage(step.select(*keys, "node", "hops"), "hops")
        seen.append((1, frontier))
        # tables of equally many rounds become one, so a round reads a logarithmic number of them
        while len(seen) > 1 and seen[-1][0] == seen[-2][0]:
            (n, late), (m, early) = seen.pop(), seen.pop()
            seen.append((n + m, cut_lineage(early.unionByName(late), "hops")))
    return reduce(DataFrame.unionByName, [rows for _, rows in seen])


def _walk(src: np.ndarray, dst: np.ndarray, node: np.ndarray, hops: np.ndarray, fresh: np.ndarray, low: int, high: int):
    """Breadth-first from the fresh nodes over one range: its changed nodes, and the nodes beyond it that are met."""
    inside = (dst >= low) & (dst < high)
    nodes = np.unique(np.concatenate([src, dst[inside], node]))
    order = np.argsort(src, kind="stable")
    dst, inside = dst[order], inside[order]
    begins = np.append(np.searchsorted(src[order], nodes), len(src))
    target = np.where(inside, np.searchsorted(nodes, dst), -1)
    far = np.iinfo(np.int64).max
    best = np.full(len(nodes), far)
    best[np.searchsorted(nodes, node)] = hops
    was = best.copy()
    opened = np.searchsorted(nodes, node[fresh])
    opened = opened[np.argsort(best[opened], kind="stable")]
    levels, at, met, hop = best[opened], 0, np.zeros(0, np.int64), 0
    beyond, beyond_hops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(met) or at < len(opened):
        hop = hop if len(met) else int(levels[at])
        stop = at + int(np.searchsorted(levels[at:], hop, "right"))
        mine = opened[at:stop]
        at = stop
        now = np.unique(np.concatenate([met, mine[best[mine] == hop]]))
        n = begins[now + 1] - begins[now]
        link = np.arange(n.sum()) + np.repeat(begins[now] - np.cumsum(n) + n, n)
        out = np.unique(dst[link[~inside[link]]])
        beyond.append(out)
        beyond_hops.append(np.full(len(out), hop + 1))
        met = np.unique(target[link[inside[link]]])
        met = met[best[met] > hop + 1]
        hop += 1
        best[met] = hop
    changed = best < was
    out, first = np.unique(np.concatenate(beyond), return_index=True)  # levels rise, so the first is the nearest
    return nodes[changed], best[changed], out, np.concatenate(beyond_hops)[first]


def _reach_by_blocks(starts: DataFrame, edges: DataFrame, block_links: int) -> DataFrame:
    """Hops by ranges of nodes.

    A round walks each range that has news, inside a task, until nothing there gets
    nearer, and tells the other ranges what it meets of theirs.  The number of rounds
    follows the ranges that a shortest way crosses instead of its hops.  A node may
    first get a longer way and later a shorter one; it is then walked again from there.
    Links of a node that has more than ``block_links`` are joined instead.
    """
    spark = edges.sparkSession
    links = cut_lineage(edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).dropna().distinct(), "links")
    ends = links.select(F.explode(F.array("src", "dst")).alias("node"))
    n = -(-links.count() // block_links)
    cuts = sorted({int(x) for x in ends.approxQuantile("node", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    edge = [-(2**63), *cuts, 2**63 - 1]

    def ranged(rows: DataFrame, column: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                block = np.searchsorted(np.array(cuts, np.int64), batch.column(column).to_numpy(zero_copy_only=False), "right")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int32))], [*batch.schema.names, "block"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{kinds}, block int")

    many = links.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_links).select("src")
    many = cut_lineage(many, "many")
    if many.limit(1).count():
        joined = cut_lineage(links.join(many, "src"), "joined")
        links = links.join(many, "src", "left_anti")
    else:
        joined = None
    links = cut_lineage(ranged(links, "src"), "ranged")

    def walk(key, mine: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        low, high = edge[key[0]], edge[key[0] + 1]
        near, hops, out, out_hops = _walk(
            mine["src"].to_numpy(np.int64), mine["dst"].to_numpy(np.int64), state["node"].to_numpy(np.int64),
            state["hops"].to_numpy(np.int64), state["fresh"].to_numpy(bool), low, high + (high == edge[-1]),
        )
        return pd.DataFrame({"node": np.append(near, out), "hops": np.append(hops, out_hops), "news": np.arange(len(near) + len(out)) >= len(near)})

    first = starts.select(F.col("node").cast("bigint").alias("node")).dropna().distinct().select("node", F.lit(0).cast("bigint").alias("hops"), F.lit(True).alias("fresh"))
    state = cut_lineage(ranged(first, "node"), "hops")
    while news := [r[0] for r in state.filter("fresh").select("block").distinct().collect()]:
        active = F.col("block").isin(news)
        told = links.filter(active).groupBy("block").cogroup(state.filter(active).groupBy("block")).applyInPandas(walk, "node bigint, hops bigint, news boolean")
        if joined is not None:
            open_ = state.filter("fresh").select(F.col("node").alias("src"), (F.col("hops") + 1).alias("hops"))
            told = told.unionByName(joined.join(open_.hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("hops").alias("hops")).withColumn("news", F.lit(True)))
        both = state.select("node", "hops", F.lit(False).alias("news")).unionByName(told)
        old = F.min(F.when(~F.col("news"), F.col("hops")))
        after = both.groupBy("node").agg(F.min("hops").alias("hops"), F.coalesce(F.min("hops") < old, F.lit(True)).alias("fresh"))
        state = cut_lineage(ranged(after, "node"), "hops")
    return state.select("node", "hops")


def single_terminal(reached: DataFrame, terminals: DataFrame, keys: list[str]) -> DataFrame:
    """The one terminal a start reaches; ``none`` or ``many`` otherwise."""
    hits = reached.join(terminals.select("node").distinct().withColumn("__t", F.lit(1)), "node", "left")
    per = hits.groupBy(*keys).agg(F.count("__t").alias("terminals"), F.max(F.when(F.col("__t") == 1, F.col("node"))).alias("terminal"))
    return per.select(
        *keys,
        "terminals",
        F.when(F.col("terminals") == 1, F.col("terminal")).alias("terminal"),
        F.when(F.col("terminals") == 1, "ok").when(F.col("terminals") == 0, "none").otherwise("many").alias("verdict"),
    )


def follow_chain(links: DataFrame) -> DataFrame:
    """End of the chain from every source, by pointer doubling.

    ``links`` holds ``src, dst``.  After k rounds every pointer spans 2^k links, so
    the number of rounds is the logarithm of the longest chain.  A source with
    two links gives ``ambiguous``; one that still moves when pointers span more
    links than there are gives ``cyclic``.
    """
    counted = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"))
    counted = cut_lineage(counted, "chain-links")
    total = counted.count()
    # an ambiguous node ends a walk: whoever arrives there is ambiguous as well
    current = counted.select(
        "src", F.when(F.col("n") == 1, F.col("dst")).otherwise(F.col("src")).alias("at"),
        F.when(F.col("n") == 1, 1).otherwise(0).cast("bigint").alias("hops"),
        (F.col("n") == 1).alias("open"), (F.col("n") > 1).alias("ambiguous"),
    )
    span = 1
    while True:
        current = cut_lineage(current, "chain")
        if span > total or current.filter("open").limit(1).count() == 0:
            break
        onward = current.select(
            F.col("src").alias("at"), F.col("at").alias("next_at"), F.col("hops").alias("next_hops"),
            F.col("open").alias("next_open"), F.col("ambiguous").alias("next_ambiguous"),
        )
        joined = current.join(onward.hint("merge"), "at", "left")
        moves = F.col("open") & F.col("next_at").isNotNull()
        current = joined.select(
            "src",
            F.when(moves, F.col("next_at")).otherwise(F.col("at")).alias("at"),
            (F.col("hops") + F.when(moves, F.col("next_hops")).otherwise(0)).alias("hops"),
            (moves & F.col("next_open")).alias("open"),
            (F.col("ambiguous") | F.coalesce(moves & F.col("next_ambiguous"), F.lit(False))).alias("ambiguous"),
        )
        span *= 2
    verdict = F.when(F.col("ambiguous"), "ambiguous").when(F.col("open"), "cyclic").otherwise("ok")
    ok = verdict == "ok"
    return current.select(
        "src", F.when(ok, F.col("at")).alias("end"), F.when(ok, F.col("hops")).alias("hops"), verdict.alias("verdict")
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id of each undirected component.

    Alternates large-star and small-star steps until the links no longer change,
    which takes a number of rounds logarithmic in the size of a component.
    """
    links = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links = cut_lineage(links, "stars")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        after = cut_lineage(small, "stars")
        moved = after.exceptAll(links).limit(1).count() + links.exceptAll(after).limit(1).count()
        links = after
        if moved == 0:
            break
    return nodes.join(links.select(F.col("u").alias("node"), "v"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
