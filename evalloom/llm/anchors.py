"""Windows that may repeat, found through anchors, for the two exact substring operators.

A window of ``size`` symbols is named by the smallest hash among its runs of
``gram`` symbols.  Equal windows have equal names wherever they stand, and
consecutive windows mostly share one, so a document becomes a few segments (name,
first window, windows).  Only segments whose name occurs again can hold a repeated
window; their content goes to the shard of the name, equal contents once with a
count.  Shards are independent, so the work grows with the input and no shard has
to see all documents.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import cut_lineage, drop_written
from evalloom.llm.text import ids_of, pieces, sliding_min

SHARD_BYTES = 1 << 20


def segments(grams: np.ndarray, bounds: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window within its row, windows, name, times the name's run stands in it) of each segment.

    ``grams[i]`` is the hash of the ``gram`` symbols from symbol i; ``bounds`` are the rows' symbols.
    """
    width = size - gram + 1
    if len(grams) < width:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    low = sliding_min(grams, width)
    valid = np.zeros(len(low) + 1, np.int8)
    first = bounds[:-1]
    many = np.diff(bounds) >= size
    np.add.at(valid, first[many], 1)
    np.add.at(valid, bounds[1:][many] - size + 1, -1)
    inside = np.cumsum(valid[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
    # a row's windows end before the next row's begin, so rows never share a run, unless size is 1
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | (low[1:] != low[:-1])
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    name = low[start]
    # places whose run names some window: those at the largest minimum of all windows over them
    high = ~sliding_min(np.concatenate([np.full(width - 1, ~np.uint64(0)), ~low, np.full(width - 1, ~np.uint64(0))]), width)
    chosen = np.flatnonzero(grams[: len(high)] == high[: len(grams)])
    a, b = np.searchsorted(chosen, start), np.searchsorted(chosen, stop - 1 + width)
    many = b - a
    each = np.repeat(np.arange(len(start)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)
    times = np.bincount(each[grams[chosen[at]] == name[each]], minlength=len(start))
    # long runs, where a name stands again and again, are cut so that contents stay short
    most = 4 * size
    parts = -(-(stop - start) // most)
    each = np.repeat(np.arange(len(start)), parts)
    first = start[each] + most * (np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts))
    row = np.searchsorted(bounds, start, "right") - 1
    return row[each], first - bounds[row[each]], np.minimum(stop[each] - first, most), name[each], times[each]


def named_segments(texts: DataFrame, cut: Callable) -> DataFrame:
    """(name, doc_id, start, n, times); ``cut(data, offsets)`` gives :func:`segments` of a piece."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                row, start, n, name, times = cut(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(ids_of(rows)[row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(times.astype(np.int32))],
                    ["name", "doc_id", "start", "n", "times"],
                )

    return texts.mapInArrow(run, "name bigint, doc_id bigint, start int, n int, times int")


def repeated_segments(texts: DataFrame, cut: Callable, again: Column) -> DataFrame:
    """doc_id and the segments of each document whose name occurs again: arrays ``start``, ``n``, ``name`` in one struct list.

    ``again`` tells from ``low`` and ``high`` (smallest and largest doc_id) and ``times`` whether a name repeats.
    """
    spark = texts.sparkSession
    all_ = cut_lineage(named_segments(texts, cut), "segments")
    names = all_.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("times").alias("times")).filter(again).select("name")
    held = cut_lineage(all_.join(names, "name").select("doc_id", "start", "n", "name"), "held-segments")
    drop_written(spark, all_)
    return held


def contents(texts: DataFrame, held: DataFrame, slices: Callable) -> DataFrame:
    """(doc_id, start, n, name, digest, content) of the held segments; a content that a batch showed before is null.

    ``slices(data, offsets, row, start, n)`` gives the byte spans of segments, empty where a row ends before.
    """
    lists = held.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "name")).alias("s"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, data, offsets in pieces(batch):
                listed = rows.column(rows.schema.get_field_index("s"))
                flat = listed.flatten()
                start, n, name = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                row = np.repeat(np.arange(rows.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
                a, b = slices(data, offsets, row, start.astype(np.int64), n.astype(np.int64))
                whole = data.tobytes()
                seen: set[bytes] = set()
                digests, held_ = [], []
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    content = whole[x:y]
                    digest = blake2b(content, digest_size=16).digest()
                    digests.append(digest)
                    held_.append(None if digest in seen else content)
                    seen.add(digest)
                keep = pa.array(b > a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids_of(rows)[row]), pa.array(start), pa.array(n), pa.array(name), pa.array(digests, pa.binary()), pa.array(held_, pa.binary())],
                    ["doc_id", "start", "n", "name", "digest", "content"],
                ).filter(keep)

    return texts.join(lists, "doc_id").select("doc_id", "text", "s").mapInArrow(run, "doc_id bigint, start int, n int, name bigint, digest binary, content binary")


def _merge_copies(batches, most: int = 1 << 16):
    """One row for each (digest, name) of some ten thousand rows, with their count, smallest document and content."""

    def merge(held):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        digest = rows.column(0).cast(pa.binary(16))
        halves = np.frombuffer(digest.buffers()[1], np.uint64)[2 * digest.offset : 2 * (digest.offset + len(digest))].reshape(-1, 2)
        name, doc = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
        # a row with the content comes before those without
        order = np.lexsort((rows.column(2).is_null().to_numpy(zero_copy_only=False), halves[:, 1], halves[:, 0], name))
        name_, halves = name[order], halves[order]
        heads = np.flatnonzero(np.concatenate([[True], (name_[1:] != name_[:-1]) | (halves[1:] != halves[:-1]).any(1)]))
        kept = rows.select([0, 1, 2]).take(pa.array(order[heads]))
        copies, low = np.diff(np.append(heads, len(order))), np.minimum.reduceat(doc[order], heads)
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(copies), pa.array(low)], ["digest", "name", "content", "copies", "low"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield merge(held)
            held, n = [], 0
    if held:
        yield merge(held)


def by_shard(found: DataFrame, solve: Callable, schema: str) -> DataFrame:
    """``solve`` on the distinct contents of whole names, some MB at a time.

    ``solve(contents, counts, lows)`` yields columns for the rows of a chunk: places in the chunk and values.
    """
    # dealt by name alone, so that one exchange serves the aggregation and the shards; copies are merged before it
    merged = found.select("digest", "name", "content", "doc_id").mapInArrow(_merge_copies, "digest binary, name bigint, content binary, copies bigint, low bigint")
    distinct = merged.repartition("name").groupBy("digest", "name").agg(
        F.first("content", ignorenulls=True).alias("content"), F.sum("copies").alias("copies"), F.min("low").alias("low")
    )
    ordered = distinct.sortWithinPartitions("name")

    def run(batches):
        digests, bodies, copies, lows, size, last = [], [], [], [], 0, None

        def chunk():
            at, *columns = solve(bodies, np.array(copies), np.array(lows))
            return pa.RecordBatch.from_arrays([pa.array([digests[i] for i in at], pa.binary()), *columns], names)

        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for name, digest, content, n, low in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "digest", "content", "copies", "low")), strict=True):
                if size >= SHARD_BYTES and name != last:
                    yield chunk()
                    digests, bodies, copies, lows, size = [], [], [], [], 0
                digests.append(digest)
                bodies.append(content)
                copies.append(n)
                lows.append(low)
                size += len(content)
                last = name
        if bodies:
            yield chunk()

    return ordered.mapInArrow(run, schema)


def ranks_by_doubling(codes: np.ndarray, reach: int | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Places in the order of the suffixes (by ``reach`` symbols, or in full), and the ranks for each power of two on the way.

    Equal ranks at a power mean as many equal symbols.  Codes are positive; beyond
    the end every symbol is 0.  Only places that still tie are sorted again.
    """
    n = len(codes)
    _, group, sizes = np.unique(codes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(sizes) - sizes)[group] + 1  # one more than the first place of the group in the order
    order = np.argsort(group, kind="stable")
    tied = order[sizes[group[order]] > 1]
    levels, have = {1: rank.astype(np.int32)}, 1
    while len(tied) and (reach is None or have < reach):
        after = tied + have
        key = rank[tied] * (n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        by_key = np.argsort(key, kind="stable")
        tied, key = tied[by_key], key[by_key]
        old = rank[tied]
        heads = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        place = old - 1 + np.arange(len(tied)) - np.repeat(heads, np.diff(np.append(heads, len(tied))))
        order[place] = tied
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(tied)))
        rank[tied] = np.repeat(place[heads] + 1, sizes)
        tied = tied[np.repeat(sizes, sizes) > 1]
        have *= 2
        levels[have] = rank.astype(np.int32)
    return order, levels
