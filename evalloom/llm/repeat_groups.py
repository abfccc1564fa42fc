"""Exact repeated byte strings by common-prefix intervals of enhanced suffix arrays.

Segments whose anchors occur again (see ``anchors``) are gathered in shards.  Each
shard sorts its suffixes, computes common prefixes of neighbours, and a stack scan
of them opens and closes the intervals of the prefix tree.  An interval of at least
``least`` bytes whose occurrences differ in the byte before is a maximal repeat; all
its occurrences are reported with its length, not just neighbours in the order.
Every repeated string of ``least`` bytes lies inside such a group.

Cases: a null or empty text has no bytes; strings never cross texts; overlapping
occurrences count; equal rows repeat each other; rows that share an id but not a
text are one document for the removal (spans are cut at each text's end); rows
without an id are left out; an empty table gives no rows; columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.anchors import by_shard, contents, repeated_segments, segments
from evalloom.llm.common import cut_lineage, drop_written, keyed_texts
from evalloom.llm.text import UNSTEP, ids_of, mix, pieces, powers, running

GRAM, SPANS = 64, "spans of repeats"


def byte_segments(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Segments of the windows of ``least`` bytes; the gram shortens with them."""
    gram = min(GRAM, max(1, least // 2))
    if len(data) < gram:
        return segments(np.zeros(0, np.uint64), offsets, least, gram)
    prefix = running(data)
    grams = mix((prefix[gram:] - prefix[:-gram]) * powers(UNSTEP, len(prefix))[: len(prefix) - gram])
    return segments(grams, offsets, least, gram)


def _sorted_runs(bodies: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that share their first ``least`` bytes with another, in order: body, place, the byte before, and run bounds.

    Prefix doubling from seven bytes; a place is only ordered as far as its body
    reaches, and only while it ties.
    """
    size = np.array([len(b) for b in bodies], np.int64)
    start = np.cumsum(size + 1) - size - 1
    symbols = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[start + size] = 0
    n = len(symbols)
    room = np.repeat(start + size, size + 1) - np.arange(n)  # bytes up to the end of the body
    have = min(7, least)
    key = np.zeros(n, np.int64)
    for j in range(have):
        key[: n - j] |= symbols[j:] << (9 * (have - 1 - j))
    tied = np.flatnonzero(room >= have)
    rank = np.zeros(n, np.int64)
    key = key[tied]
    base = np.zeros(len(tied), np.int64)
    while True:
        by_key = np.argsort(key, kind="stable")
        tied, key, base = tied[by_key], key[by_key], base[by_key]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        many = np.diff(np.append(heads, len(key)))
        # ranks keep the order of earlier rounds: a group is renumbered inside its own range
        group = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]])) if len(base) else heads
        inside = np.arange(len(tied)) - np.repeat(group, np.diff(np.append(group, len(tied))))
        rank[tied] = np.repeat((base + inside)[heads] + 1, many)
        tied = tied[np.repeat(many, many) > 1]
        if 2 * have > least:
            break
        tied = tied[room[tied] >= 2 * have]
        base = rank[tied] - 1
        key = rank[tied] * (n + 2) + rank[tied + have]
        have *= 2
    tied = tied[room[tied] >= least]
    key = rank[tied] * (n + 2) + rank[tied + least - have]
    by_key = np.argsort(key, kind="stable")
    tied, key = tied[by_key], key[by_key]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    many = np.diff(np.append(heads, len(key)))
    tied, many = tied[np.repeat(many, many) > 1], many[many > 1]
    body = np.searchsorted(start, tied, "right") - 1
    # a place at the start of its body differs from all others
    before = np.where(tied == start[body], -1 - np.arange(len(tied)), symbols[np.maximum(tied - 1, 0)])
    return body, tied - start[body], before, np.cumsum(many) - many, np.cumsum(many)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _intervals(bodies: list[bytes], least: int) -> Iterator[tuple[int, list[tuple], int, int, list[int]]]:
    """(length, suffixes of the run, first and last of the interval, its fresh suffixes) of every maximal repeat.

    A run of suffixes with equal bytes before them only continues groups that begin
    further left, so the stack scans the runs that differ there.  Fresh are the
    suffixes that no longer maximal repeat holds; each suffix of a run is fresh once.
    """
    body, place, before, low, high = _sorted_runs(bodies, least)
    if not len(low):
        return
    diverse = np.minimum.reduceat(before, low) != np.maximum.reduceat(before, low)
    for a, b in zip(low[diverse].tolist(), high[diverse].tolist(), strict=True):
        suffixes = sorted((bodies[i][p:], i, p, c) for i, p, c in zip(body[a:b].tolist(), place[a:b].tolist(), before[a:b].tolist(), strict=True))
        change = [0]
        for x, y in zip(suffixes, suffixes[1:], strict=False):
            change.append(change[-1] + (x[3] != y[3]))
        prefix = [_common(x[0], y[0]) for x, y in zip(suffixes, suffixes[1:], strict=False)] + [0]
        stack: list[tuple[int, int, list[int]]] = []
        for i, length in enumerate(prefix):
            left, pending = i, [i]
            while stack and stack[-1][0] > length:
                depth, left, fresh = stack.pop()
                fresh += pending
                pending = fresh
                if change[i] != change[left]:
                    yield depth, suffixes, left, i, fresh
                    pending = []
            if length:
                if stack and stack[-1][0] == length:
                    stack[-1][2].extend(pending)
                else:
                    stack.append((length, left, pending))


def maximal_repeats(bodies: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, (body, place) of all occurrences) of every maximal repeat of ``least`` bytes or more."""
    for depth, suffixes, left, right, _ in _intervals(bodies, least):
        yield depth, [(s[1], s[2]) for s in suffixes[left : right + 1]]


def _covered(bodies: list[bytes], copies: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, start, end) of the repeated stretches of each body; a body with copies is repeated as a whole."""
    who = np.flatnonzero(copies > 1).tolist()
    low, high = [0] * len(who), [len(bodies[i]) for i in who]
    for length, suffixes, _, _, fresh in _intervals(bodies, least):
        for i in fresh:
            who.append(suffixes[i][1])
            low.append(suffixes[i][2])
            high.append(suffixes[i][2] + length)
    return merged(np.array(who, np.int64), np.array(low, np.int64), np.array(high, np.int64))


def merged(who: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the stretches of each body."""
    if not len(who):
        return who, low, high
    order = np.lexsort((low, who))
    who, low, high = who[order], low[order], high[order]
    wide = np.int64(int(high.max()) + 1)
    far = np.maximum.accumulate(who * wide + high)
    new = np.ones(len(who), bool)
    new[1:] = who[1:] * wide + low[1:] > far[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(who)) - 1
    return who[at], low[at], far[last] - who[at] * wide


def repeated_spans(docs: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id, low, high): byte spans inside strings of ``least`` bytes that stand somewhere else too."""
    texts = keyed_texts(docs)
    spark = docs.sparkSession
    held = repeated_segments(texts, lambda data, offsets: byte_segments(data, offsets, least), F.col("times") > 1)

    def slices(data, offsets, row, start, n):
        a = np.minimum(offsets[row] + start, offsets[row + 1])
        return a, np.minimum(a + n - 1 + least, offsets[row + 1])

    found = cut_lineage(contents(texts, held, slices), "contents")
    drop_written(spark, held)

    def solve(bodies, copies, lows):
        who, low, high = _covered(bodies, copies, least)
        return who.tolist(), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))

    solved = cut_lineage(by_shard(found.select("digest", "name", "content", "doc_id"), solve, "digest binary, low int, high int"), "solved")
    placed = found.select("doc_id", "start", "digest").join(solved, "digest")
    out = cut_lineage(placed.select("doc_id", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")), "spans")
    drop_written(spark, found, solved)
    return out


def _stripped(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Bytes, removed bytes and removed runs of each row, and what is left of it."""
    n = rows.num_rows
    listed = rows.column(rows.schema.get_field_index(SPANS))
    flat = listed.flatten()
    low, high = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    row = np.repeat(np.arange(n), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    top = offsets[1:] - offsets[:-1]
    low, high = np.minimum(low, top[row]), np.minimum(high, top[row])
    row, low, high = merged(*(x[high > low] for x in (row, low, high)))
    whole = data.tobytes()
    first = np.searchsorted(row, np.arange(n + 1))
    left = []
    for i in range(n):
        at, parts = int(offsets[i]), []
        for k in range(int(first[i]), int(first[i + 1])):
            parts.append(whole[at : int(offsets[i] + low[k])])
            at = int(offsets[i] + high[k])
        parts.append(whole[at : int(offsets[i + 1])])
        left.append(b"".join(parts))
    return top.astype(np.int64), np.bincount(row, high - low, n).astype(np.int64), np.diff(first).astype(np.int64), left


def _with_spans(docs: DataFrame, least: int) -> DataFrame:
    spans = repeated_spans(docs, least).groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias(SPANS))
    return docs.join(spans, "doc_id", "left").select(*docs.columns, SPANS)


def remove_repeats(docs: DataFrame, least: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                top, removed, runs, left = _stripped(rows, data, offsets)
                digests = pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids_of(rows)), pa.array(top), pa.array(removed), pa.array(runs), digests], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(keyed_texts(docs), least).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def strip_repeats(docs: DataFrame, least: int = 200) -> DataFrame:
    """The rows of ``docs``, with all their columns, with repeated bytes cut out of ``text``.

    A character that loses some of its bytes is dropped whole; a null text stays null,
    and rows without an id stay as they are.
    """

    def run(batches):
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                left = _stripped(rows, data, offsets)[3]
                at = rows.schema.get_field_index("text")
                text = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string())
                text = pc.if_else(rows.column(at).is_null(), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([text if i == at else rows.column(i) for i in range(rows.num_columns - 1)], rows.schema.names[:-1])

    return _with_spans(docs, least).mapInArrow(run, docs.schema)
