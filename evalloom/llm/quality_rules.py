"""Quality rules: boosted trees over document statistics, flattened into node arrays.

The statistics come from whole texts.  The trees are fitted on the driver from a
bounded sample of labelled rows (``sample`` rows, those with the smallest hashes
of their ids) and then travel with the tasks as five flat numpy arrays, so all
rows of a piece walk all trees together.  Chosen statistics are monotone: more
repetition or more symbols never raise a score.

Cases: a null or empty text has no words and fails the base rule; ids that are
null are left out; repeated rows each get their row; without labels, or with one
label only, the model keeps every document that passes the base rule.  Columns
besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import keyed_texts, labelled
from evalloom.llm.text import PLAIN_WORD, Words, ids_of, mix, per_row, pieces, running, span_hash, windows

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
MARK = np.isin(np.arange(256), [ord(c) for c in "!?.,;:-_=/\\\"'()[]{}~^`@+"])
CODE_POINT = (np.arange(256) & 0xC0) != 0x80

#: statistic -> direction of its effect on the score (0: free)
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1,
    "upper_rate": 0, "digit_rate": 0, "mark_rate": 0, "distinct_rate": 0, "same_as_last": -1, "longest_word": 0, "lines_per_word": 0,
}
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def statistics(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (rows x 5) and model statistics (rows x features) of one piece."""
    words = Words(data, offsets)
    prefix = running(data)
    hashes = words.hashes(prefix)
    n = len(offsets) - 1
    count = words.counts
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    total = lambda flags: per_row(flags, offsets)

    points = total(CODE_POINT[data] & PLAIN_WORD[data])
    symbols = total(SYMBOLS[data])

    breaks = data == 0x0A
    line_start = np.concatenate([offsets[:-1], np.flatnonzero(breaks) + 1])
    line_end = np.concatenate([offsets[1:], np.flatnonzero(breaks)])
    line_start.sort()
    line_end.sort()
    full = np.searchsorted(words.starts, line_start) < np.searchsorted(words.starts, line_end)
    line_start, line_end = line_start[full], line_end[full]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    lines = np.bincount(line_row, minlength=n)
    keys = span_hash(prefix, line_start, line_end) ^ salt[line_row]
    _, first = np.unique(keys, return_index=True)
    dup_lines = lines - np.bincount(line_row[first], minlength=n)

    starts, keys = windows(hashes, words.bounds, 5)
    _, back, times = np.unique(keys ^ salt[words.row[starts]], return_inverse=True, return_counts=True)
    hit = np.zeros(len(hashes) + 5, bool)
    for j in range(5):
        hit[starts[times[back] > 1] + j] = True
    repeats = np.bincount(words.row[hit[: len(hashes)]], minlength=n)

    _, first = np.unique(hashes ^ salt[words.row], return_index=True)
    distinct = np.bincount(words.row[first], minlength=n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, words.row, words.ends - words.starts)

    base = np.stack([count, points, symbols, dup_lines, repeats], 1).astype(np.int64)
    per_word, per_byte = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    stats = np.stack([
        np.log1p(count), points / per_word, symbols / per_byte, dup_lines / np.maximum(lines, 1), repeats / per_word,
        total(UPPER[data]) / per_byte, total(DIGIT[data]) / per_byte, total(MARK[data]) / per_byte, distinct / per_word,
        np.bincount(words.row[same], minlength=n) / per_word, np.log1p(longest), lines / per_word,
    ], 1)
    return base, stats


@dataclass
class Forest:
    """All trees in five flat arrays; ``left < 0`` marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            leaf = self.left[at] < 0
            go_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(leaf, at, np.where(go_left, self.left[at], self.right[at]))
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 48, ridge: float = 1.0) -> Forest:
    """Second-order boosting on binned statistics under the log loss."""
    share = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        margin = np.full(len(y), start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)

            def grow(rows: np.ndarray, left_depth: int, low: float, high: float) -> int:
                me = len(nodes)
                leaf = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
                nodes.append([0, 0.0, -1, -1, rate * leaf])
                if left_depth == 0 or len(rows) < 20:
                    margin[rows] += rate * leaf
                    return me
                best = (1e-6, -1, -1, 0.0, 0.0)
                all_g, all_h = g[rows].sum(), h[rows].sum()
                for j, direction in enumerate(directions):
                    c = codes[rows, j]
                    size = len(edges[j]) + 1
                    gl, hl = np.bincount(c, g[rows], size).cumsum()[:-1], np.bincount(c, h[rows], size).cumsum()[:-1]
                    gr, hr = all_g - gl, all_h - hl
                    wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - all_g**2 / (all_h + ridge)
                    bad = (hl < 0.5) | (hr < 0.5) | ((wr - wl) * direction < 0)
                    gain[bad] = -1
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), j, k, float(wl[k]), float(wr[k]))
                _, j, k, wl, wr = best
                if j < 0:
                    margin[rows] += rate * leaf
                    return me
                middle, falls = (wl + wr) / 2, directions[j]
                bound_l = (low, min(high, middle)) if falls > 0 else (max(low, middle), high) if falls < 0 else (low, high)
                bound_r = (max(low, middle), high) if falls > 0 else (low, min(high, middle)) if falls < 0 else (low, high)
                goes = codes[rows, j] <= k
                nodes[me][:2] = [j, float(edges[j][k])]
                nodes[me][2] = grow(rows[goes], left_depth - 1, *bound_l)
                nodes[me][3] = grow(rows[~goes], left_depth - 1, *bound_r)
                return me

            roots.append(grow(np.arange(len(y)), depth, -8.0, 8.0))
    if not roots:
        nodes, roots = [[0, 0.0, -1, -1, 0.0]], [0]
    a = np.array(nodes, float)
    return Forest(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), depth, start)


def _samples(batches):
    for batch in batches:
        for rows, data, offsets in pieces(batch):
            _, stats = statistics(rows, data, offsets)
            y = rows.column(rows.schema.get_field_index("y"))
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(rows)), y, pa.array(list(stats), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Forest:
    """Fit on at most ``sample`` labelled documents; the result does not depend on row order."""
    texts = keyed_texts(docs)
    chosen = texts.join(F.broadcast(labelled(labels, texts, "quality", sample)), "doc_id")
    got = chosen.mapInArrow(_samples, "doc_id bigint, y int, x array<double>").toPandas()
    got = got[got["x"].notna()].sort_values("doc_id", kind="stable") if len(got) else got
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["doc_id"].to_numpy(np.int64))) if len(got) else np.zeros(0, int)
    return fit(x[order], got["y"].to_numpy(float)[order], list(FEATURES.values()))


def score(docs: DataFrame, forest: Forest, reject_below: float = 0.5) -> DataFrame:
    """Base counts, ``base_failed``, ``score`` and ``kept`` of every document."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                base, stats = statistics(rows, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids_of(rows)), *[pa.array(c) for c in base.T.copy()], pa.array(forest.score(stats))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
                )

    scored = keyed_texts(docs).mapInArrow(run, SCHEMA + ", score double")
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= reject_below))


def keep_rows(docs: DataFrame, forest: Forest, reject_below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep; rows without an id are judged as well."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for rows, data, offsets in pieces(pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(batch.num_rows))], ["text", "row"])):
                base, stats = statistics(rows, data, offsets)
                kept = (base[:, 0] >= 10) & (100 * base[:, 4] <= 20 * base[:, 0]) & (forest.score(stats) >= reject_below)
                yield batch.take(rows.column(1).filter(pa.array(kept)))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    return score(docs, train(docs, labels, sample))
