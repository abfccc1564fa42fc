"""Repeated word windows by a compressed FM-index per shard.

Segments whose anchors occur again (see ``anchors``) are gathered in shards.  A
shard's words are numbered, their Burrows-Wheeler transform is held in a wavelet
matrix, and the segments are streamed against it: backward search extends every
match word by word, and a match that reaches ``size`` words is reported with its
interval of the index, from which the smallest document of the window follows.
The order of the suffixes only has to hold for as many words as a search takes.

Cases: a null or empty text has no words; fewer than ``size`` words are never
removed; windows never cross documents; rows of one id never remove each other's
windows; rows that share an id but not a text are one document for the removal;
rows without an id are left out; an empty table gives no rows; columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.anchors import by_shard, contents, ranks_by_doubling, repeated_segments, segments
from evalloom.llm.common import cut_lineage, drop_written, keyed_texts
from evalloom.llm.text import STEP, Words, ids_of, mix, pieces, running

GRAM = 4


def word_segments(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Segments of the windows of ``size`` words."""
    words = Words(data, offsets)
    hashes = words.hashes()
    gram = min(GRAM, size)
    n = len(hashes) - gram + 1
    if n <= 0:
        return segments(np.zeros(0, np.uint64), words.bounds, size, gram)
    joined = hashes[:n].copy()
    for j in range(1, gram):
        joined *= STEP
        joined += hashes[j : n + j]
    return segments(mix(joined), words.bounds, size, gram)


class FMIndex:
    """Backward search over the Burrows-Wheeler transform of numbered words.

    The transform is kept as a wavelet matrix: one bit vector for each bit of the
    numbers, the most significant first, with the running count of its zeros.
    """

    def __init__(self, codes: np.ndarray, reach: int):
        order, _ = ranks_by_doubling(codes, 1 << (reach - 1).bit_length())
        self.order = order
        self.kinds = int(codes.max()) + 1 if len(codes) else 1
        self.bits = max(1, (self.kinds - 1).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=self.kinds))])
        column = codes[order - 1]  # the word before each suffix; the first place is preceded by the last
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            up = (column >> bit) & 1
            count = np.zeros(len(column) + 1, np.int32)
            np.cumsum(up == 0, out=count[1:])
            self.zeros.append(count)
            column = np.concatenate([column[up == 0], column[up == 1]])
        self.base = self._follow(np.arange(self.kinds), np.zeros(self.kinds, np.int64))

    def _follow(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each word's occurrences before ``at`` end in the last level."""
        for level, count in enumerate(self.zeros):
            up = (words >> (self.bits - 1 - level)) & 1
            below = count[at]
            at = np.where(up == 1, count[-1] + at - below, below)
        return at

    def extend(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more word in front."""
        start = self.first[words] - self.base[words]
        return start + self._follow(words, low), start + self._follow(words, high)


def window_matches(index: FMIndex, codes: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Interval of the index for the ``size`` words from each place; empty where the words don't occur."""
    last = codes[places + size - 1]
    low, high = index.first[last], index.first[last + 1]
    alive = np.arange(len(places))
    for back in range(size - 2, -1, -1):
        low[alive], high[alive] = index.extend(codes[places[alive] + back], low[alive], high[alive])
        alive = alive[high[alive] > low[alive]]
    return low, high


def smallest_documents(bodies: list[bytes], lows: np.ndarray, size: int) -> list[np.ndarray]:
    """For each body, the smallest document among all bodies that hold each of its windows."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    words = Words(data, offsets)
    numbered = np.unique(words.hashes(running(data)), return_inverse=True)[1] + 2
    # a body ends in the word 1, which no window holds
    at = np.arange(len(numbered)) + words.row
    codes = np.ones(len(numbered) + len(bodies), np.int64)
    codes[at] = numbered
    body = np.repeat(np.arange(len(bodies)), words.counts + 1)
    index = FMIndex(codes, size)
    per = np.maximum(words.counts - size + 1, 0)
    first = words.bounds[:-1] + np.arange(len(bodies))
    places = np.repeat(first - np.cumsum(per) + per, per) + np.arange(per.sum())
    low, high = window_matches(index, codes, places, size)
    out = np.zeros(len(places), np.int64)
    if len(places):
        # intervals of equal length are equal or disjoint
        starts, back = np.unique(low, return_inverse=True)
        ends = np.zeros(len(starts), np.int64)
        ends[back] = high
        holder = np.append(lows[body[index.order]], np.iinfo(np.int64).max)
        out = np.minimum.reduceat(holder, np.stack([starts, ends], 1).ravel())[::2][back]
    cuts = np.cumsum(per)
    return [out[b - n : b] for b, n in zip(cuts.tolist(), per.tolist(), strict=True)]


def repeated_windows(docs: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, low, high): runs of words inside windows that also start in a document with a smaller id."""
    texts = keyed_texts(docs)
    held = repeated_segments(texts, lambda data, offsets: word_segments(data, offsets, size), F.col("low") < F.col("high"))

    def slices(data, offsets, row, start, n):
        words = Words(data, offsets)
        top = words.bounds[row + 1]
        a = words.bounds[row] + start
        b = np.minimum(a + n - 1 + size, top)
        fits = a + size <= b
        if not len(words.starts):
            return np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        return np.where(fits, words.starts[np.minimum(a, len(words.starts) - 1)], 0), np.where(fits, words.ends[np.maximum(b - 1, 0)], 0)

    found = cut_lineage(contents(texts, held, slices).drop("n"), "contents", "zstd")
    drop_written(docs.sparkSession, held)

    def solve(bodies, copies, lows):
        smallest = smallest_documents(bodies, lows, size)
        return range(len(bodies)), pa.array([x.astype("<i8").tobytes() for x in smallest], pa.binary())

    solved = cut_lineage(by_shard(found.select("digest", "name", "content", "doc_id"), solve, "digest binary, smallest binary"), "smallest")

    def runs(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            doc, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            column = batch.column(2).cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
            per = np.diff(at) // 8
            smallest = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view("<i8") if at[-1] > at[0] else np.zeros(0, np.int64)
            row = np.repeat(np.arange(n), per)
            hit = smallest < doc[row]
            opens, closes = hit.copy(), hit.copy()
            same = row[1:] == row[:-1]
            opens[1:] &= ~(hit[:-1] & same)
            closes[:-1] &= ~(hit[1:] & same)
            first = np.repeat(np.cumsum(per) - per, per)
            a, b = np.flatnonzero(opens), np.flatnonzero(closes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[row[a]]), pa.array((start[row[a]] + a - first[a]).astype(np.int32)), pa.array((start[row[b]] + b - first[b] + size).astype(np.int32))],
                ["doc_id", "low", "high"],
            )

    placed = found.select("doc_id", "start", "digest").join(solved, "digest").select("doc_id", "start", "smallest")
    out = cut_lineage(placed.mapInArrow(runs, "doc_id bigint, low int, high int"), "spans")
    drop_written(docs.sparkSession, found, solved)
    return out


def remove_windows(docs: DataFrame, size: int = 13, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; with ``keep_text`` the kept words as text."""
    spans = repeated_windows(docs, size).groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("s"))

    def run(batches):
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                words = Words(data, offsets)
                listed = rows.column(rows.schema.get_field_index("s"))
                flat = listed.flatten()
                low, high = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                row = np.repeat(np.arange(rows.num_rows), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                low, high = np.minimum(words.bounds[row] + low, words.bounds[row + 1]), np.minimum(words.bounds[row] + high, words.bounds[row + 1])
                depth = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(depth, low, 1)
                np.add.at(depth, high, -1)
                gone = np.cumsum(depth[:-1]) > 0
                removed = np.bincount(words.row[gone], minlength=rows.num_rows).astype(np.int64)
                whole = data.tobytes()
                digests, kept = [], []
                for i in range(rows.num_rows):
                    if removed[i]:
                        mine = np.arange(words.bounds[i], words.bounds[i + 1])[~gone[words.bounds[i] : words.bounds[i + 1]]]
                        left = b" ".join([whole[a:b] for a, b in zip(words.starts[mine].tolist(), words.ends[mine].tolist(), strict=True)])
                    else:
                        left = b" ".join(whole[offsets[i] : offsets[i + 1]].split())
                    digests.append(hashlib.sha256(left).hexdigest())
                    if keep_text:
                        kept.append(left.decode())
                columns = [pa.array(ids_of(rows)), pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array(kept, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    return keyed_texts(docs).join(spans, "doc_id", "left").select("doc_id", "text", "s").mapInArrow(run, schema)
