"""Quality classifier: gated attention over the passages of a document.

Every passage of ``PASSAGE`` words of the whole text is encoded from hashed words
and byte classes; gated attention weighs the encodings and a logistic unit scores
their weighted sum.  All weights are learned from document labels only, on the
driver, from a bounded sample (``sample`` rows, half of each label where there are
as many, smallest hashes of their ids) of the labelled rows of the given documents
outside the held-out fold.

Cases: a null or empty text is one passage without words; rows without an id are
left out; repeated rows each get their row; without labels, or with one label
only, every score is that share of ones (0.5 without labels).  Columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import keyed_texts, labelled, remainder
from evalloom.llm.quality_rules import CODE_POINT, DIGIT, MARK, SYMBOLS, UPPER
from evalloom.llm.text import Words, ids_of, pieces

PASSAGE, HASHED, HIDDEN, GATE = 64, 48, 24, 12
SIZE = HASHED + 9


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the first passage of each row (then the total)."""
    words = Words(data, offsets)
    hashes = words.hashes()
    n = len(offsets) - 1
    per = np.maximum(1, -(-words.counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    of = first[words.row] + (np.arange(len(hashes)) - words.bounds[words.row]) // PASSAGE
    m = int(first[-1])
    count = np.bincount(of, minlength=m)
    some = np.maximum(count, 1)[:, None]
    x = np.zeros((m, SIZE), np.float32)
    bag = np.bincount(of * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), minlength=m * HASHED).reshape(m, HASHED)
    x[:, :HASHED] = np.sqrt(bag / some)
    sums = lambda flags: np.bincount(of, (c := np.concatenate([[0], np.cumsum(flags)]))[words.ends] - c[words.starts], m)
    length = np.maximum(np.bincount(of, words.ends - words.starts, m), 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    _, once = np.unique(hashes ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    rest = [
        sums(UPPER[data]) / length, sums(DIGIT[data]) / length, sums(SYMBOLS[data]) / length * 4, sums(MARK[data]) / length * 2,
        np.bincount(of[same], minlength=m) / some[:, 0], np.bincount(of[once], minlength=m) / some[:, 0],
        sums(CODE_POINT[data]) / some[:, 0] / 8, np.minimum(count / PASSAGE, 1), length / 512,
    ]
    x[:, HASHED:] = np.stack(rest, 1)
    return x, first


def attend(weights: dict, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
    """Score of each row and what the gradient needs."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ weights["w"] + weights["b"])
    t, s = np.tanh(h @ weights["v"]), 1 / (1 + np.exp(-(h @ weights["u"])))
    e = (t * s) @ weights["a"]
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[row])
    alpha = e / np.add.reduceat(e, first[:-1])[row]
    z = np.add.reduceat(alpha[:, None] * h, first[:-1], 0)
    p = 1 / (1 + np.exp(-(z @ weights["c"] + weights["d"])))
    return p, {"row": row, "h": h, "t": t, "s": s, "alpha": alpha, "z": z}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 30, rows: int = 128, rate: float = 0.01, seed: int = 7) -> dict:
    """Adam on the log loss; the order of the rows and the seed fix the result."""
    rng = np.random.default_rng(seed)
    shape = {"w": (SIZE, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    weights = {k: rng.normal(0, 0.2, s) for k, s in shape.items()}
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weights["d"][:] = np.log(share / (1 - share))
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / spread
    m1, m2, step = {k: 0 * v for k, v in weights.items()}, {k: 0 * v for k, v in weights.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), rows):
            take = order[at : at + rows]
            bounds = np.concatenate([[0], np.cumsum(first[take + 1] - first[take])])
            part = x[np.concatenate([np.arange(first[i], first[i + 1]) for i in take])]
            p, k = attend(weights, part, bounds)
            dz = ((p - y[take]) / len(take))[:, None]
            row, h, alpha = k["row"], k["h"], k["alpha"]
            grad = {"c": (dz * k["z"]).sum(0), "d": dz.sum(0)}
            to_z = (dz * weights["c"])[row]
            d_alpha = (to_z * h).sum(1)
            d_e = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, bounds[:-1])[row])
            d_ts = d_e[:, None] * weights["a"]
            d_t, d_s = d_ts * k["s"] * (1 - k["t"] ** 2), d_ts * k["t"] * k["s"] * (1 - k["s"])
            d_h = (alpha[:, None] * to_z + d_t @ weights["v"].T + d_s @ weights["u"].T) * (1 - h**2)
            grad |= {"a": (k["t"] * k["s"]).T @ d_e, "v": h.T @ d_t, "u": h.T @ d_s, "w": part.T @ d_h, "b": d_h.sum(0)}
            step += 1
            for name, g in grad.items():
                g = g + 1e-4 * weights[name]
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.999 * m2[name] + 0.001 * g * g
                weights[name] = weights[name] - rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
    # the scaling of the inputs becomes part of the first layer
    weights["b"] = weights["b"] - (mean / spread) @ weights["w"]
    weights["w"] = weights["w"] / spread[:, None]
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _samples(batches):
    for batch in batches:
        for rows, data, offsets in pieces(batch):
            x, first = passages(data, offsets)
            y = rows.column(rows.schema.get_field_index("y"))
            packed = [x[first[i] : first[i + 1]].astype("<f4").tobytes() for i in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(rows)), y, pa.array(packed, pa.binary())], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 3_000, folds: int = 5, held: int = 0) -> dict | float:
    """Weights, or the constant score where both labels do not occur."""
    texts = keyed_texts(docs)
    chosen = labelled(labels, texts, "quality", sample, balanced=True, where=remainder("doc_id", folds) != held)
    rows = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(_samples, "doc_id bigint, y int, x binary").toPandas()
    if not len(rows):
        return 0.5
    rows = rows.sort_values(["doc_id", "x"], kind="stable")
    y = rows["y"].to_numpy(float)
    if y.min() == y.max():
        return float(y[0])
    parts = [np.frombuffer(b, "<f4").reshape(-1, SIZE) for b in rows["x"]]
    return fit(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), y)


def score(docs: DataFrame, weights: dict | float) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                x, first = passages(data, offsets)
                p = np.full(len(first) - 1, weights) if isinstance(weights, float) else attend(weights, x, first)[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids_of(rows)), pa.array(p.astype(float))], ["doc_id", "score"])

    return keyed_texts(docs).mapInArrow(run, "doc_id bigint, score double")


def keep_rows(docs: DataFrame, weights: dict | float, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``; rows without an id are judged as well."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for rows, data, offsets in pieces(pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(batch.num_rows))], ["text", "row"])):
                x, first = passages(data, offsets)
                p = np.full(len(first) - 1, weights) if isinstance(weights, float) else attend(weights, x, first)[0]
                yield batch.take(rows.column(1).filter(pa.array(p >= threshold)))

    return docs.mapInArrow(run, docs.schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = 3_000, threshold: float = 0.3) -> DataFrame:
    scored = score(docs, train(docs, labels, sample))
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
