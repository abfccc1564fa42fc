"""Best-fit packing under several capacities: tokens, documents and attention cost.

Tokens are counted where the texts are.  A piece's demand depends on its length
alone (tokens: length, documents: 1, attention: length squared), so the packing is
decided on the counts of the lengths, at most ``capacity`` of them whatever the
input: lengths fall, and each goes to the open bins that every constraint allows
and that a weighted residual norm (or a weighted dot-product) prefers.  The plan
says for each run of ranks within a length which bins it fills; ranks come from a
salted window and are looked up in the plan where the pieces are.

Cases: a null or empty text is the closing id alone; rows without an id are left
out; repeated rows are packed each; an empty table gives no rows; columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.common import cut_lineage, keyed_texts

CAPACITY, END_ID, CACHED = 2048, 0, 300_000
_merging = re.compile(r" (?=\s|\Z)")


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Bytes of every piece of a byte-level vocabulary, whose printable stand-ins are undone."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(stand_in[c] for c in piece): i for piece, i in vocabulary.items() if all(c in stand_in for c in piece)}


class Encoder:
    """Ids of whole texts as packed little-endian integers.

    The tokenizer never joins two words over a space that a word follows, so a text
    is the sequence of its space-led words; ids of recent words are kept.  With
    ``added`` the file's added tokens get their own ids where they stand in a text,
    as the library does by default; without it they are spelled like other text.
    """

    def __init__(self, path: str, added: bool = False):
        import public_tokenizers
        import tiktoken

        with open(path) as f:
            saved = json.load(f)
        special = {t["content"] for t in saved.get("added_tokens", [])}
        ranks = byte_ranks({k: v for k, v in saved["model"]["vocab"].items() if k not in special})
        self.encode = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kept: dict[str, bytes] = {}
        tokens = saved.get("added_tokens", []) if added else []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in tokens}
        #: the longest of the tokens that begin at a place
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if tokens else None

    def _packed(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def _word(self, word: str) -> bytes:
        got = self._packed(" " + word)
        if len(word) <= 40:
            if len(self.kept) >= CACHED:
                self.kept.clear()
            self.kept[word] = got
        return got

    def __call__(self, text: str) -> bytes:
        if self.split is None:
            return self._plain(text)
        parts = self.split(text)
        if len(parts) == 1:
            return self._plain(text)
        return b"".join([self.added[x] if k % 2 else self._plain(x) for k, x in enumerate(parts)])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if _merging.search(text):
            first, rest = first, rest.copy()
            joined: list[str] = [first]
            for part in rest:
                if not part or part[0].isspace():
                    joined[-1] += " " + part
                else:
                    joined.append(part)
            first, *rest = joined
        kept = self.kept
        try:
            return self._packed(first) + b"".join([kept[w] for w in rest])
        except KeyError:
            return self._packed(first) + b"".join([kept[w] if w in kept else self._word(w) for w in rest])


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; the first piece of a longer document takes what is left over."""

    def run(batches):
        encode = Encoder(path, added)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = memoryview(encode(text or "") + end)
                n = len(packed) // 4
                cut = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(cut, n, capacity)]):
                    to = cut if k == 0 else at + capacity
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(packed[4 * at : 4 * to]))
                    if keep_ids:
                        ids.append(packed[4 * at : 4 * to].tobytes())
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return keyed_texts(docs).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacities: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), by: str = "norm") -> np.ndarray:
    """Rows (length, first rank, ranks, first bin, offset) that place every piece.

    ``counts``: pieces of each length.  Bins with the same content are one range of
    numbers; a step puts one piece into each bin of a range, or into as many as
    there are pieces.  ``by``: the smallest weighted norm of what is left, or the
    largest weighted dot-product of demand and room.
    """
    caps, w = np.array(capacities, float), np.array(weights, float)
    room = np.zeros((0, 3))
    start = np.zeros(0, np.int64)
    size = np.zeros(0, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        left, rank, most = counts[length], 0, int((caps // need).min())
        while left:
            fits = (room >= need).all(1) if len(room) else np.zeros(0, bool)
            if fits.any():
                at = np.flatnonzero(fits)
                rest = (room[at] - need) / caps
                value = ((w * rest**2).sum(1)) if by == "norm" else -(w * room[at] / caps * need / caps).sum(1)
                i = int(at[value.argmin()])
                k = min(left, int(size[i]))
                out.append((length, rank, k, int(start[i]), int(caps[0] - room[i, 0])))
                if k < size[i]:  # the rest of the range keeps its room
                    room, start, size = np.vstack([room, room[i]]), np.append(start, start[i] + k), np.append(size, size[i] - k)
                room[i] -= need
                size[i] = k
                if room[i, 0] < 1 or room[i, 1] < 1:
                    room, start, size = np.delete(room, i, 0), np.delete(start, i), np.delete(size, i)
                rank, left = rank + k, left - k
            else:
                new = max(1, left // most)
                room, start, size = np.vstack([room, caps]), np.append(start, bins), np.append(size, new)
                bins += new
    return np.array(out, np.int64).reshape(-1, 5)


def place(pieces: DataFrame, steps: np.ndarray, total: int, per_salt: int = 20_000) -> DataFrame:
    """``sequence_id`` and ``offset`` of every piece."""
    salts = max(8, -(-total // per_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "salt", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("local", local).join(sizes, ["length", "salt"]).withColumn("rank", F.col("ahead") + F.col("local") - 1).drop("local", "ahead", "salt")
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[order]
    key = steps[:, 0] * (1 << 44) + steps[:, 1]

    def run(batches):
        for batch in batches:
            of = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            rank = of("rank")
            at = np.searchsorted(key, of("length") * (1 << 44) + rank, "right") - 1
            columns = [c for c in batch.schema.names if c != "rank"]
            added = [pa.array(steps[at, 3] + rank - steps[at, 1]), pa.array(steps[at, 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), *added], [*columns, "sequence_id", "offset"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(run, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def best_fit_pack(docs: DataFrame, path: str, capacity: int = CAPACITY, documents: int = CAPACITY, attention: float | None = None, by: str = "norm", keep_ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces with their place.  ``added`` gives the file's added tokens their own ids; ``attention`` bounds the sum of squared lengths of a sequence (default: no tighter than the tokens)."""
    pieces = cut_lineage(tokenise(docs, path, capacity, keep_ids, added), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(counts, (capacity, documents, capacity**2 if attention is None else attention), by=by)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "sequence_id", "offset"]
    return place(pieces, steps, sum(counts.values())).select(columns)
