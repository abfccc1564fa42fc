"""Sampled segmentations of a piece lattice, and their lossless decoding.

A text becomes space-led units, which no piece crosses, so the lattice of a text is
the chain of its units' lattices.  Forward filtering sums the weight of all paths
into each node of a unit once and is kept for the next occurrence; backward
sampling then draws one path per occurrence, all occurrences of a piece of the
batch together.  The draws are hashes of (row key, unit, step), so a row always
gets the same ids, whatever batch, worker or retry it runs in.

Weights: a piece's probability falls with its rank in the vocabulary to the power
``alpha``; a character without a piece is spelled in byte pieces.  Decoding joins
the pieces' bytes, turns marks into spaces and drops the leading one; a mark that
stands in the text itself is spelled in bytes, so every text comes back.

Cases: a null or empty text has no pieces and decodes to the empty text; rows
without an id are left out; repeated rows get equal ids; columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalloom.llm.common import keyed_texts
from evalloom.llm.text import STEP, mix, pieces, powers, span_hash

MARK = "▁"
KEPT_UNITS, TOGETHER = 100_000, 48
_unit = re.compile(r" *[^ ]+| +\Z")
RARE_WEIGHT = 1e-7


def points_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string and their prefix sums for span hashes."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * powers(STEP, len(points)), out=prefix[1:])
    return points, prefix


class Pieces:
    """Surface forms, weights and bytes of a vocabulary file."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = [-1] * 256
        self.bytes: list[bytes] = []
        self.ids: dict[str, tuple[int, float]] = {}
        rank = 0
        for i in range(model.get_piece_size()):
            surface = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(surface[3:-1], 16)
                self.byte[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                form = surface.replace(MARK, " ")
                self.bytes.append(form.encode())
                if " " not in form.lstrip(" "):
                    self.ids[form] = (i, (rank + 3.0) ** -alpha)
                rank += 1
        total = sum(w for _, w in self.ids.values())
        self.ids = {k: (i, w / total) for k, (i, w) in self.ids.items()}
        self.longest = max(map(len, self.ids))
        #: for each length the sorted hashes of all beginnings of pieces, and id (-1 where none ends here) and weight of each
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, self.longest + 1):
            begun = sorted({form[:size] for form in self.ids if len(form) >= size})
            points, prefix = points_of("".join(begun))
            at = np.arange(0, len(points), size)
            hashes = span_hash(prefix, at, at + size)
            order = np.argsort(hashes)
            ends = [self.ids.get(form, (-1, 0.0)) for form in begun]
            self.tables.append((hashes[order], np.array([i for i, _ in ends], np.int32)[order], np.array([w for _, w in ends], float)[order]))

    def spelled(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()]

    def lattice(self, unit: str) -> tuple[list[float], list[int], list[int], list[tuple[int, ...]]]:
        """Edges into each node 1..n: share of the node's weight so far, node, source, ids; forward filtering scales each node."""
        n = len(unit)
        weight = [1.0] + [0.0] * n  # each scaled by the log below, so long units don't underflow
        scale = [0.0] * (n + 1)
        cdf: list[float] = []
        node: list[int] = []
        source: list[int] = []
        ids: list[tuple[int, ...]] = []
        get = self.ids.get
        for j in range(1, n + 1):
            into = []
            for i in range(max(0, j - self.longest), j):
                hit = get(unit[i:j])
                if hit is not None:
                    into.append((i, (hit[0],), hit[1]))
            if not into or into[-1][0] != j - 1:
                into.append((j - 1, tuple(self.spelled(unit[j - 1])), RARE_WEIGHT))
            top = max(scale[i] for i, _, _ in into)
            parts = [weight[i] * math.exp(scale[i] - top) * p for i, _, p in into]
            total = sum(parts)
            run = 0.0
            for (i, piece, _), part in zip(into, parts, strict=True):
                run += part / total
                cdf.append(run)
                node.append(j)
                source.append(i)
                ids.append(piece)
            cdf[-1] = 1.0
            weight[j], scale[j] = 1.0, top + math.log(total)
        return cdf, node, source, ids


class Grown:
    """An array that doubles when it is full."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each pair of a start and a size."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


class Sampler:
    """Lattices of recent units as flat arrays.

    A unit has a run of nodes, a node a run of edges with rising shares.  When there
    are too many units those used most stay, at most half as many.
    """

    def __init__(self, vocabulary: Pieces, kept: int = KEPT_UNITS):
        self.vocabulary, self.kept = vocabulary, kept
        self.known: dict[str, int] = {}
        #: a piece below 0 stands for the bytes of a character: row -1 - piece
        self.bytes: list[list[int]] = []
        self.byte_rows: dict[str, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.first_node, self.length, self.uses = Grown(np.int64), Grown(np.int64), Grown(np.int64)
        self.first_edge = Grown(np.int64)
        self.shares, self.span, self.piece = Grown(float), Grown(np.uint8), Grown(np.int32)

    def _append(self, lengths: np.ndarray, first: np.ndarray, edges: np.ndarray, cdf: np.ndarray, span: np.ndarray, piece: np.ndarray) -> None:
        """Add units whose nodes are numbered from 0; ``edges`` counts those into each node."""
        self.first_node.add(first + self.first_edge.n)
        self.length.add(lengths)
        self.uses.add(np.zeros(len(lengths), np.int64))
        self.first_edge.add(np.cumsum(edges) - edges + self.shares.n)
        self.shares.add(cdf)
        self.span.add(span)
        self.piece.add(piece)

    @property
    def _node(self) -> np.ndarray:
        """The node into which each edge leads."""
        return np.repeat(np.arange(self.first_edge.n), np.diff(np.append(self.first_edge.all, self.shares.n)))

    @property
    def cdf(self) -> np.ndarray:
        """Node number plus running share of each edge."""
        return self._node + self.shares.all

    @property
    def source(self) -> np.ndarray:
        """The node from which each edge comes."""
        return self._node - self.span.all

    def _spelled(self, char: str) -> int:
        row = self.byte_rows.get(char)
        if row is None:
            row = self.byte_rows[char] = len(self.bytes)
            self.bytes.append(self.vocabulary.spelled(char))
        return -1 - row

    def _evict(self) -> None:
        """Keep the units used twice or more since they came, the most used first, and halve their counts."""
        uses = self.uses.all
        stay = np.flatnonzero(uses > 1)
        if len(stay) > self.kept // 2:
            stay = np.sort(stay[np.argsort(-uses[stay], kind="stable")[: self.kept // 2]])
        names = list(self.known)
        first, nodes = self.first_node.all[stay], self.length.all[stay] + 1
        at = _ranges(first, nodes)
        starts = np.append(self.first_edge.all, self.shares.n)
        edges = starts[at + 1] - starts[at]
        take = _ranges(starts[at], edges)
        kept = (self.length.all[stay], np.cumsum(nodes) - nodes, edges, self.shares.all[take], self.span.all[take], self.piece.all[take])
        self._empty()
        self._append(*kept)
        self.uses.all[:] = uses[stay] // 2
        self.known = {names[i]: k for k, i in enumerate(stay.tolist())}

    def _learn(self, units: list[str]) -> None:
        """Lattices of new units: short ones together, level by level; long ones each with scaled weights."""
        short = [u for u in units if len(u) <= TOGETHER]
        for unit in short:
            self.known[unit] = len(self.known)
        if short:
            self._learn_short(short)
        for unit in units:
            if len(unit) > TOGETHER:
                self.known[unit] = len(self.known)
                cdf, node, source, pieces_ = self.vocabulary.lattice(unit)
                into = np.array(node)
                piece = [ids[0] if j - i > 1 or unit[i:j] in self.vocabulary.ids else self._spelled(unit[i]) for i, j, ids in zip(source, node, pieces_, strict=True)]
                self._append(
                    np.array([len(unit)]), np.zeros(1, np.int64), np.bincount(into, minlength=len(unit) + 1),
                    np.array(cdf), into - np.array(source), np.array(piece, np.int32),
                )

    def _learn_short(self, units: list[str]) -> None:
        points, prefix = points_of("".join(units))
        size = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), size)
        char = np.arange(len(points))
        stop = np.cumsum(size)[unit]
        first = np.cumsum(size + 1) - size - 1
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        spelled = np.zeros(0, np.int64)
        for span, (hashes, ids, weights) in enumerate(self.vocabulary.tables, 1):
            char = char[char + span <= stop[char]]
            if not len(char):
                break
            got = span_hash(prefix, char, char + span)
            at = np.minimum(np.searchsorted(hashes, got), max(len(hashes) - 1, 0))
            begun = hashes[at] == got if len(hashes) else np.zeros(len(char), bool)
            hit = begun & (ids[at] >= 0) if len(hashes) else begun
            if span == 1:
                spelled = char[~hit]
            parts.append((char[hit], np.full(hit.sum(), span), ids[at[hit]], weights[at[hit]]))
            char = char[begun]  # elsewhere no longer piece starts either
        parts.append((spelled, np.ones(len(spelled), np.int64), np.full(len(spelled), -1, np.int32), np.full(len(spelled), RARE_WEIGHT)))
        begin, span, piece, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        source = begin + unit[begin]  # one node more for each unit before
        node = source + span
        order = np.lexsort((source, node))
        begin, source, node, piece, weight = begin[order], source[order], node[order], piece[order], weight[order]
        nodes = len(points) + len(units)
        # weights of the nodes as alpha * 2**scale: long runs of rare characters don't underflow, and scaling changes no digit
        alpha, scale = np.zeros(nodes), np.zeros(nodes, np.int64)
        alpha[first] = 1.0
        level = node - first[unit[begin]]
        by_level = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[by_level], np.arange(1, TOGETHER + 2))
        share = np.zeros(len(node))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            now = by_level[a:b]
            into, back = node[now], scale[source[now]]  # nodes ascend within a level
            begins = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
            reached, group = into[begins], np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(into))))
            top = np.maximum.reduceat(back, begins)
            part = np.ldexp(alpha[source[now]] * weight[now], np.maximum(back - top[group], -2000))
            total = np.bincount(group, part)
            share[now] = part / total[group]
            alpha[reached], more = np.frexp(total)
            scale[reached] = top + more
        opens = np.ones(len(node), bool)
        opens[1:] = node[1:] != node[:-1]
        starts = np.flatnonzero(opens)
        edges = np.diff(np.append(starts, len(node)))
        cdf = share.copy()  # summed inside each node: one unit's numbers never reach another's
        for k in range(1, int(edges.max(initial=0))):
            at = starts[edges > k] + k
            cdf[at] += cdf[at - 1]
        cdf = np.minimum(cdf, 1.0)
        closes = np.append(opens[1:], True)
        cdf[closes] = 1.0
        for k in np.flatnonzero(piece < 0).tolist():
            piece[k] = self._spelled(chr(points[begin[k]]))
        self._append(size, first, np.bincount(node, minlength=nodes), cdf, node - source, piece)

    def sample(self, keys: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text."""
        if len(self.known) > self.kept:
            self._evict()
        units: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for t, text in enumerate(texts):
            if text:
                found = _unit.findall(" " + text)
                counts[t] = len(found)
                units += found
        new = [u for u in dict.fromkeys(units) if u not in self.known]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        self.uses.all[:] += np.bincount(which, minlength=self.uses.n)
        first = self.first_node.all[which]
        at = first + self.length.all[which]
        first_edge, cdf, span, piece = self.first_edge.all, self.shares.all, self.span.all, self.piece.all
        bounds = np.concatenate([[0], np.cumsum(counts)])
        row = np.repeat(np.arange(len(texts)), counts)
        seed = mix(mix(keys.astype(np.uint64) + np.uint64(1))[row] + (np.arange(len(units)) - bounds[row]).astype(np.uint64))
        alive = np.arange(len(units))
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(alive):
            u = (mix(seed[alive] + np.uint64((0xA0761D6478BD642F * (step + 1)) % (1 << 64))) >> np.uint64(11)) * 2.0**-53
            edge = first_edge[at[alive]]
            # the first edge whose running share covers 1 - u; a node's last share is 1
            short = np.flatnonzero(cdf[edge] < 1 - u)
            while len(short):
                edge[short] += 1
                short = short[cdf[edge[short]] < 1 - u[short]]
            taken.append((alive, edge))
            at[alive] -= span[edge]
            alive = alive[at[alive] > first[alive]]
            step += 1
        steps = np.bincount(np.concatenate([a for a, _ in taken]), minlength=len(units)) if taken else np.zeros(len(units), np.int64)
        end = np.cumsum(steps)
        path = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
        for k, (a, edge) in enumerate(taken):
            path[end[a] - 1 - k] = edge
        out = piece[path]
        width = np.ones(len(path), np.int64)
        rare = np.flatnonzero(out < 0)
        if len(rare):
            rows = [self.bytes[r] for r in (-1 - out[rare]).tolist()]
            width[rare] = [len(r) for r in rows]
            out = np.repeat(out, width)
            out[_ranges((np.cumsum(width) - width)[rare], width[rare])] = [b for r in rows for b in r]
        per_unit = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(units)), steps), width, len(units)).astype(np.int64))])
        return out, per_unit[bounds]


def decode(vocabulary: Pieces, ids: np.ndarray) -> str:
    """The text of an id sequence."""
    table = vocabulary.bytes
    return b"".join([table[i] for i in ids.tolist()])[1:].decode()


def sample_pieces(docs: DataFrame, path: str, alpha: float = 1.0, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), lossless (the decoded ids give the text), and ids where asked."""

    def run(batches):
        vocabulary = Pieces(path, alpha)
        sampler = Sampler(vocabulary)
        for batch in batches:
            for rows, _, _ in pieces(batch):
                keys = rows.column(0).to_numpy(zero_copy_only=False)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                ids, bounds = sampler.sample(keys, texts)
                parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [
                    pa.array(keys), pa.array(np.diff(bounds)), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                    pa.array([decode(vocabulary, p) == t for p, t in zip(parts, texts, strict=True)], pa.bool_()),
                ]
                names = ["doc_id", "n_pieces", "ids_crc32", "lossless"]
                if keep_ids:
                    columns.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean" + ", ids array<int>" * keep_ids
    return keyed_texts(docs).mapInArrow(run, schema)
