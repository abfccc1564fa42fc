"""Near-duplicates by b-bit MinHash.

Documents with equal shingle sets become one class.  Of a class's minima the low
``BITS`` bits are packed; bands of full minima propose pairs, the packed bits of a
pair are compared by counting, the share of equal codes is corrected for chance,
and only pairs that could still reach the threshold are confirmed on the full
shingle sets.  A bucket first proposes its smallest class against all others.  What
these links leave in different components is then compared inside tasks, in pairs of
blocks of a bucket: by packed bits first; classes that come near the threshold there
get their shingle sets, once a block, and the task returns the links that join
components, a forest at most.  So rows stay in proportion to classes and blocks, and a
link between different texts is lost only where no band of it agrees (about 1 in 2
million at 0.85, 1 in 20,000 at 0.80) or its estimate falls short by four standard
deviations.

Cases: fewer words than a shingle make the whole sequence one shingle; null or
empty texts and texts without words have an empty set and link with nothing; equal
texts link; rows without an id are left out; a repeated id counts as one document
if its rows are equal and keeps a row for each otherwise; an empty table gives no
rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import components, cut_lineage, drop_written, keyed_texts
from evalloom.llm.text import LOWER, STEP, Words, ids_of, mix, pieces, windows

HASHES, BITS, BAND_ROWS, BANDS = 256, 4, 5, 25
#: classes of a block of a bucket, and shingles of all its classes
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
_rng = np.random.default_rng(128)
FACTOR = (_rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
EQUAL_CODES = np.array([(b >> 4 == 0) + (b & 15 == 0) for b in range(256)], np.uint8)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, row by row in rising order, and the bounds of the rows."""
    words = Words(LOWER[data], offsets)
    hashes = words.hashes()
    start, keys = windows(hashes, words.bounds, width)
    row = words.row[start]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            more = words.counts[short] > j
            whole[more] = whole[more] * STEP + hashes[words.bounds[short[more]] + j]
        keys = np.concatenate([keys, mix(whole + words.counts[short].astype(np.uint64))])
        row = np.concatenate([row, short])
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    keys, row = keys[new], row[new]
    return keys, np.searchsorted(row, np.arange(len(offsets)))


def _signatures(batches):
    for batch in batches:
        for rows, data, offsets in pieces(batch):
            keys, bounds = shingles(data, offsets)
            n = len(offsets) - 1
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            minima = np.zeros((HASHES, n), np.uint32)
            if len(full):
                x = (keys >> np.uint64(32)).astype(np.uint32)
                for k in range(HASHES):
                    minima[k, full] = np.minimum.reduceat(x * FACTOR[k] + SHIFT[k], bounds[full])
            codes = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint8)
            packed = np.ascontiguousarray((codes[0::2] << 4 | codes[1::2]).T)
            bands = np.zeros((n, BANDS), np.uint64)
            for b in range(BANDS):
                h = np.full(n, b + 1, np.uint64)
                for r in range(BAND_ROWS):
                    h = h * STEP + minima[b * BAND_ROWS + r]
                bands[:, b] = mix(h)
            sums = _sums(keys, bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids_of(rows)), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                    pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands.view(np.int64).ravel())),
                    pa.array([p.tobytes() for p in packed], pa.binary()),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "packed"],
            )


def _sums(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that name the set of each row."""
    sums = np.zeros((2, len(keys) + 1), np.uint64)
    np.cumsum(mix(keys), out=sums[0, 1:])
    np.cumsum(mix(keys ^ STEP), out=sums[1, 1:])
    return (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64)


def _sets(batches):
    for batch in batches:
        for rows, data, offsets in pieces(batch):
            keys, bounds = shingles(data, offsets)
            sets = [keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(rows)), pa.array(_sums(keys, bounds)[0]), pa.array(sets, pa.binary())], ["rep", "k1", "keys"])


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, a 128-bit key of the set, band keys and packed low bits of every document."""
    return keyed_texts(docs).mapInArrow(_signatures, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, packed binary")


def estimate(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Similarity of packed signatures: share of equal codes, less what chance makes equal."""
    n = len(left)
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(n, HASHES * BITS // 8) for x in (left, right))
    return corrected(a, b)


def corrected(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    equal = EQUAL_CODES[a ^ b].sum(1, dtype=np.int64) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def lowest_estimate(percent: int) -> float:
    """Four standard deviations below the threshold."""
    share, chance = percent / 100, 2.0**-BITS
    equal = share + (1 - share) * chance
    return share - 4 * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def confirm(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` of classes whose sets are similar: estimated first, then on full sets."""
    floor = lowest_estimate(percent)

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(estimate(batch.column(2), batch.column(3)) >= floor)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(keep)

    def similar(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            # the larger side first: pieces are cut by its bytes
            for rows, data, offsets in pieces(batch, "text_u", 1 << 19):
                left, lb = shingles(data, offsets)
                other = rows.column(names.index("text_v"))
                _, data, offsets = next(pieces(pa.RecordBatch.from_arrays([other], ["text"]), limit=1 << 62))
                right, rb = shingles(data, offsets)
                n = len(lb) - 1
                # a shingle of a pair is in both sets if it stands twice in the pair
                row = np.concatenate([np.repeat(np.arange(n), np.diff(lb)), np.repeat(np.arange(n), np.diff(rb))])
                both = np.concatenate([left, right])
                order = np.lexsort((both, row))
                both, row = both[order], row[order]
                twice = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
                common = np.bincount(row[1:][twice], minlength=n)
                union = np.diff(lb) + np.diff(rb) - common
                keep = pa.array((100 * common >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], ["u", "v"]).filter(keep)

    side = lambda of: reps.select(F.col("rep").alias(of), F.col("packed").alias(f"packed_{of}"))
    near = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "packed_u", "packed_v").mapInArrow(likely, "u bigint, v bigint")
    near = cut_lineage(near, "near-pairs")
    asked = near.select(F.col("u").alias("doc_id")).unionByName(near.select(F.col("v").alias("doc_id"))).distinct()
    # a rare id on several rows names the class of its smallest text
    held = cut_lineage(texts.join(asked.hint("merge"), "doc_id"), "asked-texts")
    text = lambda of: held.select(F.col("doc_id").alias(of), F.col("text").alias(f"text_{of}"))
    return near.join(text("u"), "u").join(text("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(similar, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    spark = docs.sparkSession
    texts = keyed_texts(docs)
    signed = cut_lineage(signatures(docs), "signatures")
    filled = signed.filter("n_shingles > 0")
    classes = filled.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = signed.select(F.col("doc_id").alias("rep"), "k1", "k2", "n_shingles", "bands", "packed").join(classes, ["k1", "k2", "n_shingles", "rep"], "left_semi")
    reps = cut_lineage(reps.select("rep", "k1", F.col("n_shingles").alias("size"), "bands", "packed"), "classes")
    buckets = cut_lineage(_shared(reps.select(F.posexplode("bands").alias("band", "bucket"), "rep", "size")), "buckets")

    centre = buckets.groupBy("bucket").agg(F.min("rep").alias("u"))
    pairs = buckets.join(centre, "bucket").select("u", F.col("rep").alias("v")).filter("u <> v").distinct()
    links = cut_lineage(confirm(pairs, reps, texts, percent), "links")
    joined = components(links)

    more = _between_parts(buckets, joined, reps, texts, percent)
    # later links join whole components
    part = lambda of: joined.select(F.col("node").alias(of), F.col("component").alias(f"part_{of}"))
    between = more.join(part("u"), "u", "left").join(part("v"), "v", "left").select(F.coalesce("part_u", "u").alias("u"), F.coalesce("part_v", "v").alias("v"))
    merged = components(between).select(F.col("node").alias("own"), F.col("component").alias("whole"))

    member = filled.select("doc_id", "k1", "k2", "n_shingles").distinct().join(classes, ["k1", "k2", "n_shingles"])
    placed = member.join(joined, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("part"))
    named = placed.join(merged, F.col("part") == F.col("own"), "left").select("doc_id", "n_shingles", F.coalesce("whole", "part").alias("component_id"))
    alone = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")).distinct()
    out = cut_lineage(named.unionByName(alone), "components")
    drop_written(spark, signed, reps, buckets, links, more)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


CELL = ["bucket", "kind", "x", "y"]


def _between_parts(buckets: DataFrame, joined: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` that join the components of classes that share a bucket: a forest from each cell.

    A bucket above ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles is dealt in blocks,
    those of its main component only against the others.  A cell is one pair of
    blocks; a task holds one cell at a time.
    """
    spark = reps.sparkSession
    placed = buckets.join(joined, F.col("rep") == F.col("node"), "left").select("band", "bucket", "rep", "size", F.coalesce("component", "rep").alias("part"))
    placed = cut_lineage(placed, "placed")
    mixed = placed.groupBy("bucket").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("part", "rep").alias("main"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes")
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("sizes") / BLOCK_SHINGLES))
    mixed = mixed.filter("low <> high").select("bucket", "main", blocks.alias("k"))
    salted = placed.join(mixed, "bucket").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("k")))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)
    cell = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    zero, salt = F.lit(0).cast("bigint"), F.col("salt")
    cells = (
        F.when(F.col("k") == 1, F.array(cell(0, zero, zero, F.lit(0))))
        .when(F.col("part") == F.col("main"), F.transform(others, lambda t: cell(1, salt, t, F.lit(1))))
        .otherwise(
            F.concat(
                F.transform(others, lambda t: cell(1, t, salt, F.lit(2))),
                F.transform(others, lambda t: cell(2, F.least(salt, t), F.greatest(salt, t), F.when(salt == t, 0).when(salt < t, 1).otherwise(2))),
            )
        )
    )
    dealt = salted.select("band", "bucket", "rep", "part", F.explode(cells).alias("c")).select("band", "bucket", "rep", "part", "c.*")
    dealt = dealt.join(reps, "rep").select(*CELL, "side", "band", "part", "rep", "k1", "size", "packed", "bands")
    near = cut_lineage(_by_cell(dealt).mapInArrow(_near_rows(percent), dealt.schema), "near-rows")

    asked = near.select(F.col("rep").alias("doc_id")).distinct()
    sets = texts.join(asked.hint("merge"), "doc_id").mapInArrow(_sets, "rep bigint, k1 bigint, keys binary")
    sets = cut_lineage(sets, "asked-sets")
    held = near.join(sets.dropDuplicates(["rep", "k1"]).hint("merge"), ["rep", "k1"])
    links = cut_lineage(_by_cell(held).mapInArrow(_joining_links(percent), "u bigint, v bigint").distinct(), "links")
    drop_written(spark, placed, near, sets)
    return links


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def _cells(batches):
    """The rows of one cell after another, as a table, from batches sorted by cell."""
    open_, key = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in CELL])
        cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            name = tuple(at[:, a])
            if name != key and open_:
                yield pa.Table.from_batches(open_).combine_chunks()
                open_ = []
            key = name
            open_.append(batch.slice(a, b - a))
    if open_:
        yield pa.Table.from_batches(open_).combine_chunks()


def _near_pairs(cell: pa.Table, percent: int):
    """(part, then runs of row pairs) whose sizes and packed bits allow a link and whose first shared band is the cell's.

    Pairs come as ``i, j`` arrays for 64 rows ``i`` at a time; ``part`` may be
    joined up by the caller between two runs.
    """
    floor = lowest_estimate(percent)
    column = lambda name: cell.column(name).to_numpy()
    side, size, band = column("side"), column("size"), column("band")[0]
    n = cell.num_rows
    packed = np.frombuffer(b"".join(cell.column("packed").to_pylist()), np.uint8).reshape(n, -1)
    bands = cell.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    part = column("part").copy()
    yield part
    places = np.arange(n)
    for at in range(0, n, 64):
        rows = slice(at, min(at + 64, n))
        open_ = part[rows, None] != part[None, :]
        open_ &= np.where(side[rows, None] == 0, (side[None, :] == 0) & (places[rows, None] < places[None, :]), (side[rows, None] == 1) & (side[None, :] == 2))
        open_ &= 100 * np.minimum(size[rows, None], size[None, :]) >= percent * np.maximum(size[rows, None], size[None, :])
        i, j = np.nonzero(open_)
        i += at
        keep = (bands[i] == bands[j]).argmax(1) == band
        i, j = i[keep], j[keep]
        keep = corrected(packed[i], packed[j]) >= floor
        yield i[keep], j[keep]


def _near_rows(percent: int):
    """Rows of a cell that are near to a row of another component."""

    def run(batches):
        for cell in _cells(batches):
            pairs = _near_pairs(cell, percent)
            next(pairs)
            keep = np.zeros(cell.num_rows, bool)
            for i, j in pairs:
                keep[i] = keep[j] = True
            if keep.any():
                yield from cell.filter(pa.array(keep)).to_batches()

    return run


def _joining_links(percent: int):
    """Links of a cell, on full sets, that join two components not joined by an earlier one."""

    def run(batches):
        for cell in _cells(batches):
            rep = cell.column("rep").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in cell.column("keys").to_pylist()]
            u, v = [], []
            pairs = _near_pairs(cell, percent)
            part = next(pairs)
            for i, j in pairs:
                for a, b in zip(*(np.split(x, np.flatnonzero(np.diff(i)) + 1) for x in (i, j)), strict=True):
                    if not len(a):
                        continue
                    a = a[0]
                    b = b[part[b] != part[a]]
                    for c in b[_similar(sets[a], [sets[c] for c in b], percent)]:
                        if part[c] != part[a]:
                            part[part == part[c]] = part[a]
                            u.append(min(rep[a], rep[c]))
                            v.append(max(rep[a], rep[c]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _similar(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sorted sets share enough with the set ``one``."""
    if not others or not len(one):
        return np.zeros(len(others), bool)
    sizes = np.array([len(o) for o in others], np.int64)
    keys = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, keys), len(one) - 1)] == keys
    common = np.bincount(np.repeat(np.arange(len(others)), sizes)[hit], minlength=len(others))
    return 100 * common >= percent * (len(one) + sizes - common)


def _shared(rows: DataFrame) -> DataFrame:
    """Bucket rows whose bucket holds more than one class."""
    many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return rows.join(many, "bucket")
