"""Similarity joins over fingerprints and token sets.

No join here is a cross product: pairs come from equi-joins on keys that every
qualifying pair must share, and rows with equal content are joined once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.functions.similarity import (
    FIELD_WEIGHTS,
    SET_WEIGHTS,
    fingerprint_similarity,
)
from evalloom.functions.text import jaccard_of_sets as jaccard
from evalloom.functions.text import padded_words, token_set, tokens, words
from evalloom.session import broadcast_if_small, cut_lineage, spread

CORE = list(FIELD_WEIGHTS)
SETS = list(SET_WEIGHTS)
_SLACK = 1e-9


def side(prefix: str):
    return lambda name: F.col(f"{prefix}_{name}")


def with_tokens(rows: DataFrame, text: str = "text") -> DataFrame:
    """Canonical sets: distinct members in one order, so equal sets compare equal."""
    return (
        rows.withColumn("tokens", F.array_sort(tokens(F.col(text))))
        .withColumn("entities", F.array_sort(F.array_distinct("entities")))
        .withColumn("primitives", F.array_sort(F.array_distinct("primitives")))
    )


def profiles(rows: DataFrame, ident: str = "id") -> DataFrame:
    """Rows with the same fingerprint and tokens as one profile named by its smallest id."""
    return rows.groupBy(*CORE, *SETS).agg(F.min(ident).alias("rep"), F.count(F.lit(1)).alias("n"))


def _by_merge(df: DataFrame) -> DataFrame:
    """Keep a side that grows with the input off the driver.

    Spark judges a side by the bytes of its files; lists and exploded keys are many
    times larger in memory, where the driver would build the table to broadcast.
    """
    return df.hint("merge")


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def _all_equal(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [side("l")(n).eqNullSafe(side("r")(n)) for n in names])


def _agreements(floor: float) -> list[tuple[float, tuple[str, ...]]]:
    """Every set of fields that can agree with a weight of at least ``floor``, the strongest first."""
    found = [(sum(FIELD_WEIGHTS[n] for n in c), c) for size in range(len(CORE) + 1) for c in combinations(CORE, size)]
    return sorted((x for x in found if x[0] >= floor), key=lambda x: (-x[0], x[1]))


def _field_key(number: int, fields: tuple[str, ...]) -> Column:
    """The values of ``fields`` as one string; missing values are left out, so they equal each other alone."""
    return F.concat(F.lit(f"{number}:"), F.to_json(F.struct(*fields)) if fields else F.lit(""))


def _must_share(need: float) -> tuple[tuple[str, ...], float]:
    """Sets of which one must overlap by the returned Jaccard value, if the set terms are to add up to ``need``."""
    for kinds in (("tokens",), ("entities", "tokens"), tuple(SETS)):
        own = sum(SET_WEIGHTS[k] for k in kinds)
        rest = sum(SET_WEIGHTS.values()) - own
        if need > rest:
            return kinds, (need - rest) / own
    return (), 0.0


def _prefix(size: Column, least: Column | float) -> Column:
    """How many members of a set must be looked at so that an overlap of ``least`` cannot be missed."""
    return F.greatest(F.lit(0), size - F.greatest(F.ceil(least * size - 1e-6), F.lit(1)) + 1).cast("int")


def _all_of(sets: dict[str, Column], entry: Callable[[str, Column, Column], Column]) -> Column:
    """One array with ``entry(set, member, place)`` of all members of all sets."""

    def of(kind: str) -> Column:
        return F.transform(F.coalesce(sets[kind], F.array().cast("array<string>")), lambda m, i: entry(kind, m, i))

    return F.flatten(F.array(*[of(kind) for kind in sets]))


def _members(rows: DataFrame, *kept: str) -> DataFrame:
    """One row for each member of each set."""
    entries = _all_of({s: F.col(s) for s in SETS}, lambda kind, m, _: F.struct(F.lit(kind).alias("kind"), m.alias("member")))
    return rows.select(*kept, F.inline(entries))


def _by_rarity(rows: DataFrame, counted: DataFrame, prefix: str = "rare_") -> DataFrame:
    """Each set also as ``rare_<set>``: its members by rising number of rows of ``counted`` that hold them.

    Frequencies are looked up once for each distinct combination of sets.
    """
    shape = F.sha2(F.to_json(F.struct(*SETS)), 256)
    shapes = rows.select(shape.alias("__shape"), *SETS).dropDuplicates(["__shape"])
    seen = _members(counted).groupBy("kind", "member").agg(F.count(F.lit(1)).alias("rows"))
    ranked = _members(shapes, "__shape").join(_by_merge(seen), ["kind", "member"], "left")
    lists = ranked.groupBy("__shape").agg(*[
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == s, F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "member")))), lambda x: x["member"]).alias(f"{prefix}{s}") for s in SETS
    ])
    out = rows.withColumn("__shape", shape).join(_by_merge(lists), "__shape", "left")
    return out.select(*rows.columns, *[F.coalesce(f"{prefix}{s}", F.array().cast("array<string>")).alias(f"{prefix}{s}") for s in SETS])


def _numbered(full: DataFrame) -> DataFrame:
    """Profiles (``rep``, ``n``) with fields and members as whole numbers, the same for equal values.

    Numbers rise with the profiles that hold a value, so a set in rising order has its rarest members first.
    They are looked up once for each distinct combination of fields and of sets.  Profiles
    without a set are left out: a score with them is missing.
    """
    rows = full.dropna(subset=SETS).select("rep", "n", *[_coded(c).alias(c) for c in (*CORE, *SETS)])

    def values(of: DataFrame, names: list[str], *kept: str) -> DataFrame:
        listed = lambda c: F.transform(c if c in SETS else F.array(c), lambda m: F.struct(F.lit(c).alias("kind"), m.alias("value")))
        return of.select(*kept, F.inline(F.flatten(F.array(*map(listed, names)))))

    seen = values(rows, [*CORE, *SETS]).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("rows"))
    seen = cut_lineage(seen.orderBy("rows", "kind", "value").select("kind", "value", F.monotonically_increasing_id().alias("number")), "numbers")

    def told(of: DataFrame, names: list[str], figures: list[Column]) -> DataFrame:
        combination = F.unhex(F.sha2(F.to_json(F.struct(*names)), 256))
        each = values(of.select(combination.alias("__of"), *names).dropDuplicates(["__of"]), names, "__of")
        each = each.join(_by_merge(seen), ["kind", "value"]).groupBy("__of").agg(*figures)
        return of.withColumn("__of", combination).drop(*names).join(_by_merge(each), "__of", "left").drop("__of")

    number = lambda c: F.when(F.col("kind") == c, F.col("number"))
    rows = told(rows, CORE, [F.max(number(c)).alias(f"at_{c}") for c in CORE])
    rows = told(rows, SETS, [F.sort_array(F.collect_list(number(c))).alias(f"in_{c}") for c in SETS])
    none = F.array().cast("array<bigint>")
    return rows.select("rep", "n", *[f"at_{c}" for c in CORE], *[F.coalesce(f"in_{c}", none).alias(f"in_{c}") for c in SETS])


def _mixed(h: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    """Keys with one more part; every bit of the parts reaches all bits."""
    h = (h ^ np.asarray(x).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, sizes and members of lists without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes, sizes, column.flatten().to_numpy(zero_copy_only=False)


def _each(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes: the run of each entry and its place there."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _looked_at(sizes: np.ndarray, least: float | np.ndarray) -> np.ndarray:
    """How many members of a set must be looked at so that an overlap of ``least`` cannot be missed."""
    return np.maximum(0, sizes - np.maximum(np.ceil(least * sizes - 1e-6), 1) + 1).astype(np.int64)


class _Options:
    """Every set of fields in which a pair that reaches the threshold can agree, and what its sets must then share."""

    def __init__(self, threshold: float):
        found = _agreements(threshold - sum(SET_WEIGHTS.values()) - _SLACK)
        needs = [threshold - weight - 1e-6 for weight, _ in found]
        shares = [_must_share(need) for need in needs]
        self.fields = [[i for i, c in enumerate(CORE) if c in fields] for _, fields in found]
        self.kinds = [[] if need <= 0 else [SETS.index(k) for k in kinds] for need, (kinds, _) in zip(needs, shares, strict=True)]
        self.least = np.array([least for _, least in shares])
        self.agree = np.array([sum(1 << i for i in on) for on in self.fields])


#: rows of one key that a task compares with each other; a key with more is dealt in cells
_CELL = 4096
#: marks of a row: set of fields, kind of set (3: none), whether the cell compares a part with itself, part
_PLAIN = 3


def _keyed(coded: DataFrame, options: _Options, hot: DataFrame | None, cell: int) -> DataFrame:
    """Each profile at every key under which it must be looked for, or the keys alone.

    A key names fields that agree and, unless these suffice, one of the first members of a set (prefix).
    ``hot`` (``key``, ``rows``) lists keys with more than ``cell`` rows: these are cut into parts, and a row goes to the cells of its part.
    """
    alone, figures = hot is None, None
    if not alone and (many := hot.toArrow()).num_rows:
        keys = many.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        figures = keys[order], -(-many.column("rows").to_numpy()[order] // cell)
    sent = coded.sparkSession.sparkContext.broadcast(figures)

    def run(batches):
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            fields = [column(f"at_{c}").to_numpy(zero_copy_only=False) for c in CORE]
            sets = [_lists(column(f"in_{c}")) for c in SETS]
            for number, on in enumerate(options.fields):
                agreed = np.full(batch.num_rows, number + 1, np.uint64)
                for i in on:
                    agreed = _mixed(agreed, fields[i])
                for kind in options.kinds[number] or [_PLAIN]:
                    if kind == _PLAIN:
                        row, place, key = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), agreed
                    else:
                        begins, sizes, members = sets[kind]
                        row, place = _each(_looked_at(sizes, options.least[number]))
                        key = _mixed(_mixed(agreed[row], kind), members[begins[row] + place])
                    if alone:
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])
                    elif len(row):
                        yield from dealt(batch, row, place, key, number * 4 + kind)

    def dealt(batch, row, place, key, option):
        part, other, parts = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.ones(len(row), np.int64)
        if sent.value is not None:
            keys, counts = sent.value
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            parts = np.where(keys[at] == key, counts[at], 1)
            own = column_hash(batch)[row] % parts.astype(np.uint64)
            copy, other = _each(parts)
            row, place, key, part, parts = row[copy], place[copy], key[copy], own[copy].astype(np.int64), parts[copy]
            key = np.where(parts > 1, _mixed(_mixed(key, np.minimum(part, other)), np.maximum(part, other)), key)
        mark = (option * 2 + (part == other)) << 32 | part
        table = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(mark), pa.array(place)], ["key", "mark", "place"])
        for at in range(0, len(row), 20_000):
            rows = batch.take(pa.array(row[at : at + 20_000]))
            yield pa.RecordBatch.from_arrays([*table.slice(at, 20_000).columns, *rows.columns], [*table.schema.names, *rows.schema.names])

    def column_hash(batch):
        own = np.full(batch.num_rows, 7, np.uint64)
        for c in CORE:
            own = _mixed(own, batch.column(batch.schema.get_field_index(f"at_{c}")).to_numpy(zero_copy_only=False))
        for c in SETS:
            begins, sizes, members = _lists(batch.column(batch.schema.get_field_index(f"in_{c}")))
            total = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(np.full(len(members), 9, np.uint64), members))])
            own = _mixed(own, total[begins + sizes] - total[begins])
        return own

    if alone:
        return coded.mapInArrow(run, "key bigint")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(run, f"key bigint, mark bigint, place bigint, {kept}")


class _Block:
    """Rows of whole keys, in the order of key and name, and the pairs within each key."""

    def __init__(self, rows: pa.RecordBatch, options: _Options):
        number = lambda name: rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        self.options, self.keys, mark, self.place = options, number("key"), number("mark"), number("place")
        self.part, self.itself = mark & 0xFFFFFFFF, (mark >> 32) & 1
        self.option = mark >> 33
        self.fields = [number(f"at_{c}") for c in CORE]
        self.sets = []
        for c in SETS:
            begins, sizes, members = _lists(rows.column(rows.schema.get_field_index(f"in_{c}")))
            known, codes = np.unique(members, return_inverse=True)
            row, place = _each(sizes)
            table, sorted_ = None, row * len(known) + codes
            if len(sizes) * len(known) <= 1 << 23:
                table = np.zeros(len(sizes) * len(known), np.int32)
                table[sorted_] = place + 1
            self.sets.append((begins, sizes, codes, len(known), table, sorted_))

    def _met(self, kind: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shared members of each pair, and the place of the first of them on both sides (-1 without)."""
        begins, sizes, codes, width, table, cells = self.sets[kind]
        pair, place = _each(sizes[left])
        cell = right[pair] * width + codes[begins[left][pair] + place]
        if table is not None:
            there = table[cell] - 1 if len(table) else np.zeros(0, np.int64)
        else:
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            there = np.where(cells[at] == cell, at - begins[right[pair]], -1)
        hit = there >= 0
        pair, place, there = pair[hit], place[hit], there[hit]
        first = np.ones(len(pair), bool)
        first[1:] = pair[1:] != pair[:-1]
        l_at, r_at = np.full(len(left), -1), np.full(len(left), -1)
        l_at[pair[first]], r_at[pair[first]] = place[first], there[first]
        return np.bincount(pair, minlength=len(left)), l_at, r_at

    def pairs(self, names: pa.Array, cells: int):
        """(left, right, score) of pairs that agree in the fields of their key and no other, each under its first key alone.

        ``score`` is the sum of ``fingerprint_similarity`` before rounding.
        """
        ends = np.concatenate([np.flatnonzero(np.diff(self.keys)) + 1, [len(self.keys)]])
        ends = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        after = ends - np.arange(len(ends)) - 1
        work = np.cumsum(after * (1 + sum(s[1] for s in self.sets)))
        at = 0
        while at < len(after):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + cells, "right")))
            left, place = _each(after[at:to])
            left += at
            yield self._scored(left, left + place + 1, names)
            at = to

    def _scored(self, left: np.ndarray, right: np.ndarray, names: pa.Array):
        o = self.options
        option = self.option[left]
        agree = sum((f[left] == f[right]).astype(np.int64) << i for i, f in enumerate(self.fields))
        on = (option == self.option[right]) & (agree == o.agree[option >> 2])
        on &= (self.itself[left] == 1) | (self.part[left] != self.part[right])
        left, right, option, agree = left[on], right[on], option[on], agree[on]
        met = [self._met(k, left, right) for k in range(len(SETS))]
        size = [s[1] for s in self.sets]
        on = np.ones(len(left), bool)
        for number, kinds in enumerate(o.kinds):
            for i, kind in enumerate(kinds):
                of = option == number * 4 + kind
                if of.any():
                    on &= ~of | (met[kind][1] == self.place[left]) & (met[kind][2] == self.place[right])
                    for before in kinds[:i]:  # not if an earlier kind has a key for the pair
                        _, l_at, r_at = met[before]
                        found = (l_at >= 0) & (l_at < _looked_at(size[before][left], o.least[number])) & (r_at < _looked_at(size[before][right], o.least[number]))
                        on &= ~(of & found)
        left, right, agree = left[on], right[on], agree[on]
        part = {}
        for kind, s in enumerate(SETS):
            shared = met[kind][0][on]
            either = size[kind][left] + size[kind][right] - shared
            part[s] = SET_WEIGHTS[s] * (shared / np.maximum(either, 1))
        equal = {c: np.where(agree >> i & 1, FIELD_WEIGHTS[c], 0.0) for i, c in enumerate(CORE)}
        score = np.zeros(len(left))
        for c in ("family", "arity", "relation", "margin_operator"):
            score += equal[c]
        return left, right, score + part["entities"] + part["primitives"] + equal["depth"] + part["tokens"]


def _compared(full: DataFrame, threshold: float, kind: str, out: Callable, cell: int, cells: int) -> DataFrame:
    """Rows that ``out(rows, pairs)`` makes of the pairs of each block of keys; see :func:`edge_candidates`."""
    spark = full.sparkSession
    options = _Options(threshold)
    coded = spread(cut_lineage(_numbered(full), "coded"), "rep")
    hot = _keyed(coded, options, None, cell).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > cell)
    # pairs, not bytes, are the work of a task, so small parts are not put together
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = _keyed(coded, options, hot, cell).repartition(parts, "key").sortWithinPartitions("key", "rep")

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = rows.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held = rows.slice(last)
            if last:
                yield from block(rows.slice(0, last))
        if held is not None and held.num_rows:
            yield from block(held)

    def block(rows):
        of = _Block(rows, options)
        yield from out(rows, of.pairs(rows.column(rows.schema.get_field_index("rep")), cells))

    return dealt.mapInArrow(run, kind)


def edge_candidates(full: DataFrame, threshold: float, floor: float | None = None, cell: int = _CELL, cells: int = 1 << 18) -> DataFrame:
    """Pairs of profiles (``l_rep`` < ``r_rep``, ``l_n``, ``r_n``) that can reach the threshold, each once, with their score before rounding.

    A pair is looked for at the exact set of fields in which it agrees.  What is still
    missing then says which sets must overlap and by how much; members are ordered by
    rising frequency, and a pair must share one of the first members of both sides
    (prefix).  Pairs that qualify by their fields alone need no shared member.  The rows of a key
    meet in one task, which compares them on whole numbers, ``cells`` of them at a time; a key
    of more than ``cell`` rows is dealt in cells of two parts.  Scores below ``floor`` stay there.
    """

    def out(rows, found):
        rep, n = (rows.column(rows.schema.get_field_index(c)) for c in ("rep", "n"))
        for left, right, score in found:
            if floor is not None:
                left, right, score = (x[score >= floor] for x in (left, right, score))
            if len(left):
                left, right = pa.array(left), pa.array(right)
                yield pa.RecordBatch.from_arrays([rep.take(left), rep.take(right), n.take(left), n.take(right), pa.array(score)], ["l_rep", "r_rep", "l_n", "r_n", "raw"])

    ident = full.schema["rep"].dataType.simpleString()
    return _compared(full, threshold, f"l_rep {ident}, r_rep {ident}, l_n bigint, r_n bigint, raw double", out, cell, cells)


def similarity_edges(rows: DataFrame, threshold: float, ident: str = "id") -> DataFrame:
    """All unordered pairs at or above the threshold, written without repeating copies.

    ``left_id`` and ``right_id`` name profiles by their smallest member and
    ``pairs`` says how many row pairs the edge stands for; a row with both ids
    equal stands for the pairs among the copies of one profile.  Nothing is lost:
    members of a profile share every score.
    """
    full = cut_lineage(profiles(with_tokens(_narrow(rows, ident)), ident), "profiles")
    met = edge_candidates(full, threshold, threshold - 1e-6)
    between = met.select(F.col("l_rep").alias("left_id"), F.col("r_rep").alias("right_id"), F.round("raw", 6).alias("score"), (F.col("l_n") * F.col("r_n")).alias("pairs"))
    itself = fingerprint_similarity(F.col, F.col)
    copies = full.filter("n > 1").select(F.col("rep").alias("left_id"), F.col("rep").alias("right_id"), itself.alias("score"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return between.unionByName(copies).filter(F.col("score") >= threshold)


def _narrow(rows: DataFrame, ident: str) -> DataFrame:
    """What a fingerprint needs, on all cores."""
    return spread(rows.select(ident, *CORE, "entities", "primitives", "text"), ident)


def clones(rows: DataFrame, ident: str = "id") -> DataFrame:
    """``clone``: whether another row has the same fingerprint and tokens."""
    spelled = with_tokens(_narrow(rows, ident))
    # read twice below, so the digests are written once
    named = cut_lineage(spelled.select(ident, _digest().alias("profile")), "profiles")
    held = named.groupBy("profile").agg((F.count(F.lit(1)) > 1).alias("clone"))
    return _by_merge(named.join(_by_merge(held), "profile").select(ident, "clone"))


def sibling_risk(rows: DataFrame, edges: DataFrame, ident: str = "id") -> DataFrame:
    """Rows that have a sibling at the threshold, by profile and without expanding pairs."""
    canonical = with_tokens(rows)
    full = profiles(canonical, ident)
    touched = (
        edges.select(F.explode(F.array("left_id", "right_id")).alias("rep"), "score")
        .groupBy("rep")
        .agg(F.max("score").alias("top_score"))
    )
    named = full.join(_by_merge(touched), "rep")
    match = reduce(lambda a, b: a & b, [canonical[c].eqNullSafe(named[c]) for c in [*CORE, *SETS]])
    return canonical.join(_by_merge(named), match).select(canonical[ident], named["top_score"])


def sibling_scores(rows: DataFrame, threshold: float, ident: str = "id", cell: int = _CELL, cells: int = 1 << 18) -> DataFrame:
    """As :func:`sibling_risk` over all edges at the threshold, which stay in the tasks that find them: only best scores leave."""
    full = cut_lineage(profiles(with_tokens(_narrow(rows, ident)), ident), "profiles")

    def out(block, found):
        best = np.full(block.num_rows, -1.0)
        for left, right, score in found:
            on = score >= threshold - 1e-6
            np.maximum.at(best, left[on], score[on])
            np.maximum.at(best, right[on], score[on])
        at = np.flatnonzero(best >= 0)
        yield pa.RecordBatch.from_arrays([block.column(block.schema.get_field_index("rep")).take(pa.array(at)), pa.array(best[at])], ["rep", "raw"])

    between = _compared(full, threshold, f"rep {full.schema['rep'].dataType.simpleString()}, raw double", out, cell, cells)
    best = between.groupBy("rep").agg(F.round(F.max("raw"), 6).alias("score"))
    copies = full.filter("n > 1").select("rep", fingerprint_similarity(F.col, F.col).alias("score"))
    top = best.unionByName(copies).filter(F.col("score") >= threshold).groupBy("rep").agg(F.max("score").alias("top_score"))
    held = full.select(_digest().alias("profile"), "rep").join(_by_merge(top), "rep").drop("rep")
    named = with_tokens(_narrow(rows, ident)).select(ident, _digest().alias("profile"))
    return named.join(_by_merge(held), "profile").select(ident, "top_score")


def _digest() -> Column:
    """Names a profile by its content."""
    return F.unhex(F.sha2(F.to_json(F.struct(*CORE, *SETS)), 256))


def _coded(name: str) -> Column:
    """A field, or the members of a set, as text that also tells a missing value from all others."""
    text = lambda x: F.coalesce(F.concat(F.lit("v"), x.cast("string")), F.lit("n"))
    return F.transform(name, text) if name in SETS else text(F.col(name))


def _memory_index(items: DataFrame, name: str) -> tuple[pa.Array, dict, dict]:
    """Names in the order of their text; codes of each field; vocabulary, begins, postings and sizes of each set (missing sets: -1)."""
    held = items.orderBy(F.col(name).cast("string")).toArrow().combine_chunks()
    fields, sets = {}, {}
    for c in CORE:
        coded = held.column(c).combine_chunks().dictionary_encode()
        fields[c] = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    for c in SETS:
        lists = held.column(c).combine_chunks()
        sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        many = np.maximum(sizes, 0)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        begins = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))]).astype(np.int64)
        sets[c] = coded.dictionary, begins, np.repeat(np.arange(len(sizes)), many)[np.argsort(codes, kind="stable")], sizes
    return held.column(name).combine_chunks(), fields, sets


def _overlap_table(lists: pa.ListArray, index: tuple, n_items: int) -> np.ndarray:
    """Jaccard value of each list and each memory row; nan where a set is missing."""
    vocabulary, begins, postings, right = index
    left = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.index_in(lists.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(left)), np.maximum(left, 0))[codes >= 0]
    codes = codes[codes >= 0]
    many = begins[codes + 1] - begins[codes]
    at = np.arange(many.sum()) + np.repeat(begins[codes] - np.cumsum(many) + many, many)
    shared = np.bincount(np.repeat(row, many) * n_items + postings[at], minlength=len(left) * n_items).reshape(len(left), n_items)
    value = shared / np.maximum(left[:, None] + right - shared, 1)
    value[left < 0], value[:, right < 0] = np.nan, np.nan
    return value


def _neighbors_in_tasks(asked: DataFrame, memory: DataFrame, k: int, ident: str, name: str, cells: int = 1 << 19) -> DataFrame:
    """The k best of a small memory per candidate, whose rows stay in their task.

    Every candidate is scored against every row, ``cells`` scores at a time, with the sum of
    ``fingerprint_similarity``.  Rows within rounding of the k-th score come back, of equal sums the
    first k; columns round them and rank them inside the row.
    """
    coded = lambda rows, key: rows.select(key, *[_coded(c).alias(c) for c in (*CORE, *SETS)])
    sent = asked.sparkSession.sparkContext.broadcast(_memory_index(coded(memory, name), name))

    def run(batches):
        names, fields, sets = sent.value
        n_items = len(names)
        top = min(k, n_items)
        step = max(1, cells // max(1, n_items))
        for whole in batches:
            for a in range(0, whole.num_rows if n_items else 0, step):
                batch = whole.slice(a, step)
                total = np.zeros((batch.num_rows, n_items))
                for c in ("family", "arity", "relation", "margin_operator", "entities", "primitives", "depth", "tokens"):
                    column = batch.column(c)
                    if c in sets:
                        total += SET_WEIGHTS[c] * _overlap_table(column, sets[c], n_items)
                    else:
                        own = pc.index_in(column, value_set=fields[c][0]).fill_null(-1).to_numpy(zero_copy_only=False)
                        total += np.where(own[:, None] == fields[c][1], FIELD_WEIGHTS[c], 0.0)
                placed = np.where(np.isnan(total), -1.0, total)
                bar = np.partition(placed, n_items - top, axis=1)[:, n_items - top] - 2e-6
                row, item = np.nonzero(placed >= bar[:, None])
                order = np.lexsort((item, -placed[row, item], row))
                row, item = row[order], item[order]
                value = placed[row, item]
                heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])]))
                place = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
                row, item = row[place < top], item[place < top]
                found = pa.StructArray.from_arrays([names.take(pa.array(item)), pa.array(total[row, item], from_pandas=True)], [name, "total"])
                begins = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(begins), found)], [ident, "found"])

    kinds = [df.schema[c].dataType.simpleString() for c, df in ((ident, asked), (name, memory))]
    met = coded(asked, ident).mapInArrow(run, f"`{ident}` {kinds[0]}, found array<struct<`{name}`:{kinds[1]},total:double>>")

    def placed(x: Column) -> Column:
        score = F.round(x["total"], 6)
        last = F.when(score.isNull(), F.lit(float("inf"))).otherwise(-score)
        return F.struct(last.alias("last"), x[name].cast("string").alias("text"), x[name].alias(name), score.alias("score"))

    best = met.select(ident, F.posexplode(F.slice(F.array_sort(F.transform("found", placed)), 1, k)).alias("at", "best"))
    return best.select(ident, (F.col("at") + 1).alias("rank"), F.col("best")[name].alias(name), F.col("best.score").alias("score"))


def semantic_neighbors(candidates: DataFrame, memory: DataFrame, k: int, *, ident: str = "id", name: str = "memory_id", small_rows: int = 2_000, small_members: int = 200_000) -> DataFrame:
    """The k most similar memory rows per candidate, ties by id as text.

    A memory of at most ``small_rows`` rows and ``small_members`` set members is counted and then
    goes to all tasks as an index, against which each candidate is read once and ranked where it
    lies; so the work grows with the candidates alone and nothing is shuffled.

    A larger one is joined by a threshold algorithm.  For each set of fields and their values, the first k ids of the
    memory are its heads: a row that is no head of the fields in which it agrees, and
    shares no set member, has k better rows before it.  The heads of a candidate give
    the first scores, and its k-th one from then on decides: fields whose weight with
    full overlap of all sets stays below it are not looked at, and of the others only
    rows that share one of the rare members that the missing score demands.
    Candidates with equal fingerprints are asked once.
    """
    memory = cut_lineage(memory, "memory")
    members = sum((F.coalesce(F.size(s), F.lit(0)) for s in SETS), F.lit(0))
    held = with_tokens(memory).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(members), F.lit(0)).alias("members")).first()
    if held["rows"] <= small_rows and held["members"] <= small_members:
        kept = list(dict.fromkeys([ident, *CORE, "entities", "primitives", "text"]))
        asked = with_tokens(spread(candidates.select(*kept), ident))
        return _neighbors_in_tasks(asked, with_tokens(memory), k, ident, name)
    fields = [*CORE, *SETS]
    most = sum(SET_WEIGHTS.values())
    patterns = _agreements(0.0)
    asked = with_tokens(candidates).select(ident, *fields).withColumn("profile", F.sha2(F.to_json(F.struct(*fields)), 256))
    asked = asked.withColumn("core", _field_key(0, tuple(CORE)))
    profs = cut_lineage(_by_rarity(asked.drop(ident).dropDuplicates(["profile"]), with_tokens(memory)), "asked")
    order = F.col(name).cast("string")
    copy = W.partitionBy(*fields).orderBy(order)
    known = cut_lineage(with_tokens(memory).select(name, *fields).withColumn("__copy", F.row_number().over(copy)).filter(F.col("__copy") <= k).drop("__copy"), "known")

    def spelled(rows: DataFrame, *kept: str) -> DataFrame:
        return rows.select(*kept, F.inline(F.array(*[F.struct(F.lit(w).alias("w"), _field_key(i, c).alias("key")) for i, (w, c) in enumerate(patterns)])))

    heads = spelled(known, name).withColumn("__at", F.row_number().over(W.partitionBy("key").orderBy(order))).filter(F.col("__at") <= k).select("key", name)
    cores = cut_lineage(spelled(profs.select("core", *CORE).dropDuplicates(["core"]), "core"), "cores")
    # the fields alone already bound the k-th score from below
    near = cores.join(heads, "key").groupBy("core", name).agg(F.max("w").alias("w"))
    at = F.row_number().over(W.partitionBy("core").orderBy(F.desc("w")))
    near = near.withColumn("__at", at).withColumn("floor", F.max(F.when(F.col("__at") == k, F.col("w"))).over(W.partitionBy("core")))
    near = near.filter(F.col("w") + most >= F.coalesce("floor", F.lit(0.0)) - _SLACK).select("core", name)

    left, right = _renamed(profs.select("profile", "core", *fields), "l").withColumnsRenamed({"l_profile": "profile", "l_core": "core"}), _renamed(known, "r").withColumnRenamed(f"r_{name}", name)
    score = fingerprint_similarity(side("l"), side("r")).alias("score")
    first = left.join(near, "core").join(right, name).select("profile", name, score)
    best = cut_lineage(_top_k(first, "profile", name, k), "best")

    # what can still beat the k-th score
    bar = best.filter(F.col("rank") == k).select("profile", F.col("score").alias("bar"))
    open_ = profs.select("profile", "core", *[f"rare_{s}" for s in SETS]).join(bar, "profile", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
    open_ = open_.join(cores, "core").withColumn("need", F.col("bar") - F.col("w") - 1e-6).filter(F.col("need") <= most)
    firsts = {}
    for kind in SETS:
        least = F.lit(0.0)
        for floor in (0.0, SET_WEIGHTS["primitives"], SET_WEIGHTS["primitives"] + SET_WEIGHTS["entities"]):
            kinds, _ = _must_share(floor + 1e-9)
            own = sum(SET_WEIGHTS[x] for x in kinds)
            value = (F.col("need") - (most - own)) / own if kind in kinds else F.lit(2.0)  # 2: this set need not be looked at
            least = F.when(F.col("need") > floor, value).otherwise(least)
        firsts[kind] = F.slice(f"rare_{kind}", F.lit(1), F.when(least <= 1, _prefix(F.size(f"rare_{kind}"), least)).otherwise(0).cast("int"))
    member_key = lambda kind, m, _: F.concat(F.col("key"), F.lit(f"|{kind}|"), m)
    probes = open_.select("profile", F.explode(_all_of(firsts, member_key)).alias("key"))
    postings = spelled(known, name, *SETS).select(name, F.explode(_all_of({s: F.col(s) for s in SETS}, member_key)).alias("key"))
    pairs = probes.join(postings, "key").select("profile", name).distinct().join(best, ["profile", name], "left_anti")
    more = pairs.join(left, "profile").join(right, name).select("profile", name, score)
    top = _top_k(best.drop("rank").unionByName(more), "profile", name, k)
    return asked.select(ident, "profile").join(top, "profile").select(ident, "rank", name, "score")


def _top_k(scored: DataFrame, ident: str, name: str, k: int) -> DataFrame:
    """Rank per candidate; the filter on the rank lets Spark trim each partition before the shuffle."""
    order = W.partitionBy(ident).orderBy(F.col("score").desc(), F.col(name).cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _pad_zero(candidates: DataFrame, scored: DataFrame, memory: DataFrame, ident: str, name: str, k: int) -> DataFrame:
    """Add score 0 for the first ids of the memory where they were not scored.

    At most k rows of the memory can be needed as padding, so k ids are enough.
    """
    first = [r[0] for r in memory.select(name).orderBy(F.col(name).cast("string")).limit(k).collect()]
    filler = candidates.select(ident, F.explode(F.array(*[F.lit(x) for x in first])).alias(name)).withColumn(
        "score", F.lit(0.0)
    )
    kept = filler.join(scored.select(ident, name), [ident, name], "left_anti")
    return scored.unionByName(kept.select(*scored.columns))


def _overlap_index(items: DataFrame, name: str) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Names in the order of their text, tokens, where the postings of each token begin, the postings, and set sizes."""
    held = items.orderBy(F.col(name).cast("string")).select(name, F.coalesce("rt", F.array().cast("array<string>")).alias("rt")).toArrow().combine_chunks()
    lists = held.column("rt").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
    postings = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(codes, kind="stable")]
    return held.column(name).combine_chunks(), coded.dictionary, begins, postings, sizes


def _overlaps_in_tasks(docs: DataFrame, items: DataFrame, k: int, ident: str, name: str, cells: int = 1 << 18) -> DataFrame:
    """(ident, name, shared, either) of all rows of a small memory that can be among the k best of a candidate.

    Every candidate is counted against every row through the postings, ``cells`` counts
    at a time.  Rows within rounding of the k-th overlap are all returned, of equal
    overlaps the first k; where it is zero, the first k rows of the memory come too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_overlap_index(items, name))

    def run(batches):
        names, vocabulary, begins, postings, right = sent.value
        n_items = len(right)
        top = min(k, n_items)
        for batch in batches:
            if not batch.num_rows or not n_items:
                continue
            left = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = pc.index_in(batch.column(1).flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), left)[codes >= 0]
            codes = codes[codes >= 0]
            many = begins[codes + 1] - begins[codes]
            work = np.cumsum(np.bincount(row, many, batch.num_rows) + n_items)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + cells, "right")))
                mine = slice(*np.searchsorted(row, [a, b]))
                n = many[mine]
                at = np.arange(n.sum()) + np.repeat(begins[codes[mine]] - np.cumsum(n) + n, n)
                shared = np.bincount(np.repeat(row[mine] - a, n) * n_items + postings[at], minlength=(b - a) * n_items).reshape(b - a, n_items)
                either = left[a:b, None] + right - shared
                overlap = shared / np.maximum(either, 1)
                bar = np.partition(overlap, n_items - top, axis=1)[:, n_items - top] - 2e-6
                kept = (shared > 0) & (overlap >= bar[:, None])
                kept[:, :top] |= (bar <= 0)[:, None]
                doc, item = np.nonzero(kept)
                order = np.lexsort((item, -overlap[doc, item], doc))
                doc, item = doc[order], item[order]
                value = overlap[doc, item]
                heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]))
                place = np.arange(len(doc)) - np.repeat(heads, np.diff(np.append(heads, len(doc))))
                doc, item = doc[place < top], item[place < top]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + a)), names.take(pa.array(item)), pa.array(shared[doc, item]), pa.array(either[doc, item])],
                    [ident, name, "shared", "either"],
                )
                a = b

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c, df in ((ident, docs), (name, items))]
    return docs.select(ident, "lt").mapInArrow(run, ", ".join([*kinds, "shared bigint", "either bigint"]))


def negative_neighbors(
    candidates: DataFrame, memory: DataFrame, k: int, *, ident: str, name: str, text: str = "text", seed_tokens: int = 512,
    small_rows: int = 20_000, small_tokens: int = 2_000_000,
) -> DataFrame:
    """Top-k by token overlap through postings; zero overlaps fill up in id order.

    A memory of at most ``small_rows`` rows and ``small_tokens`` tokens is counted and
    then goes to all tasks as an index, against which each candidate is read once; so the
    work grows with the candidates alone.

    A larger one is joined, its postings in rising document frequency.  A few memory rows of common tokens (``4 * k``, whatever the size of the memory, of at
    most ``seed_tokens`` tokens) are scored first, and the k-th score is the bar of a
    candidate.  The bar and both sizes say how many tokens a better pair shares; leaving
    out that many but one of the commonest tokens of a memory row, it must be met by one
    of the others, so common tokens are read for candidates that have no bar yet, and
    only there.  What passes the bound by its count is compared in full.
    """
    docs = candidates.select(ident, tokens(F.col(text)).alias("lt"))
    items = cut_lineage(memory.select(name, tokens(F.col(text)).alias("rt")), "known")
    held = items.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("rt")), F.lit(0)).alias("tokens")).first()
    if held["rows"] <= small_rows and held["tokens"] <= small_tokens:
        score = F.round(F.when(F.col("either") == 0, F.lit(0.0)).otherwise(F.col("shared") / F.col("either")), 6)
        met = _overlaps_in_tasks(docs, items, k, ident, name).select(ident, name, score.alias("score"))
        return _top_k(met, ident, name, k).select(ident, "rank", name, "score")
    docs = cut_lineage(docs, "asked")
    spots = items.select(name, F.size("rt").alias("rs"), F.explode("rt").alias("token"))
    seen = spots.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(W.partitionBy(name).orderBy("rows", "token"))
    postings = cut_lineage(spots.join(seen, "token").withColumn("pos", place), "postings")
    common = postings.filter(F.col("rs") <= seed_tokens).groupBy(name).agg(F.avg("rows").alias("common")).orderBy(F.desc("common"), F.col(name).cast("string")).limit(4 * k)
    seeds = items.join(common, name).select(name, "rt").collect()
    kind = items.schema[name].dataType

    def overlap(left: Column, right: Column) -> Column:
        return F.round(jaccard(left, right), 6)

    listed = F.array(*[F.struct(F.lit(r[name]).cast(kind).alias(name), F.array(*[F.lit(t) for t in r["rt"]]).alias("rt")) for r in seeds])
    tried = F.transform(listed, lambda s: F.struct(s[name].alias(name), overlap(F.col("lt"), s["rt"]).alias("score"))) if seeds else F.array().cast(f"array<struct<{name}:{kind.simpleString()},score:double>>")
    asked = docs.withColumn("tried", tried).withColumn("bar", F.coalesce(F.get(F.sort_array(F.transform("tried", lambda s: s["score"]), asc=False), F.lit(k - 1)), F.lit(0.0)))
    asked = cut_lineage(asked, "tried")
    first = asked.select(ident, F.inline("tried"))

    # scores are rounded to six places, so a pair counts as reaching the bar from half a unit below it
    low = F.greatest(F.col("bar") - 1e-6, F.lit(0.0))
    share = low / (1 + low)
    must = F.greatest(F.lit(1), F.ceil(share * (F.col("ls") + F.col("rs")) - 1e-6))
    hits = (
        # the outer form: a plain explode would make Spark read the list a second time to test for none
        asked.select(ident, "bar", F.size("lt").alias("ls"), F.explode_outer("lt").alias("token"))
        .join(postings, "token")
        .filter(F.col("pos") <= F.col("rs") - must + 1)
        .groupBy(ident, name, "bar", "ls", "rs")
        .agg(F.count(F.lit(1)).alias("met"))
    )
    at_best = F.least(F.col("met") + must - 1, "ls", "rs")
    pairs = hits.filter(at_best / (F.col("ls") + F.col("rs") - at_best) >= low - 1e-6).select(ident, name)
    pairs = pairs.filter(~F.col(name).isin([r[name] for r in seeds])) if seeds else pairs
    more = pairs.join(docs, ident).join(items, name).select(ident, name, overlap(F.col("lt"), F.col("rt")).alias("score"))
    scored = first.unionByName(more).filter("score > 0")
    padded = _pad_zero(docs.select(ident), scored, memory, ident, name, k)
    return _top_k(padded, ident, name, k).select(ident, "rank", name, "score")


def _complete_sources(batches, sent, ident: str):
    """Per text the sources of which every group has a phrase in it; texts without any are left out."""
    held, groups, opened = sent.value
    for batch in batches:
        kept, begins, found = [], [0], []
        for row, text in enumerate(batch.column(1)):
            padded = text.as_py() or ""
            seen = set(padded.split())
            # a source is only looked at where a phrase of its first group can open
            tried = {at for word in seen & opened.keys() for at in opened[word]}
            whole = [at for at in sorted(tried) if all(any(p in seen if one else p in padded for p, one in group) for group in groups[at])]
            if whole:
                kept.append(row)
                found += whole
                begins.append(len(found))
        if kept:
            rows = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), held.take(pa.array(found)))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(kept)) for c in batch.columns], rows], [ident, "padded", "found"])


def _match_in_tasks(rows: DataFrame, sources: DataFrame, ident: str, name: str) -> DataFrame:
    """(ident, padded, found) of a small table of sources: each text is read once, its sources are found and kept in its row."""
    table = sources.select(name, "floor", F.col("tokens").alias("r_tokens"), "groups")
    needles = F.transform("groups", lambda g: F.filter(F.transform(g, padded_words), lambda p: F.length(p) > 2))
    listed = table.withColumn("groups", needles).toArrow().combine_chunks()
    groups, opened = [], {}
    for at, source in enumerate(listed.column("groups").to_pylist()):
        spelled = [[(p.strip(), True) if len(p.split()) == 1 else (p, False) for p in group or []] for group in source or []]
        groups.append(sorted(spelled, key=lambda group: not all(one for _, one in group)))  # single words are quick to test
        if spelled and all(spelled):
            for phrase, _ in groups[at][0]:
                opened.setdefault(phrase.split()[0], set()).add(at)
    held = pa.concat_arrays(listed.drop_columns(["groups"]).to_struct_array().chunks) if len(listed) else None
    sent = rows.sparkSession.sparkContext.broadcast((held, groups, opened))
    kind = table.drop("groups").schema.simpleString()
    asked = rows.schema[ident].dataType.simpleString()
    return rows.select(ident, "padded").mapInArrow(lambda batches: _complete_sources(batches, sent, ident), f"`{ident}` {asked}, padded string, found array<{kind}>")


def protected_source_match(candidates: DataFrame, sources: DataFrame, *, ident: str, name: str, text: str = "text", max_first_words: int = 2000, max_phrases: int = 20_000) -> DataFrame:
    """Sources of which every concept group has a whole-word phrase in the text, above the source's floor.

    Phrases meet texts through their first word.  The sources are a curated table:
    while their first words and phrases are few (counted first) they go to the tasks, each
    text is read once and its pairs are found and scored in its row, so neither texts nor
    hits are shuffled.  Of more sources the phrases are joined by first word.
    ``sources`` holds ``name, groups, floor, tokens``; each of its rows is a source.
    """
    phrases = (
        sources.select(name, "floor", F.size("groups").alias("n_groups"), F.posexplode("groups").alias("group", "phrases"))
        .select(name, "floor", "n_groups", "group", F.explode("phrases").alias("phrase"))
        .withColumn("needle", padded_words(F.col("phrase")))
        .withColumn("first", F.element_at(words(F.col("phrase")), 1))
        .filter(F.length("needle") > 2)
    )
    rows = candidates.select(ident, words(F.col(text)).alias("ws"))
    rows = rows.withColumn("padded", F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" ")))
    opening = [r[0] for r in phrases.select("first").distinct().limit(max_first_words + 1).collect()]
    # only pairs with every group are scored; no fingerprint on either side, so the
    # five fields are equal because both are missing
    base = sum(FIELD_WEIGHTS.values())

    def score(own: Column) -> Column:
        return F.round(F.lit(base) + SET_WEIGHTS["tokens"] * jaccard(own, F.col("r_tokens")), 6).alias("score")

    if len(opening) <= max_first_words and phrases.limit(max_phrases + 1).count() <= max_phrases:
        met = _match_in_tasks(rows, sources, ident, name)
        pairs = met.select(ident, token_set(F.split(F.trim("padded"), " ")).alias("own"), F.inline("found"))
        return pairs.select(ident, name, score(F.col("own")), "floor").filter(F.col("score") >= F.col("floor"))
    opens = F.array_distinct("ws")
    # the needles of one opening word are tried in place, so a text is never copied per phrase
    grouped = phrases.groupBy("first").agg(
        F.collect_list(F.struct(name, "floor", "n_groups", "group", "needle")).alias("ps")
    )
    opened = rows.select(ident, "padded", F.explode_outer(opens).alias("first"))
    found = F.filter("ps", lambda p: F.contains(F.col("padded"), p["needle"]))
    hits = opened.join(broadcast_if_small(grouped), "first").select(ident, F.inline(found))
    complete = (
        hits.select(ident, name, "floor", "n_groups", "group")
        .distinct()
        .groupBy(ident, name, "floor", "n_groups")
        .agg(F.count(F.lit(1)).alias("hit_groups"))
        .filter(F.col("hit_groups") == F.col("n_groups"))
    )
    known = broadcast_if_small(sources.select(name, F.col("tokens").alias("r_tokens")))
    pairs = complete.join(candidates.select(ident, text), ident).join(known, name)
    scored = pairs.select(ident, name, score(tokens(F.col(text))), "floor")
    return scored.filter(F.col("score") >= F.col("floor"))


def cell_collisions(candidates: DataFrame, registry: DataFrame, cell: list[str], ident: str, name: str) -> DataFrame:
    """Registry names that share the three-part cell of a candidate, one row each."""
    return candidates.select(ident, *cell).join(registry.select(name, *cell), cell).select(ident, name)
