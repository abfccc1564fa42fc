"""Graphs with cycles, shapes against brute force."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from evalloom.operators import geometry as G
from evalloom.operators import graph as N


def links(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def test_reachability_stops_on_cycles(spark):
    edges = links(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)])
    starts = spark.createDataFrame([(1,)], "node bigint")
    got = {r.node: r.hops for r in N.reachable_from(starts, edges).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


def test_one_terminal_or_a_reason(spark):
    edges = links(spark, [(1, 2), (3, 2), (3, 4), (5, 6), (6, 5)])
    starts = spark.createDataFrame([(1, 1), (3, 3), (5, 5)], "start bigint, node bigint")
    reached = N.reachable_from(starts, edges, ["start"])
    terminals = spark.createDataFrame([(2,), (4,)], "node bigint")
    got = {r.start: (r.verdict, r.terminal) for r in N.single_terminal(reached, terminals, ["start"]).collect()}
    assert got == {1: ("ok", 2), 3: ("many", None), 5: ("none", None)}


def test_chains(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    edges = links(spark, [*chain, (1, 2), (2, 3), (3, 2), (10, 11), (11, 12), (11, 13)])
    got = {r.src: (r.verdict, r.end, r.hops) for r in N.follow_chain(edges).collect()}
    assert got[100] == ("ok", 140, 40) and got[139] == ("ok", 140, 1)
    assert {got[1][0], got[2][0], got[3][0]} == {"cyclic"}
    assert got[11][0] == "ambiguous" and got[10][0] == "ambiguous"


def test_components(spark):
    edges = links(spark, [(1, 2), (2, 3), (7, 8), (5, 5)] + [(100 + i, 101 + i) for i in range(30)])
    nodes = spark.createDataFrame([(i,) for i in [1, 2, 3, 5, 7, 8, *range(100, 131)]], "node bigint")
    got = {r.node: r.component for r in N.connected_components(nodes, edges).collect()}
    assert [got[i] for i in (1, 2, 3, 5, 7, 8)] == [1, 1, 1, 5, 7, 7]
    assert {got[i] for i in range(100, 131)} == {100}


@pytest.mark.parametrize("small", [0, 32])
def test_smallest_gap(spark, small):
    rng = np.random.default_rng(5)
    rows = [(s, i, float(rng.random() * 20), float(rng.random() * 20), float(rng.random())) for s in range(4) for i in range(12)]
    rows.append((9, 0, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "scene int, i int, x double, y double, r double")
    got = {r.scene: r.gap for r in G.min_pairwise_gap(df, "scene", "i", small=small).collect()}
    for s in range(4):
        mine = [r for r in rows if r[0] == s]
        want = min(np.hypot(a[2] - b[2], a[3] - b[3]) - a[4] - b[4] for a, b in itertools.combinations(mine, 2))
        assert got[s] == pytest.approx(want)
    assert got[9] is None


def test_greedy_match_takes_turns(spark):
    truth = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0), (1, 2, 1.0, 0.0, 1.0)], "scene bigint, i int, x double, y double, r double")
    # the first shape takes the nearer fit although the second would want it more
    found = spark.createDataFrame([(1, 0.9, 0.0, 1.0), (1, 5.0, 0.0, 1.5)], "scene bigint, x double, y double, r double")
    row = G.greedy_match(truth, found, "scene").first()
    assert (row.matched, row.max_centre_error, row.max_radius_error) == (2, 4.0, 0.5)


def test_circle_fit_drops_an_outlier(spark):
    angles = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    rows = [(1, 10 + 5 * np.cos(a), 20 + 5 * np.sin(a)) for a in angles] + [(1, 10.0, 28.0)]
    df = spark.createDataFrame([(int(k), float(x), float(y)) for k, x, y in rows], "g int, x double, y double")
    fit = G.circle_fit(df, ["g"], "x", "y").first()
    assert fit.refit and fit.used == 40
    assert (fit.cx, fit.cy, fit.r) == (pytest.approx(10), pytest.approx(20), pytest.approx(5))
    assert fit.arc_deg == 5 * len({int(np.degrees(np.arctan2(y - fit.cy, x - fit.cx)) // 5) for _, x, y in rows[:40]})


@pytest.mark.parametrize("block", [1, 7, 40, 10_000])
def test_reachability_by_blocks_equals_brute_force(spark, block, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 80, (110, 2))} | {(i, i + 1) for i in range(100, 130)} | {(5, x) for x in range(20)}
    want, frontier, hop = {}, {0, 5, 100, 999}, 0
    while frontier:
        want |= dict.fromkeys(frontier, hop)
        frontier = {b for a, b in pairs if a in frontier} - set(want)
        hop += 1
    starts = spark.createDataFrame([(x,) for x in (0, 5, 100, 999)], "node bigint")
    got = N.reachable_from(starts, links(spark, sorted(pairs)), block_links=block).collect()
    assert len(got) == len(want) and {r.node: r.hops for r in got} == want


def test_a_long_way_takes_few_rounds(spark, monkeypatch):
    """Rounds follow the blocks that a way crosses, not its hops."""
    written = []
    cut = N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df, purpose="cut": written.append(purpose) or cut(df, purpose))
    chain = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    got = N.reachable_from(spark.range(1).selectExpr("id AS node"), chain, block_links=100).collect()
    assert {r.node: r.hops for r in got} == {i: i for i in range(301)}
    assert written.count("hops") <= 8


def test_chains_build_no_table_at_the_driver(spark, monkeypatch):
    plans = []
    cut = N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df, purpose="cut": plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, purpose))
    got = N.follow_chain(spark.range(40).selectExpr("id AS src", "id + 1 AS dst"))
    assert {r.hops for r in got.collect()} == set(range(1, 41))
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def _scene_rows(seed=3, n_scenes=60):
    rng = np.random.default_rng(seed)
    sizes = {s: tuple(int(x) for x in rng.integers(0, 8, 2)) for s in range(n_scenes)} | {50: (90, 70), 51: (40, 45)}
    place = lambda: [None if rng.random() < 0.03 else float(x) for x in rng.integers(0, 6, 3)]
    return [(s, side, i if side else 0, *place()) for s, both in sizes.items() for side, n in enumerate(both) for i in range(n)]


def _in_batches(rows, names, kinds, size):
    shape = pa.schema(list(zip(names, kinds)))
    return [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[at : at + size]], schema=shape) for at in range(0, len(rows), size)]


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_scenes_are_matched_together_as_one_by_one(size):
    """Scenes that go on over batches, few and many fits, missing places; rows of a scene in any order."""
    rows = _scene_rows()
    known = lambda r: tuple(math.nan if x is None else x for x in r[3:])
    order = lambda r: (r[2], *[(x is not None, x or 0) for x in r[3:]])
    want = {s: G._match_scene(*[[known(r) for r in sorted((r for r in rows if r[:2] == (s, side)), key=order)] for side in (0, 1)]) for s in {r[0] for r in rows}}
    mixed = sorted(rows, key=lambda r: (r[0], hash(r[1:])))
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 3]
    for small in (32, 3):
        out = G._match_batches(iter(_in_batches(mixed, ["scene", "side", "i", *"xyr"], kinds, size)), small)
        got = [tuple(row.values()) for batch in out for row in batch.to_pylist()]
        assert len(got) == len(want) and {g[0]: g[1:] for g in got} == want


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_gaps_of_small_scenes_in_batches(size):
    """Scenes above the bound are counted only, whatever batches they go on over."""
    rows = [(s, i // 2, *place) for s, _, i, *place in _scene_rows()]  # ids that repeat
    out = G._gap_batches(iter(_in_batches(rows, ["scene", "i", *"xyr"], [pa.int64(), pa.int64(), *[pa.float64()] * 3], size)), 32)
    got = {row["scene"]: (row["shapes"], row["gap"]) for batch in out for row in batch.to_pylist()}
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        gaps = [math.hypot(a[2] - b[2], a[3] - b[3]) - a[4] - b[4] for a, b in itertools.combinations(mine, 2) if a[1] != b[1] and None not in (*a, *b)]
        assert got[s][0] == len(mine)
        assert got[s][1] == (pytest.approx(min(gaps)) if gaps and len(mine) <= 32 else None)
