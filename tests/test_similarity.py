"""Similarity joins against brute force, with copies, missing fields and zero overlap."""

import itertools
import re

import numpy as np
import pytest

from evalloom.functions.similarity import FIELD_WEIGHTS, SET_WEIGHTS, blocking_keys
from evalloom.functions.text import STOP_WORDS, SYNONYMS
from evalloom.operators import similarity as S

SCHEMA = "id bigint, family string, arity string, relation string, margin_operator string, depth int, entities array<string>, primitives array<string>, text string"
WORDS = ["ring", "circle", "disk", "the", "left", "bar", "axis"]


def rows(n=60, seed=1):
    rng = np.random.default_rng(seed)
    pick = lambda xs: None if rng.random() < 0.05 else str(rng.choice(xs))
    some = lambda xs: [str(x) for x in rng.choice(xs, size=rng.integers(0, 3), replace=False)]
    out = [
        (i, pick(["f1", "f2"]), pick(["a1", "a2"]), pick(["r1", "r2", "r3"]), pick(["m1", "m2"]), int(rng.integers(1, 4)),
         some(["e1", "e2", "e3"]), some(["p1", "p2"]), " ".join(rng.choice(WORDS, size=rng.integers(0, 4))))
        for i in range(n)
    ]
    # copies of one row
    return out + [(n + j, *out[0][1:]) for j in range(3)]


def tokens(text):
    return {SYNONYMS.get(w, w) for w in text.lower().split() if w not in STOP_WORDS}


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def score(a, b):
    names = ["id", "family", "arity", "relation", "margin_operator", "depth", "entities", "primitives", "text"]
    a, b = dict(zip(names, a)), dict(zip(names, b))
    total = sum(w for f, w in FIELD_WEIGHTS.items() if a[f] == b[f])
    total += sum(SET_WEIGHTS[s] * jac(set(a[s]), set(b[s])) for s in ("entities", "primitives"))
    return round(total + SET_WEIGHTS["tokens"] * jac(tokens(a["text"]), tokens(b["text"])), 6)


@pytest.mark.parametrize("threshold", [0.68, 0.53])
def test_edges_stand_for_all_pairs(spark, threshold):
    data = rows()
    want = sum(score(a, b) >= threshold for a, b in itertools.combinations(data, 2))
    edges = S.similarity_edges(spark.createDataFrame(data, SCHEMA), threshold).collect()
    by_id = {r[0]: r for r in data}
    assert sum(e.pairs for e in edges) == want
    for e in edges:
        if e.left_id != e.right_id:
            assert e.score == pytest.approx(score(by_id[e.left_id], by_id[e.right_id]), abs=1e-6)


def test_blocking_keys_lose_nothing():
    for threshold in (0.68, 0.53):
        keys = blocking_keys(threshold)
        for size in range(6):
            for agreeing in itertools.combinations(FIELD_WEIGHTS, size):
                best = sum(FIELD_WEIGHTS[f] for f in agreeing) + sum(SET_WEIGHTS.values())
                if best >= threshold - 1e-9:
                    assert any(set(k) <= set(agreeing) for k in keys)


@pytest.mark.parametrize("size", [2, 20, 150])
def test_neighbors_of_any_memory(spark, size):
    data, memory = rows(25, 2), rows(size, 3)
    mem = spark.createDataFrame(memory, SCHEMA).withColumnRenamed("id", "memory_id")
    got = S.semantic_neighbors(spark.createDataFrame(data, SCHEMA), mem, 4)
    found = {(r.id, r["rank"]): (r.memory_id, r.score) for r in got.collect()}
    for a in data:
        best = sorted(((-score(a, b), str(b[0]), b[0]) for b in memory))[:4]
        for rank, (s, _, mid) in enumerate(best, 1):
            assert found[(a[0], rank)] == (mid, pytest.approx(-s, abs=1e-6))


def test_negative_neighbors_fill_up_with_zero(spark):
    docs = spark.createDataFrame([(1, "ring bar"), (2, "nothing"), (3, "")], "doc bigint, text string")
    memory = spark.createDataFrame([(10, "ring"), (9, "bar ring axis"), (2, "other"), (11, "")], "mem bigint, text string")
    got = S.negative_neighbors(docs, memory, 3, ident="doc", name="mem").collect()
    out = {d: [(r.mem, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.doc == d] for d in (1, 2, 3)}
    assert out[1] == [(9, round(2 / 3, 6)), (10, 0.5), (11, 0.0)]
    assert out[2] == [(10, 0.0), (11, 0.0), (2, 0.0)] and out[3] == out[2]


@pytest.mark.parametrize("limit", [2000, 0])
def test_protected_sources_need_every_group(spark, limit):
    docs = spark.createDataFrame([(1, "Red-ring left of bar"), (2, "red ring only"), (3, "redring bar left")], "doc bigint, text string")
    sources = spark.createDataFrame(
        [(7, [["red ring", "blue"], ["bar"], ["left"]], 0.0, ["bar"]), (8, [["bar"], ["left"]], 0.9, ["zzz"])],
        "src bigint, groups array<array<string>>, floor double, tokens array<string>",
    )
    got = S.protected_source_match(docs, sources, ident="doc", name="src", max_first_words=limit).collect()
    assert {(r.doc, r.src) for r in got} == {(1, 7)}


def test_negative_neighbors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    weights = 1 / np.arange(1, 401) ** 1.1
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    docs = [(i, draw(int(rng.integers(0, 60)))) for i in range(40)]
    known = [(i, draw(int(rng.integers(0, 14)))) for i in range(90)] + [(200, docs[3][1]), (201, docs[3][1]), (202, docs[4][1] + " w7")]
    frames = spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(known, "mem bigint, text string")
    for k, seed in ((3, 512), (1, 512), (4, 0)):
        got = {(r.doc, r["rank"]): (r.mem, r.score) for r in S.negative_neighbors(*frames, k, ident="doc", name="mem", seed_tokens=seed).collect()}
        for d, t in docs:
            best = sorted((-round(jac(set(t.split()), set(m.split())), 6), str(i), i) for i, m in known)[:k]
            assert [got[(d, n)] for n in range(1, k + 1)] == [(i, -s) for s, _, i in best]


def test_edges_compare_few_pairs(spark):
    """Many profiles with the same fields but unlike sets: candidates grow with the rows, not with their square."""
    counts = []
    for n in (200, 400):
        data = [(i, "f", "a", "r", "m", i % 4, [f"e{i}", f"e{i + 1}"], [f"p{i}"], f"word{i} word{i + 1} word{i + 2}") for i in range(n)]
        data = [(i, "f", f"a{i}", "r", "m", i % 4, *row[6:]) for i, row in enumerate(data)]
        full = S.profiles(S.with_tokens(spark.createDataFrame(data, SCHEMA)))
        counts.append(S.edge_candidates(full, 0.68).select("l_rep", "r_rep").distinct().count())
    assert counts[1] < 2.5 * counts[0] + 10


def test_neighbors_need_no_nested_loop(spark, capsys):
    mem = spark.createDataFrame(rows(20, 3), SCHEMA).withColumnRenamed("id", "memory_id")
    S.semantic_neighbors(spark.createDataFrame(rows(10, 2), SCHEMA), mem, 3).explain()
    assert "NestedLoop" not in (plan := capsys.readouterr().out) and "Cartesian" not in plan


def test_edges_build_no_table_at_the_driver(spark, tmp_path):
    """Exploded keys and profiles look small as files; the driver must not gather them for a broadcast."""
    data = spark.createDataFrame(rows(), SCHEMA)
    data.write.parquet(str(tmp_path / "rows"))
    data = spark.read.parquet(str(tmp_path / "rows"))
    edges = S.similarity_edges(data, 0.68)
    for frame in (edges, S.sibling_risk(data, edges)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        assert len(plan) < 40_000


def test_a_small_memory_is_not_joined(spark):
    """Work grows with the candidates alone: no join, and the same rows as the joined form, with many ties and missing texts."""
    rng = np.random.default_rng(6)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 30, n))
    docs = spark.createDataFrame([(i, draw(int(rng.integers(0, 9)))) for i in range(30)] + [(30, None)], "doc bigint, text string")
    known = [(i, draw(int(rng.integers(0, 5)))) for i in range(60)]
    memory = spark.createDataFrame(known + [(100 + i, known[7][1]) for i in range(9)] + [(120, "")], "mem bigint, text string")
    ask = lambda k, **more: S.negative_neighbors(docs, memory, k, ident="doc", name="mem", **more)
    for k in (1, 4, 100):
        small = ask(k)
        assert "Join" not in small._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, ask(k, small_rows=0).collect()))
    index = S._overlaps_in_tasks(docs.select("doc", S.tokens(S.F.col("text")).alias("lt")), memory.select("mem", S.tokens(S.F.col("text")).alias("rt")), 4, "doc", "mem", cells=100)
    score = S.F.round(S.F.when(S.F.col("either") == 0, S.F.lit(0.0)).otherwise(S.F.col("shared") / S.F.col("either")), 6)
    top = S._top_k(index.select("doc", "mem", score.alias("score")), "doc", "mem", 4)
    assert sorted(map(tuple, top.select("doc", "rank", "mem", "score").collect())) == sorted(map(tuple, ask(4).collect()))


def test_a_large_memory_is_joined_and_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 40, n))
    docs, known = ([(i, draw(int(rng.integers(0, top)))) for i in range(n)] for top, n in ((20, 25), (8, 50)))
    frames = spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(known, "mem bigint, text string")
    got = {(r.doc, r["rank"]): (r.mem, r.score) for r in S.negative_neighbors(*frames, 3, ident="doc", name="mem", small_tokens=0).collect()}
    for d, t in docs:
        best = sorted((-round(jac(set(t.split()), set(m.split())), 6), str(i), i) for i, m in known)[:3]
        assert [got[(d, n)] for n in range(1, 4)] == [(i, -s) for s, _, i in best]


def test_neighbors_of_a_small_memory_stay_in_their_task(spark):
    """No join and no shuffle of candidates; the same rows as the joined form and as brute force, whatever the block of scores."""
    data, known = rows(30, 2), rows(40, 3)
    asked = spark.createDataFrame(data, SCHEMA)
    memory = spark.createDataFrame(known, SCHEMA).withColumnRenamed("id", "memory_id")
    for k in (1, 4, 60):
        small = S.semantic_neighbors(asked, memory, k)
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
        if k < 60:
            joined = S.semantic_neighbors(asked, memory, k, small_rows=0)
            assert small.schema == joined.schema
            assert sorted(map(tuple, small.collect())) == sorted(map(tuple, joined.collect()))
        else:
            assert small.count() == len(data) * len(known)
    blocks = S._neighbors_in_tasks(S.with_tokens(asked), S.with_tokens(memory), 4, "id", "memory_id", cells=100)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, S.semantic_neighbors(asked, memory, 4).collect()))


def test_neighbors_with_missing_sets_come_last(spark):
    asked = spark.createDataFrame([(1, "f", "a", "r", "m", 1, ["e"], [None], "ring"), (2, "f", "a", "r", "m", 1, None, ["p"], "ring")], SCHEMA)
    known = [(10, "g", "a", "r", "m", 1, ["e"], [None], "ring"), (11, "f", "a", "r", "m", 1, None, ["p"], "ring"), (9, None, "b", "s", "n", 2, [], [], None)]
    memory = spark.createDataFrame(known, SCHEMA).withColumnRenamed("id", "memory_id")
    got = [tuple(r) for r in S.semantic_neighbors(asked, memory, 3).collect()]
    assert got == [(1, 1, 10, 0.85), (1, 2, 11, None), (1, 3, 9, None), (2, 1, 10, None), (2, 2, 11, None), (2, 3, 9, None)]
    none = memory.filter("memory_id < 0")
    assert S.semantic_neighbors(asked, none, 3).count() == 0


def test_clones_build_no_table_at_the_driver(spark):
    """The marks of all rows meet another table by merge: a digest for each row must not be gathered."""
    data = spark.createDataFrame(rows(), SCHEMA)
    marked = data.select("id").join(S.clones(data), "id")
    assert "Broadcast" not in marked._jdf.queryExecution().executedPlan().toString()
    seen = {}
    for r in rows():
        seen.setdefault(repr((r[1:6], sorted(r[6]), sorted(r[7]), sorted(tokens(r[8])))), []).append(r[0])
    want = {i: len(ids) > 1 for ids in seen.values() for i in ids}
    assert {r.id: r.clone for r in marked.collect()} == want and set(want.values()) == {True, False}


def test_sources_are_found_in_the_row_of_a_text(spark):
    """Neither texts nor hits are dealt out; the same rows as the joined form and as a plain search."""
    rng = np.random.default_rng(8)
    vocabulary = ["red", "ring", "bar", "left", "ringed", "the", "axis", "x1"]
    draw = lambda n: " ".join(rng.choice(vocabulary, n))
    docs = [(i, draw(int(rng.integers(0, 14))).replace(" ", rng.choice([" ", "-", ". "]))) for i in range(60)] + [(90, None), (91, "")]
    group = lambda: [draw(int(rng.integers(1, 3))) for _ in range(int(rng.integers(1, 3)))]
    known = [(i, [group() for _ in range(int(rng.integers(1, 4)))], 0.76, sorted(set(draw(3).split()) - {"the"})) for i in range(25)]
    known += [(50, [], 0.0, ["bar"]), (51, [["bar"], ["..", ""]], 0.0, ["bar"]), (52, None, 0.0, ["bar"]), (53, [["bar"], None], 0.0, ["bar"]), (54, [[None, "bar"]], 0.0, [])]
    shape = "src bigint, groups array<array<string>>, floor double, tokens array<string>"
    frames = spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(known, shape)
    found = S.protected_source_match(*frames, ident="doc", name="src")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, S.protected_source_match(*frames, ident="doc", name="src", max_first_words=0).collect()))
    assert got == sorted(map(tuple, S.protected_source_match(*frames, ident="doc", name="src", max_phrases=0).collect()))
    pad = lambda t: " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " "
    want = set()
    for d, t in docs:
        for s, groups, floor, own in known:
            hit = t and groups and all(any(p and len(pad(p)) > 2 and pad(p) in pad(t) for p in g or []) for g in groups)
            if hit and round(0.75 + 0.1 * jac(tokens(pad(t)), set(own)), 6) >= floor:
                want.add((d, s))
    assert {r[:2] for r in got} == want and len(want) > 20
    assert S.protected_source_match(frames[0], frames[1].filter("src < 0"), ident="doc", name="src").count() == 0


@pytest.mark.parametrize("threshold", [0.68, 0.3])
def test_pairs_are_compared_once_in_cells_of_any_size(spark, threshold):
    """A key of many rows is dealt in cells; no pair is met twice or lost, and best scores need no table of edges."""
    data = rows(90, 4) + [(200, "f1", "a1", "r1", "m1", 1, [None], ["p1"], "ring bar"), (201, "f1", "a1", "r1", None, 1, [None], ["p1"], "ring axis"), (202, "f1", "a1", "r1", "m1", 1, None, ["p1"], "ring bar")]
    frame = spark.createDataFrame(data, SCHEMA)
    full = S.profiles(S.with_tokens(frame)).cache()
    names = {r.rep for r in full.collect()}
    held = [r for r in data if r[0] in names and r[6] is not None]
    want = {(a[0], b[0]): score(a, b) for a, b in itertools.combinations(held, 2) if score(a, b) >= threshold}
    best = {}
    for a, b in itertools.permutations([r for r in data if r[6] is not None], 2):
        if score(a, b) >= threshold:
            best[a[0]] = max(best.get(a[0], 0), score(a, b))
    for cell, cells in ((4096, 1 << 18), (3, 40)):
        met = [(r.l_rep, r.r_rep) for r in S.edge_candidates(full, threshold, cell=cell, cells=cells).collect()]
        assert len(met) == len(set(met)) and want.keys() <= set(met)
        found = S.edge_candidates(full, threshold, threshold - 1e-6, cell=cell, cells=cells).collect()
        assert {(r.l_rep, r.r_rep): round(r.raw, 6) for r in found if round(r.raw, 6) >= threshold} == pytest.approx(want)
        told = S.sibling_scores(frame, threshold, cell=cell, cells=cells)
        assert {r.id: r.top_score for r in told.collect()} == pytest.approx(best)
        assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
