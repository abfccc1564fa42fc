"""The block fold and the stream equal the one-by-one fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import archive as A
from evalloom.streaming import archive as SA
from evalloom.streaming import ledger as SL
from evalloom.streaming import ordered as SO

CELLS = ("a", "b", "c")
POLICY = A.ArchivePolicy(cells=CELLS, max_elites=2, global_floor=0.05, local_floor=0.06, vector_size=4)


def rows(seed=3, campaigns=3, n=16):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(campaigns):
        for e in range(n if c else 3 * n):
            out.append((c, e, c * 1000 + e, str(rng.choice(CELLS)), float(rng.random()), [float(x) for x in rng.random(4)], None))
    return out


SCHEMA = "campaign_id bigint, episode bigint, candidate_id bigint, cell string, similarity double, vector array<double>, reason string"


def one_by_one(data, policy=POLICY, step=A.attested_step):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    decisions, finals = {}, {}
    for c in sorted({r[0] for r in data}):
        elites = []
        ordered = sorted((dict(zip(names, r)) for r in data if r[0] == c), key=lambda r: r["episode"])
        for who, reason, admitted, replaced in A.fold_in_order(policy, step)(elites, ordered):
            decisions[who] = (reason, admitted, replaced)
        finals[c] = sorted(e["id"] for e in elites)
    return decisions, finals


@pytest.mark.parametrize("block,look", [(3, 2), (4096, 4)])
def test_blocks_equal_one_by_one(spark, block, look):
    data = rows()
    want, elites = one_by_one(data)
    decided, final = A.archive_fold(spark.createDataFrame(data, SCHEMA), POLICY, block_rows=block, first_lookahead=look)
    assert {r.candidate_id: (r.reason, r.admitted, r.replaced) for r in decided.collect()} == want
    got = {}
    for r in final.collect():
        got.setdefault(r.campaign_id, []).append(r.id)
    assert {c: sorted(v) for c, v in got.items()} == elites


def test_stream_equals_batch(spark, tmp_path):
    data = rows(seed=8)
    frame = spark.createDataFrame(data, SCHEMA)
    for part in range(4):
        frame.filter(F.expr(f"episode div 12 = {part}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = SL.file_stream(spark, str(tmp_path / "in"), frame, files_per_batch=1)
    closing = SO.Closing(spark, frame, "episode")
    decided = SL.drain(SA.stream_archive(closing.after(stream), POLICY, lateness=48), "append", name="t", closing=closing)
    want, _ = one_by_one(data)
    assert {r.candidate_id: (r.reason, r.admitted, r.replaced) for r in decided.collect()} == want


def test_late_episode_is_left_out_and_counted(spark, tmp_path):
    frames = [spark.createDataFrame([(0, e, e, "a", 0.1, [x] * 4, None)], SCHEMA) for e, x in ((500, 0.0), (600, 0.9), (2, 1.0))]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = SL.file_stream(spark, str(tmp_path / "in"), frames[0], files_per_batch=1)
    closing, progress = SO.Closing(spark, frames[0], "episode"), []
    decided = SL.drain(SA.stream_archive(closing.after(stream), POLICY, lateness=100), "append", name="t", closing=closing, progress=progress)
    assert {r.candidate_id: r.reason for r in decided.collect()} == {500: "open_elite_slot", 600: "open_elite_slot"}
    assert SO.late_rows(progress) == 1


def test_swap_needs_a_real_gain_and_takes_the_larger_id_on_a_tie():
    at = lambda i, x: {"candidate_id": i, "cell": "a", "similarity": 0.0, "vector": [x, 0.0, 0.0, 0.0]}
    policy = A.ArchivePolicy(cells=CELLS, max_elites=2, global_floor=0.0, local_floor=0.0, vector_size=4)
    elites = []
    for row in (at(1, 0.0), at(2, 0.5)):
        assert A.attested_step(policy, elites, row)[0] == "open_elite_slot"
    assert A.attested_step(policy, elites, at(3, 0.25)) == ("cell_full_no_dispersion_improvement", False, None)
    assert A.attested_step(policy, elites, at(4, 1.0)) == ("maximin_dispersion_improved", True, 2)
    # both replacements would leave the same gap: the larger id goes
    elites = []
    for row in (at(1, 0.4), at(2, 0.6)):
        A.attested_step(policy, elites, row)
    far = {"candidate_id": 9, "cell": "a", "similarity": 0.0, "vector": [0.5, 0.9, 0.0, 0.0]}
    assert A.attested_step(policy, elites, far) == ("maximin_dispersion_improved", True, 2)


def test_declared_step():
    policy = A.ArchivePolicy(cells=CELLS, max_elites=1, local_similarity_ceiling=0.6)
    row = lambda i, s, ids, scores: {"candidate_id": i, "cell": "a", "similarity": s, "neighbour_ids": ids, "neighbour_scores": scores}
    elites = []
    assert A.declared_step(policy, elites, row(1, 0.5, [], []))[0] == "open_elite_slot"
    assert A.declared_step(policy, elites, row(2, 0.4, [], []))[0] == "incomplete_within_cell_neighbor_evidence"
    assert A.declared_step(policy, elites, row(3, 0.4, [1], [0.4])) == ("lower_similarity_replacement", True, 1)
    assert A.declared_step(policy, elites, row(4, 0.4, [3], [0.4]))[0] == "cell_full_no_local_improvement"


def test_distance_and_empty_cells(spark):
    elites = spark.createDataFrame([(0, "a", 1, [0.0, 0.0]), (0, "a", 2, [0.6, 0.8]), (0, "b", 3, [1.0, 1.0])], "campaign_id int, cell string, id int, vector array<double>")
    archives = spark.createDataFrame([(0,)], "campaign_id int")
    out = {r.cell: (r.occupancy, r.min_distance) for r in A.archive_summary(elites, archives, ["campaign_id"], list(CELLS), "id").collect()}
    assert out == {"a": (2, round(np.sqrt(0.5), 9)), "b": (1, None), "c": (0, None)}


def test_unknown_flags_are_refused(spark):
    whole = dict(valid=True, attested=True, cell="a", similarity=0.1, vector=[0.1] * 4, error_fraction=0.1, stability=0.9)
    rows = [whole] + [whole | {name: None} for name in whole]
    df = spark.createDataFrame(rows, "valid boolean, attested boolean, cell string, similarity double, vector array<double>, error_fraction double, stability double")
    reasons = [r.reason for r in df.select(A.admission_reason(POLICY).alias("reason")).collect()]
    assert reasons[0] is None and all(reasons[1:])
