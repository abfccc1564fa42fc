"""A null key is a sequence of its own, in every operator that joins a scan with its totals."""

from pyspark.sql import functions as F

from evalloom.operators import sampling as SA
from evalloom.operators import series as SE


def test_even_cover_keeps_the_null_group(spark):
    data = [(g, f"img{i:02d}") for g in ("a", None) for i in range(9)]
    got = SA.even_cover(spark.createDataFrame(data, "grp string, image string"), "grp", "image", F.substring("image", 1, 4)).collect()
    picks = {g: sorted(r.image for r in got if r.grp == g) for g in ("a", None)}
    assert len(picks["a"]) == 6 and picks["a"] == picks[None]


def test_blind_ids_number_rows_without_a_hash(spark):
    data = [(1, "bb"), (2, None), (3, "aa"), (4, None)]
    got = {r.id: r.blind_id for r in SA.blind_ids(spark.createDataFrame(data, "id bigint, sha string"), "sha", "id").collect()}
    assert got == {2: "candidate_001", 4: "candidate_002", 3: "candidate_003", 1: "candidate_004"}


def test_cycles_and_residuals_keep_the_null_key(spark):
    wave = [float(i // 20 % 2) for i in range(200)]
    data = [(k, i, x) for k in (1, None) for i, x in enumerate(wave)]
    rows = spark.createDataFrame(data, "k bigint, at bigint, v double")
    got = {r.k: (r.cycles, r.narrowest) for r in SE.count_cycles(rows, ["k"], ["at"], "v", F.expr("at div 50"), F.floor("smooth")).collect()}
    assert set(got) == {1, None} and got[1] == got[None] and got[1][0] == 5
    residual = SE.profile_residual(rows.withColumn("w", F.col("v") + 3), ["k"], "v", "w", 0.1).collect()
    assert sorted((r.k is None, r.positions, r.residual) for r in residual) == [(False, 200, 0.0), (True, 200, 0.0)]


def test_run_gaps_count_the_rows_between(spark):
    from evalloom.operators import logs as LG

    flags = [1, 1, 0, 1, 1, 1, 0, 0, 1, 0, 1, 1]
    rows = spark.createDataFrame([(k, i, f) for k in (5, None) for i, f in enumerate(flags)], "k bigint, at bigint, f int")
    got = LG.run_gaps(rows, ["k"], ["at"], F.col("f") == 1, F.expr("at div 4"), 2, span=3).collect()
    for key in (5, None):
        assert sorted((r.start, r.stop, r.width, r.gap) for r in got if r.k == key) == [(0, 2, 2, None), (3, 6, 3, 1), (10, 12, 2, 4)]
