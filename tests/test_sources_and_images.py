"""Files, manifests and rasters written at test time."""

import hashlib
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from evalloom.operators import geometry as G
from evalloom.sources import files as FL
from evalloom.sources import images as I
from evalloom.sources import jsonl as J
from evalloom.sources import manifests as M
from pictures import square, write_png

SCHEMA = StructType().add("a", LongType()).add("b", StringType())


def test_read_jsonl_names_file_and_line(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 3}\n\n{"a": \n[1]\n"text"\n{"a": 4}\n')
    good, errors = J.read_jsonl(spark, str(tmp_path / "*.jsonl"), SCHEMA)
    assert sorted(r.a for r in good.collect()) == [1, 2, 3, 4]
    found = {(os.path.basename(r.file), r.line, r.error) for r in errors.collect()}
    assert found == {("bad.jsonl", 3, "invalid JSON"), ("bad.jsonl", 4, "not a JSON object"), ("bad.jsonl", 5, "not a JSON object")}


def test_missing_file_is_empty(spark, tmp_path):
    good, errors = J.read_jsonl(spark, str(tmp_path / "nothing.jsonl"), SCHEMA)
    assert good.count() == 0 and errors.count() == 0


def test_canonical_json_equals_python(spark):
    row = {"b": None, "a": "é\"x", "n": 1.5, "t": True}
    text = spark.range(1).select(J.canonical_json({k: F.lit(x) for k, x in row.items()}).alias("x")).first().x
    assert text == json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_append_unique(spark):
    target = spark.createDataFrame([("a",)], "id string")
    incoming = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("", 4), (None, 5), ("c", 6)], "id string, seq int")
    good, rejects = J.append_unique(target, incoming, "id", "seq")
    assert sorted((r.id, r.seq) for r in good.collect()) == [("b", 2), ("c", 6)]
    assert sorted((r.seq, r.reason) for r in rejects.collect()) == [
        (1, "already_stored"), (3, "repeated_in_batch"), (4, "missing_id"), (5, "missing_id")
    ]


def test_tree_digest_equals_python(spark, tmp_path):
    for name, text in {"x/a.txt": "1", "b.txt": "2", "x/c.pyc": "3"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    files = FL.file_digests(spark, str(tmp_path))
    kept = FL.drop_caches(files)
    want = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in {"x/a.txt": "1", "b.txt": "2"}.items()}
    packed = json.dumps(want, sort_keys=True, separators=(",", ":"))
    assert FL.tree_digest(kept).first().tree_sha256 == hashlib.sha256(packed.encode()).hexdigest()
    assert FL.determinism_check(files, files).first().identical
    assert not FL.determinism_check(files, kept).first().identical


def test_discovery_prefers_the_own_manifest(spark):
    listing = spark.createDataFrame(
        [("r1", M.MANIFEST_NAME), ("r1", f"x/{M.MANIFEST_NAME}"), ("r2", f"x/{M.MANIFEST_NAME}"), ("r2", f"y/{M.MANIFEST_NAME}"), ("r3", "x.json")],
        "root string, rel string",
    )
    got = sorted((r.root, r.rel or "") for r in M.discover_manifests(listing, "root", "rel").collect())
    assert got == [("r1", M.MANIFEST_NAME), ("r2", f"x/{M.MANIFEST_NAME}"), ("r2", f"y/{M.MANIFEST_NAME}"), ("r3", "")]


def test_cohorts_and_export(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "s1", True), ("c1", "s2", False), ("c2", "s3", True)], "campaign string, sha string, eligible boolean")
    summary = {r.campaign: (r.candidates, r.eligible) for r in M.write_cohorts(rows, "campaign", str(tmp_path / "out")).collect()}
    assert summary == {"c1": (2, 1), "c2": (1, 1)}
    assert sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("campaign")) == ["campaign=c1", "campaign=c2"]
    manifest = spark.createDataFrame(
        [(1, "f", "i.png", "yes", ["yes", "no"], 1.0, False), (2, "f", "i.png", "no", ["yes", "no"], 1.0, True), (3, "f", "i.png", "no", ["yes", "no"], None, None)],
        "scene_id int, prompt_family string, image_path string, answer string, candidates array<string>, margin double, quarantined boolean",
    ).withColumns({"campaign_id": F.lit("c"), "candidate_id": F.lit("k"), "question": F.lit("q"), "human_admission": F.lit("pending")})
    assert M.write_eval_manifest(manifest, F.lit("rec"), str(tmp_path / "eval")) == 2
    written = spark.read.json(str(tmp_path / "eval"))
    assert len(written.columns) == 14 and {r.example_id for r in written.collect()} == {"rec::1_f", "rec::3_f"}


def test_strict_load_names_every_fault(spark):
    import json

    good = dict.fromkeys(M.MANIFEST_KEYS, "x") | {"schema_version": M.MANIFEST_VERSION, "candidates": ["a", "b"], "answer": "a", "quarantined": False}
    raws = [good, good | {"schema_version": "old"}, {k: x for k, x in good.items() if k not in ("question", "answer")}, good | {"campaign_id": " "}, None]
    rows = spark.createDataFrame([(i, r and json.dumps(r), False, ["a", "b"], "a", "i/x.png") for i, r in enumerate(raws)], "id int, raw string, quarantined boolean, candidates array<string>, answer string, image_path string")
    got = {(r.id, r.rule, r.detail) for r in M.load_violations(rows, ["id"], raw="raw").collect()}
    assert got == {(1, "unsupported_version", "old"), (2, "missing_keys", "answer,question"), (3, "blank_text", "campaign_id"), (4, "missing_keys", ",".join(sorted(M.MANIFEST_KEYS)))}


@pytest.fixture
def pictures(spark, tmp_path):
    for i, (x, y) in enumerate([(8, 8), (24, 8), (40, 8), (56, 8), (8, 24), (40, 40)]):
        write_png(tmp_path / f"s{i}.png", square(x, y))
    return str(tmp_path)


def test_scan_images(spark, pictures, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"\xff\xd8\xff\xe0 not really")
    got = {os.path.basename(r.path): r for r in I.scan_images(spark, pictures).collect()}
    assert got["s0.png"].type_matches and got["s0.png"].decodes and got["s0.png"].height == 64
    assert not got["bad.png"].type_matches and not got["bad.png"].decodes


def test_one_compact_cue_is_focal_and_stable(spark, pictures):
    images = spark.read.format("image").load(pictures).select(F.col("image.origin").alias("scene"), "image")

    def scorer(pixels):
        return "present" if int((pixels.mean(axis=2) < 128).sum()) >= 16 else "absent"

    grids = I.ablation_impact(images, "scene", scorer, grid=8, overlap=4).withColumn("candidate", F.lit(1).cast("bigint"))
    out = G.attest(grids, "candidate").first()
    assert (out.status, out.stability, out.scenes, len(out.vector)) == ("complete", 1.0, 6, 149)
    assert out["shape"] == "compact" and out["scale"] == "focal"
    profile = I.image_profile(images, "scene").collect()
    assert all(abs(r.foreground - 49 / 4096) < 1e-3 for r in profile)
    labels = I.palette_label(images, "scene", [(0, 0, 0), (255, 255, 255)]).filter("label = 0").collect()
    assert {r.pixels for r in labels} <= {49, 56} | {r.pixels for r in labels if r.pixels == 49}


def test_empty_and_single_cell_grids(spark):
    empty, single = [0.0] * 64, [0.0] * 63 + [1.0]
    df = spark.createDataFrame([(1, empty, empty), (2, single, empty)], "scene int, impact array<double>, error array<double>")
    rows = {r.scene: r for r in G.scene_profiles(df).collect()}
    assert rows[1].scale is None and rows[1].components == 0 and rows[1].elongation == 1.0
    assert (rows[2].span, rows[2].components, rows[2].elongation, rows[2].fill) == (0.0, 1, 1.0, 1.0)
    assert np.array(rows[2].impact_map).reshape(8, 8)[4, 4] + np.array(rows[2].impact_map).reshape(8, 8)[3, 3] == 1.0
    assert G.component_table(df, "scene", "impact").count() == 1


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, bad in (("a", 95), ("b", 95), ("c", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join("nope\n" if i == bad else f'{{"x": {i}}}\n' for i in range(1, 101)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        good, errors = J.read_jsonl(spark, str(tmp_path), StructType().add("x", LongType()))
        assert sorted((r.file[-7:], r.line) for r in errors.collect()) == [("a.jsonl", 95), ("b.jsonl", 95), ("c.jsonl", 3)]
        assert good.count() == 297
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_picture_without_an_answer_keeps_its_row(spark, pictures):
    images = spark.read.format("image").load(pictures).select(F.col("image.origin").alias("scene"), "image")

    def scorer(pixels):
        raise ValueError("blank")

    rows = I.ablation_impact(images, "scene", scorer, grid=2, overlap=None).collect()
    assert len(rows) == 6 and all(r.decision is None and r.failure == "blank" and r.error == [1.0] * 4 for r in rows)


def test_scene_kernels_share_a_worker_and_take_slices(spark):
    """Memory of Python: one worker for each task runs all kernels of a scene, over few rows at a time whatever the batch."""
    row = [float(i % 7 == 0) for i in range(64)]
    grids = spark.createDataFrame([(i, row, row[::-1]) for i in range(3)], "scene bigint, impact array<double>, error array<double>")
    plan = G.scene_profiles(grids)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    sizes = []

    def count(cells):
        sizes.append(len(cells))
        return cells * 2

    assert list(G._in_slices(count, pd.Series(range(1300)))) == [2 * i for i in range(1300)]
    assert max(sizes) <= 512 and list(G._in_slices(count, pd.Series([], dtype=float))) == []


def test_results_of_pictures_come_in_pieces(spark, monkeypatch):
    held = {}
    frame = spark.createDataFrame([(0, None)], f"scene bigint, image {I.IMAGE_STRUCT}")
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, run, schema: held.setdefault("run", run))
    I.image_decision(frame, "scene", lambda pixels: str(pixels.shape))
    image = {"height": 1, "width": 2, "nChannels": 3, "data": bytes(6)}
    pieces = list(held["run"](iter([pd.DataFrame({"scene": range(700), "image": [image] * 700})])))
    assert max(map(len, pieces)) <= 256
    assert pd.concat(pieces)["scene"].tolist() == list(range(700)) and set(pd.concat(pieces)["decision"]) == {"(1, 2, 3)"}
