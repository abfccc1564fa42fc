"""Panel rules, contract checks and scalar functions on hand-made rows."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from evalloom.functions import geometry as GE
from evalloom.functions import text as TX
from evalloom.functions.similarity import rms_distance
from evalloom.operators import checks as C
from evalloom.operators import ledger as L
from evalloom.operators import panel as P
from evalloom.operators import reports as R

# recorded panel accuracies of twenty candidates with their mean; all were hard
RECORDED = [
    ((1.0, 0.4, 0.6), 0.6667), ((1.0, 0.2, 0.6), 0.6), ((0.2, 0.4, 0.4), 0.3333), ((0.6, 0.6, 0.8), 0.6667),
    ((1.0, 0.4, 0.6), 0.6667), ((1.0, 0.2, 0.2), 0.4667), ((1.0, 0.6, 0.6), 0.7333), ((0.8, 0.4, 0.6), 0.6),
    ((0.6, 0.6, 0.6), 0.6), ((0.4, 0.4, 0.6), 0.4667), ((0.8, 0.2, 0.6), 0.5333), ((0.0, 0.6, 0.6), 0.4),
    ((1.0, 0.6, 0.6), 0.7333), ((0.6, 0.6, 0.6), 0.6), ((0.6, 1.0, 0.6), 0.7333), ((0.4, 0.6, 0.6), 0.5333),
    ((0.6, 0.8, 0.2), 0.5333), ((0.6, 0.6, 1.0), 0.7333), ((1.0, 0.2, 0.2), 0.4667), ((0.4, 0.0, 1.0), 0.4667),
]


def verdicts(spark, rows):
    flat = [(c, f"m{i}", a) for c, accs in enumerate(rows) for i, a in enumerate(accs)]
    df = spark.createDataFrame(flat, "candidate int, evaluator string, accuracy double")
    return P.panel_verdict(df, "candidate", "evaluator", "accuracy", 0.6).orderBy("candidate").collect()


def test_recorded_panels(spark):
    out = verdicts(spark, [r[0] for r in RECORDED])
    assert [round(r.mean_accuracy, 4) for r in out] == [m for _, m in RECORDED]
    assert all(r.hard_majority for r in out)


def test_threshold_is_inclusive_only_for_the_majority(spark):
    out = verdicts(spark, [(0.6, 0.6, 1.0), (0.6, 0.8, 1.0), (0.4, 0.8, 0.6), (0.5, 0.5, 0.5)])
    assert [r.hard_majority for r in out] == [True, False, True, True]
    assert [r.hard_any_below for r in out] == [False, False, True, True]
    assert [r.hard_all_below for r in out] == [False, False, False, True]


def test_no_scored_sample_has_no_accuracy(spark):
    df = spark.createDataFrame(
        [("g", "s", 1, "api_error", None, None, None, None)],
        "g string, sample_key string, seq int, status string, correct boolean, completion_tokens bigint, reasoning_tokens bigint, cost double",
    )
    row = L.event_summary(df, ["g"]).first()
    assert row.accuracy is None and row.attempted_samples == 1 and row.cost == 0.0


def test_retry_keeps_errors_open(spark):
    examples = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sample_key string")
    events = spark.createDataFrame(
        [("a", 1, "attempt_started"), ("a", 2, "scored"), ("b", 3, "attempt_started"), ("c", 4, "api_error")],
        "sample_key string, seq int, status string",
    )
    keys = lambda df: sorted(r.sample_key for r in df.collect())
    assert keys(L.remaining_examples(examples, events, retry_errors=False)) == ["d"]
    assert keys(L.remaining_examples(examples, events, retry_errors=True)) == ["b", "c", "d"]


def test_missing_counts(spark):
    rows = spark.createDataFrame([("g", {"x": 1.0}), ("g", {"x": 0.5, "y": 1.0}), ("g", None), ("h", None)], "g string, rewards map<string,double>")
    out = {(r.g, r.metric): r.value for r in R.mean_rewards(rows, "g", "rewards").collect()}
    assert out == {("g", "mean_x"): 0.5, ("g", "mean_y"): pytest.approx(1 / 3), ("h", "mean_reward"): 0.0}
    gates = spark.createDataFrame([("g", {"a": True}), ("g", {"a": True, "b": True})], "g string, gates map<string,boolean>")
    rates = {r.gate: r.rate for r in R.gate_pass_rates(gates, "g").collect()}
    assert rates == {"a": 1.0, "b": 0.5}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "value", [3, -7, 0, 1.5, 2.0, 0.1, 1e7, 12345678.5, 1e-4, 1e16, 1.5e20, 2e-7, 1e-5]
)
def test_choice_text_of_numbers(spark, value):
    text = json.dumps(value)
    assert one(spark, TX.choice_text(F.lit(text))) == text


@pytest.mark.parametrize("raw,want", [('"yes"', "yes"), ('" "', None), ("true", None), ("null", None), ("[1]", None), ("nope{", None)])
def test_choice_text_of_other_values(spark, raw, want):
    assert one(spark, TX.choice_text(F.lit(raw))) == want


@pytest.mark.parametrize("text", ["  YES.  ", "Ｎｏ", "ﬁne\t  Print!", "'Straße'", "²  x", "a;b", "ÉTÉ", "?!"])
def test_normalize_answer(spark, text):
    folded = " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    want = folded.strip(" \t\r\n\"'`.,:;!?")
    assert one(spark, TX.normalize_answer(F.lit(text))) == want


@pytest.mark.parametrize(
    "content,status",
    [
        ('{"answer": "A", "confidence": 1}', "scored"),
        ('{"answer": "a.", "confidence": 0.5}', "scored"),
        ('{"answer": "A", "confidence": true}', "unparseable"),
        ('{"answer": 1, "confidence": 0.5}', "unparseable"),
        ('{"answer": "A", "confidence": 1.01}', "unparseable"),
        ('{"answer": "A"}', "unparseable"),
        ('{"answer": "A", "confidence": 0.5, "x": 1}', "unparseable"),
        ('{"answer": "C", "confidence": 0.5}', "unparseable"),
        ('["A"]', "unparseable"),
        ("A", "unparseable"),
    ],
)
def test_score_responses(spark, content, status):
    row = spark.createDataFrame([(content, ["A", "B"], "A", None)], "content string, candidates array<string>, gold string, refusal string")
    out = TX.score_responses(row).first()
    assert out.status == status
    assert (out.prediction, out.correct) == (("A", True) if status == "scored" else (None, None))


def test_refusal_wins(spark):
    row = spark.createDataFrame([('{"answer": "A", "confidence": 1}', ["A"], "A", "no")], "content string, candidates array<string>, gold string, refusal string")
    assert TX.score_responses(row).first().status == "refused"


def test_tokens_and_jaccard(spark):
    assert sorted(one(spark, TX.tokens(F.lit("The LARGEST circle is above two disks, circle")))) == ["disk", "disks", "maximum", "order"]
    assert one(spark, TX.jaccard(TX.tokens(F.lit("the of")), TX.tokens(F.lit("")))) == 0.0
    assert one(spark, TX.contains_phrase(F.lit("Red-Ring, now"), F.lit("ring now"))) is True
    assert one(spark, TX.contains_phrase(F.lit("rings now"), F.lit("ring now"))) is False


@pytest.mark.parametrize(
    "m,want", [(20.0, "far_separate"), (1.0, "near_separate"), (-1.0, "tangent"), (0.0, "tangent"), (-20.0, "near_overlap"), (-80.0, "deep_overlap"), (81.0, None)]
)
def test_shared_bin_edges_go_to_the_earlier_bin(spark, m, want):
    assert one(spark, C.first_bin(F.lit(m), C.GAP_BINS)) == want


def test_gold_ties(spark):
    gap = lambda f, m: one(spark, C.gap_answer(F.lit(f), F.lit(m)))
    assert gap("pf3_gap_yesno", 0.0) == "no" and gap("pf6_visual_evidence", 0.0) == "yes" and gap("pf4_multiple_choice", 0.0) == "B"
    angle = lambda f: one(spark, C.angle_answer(F.lit(f), F.lit(0.0)))
    assert [angle(f) for f in (*C.ACUTE_FAMILIES, C.OBTUSE_FAMILY, C.ACUTE_CHOICE_FAMILY)] == ["no"] * 4 + ["A"]
    count = lambda f, n: one(spark, C.count_answer(F.lit(f), F.lit(n)))
    assert [count(C.MORE_THAN_FAMILY, 3), count(C.AT_MOST_FAMILY, 3), count(C.EXACTLY_FAMILY, 4), count("pf2_count_count", 5)] == ["no", "yes", "yes", "5"]


def test_missing_flag_is_not_eligible(spark):
    flags = [F.lit(True), F.lit(None).cast("boolean")]
    assert one(spark, C.eligible(F.lit(True), F.lit(1.0), flags)) is False
    assert one(spark, C.eligible(F.lit(True), F.lit(1.0), flags[:1])) is True


def test_paths_and_forbidden_fields(spark):
    df = spark.createDataFrame([(1, "a/b"), (2, "/a"), (3, "a/../b"), (4, ""), (5, "a..b"), (6, None)], "id int, p string")
    found = {(r.id, r.rule) for r in C.violations(df, ["id"], C.relative_path_rules(F.col("p"))).collect()}
    assert {(2, "absolute"), (3, "parent_step"), (4, "empty"), (6, "empty")} <= found
    assert not any(i in (1, 5) for i, _ in found)
    nested = '{"a":[{"b":{"answer":1}}],"note":"\\"gold\\":1"}'
    assert one(spark, C.has_forbidden_field(F.lit(nested), ["answer"])) is True
    assert one(spark, C.has_forbidden_field(F.lit(nested), ["gold"])) is False


def test_secrets(spark):
    hit = lambda t: one(spark, C.secret_hit(F.lit(t), ["hunter2hunter2", "short"]))
    assert hit("x hunter2hunter2 y") == "value"
    assert hit("x aHVudGVyMmh1bnRlcjI= y") == "base64"
    assert hit("see /home/someone/x") == "pattern" and hit("see /home/agent/x") is None
    assert hit("short") is None


def test_geometry_scalars(spark):
    assert one(spark, GE.lens_area(F.lit(1.0), F.lit(1.0), F.lit(2.0))) == 0.0
    assert one(spark, GE.lens_area(F.lit(1.0), F.lit(3.0), F.lit(1.0))) == pytest.approx(3.14159265)
    assert one(spark, GE.lens_area(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == pytest.approx(1.2283697)
    assert [one(spark, GE.angle_bucket(F.lit(a))) for a in (22.4, 22.5, 67.5, 112.5, 157.5, -10.0)] == ["horizontal", "rising", "vertical", "falling", "horizontal", "horizontal"]
    assert one(spark, GE.transpose_bits(F.lit("123456789"))) == "147258369"
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, rms_distance(v(0, 0), v(3, 4))) == pytest.approx((25 / 2) ** 0.5)
    assert one(spark, rms_distance(v(0), v(3, 4))) is None


def test_feedback_cost_does_not_depend_on_the_order_of_rows(spark):
    costs = spark.range(3000).selectExpr("'m0' AS evaluator", "id % 3 = 0 AS bootstrap", "IF(id = 1, 80000000.1D, 0.1D) AS cost")
    odd = spark.createDataFrame([("m1", False, float("nan")), ("m1", False, 1.0)], "evaluator string, bootstrap boolean, cost double")
    state = spark.createDataFrame([("m0", 3000, 80000200.0)], "evaluator string, state_count bigint, state_cost double")
    got = {r.evaluator: r for r in P.feedback_reconcile(costs.unionByName(odd), state, "evaluator").collect()}
    assert (got["m0"].cost_usd, got["m0"].bootstrap_cost_usd, got["m0"].passed) == (80000200.0, 100.0, True)
    assert got["m1"].cost_usd != got["m1"].cost_usd  # a cost that is no number stays visible


def test_shared_fields_reduces_keys_before_they_meet(spark):
    raw = spark.range(50).selectExpr("""'{"a": 1, "b": ' || id || ', "z": 0}' AS raw""")
    shared = R.shared_fields(raw, "raw", ["a", "c", "b", "a"])
    lines = shared._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    generate = next(i for i, line in enumerate(lines) if "Generate explode(" in line)
    assert any("HashAggregate" in line for line in lines[join:generate])
    assert sorted(r.field for r in shared.collect()) == ["a", "b"]
