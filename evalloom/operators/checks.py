"""Contract checks.  Each one yields violations as rows ``key, rule, detail``.

A check is one projection over the input: the rules become an array of optional
structs which is filtered and exploded in place, so no rule costs a shuffle.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column, Column]


def violations(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    found = F.array(
        *[
            F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
            for name, bad, detail in rules
        ]
    )
    return df.select(*keys, F.inline(F.filter(found, lambda x: x.isNotNull())).alias("rule", "detail"))


def csv(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


def literals(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def required_key_rules(raw_json: Column, required: list[str], *, exact: bool = False) -> list[Rule]:
    """Required keys missing from a raw JSON object, and extra ones in the exact form."""
    present = F.coalesce(F.json_object_keys(raw_json), F.array().cast("array<string>"))
    missing = F.array_except(literals(required), present)
    rules = [("missing_keys", F.size(missing) > 0, csv(missing))]
    if exact:
        extra = F.array_except(present, literals(required))
        rules.append(("unknown_keys", F.size(extra) > 0, csv(extra)))
    return rules


def closed_choice_rules(candidates: Column, answer: Column) -> list[Rule]:
    size = F.coalesce(F.size(candidates), F.lit(0))
    return [
        ("too_few_candidates", size < 2, size),
        ("repeated_candidates", F.size(F.array_distinct(candidates)) < size, size),
        ("answer_outside_candidates", ~F.coalesce(F.array_contains(candidates, answer), F.lit(False)), answer),
    ]


def relative_path_rules(path: Column) -> list[Rule]:
    return [
        ("empty", F.coalesce(F.length(path), F.lit(0)) == 0, path),
        ("absolute", path.startswith("/"), path),
        ("parent_step", path.rlike(r"(^|/)\.\.(/|$)"), path),
    ]


def fingerprint_rules(fields: dict[str, list], sets: dict[str, list], depth: Column, depth_range: tuple[int, int]) -> list[Rule]:
    """Enum membership, set uniqueness and membership, and the depth range."""
    rules: list[Rule] = []
    for name, allowed in fields.items():
        rules.append((f"{name}_invalid", ~F.col(name).isin(*allowed), F.col(name)))
    for name, allowed in sets.items():
        value = F.col(name)
        bad = (
            (F.size(value) == 0)
            | (F.size(F.array_distinct(value)) < F.size(value))
            | (F.size(F.array_except(value, literals(allowed))) > 0)
        )
        rules.append((f"{name}_invalid", bad, csv(value)))
    rules.append(("depth_invalid", ~depth.between(*depth_range), depth))
    return rules


IDENTIFIER = r"^[a-z][a-z0-9_]{2,63}$"
DECISION_TYPES = ("yesno", "comparison", "selection", "threshold", "count_open")


def signature_rules(decision_var: Column, structure: Column, signature_type: Column, declared_type: Column, mechanism: Column) -> list[Rule]:
    return [
        ("decision_var_invalid", ~decision_var.rlike(IDENTIFIER), decision_var),
        ("structure_invalid", ~structure.rlike(IDENTIFIER), structure),
        ("declared_type_unknown", ~declared_type.isin(*DECISION_TYPES), declared_type),
        ("signature_type_unknown", ~signature_type.isin(*DECISION_TYPES), signature_type),
        (
            "decision_type_disagrees",
            signature_type.isin(*DECISION_TYPES) & (signature_type != declared_type),
            F.concat_ws(">", signature_type, declared_type),
        ),
        ("mechanism_too_short", F.length(F.trim(mechanism)) < 20, F.length(F.trim(mechanism))),
    ]


def length_rules(limits: dict[str, tuple[int, int]]) -> list[Rule]:
    rules = []
    for name, (low, high) in limits.items():
        n = F.coalesce(F.length(F.trim(F.col(name))), F.lit(0))
        rules.append((f"{name}_length", ~n.between(low, high), n))
    return rules


def vector_rules(vector: Column, size: int) -> list[Rule]:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return [
        ("wrong_size", F.size(vector) != size, F.size(vector)),
        ("not_finite", ~finite, F.lit(None).cast("string")),
        (
            "out_of_range",
            ~F.forall(vector, lambda x: x.between(0.0, 1.0)),
            F.size(F.filter(vector, lambda x: ~x.between(0.0, 1.0))),
        ),
    ]


def hypothesis_rules(target: Column, assigned_target: Column, parent: Column, assigned_parent: Column, evidence: Column, predicted: Column) -> list[Rule]:
    n = F.size(evidence)
    return [
        ("target_not_assigned", target != assigned_target, target),
        ("parent_not_assigned", parent != assigned_parent, parent),
        ("evidence_invalid", ~n.between(1, 5) | (F.size(F.array_distinct(evidence)) < n), n),
        ("predicted_accuracy_invalid", ~predicted.between(0.0, 1.0), F.round(predicted, 6)),
    ]


def first_bin(value: Column, bins: list[tuple[str, float, float]]) -> Column:
    """First declared bin whose closed range holds the value; null outside all of them."""
    out = None
    for name, low, high in bins:
        inside = value.between(low, high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


# Margin bins in declared order, closed at both ends.
GAP_BINS = [
    ("far_separate", 20.0, 80.0),
    ("near_separate", 1.0, 20.0),
    ("tangent", -1.0, 1.0),
    ("near_overlap", -20.0, -1.0),
    ("deep_overlap", -80.0, -20.0),
]
ANGLE_BINS = [
    ("far_acute", 10.0, 60.0),
    ("near_acute", 2.0, 10.0),
    ("right", -2.0, 2.0),
    ("near_obtuse", -10.0, -2.0),
    ("far_obtuse", -60.0, -10.0),
]
# Prompt families by the rule that turns a decision value into an answer.
GAP_OVERLAP_FAMILIES = (
    "pf5_describe_then_answer",
    "pf6_visual_evidence",
    "pf7_no_gap_yesno",
    "adv2_ignore_priors",
)
GAP_SEPARATE_FAMILIES = (
    "pf3_gap_yesno",
    "adv1_false_premise",
    "pf8_not_overlapping_yesno",
    "pf9_apart_yesno",
)
GAP_CHOICE_FAMILY = "pf4_multiple_choice"
ACUTE_FAMILIES = ("pf1_acute_yesno", "pf2_less_right_yesno", "pf3_sharp_yesno")
OBTUSE_FAMILY = "pf4_obtuse_yesno"
ACUTE_CHOICE_FAMILY = "pf5_acute_mc"
COUNT_FAMILIES = ("pf1_howmany_count", "pf2_count_count")
MORE_THAN_FAMILY = "pf3_morethan3_yesno"
AT_MOST_FAMILY = "pf4_atmost3_yesno"
EXACTLY_FAMILY = "pf5_exactly4_yesno"
# end of fixed values


def _yes(condition: Column) -> Column:
    return F.when(condition, "yes").otherwise("no")


def gap_answer(family: Column, gap: Column) -> Column:
    """Gold for the two-disk families: contact (gap <= 0) means overlap."""
    overlap = gap <= 0
    return (
        F.when(family.isin(*GAP_SEPARATE_FAMILIES), _yes(~overlap))
        .when(family == GAP_CHOICE_FAMILY, F.when(overlap, "B").otherwise("A"))
        .otherwise(_yes(overlap))
    )


def angle_answer(family: Column, margin: Column) -> Column:
    """Gold for the angle families: a right angle is neither acute nor obtuse; the choice folds to A."""
    return (
        F.when(family.isin(*ACUTE_FAMILIES), _yes(margin > 0))
        .when(family == OBTUSE_FAMILY, _yes(margin < 0))
        .when(family == ACUTE_CHOICE_FAMILY, F.when(margin >= 0, "A").otherwise("B"))
    )


def count_answer(family: Column, count: Column) -> Column:
    return (
        F.when(family.isin(*COUNT_FAMILIES), count.cast("string"))
        .when(family == MORE_THAN_FAMILY, _yes(count > 3))
        .when(family == AT_MOST_FAMILY, _yes(count <= 3))
        .when(family == EXACTLY_FAMILY, _yes(count == 4))
    )


def eligible(verified: Column, submission: Column, flags: list[Column]) -> Column:
    """All conditions present and true; a missing one is not eligible."""
    out = verified.eqNullSafe(True) & submission.eqNullSafe(1.0)
    for flag in flags:
        out = out & flag.eqNullSafe(True)
    return out


def transaction_status(eligible_col: Column, audited: Column, staged: Column, committed: Column, hash_match: Column, outcomes: Column) -> Column:
    """Scientific eligibility kept apart from a completed commit."""
    passed = F.coalesce(F.exists(outcomes, lambda o: o == "passed"), F.lit(False))
    evidence = staged.isNotNull() & committed.isNotNull() & hash_match.eqNullSafe(True) & passed
    complete = ~audited | ~eligible_col | evidence
    incomplete = audited & eligible_col & ~complete
    return F.struct(
        complete.alias("commit_complete"),
        incomplete.alias("process_incomplete"),
        (eligible_col & ~incomplete).alias("seed_eligible"),
    )


def duplicate_risk(top_score: Column, clone: Column, threshold: float) -> Column:
    score = F.coalesce(top_score, F.lit(0.0))
    return (
        F.when((score >= threshold) | F.coalesce(clone, F.lit(False)), "high")
        .when(score >= round(max(0.0, threshold - 0.15), 10), "medium")
        .otherwise("low")
    )


# Headings an audit document must hold.
AUDIT_HEADINGS = ("# Human audit", "Reviewer:", "| prompt family |", "Signed-off-by:")
# end of fixed values


def _names_someone(text: Column, label: str) -> Column:
    """What follows a label is a name: something remains without marks and white space, and it is no placeholder."""
    line = F.regexp_extract(text, rf"{label}\s*([^\r\n]*)", 1)
    name = F.regexp_replace(line, r"^[\s*_]+|[\s*_]+$", "")
    return ~name.rlike(r"UNSIGNED|___|^(?i:todo)?$")


def audit_document(text: Column, families: list[str]) -> Column:
    """Missing headings, omitted families, and whether a reviewer really signed."""
    missing = F.array_compact(F.array(*[F.when(~text.contains(h), h) for h in AUDIT_HEADINGS]))
    omitted = F.array_compact(F.array(*[F.when(~text.contains(f"`{f}`"), f) for f in families]))
    return F.struct(
        F.array_join(missing, ";").alias("missing_sections"),
        F.array_join(omitted, ";").alias("missing_families"),
        (_names_someone(text, "Reviewer:") & _names_someone(text, "Signed-off-by:")).alias("signed"),
    )


def source_row_rules(groups: Column, floor: Column, copies: Column) -> list[Rule]:
    """At least three non-empty concept groups, a floor in [0, 1], and a unique id."""
    filled = F.forall(groups, lambda g: (F.size(g) > 0) & F.forall(g, lambda w: F.trim(w) != ""))
    return [
        ("repeated_id", copies > 1, copies),
        ("concept_groups_invalid", (F.size(groups) < 3) | ~filled, F.size(groups)),
        ("floor_invalid", ~floor.between(0.0, 1.0), floor),
    ]


def size_limits(files: DataFrame, root: str, size: str, max_files: int, max_bytes: int) -> DataFrame:
    """Roots over the file count or the byte total."""
    return (
        files.groupBy(root)
        .agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("total_bytes"))
        .withColumn("too_many_files", F.col("files") > max_files)
        .withColumn("too_large", F.col("total_bytes") > max_bytes)
        .filter("too_many_files OR too_large")
    )


def has_forbidden_field(canonical_json: Column, fields: list[str]) -> Column:
    """Whether any object at any depth uses a forbidden key; text values cannot match."""
    names = "|".join(fields)
    return canonical_json.rlike(rf'[{{,]\s*"({names})"\s*:')


# Shapes of home paths, service tokens and private keys.
SECRET_PATTERNS = (
    r"/(?:Users|Volumes|home)/[A-Za-z0-9_.-]+/",
    r"(?:sk-ant-|sk-or-v1-|sk-proj-)[A-Za-z0-9_-]{20,}",
    r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----",
)
# end of fixed values


def secret_hit(text: Column, secrets: list[str], patterns: tuple[str, ...] = SECRET_PATTERNS) -> Column:
    """First kind of leak in a text of any size: a known value, its base64 form, or a shape.

    Known values under eight characters would match by chance; they are not looked for.
    """
    long = [s for s in secrets if len(s) >= 8]
    encoded = [base64.b64encode(s.encode()).decode() for s in long]
    def any_of(values: list[str]) -> Column:
        hit = F.lit(False)
        for value in values:
            hit = hit | text.contains(value)
        return hit
    scanned = F.regexp_replace(text, "/home/agent/", "/container-user/")
    shaped = scanned.rlike("|".join(f"(?:{p})" for p in patterns))
    return F.when(any_of(long), "value").when(any_of(encoded), "base64").when(shaped, "pattern")


def payload_rules(root: Column, path: Column, approved: Column, roots: list[str], suffixes: list[str], names: list[str]) -> list[Rule]:
    """Allowed root, no excluded suffix unless its hash is approved, no excluded file name."""
    base = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(base, r"(\.[^.]+)$", 1))
    return [
        ("outside_payload", ~root.isin(*roots), root),
        ("excluded_type", suffix.isin(*suffixes) & ~F.coalesce(approved, F.lit(False)), suffix),
        ("excluded_name", base.isin(*names), base),
    ]


def required_flags(flags: Column, required: list[str]) -> Column:
    """Whether every required flag is present and every present flag is true."""
    missing = F.array_except(literals(required), F.map_keys(flags))
    return (F.size(missing) == 0) & F.forall(F.map_values(flags), lambda x: x.eqNullSafe(True))
