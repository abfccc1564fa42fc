"""Manifests: discovery, strict loading, export, catalogue, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.checks import closed_choice_rules, relative_path_rules, required_key_rules, violations

MANIFEST_NAME = "vlm_manifest.jsonl"


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below a root: path and length only, no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length")
    )


def discover_manifests(listing: DataFrame, root: str, relative: str, name: str = MANIFEST_NAME) -> DataFrame:
    """Per root its own manifest, else all manifests below it; roots without any are reported."""
    base = F.element_at(F.split(F.col(relative), "/"), -1)
    found = listing.select(root, relative, (base == name).alias("hit"), (F.col(relative) == name).alias("own"))
    per_root = found.groupBy(root).agg(F.bool_or("own").alias("has_own"), F.bool_or("hit").alias("has_any"))
    hits = found.filter("hit").select(root, relative, "own").distinct()
    chosen = hits.join(per_root.select(root, "has_own"), root).filter("own OR NOT has_own").select(root, relative)
    missing = per_root.filter("NOT has_any").select(root, F.lit(None).cast("string").alias(relative))
    return chosen.unionByName(missing)


# The version and the keys of a manifest row, and the keys that hold text.
MANIFEST_VERSION = "candidate-vlm-manifest-0.1.0"
MANIFEST_KEYS = [
    "schema_version", "example_id", "source_record_id", "campaign_id", "candidate_id", "image_path", "question", "answer", "candidates",
    "prompt_family", "quarantined",
]
MANIFEST_TEXTS = ["example_id", "source_record_id", "campaign_id", "candidate_id", "question", "prompt_family"]
# end of fixed values


def load_violations(rows: DataFrame, keys: list[str], *, raw: str | None = None) -> DataFrame:
    """Rules of a strict manifest load that look at one row.

    ``raw`` names the row's JSON text; with it the keys, the version and the texts that
    must not be blank are checked too.
    """
    rules = [
        ("quarantined", ~F.col("quarantined").eqNullSafe(False), F.col("quarantined")),
        *closed_choice_rules(F.col("candidates"), F.col("answer")),
        *relative_path_rules(F.col("image_path")),
    ]
    if raw is not None:
        value = lambda key: F.get_json_object(raw, f"$.{key}")
        rules += required_key_rules(F.col(raw), MANIFEST_KEYS)
        rules.append(("unsupported_version", F.coalesce(value("schema_version") != MANIFEST_VERSION, F.lit(False)), value("schema_version")))
        rules += [("blank_text", F.coalesce(F.trim(value(key)) == "", F.lit(False)), F.lit(key)) for key in MANIFEST_TEXTS]
    return violations(rows, keys, rules)


def load_snapshots(rows: DataFrame, manifest: str, dataset: str, key: str) -> DataFrame:
    """Row count per manifest with the checks that span rows: one dataset id, unique keys."""
    keys = rows.groupBy(manifest, key).agg(F.count(F.lit(1)).alias("copies"), F.min(dataset).alias("lo"), F.max(dataset).alias("hi"))
    return keys.groupBy(manifest).agg(
        F.min("lo").alias("dataset_id"),
        F.sum("copies").alias("row_count"),
        F.count_if(F.col("copies") > 1).alias("repeated_keys"),
        (F.min("lo") == F.max("hi")).alias("single_dataset"),
    )


def export_eval_manifest(rows: DataFrame, record_id: Column) -> DataFrame:
    """Rows outside quarantine in the evaluation layout, all of its keys.

    ``rows`` has ``scene_id, prompt_family, campaign_id, candidate_id, image_path, question,
    answer, candidates, margin, quarantined, human_admission``.
    """
    return rows.filter(~F.coalesce("quarantined", F.lit(False))).select(
        F.lit(MANIFEST_VERSION).alias("schema_version"),
        F.concat(record_id, F.lit("::"), F.col("scene_id").cast("string"), F.lit("_"), F.col("prompt_family")).alias("example_id"),
        record_id.alias("source_record_id"),
        "campaign_id",
        "candidate_id",
        "image_path",
        "question",
        "answer",
        F.array_join("candidates", ",").alias("candidates"),
        "prompt_family",
        "margin",
        F.lit(False).alias("quarantined"),
        F.lit(True).alias("development_only"),
        "human_admission",
    )


def write_eval_manifest(rows: DataFrame, record_id: Column, path: str) -> int:
    """Write the export as JSON lines and return the row count observed on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    out = export_eval_manifest(rows, record_id).observe(seen, F.count(F.lit(1)).alias("written"))
    out.write.json(path)
    return int(seen.get["written"])


def build_catalogue(candidates: DataFrame, gates: DataFrame, campaign: str, ident: str, metadata: DataFrame | None = None) -> DataFrame:
    """Candidates with their gate row and metadata as catalogue records, flagged when a record id repeats.

    With ``metadata`` (``ident, title, question``) a record has both texts, empty where
    unknown, and ``complete`` says whether gate row and metadata are there.
    """
    record = F.concat_ws(":", F.col(campaign), F.col(ident).cast("string"))
    joined = candidates.join(gates.withColumn("__gate", F.lit(True)), ident, "left").withColumn("record_id", record)
    if metadata is not None:
        known = metadata.select(ident, "title", "question", F.lit(True).alias("__known"))
        joined = joined.join(known, ident, "left").withColumns({
            "title": F.coalesce("title", F.lit("")), "question": F.coalesce("question", F.lit("")), "complete": F.col("__gate").isNotNull() & F.col("__known").isNotNull(),
        }).drop("__known")
    copies = joined.groupBy("record_id").agg(F.count(F.lit(1)).alias("copies"))
    return joined.drop("__gate").join(copies, "record_id").orderBy("record_id")


def repeated_records(catalogue: DataFrame) -> DataFrame:
    return (
        catalogue.groupBy("record_id").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    )


def check_catalogue(catalogue: DataFrame, version: str) -> DataFrame:
    """Records of another version, and records whose id repeats, one row for each rule and id."""
    per_id = catalogue.groupBy("record_id").agg(F.count(F.lit(1)).alias("copies"), F.count_if(~F.col("schema_version").eqNullSafe(version)).alias("others"))
    rules = [("repeated_record", F.col("copies") > 1, F.col("copies")), ("unsupported_version", F.col("others") > 0, F.col("others"))]
    return violations(per_id, ["record_id"], rules)


def cohort_summary(rows: DataFrame, campaign: str) -> DataFrame:
    return rows.groupBy(campaign).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("eligible").alias("eligible"),
        F.min("sha").alias("first_sha"),
        F.max("sha").alias("last_sha"),
    )


def write_cohorts(rows: DataFrame, campaign: str, path: str, *, files_per_campaign: int = 8) -> DataFrame:
    """One folder per campaign, a big campaign spread over several tasks, plus the summary."""
    spread = F.pmod(F.xxhash64("sha"), F.lit(files_per_campaign))
    rows.repartition(F.col(campaign), spread).write.partitionBy(campaign).parquet(path)
    return cohort_summary(rows, campaign)
