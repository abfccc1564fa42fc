"""JSON lines: strict parsing with error rows, ledgers, unique appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CORRUPT = "__corrupt"


def parse_lines(lines: DataFrame, text: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Split lines into typed rows and error rows; blank lines are dropped.

    A line must be one JSON object.  The other columns of ``lines`` are kept on
    both sides, so a line number or a file name stays attached.
    """
    kept = [c for c in lines.columns if c != text]
    value = F.try_parse_json(F.col(text))
    kind = F.schema_of_variant(value)
    checked = lines.filter(F.trim(F.col(text)) != "").withColumn(
        "__error",
        F.when(value.isNull(), "invalid JSON").when(~kind.startswith("OBJECT"), "not a JSON object"),
    )
    good = (
        checked.filter("__error IS NULL")
        .select(*kept, F.from_json(text, schema).alias("__row"))
        .select(*kept, "__row.*")
    )
    return good, checked.filter("__error IS NOT NULL").select(*kept, F.col("__error").alias("error"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Typed rows and error rows with file and line number; a missing path is an empty table.

    Line numbers cost a pass over the files that hold an error, and only those.
    """
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    if found is None or len(found) == 0:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("file", F.lit(None).cast("string")), spark.createDataFrame(
            [], "file string, line bigint, error string"
        )
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    good, bad = parse_lines(lines, "value", schema)
    bad_files = [r.file for r in bad.select("file").distinct().limit(1001).collect()]
    if not bad_files:
        return good, spark.createDataFrame([], "file string, line bigint, error string")
    numbered = number_lines(spark, bad_files if len(bad_files) <= 1000 else [path])
    _, errors = parse_lines(numbered, "value", schema)
    return good, errors.select("file", "line", "error")


def number_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with their number per file, counted in parallel over all splits."""
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen"),
    )
    # a split is read in order, whatever splits share its partition
    inside = F.row_number().over(W.partitionBy("file", "block").orderBy("seen"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.withColumn("inside", inside).join(sizes, ["file", "block"]).select("value", "file", (F.col("before") + F.col("inside")).alias("line"))


def legacy_rename(rows: DataFrame, new: str, old: str) -> DataFrame:
    """Take ``old`` where ``new`` is absent, then drop ``old``."""
    return rows.withColumn(new, F.coalesce(new, old)).drop(old)


def canonical_json(columns: dict[str, Column]) -> Column:
    """Sorted keys, no spaces, nulls written out."""
    fields = F.struct(*[columns[name].alias(name) for name in sorted(columns)])
    return F.to_json(fields, {"ignoreNullFields": "false"})


def sha256_json(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def read_events(legacy: DataFrame, per_event: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """Both ledgers as one, and the ids that occur more than once."""
    merged = legacy.unionByName(per_event, allowMissingColumns=True)
    repeated = merged.groupBy(ident).agg(F.count(F.lit(1)).alias("copies")).filter(
        (F.col("copies") > 1) | F.col(ident).isNull()
    )
    return merged, repeated


def append_unique(target: DataFrame, incoming: DataFrame, ident: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append and rejects: an empty id, an id already stored, or a later copy in the batch.

    The first copy inside the batch comes from a partial aggregation, so a batch
    full of one id does not meet in one sort.
    """
    present = F.col(ident).isNotNull() & (F.trim(F.col(ident).cast("string")) != "")
    first = incoming.filter(present).groupBy(ident).agg(F.min(seq).alias("__first"))
    stored = target.select(ident).distinct().withColumn("__stored", F.lit(True))
    judged = incoming.join(first, ident, "left").join(stored, ident, "left")
    reason = (
        F.when(~F.coalesce(present, F.lit(False)), "missing_id")
        .when(F.col("__stored"), "already_stored")
        .when(F.col(seq) > F.col("__first"), "repeated_in_batch")
    )
    judged = judged.withColumn("reason", reason).drop("__first", "__stored")
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")
