"""Sampling queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.operators import sampling as S
from evalloom.registry import query

SEED = 20260


@query(
    "sample_uniform",
    views=("v_examples",),
    sql=f"SELECT doc_id, dataset_id FROM v_examples ORDER BY sha256('{SEED}' || chr(0) || sample_key) LIMIT 100",
)
def sample_uniform(spark, d):
    return S.uniform(v.v_examples(spark, d).select("doc_id", "dataset_id", "sample_key"), 100, SEED, "sample_key").select(
        "doc_id", "dataset_id"
    )


@query(
    "sample_balanced",
    views=("v_examples",),
    sql=f"""SELECT doc_id, dataset_id, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id
        ORDER BY sha256('{SEED}' || chr(0) || sample_key)) AS turn FROM v_examples)
        ORDER BY turn, sha256('{SEED}' || chr(0) || dataset_id) LIMIT 110""",
)
def sample_balanced(spark, d):
    examples = v.v_examples(spark, d).select("doc_id", "dataset_id", "sample_key")
    return S.balanced(examples, 110, SEED, "dataset_id", "sample_key").select("doc_id", "dataset_id", "turn")


@query(
    "one_per_image",
    views=("v_examples",),
    sql=f"""SELECT image_path, arg_min(doc_id, sha256('{SEED}' || chr(0) || sample_key)) AS doc_id
        FROM v_examples GROUP BY image_path""",
)
def one_per_image(spark, d):
    examples = v.v_examples(spark, d).select("doc_id", "image_path", "sample_key")
    return S.one_per_image(examples, SEED, "image_path", "sample_key").select("image_path", "doc_id")


@query(
    "even_cover",
    views=("v_examples",),
    sql="""WITH i AS (SELECT dataset_id, image_path, row_number() OVER (PARTITION BY dataset_id ORDER BY image_path) - 1 AS slot,
        count(*) OVER (PARTITION BY dataset_id) AS n_images FROM (SELECT DISTINCT dataset_id, image_path FROM v_examples))
    SELECT DISTINCT i.* FROM i, range(6) t(j) WHERE n_images >= 4
        AND slot = CASE WHEN n_images <= 6 THEN j ELSE j * (n_images - 1) // 5 END""",
)
def even_cover(spark, d):
    return S.even_cover(v.v_examples(spark, d), "dataset_id", "image_path", F.substring("image_path", 1, 5))


@query(
    "blind_ids",
    views=(),
    sql="""WITH r AS (SELECT doc_id, sha256(text) AS sha, row_number() OVER (ORDER BY sha256(text), doc_id) AS n FROM documents)
    SELECT 'candidate_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS blind_id,
        doc_id, sha FROM r""",
)
def blind_ids(spark, d):
    docs = v.v_docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"))
    return S.blind_ids(docs, "sha", "doc_id")
