"""Stream, image and scorer queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.functions import text as TX
from evalloom.operators import geometry as G
from evalloom.plans.q_archive import POLICY
from evalloom.operators import archive as A
from evalloom.plans.q_ledger import _STREAK_SQL, bucket
from evalloom.registry import query
from evalloom.sources import images as I
from evalloom.streaming import archive as SA
from evalloom.streaming import ledger as SL
from evalloom.streaming import ordered as SO


class _Streamed:
    """Stands in for the session inside a view: its reads become streaming reads."""

    def __init__(self, spark):
        self._spark = spark
        self.read = self

    def parquet(self, path: str) -> DataFrame:
        return SL.file_stream(self._spark, path, self._spark.read.parquet(path))


def ledger_stream(spark, d):
    return v.v_ledger(_Streamed(spark), d)


@query(
    "stream_latest_status",
    views=("v_ledger",),
    sql="SELECT sample_key, arg_max(status, seq) AS status FROM v_ledger GROUP BY 1",
)
def stream_latest_status(spark, d):
    updates = SL.drain(SL.latest_status(ledger_stream(spark, d)), "update", name="status")
    return SL.latest(updates, ["sample_key"])


@query("stream_unique_events", views=("v_ledger",), sql="SELECT DISTINCT attempt_id FROM v_ledger")
def stream_unique_events(spark, d):
    events = ledger_stream(spark, d).select("attempt_id")
    return SL.drain(SL.unique_events(events, "attempt_id"), "append", name="unique").select("attempt_id")


@query(
    "stream_open_attempts",
    views=("v_ledger",),
    sql="""SELECT attempt_id, max(seq) AS last_seq FROM v_ledger GROUP BY 1 HAVING bool_or(status = 'attempt_started')
        AND NOT bool_or(status IN ('scored', 'unparseable', 'refused'))""",
)
def stream_open_attempts(spark, d):
    updates = SL.drain(SL.open_attempts(ledger_stream(spark, d), "attempt_id"), "update", name="open")
    return SL.latest(updates, ["attempt_id"]).filter("open").select("attempt_id", "last_seq")


@query(
    "stream_circuit_breaker",
    views=("v_ledger",),
    sql=_STREAK_SQL
    + """, u AS (SELECT *, sum(CAST(round(cost * 1000000) AS BIGINT)) OVER (PARTITION BY sample_key ORDER BY seq) AS used FROM s),
    b AS (SELECT sample_key, min(event_id) AS stopped_at FROM u WHERE streak >= 6 OR used >= 2500000000 GROUP BY 1)
    SELECT b.sample_key, stopped_at, CASE WHEN streak >= 6 THEN 'streak' ELSE 'cost' END AS cause FROM b JOIN u
        ON u.event_id = b.stopped_at""",
)
def stream_circuit_breaker(spark, d):
    events = ledger_stream(spark, d).withColumn("miss", F.col("status") != "scored")
    return SL.break_arrivals(
        events, "sample_key", seq="event_id", bucket=bucket(), miss="miss", cost="cost", max_streak=6, max_cost=2500.0
    )


@query("stream_archive", views=())
def stream_archive(spark, d):
    from evalloom.plans.q_archive import fold_input

    arriving = fold_input(_Streamed(spark), d)
    closing = SO.Closing(spark, arriving, "episode")
    return SL.drain(SA.stream_archive(closing.after(arriving), POLICY, lateness=10_000), "append", name="archive", closing=closing).drop("batch")


def rasters(spark, d):
    """An 8x8 black and white picture per embedding, built inside the JVM."""
    hexed = F.array_join(F.transform("impact", lambda x: F.when(x > 0, "000000").otherwise("FFFFFF")), "")
    return v.v_grid(spark, d).select(
        "scene",
        "candidate",
        F.struct(
            F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), F.unhex(hexed).alias("data")
        ).alias("image"),
    )


@query(
    "palette_label",
    views=("v_grid",),
    sql="""SELECT scene, CAST(label AS INTEGER) AS label, CAST(CASE label WHEN 0 THEN sum(impact) WHEN 1 THEN 64 - sum(impact) ELSE 0 END AS BIGINT)
        AS pixels FROM v_grid, (VALUES (0), (1), (2)) t(label) GROUP BY scene, label""",
)
def palette_label(spark, d):
    return I.palette_label(rasters(spark, d), "scene", [(10, 10, 10), (250, 250, 250), (128, 0, 0)])


# dark pixels and colours are 0 or 1 here; pixels near one side weigh one for each side
_PICTURE = """px AS (SELECT scene, candidate, x, y, impact > 0 AS dark,
        CAST(x < 3 AS INT) + CAST(x >= 5 AS INT) + CAST(y < 3 AS INT) + CAST(y >= 5 AS INT) AS w FROM v_grid),
    sides AS (SELECT scene, sum(w) FILTER (dark) AS dark_w, sum(w) AS all_w FROM px GROUP BY scene),
    paint AS (SELECT scene, CASE WHEN 2 * coalesce(dark_w, 0) > all_w THEN 0 WHEN 2 * coalesce(dark_w, 0) = all_w THEN 127 ELSE 255 END AS colour FROM sides),
    share AS (SELECT scene, avg(CAST(abs(CASE WHEN dark THEN 0 ELSE 255 END - colour) * sqrt(3) > 24 AS DOUBLE)) AS foreground,
        avg(CAST(dark AS DOUBLE)) AS p FROM px JOIN paint USING (scene) GROUP BY scene),
    edge AS (SELECT a.scene, avg(CAST(a.dark <> b.dark AS DOUBLE)) AS edges FROM px a JOIN px b ON a.scene = b.scene
        AND ((a.x = b.x AND a.y + 1 = b.y) OR (a.y = b.y AND a.x + 1 = b.x)) GROUP BY a.scene),
    prof AS (SELECT scene, foreground, edges, CASE WHEN p IN (0, 1) THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) / 9 END AS entropy FROM share JOIN edge USING (scene))"""


@query("image_profile", views=("v_grid",), sql=f"WITH {_PICTURE} SELECT scene, foreground, edges, entropy FROM prof")
def image_profile(spark, d):
    return I.image_profile(rasters(spark, d), "scene")


def dark_scorer(pixels) -> str:
    """Toy scorer: present when the picture holds at least four dark pixels; fails on a blank one."""
    dark = int((pixels.mean(axis=2) < 128).sum())
    if dark == 0:
        raise ValueError("nothing to see")
    return "present" if dark >= 4 else "absent"


@query(
    "image_decision",
    views=("v_grid",),
    sql="""SELECT scene, CASE WHEN sum(impact) >= 4 THEN 'present' WHEN sum(impact) > 0 THEN 'absent' END AS decision,
        CASE WHEN sum(impact) = 0 THEN 'nothing to see' END AS failure FROM v_grid GROUP BY scene""",
)
def image_decision(spark, d):
    return I.image_decision(rasters(spark, d), "scene", dark_scorer)


# a block of one cell, a quarter wider on all sides and rounded up, reaches one cell around it
@query(
    "ablation_impact",
    views=("v_grid",),
    sql=f"""WITH {_PICTURE}, base AS (SELECT scene, sum(CAST(dark AS INT)) AS n FROM px GROUP BY scene),
    blocks AS (SELECT b.scene, b.y * 8 + b.x AS spot, sum(CAST(CASE WHEN abs(p.x - b.x) <= 1 AND abs(p.y - b.y) <= 1 THEN colour < 128 ELSE p.dark END AS INT)) AS n
        FROM px b JOIN px p ON p.scene = b.scene JOIN paint c ON c.scene = b.scene GROUP BY b.scene, b.x, b.y),
    hits AS (SELECT k.scene, list(CAST(base.n > 0 AND k.n > 0 AND (k.n >= 4) <> (base.n >= 4) AS DOUBLE) ORDER BY spot) AS impact,
        list(CAST(base.n = 0 OR k.n = 0 AS DOUBLE) ORDER BY spot) AS error FROM blocks k JOIN base ON base.scene = k.scene GROUP BY k.scene)
    SELECT scene, CASE WHEN n >= 4 THEN 'present' WHEN n > 0 THEN 'absent' END AS decision, CASE WHEN n = 0 THEN 'nothing to see' END AS failure,
        impact, error, foreground, edges, entropy FROM base JOIN hits USING (scene) JOIN prof USING (scene)""",
)
def ablation_impact(spark, d):
    return I.ablation_impact(rasters(spark, d), "scene", dark_scorer, grid=8, overlap=4)


@query("attest_from_images", views=())
def attest_from_images(spark, d):
    grids = I.ablation_impact(rasters(spark, d), "scene", dark_scorer, grid=8, overlap=4)
    labelled = grids.join(v.v_grid(spark, d).select("scene", "candidate"), "scene")
    return G.attest(labelled, "candidate")


@query(
    "run_scorer",
    views=("v_examples",),
    sql="""SELECT doc_id, 'scored' AS status, 'yes' AS prediction, 0.5::DOUBLE AS confidence, answer = 'yes' AS correct FROM v_examples""",
)
def run_scorer(spark, d):
    plan = v.v_examples(spark, d).select("doc_id", F.lit("Is it good?").alias("question"), "candidates", "answer")
    responses = I.run_scorer(plan, I.first_choice, "doc_id").join(plan, "doc_id")
    ready = responses.withColumn("refusal", F.lit(None).cast("string"))
    return TX.score_responses(ready, gold="answer").select("doc_id", "status", "prediction", "confidence", "correct")
