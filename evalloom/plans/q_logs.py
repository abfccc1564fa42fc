"""Run log queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import views as v
from evalloom.operators import logs as G
from evalloom.registry import query


def day_bucket():
    """A day of events per ordered bucket."""
    return F.expr("us div 86400000000")


def turn_bucket():
    return F.expr("sequence div 100000")


def _broken_turns(spark, d):
    """Turns with one position removed where the text is long and one doubled where it is short."""
    turns = v.v_turns(spark, d)
    n = F.length("text")
    shifted = F.when(n % 11 == 0, F.col("sequence") + 1).otherwise(F.col("sequence"))
    return turns.withColumn("sequence", shifted)


_BROKEN_SQL = """b AS (SELECT * REPLACE (CASE WHEN length(text) % 11 = 0 THEN sequence + 1 ELSE sequence END AS sequence) FROM v_turns)"""


@query(
    "check_sequence",
    views=("v_turns",),
    sql=f"""WITH {_BROKEN_SQL} SELECT run, count(*) AS events, count(DISTINCT sequence) AS positions, min(sequence) AS first,
        max(sequence) AS last, min(sequence) = 1 AND count(DISTINCT sequence) = count(*) AND max(sequence) = count(*) AS contiguous
        FROM b GROUP BY run""",
)
def check_sequence(spark, d):
    return G.check_sequence(_broken_turns(spark, d), "run", "sequence")


@query(
    "sequence_gaps",
    views=("v_turns",),
    sql=f"""WITH {_BROKEN_SQL} SELECT run, sequence, kind FROM b WHERE sequence <> 1 AND NOT EXISTS
        (SELECT 1 FROM b p WHERE p.run = b.run AND p.sequence = b.sequence - 1)""",
)
def sequence_gaps(spark, d):
    return G.sequence_gaps(_broken_turns(spark, d), "run", "sequence").select("run", "sequence", "kind")


@query(
    "check_monotone_clock",
    views=("v_events",),
    sql="""WITH c AS (SELECT user_id, event_id, us - (k % 7) * 3600000000 AS clock FROM v_events),
    h AS (SELECT *, max(clock) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        AS highest FROM c) SELECT * FROM h WHERE clock < highest""",
)
def check_monotone_clock(spark, d):
    events = v.v_events(spark, d).select(
        "user_id", "event_id", (F.col("us") - (F.col("k") % 7) * 3600000000).alias("clock")
    )
    return G.check_monotone_clock(events, ["user_id"], "event_id", "clock", F.expr("event_id div 1000000"))


_ALLOWED = [("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("view", "signup"), ("signup", "view"), ("error", "view")]


@query(
    "check_transitions",
    views=("v_events",),
    sql=f"""WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)
        AS prev_event_type FROM v_events)
    SELECT user_id, event_id, event_type, prev_event_type, CASE WHEN prev_event_type IS NULL THEN 'bad_start'
        WHEN prev_event_type = 'purchase' THEN 'after_terminal' ELSE 'bad_transition' END AS rule FROM p
    WHERE (prev_event_type IS NULL AND event_type <> 'view') OR prev_event_type = 'purchase'
        OR (prev_event_type IS NOT NULL AND (prev_event_type, event_type) NOT IN ({", ".join(str(x) for x in _ALLOWED)}))""",
)
def check_transitions(spark, d):
    events = v.v_events(spark, d).select("user_id", "event_id", "event_type")
    return G.check_transitions(
        events, ["user_id"], "event_id", "event_type", F.expr("event_id div 1000000"),
        start="view", allowed=_ALLOWED, terminal=["purchase"],
    )


@query(
    "pair_start_finish",
    views=("v_turns",),
    sql="""SELECT f.run, f.attempt, f.sequence AS finished, (SELECT max(s.sequence) FROM v_turns s WHERE s.run = f.run
        AND s.attempt = f.attempt AND s.kind = 'public_gate_started') AS started, outcome FROM v_turns f
        WHERE kind = 'public_gate_finished'""",
)
def pair_start_finish(spark, d):
    return G.pair_start_finish(
        v.v_turns(spark, d), ["run", "attempt"], "sequence", "kind", "public_gate_started", "public_gate_finished"
    )


@query(
    "first_last_milestones",
    views=("v_turns",),
    sql="""SELECT run, min(sequence) FILTER (kind = 'candidate_staged') AS first_staging,
        max(sequence) FILTER (kind = 'public_gate_finished') AS last_finish,
        arg_max(outcome, sequence) FILTER (kind = 'public_gate_finished') AS last_outcome,
        count(*) FILTER (kind = 'public_gate_started') AS starts,
        count(*) FILTER (kind = 'public_gate_finished' AND outcome = 'failed') AS repairs FROM v_turns GROUP BY run""",
)
def first_last_milestones(spark, d):
    return G.milestones(v.v_turns(spark, d), "run", "sequence")


@query(
    "selected_after_ranking",
    views=("v_events",),
    sql="""SELECT event_id, user_id, us FROM v_events s WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM v_events r
        WHERE r.event_type = 'view' AND r.user_id = s.user_id AND r.us <= s.us)""",
)
def selected_after_ranking(spark, d):
    events = v.v_events(spark, d).select("event_id", "user_id", "us", "event_type")
    return G.selected_without_pass(
        events.filter("event_type = 'purchase'").drop("event_type"), events.filter("event_type = 'view'"), "user_id", "us"
    )


@query(
    "as_of_ranking",
    views=("v_events",),
    sql="""SELECT s.event_id, s.user_id, s.us, r.us AS as_of, r.k FROM v_events s ASOF LEFT JOIN
        (SELECT user_id, us, k FROM v_events WHERE event_type = 'view') r ON s.user_id = r.user_id AND s.us >= r.us
        WHERE s.event_type = 'purchase'""",
)
def as_of_ranking(spark, d):
    events = v.v_events(spark, d)
    return G.as_of(
        events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'"), ["user_id"], "us", "k", day_bucket()
    )


_INTERVAL_SQL = """i AS (SELECT user_id, min(us) AS started, CASE WHEN arg_max(event_type, event_id) IN ('purchase', 'error')
    THEN max(us) END AS ended FROM v_events GROUP BY 1),
    p AS (SELECT DISTINCT (us // {w}) * {w} AS probe FROM v_events)"""


def _intervals(spark, d, width):
    events = v.v_events(spark, d)
    ended = F.when(F.max_by("event_type", "event_id").isin("purchase", "error"), F.max("us"))
    intervals = events.groupBy("user_id").agg(F.min("us").alias("started"), ended.alias("ended"))
    probes = events.select((F.expr(f"us div {width}") * width).alias("probe")).distinct()
    return intervals, probes


@query(
    "active_counts",
    views=("v_events",),
    sql=f"""WITH {_INTERVAL_SQL.format(w=3600000000)} SELECT probe, count(user_id) AS active FROM p LEFT JOIN i
        ON started <= probe AND (ended IS NULL OR ended > probe) GROUP BY probe""",
)
def active_counts(spark, d):
    intervals, probes = _intervals(spark, d, 3600000000)
    return G.active_counts(intervals, probes, "started", "ended", "probe", F.expr("probe div 86400000000"))


@query(
    "active_at",
    views=("v_events",),
    sql=f"""WITH {_INTERVAL_SQL.format(w=86400000000)} SELECT probe, user_id FROM p JOIN i
        ON started <= probe AND (ended IS NULL OR ended > probe)""",
)
def active_at(spark, d):
    day = 86400000000
    intervals, probes = _intervals(spark, d, day)
    horizon = v.v_events(spark, d).agg(F.max("us")).first()[0] or 0
    return G.active_ids(intervals, probes, "user_id", "started", "ended", "probe", day, int(horizon))


@query(
    "phase_seconds",
    views=("v_events",),
    sql="""WITH p AS (SELECT user_id, us // 86400000000 AS day, min(us) FILTER (event_type = 'view') AS s,
        max(us) FILTER (event_type = 'purchase') AS f FROM v_events GROUP BY ALL)
    SELECT user_id, day, round(greatest(0, f - s) / 1e6, 6) AS seconds FROM p WHERE s IS NOT NULL AND f IS NOT NULL
    UNION ALL SELECT user_id, day, NULL FROM p WHERE s IS NULL OR f IS NULL""",
)
def phase_seconds(spark, d):
    at = lambda kind, fn: fn(F.when(F.col("event_type") == kind, F.col("us")))
    phases = (
        v.v_events(spark, d)
        .groupBy("user_id", F.expr("us div 86400000000").alias("day"))
        .agg(at("view", F.min).alias("started"), at("purchase", F.max).alias("finished"))
    )
    seconds = F.when(
        F.col("started").isNotNull() & F.col("finished").isNotNull(),
        G.phase_seconds(F.col("started"), F.col("finished")),
    )
    return phases.select("user_id", "day", seconds.alias("seconds"))


@query(
    "survivor_shrink",
    views=("v_turns",),
    sql="""WITH s AS (SELECT run, sequence, list_distinct(regexp_extract_all(lower(text), '[a-z]{2}')) AS sv FROM v_turns),
    p AS (SELECT *, lag(sv) OVER (PARTITION BY run ORDER BY sequence) AS pv FROM s)
    SELECT run, sequence, CAST(len(list_filter(sv, lambda x: NOT list_contains(pv, x))) AS INTEGER) AS reintroduced FROM p
    WHERE pv IS NOT NULL AND len(list_filter(sv, lambda x: NOT list_contains(pv, x))) > 0""",
)
def survivor_shrink(spark, d):
    survivors = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2})"), F.lit(1)))
    passes = v.v_turns(spark, d).select("run", "sequence", survivors.alias("survivors"))
    return G.survivor_shrink(passes, "run", "sequence", "survivors", turn_bucket())


@query(
    "run_segments",
    views=("v_events",),
    sql="""WITH f AS (SELECT user_id, event_id, value > 40 AS on_ FROM v_events),
    g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id)
        - row_number() OVER (PARTITION BY user_id, on_ ORDER BY event_id) AS grp FROM f)
    SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS width FROM g WHERE on_
    GROUP BY user_id, grp HAVING count(*) >= 3""",
)
def run_segments(spark, d):
    events = v.v_events(spark, d).select("user_id", "event_id", "value")
    runs = G.run_segments(events, ["user_id"], ["event_id"], F.col("value") > 40, F.expr("event_id div 1000000"), 3)
    return runs.select("user_id", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), "width")


@query(
    "run_gaps",
    views=("v_events",),
    sql="""WITH f AS (SELECT user_id, value > 40 AS on_, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM v_events),
    g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, on_ ORDER BY pos) AS grp FROM f),
    r AS (SELECT user_id, min(pos) AS start, max(pos) + 1 AS stop, count(*) AS width FROM g WHERE on_ GROUP BY user_id, grp HAVING count(*) >= 3)
    SELECT *, start - lag(stop) OVER (PARTITION BY user_id ORDER BY start) AS gap FROM r""",
)
def run_gaps(spark, d):
    events = v.v_events(spark, d).select("user_id", "event_id", "value")
    return G.run_gaps(events, ["user_id"], ["event_id"], F.col("value") > 40, F.expr("event_id div 1000000"), 3)
