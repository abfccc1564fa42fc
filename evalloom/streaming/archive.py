"""The archive as a stream: rules as columns, then one bounded state per campaign, or the whole fold over a table of arrivals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from evalloom.operators.archive import ArchivePolicy, archive_fold, attested_step
from evalloom.streaming.ledger import drain
from evalloom.streaming.ordered import fold_in_order

_OUT = "campaign_id bigint, episode bigint, candidate_id bigint, cell string, reason string, admitted boolean, replaced bigint"


def stream_archive(candidates: DataFrame, policy: ArchivePolicy, *, lateness: int, step=attested_step) -> DataFrame:
    """Decisions per candidate, in episode order, once the newest episode is ``lateness`` ahead.

    Rows carry ``reason`` from the admission rules.  State is the elites the policy
    allows and the candidates that still wait.
    """
    more = [c for c in candidates.columns if c not in ("campaign_id", "episode", "candidate_id")]

    def decide(packed: list, place: int, row: dict) -> list[tuple]:
        elites = [{**e, "vector": np.asarray(e["vector"], dtype=float)} for e in packed]
        decision = (row["reason"], False, None) if row["reason"] is not None else step(policy, elites, row)
        if decision[1]:
            packed[:] = [{**e, "vector": e["vector"].tolist()} for e in elites]
        return [(place, row["candidate_id"], row["cell"], *decision)]

    return fold_in_order(candidates, "campaign_id", "episode", ["candidate_id"], more, _OUT, lateness=lateness, begin=list, step=decide)


def fold_arrivals(candidates: DataFrame, policy: ArchivePolicy, *, step=attested_step, name: str = "archive", **blocks) -> DataFrame:
    """Decisions of the whole fold over all that has arrived, whatever files and micro-batches the rows came in.

    Micro-batches are appended to a table; once the input is drained, the table is
    folded by :func:`archive_fold`, so late rows stand where their episode says and
    a campaign's rows are spread over blocks.
    """
    return archive_fold(drain(candidates, "append", name=name).drop("batch"), policy, step=step, **blocks)[0]
