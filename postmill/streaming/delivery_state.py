"""Delivery state machine over a stream of pass outcomes, keyed by job.

Input rows: (job_url, pass_no, labels, delivered array<bigint>). State per
job: status, attempts, stored ids, last pass. A pass not newer than the last
changes nothing, so replays and late passes are harmless. Pass 0 is a first delivery (its ids
replace the stored ones, never abandons); later passes are retries.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postmill.operators.delivery import ABANDONED, DONE, MAX_ATTEMPTS, PENDING

OUTPUT = "job_url string, pass_no int, status int, attempts int, ids string"
STATE = "status int, attempts int, ids string, last_pass int"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts, stored, last = state.get if state.exists else (PENDING, 0, "", -1)
    ids = [i for i in stored.split(",") if i]
    # Only the first report of each new pass is held; replays are let go at once.
    passes: dict[int, tuple[int, list[str]]] = {}
    for batch in batches:
        for row in batch.itertuples():
            if row.pass_no > last:
                passes.setdefault(row.pass_no, (row.labels, [str(i) for i in row.delivered]))
    out = []
    for pass_no in sorted(passes):
        if status != PENDING:
            break
        labels, new = passes[pass_no]
        ids = (list(dict.fromkeys(ids)) if pass_no > 0 else []) + new
        if len(ids) == labels:
            status = DONE
        else:
            attempts += 1
            if pass_no > 0 and attempts >= MAX_ATTEMPTS:
                status = ABANDONED
        last = pass_no
        out.append((key[0], pass_no, status, attempts, ",".join(ids)))
    state.update((status, attempts, ",".join(ids), last))
    yield pd.DataFrame(out, columns=["job_url", "pass_no", "status", "attempts", "ids"])


def delivery_states(outcomes: DataFrame) -> DataFrame:
    """Every state a job passes through, as a stream."""
    return outcomes.groupBy("job_url").applyInPandasWithState(
        _advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
