"""Structured Streaming form of the alert machine: keyed state, one machine per zone, restored from the checkpoint.

Samples of a zone arrive in time order from batch to batch; inside a batch they are sorted, and a sample that is not
newer than the zone's last one is late and dropped. Event time drives the machine, so a replay gives the same log.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Thresholds
from ..operators.alerts import EVENTS, RANK, Machine, advance

STATE = "pending double, severity int, clear double, resolved double, first_seen double, escalations int, episode int, last double, shown string"


def events(assessed: DataFrame, th: Thresholds) -> DataFrame:
    """The alert event log of a stream with the columns zone_id, t, risk, headline, ttc, detail."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *own, last, severity = state.get if state.exists else (*astuple(Machine()), None, "green")
        m, out = Machine(*own), []
        for batch in [pd.concat(list(batches))]:
            for t, risk, headline, ttc, detail in batch.sort_values("t")[["t", "risk", "headline", "ttc", "detail"]].itertuples(index=False):
                if last is not None and t <= last:
                    continue
                last, kind = t, advance(m, t, RANK[risk], th)
                if kind:
                    severity = severity if kind == "resolved" else risk
                    out.append((key[0], t, kind, severity, headline, ttc, detail, m.first_seen, m.escalations, m.episode))
        state.update((*astuple(m), last, severity))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    own = assessed.select("zone_id", "t", "risk", "headline", "ttc", "detail")
    return own.groupBy("zone_id").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
