"""Opposing neighbours in a live stream: a zone's observation waits for those of its neighbours at the same time.

Every observation is sent to its own zone and to the zones that declare it as a neighbour. A zone releases its rows in time order:
once all declared neighbours of the scene have one of the same time, or once the watermark has passed that time (an
event-time timer), when the latest one of a missing neighbour before it counts. So the result doesn't depend on how a frame's zones are
spread over batches. State per zone: the waiting rows, and of each neighbour the rows not older than the oldest waiting one, and one before.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Rows of a zone that are not newer than its last released one
are late and left out; of two rows of one zone and time the first counts. Rows without a zone or time are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Scene
from .assess import OBSERVATION

MET = f"{OBSERVATION}, convergence double, against string"
_ROW = "ordinal int, frame long, density double, count double, speed double, heading double, variance double"
_FIELDS = [c.split()[0] for c in _ROW.split(", ")]


def opposed(own: tuple, others: list[tuple[str, tuple]], crowded: float) -> tuple[float, str | None]:
    """(score, neighbour) of the strongest opposing one, the first declared among equals (to nine places); rows are (density, speed, heading)."""
    best, against = 0.0, None
    density, speed, heading = own
    for name, (nd, nv, nh) in others:
        if heading is None or nh is None or speed < 0.1 or nv < 0.1:
            continue
        score = round(max(0.0, -math.cos(math.radians(heading - nh))) * min(1.0, min(density, nd) / max(crowded, 1e-6)), 9)
        if score > best:
            best, against = score, name
    return best, against


class Meeting(StatefulProcessor):
    def __init__(self, neighbours: dict[str, tuple[str, ...]], known: frozenset[str], crowded: float):
        self._neighbours, self._known, self._crowded = neighbours, known, crowded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "t double", _ROW)
        self._seen = handle.getMapState("seen", "neighbour string, t double", "density double, speed double, heading double")
        self._released = handle.getValueState("released", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        zone = key[0]
        last = self._released.get()[0] if self._released.exists() else -math.inf
        for batch in rows:
            for r in batch.itertuples(index=False):
                if r.sender == zone:
                    if r.t > last and not self._waiting.containsKey((r.t,)):
                        self._waiting.updateValue((r.t,), tuple(None if pd.isna(v) else v for v in (getattr(r, c) for c in _FIELDS)))
                        self._handle.registerTimer(math.ceil(r.t * 1000))
                elif not self._seen.containsKey((r.sender, r.t)):
                    self._seen.updateValue((r.sender, r.t), tuple(None if pd.isna(v) else v for v in (r.density, r.speed, r.heading)))
        yield self._out(zone, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._out(key[0], expiredTimerInfo.getExpiryTimeInMs() / 1000)

    def _out(self, zone: str, passed: float | None) -> pd.DataFrame:
        """The rows that need not wait any longer, in time order."""
        seen: dict[str, dict[float, tuple]] = {}
        for (name, t), v in self._seen.iterator():
            seen.setdefault(name, {})[t] = tuple(v)
        wanted = self._neighbours.get(zone, ())
        out, last = [], None
        for (t,), row in sorted(self._waiting.iterator(), key=lambda x: x[0][0]):
            whole = all(t in seen.get(n, ()) for n in wanted if n in self._known)
            if not whole and (passed is None or t > passed):
                break
            others = []
            for n in wanted:
                before = max((s for s in seen.get(n, ()) if s <= t), default=None)
                if before is not None:
                    others.append((n, seen[n][before]))
            row = dict(zip(_FIELDS, row, strict=True))
            score, against = opposed((row["density"], row["speed"], row["heading"]), others, self._crowded)
            out.append({"zone_id": zone, "t": t, **row, "convergence": score, "against": against})
            last = t
            self._waiting.removeKey((t,))
            self._handle.deleteTimer(math.ceil(t * 1000))
        if last is not None:
            self._released.update((last,))
            for n, of in seen.items():  # the latest one up to the released time stays
                latest = max((s for s in of if s <= last), default=-math.inf)
                for s in of:
                    if s < latest:
                        self._seen.removeKey((n, s))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MET.split(", ")])

    def close(self) -> None:
        pass


def met(observations: DataFrame, scene: Scene, late_s: float = 10.0) -> DataFrame:
    """The stream of observations with convergence and against. Rows more than `late_s` behind the newest time may be dropped."""
    known = frozenset(z.id for z in scene.zones)
    neighbours = {z.id: z.neighbors for z in scene.zones}
    to = {z: tuple({z} | {n for n, own in neighbours.items() if z in own}) for z in known}
    sent = F.create_map(*[F.lit(x) for z, own in to.items() for x in (F.lit(z), F.array(*map(F.lit, sorted(own))))])
    own = observations.where("zone_id is not null and t is not null").withColumn("at", F.timestamp_millis((F.col("t") * 1000).cast("long"))).withWatermark("at", f"{late_s} seconds")
    rows = own.withColumn("sender", F.col("zone_id")).withColumn("zone_id", F.explode(F.coalesce(sent[F.col("sender")], F.array("sender"))))
    return rows.groupBy("zone_id").transformWithStateInPandas(Meeting(neighbours, known, scene.thresholds.band_crowded), MET, "append", "eventTime")
