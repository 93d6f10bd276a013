"""The alert machine of a zone: dwell, escalation, resolution, hold; and the views over its event log.

`advance` is one step for one zone; the batch fold and the streaming processor both call it. The fold reads the
samples between two points of rest in time order from a sorted partition and keeps the machine's state only, so its memory doesn't grow
with a zone's history, and a long history is work for many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Thresholds
from ..sources.stored import Steps
from . import prefix

#: Seconds of a block in which points of rest are looked for, and in which alerts are numbered.
BLOCK_S = 3600.0
RANK = {"green": 0, "amber": 1, "red": 2}
# The titles of the messages.
TITLES = {"density": "High density", "density_trend": "Density rising", "flow_breakdown": "Movement breaking down", "convergence": "Opposing flows meeting", "pressure": "Turbulent movement"}
EVENTS = "zone_id string, t double, kind string, severity string, headline string, ttc double, detail string, first_seen double, escalations int, episode int"


@dataclass
class Machine:
    """State of one zone: a pending start, the live severity, the first clear sample, the last resolution."""

    pending: float | None = None
    severity: int | None = None
    clear: float | None = None
    resolved: float | None = None
    first_seen: float | None = None
    escalations: int = 0
    episode: int = 0


def advance(m: Machine, t: float, level: int, th: Thresholds) -> str | None:
    """One sample; returns fired, escalated, resolved or None."""
    if level == 0:
        m.pending = None
        if m.severity is None:
            return None
        if m.clear is None:
            m.clear = t
        elif t - m.clear >= th.resolve_s:
            m.severity, m.clear, m.resolved = None, None, t
            return "resolved"
        return None
    m.clear = None
    if m.severity is not None:
        if level <= m.severity:
            m.pending = None
        elif m.pending is None:
            m.pending = t
        elif t - m.pending >= th.dwell_s * 0.4:
            m.severity, m.pending, m.escalations = level, None, m.escalations + 1
            return "escalated"
        return None
    if m.pending is None:
        m.pending = t
    held_back = m.resolved is not None and t - m.resolved < th.reassert_gap_s and level < 2
    if t - m.pending < th.dwell_s or held_back or t == m.pending:
        return None
    m.severity, m.first_seen, m.pending, m.escalations, m.episode = level, m.pending, None, 0, m.episode + 1
    return "fired"


def folded(th: Thresholds):
    """A function over batches of (zone_id, segment, t, risk, headline, ttc, detail), sorted by zone, segment and time. Episodes are numbered in a segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, m, severity = None, Machine(), "green"
        for batch in batches:
            out = []
            for z, s, t, risk, headline, ttc, detail in batch[["zone_id", "segment", "t", "risk", "headline", "ttc", "detail"]].itertuples(index=False):
                if (z, s) != own:
                    own, m = (z, s), Machine()
                kind = advance(m, t, RANK[risk], th)
                if kind:
                    severity = severity if kind == "resolved" else risk
                    out.append((z, t, kind, severity, headline, ttc, detail, m.first_seen, m.escalations, m.episode, s))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in f"{EVENTS}, segment long".split(", ")])

    return run


def segments(samples: DataFrame, th: Thresholds, block_s: float | None = None) -> DataFrame:
    """Adds segment: a number that grows along a zone's time wherever its machine is provably at rest.

    At a sample that isn't green the machine is as new if the green samples just before it held one resolve_s or more after the
    first of them, and that one lies reassert_gap_s or more back: whatever was live is resolved by then and holds nothing back. A block of
    time sees its own samples and those a bounded time before it, which may hide such a point but never make one up. So
    a zone's history falls into parts that can be folded apart; one that never rests stays in one part.
    """
    back = 2 * (th.resolve_s + th.reassert_gap_s) + 60.0
    size = max(block_s or BLOCK_S, back)
    d = prefix.spread(samples, F.floor(F.col("t") / size), F.floor((F.col("t") + back) / size))
    order = Window.partitionBy("zone_id", "block").orderBy("t")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    loud = F.col("risk") != "green"
    # the first green sample after the last loud one, of those seen here
    start = F.coalesce(F.last(F.when(loud, F.col("_next")), ignorenulls=True).over(earlier), F.first("t").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_next", F.lead("t").over(order)).withColumn("_start", start)
    run = Window.partitionBy("zone_id", "block", "_start").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    over = F.min(F.when(~loud & (F.col("t") - F.col("_start") >= th.resolve_s), F.col("t"))).over(run)
    d = d.withColumn("_over", over).where("not halo").withColumn("_cut", (loud & F.coalesce(F.col("t") - F.col("_over") >= th.reassert_gap_s, F.lit(False))).cast("int"))
    return prefix.running(d.drop("_next", "_start", "_over", "block", "halo"), F.floor(F.col("t") / size), ("t",), {"segment": F.col("_cut")}, ("zone_id",)).drop("_cut")


def events(assessed: DataFrame, th: Thresholds, block_s: float | None = None) -> DataFrame:
    """The event log: one row for each fired, escalated or resolved alert.

    Zones are folded in the segments between their points of rest, each by one machine; a zone's episodes are numbered
    through by the counts of its earlier segments.
    """
    steps = Steps(assessed.sparkSession)
    own = segments(steps.keep("samples", assessed.select("zone_id", "t", "risk", "headline", "ttc", "detail")), th, block_s)
    log = steps.keep("log", own.repartition("zone_id", "segment").sortWithinPartitions("zone_id", "segment", "t").mapInPandas(folded(th), f"{EVENTS}, segment long"))
    steps.drop("samples")
    fired = {"_n": (F.col("kind") == "fired").cast("int")}
    return prefix.running(log, F.floor(F.col("t") / (block_s or BLOCK_S)), ("t",), fired, ("zone_id",)).withColumn("episode", F.col("_n").cast("int")).drop("_n", "segment")


def numbered(log: DataFrame, zones: tuple[str, ...] = (), start_seq: int = 0) -> DataFrame:
    """Adds seq and alert_id: fired alerts are numbered by time, those of one time in the order of the scene's zones; their later events carry the same number.

    Zones that are not in the scene's list come after it, by name.
    """
    place = F.nullif(F.array_position(F.array(*map(F.lit, zones)), F.col("zone_id")), F.lit(0)) if zones else F.lit(None).cast("long")
    fired = log.where("kind = 'fired'").select("zone_id", "episode", "t", F.coalesce(place, F.lit(len(zones) + 1)).alias("_place"))
    fired = prefix.numbered(fired, F.floor(F.col("t") / BLOCK_S), ("t", "_place", "zone_id"), "_k").select("zone_id", "episode", "_k")
    return log.join(fired, ["zone_id", "episode"]).withColumn("seq", (F.col("_k") + 1 + start_seq).cast("long")).withColumn("alert_id", F.concat(F.lit("a"), F.col("seq"))).drop("_k")


def message(headline: Column, ttc: Column, detail: Column) -> Column:
    """Title with the time to critical for a trend, with the signal's detail otherwise."""
    ttc = F.round(ttc, 1)
    head = F.coalesce(F.nullif(headline, F.lit("")), F.lit("density"))
    title = F.coalesce(F.create_map(*[F.lit(v) for kv in TITLES.items() for v in kv])[head], head)
    lead = F.when(ttc >= 60, F.concat(F.bround(ttc / 60).cast("long"), F.lit(" min"))).otherwise(F.concat(F.bround(ttc).cast("long"), F.lit(" s")))
    return F.when((head == "density_trend") & ttc.isNotNull(), F.concat(title, F.lit(" - "), lead, F.lit(" to critical"))).when(F.coalesce(detail, F.lit("")) != "", F.concat(title, F.lit(" - "), detail)).otherwise(title)


def current(log: DataFrame) -> DataFrame:
    """One row per alert: the first values of zone, seq and first_seen, the last of everything that changes.

    Resolution keeps the time of the last change in `ts`.
    """
    changed = F.when(F.col("kind") != "resolved", F.col("t"))
    last = lambda c: F.max_by(c, changed)
    return log.groupBy("alert_id", "seq", "zone_id").agg(
        F.min("first_seen").alias("first_seen"), last("severity").alias("severity"), last("headline").alias("metric"), last(message(F.col("headline"), F.col("ttc"), F.col("detail"))).alias("message"),
        F.max(changed).alias("ts"), F.max("escalations").alias("escalations"), F.max(F.when(F.col("kind") == "resolved", F.col("t"))).alias("resolved_at"),
    ).withColumn("state", F.when(F.col("resolved_at").isNull(), "active").otherwise("resolved"))


def announced(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first event of every alert and severity that isn't resolved and not among the (alert_id, severity) known already."""
    new = log.where("kind <> 'resolved'").groupBy("alert_id", "zone_id", "severity").agg(F.min("t").alias("t"))
    return new if known is None else new.join(known, ["alert_id", "severity"], "left_anti")


def rank(severity: Column) -> Column:
    return F.when(severity == "red", 2).when(severity == "amber", 1).otherwise(0)


def live(alerts: DataFrame) -> DataFrame:
    """Active alerts, most severe first, then the most recent."""
    return alerts.where("state = 'active'").orderBy(rank(F.col("severity")).desc(), F.col("ts").desc(), "seq")


def feed(alerts: DataFrame, n: int = 20) -> DataFrame:
    """Active ones first, then the most recent; the first n."""
    return alerts.orderBy((F.col("state") == "active").desc(), F.col("ts").desc(), F.col("seq").desc()).limit(n)


def recent(alerts: DataFrame, n: int) -> DataFrame:
    return alerts.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(max(1, min(500, n)))
