"""Spending on calls, granted in the order of events by state that outlives micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import collected

#: Reasons of a decision.
GRANTED, PAGE_LIMIT, CLAIM_LIMIT, MEAN_LIMIT, NO_PRICE = "AUTHORIZED", "PAGE_CALL_LIMIT", "CLAIM_COST_LIMIT", "MEAN_COST_LIMIT", "PRICING_NOT_CONFIGURED"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
TEXTS = ("kind", "page", "claim", "tier")
#: Waiting events of one slice of time, column by column; times are in microseconds.
WAITING = "event_id array<long>, ts array<long>, kind array<string>, page array<string>, claim array<string>, tier array<string>, cost array<double>"
#: Microseconds of a slice.
SLICE = 3_600_000_000


@dataclass(frozen=True)
class Limits:
    """Calls of a page by tier, what a claim may cost, what a page may cost on average, and what a call is taken to cost beforehand (None: no prices)."""

    page_calls: dict[str, int]
    claim_cost: float
    mean_cost: float
    estimate: float | None


class CostGovernor(StatefulProcessor):
    """Of each account: what waits, calls of its pages, costs of its claims, and its pages and cost in all.

    State is read and written in as few calls as there are batches of events,
    pages and claims, not events: what waits is kept in slices of time, and
    what a decision needs is read once and written back at the end. A timer is
    set for the first event of a batch and, when it goes off, for the first that still waits.
    """

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, part long", WAITING)
        self.calls = handle.getMapState("calls", "page string, tier string", "n int")
        self.costs = handle.getMapState("costs", "claim string", "cost double")
        self.whole = handle.getValueState("whole", "pages long, cost double, parts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Events wait until none before them can come; one that is sent again meanwhile is the same one."""
        pages, spent, parts = self.totals()
        first = None
        for frame in rows:
            stamps = pd.DatetimeIndex(frame["ts"])
            micros = pd.Series((stamps.tz_localize("UTC") if stamps.tz is None else stamps).as_unit("us").asi8, index=frame.index)
            for _, some in frame.assign(ts=micros).groupby(micros // SLICE):
                at = self.keep(parts, some)
                first, parts = at if first is None else min(first, at), parts + 1
        self.whole.update((pages, spent, parts))
        self.set_timer(first)
        return iter(())

    def keep(self, part: int, some: pd.DataFrame) -> int:
        """Events of one slice as one row of state; gives the time of the first."""
        first = int(some["ts"].min())
        costs = [None if pd.isna(c) else float(c) for c in some["cost"]]
        self.waiting.updateValue((first, part), (some["event_id"].tolist(), some["ts"].tolist(), *(some[c].tolist() for c in TEXTS), costs))
        return first

    def set_timer(self, first: int | None) -> None:
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Decide what is due, in order of time and id."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        pages, spent, parts = self.totals()
        self.n, self.cost = {}, {}
        slices: dict[int, list[tuple[int, int]]] = {}
        for at, part in self.waiting.keys():
            slices.setdefault(at // SLICE, []).append((part, at))
        firsts = [at for s, own in slices.items() if s * SLICE > now for _, at in own]
        changed_calls, changed_costs = set(), set()
        for at in sorted(s for s in slices if s * SLICE <= now):
            seen: dict[int, tuple] = {}
            for part, first in sorted(slices[at]):
                for event_id, *event in zip(*self.waiting.getValue((first, part)), strict=True):
                    seen.setdefault(event_id, (*event,))
                self.waiting.removeKey((first, part))
            out = []
            for _, event_id, kind, page, claim, tier, cost in sorted(((e[0], i, *e[1:]) for i, e in seen.items() if e[0] <= now), key=lambda e: e[:2]):
                if kind == "PAGE":
                    pages += 1
                elif kind == "CALL":
                    reason = self.decide(page, claim, tier, pages, spent)
                    out.append((key[0], event_id, reason == GRANTED, reason))
                    if reason == GRANTED:
                        self.n[page, tier] = self.calls_of(page, tier) + 1
                        changed_calls.add((page, tier))
                        if cost is not None:
                            spent += cost
                            self.cost[claim] = self.cost_of(claim) + cost
                            changed_costs.add(claim)
            later = {i: e for i, e in seen.items() if e[0] > now}
            if later:
                firsts.append(self.keep(parts, pd.DataFrame([(i, *e) for i, e in later.items()], columns=["event_id", "ts", *TEXTS, "cost"])))
                parts += 1
            if out:
                yield pd.DataFrame(out, columns=["account", "event_id", "granted", "reason"])
        for k in changed_calls:
            self.calls.updateValue(k, (self.n[k],))
        for claim in changed_costs:
            self.costs.updateValue((claim,), (self.cost[claim],))
        self.whole.update((pages, spent, parts))
        self.set_timer(min(firsts, default=None))

    def totals(self) -> tuple[int, float, int]:
        return self.whole.get() if self.whole.exists() else (0, 0.0, 0)

    def calls_of(self, page: str, tier: str) -> int:
        if (page, tier) not in self.n:
            have = self.calls.getValue((page, tier))
            self.n[page, tier] = have[0] if have else 0
        return self.n[page, tier]

    def cost_of(self, claim: str) -> float:
        if claim not in self.cost:
            have = self.costs.getValue((claim,))
            self.cost[claim] = have[0] if have else 0.0
        return self.cost[claim]

    def decide(self, page: str, claim: str, tier: str, pages: int, spent: float) -> str:
        limits = self.limits
        if limits.estimate is None:
            return NO_PRICE
        if self.calls_of(page, tier) >= limits.page_calls.get(tier, 0):
            return PAGE_LIMIT
        if self.cost_of(claim) + limits.estimate > limits.claim_cost:
            return CLAIM_LIMIT
        return MEAN_LIMIT if (spent + limits.estimate) / max(1, pages) > limits.mean_cost else GRANTED

    def close(self) -> None:
        pass


def governed_stream(stream: DataFrame, limits: Limits, late: str) -> DataFrame:
    """account, event_id, granted, reason of every CALL of a stream (account, event_id, ts, kind, page, claim, tier, cost).

    An account's events are decided in order of time and id, across
    micro-batches: each waits in state until the watermark has passed it. PAGE
    events count the account's pages; a granted CALL counts against its page,
    its claim and the account's mean. An event that comes after the watermark
    is dropped and never granted, so one that is sent again, with its time, has
    no effect. State is a row for each page and tier, each claim, and the events
    of an hour that came together and wait; of an account, an hour is gathered
    at a time. Null ids, times and accounts are dropped.
    """
    events = stream.filter("account IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL").select(F.col("account").cast("long").alias("account"), F.col("event_id").cast("long").alias("event_id"), "ts", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("kind", "page", "claim", "tier")), F.col("cost").cast("double").alias("cost"))
    return events.withWatermark("ts", late).groupBy("account").transformWithStateInPandas(CostGovernor(limits), "account long, event_id long, granted boolean, reason string", "append", "eventTime")


def governed_calls(stream: DataFrame, limits: Limits, late: str) -> DataFrame:
    """All decisions of ``governed_stream`` over what there is. Its state needs the store on disk, which is set for this run only."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return collected(governed_stream(stream, limits, late), "governed").drop("batch")
    finally:
        conf.set(PROVIDER, before)
