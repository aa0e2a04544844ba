"""Fetch policies as decisions over logged attempts: retry, spacing, escalation."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 3
    backoff: float = 0.2


@dataclass(frozen=True)
class RatePolicy:
    min_interval: float = 0.5


@dataclass(frozen=True)
class PaginatePolicy:
    mode: str = ""
    max_pages: int = 5


@dataclass(frozen=True)
class EscalationPolicy:
    tiers: tuple[str, ...] = ("http", "impersonate", "browser")
    sticky: bool = True


@dataclass(frozen=True)
class Profile:
    """Named policies of a resolver, in the order they wrap a fetch: paginate, escalate, retry, rate."""

    name: str
    retry: RetryPolicy = RetryPolicy()
    rate: RatePolicy | None = None
    paginate: PaginatePolicy | None = None
    escalate: EscalationPolicy | None = None


PROFILES = {
    p.name: p
    for p in (
        Profile("basic"),
        Profile("basic_browser", escalate=EscalationPolicy(("http", "browser"))),
        Profile("full_browser", rate=RatePolicy(), escalate=EscalationPolicy()),
    )
}


def retriable(status: Column, error: Column) -> Column:
    return error.isNotNull() | (status == 429) | status.between(500, 599) | (status == 0)


def retry(attempts: DataFrame, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """Of each url's attempts (url, attempt, status, error, ...) the one that counts: the first that needs no retry, else the last allowed; with the waits before it."""
    own = attempts.where(F.col("attempt") <= policy.max_attempts).withColumn("_again", retriable(F.col("status"), F.col("error")))
    best = Window.partitionBy("url").orderBy("_again", F.when(F.col("_again"), -F.col("attempt")).otherwise(F.col("attempt")))
    waited = policy.backoff * (F.pow(F.lit(2.0), F.col("attempt") - 1) - 1)
    return own.withColumn("_n", F.row_number().over(best)).where("_n = 1").withColumn("waited", waited).drop("_n", "_again")


def spaced(requests: DataFrame, policy: RatePolicy = RatePolicy()) -> DataFrame:
    """Add ``slot``: each host's requests (host, seq, at) start at least ``min_interval`` apart, none before it came.

    slot_k = max(at_k, slot_{k-1} + d) unrolls to k d + max over i <= k of (at_i - i d): a running maximum.
    """
    order = Window.partitionBy("host").orderBy("at", "seq")
    k = F.row_number().over(order) - 1
    lead = requests.withColumn("_k", k)
    run = F.max(F.col("at") - F.col("_k") * policy.min_interval).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return lead.withColumn("slot", run + F.col("_k") * policy.min_interval).drop("_k")


def sticky_tiers(attempts: DataFrame, sticky: bool = True) -> DataFrame:
    """(host, seq, url, tier) from (host, seq, url, tier, climb): the lowest tier at or above the host's floor that needs no climb, else the highest.

    The floor is the highest tier that the host has needed so far. It never falls, so a host's requests are served in
    order; hosts are independent. A host's log is read as one group: its size is what one crawler fetched there.
    """
    if not sticky:
        w = Window.partitionBy("host", "seq", "url").orderBy("climb", F.when(F.col("climb"), -F.col("tier")).otherwise(F.col("tier")))
        return attempts.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("host", "seq", "url", "tier")

    def serve(log: pd.DataFrame) -> pd.DataFrame:
        floor, out = 0, []
        log = log.dropna(subset=["seq", "url"]).sort_values(["seq", "url", "tier"])
        rows = zip(log.host, log.seq, log.url, log.tier, log.climb)
        for (seq, url), own in groupby(rows, lambda x: x[1:3]):
            tries = [(host, tier, climb) for host, _, _, tier, climb in own]
            host, tier, _ = next((t for t in tries if t[1] >= floor and not t[2]), tries[-1])
            floor = max(floor, tier)
            out.append((host, seq, url, tier))
        return pd.DataFrame(out, columns=["host", "seq", "url", "tier"])

    return attempts.groupBy("host").applyInPandas(serve, "host string, seq long, url string, tier int")
