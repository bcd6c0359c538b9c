"""One poll cycle as a DataFrame plan.

fetch -> filter (D1+C3) -> cycle dedup (F1) -> seen dedup (D3) -> enrich (D5) ->
re-filter (C3) -> repost dedup (F2+D4) -> notify cap (F8) -> commit (H2, J1).

Every stage is a lazily built DataFrame; the caller decides what to write.  The only
jobs started here are the cuts that ``materialize`` makes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matches_criteria
from ..functions.predicates import CRITERIA_COLS
from ..operators import dedup as D
from ..operators import delivery as V
from ..operators import enrich as E
from ..operators import matching as M
from ..operators import results as R
from ..sources.searches import active_searches


@dataclass
class Cycle:
    fetched: DataFrame
    filtered: DataFrame
    new: DataFrame
    enriched: DataFrame
    kept: DataFrame
    dropped: DataFrame
    individual: DataFrame
    overflow: DataFrame
    seen_rows: DataFrame
    results: DataFrame
    prime: bool
    flagged: DataFrame | None = None


#: Detail rows, or what gives those of the listings (``listing_id``) it is handed.
Details = DataFrame | Callable[[DataFrame], DataFrame]
#: Stores the rows of a plan under a name and gives them back as a table.
Cut = Callable[[str, DataFrame], DataFrame]


def run_cycle(listings: DataFrame, searches: DataFrame, seen: DataFrame, details: Details | None,
              order: list[str], now, cap: int = V.DEFAULT_CAP, prime: bool = False,
              enrich_source: str | None = None, materialize: Cut | None = None, content_dedup: bool = True) -> Cycle:
    """Build every stage of one cycle.  ``prime`` stores everything and notifies
    nothing.  ``enrich_source`` limits enrichment to one source (the portal).
    ``content_dedup`` off keeps reposts; their signatures are stored all the same.

    All outputs (kept, dropped, outbox, seen rows, results) branch from the
    repost-flagged listings, and those read the signed listings twice (the rows and the
    first of each signature); details that are asked for are told the new ones, which a run log counts beside the
    filtered ones.
    ``materialize`` cuts the plan at these, so that nothing carries (and plans) the whole
    upstream cycle again."""
    cut = materialize or (lambda name, df: df)
    active = active_searches(searches)
    dim = M.criteria_dim(active)
    fetched = listings.join(dim.select("search_id"), "search_id", "left_semi")
    filtered = M.first_match_wins(M.match_per_search(fetched, dim=dim), order)
    if callable(details):
        filtered = cut("filtered", filtered)
    new = D.only_new(filtered, seen)
    if details is not None:
        if callable(details):
            new = cut("new", new)
            wanted = new if enrich_source is None else new.filter(F.col("source") == enrich_source)
            details = details(wanted.select("listing_id"))
        enriched = E.enrich(new, details, source=enrich_source)
        refiltered = (M.attach_criteria(enriched.drop("search_type"), dim=dim)
                      .filter(matches_criteria()).drop(*CRITERIA_COLS))
    else:
        refiltered = new
    signed = cut("signed", D.with_signature(refiltered))
    if content_dedup:
        flagged = D.split_reposts(signed, order, seen)
    else:
        flagged = signed.withColumns({"dropped": F.lit(False), "kept_id": F.col("listing_id")})
    flagged = cut("flagged", flagged)
    kept = flagged.filter(~F.col("dropped")).drop("dropped", "kept_id")
    dropped = flagged.filter(F.col("dropped")).drop("dropped", "kept_id")
    if prime:
        individual = kept.limit(0).withColumn("position", F.lit(0))
        overflow = kept.limit(0)
    else:
        individual, overflow = V.notify_cap(kept, order, cap)
    return Cycle(fetched=fetched, filtered=filtered, new=new, enriched=refiltered, kept=kept,
                 dropped=dropped, individual=individual, overflow=overflow,
                 seen_rows=D.seen_rows(kept, dropped), results=R.result_rows(kept, now), prime=prime,
                 flagged=flagged)


def cycle_stats(c: Cycle, cap: int = V.DEFAULT_CAP) -> DataFrame:
    """The funnel of one cycle as one row: fetched
    (cross-search duplicates included), filtered (after cycle dedup), new (after
    re-filter and repost dedup), notified (individual messages: the first ``cap``
    new listings, none in a prime cycle).  The stages share one lineage, so the
    flags are counted over one tagged union and Spark reuses the common exchanges."""
    stages = [("fetched", c.fetched), ("filtered", c.filtered), ("new", c.kept)]
    tagged = None
    for name, df in stages:
        part = df.select(F.lit(name).alias("stage"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.agg(*[F.count_if(F.col("stage") == name).cast("bigint").alias(name) for name, _ in stages])
    notified = F.lit(0).cast("bigint") if c.prime else F.least(F.col("new"), F.lit(cap)).cast("bigint")
    return counts.withColumn("notified", notified)
