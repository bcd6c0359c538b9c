"""Shared pieces of the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.searches import active_searches, read_searches
from . import adapters as A


def flat_arrays(df: DataFrame, sep: str = "|") -> DataFrame:
    """Arrays of strings as ``sep``-joined text, so results compare as flat rows."""
    return df.select(*[F.array_join(F.col(f.name), sep).alias(f.name)
                       if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields])


def clean_searches(t: A.Tables) -> DataFrame:
    return t.memo("clean_searches", lambda: read_searches(A.searches_raw(t), A.DEFAULT_CRITERIA))


def active_dim(t: A.Tables) -> DataFrame:
    """Criteria side of the active searches, size-checked once per query."""
    from ..operators.matching import criteria_dim
    return t.memo("active_dim", lambda: criteria_dim(active_searches(clean_searches(t))))


def fetched(t: A.Tables) -> DataFrame:
    """Listings of the active searches only (inactive ones are never fetched)."""
    return t.memo("fetched", lambda: A.listings(t).join(active_dim(t).select("search_id"), "search_id", "left_semi"))


def cut_once(t: A.Tables):
    """A cut for the plans of one query: of equal plans the rows are stored once."""
    done = t.memo("cuts", list)

    def cut(name: str, df: DataFrame) -> DataFrame:
        for plan, table in done:
            if df.sameSemantics(plan):
                return table
        table = cut_lineage(df)
        done.append((df, table))
        return table
    return cut


def scratch(t, name: str) -> str:
    """A new folder of this query below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/roofline/{name}-{uuid.uuid4().hex}"
