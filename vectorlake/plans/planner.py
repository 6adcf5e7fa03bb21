"""Index choice and search strategy."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import is_index_eligible, parse


@dataclass(frozen=True)
class Plan:
    index: str
    ef: int
    reason: str


def choose(rows: int, dimension: int, k: int, filtered: bool = False) -> Plan:
    """Which index suits a query."""
    if rows < 500:
        return Plan("flat", 0, "few rows: an exact scan is cheapest")
    if filtered and rows < 5000:
        return Plan("flat", 0, "filtered query over a small collection: exact scan")
    if dimension >= 64 and rows >= 1000:
        return Plan("grid", max(128, 4 * k), "many dimensions: grid cells with exact ranking")
    return Plan("hnsw", max(64, 4 * k), "proximity graph")


def index_for(rows: Column, dimension: Column, filtered: Column) -> Column:
    """``choose(...).index`` for each row of a table of collections."""
    flat = (rows < 500) | filtered & (rows < 5000)
    return F.when(flat, "flat").when((dimension >= 64) & (rows >= 1000), "grid").otherwise("hnsw")


def strategy(filter_spec: Any, eligible: int | None, k: int) -> str:
    """How a filter is applied.  Filters always restrict the rows before the choice, so results hold k rows where k match."""
    if filter_spec is None:
        return "standard_index_search"
    if eligible is not None and eligible <= max(8 * k, 64):
        return "payload_exact_eligible"
    return "payload_aware_index_search" if is_index_eligible(parse(filter_spec)) else "payload_filtered_scan"
