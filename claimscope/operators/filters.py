"""Claim filters as ``DataFrame -> DataFrame`` transforms.

Every filter is a ``Column`` predicate (never spliced SQL text), so values
with quotes are matched literally and Catalyst can push the predicate into
the Parquet scan (``PushedFilters``) or prune ``claim_year`` partitions
(``PartitionFilters``). An empty selection means "no filter".
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tuple(values: Iterable[str] | str | None) -> tuple[str, ...]:
    if values is None:
        return ()
    if isinstance(values, str):
        return (values,)
    return tuple(values)


@dataclass(frozen=True)
class ClaimsFilter:
    """User selection shared by the reports.

    ``codes`` win over ``category``; ``category`` None means every tracked code.
    """

    states: tuple[str, ...] = ()
    years: tuple[str, ...] = ()
    category: str | None = None
    codes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "states", _tuple(self.states))
        object.__setattr__(self, "years", tuple(str(y) for y in _tuple(self.years)))
        object.__setattr__(self, "codes", _tuple(self.codes))

    def without_years(self) -> ClaimsFilter:
        """Trends show the whole period: the year selection does not apply."""
        return replace(self, years=())

    def require_states(self) -> None:
        """The directory is only defined for an explicit set of states."""
        if not self.states:
            raise ValueError("select at least one state: the provider directory is per state")


def known_state(claims: DataFrame) -> DataFrame:
    """Drop claims whose practice location is unknown (applies to every report)."""
    return claims.where(F.col("practice_state").isNotNull())


def by_states(claims: DataFrame, states: Iterable[str] = ()) -> DataFrame:
    states = _tuple(states)
    return claims.where(F.col("practice_state").isin(*states)) if states else claims


def by_years(claims: DataFrame, years: Iterable[str] = ()) -> DataFrame:
    """Year as the string prefix of the month; on the warehouse this is the
    ``claim_year`` partition column, so the predicate prunes directories."""
    years = tuple(str(y) for y in _tuple(years))
    return claims.where(F.col("claim_year").isin(*years)) if years else claims


def by_codes(claims: DataFrame, codes: Iterable[str] = ()) -> DataFrame:
    codes = _tuple(codes)
    return claims.where(F.col("code").isin(*codes)) if codes else claims


def category_codes(ref: DataFrame, category: str) -> DataFrame:
    """Reference rows whose code is among the codes listed under ``category``.

    Selection is by code, not by the joined category: a code filed under two
    categories keeps both of its rows, as a ``code IN (...)`` on the fact would.
    """
    chosen = ref.where(F.col("category") == F.lit(category)).select("code")
    return ref.join(chosen, "code", "left_semi")


def select_codes(ref: DataFrame, category: str | None = None, codes: Iterable[str] = ()) -> DataFrame:
    """Filter cascade on the small reference table: codes, else category, else all.

    Restricting the reference before the inner join carries the restriction to
    the fact through the broadcast join without a second join.
    """
    codes = _tuple(codes)
    if codes:
        return ref.where(F.col("code").isin(*codes))
    if category is not None:
        return category_codes(ref, category)
    return ref


def by_category(claims: DataFrame, ref: DataFrame, category: str) -> DataFrame:
    """Stand-alone category filter on the fact: semi join to the category's codes."""
    codes = category_codes(ref, category).select("code").distinct()
    return claims.join(codes, "code", "left_semi").select(*claims.columns)


def claim_filters(claims: DataFrame, filt: ClaimsFilter) -> DataFrame:
    """Known state + state + year + explicit code predicates on the fact."""
    out = known_state(claims)
    out = by_states(out, filt.states)
    out = by_years(out, filt.years)
    return by_codes(out, filt.codes)


def reference_by_category(ref: DataFrame, category: str | None) -> DataFrame:
    """Equality filter on the reference table; None = identity."""
    if category is None:
        return ref
    return ref.where(F.col("category") == F.lit(category))
