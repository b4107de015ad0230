"""Scalar column expressions of the claims model.

All are built from ``pyspark.sql.functions`` so they stay JVM-side inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separator between a code and its description in a label,
# between categories in a served-categories list, and the servicing-name
# fallback.
LABEL_SEPARATOR = " — "
LIST_SEPARATOR = ", "
UNKNOWN_NAME = "Unknown"
ORGANISATION = "2"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_of(month: Column | str) -> Column:
    """``LEFT(month, 4)``: null stays null, a shorter string is returned whole."""
    return F.substring(_c(month), 1, 4)


def person_name(first: Column | str, last: Column | str) -> Column:
    """``first || ' ' || last`` — null when either part is null (not concat_ws)."""
    return F.concat(_c(first), F.lit(" "), _c(last))


def billing_name(org: Column | str = "org_name", first: Column | str = "first_name",
                 last: Column | str = "last_name") -> Column:
    """Organisation name, else person name; ignores entity type, may be null."""
    return F.coalesce(_c(org), person_name(first, last))


def servicing_name(entity_type: Column | str = "entity_type", org: Column | str = "org_name",
                   first: Column | str = "first_name", last: Column | str = "last_name") -> Column:
    """Type '2' -> organisation name, otherwise person name; null -> 'Unknown'.

    A type-2 row without an organisation name does not fall back to the
    person name.
    """
    name = F.when(_c(entity_type) == F.lit(ORGANISATION), _c(org)).otherwise(person_name(first, last))
    return F.coalesce(name, F.lit(UNKNOWN_NAME))


def code_label(code: Column | str = "code", description: Column | str = "description") -> Column:
    """``"<code> — <description>"``; a missing part renders as ``None``."""
    return F.concat(
        F.coalesce(_c(code), F.lit("None")),
        F.lit(LABEL_SEPARATOR),
        F.coalesce(_c(description), F.lit("None")),
    )


def label_code(label: Column | str) -> Column:
    """Inverse of :func:`code_label`: text before the first separator."""
    return F.substring_index(_c(label), LABEL_SEPARATOR, 1)


def split_list(c: Column | str) -> Column:
    """``"a, b"`` -> ``["a", "b"]`` (null stays null)."""
    return F.split(_c(c), LIST_SEPARATOR)


def search_text(*cols: Column | str) -> Column:
    """Lower-cased text of a row for free-text search.

    Cells are joined with a newline so a needle cannot match across two
    cells; null cells are skipped (they contribute no text).
    """
    return F.lower(F.concat_ws("\n", *[_c(c).cast("string") for c in cols]))
