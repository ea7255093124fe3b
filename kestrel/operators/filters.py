"""Metadata filters (B1-B8) as Column predicates.

Filters are a dict. Known keys: ``author, category, date_from, date_to,
tags, source``; unknown keys are ignored; no dict (or an empty one) means no
filter. All predicates are combined with AND and built as Columns, never as
SQL text, so values are never interpolated.

Two table forms (contract S2-S6):
  ``null`` mode (relational): typed DATE, tags array, NULLs for missing;
      ``x = NULL`` keeps nothing, a NULL date fails every date bound.
  ``text`` mode (collection): dates are text with ``''`` for missing, so
      ``'' <= '2024-..'`` is true and such rows pass ``date_to``; tags live in
      the JSON metadata; a falsy tag value skips the tag filter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_KEYS = ("author", "category", "date_from", "date_to", "tags", "source")


def json_tags(metadata: Column) -> Column:
    """``$.tags`` of a JSON metadata text as ARRAY<STRING> (NULL if absent)."""
    return F.from_json(F.get_json_object(metadata, "$.tags"), "array<string>")


def predicate(filters: dict | None, mode: str = "null", field: Callable[[str], Column] = F.col) -> Column | None:
    """AND of the given filters, or None when there is nothing to filter. ``field`` gives the
    Column of a name (by default the frame's own)."""
    if mode not in ("null", "text"):
        raise ValueError("mode must be 'null' or 'text'")
    if not filters:
        return None
    parts: list[Column] = []
    for key in ("author", "category", "source"):
        if key in filters:
            value = filters[key]
            # A None value compares as NULL and keeps no row
            parts.append(field(key) == (F.lit(None).cast("string") if value is None
                                        else F.lit(str(value))))
    for key, op in (("date_from", "ge"), ("date_to", "le")):
        if key in filters:
            value = filters[key]
            if mode == "null":
                bound = F.lit(None).cast("date") if value is None else F.to_date(F.lit(str(value)))
                col = field("date")
            else:
                bound = F.lit(None).cast("string") if value is None else F.lit(str(value))
                col = field("date")
            parts.append(col >= bound if op == "ge" else col <= bound)
    if "tags" in filters:
        value = filters["tags"]
        if mode == "null":
            parts.append(F.array_contains(field("tags"), F.lit(value)) if value is not None
                         else F.lit(None).cast("boolean"))
        elif value:  # S5: text mode skips a falsy tag
            parts.append(F.coalesce(F.array_contains(json_tags(field("metadata")), F.lit(str(value))),
                                    F.lit(False)))
    if not parts:
        return None
    return reduce(lambda a, b: a & b, parts)


def apply_filters(df: DataFrame, filters: dict | None, mode: str = "null") -> DataFrame:
    """Pre-filter (contract S8): filters run before any top-k, and reach the
    Parquet scan as pushed filters where the column is stored."""
    p = predicate(filters, mode)
    return df if p is None else df.filter(p)
