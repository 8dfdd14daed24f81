"""Segment ids, keys and levels: as column expressions, and a parser."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftcube.config import DIMENSIONS, KEY_SEPARATOR, TOTAL_KEY

#: White space at either end, Unicode's included.
_ENDS = r"(?U)^\s+|\s+$"


def clean_dimension(value: Column) -> Column:
    """A trimmed value; blank and null mean that the dimension is rolled up."""
    return F.nullif(F.regexp_replace(value.cast("string"), _ENDS, ""), F.lit(""))


def segment_id(dims: Sequence[str] = DIMENSIONS) -> Column:
    """Compact JSON array of all dimensions in order, null for a rolled-up one."""
    return F.to_json(F.array(*dims))


def segment_key(dims: Sequence[str] = DIMENSIONS) -> Column:
    parts = [F.when(F.col(d).isNotNull(), F.concat(F.lit(f"{d}="), F.col(d))) for d in dims]
    return F.coalesce(F.nullif(F.concat_ws(KEY_SEPARATOR, *parts), F.lit("")), F.lit(TOTAL_KEY))


def segment_level(dims: Sequence[str] = DIMENSIONS) -> Column:
    return F.concat_ws(KEY_SEPARATOR, *(F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims))


def normalize_dim_value(value: object) -> str | None:
    """One dimension value as :func:`clean_dimension` makes it; NaN is null, too."""
    text = "" if value is None or value != value else str(value).strip()
    return text or None


def segment_id_from_row(row: Mapping[str, object], dims: Sequence[str] = DIMENSIONS) -> str:
    """The id of one row, as :func:`segment_id` makes it."""
    return json.dumps([normalize_dim_value(row.get(d)) for d in dims], ensure_ascii=False, separators=(",", ":"))


def build_segment_key_and_level(row: Mapping[str, object], dims: Sequence[str] = DIMENSIONS) -> tuple[str, str]:
    """(key, level) of one row, as :func:`segment_key` and :func:`segment_level` make them."""
    known = [(d, v) for d in dims if (v := normalize_dim_value(row.get(d))) is not None]
    return KEY_SEPARATOR.join(f"{d}={v}" for d, v in known) or TOTAL_KEY, KEY_SEPARATOR.join(d for d, _ in known)


def depth(dims: Sequence[str] = DIMENSIONS) -> Column:
    total = F.lit(0)
    for d in dims:
        total = total + F.col(d).isNotNull().cast("int")
    return total


def key_parts(key: Column) -> Column:
    """A key as array of (dim, value); the total and blank keys have none, blank parts are skipped.

    A part without ``=`` has a null value, so that callers can refuse it.
    """
    pieces = F.filter(F.split(key, KEY_SEPARATOR), lambda p: F.trim(p) != "")
    parts = F.transform(
        pieces,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("dim"),
            F.when(F.contains(p, F.lit("=")), F.trim(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)))).alias("value"),
        ),
    )
    return F.when(F.trim(key).isin(TOTAL_KEY, ""), F.array().cast("array<struct<dim:string,value:string>>")).otherwise(parts)


def parse_segment_key_parts(key: str) -> list[tuple[str, str]]:
    """(dimension, value) pairs of a key; an error for a part without ``=`` or with an empty side."""
    out = []
    for part in [] if key.strip() in ("", TOTAL_KEY) else key.split(KEY_SEPARATOR):
        if not part.strip():
            continue
        dim, sign, value = (x.strip() for x in part.partition("="))
        if not (sign and dim and value):
            raise ValueError(f"segment key {key!r}: bad part {part!r}")
        out.append((dim, value))
    return out
