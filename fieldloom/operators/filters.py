"""Row filters with validated bounds."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(spec) -> None:
    for f in fields(spec):
        v = getattr(spec, f.name)
        if isinstance(v, str):
            setattr(spec, f.name, v.strip() or None)
    for name in {f.name[:-4] for f in fields(spec) if f.name.endswith(("_min", "_max"))}:
        low, high = getattr(spec, f"{name}_min"), getattr(spec, f"{name}_max")
        if low is not None and high is not None and low > high:
            raise ValueError(f"{name}_min must not be above {name}_max")


def _condition(spec, columns: dict[str, str]) -> Column:
    """Equalities and inclusive ranges, all of them; no setting, no condition."""
    parts = []
    for f in fields(spec):
        v = getattr(spec, f.name)
        if v is None:
            continue
        if f.name.endswith("_min"):
            parts.append(F.col(columns.get(f.name[:-4], f.name[:-4])) >= v)
        elif f.name.endswith("_max"):
            parts.append(F.col(columns.get(f.name[:-4], f.name[:-4])) <= v)
        elif isinstance(v, (list, tuple)):
            parts.append(F.col(columns.get(f.name, f.name)).isin(*v))
        else:
            parts.append(F.col(columns.get(f.name, f.name)) == v)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass
class YieldFilter:
    year: int | None = None
    semester_code: int | None = None
    region: str | None = None
    province: str | None = None
    municipality: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    yield_min: float | None = None
    yield_max: float | None = None

    def __post_init__(self) -> None:
        _checked(self)

    def condition(self) -> Column:
        return _condition(self, {"yield": "avg_yield_ton_ha"})


@dataclass
class PriceFilter:
    """A range of prices leaves rows without a price out."""

    geolocation: str | None = None
    commodity_type: str | None = None
    commodity: str | None = None
    year: int | None = None
    month: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    price_min: float | None = None
    price_max: float | None = None

    def __post_init__(self) -> None:
        _checked(self)

    def condition(self) -> Column:
        return _condition(self, {"price": "price_php_per_kg"})


@dataclass
class CorpusFilter:
    source_id: list[str] | None = None

    def condition(self) -> Column:
        return _condition(self, {})


def without_texts(rows: DataFrame, unwanted: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows in which no column (of ``columns``) holds any of the texts; an empty list drops nothing."""
    if not unwanted:
        return rows
    pattern = "|".join(re.escape(u) for u in unwanted)
    found = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"`{c}`").cast("string").rlike(pattern), F.lit(False)) for c in columns or rows.columns))
    return rows.filter(~found)


def long_enough(rows: DataFrame, least: int = 100, text_col: str = "text") -> DataFrame:
    return rows.filter(F.length(text_col) >= least)


def page_of(rows: DataFrame, offset: int, limit: int, key: str = "point_id") -> DataFrame:
    """One page in key order."""
    return rows.orderBy(key).offset(offset).limit(limit)


def next_offset(total: int, offset: int, limit: int) -> int | None:
    return offset + limit if total > offset + limit else None
