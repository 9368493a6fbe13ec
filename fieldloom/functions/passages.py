"""Sentences made of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import safe_token, strip, two_decimals


def _text(c: str | Column) -> Column:
    return F.coalesce(strip((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(""))


def _or(c: Column, fallback: str) -> Column:
    return F.when(c == "", fallback).otherwise(c)


def yield_passage(source: str = "PRiSM") -> Column:
    """Of columns year, semester_label, region, province, municipality, avg_yield_ton_ha, scraped_at."""
    province, region, label = _text("province"), _text("region"), _text("semester_label")
    day = F.split_part(F.split_part(_text("scraped_at"), F.lit(" "), F.lit(1)), F.lit("T"), F.lit(1))
    return F.concat(
        F.lit("In "), _text("year"), F.when(label != "", F.concat(F.lit(" "), label)).otherwise(""),
        F.lit(", the municipality of "), _or(_text("municipality"), "(unknown municipality)"),
        F.when(province != "", F.concat(F.lit(", in "), province)).otherwise(""),
        F.when(region != "", F.concat(F.lit(", "), region)).otherwise(""),
        F.lit(" recorded an average rice yield of "), F.coalesce(two_decimals(F.col("avg_yield_ton_ha")), F.lit("0.00")),
        F.lit(f" ton/ha. (Source: {source}"), F.when(day != "", F.concat(F.lit(", scraped "), day)).otherwise(""), F.lit(")"),
    )


def price_sentence(price: str = "price_php_per_kg") -> Column:
    """Of columns geolocation, commodity_type, commodity, year, month and the price."""
    commodity = F.coalesce(F.nullif(_text("commodity"), F.lit("")), F.nullif(_text("commodity_type"), F.lit("")), F.lit("commodity"))
    value = F.col(price)
    return F.concat(
        F.lit("In "), _or(_text("month"), "an unknown month"), F.lit(" "), _or(_text("year"), "an unknown year"),
        F.lit(", the farmgate price of "), commodity, F.lit(" in "), _or(_text("geolocation"), "an unknown location"),
        F.when(value.isNull() | F.isnan(value), " had no recorded data.").otherwise(F.concat(F.lit(" was ₱"), two_decimals(value), F.lit(" per kilogram."))),
    )


def price_passage(price: str = "price_php_per_kg", source: str = "PSA OpenSTAT") -> Column:
    kind = _text("commodity_type")
    return F.concat(price_sentence(price), F.lit(f" (Source: {source}"), F.when(kind != "", F.concat(F.lit(", "), kind)).otherwise(""), F.lit(")"))


def price_doc_id(index: Column, prefix: str = "openstat") -> Column:
    named = (("geolocation", "geo"), (None, "commodity"), ("year", "year"), ("month", "month"))
    commodity = F.coalesce(F.nullif(_text("commodity"), F.lit("")), F.col("commodity_type"))
    return F.concat_ws("_", F.lit(prefix), *(safe_token(commodity if c is None else F.col(c), f) for c, f in named), index.cast("string"))
