"""Clusters of positions on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.text import js_round

CELL = 0.01


def cell(x: Column, size: float = CELL) -> Column:
    """The nearest grid line; halves go up, also below zero."""
    per = round(1 / size)
    return js_round(x.cast("double") * per) / per


def clusters(positions: DataFrame, lat: str = "lat", lng: str = "lng", at: str | None = None, size: float = CELL) -> DataFrame:
    """cell_lat, cell_lng, n and, with a date, first_at and last_at; largest first."""
    rows = positions.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    dated = [F.min(at).alias("first_at"), F.max(at).alias("last_at")] if at else []
    return rows.groupBy(cell(F.col(lat), size).alias("cell_lat"), cell(F.col(lng), size).alias("cell_lng")).agg(F.count("*").alias("n"), *dated).orderBy(F.desc("n"), "cell_lat", "cell_lng")


def in_cell(positions: DataFrame, cell_lat: float, cell_lng: float, lat: str = "lat", lng: str = "lng", size: float = CELL) -> DataFrame:
    return positions.where((cell(F.col(lat), size) == cell_lat) & (cell(F.col(lng), size) == cell_lng))
