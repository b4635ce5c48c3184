"""Unit registry and conversion as Column expressions; never across dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor of each unit to its dimension's base
UNITS: dict[str, tuple[str, float]] = {
    "mg": ("mass", 0.001), "g": ("mass", 1.0), "gram": ("mass", 1.0), "grams": ("mass", 1.0), "gm": ("mass", 1.0), "gms": ("mass", 1.0),
    "kg": ("mass", 1000.0), "kilogram": ("mass", 1000.0), "kilograms": ("mass", 1000.0), "kgs": ("mass", 1000.0), "t": ("mass", 1_000_000.0),
    "lb": ("mass", 453.59237), "lbs": ("mass", 453.59237), "oz": ("mass", 28.349523125),
    "ml": ("volume", 1.0), "millilitre": ("volume", 1.0), "millilitres": ("volume", 1.0), "milliliter": ("volume", 1.0), "milliliters": ("volume", 1.0),
    "cl": ("volume", 10.0), "l": ("volume", 1000.0), "litre": ("volume", 1000.0), "litres": ("volume", 1000.0), "liter": ("volume", 1000.0),
    "liters": ("volume", 1000.0), "kl": ("volume", 1_000_000.0), "fl_oz": ("volume", 29.5735295625), "gal": ("volume", 3785.411784),
    "mm": ("length", 1.0), "cm": ("length", 10.0), "m": ("length", 1000.0), "km": ("length", 1_000_000.0),
    "in": ("length", 25.4), "inch": ("length", 25.4), "inches": ("length", 25.4), "ft": ("length", 304.8),
    "number": ("count", 1.0), "unit": ("count", 1.0), "units": ("count", 1.0), "piece": ("count", 1.0), "pieces": ("count", 1.0), "pcs": ("count", 1.0),
    "nos": ("count", 1.0), "count": ("count", 1.0), "pair": ("count", 2.0), "dozen": ("count", 12.0),
    "s": ("time", 1.0), "sec": ("time", 1.0), "second": ("time", 1.0), "seconds": ("time", 1.0), "min": ("time", 60.0), "minute": ("time", 60.0),
    "minutes": ("time", 60.0), "h": ("time", 3600.0), "hour": ("time", 3600.0), "hours": ("time", 3600.0), "day": ("time", 86_400.0), "days": ("time", 86_400.0), "week": ("time", 604_800.0),
    "%": ("ratio", 0.01), "percent": ("ratio", 0.01), "fraction": ("ratio", 1.0), "ratio": ("ratio", 1.0),
}


def register_unit(name: str, dimension: str, factor: float) -> None:
    UNITS[name.lower()] = (dimension, factor)


def _lookup(unit: Column, part: int) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in sorted(UNITS.items()) for x in (k, v[part])))
    return F.try_element_at(table, F.lower(F.trim(unit)))


def dimension(unit: Column) -> Column:
    return _lookup(unit, 0)


def factor(unit: Column) -> Column:
    return _lookup(unit, 1)


def compatible(a: Column, b: Column) -> Column:
    return F.coalesce(dimension(a) == dimension(b), F.lit(False))


def convert(value: Column, source: Column, target: Column) -> Column:
    """`value` in `target` units; null if a unit is unknown or the dimensions differ."""
    return F.when(compatible(source, target), F.when(F.lower(F.trim(source)) == F.lower(F.trim(target)), value).otherwise(value * factor(source) / factor(target)))
