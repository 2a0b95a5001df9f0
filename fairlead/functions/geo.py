"""Geometry on the sphere and in the local plane, as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

EARTH_RADIUS_NM = 3440.065
NM_PER_DEGREE = 60.0
NO_RELATIVE_MOTION = 1e-9


def haversine_nm(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in nautical miles."""
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    # Rounding can push the value a hair outside [0, 1]; keep NULL as NULL.
    bounded = F.when(chord > 1.0, F.lit(1.0)).when(chord < 0.0, F.lit(0.0)).otherwise(chord)
    return F.lit(2.0 * EARTH_RADIUS_NM) * F.atan2(F.sqrt(bounded), F.sqrt(1.0 - bounded))


def signed_turn(degrees: Column) -> Column:
    """Map an angle difference to [-180, 180); ``%`` truncates in Spark, so use pmod."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def angle_change(current: Column, previous: Column) -> Column:
    return F.abs(signed_turn(current - previous))


@dataclass(frozen=True)
class Motion:
    """The four columns that describe one vessel's movement."""

    latitude: Column
    longitude: Column
    sog: Column
    cog: Column

    @classmethod
    def of(cls, prefix: str) -> "Motion":
        return cls(*(F.col(f"{prefix}_{name}") for name in ("latitude", "longitude", "sog", "cog")))

    def velocity(self) -> tuple[Column, Column]:
        course = F.radians(F.pmod(self.cog, F.lit(360.0)))
        return self.sog * F.sin(course), self.sog * F.cos(course)


def relative_position(a: Motion, b: Motion) -> tuple[Column, Column]:
    """Position of b seen from a, in NM east and north on a local plane."""
    north = (b.latitude - a.latitude) * NM_PER_DEGREE
    east = (
        signed_turn(b.longitude - a.longitude)
        * NM_PER_DEGREE
        * F.cos(F.radians((a.latitude + b.latitude) / 2.0))
    )
    return east, north
