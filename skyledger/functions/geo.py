"""Geographic bounding box."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column


class BoundingBox(NamedTuple):
    north: float
    south: float
    west: float
    east: float

    def contains(self, latitude: Column, longitude: Column) -> Column:
        return latitude.between(self.south, self.north) & longitude.between(self.west, self.east)


# The British Isles and north-west Europe.
NORTH_WEST_EUROPE = BoundingBox(north=61.5, south=49.0, west=-8.5, east=10.5)
