"""Unit conversion of position measures."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
METRES_PER_FOOT = 0.3048
METRES_PER_SECOND_PER_KNOT = 0.514444


def feet_to_metres(feet: Column) -> Column:
    return feet * F.lit(METRES_PER_FOOT)


def knots_to_ms(knots: Column) -> Column:
    return knots * F.lit(METRES_PER_SECOND_PER_KNOT)
