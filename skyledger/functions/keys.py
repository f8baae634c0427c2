"""Surrogate keys and change-detection hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSENT = "∅"


def surrogate_key(*parts: Column | str) -> Column:
    """MD5 over the parts joined by `|`.  NULL parts vanish together with their separator."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def row_hash(*parts: Column | str) -> Column:
    """MD5 over the parts joined by `|`, with a marker for NULL, so that a value and its absence differ."""
    return F.md5(F.concat_ws("|", *[F.coalesce(_text(p), F.lit(ABSENT)) for p in parts]))


def route_key(origin: Column | str, dest: Column | str) -> Column:
    return F.concat_ws("-", _text(origin), _text(dest))


def date_key(day: Column | str) -> Column:
    return F.date_format(day, "yyyyMMdd")


def _text(part: Column | str) -> Column:
    return (F.col(part) if isinstance(part, str) else part).cast("string")
