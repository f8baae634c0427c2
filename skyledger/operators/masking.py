"""Sensitive columns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENSITIVE = ("tail_number",)


def masked(
    rows: DataFrame, columns: Sequence[str] = SENSITIVE, hide: bool = False, key: str = ""
) -> DataFrame:
    """Replace sensitive text by a SHA-256, which still joins and counts; or, with `hide`, drop it.

    Texts that can be listed, as tail numbers can, are told from their plain hash by hashing the whole
    list.  With a secret `key` the hash is keyed (HMAC) and tells nothing to those without the key.
    """
    if hide:
        return rows.drop(*columns)
    return rows.withColumns({c: _hidden(F.col(c), key) for c in columns})


def readable(
    rows: DataFrame,
    members: DataFrame,
    role: str,
    columns: Sequence[str] = SENSITIVE,
    key: str = "",
) -> DataFrame:
    """Sensitive columns as they are for users who have the role, masked for all others.

    `members` lists who has which role (`user_name`, `role`).  The user is looked up when a query runs, not
    when this is called; one membership test serves the whole query.
    """
    held = members.filter((F.col("role") == role) & (F.col("user_name") == F.session_user()))
    allowed = held.agg((F.count(F.lit(1)) > 0).alias("allowed")).scalar()
    return rows.withColumns({c: F.when(allowed, F.col(c)).otherwise(_hidden(F.col(c), key)) for c in columns})


def _hidden(text: Column, key: str) -> Column:
    return _keyed(text, key) if key else F.sha2(text, 256)


def _keyed(text: Column, key: str) -> Column:
    """HMAC-SHA-256."""
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    block = block.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)
