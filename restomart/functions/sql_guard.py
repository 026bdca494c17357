"""Read-only test of SQL text, for one statement or a column of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from restomart.fixed_values import WRITE_KEYWORDS
from restomart.functions.text import EDGE, col, trim_all


def is_read_only(sql: str) -> bool:
    text = sql.strip().upper()
    return text.startswith(("SELECT", "WITH")) and not any(
        re.search(rf"\b{k}\b", text, re.ASCII) for k in WRITE_KEYWORDS)


def require_read_only(sql: str) -> None:
    if not is_read_only(sql):
        raise PermissionError("only SELECT and WITH statements are allowed")


def write_keywords(sql) -> Column:
    """Array of the write keywords a text holds as whole words."""
    upper = F.upper(col(sql))
    return F.array_compact(F.array(*[
        F.when(upper.rlike(f"{EDGE}{k}{EDGE}"), F.lit(k)) for k in WRITE_KEYWORDS]))


def starts_as_query(sql) -> Column:
    return F.upper(trim_all(sql)).rlike("^(SELECT|WITH)")


def read_only(sql) -> Column:
    return starts_as_query(sql) & (F.size(write_keywords(sql)) == 0)
