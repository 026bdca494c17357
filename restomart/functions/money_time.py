"""Money and calendar columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dollars(cents, total: bool = False) -> Column:
    """Exact cents -> dollars; totals get two more integer digits."""
    kind = "decimal(20,2)" if total else "decimal(18,2)"
    return (_col(cents).cast("decimal(19,0)") * F.lit(Decimal("0.01"))).cast(kind)


def fee_dollars(cents) -> Column:
    return dollars(F.coalesce(_col(cents), F.lit(0)))


def mean_dollars(sum_cents, count) -> Column:
    """Mean in dollars from a cents total, as one double division per step."""
    return F.try_divide(_col(sum_cents).cast("double") / 100, _col(count).cast("double"))


def half_up(value) -> Column:
    """Round half towards positive infinity (-2.5 -> -2)."""
    return F.floor(_col(value) + F.lit(0.5)).cast("bigint")


def rounded_ratio(numerator, denominator) -> Column:
    """half_up(n / d) in whole numbers; null when the denominator is 0."""
    return half_up(F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double")))


def local_clock(ts, timezone=None) -> Column:
    ts = _col(ts)
    return ts if timezone is None else F.from_utc_timestamp(ts, _col(timezone))


def weekday_number(ts) -> Column:
    """Sunday = 0."""
    return F.dayofweek(_col(ts)) - 1


def weekday_name(ts) -> Column:
    """English day name, blank-padded to nine characters."""
    return F.rpad(F.date_format(_col(ts), "EEEE"), 9, " ")


def iso_timestamp(text) -> Column:
    return F.try_to_timestamp(_col(text))
