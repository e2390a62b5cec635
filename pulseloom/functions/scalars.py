"""Scalar rules as column expressions.

Nulls and NaN: a null or NaN score gives a null label, quadrant or clamp, where a plain
comparison would call NaN large and a plain clamp would turn null into the upper bound.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pulseloom import dims


def known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(known(x), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def quadrant(yin: Column, yang: Column) -> Column:
    return (
        F.when(~(known(yin) & known(yang)), None)
        .when((yin >= 50) & (yang >= 50), "peak")
        .when(yang >= 50, "pushing_it")
        .when(yin >= 50, "recharging")
        .otherwise("burnout")
    )


def _steps(x: Column, names: tuple[str, ...]) -> Column:
    out = F.when(~known(x), None)
    for least, name in zip((80, 60, 40, 20), names, strict=False):
        out = out.when(x >= least, name)
    return out.otherwise(names[-1])


# Labels of the two scores, from high to low.
YIN_LABELS = ("Fully Charged", "Steady", "Thinning", "Running Low", "Empty")
YANG_LABELS = ("Fired Up", "Moving", "Coasting", "Sluggish", "Stalled")


def yin_label(x: Column) -> Column:
    return _steps(x, YIN_LABELS)


def yang_label(x: Column) -> Column:
    return _steps(x, YANG_LABELS)


def round_half_up(x: Column) -> Column:
    """Halves go towards plus infinity, for negative numbers too."""
    return F.floor(x + F.lit(0.5)).cast("long")


def seconds_between(start_ms: Column, end_ms: Column) -> Column:
    return round_half_up((end_ms - start_ms).cast("double") / 1000)


def minutes_played(seconds: Column) -> Column:
    """Rounded from seconds that were rounded before."""
    return round_half_up(seconds.cast("double") / 60)


def remaining_minutes(end_ms: Column, now_ms: Column) -> Column:
    left = end_ms - now_ms
    return F.when(left > 0, F.ceil(left.cast("double") / 60000)).otherwise(F.lit(0)).cast("long")


def session_id(ms: Column) -> Column:
    return F.concat(F.lit("sess_"), F.lower(F.conv(ms.cast("string"), 10, 36)))


def hour_bias(ts: Column) -> Column:
    """Struct of the biases at the hour of ts, in the session's time zone."""
    h = F.hour(ts)
    row = lambda a, b, c, d: F.struct(F.lit(a).alias("yin_bias"), F.lit(b).alias("yang_bias"), F.lit(c).alias("fire_bias"), F.lit(d).alias("earth_bias"))
    return (
        F.when((h >= 22) | (h < 6), row(-15, -20, 20, 0))
        .when((h >= 13) & (h < 15), row(-10, -10, 0, 15))
        .when((h >= 9) & (h < 12), row(10, 15, 0, -10))
        .otherwise(row(0, 0, 0, 0))
    )


def default_null(x: Column, value) -> Column:
    """Only null takes the default."""
    return F.coalesce(x, F.lit(value))


def default_empty(x: Column, value: str) -> Column:
    """Null and the empty string take the default."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(value))


def strictly_true(x: Column) -> Column:
    return x.eqNullSafe(F.lit(True))


def valid_element(x: Column) -> Column:
    """The element itself; an unknown one raises. Null and empty pass, as nothing was asked."""
    ok = F.coalesce(F.nullif(x, F.lit("")).isin(*dims.ELEMENTS), F.lit(True))
    return F.when(ok, x).otherwise(F.raise_error(F.concat(F.lit("Invalid element "), x)).cast("string"))


def engine_mode(flag: Column, api_key: Column) -> Column:
    """mock if the flag is exactly true or there is no key (null or empty), else real."""
    none = default_empty(api_key, "") == ""
    return F.when(F.coalesce(flag == "true", F.lit(False)) | none, "mock").otherwise("real")


def audio_task(recommended: Column) -> Column:
    return F.when(recommended == "meditation", "meditation").when(recommended == "zhan_zhuang", "zhanZhuang").otherwise("breathing")


def is_headphones(device: Column) -> Column:
    """No built-in speaker name occurs in the device's name; null is no device."""
    name = F.lower(F.trim(device))
    return F.coalesce(~F.exists(F.array(*[F.lit(p) for p in dims.BUILTIN_SPEAKERS]), lambda p: F.contains(name, p)), F.lit(False))


def is_wireless_headphones(kind: Column, name: Column) -> Column:
    return F.coalesce(kind.rlike(dims.HEADPHONE_KINDS), F.lit(False)) | F.coalesce(name.rlike(dims.HEADPHONE_NAMES), F.lit(False))


def day_start(day: Column) -> Column:
    return F.to_timestamp(F.concat(day, F.lit("T00:00:00Z")))


def day_end(day: Column) -> Column:
    return F.to_timestamp(F.concat(day, F.lit("T23:59:59Z")))


def utc_date(ts: Column) -> Column:
    """The calendar day in UTC of an instant, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / F.lit(86_400)).cast("int"))


def shortest(x: Column) -> Column:
    """A number as text, without a fraction where it is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def nanos_to_timestamp(nanos: Column) -> Column:
    """Whole milliseconds of a string of nanoseconds, by integer division."""
    return F.timestamp_millis(F.floor(nanos.cast("decimal(20,0)") / F.lit(1_000_000)).cast("long"))


def token_expired(expires_ms: Column, now_ms: Column) -> Column:
    return now_ms >= expires_ms


def token_expiry(now_ms: Column, expires_in: Column, default_seconds: int) -> Column:
    return now_ms + F.coalesce(expires_in, F.lit(default_seconds)) * 1000


def split_fields(line: Column) -> Column:
    """The four fields of element|score|quadrant|signal; a bar in the signal cuts it."""
    part = lambda i: F.split_part(line, F.lit("|"), F.lit(i))
    return F.struct(part(1).alias("element"), part(2).alias("score"), part(3).alias("quadrant"), part(4).alias("signal"))


def change_pct(before: Column, after: Column) -> Column:
    """Whole per cent; null where a side is missing or before is 0."""
    return F.when(before != 0, round_half_up(100 * (after - before) / before))


@F.pandas_udf(StringType())
def fixed1(x: pd.Series) -> pd.Series:
    """One decimal of the exact binary value, halves away from zero; no built-in function does it."""
    return x.map(lambda v: None if pd.isna(v) else str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)))
