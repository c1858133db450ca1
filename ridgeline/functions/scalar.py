"""Scalar functions of the model, the client's formats and the three quantile conventions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.config import DEFAULT, SEA_LEVEL_HPA, SLOPE_BANDS, USABLE_HPA
from ridgeline.functions.geo import is_finite

MINUS = "−"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / F.lit(1e6)


def half_up(x: Column) -> Column:
    """Rounds halves toward positive infinity."""
    return F.floor(x + 0.5)


def bucket(distance_m: Column, size: float = DEFAULT.bucket_m) -> Column:
    return (half_up(distance_m / size) * int(size)).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    """Null for null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def clamp_slope(pct: Column) -> Column:
    return clamp(pct, -DEFAULT.max_slope_pct, DEFAULT.max_slope_pct)


def slope_color(pct: Column) -> Column:
    """The colour of the first band whose upper slope isn't below the slope."""
    out = F.lit(SLOPE_BANDS[-1][1])
    for most, color in reversed(SLOPE_BANDS[:-1]):
        out = F.when(pct <= most, color).otherwise(out)
    return out


def band_index(color: Column, pct: Column) -> Column:
    """Index by colour; else by slope; else the last."""
    by_color = F.array_position(F.array(*[F.lit(c) for _, c in SLOPE_BANDS]), color) - 1
    by_slope = F.lit(len(SLOPE_BANDS) - 1).cast("long")
    for i, (most, _) in reversed(list(enumerate(SLOPE_BANDS[:-1]))):
        by_slope = F.when(pct <= most, i).otherwise(by_slope)
    return F.when(by_color >= 0, by_color).otherwise(by_slope)


def opposite(direction: Column) -> Column:
    return F.when(direction == "forward", "backward").otherwise("forward")


def line_key(segment_id: Column, direction: Column) -> Column:
    return F.concat_ws(":", segment_id.cast("string"), direction)


def dem_key(segment_id: Column, direction: Column, distance_m: Column) -> Column:
    return F.concat_ws("|", segment_id.cast("string"), direction, distance_m.cast("string"))


def altitude_from_hpa(hpa: Column) -> Column:
    return 44330 * (1 - F.pow(hpa / SEA_LEVEL_HPA, F.lit(1 / 5.255)))


def usable_reading(at_ms: Column, hpa: Column) -> Column:
    return is_finite(at_ms) & is_finite(hpa) & F.coalesce((hpa >= USABLE_HPA[0]) & (hpa <= USABLE_HPA[1]), F.lit(False))


def half_window_ms(asked: Column, default: float = 500.0, most: float = 2000.0) -> Column:
    return F.when(is_finite(asked) & (asked > 0), F.least(asked, F.lit(most))).otherwise(default)


def growth_speed(held_s: Column) -> Column:
    return 120 + 280 * clamp(held_s / 2, 0, 1)


def interval_for_speed(mps: Column) -> Column:
    """Milliseconds between fixes so that they are about 11 m apart; the longest interval where no speed is known."""
    return F.when(mps > 0, half_up(clamp(11 / mps * 1000, 1000, 4000) / 500) * 500).otherwise(F.lit(4000)).cast("long")


def name_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", " "))


def gap_band(gap_s: Column, edges: tuple[int, ...]) -> Column:
    out = F.lit(f">{edges[-1]}s")
    for e in reversed(edges):
        out = F.when(gap_s <= e, f"<={e}s").otherwise(out)
    return out


def qualifies(span_m: Column, share: Column, min_span_m: float = DEFAULT.min_span_m, min_coverage: float = DEFAULT.min_coverage) -> Column:
    return (span_m >= min_span_m) | (share >= min_coverage)


def is_spike(cross_m: Column, chord_m: Column, min_cross_m: float, ratio: float) -> Column:
    return F.coalesce(cross_m >= min_cross_m, F.lit(False)) & ((chord_m <= 0) | (cross_m / chord_m >= ratio))


# quantiles of a sorted array without nulls or NaN; null for an empty one


def nearest_rank(values: Column, q: float) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, F.least(n, F.floor(n * F.lit(q)).cast("int") + 1)))


def rounded_rank(values: Column, q: float) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, F.least(n, half_up((n - 1) * F.lit(q)).cast("int") + 1)))


# formats


def grouped_int(x: Column) -> Column:
    return F.format_number(half_up(x), 0)


def format_distance(m: Column) -> Column:
    feet = m / 0.3048
    return F.when(feet < 2640, F.concat(grouped_int(half_up(feet / 10) * 10), F.lit(" ft"))).otherwise(F.concat(F.format_string("%.2f", feet / 5280), F.lit(" mi")))


def format_feet(m: Column) -> Column:
    return F.concat(grouped_int(F.abs(m) / 0.3048), F.lit(" ft"))


def format_rise(m: Column) -> Column:
    text = format_feet(m)
    return F.when(text == "0 ft", text).otherwise(F.concat(F.when(m > 0, "+").otherwise(MINUS), text))


def format_grade(pct: Column) -> Column:
    r = half_up(pct * 10) / 10
    return F.when(r == 0, "0.0%").otherwise(F.concat(F.when(r > 0, "+").otherwise(MINUS), F.format_string("%.1f", F.abs(r)), F.lit("%")))


def format_band(low: Column, high: Column) -> Column:
    def n(x: Column) -> Column:
        return F.when(x < 0, F.concat(F.lit(MINUS), F.abs(x).cast("string"))).otherwise(x.cast("string"))

    return F.when(low.isNull() & high.isNotNull(), F.concat(F.lit("below "), n(high), F.lit("%"))).when(high.isNull() & low.isNotNull(), F.concat(F.lit("over "), n(low), F.lit("%"))).otherwise(
        F.concat(n(F.coalesce(low, F.lit(0))), F.lit(" to "), n(F.coalesce(high, F.lit(0))), F.lit("%"))
    )


def format_rides(low: Column, high: Column) -> Column:
    count = F.when(low == high, low.cast("string")).otherwise(F.concat_ws(" to ", low.cast("string"), high.cast("string")))
    return F.concat(F.lit("built from "), count, F.when(high == 1, " ride").otherwise(" rides"))


def format_ride_date(day: Column, today: Column) -> Column:
    short = F.concat_ws(" ", F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day)), F.dayofmonth(day).cast("string"))
    return F.when(F.year(day) == F.year(today), short).otherwise(F.concat_ws(", ", short, F.year(day).cast("string")))
