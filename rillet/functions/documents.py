"""What is published: values that JSON can hold, CSV fields, views and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_number(c: Column, digits: int) -> Column:
    """Rounded; NaN and infinities are null."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.round(x, digits))


def json_integer(c: Column) -> Column:
    return json_number(c, 0).cast("long")


def json_flag(c: Column) -> Column:
    """Null and NaN are false, as is 0."""
    x = c.cast("double")
    return F.coalesce(~F.isnan(x) & (x != 0), F.lit(False))


def iso_day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def iso_utc(c: Column) -> Column:
    """Of a timestamp in the session's zone."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def text_or_null(c: Column) -> Column:
    return F.when((c != "") & (F.lower(c) != "nan"), c)


def csv_field(c: Column) -> Column:
    """Quoted where it must be; null is empty."""
    x = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def visible(view: str, status: Column, has_forecast: Column) -> Column:
    """Whether a point is shown: all, those with a forecast, or those that have anything to tell."""
    forecast = F.coalesce(has_forecast, F.lit(False))
    return {"forecast": forecast, "all": F.lit(True)}.get(view, F.coalesce(status != "", F.lit(False)) | forecast)


def fixed(c: Column, digits: int = 0) -> Column:
    """``c`` with 0 or 1 decimals as C's printf writes it: the double itself is rounded, not its shortest decimal form, and a tie goes to the even digit (8.45 is a little
    less than that, so 8.4). Ten times the value is taken as a sum of two doubles, without an error. A zero keeps its sign."""
    x = F.abs(c.cast("double"))
    below = (c.cast("double") < 0) | ((x == 0) & c.cast("double").cast("string").startswith("-"))  # no comparison tells -0.0 from 0.0
    if digits == 0:
        tenths = F.rint(x)
        text = F.format_string("%d", tenths.cast("long"))
    else:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        scaled = x * 10.0
        rest = (high * 10.0 - scaled) + (x - high) * 10.0
        over = scaled - F.floor(scaled)  # beside 0.5 the remainder decides
        tenths = F.floor(scaled) + F.when((over > 0.5) | ((over == 0.5) & (rest > 0)) | ((over == 0.5) & (rest == 0) & (F.floor(scaled) % 2 == 1)), 1).otherwise(0)
        text = F.format_string("%d.%d", F.floor(tenths / 10), tenths % 10)
    # Beyond these a double has no decimals.
    plain = F.when(x < 2.0**49, F.concat(F.when(below, "-").otherwise(""), text))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), F.when(below, "-inf").otherwise("inf"))
    return F.when(c.isNotNull(), F.coalesce(plain, odd, F.format_string(f"%.{digits}f", c.cast("double"))))


def percent(p: Column, digits: int = 0) -> Column:
    return F.concat(fixed(p * 100, digits), F.lit("%"))


#: What headlines are made of.
NONE = "No breach threshold available for this borehole — fan shown without a breach probability."
TAG = "  Indicative — uncalibrated."
PROXY = " (proxy threshold)"
CHANCE = " chance of breaching "
CROSSING = "; median first crossing "
REST = " of members do not cross."
SAMPLED = "sampled trajectories"
WITHIN = " within the {}-day operational window)"


def headline(source: Column, threshold: Column, days: Column, p: Column, p_window: Column, samples: Column, members: Column, first: Column, early: Column, late: Column, censored: Column, window: int = 14) -> Column:
    """A sentence on the chance of a breach, the first crossing and its quartiles. Nothing crossing is told as less than one in the samples."""
    note = F.when(source == "gw_p90_proxy", PROXY).otherwise("")
    tag = F.lit(TAG)
    at = F.concat(fixed(threshold, 1), F.format_string(" mAOD within %d days", days.cast("int")))
    n = F.coalesce(samples.cast("double"), members.cast("double"), F.lit(51.0))
    basis = F.when(samples.isNotNull(), SAMPLED).otherwise("members")
    never = F.concat(F.lit("<"), percent(F.greatest(1 / n, F.lit(0.001)), 1), F.lit(CHANCE), at, note, F.lit("; no "), basis, F.lit(" cross."), tag)
    within = F.when((days > window) & p_window.isNotNull(), F.concat(F.lit(" ("), percent(p_window), F.lit(WITHIN.format(window)))).otherwise("")
    some = F.concat(percent(p), F.lit(CHANCE), at, within, note, F.lit(CROSSING), iso_day(first), F.lit(" (P25–P75: "), iso_day(early), F.lit("–"), iso_day(late), F.lit("). "), percent(censored), F.lit(REST), tag)
    none = F.lit(NONE)
    return F.when((source == "none") | source.isNull() | threshold.isNull(), none).when(p <= 0, never).otherwise(some)
