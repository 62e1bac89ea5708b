"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from diurna.schema import DEVICE_LABELS


def trim_or_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def first_non_blank(a: Column, b: Column) -> Column:
    return F.coalesce(trim_or_null(a), trim_or_null(b))


def normalize_label(x: Column) -> Column:
    """Upper case without anything but A-Z and 0-9; null gives ''."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def signal_of_label(label: Column) -> Column:
    """The signal of a device label, or null."""
    pairs = [F.lit(x) for kv in DEVICE_LABELS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), normalize_label(label))


def parse_double(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def parse_offset_time(x: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.fraction] +HH:MM`` of any fraction up to nine digits, to microseconds; null if malformed."""
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:\.(\d{0,9}))? ([+-]\d{2}:\d{2}|Z)$"
    x = F.trim(x)
    fraction = F.rpad(F.substring(F.regexp_extract(x, pattern, 2), 1, 6), 6, "0")
    whole = F.concat(F.regexp_extract(x, pattern, 1), F.lit("."), fraction, F.lit(" "), F.regexp_extract(x, pattern, 3))
    return F.when(x.rlike(pattern), F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS XXX")))


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def lerp(a: float, b: float, s: Column) -> Column:
    return F.lit(a) + F.lit(b - a) * s


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def hop_start(millis: Column, hop: int) -> Column:
    return F.floor(millis / hop) * hop


def hour_text(hour: Column) -> Column:
    """hh:mm; minutes that round to 60 carry."""
    minutes = F.pmod(round_half_up(hour * 60), F.lit(1440)).cast("int")
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)))


def html_escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def spaces_for_underscores(x: Column) -> Column:
    return F.replace(x, F.lit("_"), F.lit(" "))


def hex_byte(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), round_half_up(x))).cast("long")), 2, "0"))


def patient_name(n: Column) -> Column:
    return F.format_string("P%04d", n)


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def split_key(x: Column) -> Column:
    return F.split(x, r"\|", 2)


def mixed_seed(seed: Column, patient: Column, ordinal: Column, salt: int) -> Column:
    """Fixed formula of the series' seeds."""
    return seed * 1_000_003 + patient * 9176 + ordinal * 131 + salt


def log_grid(low: float, high: float, voices: int) -> Column:
    """Periods low * 2^(j / voices), up to high."""
    n = F.floor(F.lit(voices) * F.log2(F.lit(high / low)) + 1e-12).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda j: F.lit(low) * F.pow(F.lit(2.0), j / F.lit(float(voices))))


def matches_any(wanted: Column, value: Column) -> Column:
    """Whether a list names a value, or all; case doesn't matter."""
    return F.exists(wanted, lambda x: F.lower(x).isin("all") | (F.lower(x) == F.lower(value)))


def kelvin_rgb(kelvin: Column, clamped: bool = True) -> tuple[Column, Column, Column]:
    """Red, green and blue (0 to 255, not rounded) of a colour temperature; a published fit by black-body data."""
    k = (F.greatest(F.lit(1000.0), F.least(F.lit(40000.0), kelvin)) if clamped else kelvin) / 100
    red = F.when(k <= 66, 255.0).otherwise(329.698727446 * F.pow(k - 60, F.lit(-0.1332047592)))
    green = F.when(k <= 66, 99.4708025861 * F.log(k) - 161.1195681661).otherwise(288.1221695283 * F.pow(k - 60, F.lit(-0.0755148492)))
    blue = F.when(k >= 66, 255.0).when(k <= 19, 0.0).otherwise(138.5177312231 * F.log(k - 10) - 305.0447927307)
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)) for c in (red, green, blue))
