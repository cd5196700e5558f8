"""Column expressions: time, text and parsing. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schemas import SEVERITIES, STATION_STATUSES

UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def epoch_ms(ts: Column | str) -> Column:
    return F.unix_millis(ts)


def truncate_ms(ts: Column) -> Column:
    """Drop sub-millisecond digits: all rule arithmetic is in epoch milliseconds."""
    return F.timestamp_millis(F.unix_millis(ts))


def floor_to(ms: Column, width: int) -> Column:
    """Start of the epoch-aligned cell of ``width`` that holds ``ms`` (also before 1970)."""
    return ms - F.pmod(ms, F.lit(width))


def div(value: Column, width: int) -> Column:
    """Integral floor division that never passes through a double."""
    return F.call_function("div", floor_to(value, width), F.lit(width))


def is_blank(text: Column) -> Column:
    return text.rlike(r"^\s*$")


def iso_instant(ts: Column) -> Column:
    """``2026-09-26T10:00:00Z``, with three fraction digits only when they are not zero."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    millis = F.pmod(F.unix_millis(ts), F.lit(1000))
    pattern = "yyyy-MM-dd'T'HH:mm:ss"
    return F.when(millis == 0, F.date_format(utc, pattern + "'Z'")).otherwise(
        F.date_format(utc, pattern + ".SSS'Z'")
    )


def json_object(**entries: Column) -> Column:
    """Ordered JSON object text; nulls are kept as JSON nulls."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in entries.items()]), {"ignoreNullFields": "false"})


def with_json_entry(obj: Column, name: str, value: Column) -> Column:
    """Append one scalar entry to JSON object text."""
    body = F.rtrim(F.coalesce(obj, F.lit("{}")))
    head = F.substring(body, F.lit(1), F.length(body) - 1)
    comma = F.when(F.rtrim(head) == "{", F.lit("")).otherwise(F.lit(","))
    return F.concat(head, comma, F.lit(f'"{name}":'), value.cast("string"), F.lit("}"))


def stable_uuid(*parts: Column) -> Column:
    """UUID-shaped digest: the same parts give the same id on every replay."""
    digest = F.md5(F.concat_ws("|", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def parse_severity(text: Column) -> Column:
    """Upper-cased severity; null, blank and unknown become WARNING."""
    return F.when(F.upper(text).isin(SEVERITIES), F.upper(text)).otherwise(F.lit("WARNING"))


def parse_station_status(text: Column) -> Column:
    """Upper-cased status; null and blank become ONLINE, unknown becomes null (a defect)."""
    return (
        F.when(text.isNull() | is_blank(text), F.lit("ONLINE"))
        .when(F.upper(text).isin(STATION_STATUSES), F.upper(text))
    )


def to_fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of a non-negative double, rounded on its exact binary value, ties upward.

    ``format_string`` rounds the shortest decimal form instead, so 1.005 (really 1.00499...) would
    print as 1.01. ``middle`` is the double nearest to the midpoint between two neighbouring
    results; on equality the sign of the rounding error of ``middle`` decides. That error comes
    from an exact product split in two halves.
    """
    scale = 10 ** digits
    lower = F.floor(value * F.lit(float(scale)) + F.lit(0.5)) - 1
    odd = (2 * lower + 1).cast("double")

    def beyond(odd_number: Column) -> Column:
        middle = odd_number / F.lit(2.0 * scale)
        shifted = middle * F.lit(134217729.0)
        high = shifted - (shifted - middle)
        product = middle * F.lit(2.0 * scale)
        error = (high * F.lit(2.0 * scale) - product) + (middle - high) * F.lit(2.0 * scale)
        return (value > middle) | ((value == middle) & ((product - odd_number) + error >= 0))

    # the true result is one of lower, lower + 1, lower + 2
    n = F.when(beyond(odd + 2), lower + 2).when(beyond(odd), lower + 1).otherwise(lower)
    whole = F.call_function("div", n, F.lit(scale)).cast("string")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(n, F.lit(scale)).cast("string"), digits, "0"))
