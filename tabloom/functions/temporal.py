"""Date and time features."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, functions as F

# Names of the months, in order.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_NAME = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS).replace("sep(?:tember)?", "sep(?:t(?:ember)?)?") + ")[.]?"
# of lower-case texts: hour and minute, then perhaps seconds with a fraction, AM or PM, a zone
_TIME = r"(?:(?:t| *, *| +)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?(?: *([ap]m))?(?: *(z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}))?)?$"
#: Shapes of dates: pattern, and which of its three groups are year, month and day. A separator stands in a group of its own.
SHAPES = {
    "iso": (r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})", (1, 3, 4), 4),
    "numeric": (r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})", (4, 1, 3), 4),
    "compact": (r"^((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})", (1, 2, 3), 3),
    "day_name": (r"^([0-9]{1,2})[ -]" + _NAME + "[ -]([0-9]{4})", (3, 2, 1), 3),
    "name_day": (r"^" + _NAME + " ([0-9]{1,2}),? ([0-9]{4})", (3, 1, 2), 3),
}
LONGEST = 48
_MARK = "\u0001"
# Units per second of numeric epochs.
EPOCH_UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


@dataclass(frozen=True)
class DateTimeConfig:
    enable_components: bool = True
    enable_cyclical: bool = True
    enable_derived: bool = True


@dataclass(frozen=True)
class TemporalParams:
    column: str
    kind: str  # "timestamp", "string" or "epoch"
    epoch_unit: str | None
    min_ts: datetime | None
    has_null: bool
    day_first: bool = False


def _may_be_date(lower: Column) -> Column:
    """A quick look that spares most texts the patterns: a digit or a month at the beginning, and a year somewhere."""
    begins = "^(?:[0-9]|" + "|".join(m[:3] for m in MONTHS) + ")"
    return F.char_length(lower).between(8, LONGEST) & lower.rlike(begins) & lower.rlike("[0-9]{4}")


def date_shape(text: Column) -> Column:
    """Name of the shape a text has, null for none; texts that begin neither with a digit nor a month are not looked at."""
    t = F.lower(F.trim(text))
    found = F.lit(None).cast("string")
    for name, (pattern, _, _) in reversed(SHAPES.items()):
        found = F.when(t.rlike(pattern + _TIME), F.lit(name)).otherwise(found)
    return F.when(_may_be_date(t), found)


def parse_text(text: Column, day_first: bool = False) -> Column:
    """Timestamp of a text in one of the known shapes, else null. Of two numbers before a year the first is the month
    (the day with ``day_first``), unless only the other reading gives a month. Fractions of a second count to the
    microsecond. Without a zone the time is the session's.

    Every shape's head is rewritten to one form (shape, year, month, day), so one pattern takes all texts apart, once.
    """
    t = F.lower(F.trim(text))
    head = t
    for name, (pattern, (year, month, day), _) in SHAPES.items():
        head = F.regexp_replace(head, pattern, f"{name[0]}{_MARK}${year}{_MARK}${month}{_MARK}${day}{_MARK}")
    fields = rf"^([a-z]){_MARK}([0-9]{{4}}){_MARK}([a-z0-9.]+){_MARK}([0-9]{{1,2}}){_MARK}" + _TIME
    taken = F.split(F.regexp_replace(head, fields, _MARK.join(["", *(f"${i}" for i in range(1, 11))])), _MARK)

    def made(p: Column) -> Column:
        named = F.ceil(F.instr(F.lit(",".join(x[:3] for x in MONTHS)), F.substring(p[3], 1, 3)) / 4).cast("int")
        m, d = F.coalesce(p[3].try_cast("int"), named), p[4].cast("int")
        # in the numeric shape the two may be the other way round
        turned = (p[1] == "n") & (~((d > 12) & (m <= 12)) if day_first else (m > 12) & (d <= 12))
        half, zone = p[9], p[10]
        h = F.coalesce(p[5].try_cast("int"), F.lit(0))
        h = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "pm", 12).otherwise(0))
        seconds = F.concat(F.when(p[7] == "", "00").otherwise(p[7]), F.lit("."), F.rpad(F.substring(p[8], 1, 6), 6, "0")).try_cast("decimal(16,6)")
        offset = F.when(zone.rlike("^[+-]"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, -2, 2))).when(zone == "", F.current_timezone()).otherwise("UTC")
        return F.try_make_timestamp(p[2].cast("int"), F.when(turned, d).otherwise(m), F.when(turned, m).otherwise(d), h, F.coalesce(p[6].try_cast("int"), F.lit(0)), seconds, offset)

    # the list of at most one list of fields binds them, so that no field is looked for twice
    parsed = F.get(F.transform(F.filter(F.array(taken), lambda p: F.size(p) == 11), made), F.lit(0))
    return F.when(_may_be_date(t), parsed)


def day_first_votes(text: Column) -> tuple[Column, Column]:
    """Numbers of texts that can only be read day first, and only month first: they decide how a column is read."""
    t = F.trim(text)
    numeric = SHAPES["numeric"][0]
    first, second = (F.regexp_extract(t, numeric, i).try_cast("int") for i in (1, 3))
    return F.count_if((first > 12) & (second <= 12)), F.count_if((second > 12) & (first <= 12))


def parse_epoch(value: Column, unit: str) -> Column:
    micros = value.cast("double") * F.lit(1_000_000 / EPOCH_UNITS[unit])
    # timestamps end in year 9999; larger numbers are no dates
    return F.when(F.abs(micros) < F.lit(2.5e17), F.timestamp_micros(micros.cast("bigint")))


def parse(col: Column, kind: str, epoch_unit: str | None = None, day_first: bool = False) -> Column:
    if kind == "epoch":
        return parse_epoch(col, epoch_unit or "s")
    if kind == "string":
        return parse_text(col, day_first)
    return col.cast("timestamp")


def components(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "dayofweek": F.weekday(ts),
        "dayofyear": F.dayofyear(ts),
        "quarter": F.quarter(ts),
    }


def cyclical(ts: Column) -> dict[str, Column]:
    def pair(prefix: str, value: Column, period: int) -> dict[str, Column]:
        angle = F.lit(2 * math.pi) * value / F.lit(period)
        return {f"{prefix}_sin": F.sin(angle), f"{prefix}_cos": F.cos(angle)}

    return {**pair("month", F.month(ts), 12), **pair("dow", F.weekday(ts), 7), **pair("hour", F.hour(ts), 24)}


def boundaries(ts: Column) -> dict[str, Column]:
    day = F.to_date(ts)
    return {
        "is_weekend": F.coalesce(F.weekday(ts) >= 5, F.lit(False)).cast("int"),
        "is_month_start": F.coalesce(F.dayofmonth(ts) == 1, F.lit(False)).cast("int"),
        "is_month_end": F.coalesce(day == F.last_day(ts), F.lit(False)).cast("int"),
        "is_quarter_start": F.coalesce(day == F.trunc(day, "quarter"), F.lit(False)).cast("int"),
        "is_year_start": F.coalesce(F.dayofyear(ts) == 1, F.lit(False)).cast("int"),
    }


def days_since(ts: Column, start: Column) -> Column:
    return F.floor((F.unix_micros(ts.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000))


def datetime_features(
    params: TemporalParams, config: DateTimeConfig, ts: Column | None = None, source: Column | None = None
) -> dict[str, Column]:
    """All outputs for one date column. ``ts`` is the parsed timestamp if it is at hand."""
    name = params.column
    raw = source if source is not None else F.col(name)
    ts = ts if ts is not None else parse(raw, params.kind, params.epoch_unit, params.day_first)
    out: dict[str, Column] = {}
    if config.enable_components:
        out.update({f"{name}_{k}": v for k, v in components(ts).items()})
    if config.enable_cyclical:
        out.update({f"{name}_{k}": v for k, v in cyclical(ts).items()})
    if config.enable_derived:
        out.update({f"{name}_{k}": v for k, v in boundaries(ts).items()})
        if params.min_ts is not None:
            out[f"{name}_days_since_min"] = days_since(ts, F.lit(params.min_ts))
    if params.has_null:
        out[f"{name}_was_missing"] = raw.isNull().cast("int")
    return out
