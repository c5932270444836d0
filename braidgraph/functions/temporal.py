"""The temporal contract: instants with a precision, spans, overlaps and the calendar spine.

The session's time zone is taken to be UTC, as instants without a zone are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidgraph.functions.binding import let

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$"


def parse(value: Column) -> Column:
    """struct<instant timestamp, precision string>; null where nothing is parsed."""
    return let(F.trim(value), _parsed)


def _parsed(v: Column) -> Column:
    precision = F.when(v.rlike(r"^\d{4}$"), "year").when(v.rlike(r"^\d{4}-\d{2}$"), "month").when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(v.rlike(_ISO), "time")
    # the first day of a year or month stands for it
    instant = F.concat(v, F.when(F.length(v) == 4, "-01-01").when(F.length(v) == 7, "-01").otherwise("")).try_cast("timestamp")
    return F.when(precision.isNotNull() & instant.isNotNull(), F.struct(instant.alias("instant"), precision.alias("precision")))


def period_end(instant: Column, precision: Column) -> Column:
    """The last microsecond of the period that an instant of this precision names."""
    step = lambda unit: instant + F.expr(f"INTERVAL 1 {unit}") - F.expr("INTERVAL 1 MICROSECOND")
    return F.when(precision == "year", step("YEAR")).when(precision == "month", step("MONTH")).when(precision == "day", step("DAY")).otherwise(instant)


def canonical(instant: Column, precision: Column) -> Column:
    day = F.date_format(instant, "yyyy-MM-dd")
    return F.when(precision == "year", F.date_format(instant, "yyyy")).when(precision == "month", F.date_format(instant, "yyyy-MM")).when(precision == "day", day).otherwise(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"))


def span(occurred_start: Column, occurred_end: Column, recorded_at: Column) -> Column:
    """struct<start, end, recorded, precision>; null if none of the three parses.

    The end is the explicit one widened to its period, else the start widened.
    """

    def made(p: Column) -> Column:
        s, e, r = p["s"], p["e"], p["r"]
        end = F.coalesce(period_end(e["instant"], e["precision"]), period_end(s["instant"], s["precision"]))
        out = F.struct(s["instant"].alias("start"), end.alias("end"), r["instant"].alias("recorded"), F.coalesce(s["precision"], e["precision"], r["precision"]).alias("precision"))
        return F.when(s.isNotNull() | e.isNotNull() | r.isNotNull(), out)

    return let(F.struct(parse(occurred_start).alias("s"), parse(occurred_end).alias("e"), parse(recorded_at).alias("r")), made)


def overlaps(item: Column, window_start: Column | None = None, window_end: Column | None = None) -> Column:
    """Whether a span touches a window whose sides may be open; a given end is widened."""

    def touches(s: Column) -> Column:
        start, end = F.coalesce(s["start"], s["recorded"]), F.coalesce(s["end"], s["recorded"], s["start"])
        dated = start.isNotNull()
        if window_start is not None:
            dated = dated & (end >= parse(window_start)["instant"])
        if window_end is not None:
            w = parse(window_end)
            dated = dated & (start <= period_end(w["instant"], w["precision"]))
        return F.coalesce(dated, F.lit(False))

    return let(item, touches)


def sort_key(item: Column) -> Column:
    return F.coalesce(item["start"], item["recorded"], F.lit("0001-01-01 00:00:00").cast("timestamp"))


def spine_id(instant: Column, granularity: str = "day") -> Column:
    form = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "time": "yyyy-MM-dd"}[granularity]
    return F.concat(F.lit("t:"), F.date_format(instant, form))


def spine_chain(instant: Column, precision: Column) -> Column:
    """Ids of year, month and day, as deep as the precision goes."""
    depth = F.when(precision == "year", 1).when(precision == "month", 2).otherwise(3)
    return F.slice(F.array(spine_id(instant, "year"), spine_id(instant, "month"), spine_id(instant, "day")), F.lit(1), depth)


def metadata(occurred_start: Column, occurred_end: Column, recorded_at: Column) -> Column:
    """Map of the normalised values; absent keys are left out."""
    shown = lambda c: canonical(parse(c)["instant"], parse(c)["precision"])
    pairs = F.create_map(F.lit("occurred_start"), shown(occurred_start), F.lit("occurred_end"), shown(occurred_end), F.lit("recorded_at"), shown(recorded_at))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())
