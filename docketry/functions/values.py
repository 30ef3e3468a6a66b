"""Dates, money and numbers as their writers print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import filled


def money(c: Column) -> Column:
    """``$1,234.50`` as decimal(18,2); null for what is no amount."""
    return F.regexp_replace(F.trim(c), "[$,]", "").try_cast("decimal(18,2)")


def whole(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def day_or_text(c: Column) -> Column:
    """Dates in four spellings to ISO; anything else stays as it is. Years of two digits run from 1969 to 2068."""
    two = F.try_to_timestamp(c, F.lit("M/d/yy")).cast("date")
    two = F.when(F.year(two) > 2068, F.add_months(two, -1200)).otherwise(two)
    tries = [F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yyyy")]
    us = F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), tries[1])
    iso = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(c, F.lit("yyyy-M-d")).cast("date"))
    dash = F.when(c.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_timestamp(c, F.lit("M-d-yyyy")).cast("date"))
    return F.coalesce(F.date_format(F.coalesce(iso, us, F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), two), dash), "yyyy-MM-dd"), c)


def iso_prefix(c: Column) -> Column:
    """First ten characters where they are an ISO date, else null."""
    head = F.left(F.trim(c), F.lit(10))
    shaped = head.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(shaped & F.try_to_timestamp(F.when(shaped, head), F.lit("yyyy-MM-dd")).isNotNull(), head)


def epoch_or_iso(c: Column) -> Column:
    """All digits: seconds since 1970, or milliseconds from 13 digits on; else an ISO stamp, UTC if it names no zone."""
    n = F.when(c.rlike(r"^\d{1,18}$"), c.try_cast("bigint"))
    return F.coalesce(F.timestamp_millis(F.when(F.length(c) >= 13, n)), F.timestamp_seconds(F.when(F.length(c) < 13, n)), F.try_to_timestamp(F.when(n.isNull(), filled(c))))


def add_duration(day: Column, unit: Column, n: Column) -> Column:
    """Calendar days, months or years later; month ends are clamped. Null for another unit."""
    return F.when(unit == "days", F.date_add(day, n)).when(unit == "months", F.add_months(day, n)).when(unit == "years", F.add_months(day, n * 12))


#: Spellings of days as people type them into forms, in the order in which they are tried: (shape, format). Months alone mean their first day.
_TYPED = (
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"), (r"\d{1,2}/\d{1,2}/\d{2}", "M/d/yy"), (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"), (r"\d{1,2}-\d{1,2}-\d{2}", "M-d-yy"),
    (r"[A-Za-z]{4,} \d{1,2},? \d{4}", "MMMM d yyyy"), (r"[A-Za-z]{3} \d{1,2},? \d{4}", "MMM d yyyy"), (r"\d{1,2} [A-Za-z]{4,} \d{4}", "d MMMM yyyy"), (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"[A-Za-z]{4,} \d{4}", "MMMM yyyy"), (r"[A-Za-z]{3} \d{4}", "MMM yyyy"),
)


def typed_day(c: Column) -> Column:
    """Struct (value, warning) of a day in one of twelve spellings as ISO; other text stays as it is, with a warning. Years of two digits run from 1969 to 2068."""
    t = F.trim(c)
    plain = F.initcap(F.replace(t, F.lit(","), F.lit("")))
    found = []
    for shape, form in _TYPED:
        day = F.try_to_timestamp(F.when(t.rlike(f"^{shape}$"), plain), F.lit(form)).cast("date")
        found.append(F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day) if form.endswith("-yy") or form.endswith("/yy") else day)
    iso = F.date_format(F.coalesce(*found), "yyyy-MM-dd")
    warning = F.when(F.coalesce(t, F.lit("")) == "", F.lit(None)).when(iso.isNull(), "unreadable").when(iso != t, "interpreted")
    return F.struct(F.coalesce(iso, t).alias("value"), warning.alias("warning"))


def address_text(street: Column, city: Column, state: Column, code: Column) -> Column:
    """A postal address as lines; what is missing leaves no gap."""
    return F.concat_ws("\n", filled(street), filled(F.concat_ws(", ", filled(city), filled(state), filled(code))))
