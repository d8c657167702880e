"""Loose date parsing and the three durations. ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import HEBREW_MONTHS
from .arrays import bind

PRESENT = ("present", "current", "now", "היום", "כיום", "נוכחי")
#: Formats of loose dates, in order.
FORMATS = ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M", "yyyy/M", "M/yyyy", "M-yyyy", "M.yyyy", "MMM yyyy", "MMMM yyyy", "MMM, yyyy", "d MMM yyyy", "yyyy")
VALIDATION_FORMATS = ("yyyy", "yyyy-M-d", "yyyy-M", "MMM yyyy", "MMMM yyyy")


def _tidy(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(raw)), "[–—]", "-")


def is_present(raw: Column) -> Column:
    return _tidy(raw).isin(*PRESENT)


def _parse(text: Column, formats) -> Column:
    proper = F.initcap(text)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(proper, F.lit(f))) for f in formats])


def parse_loose(raw: Column, now: Column, default_now: bool = False) -> Column:
    """A date from '2020', 'Jan 2020', '2019-2022' (its first year), 'present', …; unparseable: null, or ``now`` if asked."""

    def parsed(t: Column) -> Column:  # of the tidied text, which the many formats then share
        return F.when(t.isin(*PRESENT), now).otherwise(_parse(F.when(t.rlike(r"^\d{4}-\d{4}$"), F.substring(t, 1, 4)).otherwise(t), FORMATS))

    found = bind(_tidy(raw), parsed)
    return F.coalesce(found, now) if default_now else found


def hebrew_months_to_numbers(raw: Column) -> Column:
    """'3 <month> 2020' and '<month> 2020' in Hebrew to 3/1/2020 and 1/2020; the day at most 28."""
    t = raw
    for i, m in enumerate(HEBREW_MONTHS, 1):  # each step names its input once, so the expression stays linear
        t = F.regexp_replace(F.regexp_replace(t, rf"(\d{{1,2}})\s+ב?{m}\s+(\d{{4}})", f"$1/{i}/$2"), rf"ב?{m}\s+(\d{{4}})", f"{i}/$1")
    return F.when(raw.rlike("[֐-׿]"), F.regexp_replace(t, r"^\s*(?:29|30|31)/(\d+/\d{4})\s*$", "28/$1")).otherwise(raw)


def parse_multilingual(raw: Column, now: Column) -> Column:
    """As :func:`parse_loose`, with Hebrew months; unparseable is null."""
    return parse_loose(hebrew_months_to_numbers(raw), now)


def parse_strict(raw: Column, now: Column) -> Column:
    """The validation parser: present words, a year, and four formats."""
    return F.when(is_present(raw), now).otherwise(_parse(_tidy(raw), VALIDATION_FORMATS))


def years_stability(start: Column, end: Column, now: Column) -> Column:
    """Days / 365.25. A null end or 'present' is now; the same bare year counts half a year; a bare end year after a month start ends on June 30; never below 0; unparseable is null."""
    year = r"^\s*\d{4}\s*$"
    s, e = parse_strict(start, now), parse_strict(end, now)
    open_end = end.isNull() | (F.lower(F.trim(end)) == "present")
    bare_s, bare_e = start.rlike(year), end.rlike(year)
    last = F.when(open_end, now).when(bare_e & ~bare_s, F.make_date(F.year(e), F.lit(6), F.lit(30))).otherwise(F.when(~F.lower(F.trim(end)).isin("current", "now", ""), e))
    days = F.datediff(last, s)
    days = F.when(days < 0, 0).otherwise(days) / 365.25
    return F.when(~open_end & bare_s & bare_e & (F.trim(start) == F.trim(end)), 0.5).otherwise(days)


def years_simple(start: Column, end: Column) -> Column:
    """Days of two dates / 365, one decimal; null unless positive."""
    y = F.round(F.datediff(end, start) / 365.0, 1)
    return F.when(y > 0, y)


def tenth(y: Column) -> Column:
    """A number of at least 0 rounded to one decimal by its exact binary value, halves to even (0.35 is below its half, 0.25 is one)."""

    def rounded(v: Column) -> Column:
        t = F.floor(v * 10.0)
        odd = (2 * t + 1).cast("double")
        half = odd / 20.0  # the double next to the half; how far it is off shows in the rest of 20 times it

        def decided(h: Column) -> Column:
            big = h * 134217729.0
            rest = bind(big - (big - h), lambda high: (high * 20.0 - h * 20.0) + (h - high) * 20.0 + (h * 20.0 - odd))
            up = F.when(v != h, v > h).otherwise(bind(rest, lambda r: F.when(r != 0, r > 0).otherwise(t % 2 == 1)))
            return F.when(up, t + 1).otherwise(t) / 10.0

        return bind(half, decided)

    return bind(y, rounded)


def years_by_months(start: Column, end: Column, now: Column) -> Column:
    """Whole months, and days over them / 30, of two dates, in years, one decimal; an open end is now; 0 without a start or for an end before it."""

    def years(span: Column) -> Column:
        s, e = span["s"], span["e"]
        days = F.dayofmonth(e) - F.dayofmonth(s)
        months = (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s)) + F.when(days > 0, days / 30.0).otherwise(0.0)
        return F.when(s.isNotNull() & (e >= s), tenth(F.greatest(months / 12.0, F.lit(0.0)))).otherwise(0.0)

    return bind(F.struct(start.alias("s"), F.coalesce(end, now).alias("e")), years)


def age_days(ts: Column, now: Column) -> Column:
    """ceil(|now - ts| / a day)."""
    return F.ceil(F.abs(F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)


def needs_recalculation(updated_at: Column, calculated_at: Column) -> Column:
    """Full recalculation if nothing was calculated yet or the job changed since."""
    return calculated_at.isNull() | (updated_at > calculated_at)
