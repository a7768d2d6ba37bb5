"""Lists and ranges as people write them on a command line or in a form, as columns: order stays, repeats go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tokens(spec: Column, what: str) -> Column:
    """The parts of a comma list, trimmed; none is an error."""
    found = F.transform(F.split(spec, ","), lambda t: F.trim(t))  # F.trim itself would take the index as what to trim
    found = F.filter(found, lambda t: t != "")
    return F.when(F.size(found) > 0, found).otherwise(F.raise_error(F.lit(f"{what}: at least one is required")).cast("array<string>"))


def symbols(spec: Column) -> Column:
    return F.array_distinct(F.transform(_tokens(spec, "symbols"), lambda t: F.upper(F.replace(t, F.lit("/"), F.lit("-")))))


def dates(spec: Column) -> Column:
    """Days as yyyyMMdd from days and ranges ``a..b``, both ends in; a range that runs backwards is an error."""
    day = lambda t: F.to_date(F.when(t.rlike(r"^\d{8}$"), t).otherwise(F.raise_error(F.concat(F.lit("not a date: "), t))), "yyyyMMdd")

    def days(t: Column) -> Column:
        ends = F.split(t, r"\.\.")
        first, last = day(ends[0]), day(F.coalesce(F.get(ends, F.lit(1)), ends[0]))
        whole = F.when(first <= last, F.sequence(first, last)).otherwise(F.raise_error(F.concat(F.lit("range runs backwards: "), t)).cast("array<date>"))
        return F.transform(whole, lambda d: F.date_format(d, "yyyyMMdd"))

    return F.array_distinct(F.flatten(F.transform(_tokens(spec, "dates"), days)))


def thresholds(spec: Column) -> Column:
    """Numbers in [0, 1] from a comma list or ``start:end:step``, the end in if a step meets it."""
    parts = F.transform(F.split(spec, ":"), lambda t: F.trim(t).cast("double"))
    start, end, step = parts[0], F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    steps = F.floor((end + step / 2 - start) / step).cast("int")
    ranged = F.when((F.size(parts) == 3) & (step > 0) & (steps >= 0), F.transform(F.sequence(F.lit(0), steps), lambda i: F.round(start + i * step, 10)))
    listed = F.transform(_tokens(spec, "thresholds"), lambda t: t.cast("double"))
    values = F.array_distinct(F.when(spec.contains(":"), ranged).otherwise(listed))
    good = values.isNotNull() & F.forall(values, lambda v: v.between(0, 1))
    return F.when(good, values).otherwise(F.raise_error(F.concat(F.lit("not a threshold grid in [0, 1]: "), spec)).cast("array<double>"))


def hours(spec: Column) -> Column:
    """Hours of a day from hours and ranges ``a-b``."""

    def of(t: Column) -> Column:
        ends = F.transform(F.split(t, "-"), lambda x: x.cast("int"))
        first, last = ends[0], F.coalesce(F.get(ends, F.lit(1)), ends[0])
        good = first.between(0, 23) & last.between(0, 23) & (first <= last)
        return F.when(good, F.sequence(first, last)).otherwise(F.raise_error(F.concat(F.lit("not hours of a day: "), t)).cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(_tokens(spec, "hours"), of)))
