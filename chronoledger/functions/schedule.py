"""Five-field cron expressions as sets, and the instants they name."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from .scalars import bound

BOUNDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))


@dataclass(frozen=True)
class Cron:
    """The values each field allows; Sunday is weekday 0."""

    minute: tuple[int, ...]
    hour: tuple[int, ...]
    day: tuple[int, ...]
    month: tuple[int, ...]
    weekday: tuple[int, ...]

    def values(self) -> Column:
        """The fields as a struct of arrays, as cron_fields gives them."""
        return F.struct(*[F.array(*[F.lit(v) for v in getattr(self, name)]).alias(name) for name, _, _ in BOUNDS])

    def admits(self, instant: Column, zone_seconds: Column | int = 0) -> Column:
        """Whether an instant (epoch seconds) is named, by the wall clock of a
        zone so many seconds ahead of UTC."""
        wall = F.timestamp_seconds(instant + zone_seconds)
        within = lambda x, allowed: x.isin(*allowed)
        day, weekday = within(F.dayofmonth(wall), self.day), within(F.dayofweek(wall) - 1, self.weekday)
        # With both restricted either names the day; else the restricted one does.
        days = day | weekday if len(self.day) < 31 and len(self.weekday) < 7 else day & weekday
        return within(F.minute(wall), self.minute) & within(F.hour(wall), self.hour) & within(F.month(wall), self.month) & days


def _values(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for item in text.split(","):
        span, slash, every = item.partition("/")
        step = int(every) if slash else 1
        first, dash, last = span.partition("-")
        a, b = (low, high) if span in ("", "*") else (int(first), int(last if dash else first))
        if step < 1 or not low <= a <= b <= high:
            raise ValueError(text)
        out |= set(range(a, b + 1, step))
    return out


def parse_cron(expression: object) -> Cron | None:
    """The fields of an expression; null if it is no valid one."""
    parts = expression.split() if isinstance(expression, str) else []
    if len(parts) != len(BOUNDS):
        return None
    try:
        return Cron(*[tuple(sorted(_values(p, low, high))) for p, (_, low, high) in zip(parts, BOUNDS, strict=True)])
    except ValueError:
        return None


def minutes_between(lower: Column, upper: Column) -> Column:
    """Array of whole minutes (epoch seconds, long) from `lower` to `upper`."""
    first = (F.ceil(lower / F.lit(60.0)) * 60).cast("long")
    last = F.floor(upper).cast("long")
    return F.when(first <= last, F.sequence(first, last, F.lit(60).cast("long"))).otherwise(F.array().cast("array<bigint>"))


_FIELD = r"^(\*|\d+(-\d+)?)?(/\d+)?$"


def _allowed(text: Column, low: int, high: int) -> Column:
    """Sorted values that a field (a column of text) allows; null if it is no
    valid one."""
    def values(item: Column) -> Column:
        return bound(F.split_part(item, F.lit("/"), F.lit(1)), lambda span: bound(spanned(item, span), lambda r: F.when(good(r), F.sequence(r["first"], r["last"], r["every"]))))

    def spanned(item: Column, span: Column) -> Column:
        every = F.when(F.contains(item, F.lit("/")), F.split_part(item, F.lit("/"), F.lit(2)).try_cast("int")).otherwise(F.lit(1))
        whole = span.isin("", "*")
        first = F.when(whole, F.lit(low)).otherwise(F.split_part(span, F.lit("-"), F.lit(1)).try_cast("int"))
        last = F.when(whole, F.lit(high)).when(F.contains(span, F.lit("-")), F.split_part(span, F.lit("-"), F.lit(2)).try_cast("int")).otherwise(first)
        return F.struct((item.rlike(_FIELD) & (item != "")).alias("fits"), every.alias("every"), first.alias("first"), last.alias("last"))

    def good(r: Column) -> Column:
        return r["fits"] & (r["every"] >= 1) & (r["first"] >= low) & (r["first"] <= r["last"]) & (r["last"] <= high)

    # An item that is no valid one is null, and so is a list with such an item.
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ",", -1), values))))


def cron_fields(expression: Column) -> Column:
    """parse_cron of a column: struct of the values that each field allows; null
    for what is no valid expression, so every row may have its own."""
    def made(parts: Column) -> Column:
        fields = [_allowed(F.get(parts, F.lit(i)), low, high).alias(name) for i, (name, low, high) in enumerate(BOUNDS)]
        return F.when(F.size(parts) == len(BOUNDS), bound(F.struct(*fields), valid))

    def valid(fields: Column) -> Column:
        return F.when(reduce(and_, [fields[name].isNotNull() for name, _, _ in BOUNDS]), fields)

    # Each part is computed once, however often it is compared.
    return bound(F.split(F.trim(F.regexp_replace(expression, r"\s+", " ")), " ", -1), made)


def instants_of(cron: Column, lower: Column, upper: Column, zone_seconds: Column) -> Column:
    """The instants (epoch seconds, long) from `lower` to `upper` that `cron`
    (of cron_fields) names by the wall clock of the zone, in order: days first,
    then their hours and minutes."""
    zone = zone_seconds.cast("long")
    first, last = F.floor((lower + zone) / 86400).cast("long"), F.floor((upper + zone) / 86400).cast("long")
    days = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def named(day: Column) -> Column:
        wall = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
        of_month, of_week = F.array_contains(cron["day"], F.dayofmonth(wall)), F.array_contains(cron["weekday"], F.dayofweek(wall) - 1)
        both = (F.size(cron["day"]) < 31) & (F.size(cron["weekday"]) < 7)
        return F.array_contains(cron["month"], F.month(wall)) & F.when(both, of_month | of_week).otherwise(of_month & of_week)

    minute = lambda d, h: F.transform(cron["minute"], lambda m: d * 86400 + h * 3600 + m * 60 - zone)
    every = F.flatten(F.transform(F.filter(days, named), lambda d: F.flatten(F.transform(cron["hour"], lambda h: minute(d, h)))))
    return F.filter(every, lambda t: (t >= lower) & (t <= upper))
