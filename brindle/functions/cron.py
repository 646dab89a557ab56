"""Five-field cron expressions as column predicates over UTC timestamps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest and highest value of minute, hour, day of month, month and day of week (7 is Sunday too).
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


@dataclass(frozen=True)
class Schedule:
    fields: tuple[frozenset[int], ...]
    any_day: bool
    any_weekday: bool

    def matches(self, minute: int, hour: int, day: int, month: int, weekday: int) -> bool:
        m, h, d, mo, w = self.fields
        if minute not in m or hour not in h or month not in mo:
            return False
        return _days(self, day in d, weekday in w)

    def column(self, ts: Column) -> Column:
        """Whether a timestamp's minute is in the schedule. The session's time zone is to be UTC."""
        m, h, d, mo, w = (sorted(f) for f in self.fields)
        in_day, in_weekday = F.dayofmonth(ts).isin(d), (F.dayofweek(ts) - 1).isin(w)
        if self.any_day or self.any_weekday:
            days = in_day & in_weekday
        else:
            days = in_day | in_weekday
        return F.minute(ts).isin(m) & F.hour(ts).isin(h) & F.month(ts).isin(mo) & days


def _days(s: Schedule, in_day: bool, in_weekday: bool) -> bool:
    """Both restricted: either is enough. One a bare star: both must hold, and the star does."""
    return (in_day and in_weekday) if s.any_day or s.any_weekday else (in_day or in_weekday)


def _number(text: str, low: int, high: int) -> int:
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"{text!r} is no number")
    n = int(text)
    if not low <= n <= high:
        raise ValueError(f"{n} is not in {low}..{high}")
    return n


def _field(text: str, low: int, high: int) -> frozenset[int]:
    values: set[int] = set()
    for part in text.split(","):
        span, _, step_text = part.partition("/")
        step = 1
        if "/" in part:
            step = _number(step_text, 1, high + 1)
        if span == "*":
            a, b = low, high
        elif "-" in span:
            x, _, y = span.partition("-")
            a, b = _number(x, low, high), _number(y, low, high)
            if a > b:
                raise ValueError(f"{span!r} runs backwards")
        else:
            a = _number(span, low, high)
            b = high if step > 1 else a  # a step of 1 behind a single number leaves it single
        values.update(range(a, b + 1, step))
    return frozenset(values)


def parse(expression: str) -> Schedule:
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError("a cron expression has five fields")
    fields = [_field(p, a, b) for p, (a, b) in zip(parts, RANGES, strict=True)]
    if 7 in fields[4]:
        fields[4] = fields[4] - {7} | {0}
    return Schedule(tuple(fields), parts[2] == "*", parts[4] == "*")
