"""Trading calendars as column expressions: days and sessions of the cash market, states of the futures market."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, time

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
OPEN, PREOPEN, CLOSE = time(9, 30), time(9, 29, 59), time(16, 0)
#: The futures market's daily break, in seconds of the New York day.
BREAK_START, BREAK_END = 17 * 3600, 18 * 3600


def _seconds(clock: time) -> int:
    return clock.hour * 3600 + clock.minute * 60 + clock.second


def clock_of(local: Column) -> Column:
    """Seconds since midnight, with fractions."""
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.date_format(local, "s.SSSSSS").cast("double")


def to_new_york(instant: Column) -> Column:
    return F.from_utc_timestamp(instant.cast("timestamp"), NEW_YORK)


def new_york_instant(day: Column, seconds: Column | int) -> Column:
    """The UTC instant of a clock time of a New York day; hours that summer time skips are read as after the gap."""
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    local = F.timestamp_seconds(F.unix_date(day) * 86400 + seconds)
    return F.to_utc_timestamp(local, NEW_YORK)


def day_window(day: Column) -> Column:
    """struct(start, end): midnight to midnight of a New York day, in UTC (23, 24 or 25 hours)."""
    return F.struct(new_york_instant(day, 0).alias("start"), new_york_instant(F.date_add(day, 1), 0).alias("end"))


@dataclass(frozen=True)
class EquityCalendar:
    """Weekdays outside the verified range fail closed. Holidays and half-days come from a maintained list."""

    verified_from: date
    verified_through: date
    holidays: frozenset[date] = frozenset()
    early_closes: Mapping[date, time] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.verified_from > self.verified_through:
            raise ValueError("verified_from must not be after verified_through")
        special = {*self.holidays, *self.early_closes}
        if any(not self.verified_from <= d <= self.verified_through for d in special):
            raise ValueError("holidays and early closes must lie in the verified range")
        if any(d.weekday() >= 5 for d in special):
            raise ValueError("holidays and early closes must be weekdays")
        if self.holidays & set(self.early_closes):
            raise ValueError("a day can't be a holiday and close early")
        if any(t >= CLOSE for t in self.early_closes.values()):
            raise ValueError("an early close is before 16:00")

    def day_status(self, day: Column) -> Column:
        verified = day.between(F.lit(self.verified_from), F.lit(self.verified_through))
        status = F.when(day.isNull(), F.lit(None).cast("string")).when(F.weekday(day) >= 5, "WEEKEND").when(~verified, "UNVERIFIED")
        if self.holidays:
            status = status.when(day.isin(*sorted(self.holidays)), "HOLIDAY")
        return status.otherwise("TRADING_DAY")

    def _close_seconds(self, day: Column) -> Column:
        c = F.lit(_seconds(CLOSE))
        for d, t in sorted(self.early_closes.items()):
            c = F.when(day == F.lit(d), _seconds(t)).otherwise(c)
        return c

    def session(self, day: Column) -> Column:
        """struct(status, opens_at, preopen_cutoff_at, closes_at, anchor_at, is_early_close); times are null but on trading
        days. A half-day is anchored to its own close."""
        status = self.day_status(day)
        on = lambda c: F.when(status == "TRADING_DAY", c)
        closes = on(new_york_instant(day, self._close_seconds(day)))
        early = (status == "TRADING_DAY") & (self._close_seconds(day) < _seconds(CLOSE))
        return F.struct(
            status.alias("status"), on(new_york_instant(day, _seconds(OPEN))).alias("opens_at"), on(new_york_instant(day, _seconds(PREOPEN))).alias("preopen_cutoff_at"),
            closes.alias("closes_at"), closes.alias("anchor_at"), early.alias("is_early_close"),
        )

    def state_at(self, instant: Column) -> Column:
        """OPEN from the opening to the closing time, both included; otherwise CLOSED, or why the day isn't one of trade."""
        local = to_new_york(instant)
        day, clock = F.to_date(local), clock_of(local)
        status = self.day_status(day)
        return F.when(status != "TRADING_DAY", status).when(clock.between(_seconds(OPEN), self._close_seconds(day)), "OPEN").otherwise("CLOSED")


@dataclass(frozen=True)
class FuturesCalendar:
    """Closed from Friday 17:00 to Sunday 18:00 New York time, with a daily break from 17:00 to 18:00."""

    verified_from: date
    verified_through: date
    closed: frozenset[date] = frozenset()

    def __post_init__(self) -> None:
        if self.verified_from > self.verified_through or any(not self.verified_from <= d <= self.verified_through for d in self.closed):
            raise ValueError("closed dates must lie in the verified range")

    def state_at(self, instant: Column) -> Column:
        local = to_new_york(instant)
        day, clock, weekday = F.to_date(local), clock_of(local), F.weekday(local)
        state = F.when(instant.isNull(), F.lit(None).cast("string")).when(~day.between(F.lit(self.verified_from), F.lit(self.verified_through)), "UNVERIFIED")
        if self.closed:
            state = state.when(day.isin(*sorted(self.closed)), "CLOSED")
        closed = (weekday == 5) | ((weekday == 4) & (clock >= BREAK_START)) | ((weekday == 6) & (clock < BREAK_END))
        return state.when(closed, "CLOSED").when((clock >= BREAK_START) & (clock < BREAK_END), "MAINTENANCE").otherwise("OPEN")
