"""Tail models fitted anew for every day on the days before it, without a copy of the past for each day.

Everything that a model asks of a past ("how many days before t have a volatility in this range and movements up to these?") is
a count of points below bounds in two to four dimensions. One static structure of an instrument's days answers such counts for
all days at once; quantiles are found by halving ranks, the cheapest pair of buffers by a walk along the grid's staircase.
Work grows with n log^d n of an instrument's n days (some 250 a year), not with their square; instruments are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.workflows import TailModel

OUTCOMES = ("RECOMMENDED", "ABSTAIN", "INSUFFICIENT_HISTORY")


class Counts:
    """Points with whole coordinates; counts of those below bounds in every dimension.

    The points of a group, in order of the first coordinate, are split into blocks of every power of two; those below a bound
    are a prefix of the order, and so at most one block of each size, in which the other coordinates are counted alike.
    """

    def __init__(self, coordinates: list[np.ndarray], group: np.ndarray | None = None):
        n = len(coordinates[0])
        group = np.zeros(n, np.int64) if group is None else group
        self.width = int(max((c.max(initial=0) for c in coordinates), default=0)) + 2
        order = np.lexsort((coordinates[0], group))
        self.key = (group * self.width + coordinates[0])[order]
        self.blocks: list[Counts] = []
        if len(coordinates) > 1:
            group, rest = group[order], [c[order] for c in coordinates[1:]]
            place = np.arange(n)
            largest = int(np.bincount(group).max(initial=0)) if n else 0
            for level in range(largest.bit_length()):
                self.blocks.append(Counts(rest, group + ((place - group) >> level << level)))

    def below(self, bounds: list[np.ndarray], group: np.ndarray | None = None) -> np.ndarray:
        """For each row of bounds, the points (of a group, named by where it begins) with every coordinate under its bound."""
        group = np.zeros(len(bounds[0]), np.int64) if group is None else group
        bound = np.minimum(np.maximum(bounds[0], 0), self.width - 1)
        prefix = np.searchsorted(self.key, group * self.width + bound) - np.searchsorted(self.key, group * self.width)
        if len(bounds) == 1:
            return prefix
        out = np.zeros(len(prefix), np.int64)
        for level, block in enumerate(self.blocks):
            has = np.flatnonzero((prefix >> level) & 1)
            if len(has):
                at = group[has] + ((prefix[has] >> (level + 1)) << (level + 1))
                out[has] += block.below([b[has] for b in bounds[1:]], at)
        return out


def _first(n: int, enough: Callable[[np.ndarray], np.ndarray], queries: int) -> np.ndarray:
    """For each query the least number in [0, n] for which `enough` holds (it holds from there on); n if for none below."""
    low, high = np.zeros(queries, np.int64), np.full(queries, n)
    while (low < high).any():
        middle = (low + high) // 2
        fits = enough(middle)
        open_ = low < high
        high = np.where(open_ & fits, middle, high)
        low = np.where(open_ & ~fits, middle + 1, low)
    return low


def _higher(n: np.ndarray, q: float) -> np.ndarray:
    return np.maximum(1, np.ceil(n * q)).astype(np.int64)


class Past:
    """An instrument's days in order: movements up and down and the volatility (NaN where it isn't valid)."""

    def __init__(self, up: np.ndarray, down: np.ndarray, iv: np.ndarray):
        self.day = np.arange(len(up))
        self.known = np.isfinite(iv)
        self.values = {"up": np.unique(up), "down": np.unique(down), "iv": np.unique(iv[self.known])}
        self.ranks = {"up": np.searchsorted(self.values["up"], up), "down": np.searchsorted(self.values["down"], down)}
        # Days without a volatility lie above all others, and so in no range of volatilities.
        self.ranks["iv"] = np.where(self.known, np.searchsorted(self.values["iv"], np.where(self.known, iv, 0)), len(self.values["iv"]))
        self.made: dict[tuple[str, ...], Counts] = {}

    def count(self, upto: np.ndarray, volatility: tuple[np.ndarray, np.ndarray] | None, **bounds: np.ndarray) -> np.ndarray:
        """Of each row's first `upto` days, those with ranks under the bounds and a volatility rank in [from, to)."""
        names = tuple(bounds)
        if volatility is None:
            return self._counts(names).below([upto, *bounds.values()])
        counts = self._counts(("iv", *names))
        return counts.below([upto, volatility[1], *bounds.values()]) - counts.below([upto, volatility[0], *bounds.values()])

    def _counts(self, names: tuple[str, ...]) -> Counts:
        if names not in self.made:
            self.made[names] = Counts([self.day, *(self.ranks[n] for n in names)])
        return self.made[names]

    def quantile(self, side: str, q: float, upto: np.ndarray, volatility: tuple[np.ndarray, np.ndarray] | None, n: np.ndarray) -> np.ndarray:
        """The rank of the higher q-quantile of each row's days (n of them, 1 or more)."""
        k = _higher(n, q)
        return _first(len(self.values[side]), lambda r: self.count(upto, volatility, **{side: r + 1}) >= k, len(upto))

    def buffered(self, m: TailModel, upto: np.ndarray, volatility: tuple[np.ndarray, np.ndarray] | None, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances up and down: the quantiles with the cheapest buffers that cover the target together; NaN where none does."""
        base = {s: self.values[s][self.quantile(s, m.quantile, upto, volatility, n)] for s in ("up", "down")}
        steps, target = round(m.buffer_max / m.buffer_step), m.target or m.quantile
        rows = len(upto)
        bound = {}
        for s, values in (("up", self.values["up"]), ("down", self.values["down"])):
            # Rank bounds for each buffer: values whose cell on the grid, the least buffer that covers them, is not larger.
            cell = lambda r, c, values=values, s=s: np.ceil((values[np.minimum(r, len(values) - 1)] - base[s]) / m.buffer_step) > c
            bound[s] = np.stack([_first(len(values), lambda r, c=c: cell(r, c), rows) for c in range(steps + 1)])
        at, best = np.arange(rows), np.full(rows, np.iinfo(np.int64).max)
        u, d = np.zeros(rows, np.int64), np.full(rows, steps)
        while (open_ := (u <= steps) & (d >= 0)).any():
            i = at[open_]
            covered = self.count(upto[i], None if volatility is None else (volatility[0][i], volatility[1][i]), up=bound["up"][u[i], i], down=bound["down"][d[i], i])
            fits = covered / n[i] >= target
            best[i] = np.where(fits, np.minimum(best[i], ((u[i] + d[i]) << 20) + u[i]), best[i])
            d[i] -= fits
            u[i] += ~fits
        none = best == np.iinfo(np.int64).max
        bu, bd = best & ((1 << 20) - 1), (best >> 20) - (best & ((1 << 20) - 1))
        return tuple(np.where(none, np.nan, base[s] + np.where(none, 0, b) * m.buffer_step) for s, b in (("up", bu), ("down", bd)))

    def distances(self, m: TailModel, upto: np.ndarray, volatility: tuple[np.ndarray, np.ndarray] | None, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if m.kind.startswith("buffered"):
            return self.buffered(m, upto, volatility, n)
        return tuple(self.values[s][self.quantile(s, m.quantile, upto, volatility, n)] for s in ("up", "down"))

    def recommend(self, m: TailModel, day: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(up, down, regime) for each asked day (its number) with its first `upto` days as past; NaN and None where the model abstains."""
        up, down = np.full(len(day), np.nan), np.full(len(day), np.nan)
        regime = np.full(len(day), None, object)
        if not m.kind.endswith(("iv", "iv_regime")):
            has = np.flatnonzero(upto > 0)
            up[has], down[has] = self.distances(m, upto[has], None, upto[has])
            regime[has] = "UNCONDITIONAL" if m.kind == "unconditional" else "BUFFERED"
        else:
            every = np.zeros(len(day), np.int64), np.full(len(day), len(self.values["iv"]))
            valid = self.count(upto, None, iv=every[1])
            has = np.flatnonzero(self.known[day] & (valid > 0))
            d, past, n = day[has], upto[has], valid[has]
            # The three cuts, as ranks: a volatility on a cut belongs to the upper regime.
            cuts = np.stack([_first(len(self.values["iv"]), lambda r, k=k: self.count(past, None, iv=r + 1) >= k, len(has)) for k in (_higher(n, q) for q in (0.25, 0.5, 0.75))])
            edges = np.concatenate([np.zeros((1, len(has)), np.int64), cuts, np.full((1, len(has)), len(self.values["iv"]))])
            bucket = (self.ranks["iv"][d] >= cuts).sum(0)
            own = edges[bucket, np.arange(len(has))], edges[bucket + 1, np.arange(len(has))]
            size = self.count(past, None, iv=own[1]) - self.count(past, None, iv=own[0])
            name = np.array([f"IV_Q{b + 1}" for b in bucket], object)
            told = np.flatnonzero((size >= m.min_regime_days) & (size > 0))
            u, v, r = np.full(len(has), np.nan), np.full(len(has), np.nan), np.full(len(has), None, object)
            if len(told):
                u[told], v[told] = self.distances(m, past[told], (own[0][told], own[1][told]), size[told])
                r[told] = name[told]
            left = np.flatnonzero(np.isnan(u))
            r[left] = None
            if m.allow_fallback and len(left):
                u[left], v[left] = self.distances(m, past[left], (every[0][has][left], every[1][has][left]), n[left])
                r[left] = name[left] + ("_FALLBACK" if m.kind == "iv_regime" else "_BUFFERED_FALLBACK")
            up[has], down[has], regime[has] = u, v, r
        regime[np.isnan(up)] = None
        return np.maximum(up, m.min_distance), np.maximum(down, m.min_distance), regime


def _refit(models: list[TailModel], keys: list[str], min_train: int, gap_days: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__day")
        day = rows["__day"].to_numpy()
        if len(day) and (np.diff(day) == 0).any():
            raise ValueError("a day has two rows")
        past = Past(*(rows[c].to_numpy(zero_copy_only=False).astype(float) for c in ("__up", "__down", "__iv")))
        upto = np.searchsorted(day, day - gap_days, "right")
        asked = np.flatnonzero((upto >= min_train) & (upto > 0))
        tables = []
        for m in models:
            up, down = np.full(len(day), np.nan), np.full(len(day), np.nan)
            regime = np.full(len(day), None, object)
            up[asked], down[asked], regime[asked] = past.recommend(m, asked, upto[asked])
            short = np.ones(len(day), bool)
            short[asked] = False
            outcome = np.where(short, OUTCOMES[2], np.where(np.isnan(up), OUTCOMES[1], OUTCOMES[0]))
            part = rows.select([*keys, "__day"]).append_column("model", pa.array([m.kind] * len(day))).append_column("n_train", pa.array(upto.astype(np.int64)))
            for name, x in (("outcome", pa.array(outcome.tolist(), pa.string())), ("up_distance", pa.array(up, mask=np.isnan(up))), ("down_distance", pa.array(down, mask=np.isnan(down))), ("regime", pa.array(regime.tolist(), pa.string()))):
                part = part.append_column(name, x)
            tables.append(part)
        return pa.concat_tables(tables)

    return run


def daily_recommendations(days: DataFrame, models: list[TailModel], min_train: int = 60, gap_days: int = 1, keys: list[str] | None = None) -> DataFrame:
    """days (keys, day, up_max, down_max, iv), one row a day and instrument -> for every day and model (by its kind): n_train, outcome, up_distance,
    down_distance, regime, as the model says that is fitted on the instrument's days up to gap_days before.

    Days with fewer than min_train days before them are INSUFFICIENT_HISTORY, days of which the model says nothing ABSTAIN; distances are
    null for both. Rows without a day or a movement are passed over; a day that an instrument has twice fails the job; an empty table
    gives an empty result. One task holds one instrument's days.
    """
    keys = keys or []
    rows = days.where("day IS NOT NULL AND up_max IS NOT NULL AND down_max IS NOT NULL")
    number = F.datediff(F.col("day").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = rows.select(*keys, number.cast("long").alias("__day"), F.col("up_max").cast("double").alias("__up"), F.col("down_max").cast("double").alias("__down"), F.nanvl(F.col("iv").cast("double"), F.lit(None).cast("double")).alias("__iv"))
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    shape = ", ".join([*kinds, "__day long", "model string", "n_train long", "outcome string", "up_distance double", "down_distance double", "regime string"])
    found = rows.groupBy(*keys).applyInArrow(_refit(models, keys, min_train, gap_days), shape)
    return found.select(*keys, F.date_from_unix_date(F.col("__day").cast("int")).alias("day"), "model", "n_train", "outcome", "up_distance", "down_distance", "regime")
