"""The session tape: cumulative volume, turnover, trades and range of each symbol's session, read at fixed times of the day, with
what is unusual about them.

The stream keeps one state a symbol.  An event only joins the sums of its reading interval, which are few numbers whatever
the number of events; an event-time timer at the interval's end, when no earlier event can come any more, adds
them to the session so far and gives out one row.  So readings do not depend on how events are cut into files, batches or
orders.  :func:`tape_batch` gives the same rows from stored events by windows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewright.functions.scalars import clamp

#: Minutes of the day between which a session trades, by weekday (0: Monday).  Other days count as over.
SESSIONS = {0: ((570, 930),), 1: ((570, 930),), 2: ((570, 930),), 3: ((570, 930),), 4: ((555, 720), (855, 965))}


@dataclass(frozen=True)
class Limits:
    """The multiples of usual volume, the ends of the range, and the sizes that alert."""

    extreme: float = 5.0
    surge: float = 3.0
    watch: float = 2.5
    top: float = 0.85
    bottom: float = 0.15
    least_move: float = 0.005
    least_flow: float = 0.01
    least_progress: float = 0.05
    block: float = 500_000.0
    large: float = 200_000.0
    least_turnover: float = 100_000.0
    least_trades: int = 3


ALERTS = ("EXTREME_VOLUME", "HIGH_VOLUME", "RANGE_HIGH_VOLUME", "RANGE_LOW_VOLUME", "AD_BULL_DIVERGENCE", "AD_BEAR_DIVERGENCE")
READING = (
    "symbol string, session date, at timestamp, volume double, turnover double, trades long, open double, high double, low double, last double,"
    " prior_close double, usual_volume double, progress double, volume_ratio double, range_position double, flow double, alerts string"
)


def progress_at(weekday: int, minute: float, sessions: dict = SESSIONS) -> float:
    """Share of the session that is over: 0.01 up to its start, 1 from its end on and on days without one."""
    parts = sessions.get(weekday)
    if not parts:
        return 1.0
    if minute <= parts[0][0]:
        return 0.01
    return min(1.0, sum(min(max(minute - a, 0.0), b - a) for a, b in parts) / sum(b - a for a, b in parts))


def progress(at: Column, sessions: dict = SESSIONS) -> Column:
    """:func:`progress_at` of a time; a reading at midnight is the end of the day before."""
    day = F.weekday(at - F.expr("INTERVAL 1 SECOND"))
    minute = F.hour(at) * 60 + F.minute(at) + F.when((F.hour(at) == 0) & (F.minute(at) == 0), 1440).otherwise(0)
    out = F.lit(1.0)
    for weekday, parts in sessions.items():
        total = float(sum(b - a for a, b in parts))
        done = sum((F.least(F.greatest(minute - a, F.lit(0)), F.lit(b - a)) for a, b in parts), F.lit(0))
        own = F.when(minute <= parts[0][0], 0.01).otherwise(F.least(F.lit(1.0), done / total))
        out = F.when(day == weekday, own).otherwise(out)
    return out


def tape_events(events: DataFrame, usual: DataFrame) -> DataFrame:
    """(symbol, ts, event_id, price, size, usual_volume) of events (of any kind; ``props.k`` is the size) with a static usual volume for each symbol."""
    e = events.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"))
    return e.join(usual.select("symbol", "usual_volume"), "symbol", "left")


@dataclass
class _Session:
    """What a session came to so far."""

    day: dt.date | None = None
    volume: float = 0.0
    turnover: float = 0.0
    trades: int = 0
    open: float = 0.0
    high: float = float("-inf")
    low: float = float("inf")
    last: float = 0.0
    prior_close: float | None = None
    usual: float | None = None
    flow: float = 0.0
    fired: list = field(default_factory=list)

    KIND = (
        "day date, volume double, turnover double, trades long, open double, high double, low double, last double, prior_close double, usual double,"
        " flow double, fired array<string>"
    )

    def values(self) -> tuple:
        return (self.day, self.volume, self.turnover, self.trades, self.open, self.high, self.low, self.last, self.prior_close, self.usual, self.flow, self.fired)


class _Tape(StatefulProcessor):
    def __init__(self, every: int, limits: Limits, sessions: dict):
        self.every, self.limits, self.sessions = every, limits, sessions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _Session.KIND)
        self.parts = handle.getMapState(
            "parts", "ends long",
            "volume double, turnover double, trades long, first_ts long, first_id long, open double, last_ts long, last_id long, last double, high double, low double, usual double",
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step = self.every * 60_000
        for pdf in rows:
            pdf = pdf[pdf["price"].notna() & pdf["ts"].notna()]
            if not len(pdf):
                continue
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            pdf = pdf.assign(us=us, ends=(us // 1000 // step + 1) * step, size=pdf["size"].fillna(0.0))
            pdf = pdf.assign(turnover=pdf["price"] * pdf["size"]).sort_values(["us", "event_id"])
            for ends, g in pdf.groupby("ends"):
                a, b = g.iloc[0], g.iloc[-1]
                usual = None if pd.isna(a["usual_volume"]) else float(a["usual_volume"])
                new = (
                    float(g["size"].sum()), float(g["turnover"].sum()), len(g), int(a["us"]), int(a["event_id"]), float(a["price"]), int(b["us"]), int(b["event_id"]), float(b["price"]),
                    float(g["price"].max()), float(g["price"].min()), usual,
                )
                if self.parts.containsKey((ends,)):
                    old = self.parts.getValue((ends,))
                    first, last = min(old[3:6], new[3:6]), max(old[6:9], new[6:9])
                    new = (old[0] + new[0], old[1] + new[1], old[2] + new[2], *first, *last, max(old[9], new[9]), min(old[10], new[10]), usual)
                else:
                    self.handle.registerTimer(int(ends))
                self.parts.updateValue((int(ends),), new)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers come in the order of their times, and no event before them can come any more
        ends = expiredTimerInfo.getExpiryTimeInMs()
        s = _Session(*self.session.get()) if self.session.exists() else _Session()
        s.fired = list(s.fired or [])
        reading = self._reading(key[0], s, ends, self.parts.getValue((ends,)))
        self.parts.removeKey((ends,))
        self.session.update(s.values())
        yield pd.DataFrame([reading], columns=[c.split()[0] for c in READING.split(",")])

    def _reading(self, symbol: str, s: _Session, ends: int, part: tuple) -> tuple:
        at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ends)
        inside = at - dt.timedelta(seconds=1)
        if s.day != inside.date():
            before = s.last if s.trades else s.prior_close
            s.__init__(day=inside.date(), open=part[5], prior_close=before)
        s.volume, s.turnover, s.trades = s.volume + part[0], s.turnover + part[1], s.trades + part[2]
        s.high, s.low, s.last, s.usual = max(s.high, part[9]), min(s.low, part[10]), part[8], part[11]
        span = s.high - s.low
        if span > 0 and part[0] > 0:
            s.flow += ((s.last - s.low) - (s.high - s.last)) / span * part[0]
        minute = inside.hour * 60 + inside.minute + (inside.second + 1) / 60
        done, limits = progress_at(inside.weekday(), minute, self.sessions), self.limits
        ratio = s.volume / (s.usual * done) if s.usual and done > limits.least_progress else None
        place = (s.last - s.low) / span if span > 0 else 0.5
        hits = {
            "EXTREME_VOLUME": ratio is not None and ratio >= limits.extreme, "HIGH_VOLUME": ratio is not None and limits.surge <= ratio < limits.extreme,
            "RANGE_HIGH_VOLUME": ratio is not None and ratio >= limits.watch and place >= limits.top, "RANGE_LOW_VOLUME": ratio is not None and ratio >= limits.watch and place <= limits.bottom,
        }
        if s.prior_close:
            fall, least = (s.prior_close - s.last) / s.prior_close, limits.least_flow * (s.usual or 0.0)
            hits |= {"AD_BULL_DIVERGENCE": fall > limits.least_move and s.flow > least, "AD_BEAR_DIVERGENCE": fall < -limits.least_move and s.flow < -least}
        new = [a for a in ALERTS if hits.get(a) and a not in s.fired]
        s.fired += new
        return (symbol, s.day, at, s.volume, s.turnover, s.trades, s.open, s.high, s.low, s.last, s.prior_close, s.usual, done, ratio, place, s.flow, ",".join(new))

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Sessions keep state in memory by default; timers need the store on disk, from the start of a query to its end."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def tape_stream(events: DataFrame, late: str = "1 hour", every: int = 60, limits: Limits = Limits(), sessions: dict = SESSIONS) -> DataFrame:
    """Readings (``READING``) every so many minutes, of :func:`tape_events` over a stream, once the watermark has passed them.  Intervals without an
    event give none.  Events without price or time are left out; a missing size is 0.  Start it under :func:`keyed_state`; days are those of
    UTC, as the session's time zone must be."""
    keyed = events.withWatermark("ts", late).groupBy("symbol")
    return keyed.transformWithStateInPandas(_Tape(every, limits, sessions), READING, "append", "eventTime")


def tape_batch(events: DataFrame, every: int = 60, limits: Limits = Limits(), sessions: dict = SESSIONS) -> DataFrame:
    """The same readings of all intervals, from stored :func:`tape_events`: one shuffle of sums by symbol, then windows on the symbol."""
    e = events.filter("price IS NOT NULL AND ts IS NOT NULL").withColumn("size", F.coalesce("size", F.lit(0.0)))
    ends = F.timestamp_seconds((F.floor(F.unix_timestamp("ts") / (60 * every)) + 1) * 60 * every)
    order = F.struct("ts", "event_id")
    p = e.groupBy("symbol", ends.alias("at")).agg(
        F.sum("size").alias("size"), F.sum(F.col("price") * F.col("size")).alias("paid"), F.count("*").alias("n"), F.min_by("price", order).alias("first"),
        F.max_by("price", order).alias("last"), F.max("price").alias("top"), F.min("price").alias("bottom"), F.max("usual_volume").alias("usual_volume"),
    )
    p = p.withColumn("session", F.to_date(F.col("at") - F.expr("INTERVAL 1 SECOND")))
    so_far = Window.partitionBy("symbol", "session").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({
        "volume": F.sum("size").over(so_far), "turnover": F.sum("paid").over(so_far), "trades": F.sum("n").over(so_far), "open": F.first("first").over(so_far),
        "high": F.max("top").over(so_far), "low": F.min("bottom").over(so_far), "progress": progress(F.col("at"), sessions),
    })
    by_time = Window.partitionBy("symbol").orderBy("at")
    # the last price of the session before: the row before the first of this one
    starts = F.when(F.coalesce(F.lag("session").over(by_time) != F.col("session"), F.lit(False)), F.lag("last").over(by_time))
    span = F.col("high") - F.col("low")
    step = F.when((span > 0) & (F.col("size") > 0), ((F.col("last") - F.col("low")) - (F.col("high") - F.col("last"))) / span * F.col("size")).otherwise(0.0)
    p = p.withColumns({"__start": starts, "__step": step})
    p = p.withColumns({
        "prior_close": F.first("__start").over(so_far), "flow": F.sum("__step").over(so_far), "range_position": F.when(span > 0, (F.col("last") - F.col("low")) / span).otherwise(0.5),
        "volume_ratio": F.when(F.col("progress") > limits.least_progress, F.try_divide(F.col("volume"), F.col("usual_volume") * F.col("progress"))),
    })
    ratio, place = F.col("volume_ratio"), F.col("range_position")
    fall, least = (F.col("prior_close") - F.col("last")) / F.col("prior_close"), limits.least_flow * F.coalesce("usual_volume", F.lit(0.0))
    hits = dict(zip(ALERTS, [
        ratio >= limits.extreme, (ratio >= limits.surge) & (ratio < limits.extreme), (ratio >= limits.watch) & (place >= limits.top), (ratio >= limits.watch) & (place <= limits.bottom),
        (F.col("prior_close") != 0) & (fall > limits.least_move) & (F.col("flow") > least), (F.col("prior_close") != 0) & (fall < -limits.least_move) & (F.col("flow") < -least),
    ]))
    p = p.withColumns({f"__{a}": F.coalesce(h, F.lit(False)).cast("int") for a, h in hits.items()})
    first = lambda a: (F.col(f"__{a}") == 1) & (F.sum(f"__{a}").over(so_far) == 1)
    p = p.withColumn("alerts", F.array_join(F.array_compact(F.array(*[F.when(first(a), F.lit(a)) for a in ALERTS])), ","))
    return p.select(*[c.split()[0] for c in READING.split(",")])


def tape_kinds(tape: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Readings with enough trading, with what they look like and a signed score: how unusual the volume pace and the size of a trade are, and on which
    side price and range speak.  Stateless, for streams too."""
    change = 100 * F.try_divide(F.col("last") - F.col("prior_close"), F.col("prior_close"))
    each = F.try_divide(F.col("turnover"), F.col("trades"))
    pace = F.when(F.col("progress") > 0.03, F.col("volume") / F.col("progress")).otherwise(F.col("volume"))
    t = tape.filter((F.col("turnover") >= limits.least_turnover) & (F.col("trades") >= limits.least_trades))
    t = t.withColumns({"change": F.coalesce(change, F.lit(0.0)), "average_trade": each, "pace": F.coalesce(F.try_divide(pace, F.col("usual_volume")), F.lit(0.0))})
    place, up = F.col("range_position"), F.col("change")
    high, low = (place > 0.7) & (up > 0), (place < 0.3) & (up < 0)
    t = t.withColumns({
        "intensity": F.when(F.col("pace") >= 3, 3.0).when(F.col("pace") >= 1.8, 1.5).otherwise(0.0) + F.when(F.col("average_trade") > limits.block, 3.0).when(F.col("average_trade") > limits.large, 1.5).otherwise(0.0),
        "bullish": F.when(high, 1.5).otherwise(0.0) + F.when(up > 2, 1.0).otherwise(0.0), "bearish": F.when(~high & low, 1.5).otherwise(0.0) + F.when(up < -2, 1.0).otherwise(0.0),
    }).filter((F.col("intensity") > 0) | high | low)
    i, bull, bear = F.col("intensity"), F.col("bullish"), F.col("bearish")
    kind = (
        F.when((i >= 4.5) & (bull > bear), "ACCUMULATION").when((i >= 4.5) & (bear > bull), "DISTRIBUTION").when((i >= 3) & (bear > bull), "SELLING PRESSURE")
        .when(F.col("average_trade") > limits.block, "BLOCK TRADES").when(F.col("pace") >= 3, "VOLUME SURGE").when((bull > 0) & (up > 0), "QUIET STRENGTH").otherwise("UNUSUAL ACTIVITY")
    )
    t = t.withColumn("kind", kind)
    return t.withColumn("score", F.when(F.col("kind").isin("DISTRIBUTION", "SELLING PRESSURE"), -(i + bear - bull)).otherwise(i + bull - bear))


def quote_alerts(tape: DataFrame, daily: DataFrame, surge: float = 2.0, least_flow: float = 0.05) -> DataFrame:
    """Readings that alert against a static table of daily flow (symbol, cmf, obv_up): volume far above what is usual by now, and money flow with the
    price.  Stateless, for streams too."""
    q = tape.join(daily.select("symbol", "cmf", "obv_up"), "symbol")
    by_now = clamp(F.col("progress"), 0.05, 1.0) * F.col("usual_volume")
    pct = 100 * F.try_divide(F.col("last") - F.col("prior_close"), F.col("prior_close"))
    q = q.withColumns({"times_usual": F.round(F.try_divide(F.col("volume"), by_now), 2), "pct": F.coalesce(pct, F.lit(0.0))})
    yes = F.coalesce(F.col("obv_up"), F.lit(False))
    found = [
        ("VOLUME_SURGE", F.col("times_usual") >= surge), ("ACCUMULATION", (F.col("cmf") > least_flow) & yes & (F.col("pct") > 0)),
        ("DISTRIBUTION", (F.col("cmf") < -least_flow) & ~F.coalesce(F.col("obv_up"), F.lit(True)) & (F.col("pct") < 0)),
    ]
    return q.withColumn("found", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found])), ",")).filter("found != ''")
