"""Typed, fail-closed sources: closes, definitions, label and ledger files, versioned configuration."""

from __future__ import annotations

import tomllib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality

#: Marks an undefined expiry in nanosecond definitions (fixed value of the feed format).
UNDEFINED_NS = 9223372036854775807
LABELS = "day date, entry_et string, close_et string, spx_a double, f_a double, entry_price double, close_price double, up_max double, down_max double, up_max_ts timestamp, down_max_ts timestamp, sample_count int, code_version string"
DISTANCES = "day date, down_distance double, up_distance double, regime string, model_version string, quantile double"


def require(df: DataFrame, names: list[str]) -> DataFrame:
    """df, or an error that lists the missing columns in order."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def or_fail(value: Column, fine: Column, message: str) -> Column:
    """value where fine holds; the job fails with the message where it doesn't (or is null)."""
    return F.when(F.coalesce(fine, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def closes_csv(spark: SparkSession, path: str) -> DataFrame:
    """DATE,SPX lines (MM/dd/yyyy) -> day, close; of a repeated day the last line of the file counts."""
    raw = spark.read.option("header", True).csv(path)
    require(raw, ["DATE", "SPX"])
    rows = raw.select(F.to_date("DATE", "MM/dd/yyyy").alias("day"), F.col("SPX").cast("double").alias("close"), F.monotonically_increasing_id().alias("line"))
    last = rows.groupBy("day").agg(F.max_by("close", "line").alias("close"))
    return last.select("day", or_fail(F.col("close"), F.col("close") > 0, "a close must be positive").alias("close"))


def closes_json(spark: SparkSession, path: str) -> DataFrame:
    """{status, results: [{t: epoch milliseconds, c: close}]} -> day, close."""
    raw = spark.read.schema("status string, results array<struct<t:bigint,c:double>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    fine = F.col("status").isin("OK", "DELAYED")
    rows = raw.select(F.explode(or_fail(F.col("results"), fine, "the feed's status isn't OK")).alias("r"))
    return rows.select(F.to_date(F.timestamp_millis("r.t")).alias("day"), or_fail(F.col("r.c"), F.col("r.c") > 0, "a close must be positive").alias("close"))


def expiring(spark: SparkSession, path: str, day: str) -> DataFrame:
    """Definitions CSV -> distinct symbols that expire on the day, by nanosecond expiration or else ISO maturity_date."""
    raw = spark.read.option("header", True).csv(path)
    ns = F.col("expiration").cast("long") if "expiration" in raw.columns else F.lit(None).cast("long")
    iso = F.to_date("maturity_date") if "maturity_date" in raw.columns else F.lit(None).cast("date")
    when = F.coalesce(F.when(ns != UNDEFINED_NS, F.to_date(F.timestamp_micros(F.floor(ns / 1000)))), iso)
    return require(raw, ["raw_symbol"]).where(when == F.lit(day).cast("date")).select("raw_symbol").distinct().orderBy("raw_symbol")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked through Spark's own file systems."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).count()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Excursion labels; a missing file is an empty table, a corrupt line fails the job, and so does one without day or entry
    price."""
    rows = spark.read.schema(LABELS).option("mode", "FAILFAST").json(path) if exists(spark, path) else spark.createDataFrame([], LABELS)
    return rows.withColumn("day", or_fail(F.col("day"), F.col("day").isNotNull() & F.col("entry_price").isNotNull(), "a label needs day and entry_price"))


def distances(spark: SparkSession, path: str) -> DataFrame:
    """Tail distances with exactly the declared keys and positive distances."""
    names = F.array_sort(F.array(*(F.lit(c.split()[0]) for c in DISTANCES.split(", "))))
    raw = spark.read.text(path)
    checked = or_fail(F.col("value"), F.array_sort(F.json_object_keys("value")) == names, "tail distances have exactly the declared keys")
    rows = raw.select(F.from_json(checked, DISTANCES, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    fine = (F.col("down_distance") > 0) & (F.col("up_distance") > 0) & F.col("quantile").between(0, 1)
    return rows.withColumn("day", or_fail(F.col("day"), fine, "distances must be positive"))


def bars(raw: DataFrame) -> DataFrame:
    """Raw minute bars -> typed rows with their broken rules: NaN is null, a missing event time is the receipt time."""
    ts = F.coalesce(*(F.col(c) for c in ("ts_event", "ts_recv") if c in raw.columns))
    n = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    rows = require(raw, ["open", "high", "low", "close", "volume"]).select("day", ts.alias("ts"), *(n(c) for c in ("open", "high", "low", "close", "volume")))
    rules = {"ENVELOPE": F.expr("low <= high AND open BETWEEN low AND high AND close BETWEEN low AND high"), "VOLUME": F.col("volume") >= 0, "TIME": F.col("ts").isNotNull()}
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))
    return rows.withColumn("violations", broken)


def quotes(raw: DataFrame) -> DataFrame:
    """Raw minute quotes -> day, ts, symbol, bid, ask, bid_size, ask_size with their broken rules: NaN is null, a missing event
    time is the receipt time; symbols are 21 characters."""
    need = ["symbol", "bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00"]
    if not {"ts_event", "ts_recv"} & set(raw.columns):
        raise ValueError("quotes need ts_event or ts_recv")
    ts = F.coalesce(*(F.col(c) for c in ("ts_event", "ts_recv") if c in raw.columns))
    price = lambda c, to: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(to)
    rows = require(raw, need).select("day", ts.alias("ts"), "symbol", price("bid_px_00", "bid"), price("ask_px_00", "ask"), F.col("bid_sz_00").cast("int").alias("bid_size"), F.col("ask_sz_00").cast("int").alias("ask_size"))
    time = F.array_compact(F.array(F.when(F.col("ts").isNull(), F.lit("TIME"))))
    return rows.withColumn("violations", F.concat(quality.quote_violations(), time))


def chain_day(raw_bars: DataFrame, raw_quotes: DataFrame | None, day: str) -> tuple[DataFrame, DataFrame | None]:
    """(bars, quotes) of one day, typed and in order of time (and symbol); the job fails at a row that breaks a rule, or, when
    asked, for a day without bars or quotes. Without raw_quotes only the bars are read. The day is a partition filter."""

    def fit(rows: DataFrame, what: str) -> DataFrame:
        fine = F.size("violations") == 0
        return rows.withColumn("ts", or_fail(F.col("ts"), fine, f"{what} break a rule")).drop("violations")

    at = F.lit(day).cast("date")
    own = fit(bars(raw_bars.where(F.col("day") == at)), "bars")
    if raw_quotes is None:
        return own.orderBy("ts"), None
    chain = fit(quotes(raw_quotes.where(F.col("day") == at)), "quotes")
    if own.isEmpty() or chain.isEmpty():
        raise ValueError(f"{day} has no bars or no quotes")
    return own.orderBy("ts"), chain.orderBy("ts", "symbol")


def toml_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The tables under `key` of a small versioned TOML file (read through Spark) as rows with the file's version."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    doc = tomllib.loads(text)
    if "version" not in doc:
        raise ValueError("the configuration has no version")
    return spark.createDataFrame([{**row, "version": doc["version"]} for row in doc[key]])


def trading_days(spark: SparkSession, start: str, end: str, holidays: list[str]) -> DataFrame:
    """Weekdays from start to end that aren't holidays."""
    days = spark.sql("SELECT explode(sequence(CAST(:a AS DATE), CAST(:b AS DATE))) AS day", args={"a": start, "b": end})
    return days.where((F.weekday("day") < 5) & ~F.col("day").isin([F.lit(h).cast("date") for h in holidays] or [F.lit(None).cast("date")]) if holidays else F.weekday("day") < 5)


def to_utc(day: Column, clock: str, zone: str = "America/New_York") -> Column:
    """The instant of a wall clock (HH:mm) on a day in a zone, as UTC."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(clock)), "yyyy-MM-dd HH:mm"), zone)
