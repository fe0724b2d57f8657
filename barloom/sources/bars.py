"""Bars and daily series: reading, building from raw events, cleaning, checking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType, TimestampNTZType
from pyspark.sql.window import Window

PRICES = ("open", "high", "low", "close")
MEASURES = (*PRICES, "volume", "amt", "amount")
BAR_SCHEMA = StructType([StructField("symbol", StringType()), StructField("ts", TimestampNTZType()), *[StructField(c, DoubleType()) for c in (*PRICES, "volume", "amt")]])
MACRO_SCHEMA = StructType([StructField("symbol", StringType()), StructField("date", DateType()), StructField("close", DoubleType())])


def symbol_key(symbol: Column) -> Column:
    """The symbol as it stands in names: lower case, . / - as _."""
    return F.lower(F.translate(symbol, "./-", "___"))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


# bars from raw rows: a tumbling bucket, first and last by an explicit order


def _bars(rows: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    """One groupBy with partial aggregation: the shuffle carries a row for each bar and input partition."""
    raw = rows.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("px"), order.alias("o"), volume.alias("volume"))
    return raw.groupBy("symbol", "ts").agg(
        F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o").alias("close"),
        F.sum("volume").cast("double").alias("volume"), F.sum("px").alias("amt"),
    )


def bars_from_events(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Bars of the events' values by event type; prices are 100 + value / 100, volume counts events."""
    bucket = F.window("ts", f"{minutes} minutes")["start"]
    rows = events.where("ts IS NOT NULL").select(F.col("event_type"), F.col("event_id"), F.col("ts"), F.col("value"), bucket.cast("timestamp_ntz").alias("bar_ts"))
    return _bars(rows, F.col("event_type"), F.col("bar_ts"), 100 + F.col("value") / 100, F.struct("ts", "event_id"), F.lit(1.0))


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily bars of lineitem by return flag."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _bars(lineitem, F.col("l_returnflag"), F.col("l_shipdate").cast("date").cast("timestamp_ntz"), 100 + F.col("l_extendedprice").cast("double") / 10000, order, F.col("l_quantity").cast("double"))


def macro_from_orders(orders: DataFrame) -> DataFrame:
    """A daily series of the orders' mean price."""
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.avg(F.col("o_totalprice").cast("double")) / 1000).alias("close")).select(F.lit("ORDERS").alias("symbol"), "date", "close")


# files


def read_bars_csv(spark: SparkSession, paths: list[str], symbol: str | None = None) -> DataFrame:
    """CSV files {symbol}_{minutes}min_data.csv whose first column is the time; columns by name, extra ones dropped."""
    raw = spark.read.option("header", True).csv(paths)
    first = raw.columns[0]
    name = F.lit(symbol) if symbol else F.regexp_extract(F.input_file_name(), r"([^/]+)_\d+min_data\.csv", 1)
    lower = {c.lower(): c for c in raw.columns[1:]}
    rows = raw.select(name.alias("symbol"), F.to_timestamp_ntz(F.col(first)).alias("ts"), *[F.expr(f"try_cast(`{lower[c]}` AS double)").alias(c) for c in MEASURES if c in lower])
    return normalise_bars(rows.withColumn("seq", F.monotonically_increasing_id()), "seq")


def read_macro_csv(spark: SparkSession, path: str, symbol: str, value: str = "close") -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return normalise_macro(raw.withColumn("seq", F.monotonically_increasing_id()), symbol, value, "seq")


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, strict: bool = False) -> DataFrame:
    """Bars of a Parquet table partitioned by symbol; filters reach the scan. strict: every symbol must be there."""
    bars = spark.read.schema(BAR_SCHEMA).parquet(path)
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    bars = time_range(bars, start, end)
    if strict and symbols is not None:
        have = {r["symbol"] for r in bars.select("symbol").distinct().collect()}  # at most as many as were asked for
        if missing := sorted(set(symbols) - have):
            raise ValueError(f"no bars of {missing}")
    return bars


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by symbol, sorted by time within files, so that time filters skip row groups."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite").partitionBy("symbol").parquet(path)


def cached(spark: SparkSession, path: str, make, fingerprint: str = "") -> DataFrame:
    """The table at the path, if it was written under the fingerprint; else made and written. Its fingerprint lies beside it."""
    key = f"{path}.fingerprint"
    if exists(spark, f"{path}/_SUCCESS") and exists(spark, f"{key}/_SUCCESS") and [r["value"] for r in spark.read.text(key).collect()] == [fingerprint]:
        return spark.read.parquet(path)
    note = lambda what: spark.createDataFrame([(what,)], "value string").coalesce(1).write.mode("overwrite").text(key)
    note("being written")
    make().write.mode("overwrite").parquet(path)
    note(fingerprint)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def source_files(df: DataFrame) -> list[tuple[str, int, int]]:
    """Name, size and time of each file that the frame is read from."""
    spark, out = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


def time_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start is not None:
        bars = bars.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(start)))
    return bars.where(F.col("ts") <= F.to_timestamp_ntz(F.lit(end))) if end is not None else bars


# cleaning


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key: the last by the order. max_by aggregates before the shuffle, a window would not."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def normalise_bars(df: DataFrame, order: str) -> DataFrame:
    """The bars' columns in order: lower-cased names, the last row of each time, finite values, complete prices."""
    df = df.toDF(*[c.lower() for c in df.columns])
    if missing := [c for c in PRICES if c not in df.columns]:
        raise ValueError(f"bars need {missing}")
    for c in MEASURES:
        df = df.withColumn(c, finite(F.col(c).cast("double")) if c in df.columns else F.lit(None).cast("double"))
    df = df.withColumn("amt", F.coalesce("amt", "amount"))
    return keep_last(df.where("ts IS NOT NULL"), ["symbol", "ts"], order).dropna(subset=list(PRICES)).select("symbol", "ts", *PRICES, "volume", "amt")


def normalise_macro(df: DataFrame, symbol: str, value: str, order: str) -> DataFrame:
    """A daily series: the last row of each day; the value is the named column, else close, else the first one."""
    columns = {c.lower(): c for c in df.columns}
    day = columns.get("date", df.columns[0])
    others = [c for c in df.columns if c not in (day, order)]
    source = columns.get(value.lower(), columns.get("close", others[0]))
    rows = df.select(F.to_date(F.col(day)).alias("date"), finite(F.expr(f"try_cast(`{source}` AS double)")).alias("close"), F.col(order).alias("seq"))
    return keep_last(rows.where("date IS NOT NULL"), ["date"], "seq").where("close IS NOT NULL").select(F.lit(symbol).alias("symbol"), "date", "close")


def with_returns(bars: DataFrame) -> DataFrame:
    """bars with cc (close to close, over gaps) and oc (open to close); missing volume is 0."""
    w = Window.partitionBy("symbol").orderBy("ts")
    before = F.last("close", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    now = F.last("close", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("volume", F.coalesce("volume", F.lit(0.0))).withColumn("cc", now / F.nullif(before, F.lit(0.0)) - 1).withColumn("oc", F.col("close") / F.nullif(F.col("open"), F.lit(0.0)) - 1)


# checks


def gaps(bars: DataFrame) -> DataFrame:
    """Minutes between a bar and the one before it, where positive."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    minutes = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 60e6
    return bars.select("symbol", minutes.alias("minutes")).where("minutes > 0")


def usual_gap(bars: DataFrame) -> DataFrame:
    """(symbol, inferred_minutes): the commonest gap in whole minutes, the smallest of equals."""
    counts = gaps(bars).groupBy("symbol", F.bround("minutes").alias("gap")).agg(F.count("*").alias("n"))
    return counts.groupBy("symbol").agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("inferred_minutes"))


def check_bar_size(bars: DataFrame, minutes: int) -> DataFrame:
    """bars, if the usual gap of each symbol with three bars or more is as expected; else an error."""
    few = bars.groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 3")
    wrong = usual_gap(bars).join(few, "symbol", "left_semi").where(F.col("inferred_minutes") != minutes).limit(5).collect()
    if wrong:
        raise ValueError(f"bars of {minutes} minutes expected: {[(r['symbol'], r['inferred_minutes']) for r in wrong]}")
    return bars


def file_name(symbol: str, minutes: int) -> str:
    return f"{re.sub(r'[./-]', '_', symbol).lower()}_{minutes}min_data.csv"
