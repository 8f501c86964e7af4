"""The registered queries of the library proper, each beside its SQL counterpart.

Values that depend on the order of sums are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions import losses
from tickforge.operators import constraints, generative, pairwise, report, stats, training, utility, windows
from tickforge.operators import features as feats
from tickforge.sources import bars as sources
from tickforge.sources import files
from tickforge.sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

LENGTH = 30
COLUMNS = ["Open", "High", "Low", "Close", "Volume", "LogReturn"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- shared parts

BARS = """bars AS (
  SELECT l_returnflag || l_linestatus AS ticker, l_shipdate AS Date, arg_min(p, row(l_orderkey, l_linenumber, p)) AS Open, max(p) AS High,
    min(p) AS Low, arg_max(p, row(l_orderkey, l_linenumber, p)) AS Close, sum(l_quantity) AS Volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem WHERE l_quantity <> 0) GROUP BY ALL)"""
RETURNS = f"""{BARS},
ret AS (
  SELECT * FROM (SELECT *, ln(Close / lag(Close) OVER (PARTITION BY ticker ORDER BY Date)) AS LogReturn FROM bars) WHERE LogReturn IS NOT NULL),
derived AS (SELECT *, ln(1 + Volume) AS LogVolume, Close * Volume AS DollarVolume FROM ret)"""


def _windows_sql(source: str, columns: list[str], length: int = LENGTH, stride: int = 1) -> str:
    cast = ", ".join(f"{c}::FLOAT AS {c}" for c in columns)
    return f"""numbered AS (
  SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY Date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n, {cast} FROM {source}),
win AS (
  SELECT ticker, id AS window_id, (pos - id * {stride})::INT AS step, {", ".join(columns)}
  FROM numbered, unnest(generate_series(greatest(0, ceil((pos - {length} + 1) / {stride}))::BIGINT, floor(least(pos, n - {length}) / {stride})::BIGINT)) AS t(id) WHERE n >= {length})"""


WINDOWS = f"{RETURNS},\n{_windows_sql('ret', COLUMNS)}"


_REAL = "(substr(ticker, 2, 1) = 'F')"


def _series_sql(columns: list[str]) -> str:
    """Series of every ticker; feature is flag:column, real those of line status F."""
    each = " UNION ALL ".join(f"SELECT ticker, {_REAL} AS real, substr(ticker, 1, 1) || ':{c}' AS feature, window_id * {LENGTH} + step AS idx, {c}::DOUBLE AS x FROM win" for c in columns)
    return f"{WINDOWS},\nseries AS ({each})"


VECTORS = "real AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label < 5), syn AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label >= 5)"
DAY = "strftime(Date, '%Y-%m-%d') AS day"


def _day(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("ticker", F.date_format("Date", "yyyy-MM-dd").alias("day"), *columns)


def _rounded(*columns: str, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in columns]


def _round_sql(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.lineitem_bars(spark, sf_dir)


def _windows(spark: SparkSession, sf_dir: str, stride: int = 1) -> DataFrame:
    return windows.create_windows(feats.log_returns(_bars(spark, sf_dir)), LENGTH, COLUMNS, stride)


def _status_sets(spark: SparkSession, sf_dir: str, stride: int = 1) -> tuple[DataFrame, DataFrame]:
    """Windows of all tickers: real ones of line status F, synthetic ones of O."""
    every, status = _windows(spark, sf_dir, stride), F.substring("ticker", 2, 1)
    return every.filter(status == "F"), every.filter(status == "O")


def _series(spark: SparkSession, sf_dir: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Real and synthetic series of all tickers, paired by return flag: features are flag:column."""
    return tuple(stats.long_series(w, columns, LENGTH, F.substring("ticker", 1, 1)) for w in _status_sets(spark, sf_dir))  # type: ignore[return-value]


def _own_series(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Series of every ticker by itself: features are ticker:column."""
    return stats.long_series(_windows(spark, sf_dir), columns, LENGTH, F.col("ticker"))


# --- sources


@query(f"WITH {BARS} SELECT ticker, {DAY}, Open, High, Low, Close, Volume FROM bars")
def d1_bars(spark, sf_dir):
    return _day(_bars(spark, sf_dir), *sources.OHLCV)


@query(
    """SELECT event_type AS ticker, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, arg_min(value, row(ts, event_id)) AS Open, max(value) AS High,
  min(value) AS Low, arg_max(value, row(ts, event_id)) AS Close, count(*)::DOUBLE AS Volume FROM events GROUP BY ALL"""
)
def d1_event_bars(spark, sf_dir):
    return sources.event_bars(spark, sf_dir, "hour").select("ticker", F.date_format("Date", "yyyy-MM-dd HH").alias("hour"), *sources.OHLCV)


_BARS_SQL = f"WITH {BARS} SELECT ticker, {DAY}, Open, High, Low, Close, Volume FROM bars"


def _ingested(spark, sf_dir, file_format: str) -> DataFrame:
    """All tickers' bars fetched one by one, written to a store and loaded again."""
    bars, folder = _bars(spark, sf_dir), new_path(spark, "store")
    tickers = [r[0] for r in bars.select("ticker").distinct().orderBy("ticker").collect()]  # one row a ticker
    found = files.ingest(spark, [*tickers, "none"], lambda session, t: bars.filter(F.col("ticker") == t), folder, file_format=file_format)
    one = files.load_bars(spark, tickers[0], folder, file_format=file_format)
    return _day(one.unionByName(found.filter(F.col("ticker") != tickers[0])), *sources.OHLCV)


@query(_BARS_SQL)
def s1_s2_s4_parquet_store(spark, sf_dir):
    return _ingested(spark, sf_dir, "parquet")


@query(_BARS_SQL)
def s3_csv_store(spark, sf_dir):
    return _ingested(spark, sf_dir, "csv")


@query(_BARS_SQL)
def s5_load_by_suffix(spark, sf_dir):
    path = new_path(spark, "bars") + ".parquet"
    _bars(spark, sf_dir).write.parquet(path)
    return _day(files.load_table(spark, path), *sources.OHLCV)


@query(f"WITH {RETURNS}, {_windows_sql('ret', ['Close', 'Volume'])} SELECT (dense_rank() OVER (ORDER BY ticker, window_id) - 1)::BIGINT AS window_id, step, Close AS f0, Volume AS f1 FROM win")
def s7_npy_round_trip(spark, sf_dir):
    """All tickers' windows at stride 1 as one array."""
    path = new_path(spark, "windows") + ".npy"
    files.save_array(_windows(spark, sf_dir), path, ["Close", "Volume"])
    return files.load_table(spark, path)


@query(f"WITH {BARS} SELECT ticker, count(*) AS rows, round(avg(Close), 6) AS close FROM bars GROUP BY 1")
def s8_json_report(spark, sf_dir):
    made = _bars(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("rows"), F.round(F.avg("Close"), 6).alias("close")).collect()  # one row a ticker
    path = files.save_report({"tickers": [r.asDict() for r in made]}, new_path(spark, "report"))
    read = spark.read.schema("tickers array<struct<ticker string, rows long, close double>>").json(path, multiLine=True)
    return read.select(F.explode("tickers").alias("t")).select("t.*")


@query("SELECT k, round(avg(x), 6) AS mean FROM (SELECT unnest(range(1, 65)) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY k")
def s9_checkpoint_round_trip(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.posexplode("embedding").alias("k", "x")).groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    path = new_path(spark, "state") + ".npz"
    files.save_checkpoint(path, {"means": np.array([r["m"] for r in rows.orderBy("k").collect()])}, 3, {"loss": 0.5})  # one row a dimension
    state, meta = files.load_checkpoint(path)
    assert meta == {"epoch": 3, "metrics": {"loss": 0.5}}
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(state["means"])], "k long, mean double")


@query("SELECT extract(day FROM ts)::INT AS epoch, event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def s10_scalar_log(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.dayofmonth("ts").alias("epoch")).pivot("event_type").agg(F.avg("value"))
    path = new_path(spark, "log")
    for r in rows.orderBy("epoch").collect():  # one row a day of the month
        values = r.asDict()
        files.log_metrics(path, values.pop("epoch"), {k: v for k, v in values.items() if v is not None})
    return files.read_metrics(spark, path).select("epoch", "metric", *_rounded("value"))


@query(
    f"""WITH {BARS}, k AS (SELECT ticker, count(*) AS n, count(*) FILTER (Volume > 25) AS busy, floor(min(Close))::BIGINT AS low, ceil(max(Close))::BIGINT AS high FROM bars GROUP BY 1)
SELECT 'series.' || ticker || unnest(['.rows', '.close.low', '.close.high']) AS name, unnest([busy, low, high])::VARCHAR AS value FROM k UNION ALL SELECT 'window', '30'"""
)
def s12_j11_merged_config(spark, sf_dir):
    """Two configurations of what the bars hold; the second one's numbers of busy bars win over the first one's of all."""
    import yaml

    counts = [F.count("*").alias("n"), F.count_if(F.col("Volume") > 25).alias("busy"), F.floor(F.min("Close")).alias("low"), F.ceil(F.max("Close")).alias("high")]
    known = _bars(spark, sf_dir).groupBy("ticker").agg(*counts).collect()  # one row a ticker
    base = {"window": 30, "series": {r["ticker"]: {"rows": r["n"], "close": {"low": r["low"]}} for r in known}}
    over = {"series": {r["ticker"]: {"rows": r["busy"], "close": {"high": r["high"]}} for r in known}}
    paths = [new_path(spark, "config") + ".yaml" for _ in range(2)]
    for path, tree in zip(paths, (base, over), strict=True):
        files.write_bytes(path, yaml.safe_dump(tree).encode())

    def flat(tree: dict, prefix: str = "") -> list[tuple[str, str]]:
        return [x for k, v in tree.items() for x in (flat(v, f"{prefix}{k}.") if isinstance(v, dict) else [(f"{prefix}{k}", str(v))])]

    return spark.createDataFrame(flat(files.load_and_merge(*paths)), "name string, value string")


# --- projections and repairs


@query(f"WITH {RETURNS} SELECT ticker, {DAY}, Close, round(LogReturn, 9) AS LogReturn FROM ret")
def p1_log_returns(spark, sf_dir):
    return _day(feats.log_returns(_bars(spark, sf_dir)), "Close", *_rounded("LogReturn", digits=9))


@query(f"WITH {BARS} SELECT ticker, {DAY}, round(ln(1 + Volume), 9) AS LogVolume, Close * Volume AS DollarVolume FROM bars")
def p2_p3_volumes(spark, sf_dir):
    return _day(feats.dollar_volume(feats.log_volume(_bars(spark, sf_dir))), *_rounded("LogVolume", digits=9), "DollarVolume")


@query("SELECT event_id, user_id, value FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL")
def p4_p6_numeric_projection(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = feats.existing(rows, feats.numeric_columns(rows))
    return rows.select(*names).dropna(subset=names)


BROKEN = f"""{BARS},
broken AS (SELECT ticker, Date, Open - 900 AS Open, Close AS High, Close AS Low, Close, CASE WHEN Volume > 60 THEN 25.5 - Volume ELSE Volume + 0.5 END AS Volume FROM bars)"""


def _broken(spark, sf_dir) -> DataFrame:
    """Bars that break every rule."""
    low = F.when(F.col("Volume") > 60, 25.5 - F.col("Volume")).otherwise(F.col("Volume") + 0.5)
    return _bars(spark, sf_dir).withColumns({"Open": F.col("Open") - 900, "High": F.col("Close"), "Low": F.col("Close"), "Volume": low})


@query(f"WITH {BROKEN} SELECT ticker, {DAY}, Open, greatest(High, Open, Close) AS High, least(Low, Open, Close) AS Low, Close FROM broken")
def p7_ohlc_constraints(spark, sf_dir):
    return _day(constraints.enforce_ohlc(_broken(spark, sf_dir)), *sources.OHLC)


@query(f"WITH {BROKEN} SELECT ticker, {DAY}, greatest(Volume, 1.0) AS floored, round_even(greatest(Volume, 1.0), 0)::BIGINT AS Volume FROM broken")
def p8_volume_constraints(spark, sf_dir):
    rows = _broken(spark, sf_dir)
    both = constraints.enforce_volume(constraints.enforce_volume(rows).withColumn("floored", F.col("Volume")), round_to_int=True)
    return _day(both, "floored", "Volume")


@query(f"WITH {BROKEN} SELECT ticker, {DAY}, greatest(Open, 1e-6) AS Open, greatest(High, 1e-6) AS High, greatest(Low, 1e-6) AS Low, greatest(Close, 1e-6) AS Close FROM broken")
def p9_positive_prices(spark, sf_dir):
    return _day(constraints.enforce_positive_prices(_broken(spark, sf_dir)), *sources.OHLC)


def _continuity_sql(source: str, gap: float) -> str:
    return f"""seq AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY Date) AS rn FROM {source}),
fold AS (
  SELECT ticker, rn, Close AS c FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.ticker, s.rn, CASE WHEN f.c <> 0 AND abs((s.Close - f.c) / f.c) > {gap}
    THEN CASE WHEN (s.Close - f.c) / f.c > 0 THEN f.c * (1 + {gap}::DOUBLE) ELSE f.c * (1 - {gap}::DOUBLE) END ELSE s.Close END
  FROM fold f JOIN seq s ON s.ticker = f.ticker AND s.rn = f.rn + 1)"""


@query(f"WITH RECURSIVE {BARS}, {_continuity_sql('bars', 0.2)} SELECT s.ticker, {DAY}, f.c AS Close FROM fold f JOIN seq s USING (ticker, rn)")
def p10_price_continuity(spark, sf_dir):
    return _day(constraints.enforce_price_continuity(_bars(spark, sf_dir).select("ticker", "Date", "Close")), "Close")


@query(
    f"""WITH RECURSIVE {BROKEN},
positive AS (SELECT ticker, Date, greatest(Open, 1e-6) AS Open, greatest(High, 1e-6) AS High, greatest(Low, 1e-6) AS Low, greatest(Close, 1e-6) AS Close, Volume FROM broken),
fixed AS (SELECT ticker, Date, Open, greatest(High, Open, Close) AS High, least(Low, Open, Close) AS Low, Close, greatest(Volume, 1.0) AS Volume FROM positive),
{_continuity_sql('fixed', 0.2)}
SELECT s.ticker, {DAY}, Open, High, Low, f.c AS Close, Volume FROM fold f JOIN seq s USING (ticker, rn)"""
)
def p11_all_constraints(spark, sf_dir):
    return _day(constraints.apply_all(_broken(spark, sf_dir)), "Open", "High", "Low", "Close", "Volume")


@query(
    f"""WITH {WINDOWS} SELECT ticker, window_id, count(*) AS n_values, round(sum(x), 2) AS total FROM (
  SELECT ticker, window_id, unnest([Open, Close, LogReturn])::DOUBLE AS x FROM win) GROUP BY ALL"""
)
def p12_flat_windows(spark, sf_dir):
    columns = ["Open", "Close", "LogReturn"]
    rows = windows.create_windows(feats.log_returns(_bars(spark, sf_dir)), LENGTH, columns)
    flat = windows.flat_vectors(windows.as_arrays(rows, columns))
    return flat.select("ticker", "window_id", F.size("v").cast("long").alias("n_values"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query(
    f"""WITH {WINDOWS} SELECT ticker, window_id, {(LENGTH - 1) * 2} AS width, max(CASE WHEN step = {LENGTH - 1} THEN (LogReturn > 0)::INT END) AS y,
  round(sum(CASE WHEN step < {LENGTH - 1} THEN Close::DOUBLE + LogReturn::DOUBLE END), 2) AS total FROM win GROUP BY ALL"""
)
def p15_classification_data(spark, sf_dir):
    columns = ["Close", "LogReturn"]
    rows = windows.create_windows(feats.log_returns(_bars(spark, sf_dir)), LENGTH, columns)
    cut = windows.classification(windows.as_arrays(rows, columns), 1)
    return cut.select("ticker", "window_id", F.size("x").alias("width"), "y", F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


# --- rolling and smoothed columns


def _roll(f: str, n: int, columns: str = "Close") -> str:
    w = f"(PARTITION BY ticker ORDER BY Date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({columns}) OVER {w} = {n} THEN {f}({columns}) OVER {w} END"


@query(f"WITH {RETURNS} SELECT ticker, {DAY}, round(LogReturn, 6) AS LogReturn, round(({_roll('stddev_samp', 21, 'LogReturn')}) * sqrt(252), 6) AS RealizedVol FROM ret")
def w2_realized_volatility(spark, sf_dir):
    return _day(feats.realized_volatility(feats.log_returns(_bars(spark, sf_dir))), *_rounded("LogReturn", "RealizedVol"))


@query(
    f"""WITH {BARS}, b AS (SELECT *, {_roll('avg', 20)} AS m, ({_roll('stddev_pop', 20)}) * 2 AS d FROM bars)
SELECT ticker, {DAY}, round(m, 5) AS BB_Middle, round(m + d, 5) AS BB_Upper, round(m - d, 5) AS BB_Lower, round(2 * d / m * 100, 5) AS BB_Width FROM b"""
)
def w3_bollinger(spark, sf_dir):
    return _day(feats.bollinger_bands(_bars(spark, sf_dir)), *_rounded("BB_Middle", "BB_Upper", "BB_Lower", "BB_Width", digits=5))


SMOOTHED = f"""{BARS},
steps AS (SELECT *, row_number() OVER w AS rn, coalesce(Close - lag(Close) OVER w, 0) AS step,
  greatest(High - Low, abs(High - lag(Close) OVER w), abs(Low - lag(Close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY Date)),
seq AS (SELECT *, avg(tr) OVER (PARTITION BY ticker ORDER BY Date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS tr14 FROM steps),
fold AS (
  SELECT ticker, rn, Close AS e12, Close AS e26, NULL::DOUBLE AS sig, greatest(step, 0) AS up, greatest(-step, 0) AS down, 0::DOUBLE AS atr FROM seq WHERE rn = 1
  UNION ALL
  SELECT ticker, rn, e12, e26, CASE WHEN rn < 26 THEN NULL WHEN rn = 26 THEN e12 - e26 ELSE 0.2 * (e12 - e26) + 0.8 * sig END, up, down, atr FROM (
    SELECT s.ticker, s.rn, 2.0::DOUBLE / 13 * s.Close + 11.0::DOUBLE / 13 * f.e12 AS e12, 2.0::DOUBLE / 27 * s.Close + 25.0::DOUBLE / 27 * f.e26 AS e26, f.sig,
      greatest(s.step, 0) / 14 + f.up * 13 / 14 AS up, greatest(-s.step, 0) / 14 + f.down * 13 / 14 AS down,
      CASE WHEN s.rn < 14 THEN 0 WHEN s.rn = 14 THEN s.tr14 ELSE (f.atr * 13 + s.tr) / 14 END AS atr
    FROM fold f JOIN seq s ON s.ticker = f.ticker AND s.rn = f.rn + 1))"""
_RSI = "round(CASE WHEN rn < 14 THEN NULL WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 5) AS RSI"
_MACD = "round(CASE WHEN rn >= 26 THEN e12 - e26 END, 5) AS MACD, round(CASE WHEN rn >= 34 THEN sig END, 5) AS MACD_Signal, round(CASE WHEN rn >= 34 THEN e12 - e26 - sig END, 5) AS MACD_Hist"


def _smoothed_sql(columns: str) -> str:
    return f"WITH RECURSIVE {SMOOTHED} SELECT s.ticker, {DAY}, {columns} FROM fold JOIN seq s USING (ticker, rn)"


@query(_smoothed_sql(_RSI))
def w4_rsi(spark, sf_dir):
    return _day(feats.rsi(_bars(spark, sf_dir)), *_rounded("RSI", digits=5))


@query(_smoothed_sql(_MACD))
def w5_macd(spark, sf_dir):
    return _day(feats.macd(_bars(spark, sf_dir)), *_rounded("MACD", "MACD_Signal", "MACD_Hist", digits=5))


@query(_smoothed_sql("round(atr, 5) AS ATR"))
def w6_atr(spark, sf_dir):
    return _day(feats.atr(_bars(spark, sf_dir)), *_rounded("ATR", digits=5))


@query(_smoothed_sql(f"{_RSI}, {_MACD}, round(atr, 5) AS ATR, round({_roll('avg', 20)}, 5) AS BB_Middle"))
def w7_add_features(spark, sf_dir):
    rows = feats.add_features(_bars(spark, sf_dir))
    return _day(rows, *_rounded("RSI", "MACD", "MACD_Signal", "MACD_Hist", "ATR", "BB_Middle", digits=5))


@query(f"WITH {RETURNS}, {_windows_sql('ret', ['Close', 'Volume'], LENGTH, 3)} SELECT * FROM win")
def w9_windows(spark, sf_dir):
    return windows.create_windows(feats.log_returns(_bars(spark, sf_dir)), LENGTH, ["Close", "Volume"], 3)


_SPLIT = "CASE WHEN window_id < floor(k * 0.7) THEN 'train' WHEN window_id < floor(k * 0.7) + floor(k * 0.15) THEN 'val' ELSE 'test' END"


@query(
    f"""WITH {WINDOWS}, sized AS (SELECT *, max(window_id) OVER (PARTITION BY ticker) + 1 AS k FROM win)
SELECT ticker, {_SPLIT.replace('0.7)', '0.7::DOUBLE)').replace('0.15)', '0.15::DOUBLE)')} AS split, count(*) AS n, min(window_id) AS first, max(window_id) AS last FROM sized GROUP BY ALL"""
)
def w10_split(spark, sf_dir):
    rows = windows.create_windows(feats.log_returns(_bars(spark, sf_dir)), LENGTH, COLUMNS)
    return windows.split(rows).groupBy("ticker", "split").agg(F.count("*").alias("n"), F.min("window_id").alias("first"), F.max("window_id").alias("last"))


_MINMAX = ", ".join(f"(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())) AS {c}" for c in windows.DEFAULT_FEATURES)


@query(
    f"""WITH {RETURNS}, scaled AS (SELECT ticker, Date, {_MINMAX} FROM derived), {_windows_sql('scaled', windows.DEFAULT_FEATURES)},
sized AS (SELECT *, max(window_id) OVER (PARTITION BY ticker) + 1 AS k FROM win)
SELECT ticker, {_SPLIT.replace('0.7)', '0.7::DOUBLE)').replace('0.15)', '0.15::DOUBLE)')} AS split, count(*) AS n, {", ".join(f"round(avg({c}::DOUBLE), 6) AS {c}" for c in windows.DEFAULT_FEATURES)} FROM sized GROUP BY ALL"""
)
def w11_preprocess(spark, sf_dir):
    rows, _, columns = windows.preprocess(_bars(spark, sf_dir))
    return rows.groupBy("ticker", "split").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in columns])


@query(
    f"""WITH {WINDOWS}, starts AS (SELECT ticker, coalesce(sum(n) OVER (ORDER BY ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT ticker, max(window_id) + 1 AS n FROM win GROUP BY 1))
SELECT ticker, step, min(s + window_id)::BIGINT AS first, max(s + window_id)::BIGINT AS last FROM win JOIN starts USING (ticker) GROUP BY ALL"""
)
def u1_union_of_tickers(spark, sf_dir):
    every = windows.create_windows(feats.log_returns(_bars(spark, sf_dir)), LENGTH, ["Close"])
    return windows.number(every).groupBy("ticker", "step").agg(F.min("window_id").alias("first"), F.max("window_id").alias("last"))


# --- scaling, tests, stylised facts


@query(f"WITH {BARS} SELECT ticker, {DAY}, round((Close - min(Close) OVER ()) / (max(Close) OVER () - min(Close) OVER ()), 9) AS Close, round((Volume - min(Volume) OVER ()) / (max(Volume) OVER () - min(Volume) OVER ()), 9) AS Volume FROM bars")
def a1_minmax(spark, sf_dir):
    return _day(windows.normalize(_bars(spark, sf_dir), ["Close", "Volume"])[0], *_rounded("Close", "Volume", digits=9))


@query(f"WITH {BARS} SELECT ticker, {DAY}, round((Close - avg(Close) OVER ()) / stddev_pop(Close) OVER (), 6) AS Close, round((Volume - avg(Volume) OVER ()) / stddev_pop(Volume) OVER (), 6) AS Volume FROM bars")
def a2_zscore(spark, sf_dir):
    return _day(windows.normalize(_bars(spark, sf_dir), ["Close", "Volume"], "zscore")[0], *_rounded("Close", "Volume"))


@query(
    f"""WITH {_series_sql(['Close', 'LogReturn'])},
c AS (SELECT feature, x, count(*) FILTER (real) AS r, count(*) FILTER (NOT real) AS s FROM series GROUP BY ALL),
f AS (SELECT feature, sum(r) OVER w / sum(r) OVER p AS fr, sum(s) OVER w / sum(s) OVER p AS fs, sum(r) OVER p AS n, sum(s) OVER p AS m FROM c
  WINDOW w AS (PARTITION BY feature ORDER BY x), p AS (PARTITION BY feature))
SELECT feature, round(max(abs(fr - fs)), 9) AS ks_statistic, max(n)::BIGINT AS n, max(m)::BIGINT AS m FROM f GROUP BY 1"""
)
def a4_ks_test(spark, sf_dir):
    return stats.ks_statistic(*_series(spark, sf_dir, ["Close", "LogReturn"])).select("feature", *_rounded("ks_statistic", digits=9), "n", "m")


#: Suppliers' balances by region, even keys against odd ones, and the exact p of each region's statistic: lattice paths
#: within the band, counted row by row.
EXACT_KS = """bal AS (SELECT r_name AS feature, s_acctbal AS x, s_suppkey % 2 = 0 AS real FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT feature, x, count(*) FILTER (real) AS r, count(*) FILTER (NOT real) AS s FROM bal GROUP BY ALL),
f AS (SELECT feature, sum(r) OVER w / sum(r) OVER p AS fr, sum(s) OVER w / sum(s) OVER p AS fs, sum(r) OVER p AS n, sum(s) OVER p AS m FROM c
  WINDOW w AS (PARTITION BY feature ORDER BY x), p AS (PARTITION BY feature)),
d AS (SELECT feature, max(abs(fr - fs)) AS d, max(n)::INT AS n, max(m)::INT AS m FROM f GROUP BY 1 HAVING max(n) > 0 AND max(m) > 0),
band AS (SELECT *, ceil(d * n * m - 1e-6) AS h FROM d),
paths AS (
  SELECT feature, n, m, h, 0 AS i, list_transform(range(0, m + 1), lambda j: CASE WHEN j * n < h THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cells FROM band
  UNION ALL
  SELECT feature, n, m, h, i + 1, list_transform(range(0, m + 1), lambda j: CASE WHEN abs((i + 1) * m - j * n) < h THEN list_sum(list_transform(range(0, j + 1), lambda k: CASE WHEN abs((i + 1) * m - k * n) < h THEN cells[k + 1] ELSE 0.0::DOUBLE END)) ELSE 0.0::DOUBLE END)
  FROM paths WHERE i < n),
p AS (SELECT d.feature, d.d, d.n, d.m, 1 - cells[d.m + 1] / exp(lgamma(d.n + d.m + 1) - lgamma(d.n + 1) - lgamma(d.m + 1)) AS p FROM paths JOIN d USING (feature) WHERE i = d.n)"""


def _balances(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_name").alias("feature"), F.col("s_acctbal").cast("double").alias("x"), (F.col("s_suppkey") % 2 == 0).alias("real"))
    return rows.filter("real"), rows.filter("NOT real")


@query(f"WITH RECURSIVE {EXACT_KS} SELECT feature, round(d, 9) AS ks_statistic, round(p, 6) AS p_value FROM p")
def a4_exact_ks(spark, sf_dir):
    found = {k: v for k, v in stats.ks_test(*_balances(spark, sf_dir)).items() if v["p_value"] is not None}
    return spark.createDataFrame([(k, round(v["ks_statistic"], 9), round(v["p_value"], 6)) for k, v in found.items()], "feature string, ks_statistic double, p_value double")


_KERNEL = "avg(exp(-list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 2))"


@query(
    f"""WITH {VECTORS}, k AS (SELECT (SELECT {_KERNEL} FROM real a, real b) AS xx, (SELECT {_KERNEL} FROM syn a, syn b) AS yy, (SELECT {_KERNEL} FROM real a, syn b) AS xy)
SELECT {_round_sql('xx', 'yy', 'xy', digits=9)}, round(xx + yy - 2 * xy, 9) AS mmd FROM k"""
)
def a5_mmd(spark, sf_dir):
    found = pairwise.mmd_rbf(*sources.vectors(spark, sf_dir))
    return spark.createDataFrame([tuple(round(found[k], 9) for k in ("xx", "yy", "xy", "mmd"))], "xx double, yy double, xy double, mmd double")


def _acf_query(lags: int, source: str = "series") -> str:
    ks = range(1, lags + 1)
    return f"""base AS (SELECT ticker, feature, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM {source} GROUP BY ALL),
centred AS (SELECT ticker, feature, idx, x - m AS x FROM {source} JOIN base USING (ticker, feature)),
lagged AS (SELECT ticker, feature, x, {", ".join(f"lag(x, {k}) OVER w AS l{k}" for k in ks)} FROM centred WINDOW w AS (PARTITION BY ticker, feature ORDER BY idx)),
prods AS (SELECT ticker, feature, unnest(range(1, {lags + 1})) AS lag, unnest([{", ".join(f"sum(x * l{k})" for k in ks)}]) AS s FROM lagged GROUP BY ticker, feature),
acf AS (SELECT ticker, feature, 0 AS lag, 1.0::DOUBLE AS acf FROM base UNION ALL SELECT ticker, feature, lag, s / (n - lag) / (v + 1e-10) FROM prods JOIN base USING (ticker, feature))"""


@query(
    f"""WITH {_series_sql(['Close', 'LogReturn'])}, {_acf_query(20)}
SELECT r.feature, r.lag::INT AS lag, round(r.acf, 6) AS real_acf, round(s.acf, 6) AS synthetic_acf FROM acf r JOIN acf s ON r.feature = s.feature AND r.lag = s.lag
WHERE substr(r.ticker, 2, 1) = 'F' AND substr(s.ticker, 2, 1) = 'O'"""
)
def a6_acf(spark, sf_dir):
    r, s = (stats.acf(x) for x in _series(spark, sf_dir, ["Close", "LogReturn"]))
    both = r.withColumnRenamed("acf", "real_acf").join(s.withColumnRenamed("acf", "synthetic_acf"), ["feature", "lag"])
    return both.select("feature", "lag", *_rounded("real_acf", "synthetic_acf"))


@query(
    f"""WITH {_series_sql(['Close', 'LogReturn'])}, {_acf_query(20)}
SELECT r.feature, round(avg(abs(r.acf - s.acf)), 6) AS mae, count(*) AS lags FROM acf r JOIN acf s ON r.feature = s.feature AND r.lag = s.lag
WHERE substr(r.ticker, 2, 1) = 'F' AND substr(s.ticker, 2, 1) = 'O' GROUP BY 1"""
)
def a7_acf_comparison(spark, sf_dir):
    return stats.acf_comparison(*_series(spark, sf_dir, ["Close", "LogReturn"])).select("feature", *_rounded("mae"), F.size("real_acf").cast("long").alias("lags"))


def _corr_sql() -> str:
    cell = " UNION ALL ".join(
        f"SELECT '{i}' AS i, '{j}' AS j, corr({i}::DOUBLE, {j}::DOUBLE) FILTER ({_REAL}) AS r, corr({i}::DOUBLE, {j}::DOUBLE) FILTER (NOT {_REAL}) AS s FROM win" for i in COLUMNS for j in COLUMNS
    )
    return f"{WINDOWS}, cells AS ({cell})"


@query(f"WITH {_corr_sql()} SELECT i, j, round(r, 6) AS real_corr, round(s, 6) AS synthetic_corr, round(r - s, 6) AS signed_diff, round(abs(r - s), 6) AS diff FROM cells")
def a8_cross_correlation(spark, sf_dir):
    cells = stats.cross_correlation(*_status_sets(spark, sf_dir), COLUMNS)
    return cells.select("i", "j", *[(F.round(c, 6) + 0.0).alias(c) for c in ("real_corr", "synthetic_corr", "signed_diff", "diff")])


@query(f"WITH {_corr_sql()} SELECT round(sqrt(sum((r - s) * (r - s))), 6) AS frobenius_norm FROM cells")
def a8_frobenius(spark, sf_dir):
    return stats.frobenius(stats.cross_correlation(*_status_sets(spark, sf_dir), COLUMNS)).select(*_rounded("frobenius_norm"))


@query(f"WITH {_series_sql(COLUMNS)} SELECT ticker || substr(feature, 2) AS feature, round(kurtosis_pop(x) + 3, 5) AS kurtosis, round(kurtosis_pop(x), 5) AS excess_kurtosis, kurtosis_pop(x) > 1.0 AS is_fat_tailed FROM series GROUP BY 1")
def a9_fat_tails(spark, sf_dir):
    return stats.fat_tails(_own_series(spark, sf_dir, COLUMNS)).select("feature", *_rounded("kurtosis", "excess_kurtosis", digits=5), "is_fat_tailed")


@query(
    f"""WITH {_series_sql(['LogReturn'])}, kinds AS (SELECT ticker, 'abs' AS feature, idx, abs(x) AS x FROM series UNION ALL SELECT ticker, 'sq', idx, x * x FROM series),
{_acf_query(20, 'kinds')},
m AS (SELECT ticker, avg(abs(acf)) FILTER (feature = 'abs') AS a, avg(abs(acf)) FILTER (feature = 'sq') AS s FROM acf WHERE lag > 0 GROUP BY 1)
SELECT ticker || ':LogReturn' AS feature, round(a, 6) AS acf_abs_returns, round(s, 6) AS acf_sq_returns, a > 0.05 AS has_clustering FROM m"""
)
def a10_volatility_clustering(spark, sf_dir):
    return stats.volatility_clustering(_own_series(spark, sf_dir, ["LogReturn"])).select("feature", *_rounded("acf_abs_returns", "acf_sq_returns"), "has_clustering")


@query(
    f"""WITH {_series_sql(['LogReturn'])}, c AS (SELECT ticker, unnest([{", ".join(f"corr(x, l{k})" for k in range(1, 11))}]) AS c FROM (SELECT ticker, x, {", ".join(f"lead(abs(x), {k}) OVER (PARTITION BY ticker ORDER BY idx) AS l{k}" for k in range(1, 11))} FROM series) GROUP BY ticker)
SELECT ticker || ':LogReturn' AS feature, round(avg(c), 6) AS mean_leverage_corr, avg(c) < -0.05 AS has_leverage_effect FROM c GROUP BY 1"""
)
def a11_leverage_effect(spark, sf_dir):
    rows = _own_series(spark, sf_dir, ["LogReturn"]).select("feature", "idx", F.col("x").alias("r"), F.abs("x").alias("vol"))
    return stats.leverage_effect(rows).select("feature", *_rounded("mean_leverage_corr"), "has_leverage_effect")


@query(
    f"""WITH {WINDOWS}, p AS (SELECT ticker, Volume::DOUBLE AS a, abs(LogReturn::DOUBLE) AS b FROM win),
r AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY a) + (count(*) OVER (PARTITION BY ticker, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY ticker ORDER BY b) + (count(*) OVER (PARTITION BY ticker, b) - 1) / 2 AS rb FROM p)
SELECT ticker AS feature, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n, corr(a, b) > 0.1 AS has_vol_volume_corr FROM r GROUP BY 1"""
)
def a12_volume_volatility(spark, sf_dir):
    rows = _windows(spark, sf_dir).select(F.col("ticker").alias("feature"), F.col("Volume").cast("double").alias("volume"), F.abs(F.col("LogReturn").cast("double")).alias("vol"))
    return stats.volume_volatility(rows).select("feature", *_rounded("pearson", "spearman"), "n", "has_vol_volume_corr")


_DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(
    f"""WITH {VECTORS},
s AS (SELECT d, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM (SELECT a.id, {_DISTANCE} AS d FROM syn a, real b)),
r AS (SELECT d, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM (SELECT a.id, {_DISTANCE} AS d FROM real a, real b)),
m AS (SELECT (SELECT avg(d) FROM s WHERE k BETWEEN 2 AND 6) AS s2r, (SELECT avg(d) FROM r WHERE k BETWEEN 2 AND 6) AS r2r)
SELECT round(s2r, 6) AS synthetic_to_real, round(r2r, 6) AS real_to_real, round(s2r / (r2r + 1e-10), 6) AS nndr, s2r / (r2r + 1e-10) < 0.5 AS privacy_risk FROM m"""
)
def a14_nndr(spark, sf_dir):
    return pairwise.nndr(*sources.vectors(spark, sf_dir)).select(*_rounded("synthetic_to_real", "real_to_real", "nndr"), "privacy_risk")


DCR = f"{VECTORS}, dcr AS (SELECT a.id, min({_DISTANCE}) AS dcr FROM syn a, real b GROUP BY a.id)"


@query(f"WITH {DCR} SELECT id, round(dcr, 6) AS dcr FROM dcr")
def a15_closest_record(spark, sf_dir):
    return pairwise.closest_record(*sources.vectors(spark, sf_dir)).select("id", *_rounded("dcr"))


@query(
    f"""WITH {DCR}, t AS (SELECT quantile_cont(dcr, 0.05) AS t FROM dcr)
SELECT round(avg(dcr), 6) AS mean_dcr, round(median(dcr), 6) AS median_dcr, round(min(dcr), 6) AS min_dcr, round(any_value(t), 6) AS p5_dcr,
  round(avg((dcr <= t)::INT), 6) AS membership_inference_risk, round(any_value(t), 6) AS threshold FROM dcr, t"""
)
def a16_membership_risk(spark, sf_dir):
    found = pairwise.membership_risk(pairwise.closest_record(*sources.vectors(spark, sf_dir)))
    return found.select(*_rounded("mean_dcr", "median_dcr", "min_dcr", "p5_dcr", "membership_inference_risk", "threshold"))


_PREDICTED = "SELECT (l_discount > 0.05)::INT AS y, (l_tax > 0.04)::INT AS prediction, round(l_tax, 2) AS score FROM lineitem"


@query(
    f"""WITH p AS ({_PREDICTED}), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM p),
s AS (SELECT sum(y * prediction) AS tp, sum(prediction) AS pp, sum(y) AS pos, count(*) AS n, sum(k * y) AS ranks, avg((y = prediction)::INT) AS acc FROM r)
SELECT round(acc, 6) AS accuracy, round(2 * tp / (pp + pos), 6) AS f1, round((ranks - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS roc_auc FROM s"""
)
def a17_classification_metrics(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_discount") > 0.05).cast("int").alias("y"), (F.col("l_tax") > 0.04).cast("int").alias("prediction"), F.round("l_tax", 2).alias("score"))
    return utility.classification_metrics(rows).select(*_rounded("accuracy", "f1", "roc_auc"))


def _facts_sql(rows: str) -> str:
    """Facts of series (series, idx, r, volume) named ``rows``, without p-values."""
    ks, ls = range(1, 21), range(1, 11)
    acf = lambda x, m, v: "(" + " + ".join(f"abs(sum(({x} - {m}) * (lag_{x}_{k} - {m})) / (any_value(n) - {k}) / (any_value({v}) + 1e-10))" for k in ks) + ") / 20"
    return f"""moved AS (
  SELECT series, idx, r, volume, abs(r) AS a, r * r AS q, {", ".join(f"lag(abs(r), {k}) OVER w AS lag_a_{k}, lag(r * r, {k}) OVER w AS lag_q_{k}" for k in ks)},
    {", ".join(f"lead(abs(r), {k}) OVER w AS next_{k}" for k in ls)} FROM {rows} WINDOW w AS (PARTITION BY series ORDER BY idx)),
base AS (SELECT series, avg(abs(r)) AS ma, var_pop(abs(r)) AS va, avg(r * r) AS mq, var_pop(r * r) AS vq, count(*) AS n FROM {rows} GROUP BY 1),
ranked AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY volume) + (count(*) OVER (PARTITION BY series, volume) - 1) / 2 AS rv, rank() OVER (PARTITION BY series ORDER BY abs(r)) + (count(*) OVER (PARTITION BY series, abs(r)) - 1) / 2 AS ra FROM {rows}),
ranks AS (SELECT series, corr(rv, ra) AS spearman FROM ranked GROUP BY 1),
facts AS (
  SELECT series, kurtosis_pop(r) AS excess_kurtosis, {acf("a", "ma", "va")} AS acf_abs_returns, {acf("q", "mq", "vq")} AS acf_sq_returns,
    ({" + ".join(f"corr(r, next_{k})" for k in ls)}) / 10 AS mean_leverage_corr, corr(volume, a) AS pearson, any_value(spearman) AS spearman, count(*) AS n
  FROM moved JOIN base USING (series) JOIN ranks USING (series) GROUP BY series)"""


@query(
    f"""WITH {WINDOWS}, rows AS (SELECT ticker AS series, window_id * {LENGTH} + step AS idx, LogReturn::DOUBLE AS r, Volume::DOUBLE AS volume FROM win), {_facts_sql("rows")}
SELECT series AS feature, round(excess_kurtosis + 3, 5) AS kurtosis, excess_kurtosis > 1 AS is_fat_tailed, {_round_sql("acf_abs_returns", "acf_sq_returns")}, acf_abs_returns > 0.05 AS has_clustering,
  {_round_sql("mean_leverage_corr")}, mean_leverage_corr < -0.05 AS has_leverage_effect, {_round_sql("pearson", "spearman")}, n, pearson > 0.1 AS has_vol_volume_corr FROM facts"""
)
def a13_stylized_facts(spark, sf_dir):
    r, idx = F.col("LogReturn").cast("double"), F.col("window_id") * LENGTH + F.col("step")
    rows = _windows(spark, sf_dir).select(F.col("ticker").alias("feature"), idx.alias("idx"), r.alias("r"), F.col("Volume").cast("double").alias("volume"), F.abs(r).alias("vol"))
    first, second = ["acf_abs_returns", "acf_sq_returns"], ["pearson", "spearman"]
    return stats.stylized_table(rows).select(
        "feature", F.round("kurtosis", 5).alias("kurtosis"), "is_fat_tailed", *_rounded(*first), "has_clustering", *_rounded("mean_leverage_corr"), "has_leverage_effect", *_rounded(*second), "n", "has_vol_volume_corr"
    )


_NEAREST = """s AS (SELECT d, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM (SELECT a.id, list_distance(a.v, b.v) AS d FROM syn a, real b)),
t AS (SELECT d, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM (SELECT a.id, list_distance(a.v, b.v) AS d FROM real a, real b)),
near AS (SELECT (SELECT avg(d) FROM s WHERE k BETWEEN 2 AND 6) AS s2r, (SELECT avg(d) FROM t WHERE k BETWEEN 2 AND 6) AS r2r, (SELECT avg(d) FROM s WHERE k = 1) AS mean_dcr),
kernel AS (SELECT (SELECT avg(exp(-(list_distance(a.v, b.v) ** 2) / 2)) FROM real a, real b) + (SELECT avg(exp(-(list_distance(a.v, b.v) ** 2) / 2)) FROM syn a, syn b) - 2 * (SELECT avg(exp(-(list_distance(a.v, b.v) ** 2) / 2)) FROM real a, syn b) AS mmd)"""


@query(
    f"""WITH RECURSIVE {EXACT_KS}, {VECTORS}, {_NEAREST}
SELECT round(((SELECT avg((p > 0.05)::INT) FROM p) + exp(-mmd) + least(1.0, s2r / (r2r + 1e-10))) / 3, 6) AS realism_score FROM near, kernel"""
)
def a18_realism_score(spark, sf_dir):
    """The score of three terms: exact tests of suppliers' balances, kernel distance and neighbour ratio of embeddings."""
    x, y = pairwise.in_cells(*sources.vectors(spark, sf_dir))  # one set of cells for the kernel and both searches
    tests = {k: v for k, v in stats.ks_test(*_balances(spark, sf_dir)).items() if v["p_value"] is not None}
    near = pairwise.neighbours(y, x, report.NEIGHBOURS + 1)[0]
    found = {"ks_tests": tests, "mmd": pairwise.mmd_of_cells(x, y)["mmd"], "privacy": {"nndr": pairwise.nndr_of_cells(x, near, report.NEIGHBOURS).first().asDict()}}
    return spark.createDataFrame([(round(report.realism_score(found), 6),)], "realism_score double")


def _report_sql() -> str:
    side = f"""numberless AS (SELECT *, {_REAL} AS real FROM win),
starts AS (SELECT ticker, real, coalesce(sum(k) OVER (PARTITION BY real ORDER BY ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT ticker, real, max(window_id) + 1 AS k FROM numberless GROUP BY ALL)),
every AS (SELECT real, (s + window_id)::BIGINT AS id, step, {", ".join(f"{c}::DOUBLE AS {c}" for c in COLUMNS)} FROM numberless JOIN starts USING (ticker, real))"""
    series = " UNION ALL ".join(f"SELECT real, '{c}' AS feature, id * {LENGTH} + step AS idx, {c} AS x FROM every" for c in COLUMNS)
    flat = ", ".join(COLUMNS)
    lags = range(1, 21)
    return f"""WITH {RETURNS}, {_windows_sql('ret', COLUMNS)}, {side}, series AS ({series}),
c AS (SELECT feature, x, count(*) FILTER (real) AS r, count(*) FILTER (NOT real) AS o FROM series GROUP BY ALL),
e AS (SELECT feature, sum(r) OVER w / sum(r) OVER p AS fr, sum(o) OVER w / sum(o) OVER p AS fo FROM c WINDOW w AS (PARTITION BY feature ORDER BY x), p AS (PARTITION BY feature)),
cb AS (SELECT real, feature, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM series GROUP BY ALL),
cl AS (SELECT real, feature, x - m AS x, m, v, n, {", ".join(f"lag(x - m, {k}) OVER (PARTITION BY real, feature ORDER BY idx) AS l{k}" for k in lags)} FROM series JOIN cb USING (real, feature)),
acf AS (SELECT real, feature, [{", ".join(f"sum(x * l{k}) / (any_value(n) - {k}) / (any_value(v) + 1e-10)" for k in lags)}] AS a FROM cl GROUP BY ALL),
mae AS (SELECT x.feature, list_sum(list_transform(list_zip(x.a, y.a), lambda z: abs(z[1] - z[2]))) / 21 AS mae FROM acf x JOIN acf y ON x.feature = y.feature AND x.real AND NOT y.real),
cells AS ({" UNION ALL ".join(f"SELECT corr({i}, {j}) FILTER (real) - corr({i}, {j}) FILTER (NOT real) AS d FROM every" for i in COLUMNS for j in COLUMNS)}),
rows AS (SELECT CASE WHEN real THEN 'real' ELSE 'synthetic' END AS series, id * {LENGTH} + step AS idx, LogReturn AS r, Volume AS volume FROM every), {_facts_sql("rows")},
flat AS (SELECT real AS side, id, flatten(list([{flat}] ORDER BY step)) AS v FROM every GROUP BY ALL),
real AS (SELECT id, v FROM flat WHERE side), syn AS (SELECT id, v FROM flat WHERE NOT side), {_NEAREST},
out AS (
  SELECT 'ks.' || feature AS metric, max(abs(fr - fo)) AS value FROM e GROUP BY feature UNION ALL SELECT 'acf_mae.' || feature, mae FROM mae
  UNION ALL SELECT 'frobenius_norm', sqrt(sum(d * d)) FROM cells UNION ALL SELECT 'mmd', mmd FROM kernel
  UNION ALL SELECT 'nndr', s2r / (r2r + 1e-10) FROM near UNION ALL SELECT 'mean_dcr', mean_dcr FROM near
  UNION ALL SELECT unnest([series || '.excess_kurtosis', series || '.acf_abs_returns', series || '.mean_leverage_corr', series || '.pearson', series || '.spearman']),
    unnest([excess_kurtosis, acf_abs_returns, mean_leverage_corr, pearson, spearman]) FROM facts)
SELECT metric, round(value, 5) + 0.0 AS value FROM out"""


@query(_report_sql())
def a19_full_report(spark, sf_dir):
    """Metrics of the whole report on all windows of all tickers, F against O; models are left to n15_tstr."""
    found = report.compute_all_metrics(*_status_sets(spark, sf_dir), COLUMNS, run_tstr=False)
    out = {f"ks.{k}": v["ks_statistic"] for k, v in found["ks_tests"].items()} | {f"acf_mae.{k}": v["mae"] for k, v in found["acf"].items()}
    out |= {"frobenius_norm": found["cross_correlation"]["frobenius_norm"], "mmd": found["mmd"], "nndr": found["privacy"]["nndr"]["nndr"], "mean_dcr": found["privacy"]["membership_inference"]["mean_dcr"]}
    for side in ("real", "synthetic"):
        facts = {k: v for part in found[f"stylized_facts_{side}"].values() for k, v in part.items()}
        out |= {f"{side}.{k}": facts[k] for k in ("excess_kurtosis", "acf_abs_returns", "mean_leverage_corr", "pearson", "spearman")}
    rows = spark.createDataFrame(list(out.items()), "metric string, value double")
    return rows.select("metric", (F.round("value", 5) + 0.0).alias("value"))


@query(
    "SELECT k, round(avg(x), 6) AS mean, round(stddev_pop(x) + 1e-8, 6) AS std FROM (SELECT unnest(range(1, 65)) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY k"
)
def a21_copula_fit(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding").alias("v"))
    fitted = generative.get_copula("gaussian", 64).fit(rows)
    found = [(k, round(float(m), 6), round(float(s), 6)) for k, (m, s) in enumerate(zip(fitted.means, fitted.stds, strict=True))]
    return spark.createDataFrame(found, "k long, mean double, std double")


@query("SELECT i - 1 AS i, j - 1 AS j, round(corr(embedding[i]::DOUBLE, embedding[j]::DOUBLE), 4) + 0.0 AS corr FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL")
def a21_copula_correlations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding").alias("v"))
    corr = generative.get_copula("gaussian", 64).fit(rows).corr
    found = [(i, j, round(float(corr[i, j]), 4) + 0.0) for i in range(64) for j in range(64)]
    return spark.createDataFrame(found, "i long, j long, corr double")


@query(
    """SELECT epoch, metric, round(avg(value), 6) AS value FROM (SELECT extract(day FROM ts)::INT AS epoch, event_type AS metric, value FROM events) GROUP BY ALL"""
)
def a22_epoch_means(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.dayofmonth("ts").alias("epoch"), F.col("event_type").alias("metric"), "value")
    return training.epoch_means(rows).select("epoch", "metric", *_rounded("value"))


@query(
    f"""WITH {BARS}, e AS (SELECT min(Close) AS lo, (max(Close) - min(Close)) / 50 AS w, count(*) AS n FROM bars),
c AS (SELECT least(floor((Close - lo) / w), 49)::INT AS bin, count(*) AS c FROM bars, e GROUP BY 1)
SELECT 'Close' AS feature, b::INT AS bin, round(lo + b * w, 6) AS left, coalesce(c, 0)::BIGINT AS count, round(coalesce(c, 0) / (n * w), 9) AS density
FROM e, unnest(range(0, 50)) AS t(b) LEFT JOIN c ON c.bin = b"""
)
def a23_histogram(spark, sf_dir):
    series = _bars(spark, sf_dir).select(F.lit("Close").alias("feature"), F.col("Close").alias("x"))
    return stats.histogram(series).select("feature", "bin", *_rounded("left"), "count", *_rounded("density", digits=9))


def _describe_sql() -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x FROM bars" for c in sources.OHLCV)
    return f"""WITH {BARS}, s AS ({each}) SELECT feature, count(x) AS count, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std, min(x) AS min,
  round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max FROM s GROUP BY 1"""


@query(_describe_sql())
def a25_describe(spark, sf_dir):
    return stats.describe(_bars(spark, sf_dir), sources.OHLCV).select("feature", "count", *_rounded("mean", "std", digits=5), "min", *_rounded("q25", "q50", "q75"), "max")


@query(f"WITH {BARS} SELECT ticker, count(*) AS rows, strftime(min(Date), '%Y-%m-%d') AS first, strftime(max(Date), '%Y-%m-%d') AS last FROM bars GROUP BY 1")
def a26_ticker_summary(spark, sf_dir):
    found = stats.ticker_summary(_bars(spark, sf_dir))
    return found.select("ticker", "rows", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first", "last")])


@query(f"WITH {WINDOWS} SELECT ticker, window_id, step, Close FROM win WHERE window_id < 5")
def t4_sample_series(spark, sf_dir):
    return stats.sample_series(_windows(spark, sf_dir), 5).select("ticker", "window_id", "step", "Close")


# --- losses, schedules, samplers

_L = "SELECT l_discount - 0.05 AS a, l_tax - 0.04 AS b, l_returnflag = 'R' AS real FROM lineitem"


@query(
    f"""WITH l AS ({_L}) SELECT round(avg(greatest(a, 0) - a * real::INT + ln(1 + exp(-abs(a)))), 6) AS adversarial, round(avg((a - b) * (a - b)), 6) AS mse, round(avg(abs(a - b)), 6) AS mae,
  round(-0.5 * avg(1 + b - a * a - exp(b)), 6) AS kl, round(avg((a - b) * (a - b)) + 0.5 * (-0.5 * avg(1 + b - a * a - exp(b))), 6) AS elbo FROM l"""
)
def m2_m6_losses(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_discount") - 0.05).alias("a"), (F.col("l_tax") - 0.04).alias("b"), (F.col("l_returnflag") == "R").alias("real"))
    a, b = F.col("a"), F.col("b")
    out = rows.agg(
        losses.bce_with_logits(a, F.col("real")).alias("adversarial"),
        losses.reconstruction(a, b).alias("mse"),
        losses.reconstruction(a, b, "mae").alias("mae"),
        losses.kl_divergence(a, b).alias("kl"),
        losses.elbo(losses.reconstruction(a, b), losses.kl_divergence(a, b), 0.5)["total"].alias("elbo"),
    )
    return out.select(*_rounded("adversarial", "mse", "mae", "kl", "elbo"))


@query(f"WITH {RETURNS} SELECT ticker, round(avg((Close - p) * (Close - p)), 3) AS loss FROM (SELECT ticker, Close, lag(Open) OVER (PARTITION BY ticker ORDER BY Date) AS p FROM ret) GROUP BY 1")
def m5_supervised_loss(spark, sf_dir):
    rows = feats.log_returns(_bars(spark, sf_dir)).withColumn("p", F.lag("Open").over(feats.by_date()))
    return rows.groupBy("ticker").agg(F.round(losses.supervised(F.col("Close"), F.col("p")), 3).alias("loss"))


LINEAR = "s AS (SELECT range::INT AS t, 1e-4 + range * (0.02 - 1e-4) / 999 AS beta FROM range(1000))"
COSINE = "s AS (SELECT t::INT AS t, least(greatest(1 - pow(cos(((t + 1) / 1000.0::DOUBLE + 0.008) / 1.008 * pi() / 2), 2) / pow(cos((t / 1000.0::DOUBLE + 0.008) / 1.008 * pi() / 2), 2), 0), 0.999) AS beta FROM range(1000) r(t))"
CONSTANTS = """c AS (SELECT *, 1 - beta AS alpha, product(1 - beta) OVER (ORDER BY t) AS bar FROM s),
k AS (SELECT *, lag(bar, 1, 1.0) OVER (ORDER BY t) AS before FROM c)"""
_CONST = "round(bar, 9) AS alpha_bar, round(before, 9) AS alpha_bar_prev, round(sqrt(bar), 9) AS sqrt_alpha_bar, round(sqrt(1 - bar), 9) AS sqrt_one_minus_alpha_bar, round(ln(1 - bar), 6) AS log_one_minus_alpha_bar, round(sqrt(1 / bar), 4) AS sqrt_recip_alpha_bar, round(sqrt(1 / bar - 1), 4) AS sqrt_recipm1_alpha_bar, round(beta * (1 - before) / (1 - bar), 9) AS posterior_variance"
_CONST_NAMES = [("alpha_bar", 9), ("alpha_bar_prev", 9), ("sqrt_alpha_bar", 9), ("sqrt_one_minus_alpha_bar", 9), ("log_one_minus_alpha_bar", 6), ("sqrt_recip_alpha_bar", 4), ("sqrt_recipm1_alpha_bar", 4), ("posterior_variance", 9)]


_ORDERS = "o AS (SELECT (o_orderkey % 1000)::INT AS t, count(*) AS orders, avg(o_totalprice) AS price FROM orders GROUP BY 1)"


def _orders_at_steps(spark, sf_dir) -> DataFrame:
    """Number and mean price of the orders that each step of a schedule noises."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy((F.col("o_orderkey") % 1000).cast("int").alias("t")).agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("price"))


@query(f"WITH {LINEAR}, {CONSTANTS}, {_ORDERS} SELECT t, round(beta, 9) AS beta, {_CONST}, orders, round(sqrt(bar) * price, 2) AS signal FROM k JOIN o USING (t)")
def m7_m9_linear_schedule(spark, sf_dir):
    constants = generative.schedule_constants(generative.linear_schedule(spark, 1000))
    rows = _orders_at_steps(spark, sf_dir).join(F.broadcast(constants), "t")
    signal = F.round(F.col("sqrt_alpha_bar") * F.col("price"), 2).alias("signal")
    return rows.select("t", *_rounded("beta", digits=9), *[F.round(c, d).alias(c) for c, d in _CONST_NAMES], "orders", signal)


@query(f"WITH {COSINE}, {CONSTANTS}, {_ORDERS} SELECT t, round(beta, 9) AS beta, orders, round(sqrt(bar) * price, 2) AS signal FROM k JOIN o USING (t)")
def m8_cosine_schedule(spark, sf_dir):
    constants = generative.schedule_constants(generative.cosine_schedule(spark, 1000))
    rows = _orders_at_steps(spark, sf_dir).join(F.broadcast(constants), "t")
    return rows.select("t", *_rounded("beta", digits=9), "orders", F.round(F.col("sqrt_alpha_bar") * F.col("price"), 2).alias("signal"))


@query(
    f"""WITH {LINEAR}, {CONSTANTS}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v, (vec_id % 1000)::INT AS t FROM embeddings)
SELECT vec_id, t, round(list_sum(list_transform(v, lambda x: sqrt(bar) * x + sqrt(1 - bar) * x * x)), 5) AS total FROM e JOIN k USING (t)"""
)
def m10_q_sample(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 1000).cast("int").alias("t"), F.col("embedding").cast("array<double>").alias("x0"))
    rows = rows.withColumn("noise", F.transform("x0", lambda x: x * x))
    out = generative.q_sample(rows, generative.schedule_constants(generative.linear_schedule(spark, 1000)))
    return out.select("vec_id", "t", F.round(F.aggregate("x_t", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


_STEPS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_transform(embedding::DOUBLE[], lambda y: y * y) AS z, (vec_id % 999 + 1)::INT AS t FROM embeddings)"""


def _stepped(spark, sf_dir, method: str, eta: float = 0.0) -> DataFrame:
    """Sums of each embedding a step back, the predicted noise being its squares and the drawn one 0.5."""
    v = F.col("embedding").cast("array<double>")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", v.alias("x"), (F.col("vec_id") % 999 + 1).cast("int").alias("t"))
    rows = rows.withColumns({"noise": F.transform("x", lambda y: y * y), "z": F.transform("x", lambda y: F.lit(0.5))})
    out = generative.reverse_step(rows, generative.schedule_constants(generative.linear_schedule(spark, 1000)), method, eta)
    return out.select("vec_id", F.round(F.aggregate("x_prev", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(
    f"""WITH {LINEAR}, {CONSTANTS}, {_STEPS}
SELECT vec_id, round(list_sum(list_transform(list_zip(x, z), lambda y: (y[1] - beta / sqrt(1 - bar) * y[2]) / sqrt(1 - beta) + sqrt(beta * (1 - before) / (1 - bar)) * 0.5)), 5) AS total FROM e JOIN k USING (t)"""
)
def m11_ddpm_step(spark, sf_dir):
    return _stepped(spark, sf_dir, "ddpm")


@query(
    f"""WITH {LINEAR}, {CONSTANTS}, {_STEPS}, g AS (SELECT *, 0.3 * sqrt((1 - before) / (1 - bar)) * sqrt(1 - bar / before) AS sigma FROM k)
SELECT vec_id, round(list_sum(list_transform(list_zip(x, z), lambda y: sqrt(before) * (y[1] - sqrt(1 - bar) * y[2]) / sqrt(bar) + sqrt(1 - before - sigma * sigma) * y[2] + sigma * 0.5)), 5) AS total FROM e JOIN g USING (t)"""
)
def m12_ddim_step(spark, sf_dir):
    return _stepped(spark, sf_dir, "ddim", 0.3)


@query("SELECT vec_id, i::INT AS i, ((ceil(1000 / (1000 // n)) - 1 - i) * (1000 // n))::INT AS t FROM (SELECT vec_id, vec_id % 40 + 1 AS n FROM embeddings) JOIN range(40) r(i) ON i < n")
def t6_strided_timesteps(spark, sf_dir):
    # of the steps 0, s, 2 s.. all are walked from the last one on, no more than each vector asks for
    chain = generative.strided_timesteps(1000, F.col("vec_id") % 40 + 1)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode(chain).alias("i", "t"))


@query()
def m12_ddim_sampler(spark, sf_dir):
    """As many vectors as there are embeddings, sampled under the denoiser of normals with their means and deviations."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding").alias("v"))
    fitted, schedule = generative.get_copula("gaussian", 64).fit(rows), generative.linear_schedule(spark, 1000)
    bars = [r[0] for r in generative.schedule_constants(schedule).orderBy("t").select("alpha_bar").collect()]  # the schedule alone
    return generative.diffusion_sample(spark, schedule, generative.normal_denoiser(fitted.means, fitted.stds, bars), rows.count(), 1, 64)


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), lambda z: z[1] + z[2] * exp(z[1] / 2))), 5) AS total FROM embeddings")
def m13_reparameterise(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.zip_with(v, F.reverse(v), lambda x, e: losses.reparameterised(x, x, e)).alias("z"))
    return rows.select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(
    """WITH d AS (SELECT extract(doy FROM o_orderdate)::BIGINT AS t, count(*) AS orders FROM orders GROUP BY 1)
SELECT t, k, round(CASE WHEN k < 8 THEN sin(t * pow(10000.0::DOUBLE, -k / 7.0::DOUBLE)) ELSE cos(t * pow(10000.0::DOUBLE, -(k - 8) / 7.0::DOUBLE)) END, 6) + 0.0 AS x, orders FROM d, (SELECT range::INT AS k FROM range(16))"""
)
def m14_time_embedding(spark, sf_dir):
    """Embeddings of the days of the year on which orders came."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.dayofyear("o_orderdate").cast("long").alias("t")).agg(F.count("*").alias("orders"))
    rows = days.select("t", "orders", F.posexplode(losses.sinusoidal(F.col("t").cast("double"), 16)).alias("k", "x"))
    return rows.select("t", "k", (F.round("x", 6) + 0.0).alias("x"), "orders")


@query(
    """WITH e AS (SELECT extract(day FROM ts)::BIGINT - 1 AS epoch, avg(value) AS value FROM events GROUP BY 1)
SELECT epoch, round(0.5 * least(1.0, epoch / 20), 9) AS beta, round(0.5 * least(1.0, epoch / 20) * value, 6) AS weighted FROM e"""
)
def m15_kl_annealing(spark, sf_dir):
    """The weight of each day of the events' month, and their mean value weighed by it."""
    days = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.dayofmonth("ts") - 1).cast("long").alias("epoch")).agg(F.avg("value").alias("value"))
    beta = losses.annealed_beta(F.col("epoch").cast("double"), 0.5, 20)
    return days.select("epoch", F.round(beta, 9).alias("beta"), F.round(beta * F.col("value"), 6).alias("weighted"))


@query()
def m16_copula_samples(spark, sf_dir):
    """Latents of both copulas fitted to the embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding").alias("v"))
    made = [generative.get_copula(k, 64).fit(rows).sample(spark, 100).withColumn("copula", F.lit(k)) for k in ("gaussian", "student_t")]
    return made[0].unionByName(made[1])


@query(
    f"""WITH {WINDOWS}, l AS (SELECT ticker, step, unnest(['Close', 'LogReturn']) AS dim, unnest([Close, LogReturn])::DOUBLE AS x FROM win),
r AS (SELECT step, dim, avg(x) AS m, sqrt(var_samp(x) + 1e-6) AS s FROM l WHERE {_REAL} GROUP BY ALL), s AS (SELECT step, dim, avg(x) AS m, sqrt(var_samp(x) + 1e-6) AS s FROM l WHERE NOT {_REAL} GROUP BY ALL)
SELECT round(avg(abs(r.m - s.m)), 5) AS mean_gap, round(avg(abs(r.s - s.s)), 5) AS std_gap, round(avg(abs(r.m - s.m)) + avg(abs(r.s - s.s)), 5) AS loss FROM r JOIN s USING (step, dim)"""
)
def m19_moment_matching(spark, sf_dir):
    cells = [stats.long_series(w, ["Close", "LogReturn"], LENGTH).select((F.col("idx") % LENGTH).alias("step"), F.col("feature").alias("dim"), "x") for w in _status_sets(spark, sf_dir)]
    return generative.moment_matching(*cells).select(*_rounded("mean_gap", "std_gap", "loss", digits=5))


@query(f"WITH {VECTORS} SELECT a.id AS real_id, b.id AS synthetic_id, round(list_inner_product(a.v, b.v), 6) AS dot, round({_DISTANCE}, 6) AS distance FROM real a JOIN syn b ON b.id = a.id + 1")
def m20_vector_products(spark, sf_dir):
    r, s = sources.vectors(spark, sf_dir)
    both = r.join(s.select(F.col("id").alias("synthetic_id"), F.col("v").alias("w")), F.col("synthetic_id") == F.col("id") + 1)
    return both.select(F.col("id").alias("real_id"), "synthetic_id", F.round(losses.dot("v", "w"), 6).alias("dot"), F.round(losses.euclidean("v", "w"), 6).alias("distance"))


@query(
    """WITH h AS (SELECT extract(day FROM ts)::INT AS epoch, event_type AS metric, avg(value) AS value FROM events GROUP BY ALL),
b AS (SELECT *, min(value) OVER (PARTITION BY metric ORDER BY epoch) AS best FROM h)
SELECT metric, epoch, round(best, 6) AS best, (row_number() OVER (PARTITION BY metric, best ORDER BY epoch) - 1)::INT AS waited FROM b"""
)
def n13_stopping_trace(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.dayofmonth("ts").alias("epoch"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return training.stopping_trace(rows, 5).select("metric", "epoch", *_rounded("best"), "waited")


@query(
    f"""WITH {WINDOWS}, w AS (SELECT DISTINCT ticker, window_id FROM win WHERE {_REAL}),
r AS (SELECT *, row_number() OVER (ORDER BY window_id, ticker) AS r, count(*) OVER () AS n FROM w)
SELECT CASE WHEN r <= n - floor(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS part, ticker, count(*) AS n, min(window_id) AS first, max(window_id) AS last FROM r GROUP BY ALL"""
)
def t3_tail_split(spark, sf_dir):
    rows = _status_sets(spark, sf_dir)[0].select("ticker", "window_id").distinct()
    train, test = (x.withColumn("part", F.lit(k)) for k, x in zip(("train", "test"), utility.tail_split(rows), strict=True))
    return train.union(test).groupBy("part", "ticker").agg(F.count("*").alias("n"), F.min("window_id").alias("first"), F.max("window_id").alias("last"))


@query()
def n15_tstr(spark, sf_dir):
    """Accuracy, F1 and area of models trained on real and on synthetic windows."""
    real, made = (windows.classification(windows.as_arrays(w, COLUMNS), COLUMNS.index("LogReturn")) for w in _status_sets(spark, sf_dir))
    found = utility.tstr_benchmark(real, made)
    return spark.createDataFrame([(k, *v.values()) for k, v in found.items()], "model string, accuracy double, f1 double, roc_auc double")


@query()
def n6_adversarial_generate(spark, sf_dir):
    """Sequences of an untrained adversarial model, as many as there are bars: the generator protocol."""
    from tickforge.operators.networks import AdversarialModel

    return AdversarialModel(len(COLUMNS)).generate(spark, _bars(spark, sf_dir).count(), LENGTH)


@query()
def n11_variational_generate(spark, sf_dir):
    """Sequences of an untrained variational model, as many as there are bars, latents from the prior."""
    from tickforge.operators.networks import VariationalModel

    return VariationalModel(len(COLUMNS)).generate(spark, _bars(spark, sf_dir).count(), LENGTH)


def _trained(spark: SparkSession, sf_dir: str, kind: str, *phases, **options) -> DataFrame:
    """(phase, epoch, metric, value): losses of small models trained on all training windows of the scaled bars."""
    from tickforge.operators import fitting

    made, _, columns = windows.preprocess(_bars(spark, sf_dir))
    made = made.filter("split = 'train'").drop("split")
    model, out = fitting.build(kind, len(columns), **options), []
    for k, (aims, epochs) in enumerate(phases):
        model, history = fitting.fit(windows.as_arrays(made, columns), model, aims, epochs, 0.005, 32)
        out += [(k, e + 1, name, x) for name, values in history.items() for e, x in enumerate(values)]
    return spark.createDataFrame(out, "phase int, epoch int, metric string, value double")


@query()
def n3_n5_adversarial_training(spark, sf_dir):
    from tickforge.operators import fitting

    return _trained(spark, sf_dir, "adversarial", (fitting.autoencoding(), 1), (fitting.supervising(), 1), (fitting.adversarial(), 1), hidden=8, layers=1)


@query()
def n8_diffusion_training(spark, sf_dir):
    from tickforge.operators import fitting

    schedule = generative.schedule_constants(generative.linear_schedule(spark, 100)).orderBy("t").select("alpha_bar")
    bars = [r[0] for r in schedule.collect()]  # the schedule alone
    return _trained(spark, sf_dir, "diffusion", (fitting.denoising(bars), 2), widths=(16, 32, 16), embedding=16, blocks=1)


@query()
def n11_variational_training(spark, sf_dir):
    from tickforge.operators import fitting

    return _trained(spark, sf_dir, "variational", (fitting.variational(1.0, 2), 3), hidden=16, layers=1)


@query()
def n17_plots(spark, sf_dir):
    """The four pictures as SVG texts, of bars and of real against synthetic windows."""
    from tickforge.operators import plots

    bars = feats.log_returns(_bars(spark, sf_dir))
    real, made = (stats.long_series(w, ["Close", "LogReturn"], LENGTH) for w in _status_sets(spark, sf_dir))
    cells = stats.correlations(bars, COLUMNS)
    tickers = [r[0] for r in bars.select("ticker").distinct().orderBy("ticker").collect()]  # one picture a ticker
    out = [
        *[(f"candlestick {t}", plots.candlestick(bars.filter(F.col("ticker") == t))) for t in tickers],
        ("distributions", plots.distributions(real, made)),
        ("correlations", plots.heatmap(cells)),
        ("time_series", plots.time_series(bars.select("ticker", "Date", "Close"), "Close")),
    ]
    return spark.createDataFrame(out, "plot string, svg string")
