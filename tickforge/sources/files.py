"""File sources and sinks: bars, arrays, reports, metric logs, configuration.

Tables go through Spark's readers and writers, partitioned by ticker so that scans prune.
NumPy arrays are read and written by tasks. Reports and YAML are small artefacts of the driver.
Their paths may be local ones or URIs of a shared or remote store.
"""

from __future__ import annotations

import argparse
import io
import json
import logging
import os
import uuid
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.sources import arrays
from tickforge.sources.bars import KEYS, OHLCV
from tickforge.sources.places import store

log = logging.getLogger(__name__)
FORMATS = ("parquet", "csv")
BAR_SCHEMA = T.StructType([T.StructField("Date", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in OHLCV], T.StructField("ticker", T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def write_bytes(path: str, data: bytes) -> None:
    system, place = store(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    with system.open_output_stream(place) as out:
        out.write(data)


def append_line(path: str, line: str) -> None:
    """Opens and closes the file, so that nothing waits in memory. The store must be able to append."""
    system, place = store(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    with system.open_append_stream(place, compression=None) as out:
        out.write(f"{line}\n".encode())


def read_bytes(path: str) -> bytes:
    system, place = store(path)
    with system.open_input_file(place) as f:
        return f.read()


def is_file(path: str) -> bool:
    from pyarrow import fs

    system, place = store(path)
    return system.get_file_info(place).type == fs.FileType.File


def write_bars(bars: DataFrame, folder: str, interval: str = "1d", file_format: str = "parquet") -> None:
    """One folder per ticker below ``folder/interval``. Rows with null values are left out."""
    if file_format not in FORMATS:
        raise ValueError(f"unknown format {file_format!r}")
    rows = bars.select(*KEYS, *OHLCV).dropna(subset=OHLCV)
    writer = rows.repartition("ticker").write.mode("overwrite").partitionBy("ticker")
    path = f"{folder}/{interval}-{file_format}"
    writer.parquet(path) if file_format == "parquet" else writer.csv(path, header=True)


def load_bars(spark: SparkSession, ticker: str | None, folder: str, interval: str = "1d", file_format: str = "parquet") -> DataFrame | None:
    """Bars of a ticker (all: None), or None if there are none. The ticker prunes partitions."""
    if file_format not in FORMATS:
        raise ValueError(f"unknown format {file_format!r}")
    path = f"{folder}/{interval}-{file_format}"
    if not _exists(spark, path if ticker is None else f"{path}/ticker={ticker}"):
        return None
    reader = spark.read.schema(BAR_SCHEMA)
    rows = reader.parquet(path) if file_format == "parquet" else reader.csv(path, header=True)
    return rows if ticker is None else rows.filter(F.col("ticker") == ticker)


def ingest(
    spark: SparkSession,
    tickers: Iterable[str],
    fetch: Callable[[SparkSession, str], DataFrame | None],
    folder: str,
    interval: str = "1d",
    file_format: str = "parquet",
) -> DataFrame | None:
    """Bars of every ticker that ``fetch`` finds, written and returned. Empty and failing tickers are logged and skipped."""
    found = []
    for ticker in tickers:
        try:
            rows = fetch(spark, ticker)
        except (OSError, ValueError, LookupError, AnalysisException):  # the source's errors; the cluster's go on
            log.exception("%s can't be fetched", ticker)
            continue
        if rows is None or rows.isEmpty():
            log.warning("%s has no bars", ticker)
            continue
        found.append(rows.withColumn("ticker", F.lit(ticker)).select(*KEYS, *OHLCV))
    if not found:
        return None
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    write_bars(every, folder, interval, file_format)
    return load_bars(spark, None, folder, interval, file_format)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: parquet, csv, or an array in ``.npy`` as rows (id, v) or windows (window_id, step, f0..)."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith(".npy"):
        return arrays.read(spark, path)
    raise ValueError(f"unknown suffix: {path}")


def save_array(windows: DataFrame, path: str, features: list[str]) -> None:
    """Windows as one ``.npy`` array, written by the tasks; a folder of parts where the store can't write into a file."""
    arrays.write(windows, path, features)


def load_processed(spark: SparkSession, processed: str, ticker: str, raw: str, interval: str = "1d") -> DataFrame | None:
    """A processed table if there is one, else raw bars, else None."""
    path = f"{processed}/{ticker}.parquet"
    return spark.read.parquet(path) if _exists(spark, path) else load_bars(spark, ticker, raw, interval)


def save_report(report: dict, folder: str) -> str:
    """``evaluation_report.json`` with NumPy values as plain ones."""

    def plain(x: Any) -> Any:
        return x.item() if isinstance(x, np.generic) else x.tolist() if isinstance(x, np.ndarray) else str(x)

    path = f"{folder.rstrip('/')}/evaluation_report.json"
    write_bytes(path, json.dumps(report, indent=2, default=plain).encode())
    return path


METRIC_SCHEMA = "epoch int, metric string, value double"


def log_metrics(path: str, epoch: int, metrics: dict[str, float]) -> None:
    """Appends lines of JSON (epoch, metric, value) below ``path``, without a Spark job.

    Where a store can't append, each call writes a file of its own there.
    """
    lines = "\n".join(json.dumps({"epoch": epoch, "metric": k, "value": float(v)}) for k, v in metrics.items())
    if not lines:
        return
    try:
        append_line(f"{path}/metrics.json", lines)
    except NotImplementedError:
        write_bytes(f"{path}/metrics-{uuid.uuid4().hex}.json", f"{lines}\n".encode())


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).json(path)


def save_checkpoint(path: str, state: dict[str, np.ndarray], epoch: int, metrics: dict[str, float] | None = None) -> None:
    """Arrays of a model with their epoch and metrics, in ``path`` (``.npz`` is added where it lacks)."""
    out = io.BytesIO()
    np.savez(out, __meta__=np.array(json.dumps({"epoch": epoch, "metrics": metrics or {}})), **state)
    write_bytes(path if path.endswith(".npz") else f"{path}.npz", out.getvalue())


def load_checkpoint(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """(arrays, {epoch, metrics}); arrays saved without a wrapper are accepted too."""
    with np.load(io.BytesIO(read_bytes(path)), allow_pickle=False) as data:
        meta = json.loads(str(data["__meta__"])) if "__meta__" in data.files else {"epoch": None, "metrics": {}}
        return {k: data[k] for k in data.files if k != "__meta__"}, meta


def load_config(path: str) -> dict:
    import yaml

    if not is_file(path):
        raise FileNotFoundError(path)
    return yaml.safe_load(read_bytes(path)) or {}


def merge_configs(base: dict, override: dict) -> dict:
    """Nested union, the right side winning."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merge_configs(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_and_merge(*paths: str) -> dict:
    out: dict = {}
    for path in paths:
        out = merge_configs(out, load_config(path))
    return out


def setup_logging(level: str = "INFO", path: str | None = None) -> logging.Logger:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        handlers.append(logging.FileHandler(path))
    logger = logging.getLogger("tickforge")
    logger.handlers[:] = handlers
    logger.setLevel(level)
    return logger


def main(argv: list[str] | None = None) -> None:
    """Copies bars from a table of bars into the ticker store."""
    parse = argparse.ArgumentParser(description=main.__doc__)
    parse.add_argument("source", help="parquet table with ticker, Date and OHLCV columns")
    parse.add_argument("--tickers", nargs="+", required=True)
    parse.add_argument("--output-dir", default="data/raw")
    parse.add_argument("--interval", default="1d")
    parse.add_argument("--format", default="parquet", choices=FORMATS)
    args = parse.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()

    def fetch(session: SparkSession, ticker: str) -> DataFrame:
        return session.read.parquet(args.source).filter(F.col("ticker") == ticker)

    rows = ingest(spark, args.tickers, fetch, args.output_dir, args.interval, args.format)
    if rows is not None:
        rows.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("Date").alias("first"), F.max("Date").alias("last")).show()
