"""Pictures are well-formed and bounded."""

import datetime
from xml.etree import ElementTree

from pyspark.sql import functions as F

from tickforge.operators import plots

BARS = "ticker string, Date date, Open double, High double, Low double, Close double, Volume double"


def bars(spark, n):
    day = datetime.date(2020, 1, 1)
    return spark.createDataFrame([("A<", day + datetime.timedelta(i), 10.0 + i % 7, 20.0, 5.0, 12.0, 100.0) for i in range(n)], BARS)


def test_candlestick(spark):
    count = lambda svg: sum(e.tag.endswith("line") for e in ElementTree.fromstring(svg))
    assert count(plots.candlestick(bars(spark, 5))) == 5
    assert count(plots.candlestick(bars(spark, 500), marks=50)) == 50
    assert count(plots.candlestick(bars(spark, 1).limit(0))) == 0 and count(plots.candlestick(bars(spark, 1))) == 1


def test_others(spark):
    x = spark.createDataFrame([("a", float(i % 9)) for i in range(50)], "feature string, x double")
    cells = spark.createDataFrame([("a", "a", 1.0), ("a", "b", None), ("b", "a", None), ("b", "b", 1.0)], "i string, j string, corr double")
    for svg in (plots.distributions(x, x.limit(0)), plots.heatmap(cells), plots.time_series(bars(spark, 9), "Close"), plots.time_series(bars(spark, 9).limit(0), "Close")):
        assert ElementTree.fromstring(svg).tag.endswith("svg")


def test_a_line_for_every_ticker(spark):
    every = bars(spark, 9).crossJoin(spark.range(11)).withColumn("ticker", F.concat("ticker", F.col("id").cast("string")))
    lines = lambda svg: sum(e.tag.endswith("polyline") for e in ElementTree.fromstring(svg))
    assert lines(plots.time_series(every, "Close")) == 11
    assert lines(plots.time_series(every, "Close", num_samples=4)) == 4
