"""Pictures as SVG texts. What is drawn is aggregated in Spark first, to a bounded number of marks."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.operators import stats

WIDTH, HEIGHT, EDGE = 900, 400, 40
COLOURS = ("#1f77b4", "#d95f02", "#1b9e77", "#7570b3", "#e7298a", "#66a61e", "#e6ab02", "#666666")
#: Marks along an axis at most.
MARKS = 400


def _svg(parts: list[str], title: str, width: int = WIDTH, height: int = HEIGHT) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" font-family="sans-serif" font-size="11">'
    return "\n".join([head, f'<rect width="{width}" height="{height}" fill="white"/>', f'<text x="{EDGE}" y="20" font-size="14">{escape(title)}</text>', *parts, "</svg>"])


def _scale(low: float, high: float, start: float, end: float):
    span = (high - low) or 1.0
    return lambda v: round(start + (v - low) / span * (end - start), 2)


def _axis(low: float, high: float) -> list[str]:
    y = _scale(low, high, HEIGHT - EDGE, EDGE)
    return [f'<text x="2" y="{y(v)}">{v:.4g}</text>' for v in (low, (low + high) / 2, high)]


def _buckets(bars: DataFrame, marks: int) -> DataFrame:
    """Numbers each series' bars 0 .. marks - 1 by equal spans of time."""
    w = Window.partitionBy("ticker")
    at = F.unix_micros(F.col("Date").cast("timestamp"))
    first, last = F.min(at).over(w), F.max(at).over(w)
    return bars.withColumn("_bucket", F.least(F.floor(F.coalesce(F.try_divide((at - first) * marks, last - first), F.lit(0))), F.lit(marks - 1)).cast("int"))


def candlestick(bars: DataFrame, title: str = "Bars", marks: int = 120) -> str:
    """Bars of one series; neighbouring ones are merged where there are more than ``marks``."""
    order = F.col("Date")
    merged = _buckets(bars, marks).groupBy("_bucket").agg(
        F.min_by("Open", order).alias("o"), F.max("High").alias("h"), F.min("Low").alias("l"), F.max_by("Close", order).alias("c"), F.sum("Volume").alias("v")
    )
    rows = sorted(tuple(r) for r in merged.collect() if None not in tuple(r)[:5])  # at most ``marks``
    if not rows:
        return _svg([], title)
    low, high, most = min(r[3] for r in rows), max(r[2] for r in rows), max(r[5] or 0 for r in rows)
    x, y = _scale(0, marks, EDGE, WIDTH - EDGE), _scale(low, high, HEIGHT - 3 * EDGE, EDGE)
    bar = _scale(0, most, 0, 1.5 * EDGE)
    wide, parts = (WIDTH - 2 * EDGE) / marks * 0.7, []
    for k, o, h, lo, c, v in rows:
        colour = COLOURS[2] if c >= o else COLOURS[1]
        parts.append(f'<line x1="{x(k + 0.5)}" x2="{x(k + 0.5)}" y1="{y(h)}" y2="{y(lo)}" stroke="{colour}"/>')
        parts.append(f'<rect x="{x(k + 0.15)}" width="{wide:.2f}" y="{y(max(o, c))}" height="{max(1.0, abs(y(o) - y(c))):.2f}" fill="{colour}"/>')
        parts.append(f'<rect x="{x(k + 0.15)}" width="{wide:.2f}" y="{HEIGHT - EDGE - bar(v or 0)}" height="{bar(v or 0)}" fill="{colour}" opacity="0.5"/>')
    return _svg([*parts, *(f'<text x="2" y="{y(v)}">{v:.4g}</text>' for v in (low, high))], title)


def distributions(real: DataFrame, synthetic: DataFrame, bins: int = 50, title: str = "Distributions") -> str:
    """Densities of (feature, x) rows, real against synthetic, a panel a feature."""
    cells = [stats.histogram(rows, bins).orderBy("feature", "bin").collect() for rows in (real, synthetic)]  # features x bins
    names = sorted({r["feature"] for side in cells for r in side})
    parts = []
    for n, name in enumerate(names):
        mine = [[r for r in side if r["feature"] == name and r["left"] is not None] for side in cells]
        every = [r for side in mine for r in side]
        if not every:
            continue
        top = n * HEIGHT
        x = _scale(min(r["left"] for r in every), max(r["right"] for r in every), EDGE, WIDTH - EDGE)
        y = _scale(0, max(r["density"] or 0 for r in every), top + HEIGHT - EDGE, top + EDGE)
        for side, colour in zip(mine, COLOURS, strict=False):
            parts += [f'<rect x="{x(r["left"])}" width="{x(r["right"]) - x(r["left"]):.2f}" y="{y(r["density"] or 0)}" height="{y(0) - y(r["density"] or 0):.2f}" fill="{colour}" opacity="0.5"/>' for r in side]
        parts.append(f'<text x="{EDGE}" y="{top + EDGE - 4}">{escape(str(name))}</text>')
    return _svg(parts, title, WIDTH, HEIGHT * max(1, len(names)))


def heatmap(cells: DataFrame, value: str = "corr", title: str = "Correlations") -> str:
    """A square of (i, j, value) cells between -1 and 1; what is null stays grey."""
    rows = cells.select("i", "j", value).collect()  # features squared
    names = list(dict.fromkeys(r[0] for r in rows))
    size, parts = 60, []
    place = {name: EDGE + 60 + size * k for k, name in enumerate(names)}
    for i, j, v in rows:
        fade = 255 - round(200 * min(1.0, abs(v))) if v is not None else 200
        colour = (200, 200, 200) if v is None else (255, fade, fade) if v > 0 else (fade, fade, 255)
        parts.append(f'<rect x="{place[j]}" y="{place[i]}" width="{size}" height="{size}" fill="rgb{colour}"/>')
        parts.append(f'<text x="{place[j] + 14}" y="{place[i] + 34}">{"" if v is None else f"{v:.2f}"}</text>')
    for name, at in place.items():
        parts.append(f'<text x="4" y="{at + 34}">{escape(str(name))}</text><text x="{at}" y="{EDGE + 50}">{escape(str(name))}</text>')
    edge = EDGE + 80 + size * len(names)
    return _svg(parts, title, edge, edge)


def time_series(rows: DataFrame, column: str, title: str = "Series", marks: int = MARKS, num_samples: int | None = None) -> str:
    """Mean of a column by equal spans of time, a line a ticker: all of them, or the first ``num_samples`` by name."""
    if num_samples is not None:
        rows = rows.join(rows.select("ticker").distinct().orderBy("ticker").limit(num_samples), "ticker", "left_semi")
    means = _buckets(rows, marks).groupBy("ticker", "_bucket").agg(F.avg(column).alias("y"))
    found = sorted((r[0] or "", r[1], r[2]) for r in means.collect() if None not in (r[1], r[2]))
    if not found:
        return _svg([], title)
    low, high = min(r[2] for r in found), max(r[2] for r in found)
    x, y = _scale(0, marks, EDGE, WIDTH - EDGE), _scale(low, high, HEIGHT - EDGE, EDGE)
    parts = _axis(low, high)
    lines: dict[str, list[str]] = {}
    for name, b, v in found:
        lines.setdefault(name, []).append(f"{x(b + 0.5)},{y(v)}")
    for k, (name, points) in enumerate(lines.items()):
        colour = COLOURS[k % len(COLOURS)]
        parts.append(f'<polyline points="{" ".join(points)}" fill="none" stroke="{colour}"/><text x="{WIDTH - EDGE - 40}" y="{EDGE + 14 * k}" fill="{colour}">{escape(name)}</text>')
    return _svg(parts, title)
