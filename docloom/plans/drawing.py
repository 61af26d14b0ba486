"""Pictures of a run, as SVG files: no plotting library is needed, and only small tables are
drawn (at most 30 bins, a row per stage, or a sample)."""

from __future__ import annotations

import base64
from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import display
from ..sources.datasets import write_text
from . import report

WIDE, HIGH, LEFT, TOP = 640, 320, 60, 50


def wrapped(label: str) -> list[str]:
    """The lines of a label: a break before ``(`` and after ``,``."""
    return label.replace("(", "\n(").replace(",", ",\n").split("\n")


def text(x: float, y: float, lines: list[str], anchor: str = "middle", size: int = 12) -> str:
    spans = "".join(f'<tspan x="{x:.1f}" dy="{0 if k == 0 else size + 2}">{escape(line)}</tspan>' for k, line in enumerate(lines))
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" font-size="{size}">{spans}</text>'


def page(width: float, height: float, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" font-family="sans-serif"><rect width="100%" height="100%" fill="white"/>{"".join(parts)}</svg>'


def axes(high: float, unit: str = "") -> list[str]:
    """The frame of a chart and five marks from 0 to ``high``."""
    out = [f'<path d="M{LEFT} {TOP}V{TOP + HIGH}H{LEFT + WIDE}" fill="none" stroke="black"/>']
    return out + [text(LEFT - 6, TOP + HIGH * (1 - k / 4) + 4, [f"{high * k / 4:.4g}{unit}"], "end") for k in range(5)]


def chart(label: str, names: list[str], heights: list[float]) -> str:
    top = max(heights, default=0) or 1.0
    step = WIDE / max(len(heights), 1)
    parts = [text(LEFT + WIDE / 2, 18, wrapped(label)), *axes(top)]
    for k, (name, h) in enumerate(zip(names, heights)):
        parts.append(f'<rect x="{LEFT + k * step:.1f}" y="{TOP + HIGH * (1 - h / top):.1f}" width="{step * 0.95:.1f}" height="{HIGH * h / top:.1f}" fill="steelblue"/>')
        if len(names) <= 10 or k % 5 == 0:
            parts.append(text(LEFT + (k + 0.5) * step, TOP + HIGH + 16, [name]))
    if not heights:
        parts.append(text(LEFT + WIDE / 2, TOP + HIGH / 2, ["no values"]))
    return page(LEFT + WIDE + 20, TOP + HIGH + 40, parts)


def bars(spark: SparkSession, path: str, label: str, shown: DataFrame) -> None:
    """A stage's histogram: densities by bin, or counts by category."""
    if "bin" in shown.columns:
        rows = shown.orderBy("bin").collect()  # at most ``report.BINS``
        write_text(spark, path, chart(label, [f"{r.low:.4g}" for r in rows], [r.density for r in rows]))
    else:
        rows = shown.orderBy(F.desc("n"), "value").limit(report.BINS).collect()
        write_text(spark, path, chart(label, [str(r.value) for r in rows], [float(r.n) for r in rows]))


def remaining(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """The share of rows that remain after each stage, from 0 to 100 percent; ``rows`` as in
    a run's summary."""
    step = WIDE / max(len(rows) - 1, 1)
    at = [(LEFT + k * step, TOP + HIGH * (1 - (r[6] or 0.0) / 100), r) for k, r in enumerate(rows)]
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y, _ in at)
    parts = [text(LEFT + WIDE / 2, 18, ["Remaining rows by stage"]), *axes(100, " %"), f'<polyline points="{line}" fill="none" stroke="steelblue" stroke-width="2"/>']
    parts += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4" fill="steelblue"/>' + text(x, TOP + HIGH + 16, wrapped(r[1]), size=10) for x, y, r in at]
    write_text(spark, path, page(LEFT + WIDE + 60, TOP + HIGH + 70, parts))


def table(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """The summary: a column per stage."""
    heads = ["", *(r[1] for r in rows)]
    lines = [("Remaining examples", 2), ("Removed examples", 3), ("Remaining questions", 4), ("Removed questions", 5), ("Seconds per 1000 examples", 7)]
    cells = [heads] + [[name, *(f"{r[k]:.3f}" if isinstance(r[k], float) else str(r[k]) for r in rows)] for name, k in lines]
    parts = []
    for y, row in enumerate(cells):
        for x, cell in enumerate(row):
            parts.append(f'<rect x="{10 + 190 * x}" y="{10 + 50 * y}" width="190" height="50" fill="none" stroke="gray"/>')
            parts.append(text(105 + 190 * x, 30 + 50 * y, wrapped(cell), size=11))
    write_text(spark, path, page(20 + 190 * len(heads), 20 + 50 * len(cells), parts))


def value_text(value) -> str:
    """A decision value as it is shown: numbers with four places."""
    return f"{value:.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)


def samples(spark: SparkSession, path: str, df: DataFrame, most: int, translator: Callable[[], object] | None = None) -> int:
    """Cards of image, question, text, translations and value, for up to ``most`` rows that
    have all of these; the number of cards."""
    columns = ["image", display(F.get("questions", F.lit(0))).alias("question"), display(F.col("text")).alias("text"), "filter_value"]
    rows = report.showable(df).orderBy("dataset_split", "doc_id").select(*columns).limit(most).collect()
    own = translator() if translator else None
    parts = []
    for k, r in enumerate(rows):
        y = 10 + 150 * k
        kind = "png" if bytes(r.image[:4]) == b"\x89PNG" else "jpeg"
        parts.append(f'<image x="10" y="{y}" width="140" height="140" href="data:image/{kind};base64,{base64.b64encode(bytes(r.image)).decode()}"/>')
        shown = [f"Question: {r.question}", f"Text: {r.text}", f"Value: {value_text(r.filter_value)}"]
        if own:
            shown[2:2] = [f"Question, translated: {_translated(own, r.question)}", f"Text, translated: {_translated(own, r.text)}"]
        parts += [text(160, y + 20 + 22 * i, [line], "start") for i, line in enumerate(shown)]
    write_text(spark, path, page(1000, 20 + 150 * max(len(rows), 1), parts))
    return len(rows)


def _translated(service, words: str) -> str:
    try:
        return service.translate(words)
    except Exception:  # noqa: BLE001  a sample is shown without what a service can't translate
        return ""
