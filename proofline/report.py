"""Fixed-width text tables of small results. Rows are collected: they are groups, detectors or single documents."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

SPAN_ROWS = 14


def cell(value) -> str:
    if value is None:
        return "n/a"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return "never" if math.isinf(value) else f"{value:.3f}"
    return str(value)


def render(rows: Sequence[Sequence], header: Sequence[str], title: str = "") -> str:
    """Columns as wide as their widest cell; numbers to the right."""
    text = [list(map(cell, r)) for r in rows]
    wide = [max([len(h), *(len(r[i]) for r in text)]) for i, h in enumerate(header)]
    right = [bool(rows) and all(isinstance(r[i], int | float) and not isinstance(r[i], bool) or r[i] is None for r in rows) for i in range(len(header))]
    line = lambda r: "  ".join(c.rjust(w) if k else c.ljust(w) for c, w, k in zip(r, wide, right)).rstrip()
    return "\n".join([*([title, "=" * len(title)] if title else []), line(header), line(["-" * w for w in wide]), *map(line, text)])


def render_table(df: DataFrame, title: str = "", order: Sequence[str] = (), limit: int | None = None) -> str:
    """``df`` as a table, in a given order. A limit is for previews of one document."""
    df = df.orderBy(*order) if order else df
    rows = (df.limit(limit) if limit else df).collect()
    return render([tuple(r) for r in rows], df.columns, title)


def render_benchmark(df: DataFrame) -> str:
    """Detectors by name; a budget finer than the corpus resolves is starred."""
    out = []
    for r in df.orderBy("detector").collect():
        star = lambda v, ok: f"{cell(v)}{'' if ok else '*'}"
        out.append((r.detector, r.auroc, star(r.tpr_5, r.resolution <= 0.05), star(r.tpr_1, r.resolution <= 0.01), r.accuracy, r.f1, r.fpr, r.brier, r.ece))
    return render(out, ["detector", "AUROC", "TPR@5%", "TPR@1%", "accuracy", "F1", "FPR", "Brier", "ECE"], "Benchmark") + "\n* finer than the human texts resolve"


def to_json(df: DataFrame, **more) -> str:
    """Rows as JSON with non-finite numbers as null, beside further members."""
    fine = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    return json.dumps(more | {"results": [{k: fine(v) for k, v in r.asDict().items()} for r in df.collect()]}, indent=2, default=str, allow_nan=False)
