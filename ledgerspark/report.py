"""Rendering of small results; values are rounded here and nowhere else."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

MOST_ROWS = 1000


def _rows(df: DataFrame) -> list[dict]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows are no report; write them as a table")
    return [r.asDict(recursive=True) for r in rows]


def _cell(value, column: str) -> str:
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.2%}" if column.endswith(("rate", "ratio", "share")) else f"{value:,.2f}"
    return f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def markdown(title: str, df: DataFrame) -> str:
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(_cell(r[c], c) for c in df.columns) + " |" for r in _rows(df)]) + "\n"


def text(df: DataFrame) -> str:
    rows = [df.columns] + [[_cell(r[c], c) for c in df.columns] for r in _rows(df)]
    widths = [max(map(len, column)) for column in zip(*rows)]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(row, widths)) for row in rows)


def as_json(results: dict[str, DataFrame]) -> str:
    return json.dumps({name: _rows(df) for name, df in results.items()}, default=str, indent=1)
