"""Reports as text: Markdown tables, review pages and event streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(long: DataFrame, digits: int = 3) -> str:
    """Metrics by group from rows (scope, value, metric, mean, n); a report is small, so the table is drawn on the driver."""
    rows = [r.asDict() for r in long.collect()]
    heads = sorted({(r["scope"] != "overall", r["scope"], r["value"] or "") for r in rows})
    cell = {(r["metric"], r["scope"], r["value"] or ""): r for r in rows}
    lines = ["| metric | " + " | ".join(v or s for _, s, v in heads) + " |", "|" + " - |" * (len(heads) + 1)]
    for m in dict.fromkeys(r["metric"] for r in rows):
        found = [cell.get((m, s, v)) for _, s, v in heads]
        lines.append(f"| {m} | " + " | ".join("–" if not r or r["mean"] is None else f"{r['mean']:.{digits}f} ({r['n']})" for r in found) + " |")
    return "\n".join(lines)


def payload(*columns: str) -> Column:
    """Rows as a JSON array that may stand inside a script element."""
    return F.replace(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))), F.lit("</"), F.lit("<\\/"))


def page(template: str, data: str, mark: str = "/*DATA*/") -> str:
    return template.replace(mark, data)


def events(deltas: Iterator[str], final: dict, refused: bool = False) -> Iterator[str]:
    """Server-sent events: the deltas, then one final event; a refusal has the final one alone."""
    if not refused:
        for d in deltas:
            yield f"event: delta\ndata: {json.dumps({'text': d}, ensure_ascii=False)}\n\n"
    yield f"event: final\ndata: {json.dumps(final, ensure_ascii=False)}\n\n"
