"""Charts of small metric rows as SVG text: confusion matrix, model comparison, reliability curve. Rendered on the driver."""

from __future__ import annotations

from html import escape

INK, MUTED, FILL, LINE = "#1f2933", "#9aa5b1", "#2b6cb0", "#e4e7eb"


def _page(width: int, height: int, title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}" font-family="sans-serif" font-size="12">'
    return "\n".join([head, f"<title>{escape(title)}</title>", f'<text x="16" y="24" font-size="15" fill="{INK}">{escape(title)}</text>', *body, "</svg>"])


def _text(x: float, y: float, s: object, anchor: str = "start", fill: str = INK) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" fill="{fill}">{escape(str(s))}</text>'


def confusion(labels: list[str], counts: dict[tuple[str, str], int], title: str = "Confusion matrix") -> str:
    """Rows are true labels, columns predicted ones; the shade is the share of the row."""
    cell, left, top = 44, 150, 130
    body = []
    for j, p in enumerate(labels):
        x = left + j * cell + cell / 2
        body.append(f'<text x="{x:.1f}" y="{top - 8}" transform="rotate(-45 {x:.1f} {top - 8})" fill="{INK}">{escape(str(p))}</text>')
    for i, t in enumerate(labels):
        whole = max(1, sum(counts.get((t, p), 0) for p in labels))
        body.append(_text(left - 8, top + i * cell + cell / 2 + 4, t, "end"))
        for j, p in enumerate(labels):
            n = counts.get((t, p), 0)
            body.append(f'<rect x="{left + j * cell}" y="{top + i * cell}" width="{cell - 2}" height="{cell - 2}" fill="{FILL}" fill-opacity="{0.06 + 0.94 * n / whole:.3f}"/>')
            body.append(_text(left + j * cell + cell / 2 - 1, top + i * cell + cell / 2 + 4, n, "middle", "#ffffff" if n / whole > 0.5 else INK))
    return _page(left + cell * len(labels) + 30, top + cell * len(labels) + 30, title, body)


def bars(rows: list[tuple[str, float]], title: str = "Models") -> str:
    """One bar a model, from 0 to 1."""
    left, wide, body = 190, 320, []
    for i, (name, value) in enumerate(rows):
        y = 48 + 30 * i
        body += [_text(left - 8, y + 14, name, "end"), f'<rect x="{left}" y="{y}" width="{wide}" height="18" fill="{LINE}"/>', f'<rect x="{left}" y="{y}" width="{wide * min(1.0, max(0.0, value)):.1f}" height="18" fill="{FILL}"/>', _text(left + wide + 8, y + 14, f"{value:.3f}")]
    return _page(left + wide + 70, 70 + 30 * len(rows), title, body)


def reliability(bins: list[tuple[float, float, int]], title: str = "Reliability") -> str:
    """(mean confidence, accuracy, rows) of each bin against the diagonal; empty bins are left out."""
    left, top, side = 56, 44, 320
    at = lambda c, a: (left + side * c, top + side * (1 - a))
    body = [f'<rect x="{left}" y="{top}" width="{side}" height="{side}" fill="none" stroke="{MUTED}"/>', f'<line x1="{left}" y1="{top + side}" x2="{left + side}" y2="{top}" stroke="{MUTED}" stroke-dasharray="4 4"/>']
    points = [at(c, a) for c, a, n in bins if n]
    if points:
        body.append(f'<polyline points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in points)}" fill="none" stroke="{FILL}" stroke-width="2"/>')
    body += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4" fill="{FILL}"/>' for x, y in points]
    body += [_text(left + side / 2, top + side + 34, "mean confidence", "middle"), _text(left + 4, top + 16, "accuracy", "start", MUTED)]
    for k in (0.0, 0.5, 1.0):
        x, y = at(k, k)
        body += [_text(x, top + side + 16, f"{k:.1f}", "middle", MUTED), _text(left - 6, y + 4, f"{k:.1f}", "end", MUTED)]
    return _page(left + side + 30, top + side + 50, title, body)


def write(spark, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
