"""Report sinks: canonical JSON and a plain HTML page, both named by their content."""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

#: Most items and most bytes of one report.
MOST_ITEMS, MOST_BYTES = 2_000, 64 * 1024 * 1024


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def rows_of(items: DataFrame, order: Iterable[str]) -> list[dict]:
    """Items as dictionaries in order; a report of more than MOST_ITEMS is refused, not cut."""
    rows = items.orderBy(*order).limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"a report has at most {MOST_ITEMS} items")
    return [r.asDict(recursive=True) for r in rows]


def render_json(sections: Mapping[str, list[dict]]) -> tuple[str, bytes]:
    """(artifact id, bytes)."""
    return _artifact(canonical(sections).encode(), "json-1")


def render_html(title: str, sections: Mapping[str, list[dict]]) -> tuple[str, bytes]:
    """(artifact id, bytes) of a page with one table a section; all contents are escaped."""
    parts = [f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, rows in sections.items():
        parts.append(f"<section><h2>{html.escape(name)}</h2>")
        if rows:
            columns = sorted({c for r in rows for c in r})
            parts.append("<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + "</tr>")
            for r in rows:
                cells = (r.get(c) for c in columns)
                parts.append("<tr>" + "".join(f"<td>{html.escape('' if v is None else v if isinstance(v, str) else canonical(v))}</td>" for v in cells) + "</tr>")
            parts.append("</table>")
        else:
            parts.append("<p>No items.</p>")
        parts.append("</section>")
    parts.append("</body></html>")
    return _artifact("".join(parts).encode(), "html-1")


def _artifact(content: bytes, renderer: str) -> tuple[str, bytes]:
    if len(content) > MOST_BYTES:
        raise ValueError(f"a report has at most {MOST_BYTES} bytes")
    digest = hashlib.sha256(content).hexdigest()
    return "reportartifact_" + hashlib.sha256(canonical({"content_sha256": digest, "renderer": renderer}).encode()).hexdigest(), content
