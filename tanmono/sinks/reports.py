"""Reports and documents: JSON, CSV, and stand-alone HTML pages of bounded results."""

from __future__ import annotations

import csv
import hashlib
import html
import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a page or a driver-side document may hold.
PAGE_ROWS = 20_000


def _bounded(df: DataFrame) -> list[dict]:
    rows = df.limit(PAGE_ROWS + 1).collect()
    if len(rows) > PAGE_ROWS:
        raise ValueError(f"more than {PAGE_ROWS} rows do not go into one document; write a table instead")
    return [r.asDict(recursive=True) for r in rows]


def write_json(df: DataFrame, path: str | Path, **about: object) -> None:
    """One readable UTF-8 document of the rows and what is said about them."""
    Path(path).write_text(json.dumps(about | {"rows": _bounded(df)}, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, written in parallel; arrays and structs as JSON text."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True)


def write_review_sheet(df: DataFrame, path: str | Path) -> int:
    """One CSV file of criteria for reviewers, with empty verdict and note; returns its rows."""
    rows = _bounded(df)
    with Path(path).open("w", encoding="utf-8", newline="") as file:
        sheet = csv.DictWriter(file, [*df.columns, "verdict", "note"])
        sheet.writeheader()
        sheet.writerows(rows)
    return len(rows)


def render_table(df: DataFrame, title: str, path: str | Path) -> None:
    """A page with a table that can be filtered by text."""
    rows = _bounded(df)
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "\n".join(f"<tr>{''.join(cell('td', r[c]) for c in df.columns)}</tr>" for r in rows)
    script = "const q=document.querySelector('input');q.oninput=()=>document.querySelectorAll('tbody tr').forEach(r=>r.hidden=!r.textContent.includes(q.value))"
    page = f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><input placeholder=filter><table><thead><tr>{head}</tr></thead><tbody>\n{body}\n</tbody></table><script>{script}</script>\n"
    Path(path).write_text(page, encoding="utf-8")


def render_cards(df: DataFrame, title: str, path: str | Path) -> None:
    """A page of cards(front, back), both HTML already; the back shows on request."""
    cards = "\n".join(f"<details><summary>{r['front']}</summary><div>{r['back']}</div></details>" for r in _bounded(df.select("front", "back")))
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>\n{cards}\n", encoding="utf-8")


def media_names(df: DataFrame) -> DataFrame:
    """Rows(video_path, start_ms, end_ms) with content-addressed names and times of a clip and a still.

    The clip starts 200 ms early, ends 200 ms late and lasts 400 ms at least; the still is its middle.
    """
    start = F.greatest(F.col("start_ms") - 200, F.lit(0))
    end = F.greatest(F.col("end_ms") + 200, start + 400)
    stem = F.substring(F.sha2(F.concat_ws("|", "video_path", start, end), 256), 1, 20)
    return df.withColumns({
        "clip_start": start, "clip_end": end, "still_at": F.expr("(start_ms + end_ms) div 2"),
        "clip": F.concat(stem, F.lit(".mp3")), "still": F.concat(stem, F.lit(".jpg")),
    })


def render_clip(video: str | Path, start_ms: int, end_ms: int, target: str | Path) -> bool:
    """Cut a clip, unless its file is there; by ffmpeg where that is installed."""
    if Path(target).exists():
        return False
    subprocess.run(["ffmpeg", "-v", "error", "-ss", str(start_ms / 1000), "-t", str((end_ms - start_ms) / 1000), "-i", str(video), "-vn", str(target)], check=True)
    return True


def file_digest(path: str | Path) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()
