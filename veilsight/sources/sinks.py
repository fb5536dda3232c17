"""Results as files: JSON results and reports, an HTML page, review and history CSV, error lines.

Results of a site are small and ordered, so they are written by the driver, to a temporary file that is
then renamed. Tables of any size go through Spark's own writers.
"""

from __future__ import annotations

import csv
import io
import json
import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT, EXTRA, REPORT, PAGE, REVIEW = "result.json", "result_extra.json", "report.json", "report.html", "review.json"
MOST_FRAMES, MOST_CAUSES = 40, 5


def write_atomically(path: str, content: str) -> None:
    temp = f"{path}.tmp"
    with open(temp, "w", encoding="utf-8", newline="") as f:
        f.write(content)
    os.replace(temp, path)


def timestamp(t: datetime) -> str:
    """To the second, with offset."""
    return t.replace(microsecond=0).isoformat()


def tenth(seconds: float) -> float:
    """Half up to one decimal."""
    return int(seconds * 10 + 0.5) / 10


def meta(topic: str, entry_url: str, started: datetime, finished: datetime, version: str) -> dict:
    return {
        "topic": topic, "entry_url": entry_url or "", "started_at": timestamp(started), "finished_at": timestamp(finished),
        "elapsed_sec": tenth((finished - started).total_seconds()), "tool_version": version,
    }


def in_order(rows: DataFrame | None) -> list[dict]:
    """Report rows of one site in the order of their numbers, core before extra; none for none."""
    got = [r.asDict(recursive=True) for r in rows.toLocalIterator()] if rows is not None else []
    return sorted(got, key=lambda r: (r["technique"] == "ETC", int(r["id"][2:])))


def result_json(rows: list[dict], head: dict, extra: bool = False) -> str:
    found = []
    for r in rows:
        if (r["technique"] == "ETC") == extra:
            item = {"id": r["id"], "url": r["url"], "is_violation": True, "location": r["location"], "evidence_text": r["evidence_text"], "technique": r["technique"]}
            found.append(item | ({"extra_finding": r["extra_finding"]} if extra else {}))
    return json.dumps({"meta": head, "findings": found}, ensure_ascii=False, indent=2) + "\n"


def report_json(rows: list[dict], head: dict, run: dict, review: dict) -> str:
    found = []
    for r in rows:
        item = {k: v for k, v in r.items() if k != "review_key" and (k != "extra_finding" or v is not None)}
        found.append({"id": r["id"], "key": r["review_key"], **item, "decoded": r["decoded"] or "", "method": r["method"] or ""})
    return json.dumps({**head, **run, "findings": found, "review": review}, ensure_ascii=False, indent=2) + "\n"


def report_html(report: str) -> str:
    """The report inside a page; the data can't close its script element."""
    data = report.replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>report</title></head><body><script type="application/json" id="data">{data}</script></body></html>\n'


def write_results(report_rows: DataFrame | None, folder: str, head: dict, run: dict | None = None, review: dict | None = None, extras: bool = True) -> list[str]:
    """All files of a run; a folder that can't be written is an error of its own."""
    os.makedirs(folder, exist_ok=True)
    rows = in_order(report_rows)
    text = report_json(rows, head, run or {}, review or {})
    files = {RESULT: result_json(rows, head), REPORT: text, PAGE: report_html(text), REVIEW: json.dumps(review or {}, ensure_ascii=False, indent=2) + "\n"}
    if extras:
        files[EXTRA] = result_json(rows, head, extra=True)
    for name, content in files.items():
        write_atomically(os.path.join(folder, name), content)
    return sorted(files)


def write_anywhere(report_rows: DataFrame, folders: list[str], head: dict, **more) -> str:
    """Into the first of some folders that can be written."""
    for folder in folders:
        try:
            write_results(report_rows, folder, head, **more)
            return folder
        except OSError:
            continue
    raise OSError(f"no folder can be written: {folders}")


def open_review(folder: str) -> dict:
    """Review entries; a missing or broken file is an empty one."""
    try:
        with open(os.path.join(folder, REVIEW), encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return {k: v for k, v in found.items() if v} if isinstance(found, dict) else {}


def csv_lines(rows: list[list[str]]) -> str:
    """All cells quoted, CRLF line ends."""
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\r\n").writerows(rows)
    return out.getvalue()


def review_csv(report_rows: DataFrame, path: str) -> None:
    """Findings with an empty column for the verdict, with a byte order mark."""
    head = ["id", "technique", "url", "location", "evidence_text", "verdict"]
    rows = [[r["id"], r["technique"], r["url"], r["location"], r["evidence_text"], ""] for r in in_order(report_rows)]
    write_atomically(path, "\ufeff" + csv_lines([head, *rows]))


def parse_csv(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")))


def append_history(path: str, row: dict) -> None:
    """One wide line, with a head if the file is new."""
    new = not os.path.exists(path)
    with open(path, "a", encoding="utf-8", newline="") as f:
        w = csv.DictWriter(f, list(row), lineterminator="\n")
        if new:
            w.writeheader()
        w.writerow(row)


def error_lines(errors: DataFrame) -> DataFrame:
    """One JSON document per error, stacks and causes cut to their limits; ``value`` can go to any text sink."""
    return errors.select(
        F.to_json(F.struct("time", "thread", "site", "url", "class", "message", F.slice("stack", 1, MOST_FRAMES).alias("stack"), F.slice("causes", 1, MOST_CAUSES).alias("causes"))).alias("value")
    )


def summary_lines(summary: DataFrame) -> list[str]:
    return [f"{r['technique']}: {r['n']}" for r in summary.orderBy("technique").collect()]  # one row per technique
