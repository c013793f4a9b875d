"""Publishing only what is valid: gate, atomic files, report."""

from __future__ import annotations

import json
import os
import tempfile
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate(rows: DataFrame, found: DataFrame, key: str = "official_id") -> DataFrame:
    """Rows of the keys without any problem."""
    return rows.join(found.select(key).distinct(), key, "left_anti")


def publish_table(rows: DataFrame, found: DataFrame, path: str, key: str = "official_id") -> None:
    """K2: replace the partitions of valid keys; those of failed keys stay as they were.
    Rows of one key are written by as many tasks as they need, not gathered in one."""
    good = gate(rows, found, key)
    good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def plain(value):
    """Rows as JSON values; whole amounts as integers, nulls kept."""
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def write_json(path: str | Path, document) -> None:
    """K1: readers see the old file or the new one, never a part."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(json.dumps(plain(document), indent=2, ensure_ascii=False) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def publish_documents(documents: DataFrame, found: DataFrame, folder: str | Path, name: str, key: str = "official_id") -> int:
    """K1, K2: one JSON file for each valid official, fetched one after the other."""
    n = 0
    for row in gate(documents, found, key).toLocalIterator():
        write_json(Path(folder) / str(row[key]) / name, row)
        n += 1
    return n


def report_lines(status: DataFrame, found: DataFrame) -> DataFrame:
    """K4: the lines of the Markdown table, one an official and builder."""
    said = found.groupBy("official_id", "builder").agg(F.array_join(F.array_sort(F.collect_list("detail")), "; ").alias("said"))
    rows = status.join(said, ["official_id", "builder"], "left")
    cells = F.concat_ws(" | ", "official_id", "builder", "status", F.col("records").cast("string"), F.coalesce("said", F.lit("—")))
    return rows.select("official_id", "builder", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def report_markdown(status: DataFrame, found: DataFrame, unavailable: list[str] = (), fatal: list[str] = ()) -> str:
    """K4: the report as text; it has one line an official, which is what a reader looks at."""
    s = status.groupBy("status").count().collect()
    n = {r["status"]: r["count"] for r in s}
    lines = [
        f"**{n.get('ok', 0)} builder run(s) ok, {n.get('failed', 0)} failed, {n.get('skipped', 0)} skipped, {len(unavailable)} source(s) unavailable**",
        "",
        "| Official | Builder | Status | Records | Problems |",
        "| --- | --- | --- | --- | --- |",
    ]
    lines += [r.line for r in report_lines(status, found).orderBy("official_id", "builder").toLocalIterator()]
    for title, notes in (("Unavailable sources", unavailable), ("Fatal errors", fatal)):
        if notes:
            lines += ["", f"**{title}:**", *[f"- {x}" for x in notes]]
    return "\n".join(lines)


def exit_status(found: DataFrame) -> int:
    """K7."""
    return 0 if found.isEmpty() else 1
