"""Writers: single-file sheets and documents for desktop programs, and layers for maps.

Large results are best left to ``DataFrame.write``. The single-file writers stream a result's rows,
a partition at a time, through the driver, because such a file has one writer.
"""

from __future__ import annotations

import csv
import json
import locale
import math

from pyspark.sql import DataFrame


def usual_delimiter() -> str:
    """A semicolon where the locale's decimal sign is a comma, else a comma."""
    return ";" if locale.localeconv()["decimal_point"] == "," else ","


def write_sheet(df: DataFrame, path: str, delimiter: str | None = None) -> None:
    """A CSV file for spreadsheets: byte-order mark, a first line ``sep=…``, headers, rows in the result's order; nulls are empty."""
    sep = delimiter or usual_delimiter()
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        f.write(f"sep={sep}\n")
        out = csv.writer(f, delimiter=sep)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(row)


def plain(value):
    """JSON's own types: rows and dates become maps and texts, NaN and the infinities null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, bool, type(None))) else str(value)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON array of the rows, indented by two, letters as they are."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.toLocalIterator()):
            text = json.dumps(plain(row), indent=2, ensure_ascii=False)
            f.write(("," if i else "") + "\n  " + text.replace("\n", "\n  "))
        f.write("\n]\n")


def write_layers(layers: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """A Parquet dataset for each layer, geometry as a WKT column, under ``folder``; other layers there stay."""
    for name, df in layers.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")
