"""CSV tables and the console report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV part with a header; for result tables of summary size."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")


def report(tables: Mapping[str, DataFrame], rows: int = 20) -> str:
    """The headline tables as text; each is summary-sized and cut at ``rows``."""
    out = []
    for name, df in tables.items():
        found = df.limit(rows).collect()
        widths = [max(len(c), *(len(_shown(r[c])) for r in found)) if found else len(c) for c in df.columns]
        out += [name, "  ".join(c.ljust(w) for c, w in zip(df.columns, widths, strict=True))]
        out += ["  ".join(_shown(r[c]).ljust(w) for c, w in zip(df.columns, widths, strict=True)) for r in found] + [""]
    return "\n".join(out)


def _shown(value: object) -> str:
    return "" if value is None else f"{value:.6g}" if isinstance(value, float) else str(value)
