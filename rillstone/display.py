"""Results as bordered text tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame


def _cell(x, zone: ZoneInfo) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, datetime):
        x = x.replace(tzinfo=zone) if x.tzinfo is None else x.astimezone(zone)
        return x.strftime("%Y-%m-%d %H:%M:%S") + (f".{x.microsecond // 1000:03d}" if x.microsecond else "") + x.strftime(" %Z")
    return str(x)


def table_text(df: DataFrame, rows: int = 100, header: bool = True, zone: str = "UTC") -> str:
    """The first rows as a table; "No data!" if there are none. Times are shown in the zone."""
    return rows_text(df.columns, df.take(rows), header, zone)


def rows_text(columns: Sequence[str], rows: Sequence, header: bool = True, zone: str = "UTC") -> str:
    """Rows at hand as a table."""
    tz = ZoneInfo(zone)
    got = [[_cell(x, tz) for x in r] for r in rows]
    if not got:
        return "No data!"
    head = [columns] if header else []
    widths = [max(map(len, column)) for column in zip(*head, *got, strict=True)]
    line = lambda a, b, c, fill: a + b.join(fill * (w + 2) for w in widths) + c
    text = lambda r: "│" + "┆".join(f" {x.ljust(w)} " for x, w in zip(r, widths, strict=True)) + "│"
    out = [line("┌", "┬", "┐", "─")]
    if header:
        out += [text(columns), line("╞", "╪", "╡", "═")]
    return "\n".join([*out, *map(text, got), line("└", "┴", "┘", "─")])
