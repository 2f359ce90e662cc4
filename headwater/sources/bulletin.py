"""Bulletin pages to level and alert rows.

Only the HTML tables are read in Python, page by page inside tasks. A page that
cannot be read yields one row with an error, so that nothing is lost silently.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.constants import ALIASES, BULLETIN_COLUMNS
from headwater.functions import clean

RAW_SCHEMA = (
    "page_id string, captured_at timestamp_ntz, source string, "
    "clock string, month_day string, cells array<string>, error string"
)
MEASURES = ("rwl_m", "dev_24h_m", "nhwl_m", "dev_nhwl_m", "rule_curve_m", "dev_rule_curve_m", "gates",
            "gate_opening_m", "inflow_cms", "outflow_cms")


class _TableReader(HTMLParser):
    """Collects each table as rows of (text, rowspan, colspan, is_header)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self._open, self._cell = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._open.append([])
        elif tag == "tr" and self._open:
            self._open[-1].append([])
        elif tag in ("td", "th") and self._open and self._open[-1]:
            spans = dict(attrs)
            self._cell = [[], _span(spans.get("rowspan")), _span(spans.get("colspan")), tag == "th"]
            self._open[-1][-1].append(self._cell)

    def handle_endtag(self, tag):
        if tag == "table" and self._open:
            self.tables.append(self._open.pop())
        if tag in ("td", "th", "tr", "table"):
            self._cell = None

    def handle_data(self, data):
        if self._cell is not None:
            self._cell[0].append(data)


def _span(text) -> int:
    return int(text) if text and text.isdigit() and int(text) > 0 else 1


def table_grids(html: str) -> list[list[tuple[list[str], bool]]]:
    """Every table of a page as rows of (texts, all header cells), spans filled."""
    # Text before the first table cannot matter; most pages have none at all.
    start = (html or "").lower().find("<table")
    if start < 0:
        return []
    reader = _TableReader()
    reader.feed(html[start:])
    reader.close()
    grids = []
    for table in reader.tables + reader._open:
        pending: dict[int, tuple[int, str, bool]] = {}
        rows = []
        for cells in table:
            line: list[tuple[str, bool]] = []
            waiting = list(cells)
            while waiting or len(line) in pending:
                at = len(line)
                if at in pending:
                    left, text, header = pending.pop(at)
                    if left > 1:
                        pending[at] = (left - 1, text, header)
                    line.append((text, header))
                    continue
                parts, down, across, header = waiting.pop(0)
                text = " ".join("".join(parts).split())
                for i in range(across):
                    if down > 1:
                        pending[at + i] = (down - 1, text, header)
                    line.append((text, header))
            rows.append(([t for t, _ in line], all(h for _, h in line)))
        grids.append(rows)
    return grids


def _chosen(html: str, width: int, marker: str):
    """Body rows of the first table of this width that shows the marker."""
    for grid in table_grids(html):
        rows = [texts for texts, header in grid if texts and not header]
        widest = max(map(len, rows), default=0)
        if widest == width and any(marker.lower() in t.lower() for texts in rows for t in texts):
            return rows
    return None


def _read(pages: DataFrame, width: int, marker: str, pairs: bool) -> DataFrame:
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page in batch.itertuples(index=False):
                head = (page.page_id, page.captured_at, page.source)
                try:
                    rows = _chosen(page.html, width, marker)
                    if rows is None:
                        out.append((*head, None, None, None, f"no {width}-column table with {marker}"))
                        continue
                    first: dict[str, list[str]] = {}
                    before = len(out)
                    for texts in rows:
                        if len(texts) != width:
                            continue
                        if not pairs:
                            out.append((*head, None, None, texts, None))
                        elif texts[0] in first:
                            # A reading is a clock row and then a date row.
                            clock = first.pop(texts[0])
                            out.append((*head, clock[1], texts[1], clock, None))
                        elif texts[0].lower() != "dam name":
                            first[texts[0]] = texts
                    if len(out) == before:
                        out.append((*head, None, None, None, "no readings"))
                except Exception as error:  # noqa: BLE001 - old layouts vary; kept as a row
                    out.append((*head, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["page_id", "captured_at", "source", "clock", "month_day", "cells", "error"])

    slim = pages.select(F.col("page_id").cast("string").alias("page_id"),
                        F.col("captured_at").cast("timestamp_ntz").alias("captured_at"), "source", "html")
    return slim.mapInPandas(extract, RAW_SCHEMA)


def read_level_pages(pages: DataFrame, marker: str = "Angat") -> DataFrame:
    """Raw readings of (page_id, captured_at, source, html), or one error per page."""
    return _read(pages, len(BULLETIN_COLUMNS), marker, pairs=True)


def levels(raw: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Clean level observations. Readings without a readable date are dropped."""
    at = {name: i for i, name in enumerate(BULLETIN_COLUMNS)}
    day = clean.month_day_to_date(F.col("month_day"), F.col("captured_at"))
    good = raw.filter(F.col("error").isNull()).withColumn("_day", day).filter(F.col("_day").isNotNull())
    rows = good.select(
        clean.canonical(F.col("cells")[0], ALIASES if aliases is None else aliases).alias("dam"),
        clean.at_clock(F.col("_day"), F.col("clock")).alias("obs_datetime"),
        *[clean.number(F.col("cells")[at[m]]).alias(m) for m in MEASURES],
        F.col("captured_at").alias("scraped_at"), "source", "page_id",
    )
    return clean.blank_undefined_reference(rows, {"nhwl_m": "dev_nhwl_m", "rule_curve_m": "dev_rule_curve_m"})


def read_alert_pages(pages: DataFrame, marker: str = "Flood Watch") -> DataFrame:
    return _read(pages, 2, marker, pairs=False)


def alerts(raw: DataFrame) -> DataFrame:
    """Alert states; header rows in mid-table and other noise are filtered."""
    rows = raw.filter(F.col("error").isNull()).select(
        clean.tidy(F.col("cells")[0]).alias("basin"), clean.tidy(F.col("cells")[1]).alias("status"),
        "captured_at", "page_id",
    )
    kept = rows.filter(
        ~clean.matches(F.col("basin"), "RIVER BASINS|DAMS/RESERVOIR|STATUS")
        & clean.matches(F.col("status"), "Flood Watch")
    )
    return kept.select(
        "basin", "status", clean.is_alert(F.col("status")).alias("on_watch"),
        clean.alert_kind(F.col("basin")).alias("kind"), F.to_date("captured_at").alias("date"),
        F.col("captured_at").alias("scraped_at"), "page_id",
    )


def page_status(raw: DataFrame) -> DataFrame:
    """Pages and rows per outcome, for the run's counters."""
    return raw.groupBy(F.coalesce("error", F.lit("parsed")).alias("status")).agg(
        F.count_distinct("page_id").alias("pages"), F.count("cells").alias("readings")
    )
