"""Tables and text of web pages.

A page is one string, so both are Arrow functions over the column of pages; what comes out are ordinary rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as vo

# Tags that part words, tags whose content is not text.
PARTING = frozenset("br hr img p div li ul ol tr wbr input meta link".split())
HIDDEN = frozenset(("script", "style"))
# End of fixed values.
CELLS = "page_id long, table_no int, row_no int, col_no int, header boolean, text string"


# Marks of a page written as one string: a row or cell begins or ends, hidden content begins or ends.
ROW, ROW_END, CELL, CELL_END, HIDE, HIDE_END = "\x01\x02\x03\x04\x05\x06"
MARKS = {("tr", True): ROW, ("tr", False): ROW_END} | {(t, o): CELL if o else CELL_END for t in ("td", "th") for o in (True, False)} | {(t, o): HIDE if o else HIDE_END for t in HIDDEN for o in (True, False)}
ANY_MARK = re.compile("[\x01-\x06]")
WHOLE_ROW, WHOLE_CELL, HIDDEN_PART = (re.compile(x, re.S) for x in (f"{ROW}([^{ROW}{ROW_END}]*){ROW_END}", f"{CELL}([^{CELL}{CELL_END}]*){CELL_END}", f"{HIDE}[^{HIDE_END}]*(?:{HIDE_END}|$)"))
Event = tuple[str, bool | None, str]


def events(markup: str | None) -> list[Event]:
    """What a page holds, in order: (tag, True, its classes), (tag, False, '') and ('', None, text)."""
    found: list[Event] = []
    reader = HTMLParser(convert_charrefs=True)
    reader.handle_starttag = lambda tag, attrs: found.append((tag, True, dict(attrs).get("class") or ""))
    reader.handle_endtag = lambda tag: found.append((tag, False, ""))
    reader.handle_data = lambda text: found.append(("", None, ANY_MARK.sub(" ", text)))
    reader.feed(markup or "")
    reader.close()
    return found


def marked(part: Iterable[Event]) -> str:
    """Events as one string: text as it is, marks for rows, cells and hidden content, a space for tags that part words."""
    return "".join(text if opens is None else MARKS.get((tag, opens), " " if tag in PARTING else "") for tag, opens, text in part)


def squeeze(text: str) -> str:
    return " ".join(ANY_MARK.sub("", text).split())


def text_of(markup: str | None) -> str:
    page = "".join(text if opens is None else MARKS[tag, opens] if tag in HIDDEN else " " if tag in PARTING else "" for tag, opens, text in events(markup))
    return squeeze(HIDDEN_PART.sub("", page))


def html_text(markup: Column | str) -> Column:
    """Visible text with white space collapsed."""

    @F.pandas_udf("string")
    def visible(pages: pd.Series) -> pd.Series:
        return pages.map(text_of)

    return visible(markup)


def tables_of(page: list[Event], css_class: str) -> list[list[Event]]:
    """The events of each table of the class that lies in no other such table, without those of tables inside it."""
    out: list[list[Event]] = []
    path: list[list[Event] | None] = []  # for each open table where its events go; nowhere for tables that are not wanted
    for event in page:
        tag, opens, value = event
        if tag == "table" and opens:
            wanted = css_class in value.split() and not any(x is not None for x in path)
            path.append([] if wanted else None)
            out += path[-1:] if wanted else []
        elif tag == "table":
            del path[-1:]
        elif path and path[-1] is not None:
            path[-1].append(event)
    return out


def cells_of(markup: str | None, css_class: str) -> list[tuple[int, int, int, bool, str]]:
    """(table, row, column, header, text); the first row that has cells is the header."""
    out = []
    for number, part in enumerate(tables_of(events(markup), css_class)):
        rows = [[squeeze(cell) for cell in WHOLE_CELL.findall(row)] for row in WHOLE_ROW.findall(marked(part))]
        out += [(number, i, j, i == 0, text) for i, row in enumerate(filter(None, rows)) for j, text in enumerate(row)]
    return out


def table_cells(pages: DataFrame, css_class: str, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(page, *cell) for page, markup in zip(frame["page_id"], frame["html"], strict=True) for cell in cells_of(markup, css_class)]
            yield pd.DataFrame(rows, columns=["page_id", "table_no", "row_no", "col_no", "header", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInPandas(run, CELLS)


def labelled_rows(cells: DataFrame) -> DataFrame:
    """Each row of a table as a map from header key to text; ragged rows have fewer entries."""
    heads = cells.where("header").select("page_id", "table_no", "col_no", vo.normalise_key(F.col("text")).alias("key"))
    named = cells.where("not header").join(heads, ["page_id", "table_no", "col_no"])
    entries = named.groupBy("page_id", "table_no", "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", "key", "text"))).alias("c"))
    first = heads.where("col_no = 0").select("page_id", "table_no", F.col("key").alias("first_header"))
    # of columns with equal headers the first counts
    once = F.filter("c", lambda x, i: ~F.exists(F.slice("c", F.lit(1), i), lambda y: y["key"] == x["key"]))
    return entries.select("page_id", "table_no", "row_no", F.map_from_entries(F.transform(once, lambda x: F.struct(x["key"], x["text"]))).alias("fields")).join(first, ["page_id", "table_no"])


# Headers of the official list.
COLUMNS = {"ratio": ["RATIOCEDEARS/VALORSUBYACENTE"], "symbol": ["SIMBOLOBYMA"], "ticker": ["TICKERENMERCADODEORIGEN"], "market": ["MERCADODEORIGEN"], "isin": ["ISINCEDEAR"], "underlying_isin": ["ISINETF", "ISINACCION"]}
# End of fixed values.


def records(rows: DataFrame, source: str = "official_list") -> DataFrame:
    """Rows of recognised tables as records, with `reason` for rejects and `warnings`; a table without a needed column is an error."""
    field = lambda k: F.coalesce(*[F.try_element_at("fields", F.lit(h)) for h in COLUMNS[k]], F.lit(None))
    kind = vo.lookup(vo.TABLE_KINDS, F.col("first_header"))
    symbol, ratio, market = vo.normalise_symbol(field("symbol")), vo.parse_ratio(field("ratio")), F.nullif(field("market"), F.lit(""))
    warnings = F.array(F.when(ratio.isNull(), "no_ratio"), F.when(market.isNotNull() & ~vo.is_missing_market(market) & ~vo.is_known_market(market), "unknown_market"))
    return rows.where(kind.isNotNull()).select(
        F.lit(source).alias("provider"), (F.col("table_no") * 100_000 + F.col("row_no")).alias("pos"), symbol.alias("symbol"), F.try_element_at("fields", F.col("first_header")).alias("name"), kind.alias("instrument_type"),
        vo.normalise_symbol(field("ticker")).alias("underlying_symbol"), market.alias("underlying_market_raw"), vo.clean_isin(field("underlying_isin")).alias("underlying_isin"),
        ratio.alias("ratio"), vo.clean_isin(field("isin")).alias("isin"), F.lit("UNKNOWN").alias("program_status"), F.lit(source).alias("source_ref"),
        F.when(symbol.isNull(), "missing_symbol").alias("reason"), F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"),
    )
