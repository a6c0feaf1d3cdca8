"""Web pages by a stack of open tags: tables as grids with their spans, lists, and what kind of page it is."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_cell, row_label

# Tags without an end, tags that a new one closes, and the largest spans that a page may ask for.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {
    "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, "thead": {"tbody", "tr", "td", "th", "caption"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "p": {"p"},
}
#: What an implied end does not reach beyond.
WALLS = {"table", "ul", "ol", "dl", "select", "td", "th", "body", "html", "div", "section", "article"}
STOPS = {tag: WALLS - shut for tag, shut in CLOSES.items()}
#: Plain tags, which need no parser to be read: an end, or a beginning with attributes without references.
_TAG = re.compile(r"""<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z-]*=(?:"[^"<>&]*"|'[^'<>&]*'|[a-zA-Z0-9_.%-]+))*))>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)=(?:"([^"]*)"|'([^']*)'|([^ ]+))""")
#: Elements whose text parsers read by rules of its own.
RAW = {"script", "style", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}
MOST_COLUMNS, MOST_ROWS = 1000, 65534
# Parts of a title that say what page has been sent in place of the one asked for, and what company pages have.
MISSING, BLOCKED = ("404", "not found"), ("just a moment", "captcha", "access denied", "forbidden")
LANDMARKS = ("top-ratios", "profit-loss", "quarters")
#: The extracts of a company's page: a list, and tables by the id of their section.
STATEMENTS = {"ratios_history": "ratios", "quarters": "quarters", "profit_loss": "profit-loss", "balance_sheet": "balance-sheet", "cash_flow": "cash-flow"}


def spaced(text: str) -> str:
    return " ".join(text.split())


@dataclass
class Cell:
    row: int
    column: int
    rows: int
    columns: int
    header: bool
    part: str
    text: list[str] = field(default_factory=list)
    button: list[str] | None = None


@dataclass
class Table:
    number: int
    outer: int | None
    section: str | None
    classes: str
    cells: list[Cell] = field(default_factory=list)
    row: int = -1
    taken: dict[int, int] = field(default_factory=dict)  # by column, the last row that a cell above reaches into
    part: str = "body"


@dataclass
class Item:
    list_id: str
    number: int
    name: list[str] | None = None
    value: list[str] | None = None


class Page(HTMLParser):
    """One page, read once: its tables, the items of its lists that have an id, its title and its elements' ids and classes."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tables: list[Table] = []
        self.items: list[Item] = []
        self.title: list[str] = []
        self.titles = 0
        self.ids: set[str] = set()
        self.classes: set[str] = set()
        #: Open elements: tag, id, and the table, cell, item or text that they began.
        self.stack: list[tuple[str, str | None, object]] = []
        self.counts: dict[int, int] = {}
        #: The first title as it is written; where it begins, and where the parser stands.
        self.written = ""
        self.begun: int | None = None
        self.at = self.base = 0
        self.html = html
        plain = self._plain_tags(html)
        if plain is None:
            self.feed(html)
            self.at, self.base = 0, len(html) - len(self.rawdata)
            self.close()
            return
        for (at, end, closed, tag, attrs), (after, *_) in zip(plain, [*plain[1:], (len(html),)], strict=True):
            self.at, self.begins = at, end
            if closed:
                self.handle_endtag(closed)
            elif tag:
                self.handle_starttag(tag, attrs)
            if end < after:
                text = html[end:after]
                self.handle_data(unescape(text) if "&" in text else text)

    @staticmethod
    def _plain_tags(html: str) -> list[tuple] | None:
        """(place, end, closed tag, opened tag, attributes) of all tags of a page that has only plain ones, first an empty one; else null."""
        out, titled = [(0, 0, None, None, None)], False
        for m in _TAG.finditer(html):
            closed, tag, attrs = m.groups()
            closed, tag = closed and closed.lower(), tag and tag.lower()
            # the text of a title is read by rules of its own as well, if it is more than text
            if tag in RAW or (titled and closed != "title"):
                return None
            titled = tag == "title"
            out.append((m.start(), m.end(), closed, tag, [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attrs)] if attrs else ()))
        return out if len(out) - 1 == html.count("<") else None

    def updatepos(self, i: int, j: int) -> int:
        self.at = j
        return j

    def _open(self, kind: type) -> object | None:
        return next((x for _, _, x in reversed(self.stack) if isinstance(x, kind)), None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if own:
            self.ids |= {own["id"]} if own.get("id") else set()
            self.classes |= set(own.get("class", "").split())
        if tag in CLOSES:
            # all from the outermost that it closes on, up to the last wall, which an implied end does not reach beyond
            shut, stops, low = CLOSES[tag], STOPS[tag], None
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in stops:
                    break
                low = i if self.stack[i][0] in shut else low
            if low is not None:
                del self.stack[low:]
        made: object = None
        if tag == "table":
            outer = self._open(Table)
            section = next((i for t, i, _ in reversed(self.stack) if i and t in ("section", "div", "article")), own.get("id") or None)
            made = Table(len(self.tables), outer.number if outer else None, section, own.get("class", ""))
            self.tables.append(made)
        elif tag in ("thead", "tbody", "tfoot") and (table := self._open(Table)):
            table.part = {"thead": "head", "tbody": "body", "tfoot": "foot"}[tag]
            table.taken = {}
        elif tag == "tr" and (table := self._open(Table)):
            table.row += 1
        elif tag in ("td", "th") and (table := self._open(Table)):
            made = self._cell(table, tag, own)
        elif tag == "li" and self.stack and self.stack[-1][0] in ("ul", "ol") and self.stack[-1][1]:
            place = len(self.stack)
            self.counts[place] = self.counts.get(place, -1) + 1
            made = Item(self.stack[-1][1], self.counts[place])
            self.items.append(made)
        elif tag in ("ul", "ol"):
            self.counts.pop(len(self.stack) + 1, None)
        elif tag == "button" and (cell := self._open(Cell)) and cell.button is None:
            cell.button = made = []
        elif tag == "title":
            self.titles += 1
            made = self.title if self.titles == 1 else None
            if self.titles == 1:
                self.begun = self._after()
        if made is None and "class" in own and (item := self._open(Item)):
            for name in ("name", "value"):
                if name in own["class"].split() and getattr(item, name) is None:
                    made = []
                    setattr(item, name, made)
                    break
        if tag not in VOID:
            self.stack.append((tag, own.get("id") or None, made))

    def _after(self) -> int:
        """Where the tag that is being read ends."""
        text = self.get_starttag_text()
        return self.base + self.at + len(text) if text else self.begins

    def _cell(self, table: Table, tag: str, own: dict[str, str]) -> Cell:
        def span(name: str, most: int) -> int:
            found = re.match(r"\s*(\d+)", own.get(name, ""))
            return min(int(found[1]), most) if found else 1

        table.row = max(table.row, 0)
        column = 0
        while table.taken.get(column, -1) >= table.row:
            column += 1
        columns, rows = (max(1, span("colspan", MOST_COLUMNS)), span("rowspan", MOST_ROWS) or MOST_ROWS) if own else (1, 1)
        for c in range(column, column + columns):
            table.taken[c] = table.row + rows - 1
        cell = Cell(table.row, column, rows, columns, tag == "th", table.part)
        table.cells.append(cell)
        return cell

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.begun is not None:
            self.written, self.begun = self.html[self.begun : self.base + self.at], None
        # an end closes what is open inside; one without a beginning within its table is left out
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if self.stack[i][0] == "table":
                return

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        for _, _, made in reversed(self.stack):
            if isinstance(made, list):
                made.append(data)
            elif isinstance(made, Cell):
                made.text.append(data)
                break
            elif isinstance(made, Table):
                break

    def grid(self, table: Table) -> Iterator[tuple]:
        """(row, column, spanned, header, part, text, button) of all places, spans filled; a span ends with its table's part."""
        last: dict[str, int] = {}
        for cell in table.cells:
            last[cell.part] = max(last.get(cell.part, 0), cell.row)
        for cell in table.cells:
            text, button = spaced("".join(cell.text)), spaced("".join(cell.button)) if cell.button is not None else None
            for r in range(cell.row, min(cell.row + cell.rows - 1, max(last[cell.part], cell.row)) + 1):
                for c in range(cell.column, cell.column + cell.columns):
                    yield r, c, (r, c) != (cell.row, cell.column), cell.header, cell.part, text, button


def _pages(rows: DataFrame, id_col: str, html_col: str, take, schema: str) -> DataFrame:
    """Rows (id, ...) of each page, read with a stack in Arrow batches; null pages have none."""
    given = rows.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    kind = given.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        kinds = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[x.strip().split(" ")[1]] for x in schema.split(",")]
        for batch in batches:
            found = [(i, *x) for i, html in enumerate(batch.column(1).to_pylist()) if html is not None for x in take(Page(html))]
            at, *columns = zip(*found, strict=True) if found else ([], *([] for _ in names))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", *names])

    return given.mapInArrow(read, f"id {kind}, {schema}")


def table_cells(rows: DataFrame, id_col: str = "id", html_col: str = "html", sections: tuple[str, ...] | None = None) -> DataFrame:
    """(id, table, outer, section, classes, row, col, spanned, header, part, text, button): every place of every table of pages.

    Cells that span rows or columns fill all their places, which all but the first are ``spanned``. A table within a cell is
    a table of its own, ``outer`` its container's number, and its text is none of the outer cell's. ``section`` is the id of
    the nearest section, div or article around, else the table's own; ``part`` is head, body or foot. Ends that are left
    out, as of rows and cells, are implied. ``button`` is the text of a cell's first button, null without one. With
    ``sections``, only tables of these are given.
    """

    def take(page: Page) -> Iterator[tuple]:
        for t in page.tables if sections is None else (t for t in page.tables if t.section in sections):
            for place in page.grid(t):
                yield t.number, t.outer, t.section, t.classes, *place

    return _pages(rows, id_col, html_col, take, "table int, outer int, section string, classes string, row int, col int, spanned boolean, header boolean, part string, text string, button string")


def list_items(rows: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """(id, list_id, item, name, value): items of lists with an id, with the text of their first elements of the classes name and value."""

    def take(page: Page) -> Iterator[tuple]:
        text = lambda x: None if x is None else spaced("".join(x))
        return ((i.list_id, i.number, text(i.name), text(i.value)) for i in page.items)

    return _pages(rows, id_col, html_col, take, "list_id string, item int, name string, value string")


def page_facts(rows: DataFrame, id_col: str = "id", html_col: str = "html", asked: bool = True) -> DataFrame:
    """(id, title, reason, tables, written): why a page is not a company's, null if it is one: not there, blocked, or not recognised.

    Only of pages that were ``asked`` for does the title tell what has been sent instead; others can have a 404 in a number.

    ``written`` is the title as the page has it, with references such as &quot; as they are; empty if it has no end.
    """

    def take(page: Page) -> Iterator[tuple]:
        title = spaced("".join(page.title))
        low = title.lower()
        reason = None if not asked else "page_not_found" if any(x in low for x in MISSING) else "bot_blocked" if any(x in low for x in BLOCKED) else None
        if not reason and not (page.ids & set(LANDMARKS) or "sub-nav-holder" in page.classes):
            reason = "page_not_recognized"
        yield title, reason, len(page.tables), page.written

    return _pages(rows, id_col, html_col, take, "title string, reason string, tables int, written string")


def statements(cells: DataFrame) -> DataFrame:
    """(id, extract, label, place, period, num, txt): the values of a company page's statement tables.

    Of each section's first table of the class data-table: its head gives the periods, a blank first one left out, and each
    row of its body a label and values by place. Labels lose the plus sign of rows that open; rows without a label and
    those of links to files are left out; of a label that repeats the last row counts. Values are numbers or texts, null
    where empty or a dash.
    """
    names = F.create_map(*(F.lit(x) for k, v in STATEMENTS.items() for x in (v, k)))
    rows = cells.where(F.col("section").isin(*STATEMENTS.values()) & F.array_contains(F.split("classes", r"\s+"), "data-table")).withColumn("extract", names[F.col("section")])
    own = Window.partitionBy("id", "extract")
    rows = rows.withColumn("first", F.min("table").over(own)).where("table = first")
    # heads go beside every row of their table, so pages are read once
    heads = F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == "head", F.struct("row", "col", "text"))).over(own)), lambda x: x["text"])
    body = rows.withColumn("heads", heads).where("part = 'body' AND NOT header")
    lines = body.groupBy("id", "extract", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text", "button"))).alias("cells"), F.first("heads").alias("heads"))
    lines = lines.withColumn("label", row_label(F.coalesce(F.col("cells")[0]["button"], F.col("cells")[0]["text"]))).where("label != '' AND label != 'Raw PDF'")
    lines = lines.withColumn("last", F.max("row").over(Window.partitionBy("id", "extract", "label"))).where("row = last")
    periods = F.when(F.get("heads", F.lit(0)) == "", F.slice("heads", 2, 1 << 20)).otherwise(F.col("heads"))
    values = lines.select("id", "extract", "label", periods.alias("periods"), F.posexplode(F.transform(F.slice("cells", 2, 1 << 20), lambda c: clean_cell(c["text"]))).alias("place", "value"))
    return values.select("id", "extract", "label", "place", F.get("periods", F.col("place")).alias("period"), "value.num", "value.txt")


def snapshot(items: DataFrame) -> DataFrame:
    """(id, name, value) of the list of a company page's top ratios; of a name that repeats the last counts."""
    rows = items.where("list_id = 'top-ratios' AND name != '' AND value IS NOT NULL")
    return rows.groupBy("id", "name").agg(F.max_by("value", "item").alias("value"))


def text_of(value: Column) -> Column:
    """A value (num, txt) as one text."""
    return F.coalesce(value["num"].cast("string"), value["txt"])
