"""Canonical content blocks from page JSON, HTML and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import BLOCK_TYPES

# Where page JSON keeps its blocks (the first that is a list counts, even an empty one), types and texts.
BLOCK_PATHS = ("$.blocks", "$.content_blocks", "$.content.blocks", "$.content.elements", "$.page.blocks", "$.page.content", "$.elements", "$.layout.blocks")
TYPE_FIELDS = ("layout_tag", "type", "block_type", "element_type", "category")
TEXT_FIELDS = ("text", "content", "content_text", "value", "body", "paragraph", "raw_text", "extracted_text", "ocr_text")
TABLE_KEYS = ("rows", "cells", "table_data", "headers", "columns")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def block_list(raw: Column) -> Column:
    """The array of raw blocks, or null."""
    return F.coalesce(*(_get(raw, p, "array<variant>") for p in BLOCK_PATHS))


def block_type(raw: Column) -> Column:
    """table, heading, image, list or text: by its type fields, then by its keys, then by a level."""
    known = F.create_map(*(F.lit(x) for kind, names in BLOCK_TYPES.items() for n in names for x in (n, kind)))
    named = [F.try_element_at(known, F.lower(F.trim(_get(raw, f"$.{f}")))) for f in TYPE_FIELDS]
    tabular = F.lit(False)
    for k in TABLE_KEYS:
        tabular = tabular | _get(raw, f"$.{k}", "variant").isNotNull()
    level = _filled(_get(raw, "$.heading_level"), _get(raw, "$.level"))
    return F.coalesce(*named, F.when(tabular, "table"), F.when(level.isNotNull() & (level != "0"), "heading"), F.lit("text"))


def block_text(raw: Column) -> Column:
    """A block's text: itself if it is a string, else its first filled text field, also one level down."""
    own = F.when(F.schema_of_variant(raw) == "STRING", raw.try_cast("string"))
    found = []
    for f in TEXT_FIELDS:
        found.append(F.when(F.schema_of_variant(_get(raw, f"$.{f}", "variant")) == "STRING", _get(raw, f"$.{f}")))
        found += [_get(raw, f"$.{f}.{inner}") for inner in ("text", "value", "content")]
    return _filled(own, *found)


def heading_level(raw: Column) -> Column:
    """A heading's level, 1 to 6; text such as h2 gives its number."""
    text = _filled(_get(raw, "$.heading_level"), _get(raw, "$.level"), _get(raw, "$.depth"))
    number = F.regexp_extract(F.coalesce(text, F.lit("1")), r"(\d+)", 1).try_cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(number, F.lit(1))))


def cell_text(cell: Column) -> Column:
    """A cell as text: a scalar, or the value, text or content of an object."""
    scalar = F.when(~F.schema_of_variant(cell).rlike("^(OBJECT|ARRAY)"), cell.try_cast("string"))
    return F.trim(F.coalesce(scalar, _filled(_get(cell, "$.value"), _get(cell, "$.text"), _get(cell, "$.content")), F.lit("")))


def _header_list(table: Column) -> Column:
    return F.coalesce(*(_get(table, f"$.{k}", "array<variant>") for k in ("headers", "header", "column_headers", "head")))


def _header_rows(raw: Column) -> Column:
    first = F.try_element_at(raw, F.lit(1))
    many = F.transform(raw, lambda r: F.transform(r.try_cast("array<variant>"), cell_text))
    one = F.array(F.transform(raw, cell_text))
    empty = F.array().cast("array<array<string>>")
    return F.when(F.coalesce(F.size(raw), F.lit(0)) < 1, empty).when(F.schema_of_variant(first).startswith("ARRAY"), many).otherwise(one)


def data_rows(table: Column) -> Column:
    raw = F.coalesce(*(_get(table, f"$.{k}", "array<variant>") for k in ("rows", "body", "data_rows", "data")))

    def row(r: Column) -> Column:
        values = F.map_values(r.try_cast("map<string,variant>"))  # of an object without cells, in the order of its names
        cells = F.coalesce(r.try_cast("array<variant>"), _get(r, "$.cells", "array<variant>"), _get(r, "$.values", "array<variant>"), values)
        return F.transform(cells, cell_text)

    return F.coalesce(F.filter(F.transform(raw, row), lambda x: x.isNotNull()), F.array().cast("array<array<string>>"))


def merged_cells(table: Column) -> Column:
    raw = F.coalesce(*(_get(table, f"$.{k}", "array<variant>") for k in ("merged_cells", "merges", "spans")))
    side = lambda c, a, b: F.coalesce(_get(c, f"$.{a}", "int"), _get(c, f"$.{b}", "int"), F.lit(0))
    return F.transform(
        raw,
        lambda c: F.struct(
            side(c, "row_start", "r1").alias("row_start"), side(c, "row_end", "r2").alias("row_end"), side(c, "col_start", "c1").alias("col_start"), side(c, "col_end", "c2").alias("col_end"), _get(c, "$.value").alias("value")
        ),
    )


def table_text(headers: Column, rows: Column) -> Column:
    """Cells joined by bars, a rule of 40 dashes after the header rows."""
    line = lambda r: F.array_join(r, " | ", "")
    head = F.transform(headers, line)
    rule = F.when(F.size(headers) > 0, F.array(F.lit("-" * 40))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, rule, F.transform(rows, line)), "\n")


# Footnote marks in cells; what they capture is the mark.
FOOTNOTES = (
    r"\((\d+)\)",
    r"\(([a-z])\)",
    r"(\*{1,3})",
    r"(?:Note|note)\s+(\d+)",
    r"(?:Refer|refer)\s+(?:Schedule|schedule)\s+([IVXLCDM]+|[A-Z])",
    r"(?:See|see)\s+(?:Note|note)\s+(\d+)",
)


def _marks(pattern: str):
    return lambda c: F.regexp_extract_all(c, F.lit(pattern), 1)


def footnotes(cells: Column) -> Column:
    """Distinct footnote marks of an array of cells, sorted; what the patterns capture."""
    found = [F.flatten(F.transform(cells, _marks(p))) for p in FOOTNOTES]
    return F.array_sort(F.array_distinct(F.concat(*found)))


NO_ROWS = "array<array<string>>"
#: What a block is besides its keys, position and type; the same for blocks of JSON, HTML and Markdown.
BLOCK_FIELDS = (
    "pos", "block_type", "heading_level", "content_text", "headers", "rows", "table_text", "merged", "footnotes", "num_columns", "num_rows", "table_html", "bounding_box", "confidence",
)


def _present(v: Column, *names: str) -> Column:
    """The first of some fields that is neither null nor an empty list or object."""
    fields = [_get(v, f"$.{n}", "variant") for n in names]
    return F.coalesce(*(F.when(~F.schema_of_variant(x).isin("VOID", "ARRAY<VOID>", "OBJECT<>"), x) for x in fields))


def _widest(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def as_blocks(blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Blocks with BLOCK_FIELDS, from (keys, pos, block_type, heading_level, content_text, headers, rows) and what else is known of them."""
    table = F.col("block_type") == "table"
    filled = blocks
    for name, value in (("merged", F.lit(None)), ("table_html", F.lit("")), ("bounding_box", F.lit(None).cast("string")), ("confidence", F.lit(1.0))):
        if name not in blocks.columns:
            filled = filled.withColumn(name, value.cast("array<struct<row_start:int,row_end:int,col_start:int,col_end:int,value:string>>") if name == "merged" else value)
    cells = F.flatten(F.concat("headers", "rows"))
    return filled.select(
        *keys,
        "pos",
        "block_type",
        "heading_level",
        "content_text",
        "headers",
        "rows",
        F.when(table, table_text(F.col("headers"), F.col("rows"))).alias("table_text"),
        "merged",
        F.when(table, footnotes(cells)).alias("footnotes"),
        F.when(table, F.greatest(_widest(F.col("headers")), _widest(F.col("rows")))).alias("num_columns"),
        F.when(table, F.size("rows")).alias("num_rows"),
        F.when(table, F.col("table_html")).alias("table_html"),
        "bounding_box",
        "confidence",
    )


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _more(names: tuple[str, ...], **values):
    """From a struct with fields of these names to one with more fields, each a function of the struct."""
    return lambda x: F.struct(*(x[n].alias(n) for n in names), *(f(x).alias(n) for n, f in values.items()))


def _item(pos, kind, level, text, headers, rows, merged=None, table_html="", box=None, confidence=1.0) -> Column:
    """A block before its derived fields, the same struct for blocks of JSON, HTML and Markdown."""
    fields = {
        "pos": (pos, "int"), "block_type": (kind, "string"), "heading_level": (level, "int"), "content_text": (text, "string"), "headers": (headers, NO_ROWS), "rows": (rows, NO_ROWS),
        "merged": (merged, "array<struct<row_start:int,row_end:int,col_start:int,col_end:int,value:string>>"), "table_html": (table_html, "string"), "bounding_box": (box, "string"), "confidence": (confidence, "double"),
    }
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n) for n, (v, t) in fields.items()))


def _exploded(pages: DataFrame, keys: tuple[str, ...], items: Column, *kept: str) -> DataFrame:
    """A row for each struct of a page's array. With the outer form no filter on the array is inferred, which would make it twice."""
    return pages.select(*keys, *kept, F.explode_outer(items).alias("x")).where("x IS NOT NULL").select(*keys, *kept, "x.*")


def _placed_lines(cells: Column) -> Column:
    """Lines of a table whose cells have places (row, col, pos, value): gaps are empty, the last of a place counts.

    An empty cell for each place is sorted in before the cells given, so the last of a place is what it holds, and a line
    is as many places as the table is wide.
    """
    sized = F.struct(cells.alias("cells"), F.array_max(F.transform(cells, lambda c: c["row"])).alias("h"), F.array_max(F.transform(cells, lambda c: c["col"])).alias("w"))
    to = lambda n: F.sequence(F.lit(0), n)

    def sorted_in(x: Column) -> Column:
        blank = F.flatten(F.transform(to(x["h"]), lambda r: F.transform(to(x["w"]), lambda c: F.struct(r.alias("row"), c.alias("col"), F.lit(-1).alias("pos"), F.lit("").alias("value")))))
        inside = F.filter(x["cells"], lambda c: (c["row"] >= F.least(F.lit(0), x["h"])) & (c["col"] >= F.least(F.lit(0), x["w"])))
        return F.array_sort(F.concat(blank, inside))

    def last(x: Column) -> Column:
        after = lambda i: F.get(x["all"], i + 1)
        return F.transform(F.filter(x["all"], lambda c, i: F.coalesce((after(i)["row"] != c["row"]) | (after(i)["col"] != c["col"]), F.lit(True))), lambda c: c["value"])

    def lines(x: Column) -> Column:
        width = F.abs(x["w"]) + 1
        return F.transform(to(F.abs(x["h"])), lambda r: F.slice(x["values"], r * width + 1, width))

    return _once(_once(_once(sized, _more(("h", "w"), all=sorted_in)), _more(("h", "w"), values=last)), lines)


def _json_items(json: Column) -> Column:
    """The blocks of a page's JSON as an array of structs (pos, b, kind, is_table, t, headers, rows, content_text); see json_blocks."""
    sides = lambda raw: F.coalesce(_get(raw, "$.tables", "array<variant>"), _get(raw, "$.table_list", "array<variant>"))
    none = F.array().cast("array<struct<b:variant,kind:string>>")
    typed = lambda a, kind: F.coalesce(F.transform(a, lambda b: F.struct(b.alias("b"), kind(b).alias("kind"))), none)

    def whole(x: Column) -> Column:
        flat = F.coalesce(F.size(x["blocks"]), F.lit(0)) < 1
        page = F.when(block_text(x["raw"]).isNotNull(), F.array(F.struct(x["raw"].alias("b"), F.lit("text").alias("kind"))))
        return F.concat(F.when(flat, F.coalesce(page, none)).otherwise(typed(x["blocks"], block_type)), typed(x["side"], lambda _: F.lit("side table")))

    page = _once(F.try_parse_json(json), lambda raw: F.struct(raw.alias("raw"), block_list(raw).alias("blocks"), sides(raw).alias("side")))
    items = F.transform(_once(page, whole), lambda x, i: F.struct(i.alias("pos"), x["b"].alias("b"), x["kind"].alias("kind"), x["kind"].isin("table", "side table").alias("is_table")))
    own = ("pos", "b", "kind", "is_table")
    items = F.transform(items, _more(own, source=lambda x: F.when(x["is_table"], _present(x["b"], "table_data", "data"))))
    items = F.transform(items, _more(own, t=lambda x: F.when(F.schema_of_variant(x["source"]).rlike("^(OBJECT|ARRAY)"), x["source"]).otherwise(x["b"])))
    own = (*own, "t")
    table = lambda f: lambda x: F.when(x["is_table"], f(x))

    def listed(t: Column) -> Column:
        return F.transform(F.filter(t.try_cast("array<variant>"), lambda r: F.schema_of_variant(r).startswith("ARRAY")), lambda r: F.transform(r.try_cast("array<variant>"), cell_text))

    items = F.transform(
        items,
        _more(
            own,
            headers=table(lambda x: _once(_header_list(x["t"]), _header_rows)),
            rows=table(lambda x: F.coalesce(listed(x["t"]), data_rows(x["t"]))),
            content_text=lambda x: F.when(~x["is_table"], block_text(x["b"])),
            text=table(lambda x: F.trim(F.when(F.schema_of_variant(_get(x["b"], "$.text", "variant")) == "STRING", _get(x["b"], "$.text")))),
        ),
    )
    own = (*own, "content_text")

    # tables given as cells with their places; the first line is the header
    def cells(x: Column) -> Column:
        objects = F.filter(_get(x["b"], "$.cells", "array<variant>"), lambda c: F.schema_of_variant(c).startswith("OBJECT"))
        place = lambda c, *names: F.coalesce(*(_get(c, f"$.{n}", "int") for n in names), F.lit(0))
        value = lambda c: F.coalesce(cell_text(F.coalesce(_get(c, "$.value", "variant"), _get(c, "$.text", "variant"))), F.lit(""))
        return F.transform(objects, lambda c, i: F.struct(place(c, "row", "row_index", "r").alias("row"), place(c, "col", "col_index", "c").alias("col"), i.alias("pos"), value(c).alias("value")))

    items = F.transform(items, _more((*own, "headers", "rows", "text"), cells=lambda x: F.when(x["is_table"] & (F.size(x["rows"]) == 0), cells(x))))
    items = F.transform(items, _more((*own, "headers", "rows", "text"), lines=lambda x: F.when(F.size(x["cells"]) > 0, _placed_lines(x["cells"]))))

    # tables in the text of their block
    def written(x: Column, header: bool) -> Column:
        rows = F.filter(F.try_element_at(html_tables(x["text"]), F.lit(1)), lambda r: r["is_header"] == header)["cells"]
        marked = F.transform(F.filter(F.split(x["text"], "\n"), lambda v: (F.trim(v) != "") & ~rule_line(v)), markdown_cells)
        part = F.slice(marked, 1, 1) if header else F.slice(marked, 2, 100_000)
        found = F.when(F.lower(x["text"]).startswith("<table"), rows).when(F.contains(x["text"], F.lit("|")) & F.contains(x["text"], F.lit("-")), part)
        return F.coalesce(found, F.array().cast(NO_ROWS))

    def of(name: str, header: bool):
        bare = lambda x: (F.size(x["rows"]) == 0) & (F.size(x["headers"]) == 0) & x["lines"].isNull()
        line = lambda x: F.slice(x["lines"], 1, 1) if header else F.slice(x["lines"], 2, 1_000_000)
        return lambda x: F.when(x["lines"].isNotNull(), line(x)).when(bare(x), written(x, header)).otherwise(x[name])

    items = F.transform(items, _more(own, headers=of("headers", True), rows=of("rows", False)))
    kept = F.filter(items, lambda x: (x["is_table"] & ((F.size(x["headers"]) > 0) | (F.size(x["rows"]) > 0))) | (~x["is_table"] & x["content_text"].isNotNull()))
    return _once(kept, lambda a: F.when(F.exists(a, lambda x: x["kind"] == "table"), F.filter(a, lambda x: x["kind"] != "side table")).otherwise(a))


def _json_item(x: Column) -> Column:
    """A struct of _json_items as a block."""
    b = x["b"]
    return _item(
        x["pos"],
        F.when(x["is_table"], F.lit("table")).otherwise(x["kind"]),
        F.when(x["kind"] == "heading", heading_level(b)),
        x["content_text"],
        x["headers"],
        x["rows"],
        F.when(x["is_table"], merged_cells(x["t"])),
        F.coalesce(_filled(*(_get(b, f"$.{n}") for n in ("html", "table_html", "rendered_html"))), F.lit("")),
        F.coalesce(*(F.to_json(_present(b, n)) for n in ("bbox", "bounding_box", "coordinates"))),
        F.coalesce(_get(b, "$.confidence", "double"), F.lit(1.0)),
    )


def json_blocks(pages: DataFrame, keys: tuple[str, ...] = ("page_number",)) -> DataFrame:
    """Blocks (keys, BLOCK_FIELDS) of page JSON, from (keys, json); pages are read one by one, without a shuffle.

    Unreadable JSON gives no blocks. A page without a block list is one text block, if it has text; the tables of
    ``tables`` or ``table_list`` are taken if no block is a table. A table's cells are in an object with headers and
    rows, in a list of rows, in a list of cells with their places, or in its text, as HTML or Markdown; what has none
    of them is no table.
    """
    return as_blocks(_exploded(pages, keys, F.transform(_json_items(F.col("json")), _json_item)), keys)


def grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, line array<string>) from (keys, row, col, value, pos): gaps are empty, the last of a place counts."""
    last = cells.groupBy(*keys, "row", "col").agg(F.max_by("value", "pos").alias("value"))
    width = last.groupBy(*keys).agg(F.max("col").alias("width"), F.max("row").alias("height"))
    lines = last.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    every = width.select(*keys, "width", F.explode(F.sequence(F.lit(0), "height")).alias("row"))
    filled = every.join(lines, [*keys, "row"], "left")
    value = F.transform(F.sequence(F.lit(0), "width"), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    return filled.select(*keys, "row", value.alias("line"))


def html_text(html: Column) -> Column:
    """An HTML page's text: tags become spaces, white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def html_tables(html) -> Column:
    """Tables of a page: arrays of rows (is_header, cells); a row with any header cell is a header."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)

    def row(r: Column) -> Column:
        cells = F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1)
        return F.struct(r.rlike(r"(?i)<th").alias("is_header"), F.transform(cells, html_text).alias("cells"))

    return F.transform(tables, lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), row), lambda r: F.size(r["cells"]) > 0))


def top_ratios(html: Column) -> Column:
    """Name and value pairs of a page's list with the id top-ratios, as a map; of a name that repeats the last counts."""
    items = F.regexp_extract_all(F.regexp_extract(html, r"(?is)<(\w+)[^>]*id=[\"']top-ratios[\"'][^>]*>(.*?)</\1>", 2), F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1)

    def part(item: Column, name: str) -> Column:
        inner = F.regexp_extract(item, rf"(?is)<(\w+)[^>]*class=[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1>(?=\s*(?:<\w+[^>]*class=|$))", 2)
        return html_text(inner)

    pairs = F.filter(F.transform(items, lambda i: F.struct(part(i, "name").alias("key"), part(i, "value").alias("value"))), lambda x: x["key"] != "")
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def html_headings(html: Column) -> Column:
    """Headings in order: (level, text)."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), 0)
    return F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r"(?i)^<h([1-6])", 1).cast("int").alias("level"), html_text(t).alias("text")))


def rule_line(line: Column) -> Column:
    """Whether a Markdown line only parts a table's header from its rows."""
    return line.rlike(r"^\s*\|?[\s:|-]+\|?\s*$") & line.contains("-")


def markdown_cells(line: Column) -> Column:
    """Cells of a Markdown table line, without the outer bars."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def _markdown_items(markdown: Column) -> Column:
    """The blocks of a Markdown text as an array of structs (block, block_type, heading_level, content_text, cells); see markdown_blocks."""

    def kind(line: Column) -> Column:
        return F.when(F.trim(line) == "", "blank").when(F.trim(line).startswith("|"), "table").when(line.rlike(r"^#{1,6}\s+\S"), "heading").otherwise("text")

    def runs(lines: Column) -> Column:
        # a run begins where the kind changes, or with a heading, and ends before the next one
        first = lambda i: (i == 0) | (F.get(lines, i)["kind"] == "heading") | (F.get(lines, i)["kind"] != F.get(lines, i - 1)["kind"])
        begins = F.filter(F.transform(lines, lambda x, i: i), lambda i: F.coalesce(first(i), F.lit(True)))
        return _once(begins, lambda a: F.transform(a, lambda i, n: F.slice(lines, i + 1, F.coalesce(F.get(a, n + 1), F.size(lines)) - i)))

    def block(x: Column) -> Column:
        kinds, text = x["kind"], F.array_join(x["lines"], "\n")
        return F.struct(
            x["block"].alias("block"),
            kinds.alias("block_type"),
            F.when(kinds == "heading", F.length(F.regexp_extract(text, r"^(#{1,6})", 1))).alias("heading_level"),
            F.when(kinds == "heading", F.trim(F.regexp_replace(text, r"^#{1,6}\s+", ""))).when(kinds == "text", F.trim(text)).alias("content_text"),
            F.when(kinds == "table", F.transform(x["lines"], markdown_cells)).alias("cells"),
        )

    lines = F.transform(F.coalesce(F.split(markdown, "\n"), F.array().cast("array<string>")), lambda v: F.struct(kind(v).alias("kind"), v.alias("line")))
    solid = F.filter(_once(lines, runs), lambda r: r[0]["kind"] != "blank")
    named = F.transform(
        solid,
        lambda r, i: F.struct(i.alias("block"), r[0]["kind"].alias("kind"), F.transform(F.filter(r, lambda x: (x["kind"] != "table") | ~rule_line(x["line"])), lambda x: x["line"]).alias("lines")),
    )
    return F.transform(named, block)


def markdown_blocks(pages: DataFrame, keys: tuple[str, ...] = ("page_number",)) -> DataFrame:
    """(keys, block, block_type, heading_level, content_text, cells) from (keys, markdown); pages are read one by one, without a shuffle.

    Runs of lines that begin with a bar are tables, whose rule lines are dropped; lines with 1 to 6 # are headings;
    runs of other lines between blank ones are text.
    """
    return _exploded(pages, keys, _markdown_items(F.col("markdown")))


def _html_items(html: Column) -> Column:
    """Blocks of an HTML page: its tables, then all other text as one block."""
    of = lambda t, header: F.filter(t, lambda r: r["is_header"] == header)["cells"]
    numbered = F.filter(F.transform(html_tables(html), lambda t, i: F.struct(i.alias("pos"), t.alias("t"))), lambda x: F.size(x["t"]) > 0)
    tables = F.transform(numbered, lambda x: _item(x["pos"], "table", None, None, of(x["t"], True), of(x["t"], False)))
    none = F.array().cast(NO_ROWS)
    rest = html_text(F.regexp_replace(html, r"(?is)<table[^>]*>.*?</table>", ""))
    text = F.filter(F.transform(F.array(rest), lambda t: _item(1_000_000, "text", None, t, none, none)), lambda x: x["content_text"] != "")
    return F.concat(tables, text)


def html_blocks(pages: DataFrame, keys: tuple[str, ...] = ("page_number",)) -> DataFrame:
    """Blocks of HTML pages (keys, html): their tables, then all other text as one block."""
    return as_blocks(_exploded(pages, keys, _html_items(F.col("html"))), keys)


def _sourced(pages: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, json, own, marked, plain, source): a page's blocks of JSON; only if it has none of HTML, and only then of Markdown; null arrays are not asked for."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    rows = pages.select(*keys, "json", "html", "markdown", _json_items(F.col("json")).alias("own"))
    rows = rows.select(*keys, "json", "markdown", "own", F.when(none("own") & ~blank("html"), _html_items(F.col("html"))).alias("marked"))
    rows = rows.select(*keys, "json", "own", "marked", F.when(none("own") & none("marked") & ~blank("markdown"), _markdown_items(F.col("markdown"))).alias("plain"))
    source = F.when(~none("own"), "json").when(~none("marked"), "html").when(~none("plain"), "markdown").otherwise("empty")
    return rows.select(*keys, "json", "own", "marked", "plain", source.alias("source"))


def page_blocks(pages: DataFrame, keys: tuple[str, ...] = ("page_number",)) -> DataFrame:
    """Blocks (keys, BLOCK_FIELDS, source) of pages (keys, json, html, markdown): of JSON; of a page whose JSON has none of HTML, else of Markdown."""
    plain = lambda x: _item(x["block"], x["block_type"], x["heading_level"], x["content_text"], *(F.slice(F.coalesce(x["cells"], F.array().cast(NO_ROWS)), *s) for s in ((1, 1), (2, 1_000_000))))
    items = F.when(F.col("source") == "json", F.transform("own", _json_item)).when(F.col("source") == "html", F.col("marked")).otherwise(F.transform("plain", plain))
    return as_blocks(_exploded(_sourced(pages, keys), keys, items, "source"), (*keys, "source")).select(*keys, *BLOCK_FIELDS, "source")


def normalized(pages: DataFrame, keys: tuple[str, ...] = ("page_number",)) -> DataFrame:
    """(keys, source, n_blocks, bad_json): one row for each page, also for those without blocks, whose source is empty. Nothing is shuffled."""
    bad = (F.coalesce(F.trim("json"), F.lit("")) != "") & F.try_parse_json("json").isNull()
    blocks = sum((F.greatest(F.size(c), F.lit(0)) for c in ("own", "marked", "plain")), F.lit(0))
    return _sourced(pages, keys).select(*keys, "source", blocks.cast("long").alias("n_blocks"), bad.alias("bad_json"))
