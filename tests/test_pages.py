"""Web pages: grids of nested, spanned and malformed tables, statement extracts, lists and titles."""

from finlode.operators import pages

STATEMENT = (
    '<section id="{id}"><table class="data-table"><thead><tr><th></th><th>Mar 2023</th><th>Mar 2024</th></tr></thead><tbody>'
    "<tr><td><button>Sales +</button></td><td>26,385</td><td>-15,000</td></tr><tr><td>ROE %</td><td>18%</td><td>-</td></tr>"
    "<tr><td>Raw PDF</td><td>link</td></tr><tr><td></td><td>1</td></tr><tr><td>EPS</td><td>1.5</td><td>n/a</td><td>9</td></tr></tbody></table></section>"
)
RATIOS = '<ul id="top-ratios"><li><span class="name">Market Cap</span><span class="number"><span class="value">5,62,951</span> Cr.</span></li><li><span class="name">Empty</span></li></ul>'


def grids(spark, *htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "id int, html string")
    out = {}
    for r in pages.table_cells(df).orderBy("id", "table", "row", "col").collect():
        out.setdefault((r["id"], r["table"]), []).append(r)
    return out


def shape(cells):
    rows = {}
    for c in cells:
        rows.setdefault(c["row"], []).append((c["col"], c["text"]))
    return [[t for _, t in sorted(row)] for _, row in sorted(rows.items())]


def test_spans_fill_a_grid(spark):
    html = "<table><tr><th rowspan=2>a</th><th colspan=2>b</th></tr><tr><td>c</td><td rowspan=2>d</td></tr><tr><td>e</td><td>f</td></tr></table>"
    zero = "<table><tr><td rowspan=0>x</td><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td></tr></table>"
    over = "<table><thead><tr><th rowspan=9>h</th></tr></thead><tbody><tr><td colspan='two'>b</td></tr></tbody></table>"
    got = grids(spark, html, zero, over)
    assert shape(got[0, 0]) == [["a", "b", "b"], ["a", "c", "d"], ["e", "f", "d"]]
    assert [(c["row"], c["col"]) for c in got[0, 0] if c["spanned"]] == [(0, 2), (1, 0), (2, 2)]
    assert shape(got[1, 0]) == [["x", "1"], ["x", "2"], ["x", "3"]]
    assert shape(got[2, 0]) == [["h"], ["b"]] and [c["part"] for c in got[2, 0]] == ["head", "body"]


def test_nested_and_unclosed_tables(spark):
    html = "<div id=d><table class='x y'><tr><td>out<table><tr><td>in<td>side</table>er<td>2<tr><td>3</div>!</table></div><p>after<table><tr><td>z"
    got = grids(spark, html)
    assert shape(got[0, 0]) == [["outer", "2"], ["3!"]] and shape(got[0, 1]) == [["in", "side"]] and shape(got[0, 2]) == [["z"]]
    assert {(c["table"], c["outer"], c["section"], c["classes"]) for cells in got.values() for c in cells} == {(0, None, "d", "x y"), (1, 0, "d", ""), (2, None, None, "")}


def test_entities_scripts_and_nothing(spark):
    got = grids(spark, "<table><tr><td>a &amp;\n b<br>c<script>var x='<td>no</td>'</script><td><!-- <td>no</td> --></table>", "", "</table></td>text<", None, "<tr><td>no table")
    assert list(got) == [(0, 0)] and shape(got[0, 0]) == [["a & bc", ""]]


def test_six_extracts(spark):
    page = "<html><head><title>Test Company</title></head><body>" + RATIOS + "".join(STATEMENT.format(id=sid) for sid in pages.STATEMENTS.values()) + "</body></html>"
    partial = RATIOS + STATEMENT.format(id="balance-sheet") + '<section id="quarters"><table><tr><td>no class</td></tr></table></section>'
    df = spark.createDataFrame([(1, page), (2, partial), (3, None)], "id int, html string")
    rows = pages.statements(pages.table_cells(df)).collect()
    assert {(r["id"], r["extract"]) for r in rows} == {(1, e) for e in pages.STATEMENTS} | {(2, "balance_sheet")}
    got = [(r["label"], r["period"], r["num"], r["txt"]) for r in sorted(rows, key=lambda r: (r["label"], r["place"])) if r["id"] == 1 and r["extract"] == "profit_loss"]
    assert got == [("EPS", "Mar 2023", 1.5, None), ("EPS", "Mar 2024", None, "n/a"), ("EPS", None, 9.0, None), ("ROE %", "Mar 2023", None, "18%"), ("ROE %", "Mar 2024", None, None), ("Sales", "Mar 2023", 26385.0, None), ("Sales", "Mar 2024", -15000.0, None)]
    assert {(r["id"], r["name"], r["value"]) for r in pages.snapshot(pages.list_items(df)).collect()} == {(1, "Market Cap", "5,62,951"), (2, "Market Cap", "5,62,951")}


def test_kinds_of_pages(spark):
    title = "<title>{}</title>"
    htmls = [title.format("Fine") + RATIOS, title.format("Error 404"), title.format("Just a moment..."), title.format("Access Denied") + RATIOS, "<p>nothing</p>", "<div class='a sub-nav-holder'>x", title.format("Page Not Found") * 2]
    df = spark.createDataFrame(list(enumerate(htmls)), "id int, html string")
    got = {r["id"]: (r["title"], r["reason"]) for r in pages.page_facts(df).collect()}
    assert got == {0: ("Fine", None), 1: ("Error 404", "page_not_found"), 2: ("Just a moment...", "bot_blocked"), 3: ("Access Denied", "bot_blocked"), 4: ("", "page_not_recognized"), 5: ("", None), 6: ("Page Not Found", "page_not_found")}


def test_lists_number_their_items(spark):
    html = "<ul id=a><li><b class=name>n</b><i class=value>v</i><ul id=b><li><b class=name>x</b></ul><li><b class='big name'>m</b></ul><ul id=a><li>z</ul><ol><li>none</ol>"
    rows = pages.list_items(spark.createDataFrame([(1, html)], "id int, html string")).collect()
    assert [(r["list_id"], r["name"], r["value"]) for r in rows] == [("a", "n", "v"), ("b", "x", None), ("a", "m", None), ("a", None, None)]


def test_company_pages_are_dealt_out_and_read_once(spark):
    from finlode.plans import webpages

    assert webpages._company_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = webpages.QUERIES["statement_quarters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_plain_tags_are_read_as_the_parser_reads_them(spark, monkeypatch):
    """Pages with tags taken out, doubled and broken, with and without the quick way."""
    import random
    import re

    rng = random.Random(4)
    more = ["<", "</", "<!-- <td> -->", "&amp", "<TD COLSPAN=2>", '<td colspan="3" rowspan=0>', "<title>", "</title>", "<br/>", "<a href=x&y>", '<li class="name value">', "<textarea>", "<b", "</p >", '<i class="">']
    htmls = []
    for _ in range(300):
        parts = re.split(r"(<[^>]*>)", RATIOS + "<title>a &amp; b</title>" + STATEMENT.format(id="quarters"))
        for _ in range(rng.choice([0, 1, 3, 6])):
            at = rng.randrange(len(parts))
            parts[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(parts)], [rng.choice(more)]])
        htmls.append("".join(parts))

    def read(html):
        page = pages.Page(html)
        text = lambda x: x if x is None else "".join(x)
        return [list(page.grid(t)) for t in page.tables], [(i.list_id, i.number, text(i.name), text(i.value)) for i in page.items], text(page.title), page.written, page.ids, page.classes

    plain = [read(h) for h in htmls]
    assert 50 < sum(pages.Page._plain_tags(h) is not None for h in htmls) < 300
    monkeypatch.setattr(pages.Page, "_plain_tags", staticmethod(lambda html: None))
    assert plain == [read(h) for h in htmls]


def test_web_page_titles_as_their_sql_reads_them(spark, tmp_path):
    import duckdb

    from finlode.plans import webpages

    titles = ["a &quot;b&quot;  c &amp; d &amp", "&lt;x&gt; &#65;", "plain", " ", "&amp;amp;"]
    rows = [(i, f"<html><head><title>{t}</title></head><body><p>x</body></html>") for i, t in enumerate(titles)] + [(9, "<p>no title")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = webpages.web_page_kinds(spark, str(tmp_path)).select("page_id", "title_md5", "reason").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(webpages.ORACLE_SQL["web_page_kinds"]).fetchall())
    facts = {r["id"]: r["title"] for r in pages.page_facts(spark.createDataFrame(rows, "id long, html string")).collect()}
    assert facts[0] == 'a "b" c & d &' and facts[1] == "<x> A"


def test_titles_of_web_pages_are_no_answers_to_a_request(spark, tmp_path):
    """A card number with 404 in it, or a title of an error page, says nothing of a page that nobody asked for; of a company's page it does."""
    import duckdb

    from finlode.plans import webpages

    titles = ["das 4325404893167225 m", "404 Not Found", "Access denied", "plain"]
    rows = [(i, f"<html><head><title>{t}</title></head><body></body></html>") for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = webpages.web_page_kinds(spark, str(tmp_path)).select("page_id", "title_md5", "reason").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(webpages.ORACLE_SQL["web_page_kinds"]).fetchall())
    assert [r["reason"] for r in pages.page_facts(df, "page_id").orderBy("id").collect()] == ["page_not_found", "page_not_found", "bot_blocked", "page_not_recognized"]
