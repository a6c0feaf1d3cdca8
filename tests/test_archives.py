"""Archives against loose files, and page counts of PDF files of several kinds."""

import io
import random
import zipfile
import zlib

from finlode.sources import archives


def plain_pdf(n, extra=b""):
    """A PDF file with a cross-reference table."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (3 + i) for i in range(n)), n)]
    objects += [b"<< /Type /Page /Parent 2 0 R >>"] * n
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for i, o in enumerate(objects):
        places.append(out.tell())
        out.write(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o))
    start = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF%s" % (len(objects) + 1, start, extra))
    return out.getvalue()


def packed_pdf(n, predictor=False):
    """A PDF file whose catalogue and page tree are in an object stream, with a cross-reference stream."""
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count %d >>" % n]
    places = b" ".join(b"%d %d" % (i + 1, sum(len(x) + 1 for x in inner[:i])) for i in range(2)) + b" "
    body = zlib.compress(places + b"\n".join(inner))
    out = io.BytesIO()
    out.write(b"%PDF-1.5\n")
    at = out.tell()
    out.write(b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(places), len(body)) + body + b"\nendstream\nendobj\n")
    start = out.tell()
    rows = [(0, 0, 0), (2, 3, 0), (2, 3, 1), (1, at, 0), (1, start, 0)]
    table = [bytes([k]) + p.to_bytes(3, "big") + bytes([i]) for k, p, i in rows]
    if predictor:
        before, coded = bytes(5), []
        for row in table:
            coded.append(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, before, strict=True)))
            before = row
        table = coded
    extra = b" /DecodeParms << /Predictor 12 /Columns 5 >>" if predictor else b""
    body = zlib.compress(b"".join(table))
    out.write(b"4 0 obj\n<< /Type /XRef /Size 5 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode%s /Length %d >>\nstream\n" % (extra, len(body)) + body + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % start)
    return out.getvalue()


def updated_pdf(n, more):
    """A file whose page tree was replaced by an appended section."""
    first = plain_pdf(n)
    at = len(first) + 1
    own = b"2 0 obj\n<< /Type /Pages /Kids [] /Count %d >>\nendobj\n" % more
    old = int(first.rpartition(b"startxref")[2].split()[0])
    return first + b"\n" + own + b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, old, at + len(own))


def test_page_counts(spark):
    cases = [(plain_pdf(3), 3), (plain_pdf(250), 250), (packed_pdf(41), 41), (packed_pdf(7, True), 7), (updated_pdf(3, 12), 12), (b"", None), (b"no pdf", None), (b"%PDF-1.4 broken startxref 99999", None), (None, None), (plain_pdf(2)[:60], None)]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, (c, _) in enumerate(cases)], "id int, content binary")
    got = {r["id"]: r["total_pages"] for r in archives.page_counts(df).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases)}


def test_archives_give_what_loose_files_give(spark, tmp_path):
    rng = random.Random(1)
    loose, want = tmp_path / "loose", {}
    (tmp_path / "zips" / "sub").mkdir(parents=True)
    loose.mkdir()
    for a in range(3):
        with zipfile.ZipFile(tmp_path / "zips" / ("sub" if a else ".") / f"r{a}.zip", "w", zipfile.ZIP_DEFLATED if a else zipfile.ZIP_STORED) as z:
            z.mkdir("out")
            for page in range(1, 30):
                for kind in rng.sample(["json", "htm", "html", "md", "txt"], rng.randint(0, 3)):
                    text = f"é {a} {page} {kind} " * rng.randint(1, 200)
                    z.writestr(f"out/page_{page}.{kind}", text)
                    (loose / f"r{a}__page_{page}.{kind}").write_text(text)
                    want[f"r{a}.zip", f"out/page_{page}.{kind}"] = text.encode()
    for split, tasks in ((1 << 30, 3), (20_000, 10)):
        files = archives.archive_files(spark, str(tmp_path / "zips"), split)
        assert {(r["archive"], r["member"]): bytes(r["content"]) for r in files.collect()} == want
        assert files.rdd.getNumPartitions() >= tasks
    whole = spark.read.format("binaryFile").load(str(loose)).selectExpr("concat(regexp_extract(path, '(r[0-9])__', 1), '.zip') AS archive", "regexp_replace(path, '.*__', '') AS member", "content")
    one, two = (sorted(map(tuple, archives.report_parts(t).collect())) for t in (files, whole))
    assert one == two and len(one) > 40
    assert archives.archive_files(spark, f"file://{tmp_path}/zips/r0.zip").count() == sum(1 for a, _ in want if a == "r0.zip")


def test_archives_in_another_store(spark, tmp_path):
    """A path that only Spark can open: each archive is read whole."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("p1.json", "{}")
        z.writestr("p2.md", "x")
    spark.conf.set("fs.viewfs.mounttable.zips.link./in", f"file://{tmp_path}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.zips.link./in", f"file://{tmp_path}")
    got = archives.archive_files(spark, "viewfs://zips/in").select("archive", "member", "size").collect()
    assert sorted(map(tuple, got)) == [("a.zip", "p1.json", 2), ("a.zip", "p2.md", 1)]


def test_an_empty_folder(spark, tmp_path):
    assert archives.archive_files(spark, str(tmp_path)).count() == 0
