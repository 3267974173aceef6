"""xlsx / CSV readers and the result writers."""

import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from ledgerlens.operators import sinks
from ledgerlens.sources.csv_grid import read_csv_grid
from ledgerlens.sources.xlsx import read_workbook, read_xlsx_grid


def tmpdir():
    return tempfile.mkdtemp(prefix="ll-test-", dir="/tmp")


def test_xlsx_grid_source(spark):
    d = tmpdir()
    with open(os.path.join(d, "MOV a.xlsx"), "wb") as fh:
        fh.write(sinks.workbook_bytes([("NOTES", [["x"]]),
                                       ("MOUVEMENT", [["Titre"], [None], ["Date", "REF", "STOCK"],
                                                      [45000, "A.1", 3.5], [None, "B", None, "z"]])]))
    rows = read_xlsx_grid(spark, os.path.join(d, "*.xlsx")).orderBy("sheet_pos", "row_idx").collect()
    assert [(r.sheet, r.row_idx) for r in rows] == [("NOTES", 0), ("MOUVEMENT", 0), ("MOUVEMENT", 2),
                                                    ("MOUVEMENT", 3), ("MOUVEMENT", 4)]
    assert rows[3].cells == ["45000", "A.1", "3.5"] and rows[4].cells == [None, "B", None, "z"]
    sheets = spark.createDataFrame(rows).select("file_id", "sheet_pos", "sheet").distinct().count()
    assert sheets == 2


def test_csv_encoding_bom_delimiter_quotes(spark):
    d = tmpdir()
    with open(os.path.join(d, "a.csv"), "wb") as fh:
        fh.write("﻿Date;REF;Qté\n\n01/02/2025;\"A;1\";3,5\n02/02/2025;B;\"x\"\"y\"\n".encode("utf-8"))
    with open(os.path.join(d, "b.csv"), "wb") as fh:
        fh.write("Date,REF,Qt\xe9\n01/02/2025,A,\x80 3\n".encode("latin-1"))
    with open(os.path.join(d, "c.csv"), "wb") as fh:
        fh.write(b"Date|REF|QTY\n1|2|\n")
    rows = {(os.path.basename(r.file_id), r.row_idx): r.cells for r in read_csv_grid(spark, d + "/*.csv").collect()}
    assert rows[("a.csv", 0)] == ["Date", "REF", "Qté"]
    assert rows[("a.csv", 1)] == ["01/02/2025", "A;1", "3,5"]          # blank line skipped, quotes kept whole
    assert rows[("a.csv", 2)] == ["02/02/2025", "B", 'x"y']
    assert rows[("b.csv", 0)] == ["Date", "REF", "Qté"]                # code page 1252
    assert rows[("b.csv", 1)][2] == "€ 3"
    assert rows[("c.csv", 1)] == ["1", "2", None]


def test_csv_partitions_round_trip_special_names(spark):
    df = spark.createDataFrame([("U", "+croute", "match", "A", 1.0), ("U", " pet ", "discrepancy", "B", 2.0),
                                ("U", "(ouate", "match", "C", 3.0), ("U", "فيبر", "match", "D", 4.0)],
                               "unit string, atelier string, status string, Ref string, Difference double")
    path = sinks.fresh_output(spark, "t-csv")
    sinks.write_csv(df, path)
    back = sinks.read_csv_results(spark, path)
    assert sorted(r.atelier for r in back.collect()) == sorted(["+croute", " pet ", "(ouate", "فيبر"])
    assert back.columns[0] == "Ref"
    files = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")]
    assert files and all(open(f, "rb").read().startswith(b"\xef\xbb\xbfRef,Difference") for f in files)


def test_csv_export_quotes_for_spreadsheets(spark):
    import csv
    df = spark.createDataFrame([("U", "A", "match", 'PIPE 5" STEEL, "cut"', "مرجع\nx")], "unit string, atelier string, status string, Ref string, note string")
    path = sinks.fresh_output(spark, "t-csv")
    sinks.write_csv(df, path)
    file = next(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-"))
    assert list(csv.reader(open(file, encoding="utf-8-sig", newline=""))) == [["Ref", "note"], ['PIPE 5" STEEL, "cut"', "مرجع\nx"]]


def test_a_truncated_workbook_delivers_an_error_and_no_rows(spark):
    from ledgerlens.session import cut_lineage
    from ledgerlens.sources.grid_reader import read_files, readable, unreadable
    d = tmpdir()
    whole = sinks.workbook_bytes([("A", [["Date", "REF"]]), ("S", [["Date", "REF", "STOCK"]] + [[f"d{i}", f"r{i}", i] for i in range(9000)])])
    with zipfile.ZipFile(os.path.join(d, "half.xlsx"), "w") as z, zipfile.ZipFile(__import__("io").BytesIO(whole)) as w:
        for n in w.namelist():  # the second sheet breaks off in its rows
            z.writestr(n, w.read(n)[:-2000] if n.endswith("sheet2.xml") else w.read(n))
    with open(os.path.join(d, "whole.xlsx"), "wb") as fh:
        fh.write(whole)
    with open(os.path.join(d, "cut.xlsx"), "wb") as fh:
        fh.write(whole[:len(whole) // 2])
    got = cut_lineage(read_files(spark, d + "/*"), "t-files")
    assert sorted(os.path.basename(r.file_id) for r in unreadable(got).collect()) == ["cut.xlsx", "half.xlsx"]
    assert {(os.path.basename(r.file_id), r["count"]) for r in readable(got).groupBy("file_id").count().collect()} == {("whole.xlsx", 9002)}


def test_report_and_xlsx_writers(spark):
    lines = spark.createDataFrame([("F", "A", i, f"line {i:03d}") for i in range(50)] +
                                  [("F", None, -1, "# title")], "unit string, atelier string, line_no int, line string")
    path = sinks.fresh_output(spark, "t-md")
    sinks.write_report(lines, path, num_partitions=4)
    parts = sorted(f for f in os.listdir(os.path.join(path, "unit=F")) if f.startswith("part-"))
    text = "".join(open(os.path.join(path, "unit=F", f)).read() for f in parts).splitlines()
    assert text[0] == "# title" and text[1:] == [f"line {i:03d}" for i in range(50)]
    recon = spark.createDataFrame([("F", "A", "discrepancy", f"R{i}", float(i)) for i in range(30)],
                                  "unit string, atelier string, status string, Ref string, Difference double")
    out = sinks.write_xlsx(recon, os.path.join(tmpdir(), "x"), num_partitions=3).collect()
    assert sum(r.rows for r in out) == 30
    for r in out:
        with zipfile.ZipFile(r.file) as z:
            assert "xl/worksheets/sheet1.xml" in z.namelist()
        assert len(list(read_workbook(r.file))) == r.rows + 1


def test_read_grid_dispatches_by_extension(spark):
    from ledgerlens.sources.grid_reader import read_grid
    d = tmpdir()
    with open(os.path.join(d, "a.xlsx"), "wb") as fh:
        fh.write(sinks.workbook_bytes([("S", [["Date", "REF"], ["1", "x"]])]))
    with open(os.path.join(d, "b.csv"), "wb") as fh:
        fh.write(b"Date;REF\n2;y\n")
    with open(os.path.join(d, "notes.txt"), "wb") as fh:
        fh.write(b"ignored")
    got = {(r.file_id, r.sheet, r.row_idx): r.cells for r in read_grid(spark, d + "/*").collect()}
    assert got == {(d + "/a.xlsx", "S", 0): ["Date", "REF"], (d + "/a.xlsx", "S", 1): ["1", "x"],
                   (d + "/b.csv", "CSV", 0): ["Date", "REF"], (d + "/b.csv", "CSV", 1): ["2", "y"]}


def test_assign_snapshots_by_period_and_fallback(spark):
    from ledgerlens.sources.files import assign_snapshots
    files = spark.createDataFrame([("M", "/p/STOCK 3-2025.xlsx", "STOCK 3-2025.xlsx", 0),
                                   ("M", "/p/inventaire.xlsx", "inventaire.xlsx", 1),
                                   ("N", "/p/a.xlsx", "a.xlsx", 0), ("N", "/p/b.xlsx", "b.xlsx", 1),
                                   ("N", "/p/STOCK 11-2024.xlsx", "STOCK 11-2024.xlsx", 2)],
                                  "unit string, path string, file_name string, file_pos int")
    got = {(r.unit, r.file_name): r.role for r in assign_snapshots(files, 2025, 3).collect()}
    assert got == {("M", "STOCK 3-2025.xlsx"): "current", ("M", "inventaire.xlsx"): "previous",
                   ("N", "a.xlsx"): "current", ("N", "b.xlsx"): "previous"}


def test_csv_delimiter_counts_rows_outside_quotes(spark):
    from ledgerlens.sources.csv_grid import csv_grid, lines_of
    files = [("a.csv", b"Date;REF;QTE\n1,5;2,5;3,5\n2;x;4\n"),
             ("b.csv", b'Date;REF;QTE\r\n"a, b, c, d";"x ""q""";3\r\n\r\n"l1\nl2";;5\r\n')]
    got = {(r.file_id, r.row_idx): r.cells for r in csv_grid(lines_of(spark.createDataFrame(files, "path string, content binary"))).collect()}
    assert got[("a.csv", 1)] == ["1,5", "2,5", "3,5"]                  # decimal commas are no separators
    assert got[("b.csv", 1)] == ["a, b, c, d", 'x "q"', "3"]           # nor are those inside quotes
    assert got[("b.csv", 2)] == ["l1\nl2", None, "5"]                  # a line break inside quotes is text


def test_workbook_writer_survives_a_retry(spark):
    """A task that runs twice writes the same names again."""
    recon = spark.createDataFrame([("F", "A", "match", f"R{i}", float(i)) for i in range(40)],
                                  "unit string, atelier string, status string, Ref string, Difference double")
    path = os.path.join(tmpdir(), "x")
    one = sorted(map(tuple, sinks.write_xlsx(recon, path, num_partitions=2).collect()))
    two = sorted(map(tuple, sinks.write_xlsx(recon, "file:" + path, num_partitions=2).collect()))
    assert [n for _, n in one] == [n for _, n in two]
    assert sorted(os.listdir(path)) == sorted(os.path.basename(f) for f, _ in one)


def test_scratch_is_removed(spark):
    from ledgerlens.session import cut_lineage, remove_scratch
    kept = spark.sparkContext.__dict__.pop("_ledgerlens_scratch", [])
    cut_lineage(spark.range(3), "gone")
    path = spark.sparkContext.__dict__["_ledgerlens_scratch"][0]
    assert os.path.isdir(path.removeprefix("file:"))
    remove_scratch(spark)
    assert not os.path.exists(path.removeprefix("file:"))
    spark.sparkContext.__dict__["_ledgerlens_scratch"] = kept


def plain_csv(data: bytes):
    """Rows of a CSV file by the standard library; an unclosed quote as the
    reader defines it."""
    import csv
    import io
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1252", errors="replace")
    text = text.replace("\r\n", "\n").replace("\r", "\n")

    def cut(t):
        return [[x or None for x in r] for r in csv.reader(io.StringIO(t, newline=""), delimiter=";") if r and (len(r) != 1 or r[0].strip(" "))]

    lines = text.split("\n")
    open_at, at = None, 0
    while at < len(lines):
        end = at + 1
        while end <= len(lines) and _open("\n".join(lines[at:end])):
            end += 1
        if end > len(lines):
            open_at = at
            break
        at = end
    if open_at is None:
        return cut(text)
    out = cut("\n".join(lines[:open_at])) if open_at else []
    for x in lines[open_at:]:
        out += cut(x)
    return out


def _open(text: str) -> bool:
    """Whether a text ends inside a quoted field."""
    state = "start"
    for c in text:
        if state == "quoted":
            state = "closing" if c == '"' else "quoted"
        elif c == '"' and state in ("start", "closing"):
            state = "quoted"
        elif c in ";\n":
            state = "start"
        else:
            state = "plain"
    return state == "quoted"


def test_csv_of_many_blocks_equals_the_standard_library(spark):
    """Quotes inside fields, breaks inside quotes, blank lines and unclosed
    quotes, in blocks of a few bytes and in one block."""
    import random

    from ledgerlens.session import cut_lineage
    from ledgerlens.sources.csv_grid import NOTED, csv_grid, read_lines
    rnd = random.Random(9)
    fields = ["", "x", 'PIPE 5" STEEL', '"a;b"', '"l1\nl2"', '"say ""hi"""', '"q"tail', '""', '"\n\n"', "é", ' "no"', '"a\r\nb;c"', '"""\n"""', "12,5"]
    d, want = tmpdir(), {}
    for i in range(14):
        rows = [";".join(rnd.choice(fields) for _ in range(4)) for _ in range(rnd.randrange(1, 60))]
        text = "a;b;c;d\n" + "".join(r + rnd.choice(["\n", "\r\n", "\n\n", "\n  \n"]) for r in rows)
        if i % 4 == 3:
            text += 'x;"never closed;z\nb;"c";5" d\n1;2;"3\n'
        data = text.encode("cp1252" if i % 3 == 1 else "utf-8-sig" if i % 3 else "utf-8")
        name = f"f +{i}%20.csv"
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
        want[name] = plain_csv(data)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for block in ("64", "300", size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            lines = cut_lineage(read_lines(spark, d + "/*"), "t-lines")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert (lines.select("file_id", "block").distinct().count() > 14) == (block != size)
        got = csv_grid(lines).collect()
        rows = {}
        for r in got:
            if r.sheet_pos >= 0:
                rows.setdefault(os.path.basename(r.file_id), []).append((r.row_idx, r.cells))
        assert {f: [c for _, c in sorted(x)] for f, x in rows.items()} == want
        assert all(sorted(i for i, _ in x) == list(range(len(x))) for x in rows.values())
        assert {os.path.basename(r.file_id) for r in got if r.sheet_pos == NOTED} == {f"f +{i}%20.csv" for i in (3, 7, 11)}


def test_inch_marks_keep_their_rows(spark):
    d = tmpdir()
    with open(os.path.join(d, "a.csv"), "wb") as fh:
        fh.write(b'Date;REF;QTE\n1/2/2025;A;1\n2/2/2025;PIPE 5" STEEL;2\n3/2/2025;B;3\n4/2/2025;C;4\n')
    rows = read_csv_grid(spark, d + "/*.csv").orderBy("row_idx").collect()
    assert [r.cells[1] for r in rows] == ["REF", "A", 'PIPE 5" STEEL', "B", "C"]


def test_csv_ledgers_are_files_of_one_folder(spark):
    """Not a folder per file; a file without a name takes all lines that have
    none, and lines are in the order of their keys."""
    from ledgerlens.sources.grids import csv_ledger_files
    d, out = tmpdir(), sinks.fresh_output(spark, "t-ledgers")
    rows = [(k, n, 1.5, f, "F", "1998-06-01") for k, f in ((7, "A"), (1002, "A"), (3001, "N:"), (5, None)) for n in (2, 1, 3)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, d string")
    li.withColumn("l_shipdate", F.col("d").cast("timestamp_ntz")).repartition(3).write.parquet(d + "/lineitem.parquet")
    made = {r.file: r.rows for r in csv_ledger_files(spark, d, out).collect()}
    assert made == {"csv_AF_0": 4, "csv_AF_1": 4, "csv_N:F_3": 4, "__HIVE_DEFAULT_PARTITION__": 4}
    assert sorted(os.listdir(out)) == ["path=__HIVE_DEFAULT_PARTITION__", "path=csv_AF_0", "path=csv_AF_1", "path=csv_N%3AF_3"]
    assert open(out + "/path=csv_AF_0", "rb").read() == 'Date;REFERENCE;Qté;STOCK;LOCALISATION\n1/6/1998;7;part;1,50;A\n1/6/1998;7;part;1,50;A\n1/6/1998;7;PIPE 5" STEEL;1,50;A\n'.encode("latin-1")
    assert open(out + "/path=csv_AF_1", "rb").read().startswith('﻿Date,REFERENCE,Qté,STOCK,LOCALISATION\n1/6/1998,"1002",part,1.50,A\n'.encode())


def test_csv_lines_of_mixed_encodings(spark):
    """In a file that is no UTF-8 a line that is by chance is not read as such."""
    from ledgerlens.sources.csv_grid import csv_grid, lines_of
    files = [("a.csv", b"\xef\xbb\xbfDate;REF\n1;\xc3\xa9\n2;\xe9\n3;x\n"), ("b.csv", b"\xef\xbb\xbfDate;REF\n1;\xc3\xa9\n")]
    got = {(r.file_id, r.row_idx): r.cells for r in csv_grid(lines_of(spark.createDataFrame(files, "path string, content binary"))).collect()}
    assert [got["a.csv", i] for i in range(4)] == [["Date", "REF"], ["1", "Ã©"], ["2", "é"], ["3", "x"]]
    assert [got["b.csv", i] for i in range(2)] == [["Date", "REF"], ["1", "é"]]


def test_workbook_rows_of_any_form_are_read_alike(spark):
    """The writer's rows are taken by the pattern; what it does not take goes
    through the parser, in its place, and errors stay errors."""
    import io

    from ledgerlens.sources import xlsx
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def sheet(xml, shared=""):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(sinks.workbook_bytes([("S", [])]))) as z, zipfile.ZipFile(out, "w") as w:
            for n in z.namelist():
                w.writestr(n, xml if n.endswith("sheet1.xml") else z.read(n))
            w.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")
        got = []
        try:
            got += [(r, c) for _, _, r, c in xlsx.read_workbook(io.BytesIO(out.getvalue()))]
        except Exception as e:  # noqa: BLE001
            got.append(type(e).__name__)
        return got

    made = sinks.workbook_bytes([("S", [[f"d{i}", i, None, i / 2] for i in range(9000)])])
    text = zipfile.ZipFile(io.BytesIO(made)).read("xl/worksheets/sheet1.xml").decode()
    assert len(xlsx._ROW.findall(text)) == 9000
    assert [c for *_, c in xlsx.read_workbook(io.BytesIO(made))] == [[f"d{i}", str(i), None, str(i // 2) if i % 2 == 0 else repr(i / 2)] for i in range(9000)]
    simple = '<row r="{}"><c r="A{}"><v>{}</v></c><c r="C1" t="s"><v>1</v></c></row>'
    for plain in (False, True):
        first = simple.format(1, 1, 5) if plain else simple.format(1, 1, 5).replace("<v>5", "<f>x</f><v>5")
        odd = '<row r="2"><c><v>1</v></c><c r="AB2" t="inlineStr"><is><r><t>a&amp;b</t></r><r><t>c<!-- x -->d</t></r></is></c></row>'
        rows = f"<worksheet {ns}><cols/><sheetData>{first}{odd}{simple.format(7, 7, 'inf')}"
        got = sheet(rows + "</sheetData></worksheet>", "<si><t>s0</t></si><si><t>s1</t></si>")
        assert got == [(0, ["5", None, "s1"]), (1, ["1"] + [None] * 26 + ["a&bcd"]), (6, ["inf", None, "s1"])]
        assert sheet(rows + "</worksheet>", "<si/><si/>")[-1] == "ParseError"
        assert sheet(rows + "</sheetData></worksheet>", "<si/>") == ["IndexError"]
    prefixed = f'<x:worksheet xmlns:x="{ns[7:-1]}"><x:sheetData>{simple.format(1, 1, 5)}<x:row r="3"><x:c r="B3"><x:v>7</x:v></x:c></x:row></x:sheetData></x:worksheet>'
    assert sheet(prefixed) == [(2, [None, "7"])]


def test_workbooks_of_a_folder_by_name(spark):
    d = tmpdir()
    for name in ("a.xlsx", "None"):
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(sinks.workbook_bytes([("S", [["Date"]])]))
    assert [os.path.basename(r.file_id) for r in read_xlsx_grid(spark, d, "*.xlsx").collect()] == ["a.xlsx"]
