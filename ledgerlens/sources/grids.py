"""Sheet grids: the untyped form every spreadsheet / CSV input takes.

``grid(file_id, sheet_pos, sheet, row_idx, cells ARRAY<STRING>)`` - one row
per sheet row, NULL for an empty cell.  Readers for real files live in
``sources.csv_grid`` and ``sources.xlsx``; this module also renders the
benchmark tables as workbooks (title rows, a header row whose layout and
column names vary per file, then one row per line item) so the header and
column rules run over data that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checked_broadcast
from ledgerlens.sources.tables import read_table

GRID_SCHEMA = "file_id string, sheet_pos int, sheet string, row_idx bigint, cells array<string>"

# Ledger workbook layouts by return flag: title rows, header cells, and the
# order of (date, ref, designation, qty, location) in the row.
LEDGER_LAYOUTS = {
    "A": (["Suivi des mouvements"], ["Date", "REFERENCE", "DESIGNATION", "STOCK", "LOCALISATION"],
          ["date", "ref", "des", "qty", "loc"]),
    "N": ([], ["LA DATE", "Référence", "DESIGNATION", "STOCK PV", "LOCALISATION"],
          ["date", "ref", "des", "qty", "loc"]),
    "R": (["Suivi des mouvements", None, "Unité de production"],
          ["REF", "DESIGNATION", "DATE", "STOCKS", "LOCALISATION"],
          ["ref", "des", "date", "qty", "loc"]),
}
LEDGER_SHEETS = {"F": "MOUVEMENT", "O": "MOV"}


def _arr(values) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values])


def _line_cells(d: Column, ref: Column, des: Column, qty: Column, loc: Column, order) -> Column:
    parts = {"date": d, "ref": ref, "des": des, "qty": qty, "loc": loc}
    return F.array(*[parts[k] for k in order])


def _case(key: Column, mapping: dict, build) -> Column:
    out = None
    for k, v in mapping.items():
        e = build(v)
        out = F.when(key == k, e) if out is None else out.when(key == k, e)
    return out


def _title_rows(files: DataFrame, key: Column, layouts: dict, width: int) -> DataFrame:
    """Title rows and the header row for each file, from its layout."""
    rows = []
    for k, (titles, header, _order) in layouts.items():
        cells = [[t] + [None] * (width - 1) if t is not None else [None] * width for t in titles]
        cells.append(header)
        rows.append((k, [(i, c) for i, c in enumerate(cells)]))
    expr = _case(key, {k: v for k, v in rows},
                 lambda rs: F.array(*[F.struct(F.lit(i).cast("bigint").alias("row_idx"), _arr(c).alias("cells"))
                                      for i, c in rs]))
    return files.select("*", F.explode(expr).alias("r")).select("*", "r.row_idx", "r.cells").drop("r")


def ledger_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as six movement workbooks ('MOV <flag><status>.xlsx').

    Dates are d/M/yyyy text, quantities 2-dp text; each file's header sits
    after its title rows and data rows follow in (order key, line) order.
    """
    li = read_table(spark, sf_dir, "lineitem")
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    file_id = F.concat(F.lit("MOV "), rf, ls, F.lit(".xlsx"))
    sheet = _case(ls, LEDGER_SHEETS, lambda s: F.lit(s))
    n_top = _case(rf, LEDGER_LAYOUTS, lambda v: F.lit(len(v[0]) + 1))
    d = F.date_format(F.col("l_shipdate").cast("date"), "d/M/yyyy")
    ref = F.col("l_orderkey").cast("string")
    des = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    qty = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    cells = _case(rf, LEDGER_LAYOUTS, lambda v: _line_cells(d, ref, des, qty, rf, v[2]))
    data = li.select(file_id.alias("file_id"), F.lit(0).alias("sheet_pos"), sheet.alias("sheet"),
                     (n_top + F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("row_idx"),
                     cells.alias("cells"))
    # a row per file, written once: else every part of the union finds it again
    files = checked_broadcast(li.select(rf.alias("_rf"), ls.alias("_ls")).distinct(), "ledger-files")
    files = files.select("_rf", F.concat(F.lit("MOV "), "_rf", "_ls", F.lit(".xlsx")).alias("file_id"),
                         F.lit(0).alias("sheet_pos"), _case(F.col("_ls"), LEDGER_SHEETS, lambda s: F.lit(s)).alias("sheet"))
    top = _title_rows(files, F.col("_rf"), LEDGER_LAYOUTS, 5).drop("_rf", "_ls")
    # a small notes sheet in front of the ledger sheet of every 'F' file
    notes = (files.where(F.col("_ls") == "F")
             .select("file_id", F.lit(-1).alias("sheet_pos"), F.lit("NOTES").alias("sheet"),
                     F.lit(0).cast("bigint").alias("row_idx"),
                     F.array(F.lit("Remarques"), F.concat(F.lit("fichier "), F.col("file_id"))).alias("cells")))
    grid = data.unionByName(top).unionByName(notes)
    # sheet positions: NOTES first (0), the ledger sheet after it
    return grid.withColumn("sheet_pos", F.when(F.col("sheet") == "NOTES", 0).otherwise(
        F.when(F.col("file_id").endswith("F.xlsx"), 1).otherwise(0)).cast("int"))


STOCK_FILE = "STOCK 06-1998.xlsx"
STOCK_HEADER = ["REFERENCE", "DESIGNATION", "QUANTITE", "LOCALISATION"]


def stock_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot workbook: a junk first sheet, then sheet 'STOCK' holding the
    lines shipped before July 1998 (ref, designation, qty, location)."""
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz"))
    nation = read_table(spark, sf_dir, "nation")
    data = li.select(
        F.lit(STOCK_FILE).alias("file_id"), F.lit(1).alias("sheet_pos"), F.lit("STOCK").alias("sheet"),
        (F.lit(2) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("row_idx"),
        F.array(F.concat(F.lit(" "), F.col("l_orderkey").cast("string")),
                F.concat(F.lit("part "), F.col("l_partkey").cast("string")),
                F.col("l_quantity").cast("decimal(18,2)").cast("string"),
                F.col("l_returnflag")).alias("cells"))
    head = spark.createDataFrame(
        [(STOCK_FILE, 1, "STOCK", 0, ["ETAT DE STOCK AU 30/06/1998", None, None, None]),
         (STOCK_FILE, 1, "STOCK", 1, STOCK_HEADER)], GRID_SCHEMA)
    junk = nation.select(F.lit(STOCK_FILE).alias("file_id"), F.lit(0).alias("sheet_pos"),
                         F.lit("Feuil1").alias("sheet"), F.col("n_nationkey").cast("bigint").alias("row_idx"),
                         F.array(F.col("n_name")).alias("cells"))
    return data.unionByName(head).unionByName(junk)


# Multi-sheet snapshot: one sheet per location, each with its own header and
# quantity column name (title rows, header cells).
MULTI_SHEETS = {
    "A": ("MAG A", ["Inventaire magasin A"], ["REFERENCE", "DESIGNATION", "QUANTITE"]),
    "N": ("MAG N", [], ["REF", "QUANTITE/KG"]),
    "R": ("MAG R", ["Inventaire", "magasin R"], ["Ref produit", "Désignation", "QUANTITE/M"]),
}
MULTI_FILE = "STOCK MAGASINS.xlsx"


def multi_sheet_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    rf = F.col("l_returnflag")
    ref = F.col("l_orderkey").cast("string")
    qty = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    des = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    cells = (F.when(rf == "A", F.array(ref, des, qty)).when(rf == "N", F.array(ref, qty))
             .otherwise(F.array(ref, des, qty)))
    n_top = _case(rf, MULTI_SHEETS, lambda v: F.lit(len(v[1]) + 1))
    sheet = _case(rf, MULTI_SHEETS, lambda v: F.lit(v[0]))
    pos = _case(rf, {k: i for i, k in enumerate(MULTI_SHEETS)}, lambda i: F.lit(i))
    data = li.select(F.lit(MULTI_FILE).alias("file_id"), pos.cast("int").alias("sheet_pos"), sheet.alias("sheet"),
                     (n_top + F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("row_idx"),
                     cells.alias("cells"))
    rows = []
    for i, (k, (name, titles, header)) in enumerate(MULTI_SHEETS.items()):
        for j, t in enumerate(titles):
            rows.append((MULTI_FILE, i, name, j, [t] + [None] * (len(header) - 1)))
        rows.append((MULTI_FILE, i, name, len(titles), header))
    return data.unionByName(spark.createDataFrame(rows, GRID_SCHEMA))


# Two movement sheets of one workbook, stacked: entries (status F, day-first
# dates) and exits (status O, month-first dates).
PAIR_FILE = "MOV ENTREES SORTIES.xlsx"
PAIR_SHEETS = {"F": ("ENTREES", ["Date", "REFERENCE", "STOCK"], "d/M/yyyy"),
               "O": ("SORTIES", ["LA DATE", "REF", "STOCKS"], "M/d/yyyy")}


def paired_ledger_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    ls = F.col("l_linestatus")
    d = F.col("l_shipdate").cast("date")
    date_txt = F.when(ls == "F", F.date_format(d, "d/M/yyyy")).otherwise(F.date_format(d, "M/d/yyyy"))
    sheet = _case(ls, PAIR_SHEETS, lambda v: F.lit(v[0]))
    pos = F.when(ls == "F", 0).otherwise(1)
    data = li.select(F.lit(PAIR_FILE).alias("file_id"), pos.cast("int").alias("sheet_pos"), sheet.alias("sheet"),
                     (F.lit(1) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("row_idx"),
                     F.array(date_txt, F.col("l_orderkey").cast("string"),
                             F.col("l_quantity").cast("decimal(18,2)").cast("string")).alias("cells"))
    rows = [(PAIR_FILE, i, v[0], 0, v[1]) for i, v in enumerate(PAIR_SHEETS.values())]
    return data.unionByName(spark.createDataFrame(rows, GRID_SCHEMA))


def sheets_of(grid: DataFrame) -> DataFrame:
    """Workbook sheet list ``(file_id, sheet_pos, sheet)``."""
    return grid.groupBy("file_id", "sheet").agg(F.min("sheet_pos").alias("sheet_pos")).select(
        "file_id", "sheet_pos", "sheet")


# CSV exports of the ledger: one file per (flag, status, block of 1000 orders),
# so a file's size is bounded while the number of files grows with the data.
# The block number picks the delimiter and the encoding.
CSV_BLOCK = 1000
CSV_HEADER = ["Date", "REFERENCE", "Qté", "STOCK", "LOCALISATION"]


#: Characters of a name that its file writes as %XX, and the name for NULL.
CSV_ESCAPED = {chr(c): f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}
CSV_NULL = "__HIVE_DEFAULT_PARTITION__"


def csv_ledger_files(spark: SparkSession, sf_dir: str, out_dir: str) -> DataFrame:
    """Write the ledger as CSV files into the shared folder ``out_dir``, the
    file of a name as ``path=<name>``.  Parts carry inch marks, and quoted
    texts with delimiters, doubled quotes and line breaks.  A task writes the
    files it holds one after the other, each line by line, so a file may have
    any size.  Returns (file, rows) per file."""
    from itertools import groupby
    from urllib.parse import quote

    from ledgerlens.operators.sinks import new_file
    from ledgerlens.session import cut_lineage, ship_package
    from ledgerlens.sources.csv_grid import SEPARATORS
    ship_package(spark)
    li = read_table(spark, sf_dir, "lineitem").withColumn("block", (F.col("l_orderkey") / CSV_BLOCK).cast("long"))
    sep = F.element_at(F.array(*[F.lit(s) for s in SEPARATORS]), (F.col("block") % len(SEPARATORS)).cast("int") + 1)
    qty = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    qty = F.when(F.col("sep") == ";", F.replace(qty, F.lit("."), F.lit(","))).otherwise(qty)
    ref = F.col("l_orderkey").cast("string")
    ref = F.when(F.col("sep") == ",", F.concat(F.lit('"'), ref, F.lit('"'))).otherwise(ref)
    n = F.col("l_linenumber")
    part = (F.when(n == 3, 'PIPE 5" STEEL').when(n == 5, F.concat(F.lit('"5"" pipe'), "sep", F.lit('steel\n\ncut"'))).otherwise("part"))
    path = F.coalesce(F.concat(F.lit("csv_"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit("_"), F.col("block").cast("string")), F.lit(CSV_NULL))
    path = F.when(path != "", path).otherwise(CSV_NULL).alias("path")
    latin = F.col("block") % 3 == 0

    def encoded(line):
        line = F.concat(F.coalesce(line, F.lit("")), F.lit("\n"))
        return F.when(latin, F.encode(line, "ISO-8859-1")).otherwise(F.encode(line, "UTF-8")).alias("line")

    line = F.concat_ws("", F.date_format(F.col("l_shipdate").cast("date"), "d/M/yyyy"), "sep", ref, "sep", part, "sep", qty, "sep", "l_returnflag")
    lines = li.withColumn("sep", sep).select(path, F.col("l_orderkey").alias("at"), F.col("l_linenumber").cast("int").alias("n"), encoded(line))
    head = F.expr("array_join(array(" + ", ".join(f"'{h}'" for h in CSV_HEADER) + "), sep)")
    heads = li.select("l_returnflag", "l_linestatus", "block").distinct().withColumn("sep", sep).select(
        path, F.lit(-1).cast("long").alias("at"), F.lit(0).alias("n"), encoded(F.when(latin, head).otherwise(F.concat(F.lit("\ufeff"), head)))).distinct()

    def write(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def runs():
            """(name, lines, their bytes) of neighbours in a batch."""
            for b in batches:
                at, ends = 0, pc.run_end_encode(b.column(0))
                for name, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                    lines = b.column(1).slice(at, end - at)
                    _, offsets, data = lines.buffers()
                    width = 8 if pa.types.is_large_binary(lines.type) else 4
                    first, last = (int.from_bytes(offsets[width * i:width * (i + 1)], "little") for i in (lines.offset, lines.offset + len(lines)))
                    yield name, end - at, data[first:last]
                    at = end

        done = []
        for name, parts in groupby(runs(), key=lambda r: r[0]):
            rows = 0
            escaped = "".join(CSV_ESCAPED.get(c, c) for c in name)
            with new_file(f"{out_dir}/path={quote(escaped)}") as out:  # a URI
                for _, n, data in parts:
                    out.write(data)
                    rows += n
            done.append((name, rows))
        if done:
            yield pa.RecordBatch.from_pydict({"file": [f for f, _ in done], "rows": pa.array([r for _, r in done], pa.int64())})

    ordered = lines.unionByName(heads).repartition("path").sortWithinPartitions("path", "at", "n")
    return cut_lineage(ordered.select("path", "line").mapInArrow(write, "file string, rows long"), "csv-files")


def xlsx_ledger_files(spark: SparkSession, sf_dir: str, out_dir: str) -> DataFrame:
    """Write ledger workbooks derived from lineitem into ``out_dir`` (a
    shared folder): one per (flag, status, block of CSV_BLOCK
    orders), each with a 'NOTES' sheet and a 'MOUVEMENT' sheet (title row,
    header row, one row per line).  A task builds the workbooks it holds one
    after the other, each from its bounded block of rows.  Returns (file,
    rows) per workbook."""
    from itertools import groupby

    from ledgerlens.operators.sinks import put_file, workbook_bytes
    from ledgerlens.session import cut_lineage, ship_package
    ship_package(spark)
    li = read_table(spark, sf_dir, "lineitem")
    block = (F.col("l_orderkey") / CSV_BLOCK).cast("long")
    name = F.concat(F.lit("xlsx_"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit("_"),
                    block.cast("string"), F.lit(".xlsx"))
    rows = li.select(name.alias("file"), "l_orderkey", "l_linenumber",
                     F.date_format(F.col("l_shipdate").cast("date"), "d/M/yyyy").alias("d"),
                     F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("q"))

    def write(batches):
        import pyarrow as pa

        lines = (line for b in batches for line in zip(*[c.to_pylist() for c in b.columns]))
        done = []
        for fn, group in groupby(lines, key=lambda line: line[0]):
            body = [line[1:] for line in group]
            sheets = [("NOTES", [["fichier", fn]]),
                      ("MOUVEMENT", [["Suivi des mouvements"], ["Date", "REFERENCE", "STOCK"]] + body)]
            put_file(f"{out_dir}/{fn}", workbook_bytes(sheets))
            done.append((fn, len(body)))
        if done:
            yield pa.RecordBatch.from_pydict({"file": pa.array([f for f, _ in done], pa.string()), "rows": pa.array([n for _, n in done], pa.int64())})

    ordered = rows.repartition("file").sortWithinPartitions("file", F.col("l_orderkey").asc_nulls_last(), F.col("l_linenumber").asc_nulls_last())
    written = ordered.select("file", "d", F.col("l_orderkey").cast("string"), "q").mapInArrow(write, "file string, rows long")
    return cut_lineage(written, "xlsx-files")
