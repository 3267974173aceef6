"""Result sinks: CSV per atelier / view, Markdown report files, XLSX slices.

Writers partition the output by (unit, atelier, status) directories; empty
groups simply produce no directory.  CSV files quote with doubled quotes and
begin with a UTF-8 byte-order mark, by which spreadsheets know the encoding.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage, scratch_path


def fresh_output(spark, name: str) -> str:
    """A new folder under the shared checkpoint location."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


#: The mark is written as the begin of the header line, which every file has.
BOM = "\ufeff"


def write_csv(recon: DataFrame, path: str, parts: Sequence[str] = ("unit", "atelier", "status"), bom: bool = True) -> str:
    first = next(c for c in recon.columns if c not in parts)
    marked = recon.withColumnRenamed(first, BOM + first) if bom else recon
    (marked.write.mode("overwrite").partitionBy(*parts).option("header", True)
     .option("escape", '"').option("encoding", "UTF-8").csv(path))
    return path


def read_csv_results(spark, path: str) -> DataFrame:
    got = spark.read.option("header", True).option("escape", '"').option("basePath", path).csv(path)
    return got.toDF(*[c.removeprefix(BOM) for c in got.columns])


def write_report(lines: DataFrame, path: str, num_partitions: int | None = None) -> str:
    """Markdown report: range-partitioned by (unit, atelier, line_no) so a
    large atelier spreads over several ordered part files per unit folder."""
    n = num_partitions or lines.sparkSession.sparkContext.defaultParallelism
    ordered = (lines.repartitionByRange(n, "unit", F.col("atelier").asc_nulls_first(), "line_no")
               .sortWithinPartitions("unit", F.col("atelier").asc_nulls_first(), "line_no"))
    ordered.select("unit", "line").write.mode("overwrite").partitionBy("unit").text(path)
    return path


# --- XLSX (minimal SpreadsheetML written with the standard library) ----------

_CT = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
       '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
       '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
       '<Default Extension="xml" ContentType="application/xml"/>'
       '<Override PartName="/xl/workbook.xml" '
       'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
       '<Override PartName="/xl/worksheets/sheet1.xml" '
       'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
         '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
         '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/'
         'officeDocument" Target="xl/workbook.xml"/></Relationships>')
_WB = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
       '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
       'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
       '<sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
_WB_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/'
            'worksheet" Target="worksheets/sheet1.xml"/></Relationships>')


def _py(v):
    """numpy scalars -> Python values for the cell writer."""
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v != v:
        return None
    return v


def _xml_escape(s: str) -> str:
    return (s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;"))


def xlsx_bytes(columns: Sequence[str], rows, sheet_name: str = "Sheet1") -> bytes:
    """One-sheet workbook: numbers as numeric cells, other values inline text."""
    return workbook_bytes([(sheet_name, [list(columns)] + [list(r) for r in rows])])


def workbook_bytes(sheets) -> bytes:
    """Workbook from ``[(sheet_name, rows)]``; a row is a list of cell values
    (None leaves the cell empty)."""
    import io
    import zipfile

    def col_letter(i: int) -> str:
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    letters: list[str] = []

    def row_xml(n: int, values) -> str:
        while len(letters) < len(values):
            letters.append(col_letter(len(letters)))
        cs = [f'<row r="{n}">']
        for at, v in zip(letters, values):
            if v is None:
                continue
            if isinstance(v, str):
                if "&" in v or "<" in v or ">" in v or '"' in v:
                    v = _xml_escape(v)
                cs.append(f'<c r="{at}{n}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>')
            elif isinstance(v, bool):
                cs.append(f'<c r="{at}{n}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cs.append(f'<c r="{at}{n}"><v>{v!r}</v></c>')
            else:
                cs.append(f'<c r="{at}{n}" t="inlineStr"><is><t xml:space="preserve">{_xml_escape(str(v))}</t></is></c>')
        cs.append("</row>")
        return "".join(cs)

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        overrides = "".join(
            f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/'
            'vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        z.writestr("[Content_Types].xml", _CT.replace("</Types>", "").split('<Override PartName="/xl/worksheets')[0]
                   + overrides + "</Types>")
        z.writestr("_rels/.rels", _RELS)
        sheet_els = "".join(f'<sheet name="{_xml_escape(str(n)[:31])}" sheetId="{i + 1}" r:id="rId{i + 1}"/>'
                            for i, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", _WB.replace('<sheet name="{name}" sheetId="1" r:id="rId1"/>', sheet_els))
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/'
                       f'2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
                       for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", _WB_RELS.split("<Relationship ")[0] + rels + "</Relationships>")
        for i, (_, rows) in enumerate(sheets):
            body = "".join(row_xml(n + 1, r) for n, r in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml",
                       '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                       '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
                       + body + "</sheetData></worksheet>")
    return buf.getvalue()


@contextmanager
def new_file(path: str):
    """A stream to a file of any file system pyarrow knows: under a name of
    its own first, then moved, so a retried task replaces the file of its
    forerunner and nothing half-written is ever read."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path if ":/" in path else "file://" + path)
    folder = name.rpartition("/")[0]
    where.create_dir(folder, recursive=True)
    draft = f"{folder}/_{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as out:
        yield out
    where.move(draft, name)


def put_file(path: str, data: bytes) -> None:
    """Write a file whole (``new_file``)."""
    with new_file(path) as out:
        out.write(data)


def write_xlsx(recon: DataFrame, path: str, parts: Sequence[str] = ("unit", "atelier", "status"),
               num_partitions: int | None = None) -> DataFrame:
    """One workbook per (group, task slice): rows are range-partitioned on
    (group, Ref), each task writes the slices it holds.  No group is ever
    gathered into a single task.  Files are named by group, partition and
    batch, so a retried task writes the same names again.  Returns (file,
    rows) per written file, computed once."""
    import pandas as pd

    from ledgerlens.session import ship_package
    ship_package(recon.sparkSession)
    n = num_partitions or recon.sparkSession.sparkContext.defaultParallelism
    cols = [c for c in recon.columns if c not in parts]

    def run(it):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        out = []
        for turn, pdf in enumerate(it):
            for key, g in pdf.groupby(list(parts), sort=True, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                name = "__".join(str(k) for k in key).replace("/", "_")
                fn = f"{path}/{name}__part{pid:05d}_{turn:04d}.xlsx"
                put_file(fn, xlsx_bytes(cols, [tuple(_py(v) for v in r) for r in
                                               g[cols].itertuples(index=False, name=None)], str(key[-1])))
                out.append((fn, len(g)))
        yield pd.DataFrame(out, columns=["file", "rows"])

    ordered = recon.repartitionByRange(n, *parts, "Ref").sortWithinPartitions(*parts, "Ref")
    return cut_lineage(ordered.mapInPandas(run, "file string, rows long"), "xlsx-written")
