"""Spreadsheet workbooks as sheet grids.

Files come through Spark's ``binaryFile`` source, so any file system Spark
reads will do and small files share a partition; a workbook is parsed inside
its task with the standard library (zip + streaming XML) and leaves as Arrow
batches of ``(file_id, sheet_pos, sheet, row_idx, cells)``, one row per sheet
row with at least one cell.  ``file_id`` is the full path.

Cell values as a spreadsheet reader sees them: shared / inline strings,
numbers in the shortest form of their double (``1.1``, ``10``), cells with a
date format as ISO text, booleans as TRUE / FALSE.  A workbook that cannot be
read yields one marker row (sheet position ``UNREADABLE``, its message in
``cells``) instead of failing the job.
"""

from __future__ import annotations

import datetime
import io
import re
import sys
import zipfile
from xml.etree.ElementTree import ParseError, iterparse
from xml.parsers import expat

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_DDL = "file_id string, sheet_pos int, sheet string, row_idx bigint, cells array<string>"
#: Sheet position of the marker row of a file that could not be read.
UNREADABLE = -1
BATCH_ROWS = 4096
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RNS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PNS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_REF = re.compile(r"([A-Z]+)(\d+)")
# Built-in number formats that show a date or time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_EPOCHS = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{_NS}t"))


def _date_styles(z: zipfile.ZipFile, names: set) -> set[int]:
    """Cell styles whose number format shows a date."""
    if "xl/styles.xml" not in names:
        return set()
    custom, styles, inside = {}, [], False
    with z.open("xl/styles.xml") as f:
        for event, el in iterparse(f, events=("start", "end")):
            if el.tag == f"{_NS}cellXfs":
                inside = event == "start"
            elif event == "end" and el.tag == f"{_NS}numFmt":
                # what stands in quotes, brackets or behind a backslash is text
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", el.get("formatCode", ""))
                custom[int(el.get("numFmtId"))] = bool(re.search("[dmyhs]", code, re.I)) and "General" not in code
            elif event == "end" and inside and el.tag == f"{_NS}xf":
                styles.append(int(el.get("numFmtId", 0)))
    return {i for i, k in enumerate(styles) if k in _DATE_FORMATS or custom.get(k)}


def _number(text: str) -> str:
    """Shortest text of a stored number; what is no number stays as it is."""
    try:
        x = float(text)
    except ValueError:
        return text
    if x != x or x in (float("inf"), float("-inf")):
        return text
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _date(text: str, epoch: datetime.datetime) -> str:
    try:
        d = epoch + datetime.timedelta(milliseconds=round(float(text) * 86_400_000))
    except (ValueError, OverflowError):
        return _number(text)
    return d.strftime("%Y-%m-%d" if d.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")


# Rows as nearly every writer writes them: a pattern takes them, any other row
# goes through the XML parser.
_TEXT = r"[^<>&\x00-\x1f\ufffe\uffff]*+"
_CELL = rf'<c r="([A-Z]+)[0-9]+"(?: s="([0-9]+)")?(?: t="([A-Za-z]+)")?>(?:<v>({_TEXT})</v>|<is><t(?: xml:space="preserve")?>({_TEXT})</t></is>)</c>'
_CELLS = re.compile(_CELL)
_ROW = re.compile(r'<row r="([0-9]+)"(?: spans="[0-9:]+")?>((?:' + re.sub(r"\((?!\?)", "(?:", _CELL) + r")++)</row>")
_DATA = "<sheetData>"
#: Bytes of a sheet read at once, and most without the end of a row.
_CHUNK, _LONGEST = 1 << 17, 1 << 22


def _plain_utf8(data: bytes, first: bool) -> str | None:
    """The text of a piece of XML in which every tag is one: UTF-8, without
    comments, CDATA, declarations or processing instructions."""
    if b"<!" in data or data.find(b"<?", 1 if first else 0) >= 0 or first and not re.match(
            rb"(?:\xef\xbb\xbf)?(?:<\?xml version=.1\.0.(?: encoding=.(?:UTF|utf)-8.)?(?: standalone=.\w+.)?\s*\?>)?\s*<\w", data):
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _sheet_rows(f, shared: list, dates: set, epoch: datetime.datetime):
    """Yield (row_idx, cells) for every row of a sheet's XML with a value.

    The parser's events are taken as they come, without a tree: of a cell its
    ``v`` (a direct child, the text before any other element) and the texts of
    its ``t`` elements.  Rows that ``_ROW`` takes reach the parser as blanks, so
    it still checks the whole sheet and names the right place of an error."""
    rows, columns, defaults = [], {}, []
    row, cells = None, {}          # the row's number as given; its values
    idx, kind, style = None, None, None
    depth = at_cell = at_data = 0  # open elements; those around the cell, the rows
    value = texts = None           # text of the first v; texts of all t
    taking = None                  # the list that takes characters now
    row_tag, cell_tag, v_tag, t_tag, data_tag = (f"{_NS[1:-1]} {x}" for x in ("row", "c", "v", "t", "sheetData"))

    def column(letters):
        if letters not in columns:
            columns[letters] = _col_index(letters)
        return columns[letters]

    def cell_value(kind, style, text, inline):
        if kind == "inlineStr":
            return inline
        if not text:
            return None
        if kind == "s":
            return shared[int(text)]
        if kind == "b":
            return "TRUE" if text == "1" else "FALSE"
        if kind in (None, "", "n"):
            return _date(text, epoch) if dates and int(style or 0) in dates else _number(text)
        return text

    def put_row(number):
        if cells:
            width = max(cells) + 1
            values = list(cells.values()) if [*cells] == [*range(width)] else [cells.get(i) for i in range(width)]
            rows.append((int(number) - 1, values))
            cells.clear()

    def start(tag, attrs):
        nonlocal row, idx, kind, style, depth, at_cell, at_data, value, texts, taking
        depth += 1
        taking = None
        if tag == cell_tag:
            m = _REF.match(attrs.get("r", ""))
            idx, kind, style = column(m.group(1)) if m else None, attrs.get("t"), attrs.get("s")
            at_cell, value, texts = depth, None, []
        elif tag == t_tag:
            if at_cell and kind == "inlineStr":
                taking = texts
        elif tag == v_tag:
            if at_cell and value is None and depth == at_cell + 1:
                taking = value = []
        elif tag == row_tag:
            row = attrs.get("r")
            cells.clear()
        elif tag == data_tag:
            at_data = depth

    def end(tag):
        nonlocal depth, at_cell, taking
        taking = None
        depth -= 1
        if tag == cell_tag:
            at_cell = 0
            val = cell_value(kind, style, "".join(value or ()), "".join(texts))
            if val is not None and val != "":
                cells[len(cells) if idx is None else idx] = val
        elif tag == row_tag:
            put_row(row)

    def characters(data):
        if taking is not None:
            taking.append(data)

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.StartNamespaceDeclHandler = lambda prefix, uri: defaults.append(uri) if prefix is None else None

    def take(text):
        """Rows of a text that ends with a row."""
        at, blanks = 0, 0
        for m in _ROW.finditer(text):
            gap = text[at:m.start()]
            if gap:
                parser.Parse((" " * blanks + gap).encode("utf-8"), False)
                blanks = 0
            at = m.end()
            if (gap and gap.strip() and not gap.endswith(_DATA)) or depth != at_data or defaults != [_NS[1:-1]]:
                parser.Parse((" " * blanks + m.group()).encode("utf-8"), False)
                blanks = 0
                continue
            blanks += at - m.start()
            for letters, styled, typed, text_v, text_t in _CELLS.findall(m.group(2)):
                val = cell_value(typed, styled, text_v, text_t)
                if val is not None and val != "":
                    cells[column(letters)] = val
            put_row(m.group(1))
        parser.Parse((" " * blanks + text[at:]).encode("utf-8"), False)

    plain, first, rest, last = True, True, b"", False
    while not last:
        chunk = f.read(_CHUNK)
        last, wrong = not chunk, None
        data = rest + chunk
        cut = data.rfind(b"</row>") + len(b"</row>") if plain and not last else len(data)
        if plain and cut < len(b"</row>") + 1 and not last and len(data) < _LONGEST:
            rest = data
            continue
        if cut < len(b"</row>") + 1:  # no end of a row: not cut between tags
            cut, plain = len(data), False
        data, rest = data[:cut], data[cut:]
        text = _plain_utf8(data, first) if plain and data else None
        plain, first = text is not None, False
        try:
            if plain and not last:
                take(text)
            else:
                parser.Parse(data, False)
            if last:
                parser.Parse(b"", True)
        except expat.ExpatError as e:
            wrong = ParseError(str(e))
        except Exception as e:  # noqa: BLE001 - of a cell; the rows before it come first
            wrong = e
        yield from rows
        rows.clear()
        if wrong is not None:
            raise wrong


def read_workbook(source):
    """Yield (sheet_pos, sheet, row_idx, cells) for every non-empty row of a
    workbook (a path or a binary file object)."""
    with zipfile.ZipFile(source) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, el in iterparse(f):
                    if el.tag == f"{_NS}si":
                        shared.append(_text(el))
                        el.clear()
        dates = _date_styles(z, names)
        rels = {}
        with z.open("xl/_rels/workbook.xml.rels") as f:
            for _, el in iterparse(f):
                if el.tag == f"{_PNS}Relationship":
                    t = el.get("Target")
                    rels[el.get("Id")] = t.lstrip("/") if t.startswith("/") else "xl/" + t
        sheets, epoch = [], _EPOCHS[False]
        with z.open("xl/workbook.xml") as f:
            for _, el in iterparse(f):
                if el.tag == f"{_NS}sheet":
                    sheets.append((el.get("name"), rels.get(el.get(f"{_RNS}id"))))
                elif el.tag == f"{_NS}workbookPr":
                    epoch = _EPOCHS[el.get("date1904") in ("1", "true")]
        for pos, (name, target) in enumerate(sheets):
            if target not in names:
                continue
            with z.open(target) as f:
                for row_idx, cells in _sheet_rows(f, shared, dates, epoch):
                    yield pos, name, row_idx, cells


def local_path(path: Column) -> Column:
    """A path without the ``file:`` scheme, as inputs may name it either way."""
    return F.regexp_replace(path, "^file:/+", "/")


def parse_workbooks(files: DataFrame) -> DataFrame:
    """Grid rows of ``files(path, content)``."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("file_id", pa.string()), ("sheet_pos", pa.int32()), ("sheet", pa.string()),
                            ("row_idx", pa.int64()), ("cells", pa.list_(pa.string()))])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows, name = [], path.as_py()
                try:
                    for row in read_workbook(io.BytesIO(content.as_py() or b"")):
                        rows.append((name, *row))
                        if len(rows) >= BATCH_ROWS:
                            yield batch(rows)
                            rows = []
                except Exception as e:  # noqa: BLE001 - whatever a damaged file raises becomes data
                    rows.append((name, UNREADABLE, "", -1, [f"{type(e).__name__}: {e}"]))
                if rows:
                    yield batch(rows)

    return files.select(local_path(F.col("path")).alias("path"), "content").mapInArrow(run, GRID_DDL)


def read_xlsx_grid(spark: SparkSession, paths, names: str | None = None) -> DataFrame:
    """Grid of every workbook among ``paths`` (a path or pattern, or a list);
    ``names``: only files of such names.  A folder with ``names`` is listed at
    once, a pattern of files one file after the other."""
    files = spark.read.format("binaryFile")
    if names is not None:
        files = files.option("pathGlobFilter", names)
    return parse_workbooks(files.load(paths).select("path", "content"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
