"""CSV ledgers as sheet grids, with encoding and delimiter detection, for
files of any size.

Files are read by Spark's text source, which cuts a large file into byte
ranges ("blocks") and gives their physical lines as raw bytes; a file is never
one row of one task.  What needs the whole file is put together from the
blocks:

* encoding: valid UTF-8 in every line (a byte-order mark is dropped),
  otherwise Windows code page 1252 (Latin-1 decode plus the 0x80-0x9F remap
  below);
* delimiter: the candidate for which most lines have as many fields as the
  first line, if these are at least two; where the first line is a title, the
  candidate whose most frequent number of fields explains most delimiters;
  ties go to the larger number of fields, then to the earlier candidate; with
  none the comma is used;
* records: a quote opens a field at the field's start only, anywhere else it
  is text.  Every line is a function from the state before it (outside or
  inside a quoted field) to the state behind it.  The functions are composed
  along each block, then along the blocks of a file, which gives every line
  the state it starts in; all lines are then cut in parallel, and the lines of
  one record are put together;
* rows: non-blank records, numbered densely from 0 (blank lines do not
  count); line breaks inside quotes are part of their field, as ``\\n``;
* fields: split on the delimiter outside quotes, quotes removed, doubled
  quotes unescaped, empty fields NULL;
* a quoted field that the file never closes: from its line on, every line is a
  record of its own, whose open quote ends with the line; the file gets a note
  (a marker row at sheet position ``NOTED``).

Everything is built-in expressions.  A physical line, and a record of several
lines, must fit a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import checked_broadcast, cut_lineage

# Candidate delimiters in preference order.
SEPARATORS = [";", ",", "\t", "|"]
#: Sheet position of the marker row of a file that was read with a note.
NOTED = -2

# Code page 1252 differs from Latin-1 only in 0x80-0x9F; derive that block
# from Python's codec (undefined bytes become U+FFFD as with errors='replace').
_CP1252_HIGH = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")
_LATIN1_HIGH = bytes(range(0x80, 0xA0)).decode("latin-1")

# Quoted field without its closing quote, and a whole field, for a delimiter
# class D.  Possessive, so that a line of any length is read once.
_OPEN = r'"[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:{_OPEN}"[^D]*+|[^"D][^D]*+|)'
_STAYS_OPEN = rf'^{_FIELD}(?:D{_FIELD})*+{_OPEN}\z'
_STILL_OPEN = rf'^[^"]*+(?:""[^"]*+)*+(?:\z|"[^D]*+(?:D{_FIELD})*+{_OPEN}\z)'
_CUT = rf'D({_OPEN}(?:"[^D]*+)?+|[^"D][^D]*+|)'
_QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)(?:"(.*))?\z'


def _pattern(template: str, sep: str) -> str:
    d = {"|": r"\|", "\t": r"\t"}.get(sep, sep)
    return template.replace("[^D]", f"[^{d}]").replace('[^"D]', f'[^"{d}]').replace("D", d)


def _by_sep(build, sep: Column) -> Column:
    """``build(separator)`` for the separator of the row."""
    return reduce(lambda otherwise, s: F.when(sep == s, build(s)).otherwise(otherwise), reversed(SEPARATORS[:-1]), build(SEPARATORS[-1]))


def read_lines(spark: SparkSession, paths, names: str = "*.[cC][sS][vV]") -> DataFrame:
    """(file_id, block, id, raw): the physical lines of the files among
    ``paths`` with such names; (block, id) is their order in the file."""
    text = spark.read.option("pathGlobFilter", names).text(paths)
    # the path as the other sources give it, without URL escapes; per line, so
    # without a regex
    path = F.col("_metadata.file_path")
    path = F.when(F.instr(path, "%") > 0, F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    local = F.concat(F.lit("/"), F.ltrim(F.substr(path, F.lit(len("file:/") + 1)), F.lit("/")))
    return text.select(F.when(F.startswith(path, F.lit("file:/")), local).otherwise(path).alias("file_id"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("raw"))


def lines_of(files: DataFrame) -> DataFrame:
    """The same of small files given as ``(path, content BINARY)``."""
    chars = F.decode("content", "ISO-8859-1")
    return files.select(F.col("path").alias("file_id"), F.posexplode(F.split(chars, "\r\n|\r|\n")).alias("id", "chars")).select(
        "file_id", F.lit(0).cast("long").alias("block"), F.col("id").cast("long").alias("id"), F.encode("chars", "ISO-8859-1").alias("raw"))


def _latin(raw: Column) -> Column:
    return F.translate(F.decode(raw, "ISO-8859-1"), _LATIN1_HIGH, _CP1252_HIGH)


def _without(mark: str, text: Column) -> Column:
    return F.when(F.startswith(text, F.lit(mark)), F.substr(text, F.lit(len(mark) + 1))).otherwise(text)


def decoded(lines: DataFrame) -> DataFrame:
    """``lines`` with ``text`` in place of the bytes, written once.  A line is
    written as its own bytes decode; in a file with other lines that are no
    UTF-8, those that are by chance are turned when they are read (most are
    ASCII, the same in both)."""
    plain = F.col("raw").cast("string")
    text = F.when(F.col("utf8"), _without("\ufeff", plain)).otherwise(_without("ï»¿", _latin(F.col("raw"))))
    own = cut_lineage(lines.withColumn("utf8", F.is_valid_utf8(plain)).select("file_id", "block", "id", "utf8", text.alias("text")), "csv-raw")
    other = checked_broadcast(own.where("not utf8").select("file_id").distinct(), "csv-encodings").withColumn("as_latin", F.lit(True))
    turned = F.col("as_latin") & F.col("utf8") & (F.octet_length("text") != F.length("text"))
    return own.join(other, "file_id", "left").select(
        "file_id", "block", "id", F.when(turned, _latin(F.encode("text", "UTF-8"))).otherwise(F.col("text")).alias("text"))


def sniff(text: DataFrame) -> DataFrame:
    """(file_id, sep) of decoded lines: one hash aggregate over all of them,
    by block and by the widths under every candidate; its first row of a file
    is the one with the file's first line."""
    def width(s: str) -> Column:
        plain = F.octet_length("text") - F.octet_length(F.replace("text", F.lit(s), F.lit("")))
        quoted = F.regexp_count(F.concat(F.lit(s), F.col("text")), F.lit(_pattern(_CUT, s))) - 1
        return F.when((plain > 0) & (F.instr("text", '"') > 0), quoted).otherwise(plain) + 1

    names = [f"w{i}" for i in range(len(SEPARATORS))]
    widths = text.where(F.trim("text") != "").select("file_id", "block", "id", *[width(s).cast("long").alias(w) for w, s in zip(names, SEPARATORS)])
    widths = cut_lineage(widths.groupBy("file_id", "block", *names).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")), "csv-widths")
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.col(w).alias("width")) for i, w in enumerate(names)])).alias("t")
    fits = widths.select("file_id", "n", tries).groupBy("file_id", "t").agg(F.sum("n").alias("n")).where("t.width > 1")
    first = widths.groupBy("file_id").agg(F.min_by(F.struct(*names), F.struct("block", "id")).alias("w"))
    heads = first.select("file_id", "w.*").select("file_id", tries, F.lit(True).alias("head"))
    score = F.struct(F.when(F.col("head"), F.col("n")).otherwise(0), F.col("n") * (F.col("t.width") - 1), "t.width", -F.col("t.turn"))
    best = fits.join(heads, ["file_id", "t"], "left").groupBy("file_id").agg(F.max_by("t.turn", score).alias("turn"))
    seps = F.array(*[F.lit(s) for s in SEPARATORS])
    return widths.select("file_id").distinct().join(best, "file_id", "left").select("file_id", F.coalesce(F.get(seps, F.col("turn")), F.lit(",")).alias("sep"))


def _before(value: Column, w) -> Column:
    return value.over(w.rowsBetween(Window.unboundedPreceding, -1))


def _by_line():
    return Window.partitionBy("file_id", "block").orderBy("id")


def _by_block():
    return Window.partitionBy("file_id").orderBy("block")  # a row per block of a file


def _odd(c: Column) -> Column:
    return c % 2 == 1


def _states(lines: DataFrame) -> DataFrame:
    """``lines`` with ``turns`` and ``known``: the state before a line is the
    last state that does not depend on what was before it (``known``), turned
    round by every swap (``turns`` of them so far in the block)."""
    turns = lines.withColumn("turns", F.coalesce(_before(F.sum(F.when(F.col("out") & ~F.col("in"), 1).otherwise(0)), _by_line()), F.lit(0)))
    sure = F.when(F.col("out") == F.col("in"), F.col("out") != _odd(F.col("turns")))
    return turns.withColumn("sure", sure).withColumn("known", _before(F.last("sure", ignorenulls=True), _by_line()))


def _entries(lines: DataFrame) -> DataFrame:
    """(file_id, block, entry) of the files of several blocks: is the begin of
    the block inside quotes.  Only lines that are not left in the state they
    are entered in count."""
    several = checked_broadcast(lines.where("block > 0").select("file_id").distinct(), "csv-several")
    here = lines.join(several, "file_id", "left_semi")
    scan = _states(here.where("out or not in").select("file_id", "block", "id", "out", "in"))
    blocks = scan.groupBy("file_id", "block").agg(F.max(F.when(F.col("sure").isNotNull(), F.struct("id", "sure"))).alias("last"),
                                                  (F.sum(F.when(F.col("out") & ~F.col("in"), 1).otherwise(0)) % 2).alias("swap"))
    blocks = here.select("file_id", "block").distinct().join(blocks, ["file_id", "block"], "left").withColumn("swap", F.coalesce("swap", F.lit(0)))
    blocks = blocks.withColumn("swaps", F.when(F.col("last").isNull(), F.col("swap")).otherwise(0))
    blocks = blocks.withColumn("turns", F.coalesce(_before(F.sum("swaps"), _by_block()), F.lit(0)))
    blocks = blocks.withColumn("sure", F.when(F.col("last").isNotNull(), F.struct(
        "block", (F.col("last.sure") != _odd(F.col("swap"))).alias("exit"), "turns")))
    blocks = blocks.withColumn("known", _before(F.max("sure"), _by_block()))
    entry = F.coalesce(F.col("known.exit") != _odd(F.col("turns") - F.col("known.turns")), _odd(F.col("turns")))
    return checked_broadcast(blocks.select("file_id", "block", entry.alias("entry")), "csv-entries")


def records(text: DataFrame, seps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, row_idx, sep, record) of decoded lines, and (file_id, block,
    id) of the line that opens a field the file never closes.

    The lines are shuffled once, by block: their states and their row numbers
    in the block come from the same sorted rows."""
    quotes = F.instr("text", '"') > 0

    def ends(template: str, otherwise: bool) -> Column:
        return F.when(quotes, _by_sep(lambda s: F.rlike("text", F.lit(_pattern(template, s))), F.col("sep"))).otherwise(otherwise)

    # out / in: is the end of the line inside quotes, if its start is outside / inside
    lines = text.join(seps, "file_id").withColumn("out", ends(_STAYS_OPEN, False)).withColumn("in", ends(_STILL_OPEN, True))
    filled = F.trim("text") != ""
    upto = _by_line().rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce("known", F.coalesce("entry", F.lit(False))) != _odd(F.col("turns"))
    cut = _states(lines).join(_entries(lines), ["file_id", "block"], "left").withColumn("inside", state)
    cut = cut.withColumn("open", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")))
    # n: rows so far in the block; m: lines so far that are not blank
    row = ~F.col("inside") & (F.col("open") | filled)
    cut = cut.select("file_id", "block", "id", "sep", "text", "inside", "open", F.sum(row.cast("long")).over(upto).alias("n"),
                     F.sum(filled.cast("long")).over(upto).alias("m"))
    cut = cut_lineage(cut, "csv-cut")
    outside = lambda c: F.max(F.when(~F.col("inside"), F.col(c)))
    blocks = cut.groupBy("file_id", "block").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max_by("open", "id").alias("open"), outside("id").alias("head"),
                                                 outside("n").alias("head_n"), outside("m").alias("head_m"))
    blocks = cut_lineage(blocks, "csv-blocks")
    # a file that ends inside quotes: the line that opened them, and all behind it, stand alone
    last = blocks.groupBy("file_id").agg(F.max_by("open", "block").alias("open"), F.max(F.when(F.col("head").isNotNull(), F.struct(
        F.col("block").alias("head_block"), "head", "head_n", "head_m"))).alias("head"))
    never = checked_broadcast(last.where("open").select("file_id", "head.*"), "csv-unclosed")
    known = blocks.select("file_id", "block", "n", "m").join(never, "file_id", "left")
    alone = (F.when(F.col("block") == F.col("head_block"), F.col("head_n") + F.col("m") - F.col("head_m"))
             .when(F.col("block") > F.col("head_block"), F.col("m")))
    first = F.coalesce(_before(F.sum(F.coalesce(alone, F.col("n"))), _by_block()), F.lit(0))
    offsets = checked_broadcast(known.select("file_id", "block", first.alias("first"), "head_block", "head", "head_n", "head_m"), "csv-offsets")
    here = cut.join(offsets, ["file_id", "block"])
    apart = F.when(F.col("head_block").isNotNull(), F.struct("block", "id") >= F.struct("head_block", "head")).otherwise(False)
    here = here.withColumn("row_idx", F.col("first") + F.when(apart, alone).otherwise(F.col("n")) - 1)
    here = here.withColumn("joined", (F.col("inside") | F.col("open")) & ~apart)
    single = here.where(~F.col("joined") & filled).select("file_id", "row_idx", "sep", F.col("text").alias("record"))
    # a line inside quotes has the number of the record it belongs to
    several = here.where("joined").groupBy("file_id", "row_idx", "sep").agg(
        F.sort_array(F.collect_list(F.struct("block", "id", "text"))).alias("parts"))
    whole = several.select("file_id", "row_idx", "sep", F.array_join("parts.text", "\n").alias("record"))
    return single.union(whole), never.select("file_id", F.col("head_block").alias("block"), F.col("head").alias("id"))


def _fields(record: Column, sep: Column) -> Column:
    """The fields of a record; empty ones NULL."""
    def bare(x: Column) -> Column:
        x = F.when(F.startswith(x, F.lit('"')), F.concat(
            F.replace(F.regexp_extract(x, _QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, _QUOTED, 2))).otherwise(x)
        return F.when(x != "", x)

    # every field begins with a delimiter then, so none is an empty match
    quoted = _by_sep(lambda s: F.regexp_extract_all(F.concat(F.lit(s), record), F.lit(_pattern(_CUT, s)), 1), sep)
    plain = _by_sep(lambda s: F.split(record, r"\|" if s == "|" else s, -1), sep)
    return F.when(F.instr(record, '"') > 0, F.transform(quoted, bare)).otherwise(F.transform(plain, lambda x: F.when(x != "", x)))


def read_csv_grid(spark: SparkSession, paths) -> DataFrame:
    """Grid rows ``(file_id, sheet_pos, sheet, row_idx, cells)`` of CSV files;
    ``sheet`` is 'CSV' (a CSV file is a one-sheet workbook)."""
    return csv_grid(read_lines(spark, paths)).where("sheet_pos >= 0")


def csv_grid(lines: DataFrame, seps: DataFrame | None = None) -> DataFrame:
    """Grid and marker rows of physical lines (``read_lines``, ``lines_of``);
    ``seps``: the delimiters, where a caller has decoded lines and knows them."""
    text = decoded(lines) if seps is None else lines
    seps = checked_broadcast(sniff(text), "csv-separators") if seps is None else seps
    rows, never = records(text, seps)
    grid = rows.select("file_id", F.lit(0).alias("sheet_pos"), F.lit("CSV").alias("sheet"),
                       F.col("row_idx").cast("bigint").alias("row_idx"), _fields(F.col("record"), F.col("sep")).alias("cells"))
    notes = never.select("file_id", F.lit(NOTED).alias("sheet_pos"), F.lit("").alias("sheet"), F.lit(-1).cast("bigint").alias("row_idx"),
                         F.array(F.lit("a quoted field is never closed; from its line on every line is a row")).alias("cells"))
    return grid.union(notes)
