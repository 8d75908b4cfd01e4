"""Readers: CSV, fixed-width, spreadsheet, Parquet, database files and SQL connections, all as text or typed DataFrames.

CSV, fixed-width and Parquet files are read by Spark's tasks, a CSV file in splits unless one of its records spans lines; rows are
numbered by the sizes of the splits before them. Sections of a CSV file and spreadsheets only make sense in file order; these
documents are laid out on the driver. A database file is one process' file: the driver streams it in bounded batches.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections import Counter
from datetime import datetime, timedelta
from itertools import count
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.errors import AnalysisError, RunError
from ledgerloom.plans.scratch import Scratch, numbered, numbered_in_files

HEAD = 1 << 20
#: Rows of a database file in memory at once.
BATCH = 200_000


def header_names(cells: list[str | None]) -> list[str]:
    """Runs of blanks become one; a blank name is column_<i>; repeats get _2, _3, skipping names the header has elsewhere."""
    names = [" ".join((c or "").split()) or f"column_{i}" for i, c in enumerate(cells, 1)]
    met: Counter = Counter()
    every = {n.lower() for n in names}
    for i, name in enumerate(names):
        met[name.lower()] += 1
        if met[name.lower()] > 1:
            names[i] = next(x for k in count(met[name.lower()]) if (x := f"{name}_{k}").lower() not in every)
            every.add(names[i].lower())
    return names


def split_line_fields(text: str, delimiter: str) -> list[tuple[int, list[str]]]:
    """(line number, fields) of each record: a quote opens only at the start of a field, and a line end inside quotes is text."""
    out, fields, field, line, start = [], [], [], 1, 1
    i, n, quoted, opened = 0, len(text), False, False
    while i < n:
        ch = text[i]
        if quoted:
            if ch == '"' and i + 1 < n and text[i + 1] == '"':
                field.append('"')
                i += 1
            elif ch == '"':
                quoted = False
            else:
                line += ch == "\n"
                field.append(ch)
        elif ch == '"' and not field and not opened:
            quoted = opened = True
        elif ch == delimiter:
            fields.append("".join(field))
            field, opened = [], False
        elif ch in "\r\n":
            if ch == "\r" and i + 1 < n and text[i + 1] == "\n":
                i += 1
            out.append((start, [*fields, "".join(field)]))
            fields, field, opened = [], [], False
            line += 1
            start = line
        else:
            field.append(ch)
        i += 1
    if field or fields or opened:
        out.append((start, [*fields, "".join(field)]))
    return out


def guess_delimiter(text: str) -> str:
    """Of , ; tab | the one that gives the most lines of the first megabyte the same number (2 or more) of fields."""
    best, score = ",", -1
    for d in ",;\t|":
        widths = Counter(len(f) for _, f in split_line_fields(text[:HEAD], d) if any(x.strip() for x in f))
        top = max((n for w, n in widths.items() if w > 1), default=0)
        if top > score:
            best, score = d, top
    return best


def sections(records: list[tuple[int, list[str]]]) -> list[list[tuple[int, list[str]]]]:
    """Runs of non-blank records."""
    out: list[list] = [[]]
    for line, fields in records:
        if any(f.strip() for f in fields):
            out[-1].append((line, fields))
        elif out[-1]:
            out.append([])
    return [s for s in out if s]


def _rows(spark: SparkSession, names: list[str], rows: list[list], row_number: str | None) -> DataFrame:
    columns = ([row_number] if row_number else []) + names
    data = [([i + 1] if row_number else []) + r for i, r in enumerate(rows)]
    schema = T.StructType(([T.StructField(row_number, T.LongType())] if row_number else []) + [T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame(data, schema) if data else spark.createDataFrame([], schema).select(*columns)


def csv_section(spark: SparkSession, text: str, section: int | None = None, delimiter: str | None = None, header: bool = True, ragged: bool = False, row_number: str | None = None) -> DataFrame:
    """A table inside a file's text: the N-th run of non-blank lines, or all of it."""
    d = delimiter or guess_delimiter(text)
    records = split_line_fields(text, d)
    if section is not None:
        found = sections(records)
        if not 1 <= section <= len(found):
            raise RunError("L213", f"the file has {len(found)} sections")
        records = found[section - 1]
    else:
        records = [(n, f) for n, f in records if any(x.strip() for x in f)]
    if not records:
        raise RunError("L200", "the file has no table")
    width = len(records[0][1]) if header or not ragged else max(len(f) for _, f in records)
    names = header_names(records[0][1]) if header else [f"column_{i + 1}" for i in range(width)]
    body = records[1:] if header else records
    wrong = [n for n, f in body if len(f) > width or (len(f) < width and not ragged)]
    if wrong:
        raise RunError("L212", f"lines with another number of fields: {', '.join(map(str, wrong[:5]))}")
    return _rows(spark, names, [f + [None] * (width - len(f)) for _, f in body], row_number)


def _head(spark: SparkSession, path: str) -> str:
    """The file's first lines, a megabyte at least if it is that long."""
    n = 200
    while True:
        lines = [r[0] for r in spark.read.text(path).limit(n).collect()]
        text = "\n".join(lines)
        if len(lines) < n or len(text) >= HEAD:
            return text
        n *= 8


def ends_open(line: str, delimiter: str) -> bool:
    """Whether a line ends inside quotes, so that its record goes on in the next one."""
    if '"' not in line:
        return False
    i, n = 0, len(line)
    while i < n:
        if line[i] != '"':  # a quote opens at the start of a field only
            i = line.find(delimiter, i)
            if i < 0:
                return False
            i += 1
            continue
        i += 1
        while True:
            i = line.find('"', i)
            if i < 0:
                return True
            if line[i + 1 : i + 2] != '"':
                break
            i += 2
        i = line.find(delimiter, i + 1)
        if i < 0:
            return False
        i += 1
    return False


def _spans_lines(spark: SparkSession, path: str, delimiter: str) -> bool:
    """Whether some record of the file goes on in another line; lines are looked at in parallel."""

    def odd(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            quoted = batch.column(0).filter(pc.match_substring(batch.column(0), '"'))
            n = sum(ends_open(x, delimiter) for x in quoted.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return not spark.read.text(path).mapInArrow(odd, "n long").filter("n > 0").isEmpty()


def csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, section: int | None = None, ragged: bool = False, row_number: str | None = None) -> DataFrame:
    """All columns as text. A section needs the file's order and is read whole; else Spark splits the file among tasks, which number the
    rows, if asked to, by the sizes of the parts before them; several files of a folder follow each other by name. A file with a record of several lines is one task's work."""
    if section is not None:
        text = spark.read.text(path, wholetext=True).first()[0]
        return csv_section(spark, text.removeprefix("\ufeff"), section, delimiter, header, ragged, row_number)
    head = _head(spark, path).removeprefix("\ufeff")
    d = delimiter or guess_delimiter(head)
    first = next((f for _, f in split_line_fields(head, d) if any(x.strip() for x in f)), None)
    if first is None:
        raise RunError("L200", "the file has no table")
    names = header_names(first) if header else [f"column_{i + 1}" for i in range(len(first))]
    bad, ok, file, block = (next(f"{x}{k or ''}" for k in count() if f"{x}{k or ''}" not in {n.lower() for n in names}) for x in ("_bad", "_ok", "_file", "_block"))
    wanted = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(bad, T.StringType())])
    options = dict(sep=d, quote='"', escape='"', header=header, multiLine=_spans_lines(spark, path, d), mode="PERMISSIVE", columnNameOfCorruptRecord=bad, enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = spark.read.schema(wanted).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).csv(path)
    place = [file, block] if row_number else []
    if row_number:
        df = df.withColumns({c: df.metadataColumn("_metadata").getField(f) for c, f in ((file, "file_path"), (block, "file_block_start"))})
    has_text = F.exists(F.array(*[F.col(f"`{n}`") for n in names]), lambda c: c.rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"))
    short = F.col(f"`{names[-1]}`").isNull()  # a line of fewer fields leaves the last column empty, a longer one fills it
    wrong = F.col(bad).isNotNull() & (~short if ragged else F.lit(True)) & has_text
    checked = df.withColumn(ok, F.when(wrong, F.raise_error(F.lit("L212: a line has another number of fields"))).otherwise(F.coalesce(has_text, F.lit(False))))
    rows = checked.filter(F.col(ok)).select(*[F.col(f"`{n}`") for n in [*names, *place]])
    return numbered_in_files(Scratch(spark, "csv"), rows, file, block, row_number).select(row_number, *[F.col(f"`{n}`") for n in names]) if row_number else rows


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A literal path; integers are 64 bits wide."""
    if re.search(r"[*?\[{]", path):
        raise AnalysisError("L200", "paths are literal")
    return spark.read.parquet(path)


def fixed_width(spark: SparkSession, path: str, layout: list[tuple[str, int, int, str]], encoding: str = "utf-8", record: str | None = None, record_length: int | None = None, row_number: str | None = None) -> DataFrame:
    """layout: (name, 1-based start byte, length, code A text, N whole number, D YYYYMMDD, M amount with two implied decimals).

    Records are lines, or blocks of ``record_length`` bytes; ``record`` keeps those that begin with it. Lines are read in splits; blocks by one
    task a file.
    """
    if record_length:
        whole = spark.read.format("binaryFile").load(path).select("content")
        starts = F.sequence(F.lit(0).cast("long"), F.octet_length("content").cast("long") - 1, F.lit(record_length).cast("long"))
        records = whole.filter(F.octet_length("content") > 0).select("content", F.explode(starts).alias("at")).select(F.substring("content", F.col("at").cast("int") + 1, F.lit(record_length)).alias("r"))
    else:
        records = spark.read.text(path).select(F.col("value").cast("binary").alias("r"))
    shown = F.decode("r", "iso-8859-1")  # a character for each byte
    records = records.filter(shown.rlike(r"[^\s]"))
    if record is not None:
        records = records.filter(F.substring("r", F.lit(1), F.lit(len(record.encode(encoding)))) == F.lit(record.encode(encoding)))
    n = "_n"
    records = numbered(Scratch(spark, "fixed-width"), records, [], n)
    sizes = records.agg(F.min(F.octet_length("r")), F.max(F.octet_length("r"))).first()
    if sizes[0] != sizes[1]:
        raise RunError("L212", "records differ in length")
    columns = []
    for name, start, length, code in layout:
        v = F.decode(F.substring("r", F.lit(start), F.lit(length)), encoding)
        t = F.regexp_replace(v, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
        if code == "D":
            v = F.when(t.rlike("^0*$"), None).when(t.rlike(r"^[0-9]{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).otherwise(t)
        elif code == "M":
            digits = F.lpad(F.regexp_replace(F.regexp_replace(t, "[^0-9]", ""), "^0+", ""), F.greatest(F.length(F.regexp_replace(F.regexp_replace(t, "[^0-9]", ""), "^0+", "")), F.lit(3)), F.lit("0"))
            amount = F.concat(F.when(t.contains("-"), "-").otherwise(""), F.substring(digits, F.lit(1), F.length(digits) - 2), F.lit("."), F.substring(digits, F.length(digits) - 1, F.lit(2)))
            v = F.when(t.rlike(r"^[+-]?[0-9]+[+-]?$"), amount).otherwise(t)
        elif code == "N":
            v = t
        else:
            v = F.nullif(F.regexp_replace(v, r"[\s\p{Z}]+$", ""), F.lit(""))
        columns.append(v.alias(name))
    return records.select(*([F.col(n).alias(row_number)] if row_number else []), *columns)


LAYOUT_TYPES = {"A": "string", "N": "int", "D": "date", "M": "decimal(18,2)"}

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cell_date(serial: float) -> str:
    when = datetime(1899, 12, 30) + timedelta(days=serial)
    when = (when + timedelta(microseconds=500)).replace(microsecond=0)
    return when.date().isoformat() if serial == int(serial) else when.isoformat(sep=" ")


def workbook(path: str, sheet: str | None = None) -> list[list[str | None]]:
    """The cells of a worksheet as text, by row; dates in ISO form."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): rels[s.get(f"{{{_NS['r']}}}id")] for s in book.iterfind("m:sheets/m:sheet", _NS)}
        if sheet is not None and sheet not in sheets:
            raise RunError("L200", "the workbook has no such sheet")
        target = sheets[sheet or next(iter(sheets))].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        dates = set()
        if "xl/styles.xml" in z.namelist():
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            custom = {int(f.get("numFmtId")) for f in styles.iterfind("m:numFmts/m:numFmt", _NS) if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode").lower()))}
            dates = {i for i, x in enumerate(styles.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | custom}
        body = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows: list[list[str | None]] = []
    for row in body.iterfind("m:sheetData/m:row", _NS):
        at = int(row.get("r", len(rows) + 1))
        rows += [[] for _ in range(at - len(rows))]
        for c in row.iterfind("m:c", _NS):
            col = _column_number(c.get("r")) if c.get("r") else len(rows[at - 1])
            kind, v = c.get("t", "n"), c.find("m:v", _NS)
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                value = shared[int(v.text)]
            elif kind == "b":
                value = "true" if v.text == "1" else "false"
            elif kind == "n":
                number = float(v.text)
                value = _cell_date(number) if int(c.get("s", 0)) in dates else str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)
            else:
                value = v.text
            cells = rows[at - 1]
            cells += [None] * (col + 1 - len(cells))
            cells[col] = value
    return rows


def excel(spark: SparkSession, path: str, sheet: str | None = None, cells: str | None = None, header_row: int | None = None, section: int | None = None, header: bool = True, row_number: str | None = None) -> DataFrame:
    """One rectangular table of a worksheet as text: a range (``A3:L90``), from a header row, or the N-th run of non-blank rows; it ends at the first blank row."""
    rows = workbook(path.removeprefix("file://"), sheet)
    blank = lambda r: not any((x or "").strip() for x in r)
    if cells:
        a, b = cells.split(":")
        (c0, r0), (c1, r1) = ((_column_number(x), int(re.search(r"\d+", x)[0])) for x in (a, b))
        table = [(r + [None] * (c1 + 1 - len(r)))[c0 : c1 + 1] for r in rows[r0 - 1 : r1]]
        table = [r for r in table if not blank(r)]
    else:
        runs: list[list] = [[]]
        for r in rows[(header_row or 1) - 1 :]:
            if blank(r):
                runs.append([])
            else:
                runs[-1].append(r)
        runs = [x for x in runs if x]
        if not runs or (section or 1) > len(runs):
            raise RunError("L213", "the sheet has no such table")
        table = runs[(section or 1) - 1]
    width = max(len(r) for r in table)
    table = [r + [None] * (width - len(r)) for r in table]
    names = header_names(table[0]) if header else [f"column_{i + 1}" for i in range(width)]
    return _rows(spark, names, table[1:] if header else table, row_number)


def _plain_table(table):
    """An Arrow table with types that Spark has: wider integers for unsigned ones, text for what it lacks."""
    import pyarrow as pa

    fields = []
    for f in table.schema:
        t = f.type
        if pa.types.is_unsigned_integer(t):
            t = pa.decimal128(20, 0) if t.bit_width == 64 else pa.int64()
        elif pa.types.is_dictionary(t) or pa.types.is_time(t) or pa.types.is_duration(t) or pa.types.is_interval(t):
            t = pa.string()
        elif pa.types.is_timestamp(t) and t.unit != "us":
            t = pa.timestamp("us", t.tz)
        fields.append(pa.field(f.name, t))
    columns = [c if c.type == f.type else pa.chunked_array([pa.array([None if v is None else str(v) for v in c.to_pylist()], pa.string())]) if pa.types.is_string(f.type) and not pa.types.is_dictionary(c.type) else c.cast(f.type) for c, f in zip(table.columns, fields)]
    return pa.table(columns, schema=pa.schema(fields))


def database_file(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The rows of a query on an embedded database file, through Arrow in batches: whole numbers, decimals and nulls stay what they are.

    More than one batch goes to scratch tables, so that the driver holds BATCH rows at most.
    """
    import duckdb
    import pyarrow as pa

    con = duckdb.connect(path, read_only=True)
    try:
        batches = con.execute(query.rstrip().rstrip(";")).to_arrow_reader(BATCH)
        made, held = None, []
        for batch in batches:
            if held:
                made = _append(spark, made, held)
            held = [batch]
        last = spark.createDataFrame(_plain_table(pa.Table.from_batches(held, batches.schema)))
        return last if made is None else made[1](last)
    finally:
        con.close()


def _append(spark: SparkSession, made, held):
    """A scratch folder that batches are appended to, and what reads it with the last one."""
    import pyarrow as pa

    path = made[0] if made else f"{Scratch(spark, 'database').root}/rows"
    df = spark.createDataFrame(_plain_table(pa.Table.from_batches(held)))
    df.write.mode("append").parquet(path)
    return path, lambda last: spark.read.schema(last.schema).parquet(path).unionByName(last)


def secret(value: str | dict) -> str:
    """A literal, or {"env": NAME}: read when used, never kept in plans or messages."""
    if isinstance(value, dict):
        if value["env"] not in os.environ:
            raise RunError("L200", f"the environment lacks {value['env']}")
        return os.environ[value["env"]]
    return value


def sql(spark: SparkSession, url: str | dict, query: str, user: str | dict | None = None, password: str | dict | None = None, **options: str) -> DataFrame:
    """The rows of a query on a JDBC connection; filters and columns are pushed into it."""
    reader = spark.read.format("jdbc").option("url", secret(url)).option("query", query.rstrip().rstrip(";")).options(**options)
    if user is not None:
        reader = reader.option("user", secret(user))
    if password is not None:
        reader = reader.option("password", secret(password))
    return reader.load()
