"""Sources: delimited text, JSON, JSON lines and archives of them, from any path that Spark reads."""

from __future__ import annotations

import csv as _csv
import io
import json
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean
from ..operators.split import sample_rows
from ..settings import Settings
from . import xlsx

DELIMITERS = (",", "\t", ";", "|", ":")
PROBE_BYTES = 10_000


class ReaderUnavailable(RuntimeError):
    """The file kind is known, but the library that reads it is not installed."""


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """First bytes of a file, by Hadoop's file systems, so that any store works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def detect_encoding(head: bytes) -> str:
    """By byte-order mark, else UTF-8 if the bytes are that, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if head.startswith(mark):
            return name
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return "UTF-8" if e.start >= len(head) - 3 and e.reason == "unexpected end of data" else "ISO-8859-1"
    return "UTF-8"


def detect_delimiter(text: str) -> str:
    """The most frequent candidate in the first 1024 characters; ties go to the first; none: a comma."""
    head = text[:1024]
    best = max(DELIMITERS, key=lambda d: (head.count(d), -DELIMITERS.index(d)))
    return best if head.count(best) else ","


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, skip_bad: bool = False) -> DataFrame:
    """All columns as text; quotes and line breaks inside quotes are understood.  ``skip_bad`` leaves out rows with
    more fields than the header."""
    if sep is None or encoding is None:
        head = _head(spark, path, PROBE_BYTES)
        encoding = encoding or detect_encoding(head)
        sep = sep or detect_delimiter(head.decode(encoding, "replace"))
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"')
    rows = reader.option("inferSchema", False).csv(path)
    if not skip_bad:
        return rows
    wide = reader.schema(T.StructType([*(T.StructField(f"c{k}", T.StringType()) for k in range(len(rows.columns))), T.StructField("beyond", T.StringType())]))
    return wide.csv(path).filter("beyond IS NULL").drop("beyond").toDF(*rows.columns)


def has_bad_rows(spark: SparkSession, path: str) -> bool:
    """Whether some row has more fields than the header, by the detected encoding and delimiter."""
    head = _head(spark, path, PROBE_BYTES)
    encoding = detect_encoding(head)
    sep = detect_delimiter(head.decode(encoding, "replace"))
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"')
    n = len(reader.csv(path).columns)
    wide = reader.schema(", ".join([*(f"c{k} string" for k in range(n)), "beyond string"])).csv(path)
    return bool(wide.filter("beyond IS NOT NULL").head(1))


def ingest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Robust text ingest: detected encoding and delimiter, all text, cleaned headers, null spellings removed.  A file
    with broken rows is read again as Latin-1 with commas, without them."""
    if has_bad_rows(spark, path):
        return clean.basic_clean(read_csv(spark, path, ",", "ISO-8859-1", skip_bad=True))
    return clean.basic_clean(read_csv(spark, path))


def parse_csv(spark: SparkSession, path: str, sample: int | None = None, key: str | None = None) -> DataFrame:
    """The pipeline's reader; a sample is taken only on request, by a hash of ``key``."""
    out = clean.parser_clean(read_csv(spark, path, sep=","))
    return sample_rows(out, key, sample) if sample and key else out


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields as columns ``parent<sep>child``; of an array of structs the first element; other arrays stay."""

    def walk(name: str, col: Column, kind: T.DataType) -> Iterator[Column]:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            col, kind = F.get(col, F.lit(0)), kind.elementType
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f"{name}{sep}{f.name}", col.getField(f.name), f.dataType)
        else:
            yield col.alias(name)

    return df.select(*(c for f in df.schema.fields for c in walk(f.name, F.col(f"`{f.name}`"), f.dataType)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, ``{"data": [...]}``, ``{"records": [...]}`` or one object; nested fields flattened."""
    df = spark.read.option("multiLine", True).json(path)
    for wrapper in ("data", "records"):
        if df.columns == [wrapper] or (wrapper in df.columns and isinstance(df.schema[wrapper].dataType, T.ArrayType)):
            kind = df.schema[wrapper].dataType
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                df = df.select(F.inline(wrapper))
                break
    return flatten(df)


def ingest_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON or JSON lines; lines that do not parse are left out."""
    head = _head(spark, path, 64).lstrip()
    if head.startswith(b"["):
        df = read_json(spark, path)
    else:
        df = spark.read.option("mode", "DROPMALFORMED").json(path)
        if not df.columns or df.columns == ["_corrupt_record"]:
            df = read_json(spark, path)
        df = flatten(df.drop("_corrupt_record"))
    return clean.basic_clean(df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)))


def read_excel(spark: SparkSession, path: str, all_sheets: bool = True) -> DataFrame:
    """Worksheets of .xlsx files as text, tagged ``_sheet_name``; a sheet that fails is skipped.  Each workbook is one
    task's work, a row at a time.  The older .xls is not read."""
    if path.lower().endswith(".xls"):
        raise ReaderUnavailable("the binary .xls format is not read; save the workbook as .xlsx")
    raw = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for name, records in islice(xlsx.sheets(content), None if all_sheets else 1):
                    try:
                        while part := list(islice(records, 10_000)):
                            yield pd.DataFrame({"_sheet_name": name, "record": [json.dumps(r) for r in part]})
                    except (KeyError, ValueError, IndexError, ElementTree.ParseError):
                        continue

    return _records(raw.mapInPandas(rows, "_sheet_name string, record string"), "record", ["_sheet_name"])


def _records(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Rows of JSON objects as columns; the key set is aggregated, one row for each name."""
    names = [r.k for r in rows.select(F.explode(F.json_object_keys(column)).alias("k")).distinct().orderBy("k").collect()]
    parsed = rows.withColumn("_m", F.from_json(column, "map<string,string>"))
    return parsed.select(*(F.element_at("_m", F.lit(n)).alias(n) for n in names), *keep)


def _members(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(member, record, error): a row for each record, and one without a record for each member that fails."""
    for batch in batches:
        for content in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for name in sorted(archive.namelist()):
                    base = name.rsplit("/", 1)[-1]
                    if name.endswith("/") or base.startswith(".") or "__MACOSX" in name:
                        continue
                    try:
                        found = [(name, json.dumps(r), None) for r in _member_records(base, archive.read(name))]
                    except Exception as e:  # a member that fails is skipped by read_zip and listed by member_report
                        found = [(name, None, f"{type(e).__name__}: {e}")]
                    if found:
                        yield pd.DataFrame(found, columns=["member", "record", "error"], dtype=object)


_MEMBER = "member string, record string, error string"


def _member_records(name: str, data: bytes) -> Iterator[dict]:
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        for sheet, records in xlsx.sheets(data):
            for record in records:
                yield {**record, "_sheet_name": sheet}
        return
    if kind == "xls":
        raise ReaderUnavailable("the binary .xls format is not read")
    text = data.decode(detect_encoding(data[:PROBE_BYTES]), "replace")
    if kind == "csv":
        for row in _csv.DictReader(io.StringIO(text)):
            yield {k.strip(): v for k, v in row.items() if k}
    elif kind == "json":
        found = json.loads(text)
        if isinstance(found, dict):
            found = next((found[k] for k in ("data", "records") if isinstance(found.get(k), list)), [found])
        for row in found:
            yield {k: None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in _flat(row).items()}


def _flat(record: dict, prefix: str = "") -> dict:
    out: dict = {}
    for k, v in record.items():
        name = f"{prefix}{k}"
        if isinstance(v, list) and v and isinstance(v[0], dict):
            v = v[0]
        out |= _flat(v, f"{name}_") if isinstance(v, dict) else {name: v}
    return out


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON and .xlsx members of archives, as text, with ``_source_file``; files that fail (see
    :func:`member_report`), hidden files and nested archives are skipped.  Each archive is one task's work."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    rows = raw.mapInPandas(_members, _MEMBER).filter("record IS NOT NULL").withColumnRenamed("member", "_source_file")
    return _records(rows, "record", ["_source_file"])


def member_report(spark: SparkSession, path: str) -> DataFrame:
    """(member, records, error) of archives: how many records each member gave, or why it gave none."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInPandas(_members, _MEMBER).groupBy("member").agg(F.count("record").alias("records"), F.max("error").alias("error"))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, .xlsx or ZIP upload.  Other kinds, and uploads without rows, raise ValueError."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind not in ("csv", "xlsx", "zip"):
        raise ValueError("unsupported file format: CSV, XLSX or ZIP is expected")
    if kind == "csv":
        df = read_csv(spark, path, ",", skip_bad=True)
    else:
        df = read_zip(spark, path) if kind == "zip" else read_excel(spark, path, all_sheets=False)
    if not df.columns or not df.head(1):
        raise ValueError("no data in the uploaded file")
    return df


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": ingest_csv, ".tsv": ingest_csv, ".json": ingest_json, ".jsonl": ingest_json, ".zip": read_zip, ".xlsx": read_excel, ".xls": read_excel,
}


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, size_bytes, supported, modified); the files' contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", ext.alias("extension"), F.col("length").alias("size_bytes"), ext.isin(*READERS).alias("supported"), F.col("modificationTime").alias("modified"))


def ingest(spark: SparkSession, path: str, settings: Settings | None = None) -> tuple[DataFrame, dict]:
    """(rows, metadata) by extension; other extensions raise ValueError, and so do files beyond the limit of
    ``settings``, where these are given."""
    ext = "." + path.rsplit(".", 1)[-1].lower()
    if ext not in READERS:
        raise ValueError(f"unsupported file type: {ext}")
    info = file_info(spark, path).first()
    if settings and info.size_bytes > settings.max_file_bytes:
        raise ValueError(f"{path} has {info.size_bytes} bytes, more than {settings.max_file}")
    df = READERS[ext](spark, path)
    return df, {"path": path, "size_bytes": info.size_bytes, "rows": df.count(), "columns": len(df.columns), "dtypes": dict(df.dtypes)}


def union_records(frames: list[DataFrame]) -> DataFrame:
    """Ragged tables one after another; columns that one lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
