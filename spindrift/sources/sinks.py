"""Sinks: CSV with the healthcare column order, JSON reports, and archives of the written files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P


CHUNK = 1 << 20


def csv_columns(df: DataFrame) -> list[str]:
    """Claims order if any row has a MEMBER_ID, else demographics order, then the other columns sorted."""
    has_member = "MEMBER_ID" in df.columns and df.filter(F.col("MEMBER_ID").isNotNull() & (F.col("MEMBER_ID") != "")).head(1)
    first = [c for c in (P.CLAIM_PROJECTION if has_member else P.PATIENT_PROJECTION) if c in df.columns]
    return first + sorted(c for c in df.columns if c not in first)


def write_csv(df: DataFrame, path: str, ordered: bool = False) -> bool:
    """Header, nulls as empty fields.  Nothing is written for an empty table; returns whether it was."""
    if not df.head(1):
        return False
    out = df.select(*csv_columns(df)) if ordered else df
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)
    return True


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report_document(df: DataFrame) -> DataFrame:
    """Each row of a report table as one JSON document."""
    return df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"}).alias("document"))


def write_report(df: DataFrame, path: str) -> None:
    report_document(df).write.mode("overwrite").text(path)


class _JvmStream(io.RawIOBase):
    """A stream of the JVM to write to."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)


def _chunks(jvm, stream) -> Iterator[bytes]:
    take = lambda: bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, CHUNK)))
    return iter(take, b"")


def package(spark: SparkSession, folders: dict[str, str], target: str, readme: str | None = None) -> None:
    """One archive of written folders: member name -> folder of part files, joined in order, by Hadoop's file systems.

    Bytes stream through the driver, CHUNK at a time; archives are meant for results of download size.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    sink = _JvmStream(path.getFileSystem(conf).create(path, True))
    buffer = io.BufferedWriter(sink, CHUNK)
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for member, folder in folders.items():
            root = jvm.org.apache.hadoop.fs.Path(folder)
            fs = root.getFileSystem(conf)
            parts = sorted(str(s.getPath()) for s in fs.listStatus(root) if s.getPath().getName().startswith("part-"))
            with archive.open(member, "w", force_zip64=True) as out:
                for k, part in enumerate(parts):
                    stream = fs.open(jvm.org.apache.hadoop.fs.Path(part))
                    for n, data in enumerate(_chunks(jvm, stream)):
                        if k and not n and member.endswith(".csv"):
                            data = data.split(b"\n", 1)[-1]  # each part has the header
                        out.write(data)
                    stream.close()
        if readme:
            archive.writestr("README.txt", readme)
    buffer.flush()
    sink.stream.close()


def write_synthetic(df: DataFrame, folder: str) -> None:
    """``synthetic_data.csv`` and ``.json`` folders and ``synthetic_data.zip`` with both."""
    write_csv(df, f"{folder}/synthetic_data.csv")
    write_json(df, f"{folder}/synthetic_data.json")
    package(df.sparkSession, {"synthetic_data.csv": f"{folder}/synthetic_data.csv", "synthetic_data.json": f"{folder}/synthetic_data.json"}, f"{folder}/synthetic_data.zip")
