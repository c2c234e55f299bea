import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spindrift.sources import readers, sinks
from spindrift.streaming import masking


def test_probes():
    assert readers.detect_delimiter("a;b;c,d") == ";" and readers.detect_delimiter("a,b|c") == "," and readers.detect_delimiter("plain") == ","
    assert readers.detect_encoding("é".encode()) == "UTF-8" and readers.detect_encoding("é".encode("latin-1") + b"x") == "ISO-8859-1" and readers.detect_encoding(b"\xff\xfea\0") == "UTF-16LE"


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("Name!;Age;empty\n José ;N/A;\n\"x;y\";7;\n".encode("latin-1"))
    df = readers.ingest_csv(spark, str(path))
    assert df.columns == ["name", "age"]
    assert sorted(map(tuple, df.collect()), key=str) == [("José", None), ("x;y", "7")]
    info = readers.file_info(spark, str(path)).first()
    assert info.extension == ".csv" and info.supported and info.size_bytes == path.stat().st_size


@pytest.mark.parametrize("document", [[{"a": 1, "b": {"c": "x"}}], {"data": [{"a": 1, "b": {"c": "x"}}]}, {"records": [{"a": 1, "b": {"c": "x"}}]}, {"a": 1, "b": {"c": "x"}}])
def test_json_shapes(spark, tmp_path, document):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(document))
    assert [tuple(r) for r in readers.read_json(spark, str(path)).select("a", "b_c").collect()] == [(1, "x")]


def test_json_lines_skip_bad(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1, "l": [{"x": 5}, {"x": 6}]}\nnot json\n{"a": 2, "l": []}\n')
    df, meta = readers.ingest(spark, str(path))
    assert sorted((r.a, r.l_x) for r in df.collect()) == [("1", "5"), ("2", None)] and meta["rows"] == 2
    with pytest.raises(ValueError):
        readers.ingest(spark, str(tmp_path / "a.bin"))


def test_zip(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one.csv", "x,y\n1,2\n")
        z.writestr("in/two.json", json.dumps({"records": [{"x": 3, "n": {"k": [1, 2]}}]}))
        z.writestr("__MACOSX/one.csv", "x\n9\n")
        z.writestr(".hidden.csv", "x\n9\n")
        z.writestr("nested.zip", b"PK")
        z.writestr("bad.json", "{")
    got = {r._source_file: r for r in readers.read_zip(spark, str(path)).collect()}
    assert set(got) == {"one.csv", "in/two.json"} and got["one.csv"].y == "2" and got["in/two.json"].n_k == "[1, 2]"


def workbook(path, sheets):
    """A small .xlsx file: sheet name -> rows of (type, value, style) cells."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    strings: list[str] = []

    def cell(at, kind, value, style):
        if kind == "s":
            strings.append(value)
            value = len(strings) - 1
        inner = f"<is><t>{value}</t></is>" if kind == "inlineStr" else f"<v>{value}</v>"
        return f'<c r="{at}" t="{kind}" s="{style}">{inner}</c>'

    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for k, n in enumerate(names, 1):
            rows = "".join("<row>" + "".join(cell(f"{chr(65 + i)}{r}", *c) for i, c in enumerate(row) if c) + "</row>" for r, row in enumerate(sheets[n], 1))
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>' if sheets[n] else "broken")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>")


SHEETS = {
    "claims": [[("s", "CLAIM_ID", 0), ("s", "day", 0), ("inlineStr", "paid", 0)], [("s", "IQV1", 0), ("n", 45296, 1), ("b", 1, 0)], [], [("s", "IQV2", 0), None, ("n", "12.5", 0)]],
    "broken": [],
    "people": [[("s", "ID", 0), None], [("n", 7, 0), ("e", "#N/A", 0)]],
}


def test_excel(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", SHEETS)
    got = {(r._sheet_name, r.CLAIM_ID or r.ID): r for r in readers.read_excel(spark, str(tmp_path / "a.xlsx")).collect()}
    assert set(got) == {("claims", "IQV1"), ("claims", "IQV2"), ("people", "7")}
    assert got["claims", "IQV1"].day == "2024-01-05 00:00:00" and got["claims", "IQV1"].paid == "True" and got["claims", "IQV2"].paid == "12.5" and got["claims", "IQV2"].day is None
    assert {r._sheet_name for r in readers.read_excel(spark, str(tmp_path / "a.xlsx"), all_sheets=False).collect()} == {"claims"}
    with pytest.raises(readers.ReaderUnavailable):
        readers.read_excel(spark, str(tmp_path / "a.xls"))


def test_members_and_uploads(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"claims": SHEETS["claims"]})
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.xlsx", "in/a.xlsx")
        z.writestr("b.csv", "CLAIM_ID,x\nIQV3,1\n")
        z.writestr("old.xls", b"x")
        z.writestr("bad.json", "{")
    rows = readers.read_upload(spark, str(tmp_path / "a.zip"))
    assert sorted(r.CLAIM_ID for r in rows.collect()) == ["IQV1", "IQV2", "IQV3"]
    report = {r.member: (r.records, r.error) for r in readers.member_report(spark, str(tmp_path / "a.zip")).collect()}
    assert report["in/a.xlsx"] == (2, None) and report["b.csv"] == (1, None) and report["old.xls"][0] == 0 and "ReaderUnavailable" in report["old.xls"][1] and report["bad.json"][1]
    assert readers.read_upload(spark, str(tmp_path / "a.xlsx")).count() == 2
    (tmp_path / "none.csv").write_text("a,b\n")
    for name in ("none.csv", "a.txt"):
        with pytest.raises(ValueError):
            readers.read_upload(spark, str(tmp_path / name))


def test_broken_rows_are_left_out(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Na me,B\nJos\xe9,1\none,two,three\n\"x,y\",2\nshort\n".encode("latin-1"))
    got = readers.ingest_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r.na_me, r.b) for r in got.collect()) == [("José", "1"), ("short", None), ("x,y", "2")]


def test_size_limit(spark, tmp_path):
    from spindrift.settings import Settings

    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    assert readers.ingest(spark, str(tmp_path / "a.csv"), Settings())[1]["rows"] == 1
    with pytest.raises(ValueError):
        readers.ingest(spark, str(tmp_path / "a.csv"), Settings(max_file="4B"))


def test_package(spark, tmp_path):
    from spindrift.plans import pipeline

    claims = spark.createDataFrame([("IQV1", "M1", 1.5), ("IQV2", "M2", 2.5)], "CLAIM_ID string, MEMBER_ID string, COPAY double").repartition(2)
    report = spark.createDataFrame([("HIGH", 3)], "risk string, fields int")
    with zipfile.ZipFile(pipeline.write_package({"claims": claims, "demographics": claims.limit(0)}, report, str(tmp_path / "out"))) as z:
        assert sorted(z.namelist()) == ["README.txt", "insurance_claims.csv", "privacy_report.json"]
        assert sorted(z.read("insurance_claims.csv").decode().splitlines()) == ["CLAIM_ID,MEMBER_ID,COPAY", "IQV1,M1,1.5", "IQV2,M2,2.5"]
        assert json.loads(z.read("privacy_report.json")) == {"risk": "HIGH", "fields": 3}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("z", None, "M1", ""), ("y", 2, "M2", "q")], "b string, a int, MEMBER_ID string, CLAIM_ID string")
    assert sinks.csv_columns(df) == ["CLAIM_ID", "MEMBER_ID", "a", "b"]
    sinks.write_csv(df, str(tmp_path / "out"), ordered=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("CLAIM_ID,MEMBER_ID,a,b\n") and ",M1,,z" in text
    assert not sinks.write_csv(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    sinks.write_synthetic(df.repartition(2), str(tmp_path / "s"))
    with zipfile.ZipFile(tmp_path / "s/synthetic_data.zip") as z:
        assert z.read("synthetic_data.csv").decode().count("MEMBER_ID") == 1 and len(z.read("synthetic_data.json").splitlines()) == 2
    assert json.loads(sinks.report_document(df).first().document)["MEMBER_ID"] in ("M1", "M2")
    assert readers.union_records([df.select("a"), df.select("b")]).count() == 4


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("email", F.lit("a@b.org"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    change = lambda df: masking.masked(df, ["email"])
    masking.masked_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp"), change).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id", "email")
    assert got.exceptAll(change(events).select("event_id", "email")).count() == 0 and got.count() == events.count()
    counts = masking.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type")
    assert counts.agg(F.sum("n")).first()[0] == events.count()
