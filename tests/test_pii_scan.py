import duckdb
import pytest

from spindrift.functions import patterns as P
from spindrift.operators import privacy, profile
from spindrift.plans import catalogue

BESIDE_LETTERS = ["CIÓNRAADOMENTE!! CIÓ", "é123-45-6789", "123-45-6789é", "日12345日", "x@b.orgé", "Ñ10.0.0.1ñ", "٣123456789", "ÁBCDEF1́", "𝒜AB1234567", "ß4111 1111 1111 1111", "ª12 Main Streetº"]
BESIDE_SPACES = ["123\x0b45\x0b6789", "123\x0c45\x0c6789", "12\x0bMain Street", "12 Main\x0bStreet", "555\u00a0123\u00a04567", "555\u2003123\u20034567", "555\x85123\x854567", "555\x1c123\x1c4567"]
#: 41 of 640 is 0.0640625, a tie at six places.
TIES = ["123-45-6789"] * 41 + ["none"] * 599


@pytest.mark.parametrize("texts", [BESIDE_LETTERS, BESIDE_SPACES, TIES, [None, "", *BESIDE_LETTERS, *BESIDE_SPACES]], ids=["letters", "spaces", "ties", "all"])
def test_scan_equals_sql(spark, tmp_path, texts):
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Customer#000000001"), (2, "Ñ000000002"), (3, None)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("documents", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES["pii_column_scan"](spark, str(tmp_path))
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES['pii_column_scan']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected)


def test_scans_and_samples_agree(spark):
    df = spark.createDataFrame([(t,) for t in BESIDE_LETTERS + BESIDE_SPACES], "c string")
    freq = profile.frequencies(df)
    a = {r.family: r for r in privacy.scan_in_place(df, ["c"]).collect()}
    assert a == {r.family: r for r in privacy.scan_families(freq).collect()}
    for family in ("mrn", "npi", "email"):
        found = privacy.samples(freq, family, 100).collect()
        assert sum(len(r.samples) for r in found) == (a[family].match_count if family in a else 0)
        assert len(P.PII_FAMILIES[family][2]) == 1  # so each match is one text


def test_families_of_the_caller_see_the_text(spark):
    df = spark.createDataFrame([("Zürich",), ("Zurich",)], "c string")
    found = {r.family: r.match_count for r in privacy.scan_in_place(df, ["c"], {"city": (0.5, 0.5, ("ü",))}).collect()}
    assert found["city"] == 1
