import pytest
from pyspark.sql import functions as F

from spindrift.functions import patterns as P
from spindrift.operators import clean, health, redact, split
from spindrift.settings import Settings, parse_size

MIXED = (
    "CLAIM_ID string, MEMBER_ID string, ID string, LAST_NAME string, AGE int, GENDER string, CLAIM_TYPE string, DIAGNOSIS_CODE string, PROCEDURE_CODE string, TOTAL_CHARGE double, CLAIM_COST double, STATUS string"
)
ROWS = [
    ("CLM001", "MBR001", None, "Smith", 45, "M", "Medical", "Z00.00", "99213", 150.0, None, "Active"),
    ("CLM002", "MBR002", None, "Johnson", 32, "F", "Dental", "K02.9", "99214", 200.0, None, "Active"),
    ("CLM003", None, "PAT001", "Williams", 67, "M", None, None, None, None, 1500.0, "Active"),
    ("CLM004", None, "PAT002", "Brown", 28, "F", None, None, None, None, 800.0, "Closed"),
    ("CLM005", "MBR003", "PAT003", "Davis", 55, "M", "Medical", "bad", "99215", 300.0, None, "Active"),
]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(ROWS, MIXED)


def test_headers():
    assert clean.normalised_headers(["Patient Name!", "patient-name", "", "a b", "a-b", "a b"]) == ["patient_name", "patient_name_1", "unnamed_column", "a_b", "a_b_1", "a_b_2"]
    assert clean.parser_headers([" a b", "a-b", "C"]) == ["a_b", "a_b_1", "C"]
    assert clean.upper_headers([" age "]) == ["AGE"]


def test_null_spellings_every_token(spark):
    df = spark.createDataFrame([(t, "x") for t in P.INGEST_NULLS] + [(" kept ", "x")], "a string, b string")
    got = clean.trim_and_null(df, P.INGEST_NULLS)
    assert got.filter("a is not null").collect()[0].a == "kept"
    assert got.filter("a is null").count() == len(P.INGEST_NULLS)


def test_drop_empty(spark):
    df = spark.createDataFrame([("a", None, None), (None, None, None)], "x string, y string, z int")
    got = clean.drop_empty(df)
    assert got.columns == ["x"] and got.count() == 1


def test_health_rules(mixed):
    got = {r.TOTAL_CHARGE: r for r in clean.clean_health(mixed).collect()}
    assert all(r.CLAIM_ID is None for r in got.values())  # neither prefix
    assert got[150.0].DIAGNOSIS_CODE_VALID and not got[300.0].DIAGNOSIS_CODE_VALID and got[300.0].DIAGNOSIS_CODE == "bad"


def test_health_ranges(spark):
    df = spark.createDataFrame([("IQV1", "130", "x", -1.0, 1.5), ("CMS2", "12", "M", 2.0, 0.5), ("Z", "nan", "F", float("nan"), float("nan"))], "claim_id string, age string, gender string, total_charge double, coinsurance double")
    got = clean.clean_health(df).orderBy("TOTAL_CHARGE").collect()
    by = {r.CLAIM_ID: r for r in got}
    assert by["IQV1"].AGE is None and by["IQV1"].GENDER is None and by["IQV1"].TOTAL_CHARGE is None and by["IQV1"].COINSURANCE is None
    assert by["CMS2"].AGE == 12.0 and by["CMS2"].COINSURANCE == 0.5
    assert by[None].TOTAL_CHARGE is None and by[None].AGE is None


def test_redaction_blank_is_value(spark):
    df = spark.createDataFrame([("", "", ""), ("Lee", "45.0", "58923"), (None, None, None), ("Kim", " 70 ", "12")], "LAST_NAME string, AGE string, PROVIDER_ZIP string")
    got = [tuple(r) for r in redact.redact(df).collect()]
    assert got == [("[REDACTED_NAME]", "[REDACTED_AGE]", "[REDACTED_ZIP]"), ("[REDACTED_NAME]", "[REDACTED_AGE]", "589XX"), (None, None, None), ("[REDACTED_NAME]", "70_Plus", "[REDACTED_ZIP]")]
    assert [tuple(r) for r in redact.redact(df, blank_is_value=False).collect()][0] == (None, None, None)


def test_age_numbers_truncate(spark):
    df = spark.createDataFrame([(17.9,), (18.0,), (69.99,), (90.0,), (float("nan"),)], "AGE double")
    assert [r.AGE for r in redact.redact(df).collect()] == ["Under_18", "18-29", "50-69", "70_Plus", "[REDACTED_AGE]"]


def test_ages_of_sample(mixed):
    assert [r.AGE for r in redact.redact(mixed).collect()] == ["30-49", "30-49", "50-69", "18-29", "50-69"]


def test_masking_is_idempotent(mixed):
    once = redact.mask(mixed, ["LAST_NAME", "STATUS"], ["DIAGNOSIS_CODE"])
    assert once.exceptAll(redact.mask(once, ["LAST_NAME", "STATUS"], ["DIAGNOSIS_CODE"])).count() == 0
    r = once.first()
    assert (r.LAST_NAME, r.STATUS, r.DIAGNOSIS_CODE) == ("MASKED_NAME", "MASKED_PII", "MASKED_DIAGNOSIS")
    assert redact.mask(mixed, ["CLAIM_ID"], protect_keys=["CLAIM_ID"]).first().CLAIM_ID == "CLM001"


def test_three_splits(mixed):
    claims, people = split.split_by_identifier(mixed)
    assert (claims.count(), people.count()) == (3, 2)
    assert claims.columns == list(P.CLAIM_PROJECTION) and people.columns == list(P.PATIENT_PROJECTION)
    assert tuple(split.count_by_name(mixed).first()) == (0, 5)
    both = split.split_mixed(mixed)
    assert (both[0].count(), both[1].count(), split.union_once(mixed).count()) == (5, 5, 5)


def test_sample_and_splits_ignore_partitioning(mixed):
    df = mixed.withColumn("k", F.col("CLAIM_ID"))
    a = {r.k for r in split.sample_rows(df.repartition(3), "k", 2).collect()}
    assert a == {r.k for r in split.sample_rows(df.repartition(1), "k", 2).collect()} and len(a) == 2


def test_health_summary(mixed):
    doubled = mixed.unionByName(mixed.limit(1))
    got = health.summary(doubled, clean.clean_health(doubled)).first()
    assert (got.total_records, got.duplicate_records) == (6, 1)
    assert "1 duplicate records found" in got.issues_found and "Missing values standardized" in got.issues_found
    assert "1 invalid diagnosis codes" not in got.issues_found  # three rows have no code: four are invalid or missing
    assert any("invalid diagnosis codes" in x for x in got.issues_found)


def test_empty_tables(spark, mixed):
    none = mixed.limit(0)
    assert health.quality_score(none).first()[0] == 0.0
    assert health.duplicate_rows(none).first()[0] == 0
    assert split.split_by_identifier(none)[0].count() == 0


def test_settings():
    assert Settings().max_file_bytes == 100 * 1024**2 and parse_size("1.5 kb") == 1536 and parse_size("7") == 7
    with pytest.raises(ValueError):
        parse_size("many")
