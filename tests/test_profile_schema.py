import math

import pytest

from spindrift.functions import exprs as E
from spindrift.functions import stats as S
from spindrift.operators import privacy, profile, schema
from pyspark.sql import functions as F


def one(spark, values, kind="string"):
    return profile.frequencies(spark.createDataFrame([(v,) for v in values], f"c {kind}"))


@pytest.mark.parametrize(
    "values, hint",
    [
        ([None, None], "empty"), (["1", "2", "1,234"], "integer"), (["1.5", "2"], "float"), (["$5", "$1,234.50", "$7"], "currency"),
        (["2024-01-01xyz", "2023-05-06"], "date"), (["yes", "NO", "y"], "boolean"), (["red"] * 20, "categorical"), (["red", "blue"], "text"), (["1e5", "1d", "inf", "1_000", "x"], "text"),
    ],
)
def test_type_hints(spark, values, hint):
    assert profile.type_hints(one(spark, values)).first().data_type_hint == hint


def test_numbers(spark):
    df = spark.createDataFrame([("1,234",), (" 7 ",), ("1d",), ("inf",), ("1_000",), ("-1.5e2",), (".5",)], "v string")
    assert [r[0] for r in df.select(E.number(F.col("v"))).collect()] == [1234.0, 7.0, None, None, None, -150.0, 0.5]


def test_numeric_statistics(spark):
    df = spark.createDataFrame([("$1,000",), ("3",), ("x",), (None,)], "v string")
    r = profile.numeric_statistics(df, ["v"]).first()
    assert (r["count"], r.min, r.max, r.median, r.range) == (2, 3.0, 1000.0, 501.5, 997.0)
    single = profile.numeric_statistics(spark.createDataFrame([(4.0,)], "v double"), ["v"]).first()
    assert single.std is None and single.q25 == 4.0


def test_profile_edge_columns(spark):
    df = spark.createDataFrame([(None, "a", 1)] * 3, "n string, k string, i int")
    got = {r.column_name: r for r in profile.profile_columns(df).collect()}
    assert got["n"].data_type_hint == "empty" and got["n"].null_rate == 1.0 and any("High null rate: 100.0%" == x for x in got["n"].issues)
    assert got["k"].unique_count == 1
    assert profile.dataset_summary(profile.profile_columns(df)).first().total_cells == 9


def test_entropy_and_top(spark):
    freq = one(spark, ["a"] * 3 + ["b"] + [None])
    r = profile.entropy(freq).first()
    assert (r.most_frequent, r.most_frequent_count, r.least_frequent, r.unique_categories) == ("a", 3, "b", 2)
    assert r.entropy == pytest.approx(0.811278, abs=1e-5)
    assert [(x.value, x.n) for x in profile.top_values(freq, 1).collect()] == [("a", 3)]


def test_profile_ignores_partitioning(spark):
    df = spark.range(500).selectExpr("id % 7 AS a", "cast(id as string) AS b")
    a = {tuple(map(str, r)) for r in profile.profile_columns(df.repartition(5)).collect()}
    assert a == {tuple(map(str, r)) for r in profile.profile_columns(df.repartition(1)).collect()}


@pytest.mark.parametrize(
    "family, value",
    [
        ("ssn", "123-45-6789"), ("phone", "555-123-4567"), ("email", "a.b@c.org"), ("credit_card", "4111 1111 1111 1111"), ("drivers_license", "AB1234567"), ("passport", "AB1234567"),
        ("ip_address", "10.0.0.1"), ("address", "12 Main Street"), ("zip_code", "12345"), ("date_of_birth", "01/31/1990"), ("mrn", "AB12CD"), ("npi", "1234567890"), ("insurance_id", "ABC1234567"),
    ],
)
def test_each_family(spark, family, value):
    found = {r.family for r in privacy.scan_families(one(spark, [value])).collect()}
    assert family in found


def test_family_sums_patterns_and_parenthesised_phone(spark):
    nine = {r.family: r for r in privacy.scan_families(one(spark, ["123456789", None])).collect()}
    assert {"ssn", "passport", "drivers_license", "insurance_id"} <= set(nine)
    assert nine["ssn"].match_rate == 0.5  # nulls stay in the denominator
    assert "phone" not in {r.family for r in privacy.scan_families(one(spark, ["call (743) 555-3824"])).collect()}
    from spindrift.functions.patterns import PHONE_IN_PARENTHESES

    assert "phone_paren" in {r.family for r in privacy.scan_families(one(spark, ["call (743) 555-3824"]), {"phone_paren": PHONE_IN_PARENTHESES}).collect()}


def test_scans_agree(spark):
    df = spark.createDataFrame([("a@b.org",), ("10.0.0.1",), ("a@b.org",), (None,)], "c string")
    a = sorted(map(tuple, privacy.scan_in_place(df, ["c"]).collect()))
    assert a == sorted(map(tuple, privacy.scan_families(profile.frequencies(df)).collect()))


def test_names_and_report(spark):
    df = spark.createDataFrame([("Smith", "4111111111111111"), ("Garcia", "5500000000000004"), ("Lee", "x")], "last_name string, card string")
    freq = profile.frequencies(df)
    name = privacy.scan_names(freq).first()
    assert (name.name_type, name.confidence) == ("last_name", 0.7)
    report = privacy.report(df).first()
    assert report.total_columns == 2 and any("PCI" in x for x in report.compliance_notes)


def test_pipeline_thresholds(spark):
    df = spark.createDataFrame([("IQV200000", "C50.9", "x")] * 3, "CLAIM_ID string, DIAGNOSIS_CODE string, LAST_NAME string")
    flags = {r.column_name: r for r in privacy.flagged(privacy.pipeline_confidence(df)).collect()}
    assert flags["CLAIM_ID"].is_phi and not flags["DIAGNOSIS_CODE"].is_phi and flags["LAST_NAME"].is_pii
    low = {r.column_name: r for r in privacy.flagged(privacy.pipeline_confidence(df), phi_threshold=0.85).collect()}
    assert low["DIAGNOSIS_CODE"].is_phi
    masked, _ = privacy.mask_detected(df, protect_keys=["CLAIM_ID"])
    assert tuple(masked.first()) == ("IQV200000", "C50.9", "MASKED_NAME")
    assert [privacy.risk_band(F.lit(n)) is not None for n in (0, 2, 5, 10, 11)]


def test_normal_test_closed_form(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)], "v double")
    r = schema.distributions(df, ["v"]).first()
    assert r.n == 20 and r.distribution in ("normal", "symmetric")
    few = schema.distributions(df.limit(7), ["v"]).first()
    assert few.distribution == "unknown"
    x = spark.createDataFrame([(float(v),) for v in (2, 8, 0, 4, 1, 9, 9, 0)], "v double")
    p = x.agg(S.normal_test_p(F.count("v"), F.skewness("v"), F.kurtosis("v"))).first()[0]
    assert 0 < p < 1


def test_p_values():
    assert S.kolmogorov_p(0.0, 10, 10) == 1.0 and S.kolmogorov_p(1.0, 100, 100) < 1e-10
    assert S.chi_square_p(10.0, 2) == pytest.approx(math.exp(-5), rel=1e-9)
    assert S.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-6)
    assert S.chi_square_p(float("inf"), 3) == 0.0


def test_schema_and_ddl(spark):
    df = spark.createDataFrame([(i, f"n{i}@x.org", "low" if i % 3 else "high", i % 2 == 0) for i in range(40)], "id int, mail string, level string, flag boolean")
    table = schema.infer(df)
    got = {r.column_name: r for r in table.collect()}
    assert got["id"].sql_type == "TINYINT" and got["id"].pk_score == pytest.approx(1.0) and got["mail"].pk_score == pytest.approx(0.9) and got["level"].sql_type == "ENUM" and got["flag"].sql_type == "BOOLEAN"
    assert got["mail"].format == "email"
    ddl = schema.to_ddl(table, "t", profile.frequencies(df))
    assert "PRIMARY KEY (id)" in ddl and "level ENUM('high', 'low') NOT NULL" in ddl and "UNIQUE (mail)" in ddl


def test_ordinal_boolean(spark):
    assert schema.ordinal_columns(one(spark, ["Low", "medium", "HIGH"])).first().is_ordinal
    assert schema.ordinal_columns(one(spark, ["1st", "2nd"])).first().is_ordinal
    assert not schema.ordinal_columns(one(spark, ["a"])).first().is_ordinal
    r = schema.boolean_columns(one(spark, ["Yes", "no", "no"])).first()
    assert (r.true_count, r.false_count, r.representation) == (1, 2, "yes/no")


def test_field_schema_hints(spark):
    df = spark.createDataFrame([(45, "english", "IQV1"), (30, "dutch", "IQV2")], "AGE int, language string, CLAIM_ID string")
    got = {r.column_name: r for r in schema.field_schema(df, hints=True).collect()}
    assert got["AGE"].type == "integer" and got["AGE"].max == 120.0 and got["language"].type == "string"
    assert got["CLAIM_ID"].pattern.startswith("^(IQV")
    assert schema.dataset_quality(schema.field_schema(df)).first().quality_score == 1.0


def test_quartiles_equal_sorted_lists(spark):
    import random

    rng = random.Random(5)
    for size in (0, 1, 2, 3, 4, 7, 100, 3000):
        a = [rng.choice([None, rng.random() * 100, 1.0, -5.0]) for _ in range(size)]
        b = [float(k % 3) for k in range(size)]
        df = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(3)
        got = {r.column_name: [r.q25, r.median, r.q75] for r in profile.quartiles(df, {"a": F.col("a"), "b": F.col("b")}).collect()}
        for name, values in (("a", a), ("b", b)):
            x = sorted(v for v in values if v is not None)

            def at(q, x=x):
                place = q * (len(x) - 1)
                low = int(place)
                return x[low] + (x[min(low + 1, len(x) - 1)] - x[low]) * (place - low)

            assert got[name] == ([pytest.approx(at(q)) for q in (0.25, 0.5, 0.75)] if x else [None] * 3)
