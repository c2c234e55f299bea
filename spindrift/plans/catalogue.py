"""The named queries and, where SQL can say the same, the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import patterns as P
from ..operators import clean, health, privacy, profile, redact, schema, split, synth, validate
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a few places: sums of floating-point numbers depend on their order."""
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


def rounded_as_sql(df: DataFrame, places: int = 6) -> DataFrame:
    """As :func:`rounded`, with ties broken as the SQL's ``round`` does: by the double times a power of ten, not by its
    decimal digits, so that 0.0640625 becomes 0.064062."""
    scale = 10.0**places
    return df.withColumns({c: F.round(F.col(c) * scale) / scale for c, t in df.dtypes if t == "double"})


# ---- the derived healthcare table: one SELECT in the syntax that both engines share

HEALTH = """
SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'BAD' ELSE 'IQV' END || CAST(o_orderkey AS VARCHAR(20)) AS CLAIM_ID,
  CASE WHEN o_orderkey % 31 = 0 THEN 'X' ELSE 'M' END || CAST(o_custkey AS VARCHAR(20)) AS MEMBER_ID,
  CASE o_orderkey % 3 WHEN 0 THEN 'Inpatient' WHEN 1 THEN 'Outpatient' ELSE 'Pharmacy' END AS CLAIM_TYPE,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Emergny' WHEN o_orderkey % 7 = 1 THEN 'N/A' WHEN o_orderkey % 7 < 4 THEN 'Elective' ELSE 'Urgent' END AS ADMISSION_TYPE,
  CAST(NULL AS VARCHAR(10)) AS PROVIDER_ZIP,
  CASE o_orderkey % 4 WHEN 0 THEN 'Oncology' WHEN 1 THEN 'Cardiology' WHEN 2 THEN '' ELSE 'Pediatrics' END AS PROVIDER_SPECIALTY,
  CASE o_orderkey % 5 WHEN 0 THEN 'C50.9' WHEN 1 THEN 'M16.0' WHEN 2 THEN 'J45.909' WHEN 3 THEN 'bad' ELSE 'N/A' END AS DIAGNOSIS_CODE,
  CAST(99200 + o_orderkey % 300 AS VARCHAR(10)) AS PROCEDURE_CODE,
  CASE WHEN o_orderkey % 11 = 0 THEN -o_totalprice ELSE o_totalprice END AS TOTAL_CHARGE,
  CAST(o_orderkey % 50 - 2 AS DOUBLE) AS COPAY,
  CAST(o_orderkey % 13 AS DOUBLE) / 10 AS COINSURANCE,
  CASE o_orderkey % 3 WHEN 0 THEN 'Paid' WHEN 1 THEN 'Pending' ELSE 'Denied' END AS ADJUDICATION_STATUS,
  CAST(NULL AS VARCHAR(20)) AS ID, CAST(NULL AS VARCHAR(20)) AS LAST_NAME, CAST(NULL AS VARCHAR(10)) AS AGE, CAST(NULL AS VARCHAR(10)) AS GENDER,
  CAST(NULL AS VARCHAR(10)) AS DRG_CODE, CAST(NULL AS VARCHAR(10)) AS ICD9_PROCEDURE, CAST(NULL AS DOUBLE) AS CLAIM_COST, CAST(NULL AS VARCHAR(10)) AS STATUS
FROM {orders}
UNION ALL
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'IQV' ELSE 'CMS' END || CAST(c_custkey AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)),
  CASE WHEN c_custkey % 17 = 0 THEN '12' WHEN c_custkey % 17 = 1 THEN '' ELSE CAST(10000 + c_custkey AS VARCHAR(10)) END, CAST(NULL AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)),
  CAST(NULL AS VARCHAR(20)), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR(20)),
  'PT' || CAST(c_custkey AS VARCHAR(20)),
  CASE c_custkey % 5 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Garcia' WHEN 2 THEN 'Zyxel' WHEN 3 THEN 'James' ELSE '' END,
  CASE WHEN c_custkey % 19 = 0 THEN 'N/A' WHEN c_custkey % 19 = 1 THEN '45.0' ELSE CAST(c_custkey % 131 AS VARCHAR(10)) END,
  CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'Female' ELSE 'X' END,
  CAST(100 + c_custkey % 300 AS VARCHAR(10)), CAST(10 + c_custkey % 80 AS VARCHAR(10)) || '.5',
  CASE WHEN c_custkey % 9 = 0 THEN -c_acctbal ELSE c_acctbal END, 'Active'
FROM {customer}
"""
REPEATED = HEALTH + " UNION ALL SELECT * FROM (" + HEALTH + ") again WHERE ID LIKE 'PT%7'"
_SQL_HEALTH = "WITH health AS (" + HEALTH.format(orders="orders", customer="customer") + ") "
_FIELDS = (
    "CLAIM_ID MEMBER_ID CLAIM_TYPE ADMISSION_TYPE PROVIDER_ZIP PROVIDER_SPECIALTY DIAGNOSIS_CODE PROCEDURE_CODE TOTAL_CHARGE COPAY COINSURANCE ADJUDICATION_STATUS"
    " ID LAST_NAME AGE GENDER DRG_CODE ICD9_PROCEDURE CLAIM_COST STATUS"
).split()
_DOUBLES = ("TOTAL_CHARGE", "COPAY", "COINSURANCE", "CLAIM_COST")


def health_table(spark: SparkSession, sf_dir: str, sql: str = HEALTH) -> DataFrame:
    return spark.sql(sql, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def _sql_clean() -> str:
    """The cleaned health table as SQL."""
    cells = []
    for c in _FIELDS:
        x = c if c in _DOUBLES else f"CASE WHEN {c} NOT IN ('N/A', '', 'NULL', 'null') THEN {c} END"
        if c == "ADMISSION_TYPE":
            x = f"CASE WHEN {c} = 'Emergny' THEN 'Emergency' ELSE {x} END"
        if c in P.NUMERIC_FIELDS and c not in _DOUBLES:
            x = f"CASE WHEN regexp_matches(replace({c}, ',', ''), '{P.NUMBER}') THEN TRY_CAST(replace({c}, ',', '') AS DOUBLE) END"
        cells.append(f"{x} AS {c}")
    rules = {
        "CLAIM_ID": "CASE WHEN CLAIM_ID LIKE 'IQV%' OR CLAIM_ID LIKE 'CMS%' THEN CLAIM_ID END",
        "MEMBER_ID": "CASE WHEN MEMBER_ID LIKE 'M%' OR MEMBER_ID LIKE 'PT%' THEN MEMBER_ID END",
        "AGE": "CASE WHEN AGE BETWEEN 0 AND 120 THEN AGE END",
        "GENDER": "CASE WHEN GENDER IN ('M', 'F', 'Male', 'Female') THEN GENDER END",
        "COINSURANCE": "CASE WHEN COINSURANCE BETWEEN 0 AND 1 THEN COINSURANCE END",
    } | {c: f"CASE WHEN {c} >= 0 THEN {c} END" for c in ("TOTAL_CHARGE", "COPAY", "CLAIM_COST")}
    ruled = ", ".join(f"{rules.get(c, c)} AS {c}" for c in _FIELDS)
    flag = f"coalesce(regexp_matches(DIAGNOSIS_CODE, '{P.ICD_STRICT}'), false) AS DIAGNOSIS_CODE_VALID"
    return f"{_SQL_HEALTH[:-1]}, typed AS (SELECT {', '.join(cells)} FROM health), cleaned AS (SELECT {ruled}, {flag} FROM typed) "


_SQL_CLEAN = _sql_clean()


def _sql_long(tables: dict[str, list[str]], doubles: tuple[str, ...] = ()) -> str:
    """(column_name, value) of columns as text, as :func:`profile.frequencies` sees them."""
    text = lambda c: f"regexp_replace(printf('%.6f', CAST({c} AS DOUBLE)), '\\.?0+$', '')" if c in doubles else f"CAST({c} AS VARCHAR)"
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {text(c)} AS value FROM {t}" for t, some in tables.items() for c in some)


_SQL_NUMBER = f"CASE WHEN regexp_matches(replace(value, ',', ''), '{P.NUMBER}') THEN TRY_CAST(trim(replace(value, ',', '')) AS DOUBLE) END"


def _sql_any(column: str, some) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in some) + ")"


def _sql_profile(tables: dict[str, list[str]], doubles: tuple[str, ...] = ()) -> str:
    """CTEs long, classed, base (counts and hint), scored (with quality_score)."""
    dates = _sql_any("value", [f"^(?:{p})" for p in P.DATE_PREFIXES])
    patterns = ", ".join(f"count(*) FILTER (WHERE regexp_matches(value, '{p}')) AS {k}" for k, p in P.VALUE_PATTERNS.items())
    return f"""WITH long AS ({_sql_long(tables, doubles)}),
classed AS (SELECT column_name, value, {_SQL_NUMBER} AS x, {dates} AS is_date, {_sql_any("value", P.CURRENCY)} AS is_currency,
  lower(value) IN ({", ".join(f"'{b}'" for b in P.BOOLEANS)}) AS is_boolean FROM long),
counted AS (SELECT column_name, count(*) AS total_count, count(*) - count(value) AS null_count, count(value) AS non_null_count, count(DISTINCT value) AS unique_count,
  count(x) AS numbers, count(*) FILTER (WHERE x = floor(x)) AS integral, count(*) FILTER (WHERE x IS NULL AND is_currency) AS currency, count(*) FILTER (WHERE is_date) AS dates,
  count(*) FILTER (WHERE is_boolean) AS booleans, min(x) AS low, max(x) AS high, max(length(value)) AS longest, {patterns} FROM classed GROUP BY column_name),
base AS (SELECT *, null_count / total_count AS null_rate, unique_count / total_count AS cardinality_rate,
  CASE WHEN non_null_count = 0 THEN 'empty' WHEN numbers / non_null_count >= 0.8 THEN CASE WHEN integral > numbers - integral THEN 'integer' ELSE 'float' END
    WHEN currency / non_null_count >= 0.7 THEN 'currency' WHEN dates / non_null_count >= 0.7 THEN 'date' WHEN booleans / non_null_count >= 0.8 THEN 'boolean'
    WHEN unique_count / non_null_count <= 0.1 AND unique_count <= 50 THEN 'categorical' ELSE 'text' END AS data_type_hint FROM counted),
scored AS (SELECT *, greatest(0.0, least(1.0, 1.0::DOUBLE - null_rate * 0.3::DOUBLE - CASE WHEN cardinality_rate < 0.01 OR cardinality_rate > 0.95 THEN 0.2::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN data_type_hint IN ('integer', 'float', 'date', 'boolean') THEN 0.1::DOUBLE ELSE 0::DOUBLE END)) AS quality_score FROM base) """


# ---- profiles


def _sql_numeric(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
        round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, round((max({c}) - min({c}))::DOUBLE, 4) AS range, count(*) FILTER (WHERE {c} = 0) AS zeros,
        count(*) FILTER (WHERE {c} < 0) AS negatives, count(*) FILTER (WHERE {c} > 0) AS positives FROM {name}"""
        for c in columns
    )


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(_sql_numeric("lineitem", _LINE))
def profile_lineitem_numeric(spark, d):
    return rounded(profile.numeric_statistics(table(spark, d, "lineitem"), _LINE), 4)


@query(_sql_numeric("orders", ["o_totalprice", "o_custkey"]))
def profile_orders_numeric(spark, d):
    return rounded(profile.numeric_statistics(table(spark, d, "orders"), ["o_totalprice", "o_custkey"]), 4)


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_PART = ["p_name", "p_brand", "p_type", "p_size"]
_LONG_CUSTOMER = _sql_profile({"customer": _CUSTOMER}, ("c_acctbal",))
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_LONG_ORDERS = _sql_profile({"orders": _ORDERS}, ("o_totalprice",))


@query(_LONG_CUSTOMER + "SELECT column_name, total_count, null_count, non_null_count, unique_count, round(null_rate, 6) AS null_rate, round(cardinality_rate, 6) AS cardinality_rate FROM base")
def column_counts(spark, d):
    customer = table(spark, d, "customer")
    return rounded(profile.counts(profile.cells(customer), profile.distinct_counts(customer)))


@query()
def column_counts_approximate(spark, d):
    return profile.approximate_counts(table(spark, d, "lineitem"))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS avg_length, quantile_cont(length({c}), 0.5)::DOUBLE AS median_length,
        count(*) FILTER (WHERE {c} = '') AS empty_strings, count(*) FILTER (WHERE regexp_matches({c}, '\\d')) AS contains_digits,
        count(*) FILTER (WHERE regexp_matches({c}, '[^a-zA-Z0-9\\s]')) AS contains_special, count(*) FILTER (WHERE {c} = upper({c}) AND {c} <> lower({c})) AS all_uppercase,
        count(*) FILTER (WHERE {c} = lower({c}) AND {c} <> upper({c})) AS all_lowercase FROM part"""
        for c in ("p_name", "p_brand", "p_type")
    )
)
def profile_text_part(spark, d):
    return rounded(profile.text_statistics(table(spark, d, "part"), ["p_name", "p_brand", "p_type"]))


@query("SELECT 'text' AS column_name, min(length(text)) AS min_length, max(length(text)) AS max_length, round(avg(length(text)), 6) AS avg_length, quantile_cont(length(text), 0.5)::DOUBLE AS median_length FROM documents")
def profile_text_documents(spark, d):
    found = profile.text_statistics(table(spark, d, "documents"), ["text"])
    return rounded(found.select("column_name", "min_length", "max_length", "avg_length", "median_length"))


@query(
    """WITH y AS (SELECT year(o_orderdate) AS v, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT month(o_orderdate) AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT 'o_orderdate' AS column_name, strftime(min(o_orderdate), '%Y-%m-%d') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d') AS max_date,
  CAST(floor((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400) AS BIGINT) AS range_days, count(DISTINCT o_orderdate) AS unique_dates,
  (SELECT v FROM y ORDER BY n DESC, v LIMIT 1) AS most_common_year, (SELECT v FROM m ORDER BY n DESC, v LIMIT 1) AS most_common_month FROM orders"""
)
def profile_date_orders(spark, d):
    return profile.date_statistics(table(spark, d, "orders"), "o_orderdate")


@query(
    f"""WITH long AS ({_sql_long({"part": ["p_brand", "p_type"]})} UNION ALL {_sql_long({"events": ["event_type"]})}), f AS (SELECT column_name, value, count(*) AS n FROM long GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY column_name) AS total, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS a,
  row_number() OVER (PARTITION BY column_name ORDER BY n, value) AS z FROM f)
SELECT column_name, count(*) AS unique_categories, max(value) FILTER (WHERE a = 1) AS most_frequent, max(n) FILTER (WHERE a = 1) AS most_frequent_count,
  max(value) FILTER (WHERE z = 1) AS least_frequent, max(n) FILTER (WHERE z = 1) AS least_frequent_count, round(sum(-(n / total) * log2(n / total + 1e-10)), 6) AS entropy FROM t GROUP BY column_name"""
)
def profile_categorical_entropy(spark, d):
    freq = profile.frequencies(table(spark, d, "part"), ["p_brand", "p_type"]).unionByName(profile.frequencies(table(spark, d, "events"), ["event_type"]))
    return rounded(profile.entropy(freq))


@query(
    f"""WITH f AS (SELECT column_name, value, count(*) AS n FROM ({_sql_long({"part": _PART})}) GROUP BY ALL)
SELECT * FROM (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM f) WHERE rank <= 10"""
)
def top_values(spark, d):
    return profile.top_values(profile.frequencies(table(spark, d, "part"), _PART))


@query(_LONG_ORDERS + "SELECT column_name, data_type_hint FROM base")
def type_hints(spark, d):
    orders = table(spark, d, "orders")
    return profile.type_hints(profile.cells(orders, _ORDERS), profile.distinct_counts(orders, _ORDERS))


@query("SELECT 'text' AS column_name, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS {k}" for k, p in P.VALUE_PATTERNS.items()) + " FROM documents")
def pattern_counts(spark, d):
    return profile.pattern_counts(profile.cells(table(spark, d, "documents"), ["text"]))


@query(
    _LONG_CUSTOMER
    + f"""SELECT column_name, round(quality_score, 6) AS quality_score,
  (CASE WHEN null_rate > 0.5 THEN 1 ELSE 0 END) + (CASE WHEN cardinality_rate < 0.01 AND unique_count > 1 THEN 1 ELSE 0 END) + (CASE WHEN cardinality_rate > 0.95 AND total_count > 100 THEN 1 ELSE 0 END)
  + (CASE WHEN data_type_hint = 'text' AND ({" + ".join(P.VALUE_PATTERNS)}) BETWEEN 1 AND 0.8 * total_count - 0.0001 THEN 1 ELSE 0 END) AS n_issues FROM scored"""
)
def quality_scores(spark, d):
    return rounded(profile.profile_columns(table(spark, d, "customer")).select("column_name", "quality_score", F.size("issues").alias("n_issues")))


_SEEN = " + ".join(P.VALUE_PATTERNS)
_SQL_ISSUES = f"""issues AS (SELECT column_name, 'High null rate: ' || printf('%.1f', null_rate * 100) || '%' AS issue FROM scored WHERE null_rate > 0.5
  UNION ALL SELECT column_name, 'Very low cardinality - mostly duplicate values' FROM scored WHERE cardinality_rate < 0.01 AND unique_count > 1
  UNION ALL SELECT column_name, 'Very high cardinality - mostly unique values' FROM scored WHERE cardinality_rate > 0.95 AND total_count > 100
  UNION ALL SELECT column_name, 'Mixed data types detected' FROM scored WHERE data_type_hint = 'text' AND ({_SEEN}) > 0 AND ({_SEEN}) < 0.8 * total_count) """
_LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query(_sql_profile({"lineitem": _LINEITEM}, ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))[:-1] + f", {_SQL_ISSUES} SELECT * FROM issues")
def column_issues(spark, d):
    return profile.profile_columns(table(spark, d, "lineitem")).select("column_name", F.explode("issues").alias("issue"))


_SQL_ADVICE = """advice AS (SELECT 1 AS k, 'Consider handling high null rates in: ' AS t, list(column_name ORDER BY column_name) FILTER (WHERE null_rate > 0.3) AS v FROM scored
  UNION ALL SELECT 2, 'Potential ID columns detected: ', list(column_name ORDER BY column_name) FILTER (WHERE cardinality_rate > 0.95 AND data_type_hint IN ('integer', 'text')) FROM scored
  UNION ALL SELECT 3, 'Consider encoding categorical columns: ', list(column_name ORDER BY column_name) FILTER (WHERE data_type_hint = 'categorical' AND unique_count > 10) FROM scored)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS position, t || array_to_string(v[1:3], ', ') AS recommendation FROM advice WHERE len(v) > 0"""


@query(_LONG_ORDERS[:-1] + f", {_SQL_ADVICE}")
def profile_recommendations(spark, d):
    return profile.recommendations(profile.profile_columns(table(spark, d, "orders"), _ORDERS))


@query(
    _LONG_CUSTOMER[:-1]
    + f", {_SQL_ISSUES}"
    + """SELECT max(total_count) AS total_rows, count(*) AS total_columns, max(total_count) * count(*) AS total_cells, round(avg(null_rate), 6) AS avg_null_rate,
  round(avg(quality_score), 6) AS avg_quality_score, (SELECT count(DISTINCT column_name) FROM issues) AS columns_with_issues, count(*) FILTER (WHERE quality_score > 0.8) AS high_quality_columns FROM scored"""
)
def dataset_quality(spark, d):
    return rounded(profile.dataset_summary(profile.profile_columns(table(spark, d, "customer"))))


# ---- privacy

_TEXTS = {"documents": ["text"], "conversations": ["role"], "customer": ["c_name"]}


def _sql_families(tables: dict[str, list[str]]) -> str:
    sums = ", ".join(f"sum({' + '.join(f'''CAST(coalesce(regexp_matches(value, '{p}'), false) AS INT)''' for p in some)})::BIGINT AS {k}" for k, (_, _, some) in P.PII_FAMILIES.items())
    rows = " UNION ALL ".join(f"SELECT column_name, total, '{k}' AS family, {k} AS match_count, {t}::DOUBLE AS threshold, {w}::DOUBLE AS weight FROM wide" for k, (t, w, _) in P.PII_FAMILIES.items())
    return f"""WITH long AS ({_sql_long(tables)}), wide AS (SELECT column_name, count(*) AS total, {sums} FROM long GROUP BY column_name), rows AS ({rows}),
found AS (SELECT column_name, family, match_count, match_count / total AS match_rate, least(match_count / total / threshold, 1.0::DOUBLE) AS confidence, weight FROM rows WHERE match_count > 0),
families AS (SELECT *, CASE WHEN confidence >= 0.8 AND match_rate >= 0.7 THEN 'HIGH' WHEN confidence >= 0.6 AND match_rate >= 0.5 THEN 'MEDIUM'
  WHEN confidence >= 0.3 AND match_rate >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level FROM found) """


@query(_sql_families({"documents": ["text"], "customer": ["c_name"]}) + "SELECT column_name, family, match_count, round(match_rate, 6) AS match_rate, round(confidence, 6) AS confidence, risk_level, weight FROM families")
def pii_column_scan(spark, d):
    found = privacy.scan_in_place(table(spark, d, "documents"), ["text"]).unionByName(privacy.scan_in_place(table(spark, d, "customer"), ["c_name"]))
    return rounded_as_sql(found)


_PEOPLE = ["ID", "LAST_NAME", "AGE", "PROVIDER_ZIP", "DRG_CODE", "CLAIM_ID"]
_SQL_PEOPLE = _sql_families({"health": _PEOPLE}).replace("WITH ", _SQL_HEALTH[:-1] + ", ", 1)
_SQL_NAMES = f"""name_hits AS (SELECT column_name, count(*) AS total, count(*) FILTER (WHERE lower(value) IN ({", ".join(f"'{x}'" for x in P.FIRST_NAMES)})) AS first_name_matches,
  count(*) FILTER (WHERE lower(value) IN ({", ".join(f"'{x}'" for x in P.LAST_NAMES)})) AS last_name_matches FROM long GROUP BY column_name),
names AS (SELECT column_name, first_name_matches, last_name_matches, first_name_matches / total AS first_name_rate, last_name_matches / total AS last_name_rate,
  round(least(1.0::DOUBLE, CASE WHEN {" OR ".join(f"lower(column_name) LIKE '%{w}%'" for w in P.NAME_COLUMN_HINTS)} THEN 0.3::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN first_name_matches / total > 0.3 THEN 0.4::DOUBLE ELSE 0::DOUBLE END + CASE WHEN last_name_matches / total > 0.3 THEN 0.4::DOUBLE ELSE 0::DOUBLE END), 6) AS confidence FROM name_hits)"""


@query(
    f"""{_SQL_HEALTH[:-1]}, long AS (SELECT 'LAST_NAME' AS column_name, LAST_NAME AS value FROM health WHERE ID IS NOT NULL), {_SQL_NAMES}
SELECT column_name, first_name_matches, last_name_matches, round(first_name_rate, 6) AS first_name_rate, round(last_name_rate, 6) AS last_name_rate, confidence FROM names WHERE confidence > 0.5"""
)
def pii_names(spark, d):
    people = health_table(spark, d).filter("ID IS NOT NULL")
    found = privacy.scan_names(profile.cells(people, ["LAST_NAME"]))
    return rounded(found.select("column_name", "first_name_matches", "last_name_matches", "first_name_rate", "last_name_rate", "confidence"))


_SQL_SCORES = f"""{_SQL_PEOPLE[:-1]}, {_SQL_NAMES}, every AS (SELECT column_name, family, confidence, weight FROM families UNION ALL SELECT column_name, 'names', confidence, {P.NAMES_WEIGHT}::DOUBLE FROM names WHERE confidence > 0.5),
scores AS (SELECT c.column_name, count(family) AS n_families, least(coalesce(sum(weight * confidence) / sum(weight), 0::DOUBLE), 1.0::DOUBLE) AS overall_risk_score
  FROM (SELECT DISTINCT column_name FROM long) c LEFT JOIN every USING (column_name) GROUP BY c.column_name) """


def _people_scores(spark, d):
    people = health_table(spark, d)
    found = privacy.detect(profile.cells(people, _PEOPLE))
    return privacy.column_scores(found, privacy.names_of(people, _PEOPLE)), found


@query(_SQL_SCORES + "SELECT column_name, n_families, round(overall_risk_score, 6) AS overall_risk_score FROM scores")
def pii_risk_scores(spark, d):
    return rounded(_people_scores(spark, d)[0].drop("recommendations"))


@query(
    _SQL_SCORES
    + """SELECT *, CASE WHEN high_risk_columns > 0 THEN 'HIGH' WHEN medium_risk_columns > 0 THEN 'MEDIUM' WHEN columns_with_pii > 0 THEN 'LOW' ELSE 'MINIMAL' END AS overall_risk FROM (
SELECT count(*) AS total_columns, count(*) FILTER (WHERE n_families > 0) AS columns_with_pii, count(*) FILTER (WHERE overall_risk_score >= 0.8) AS high_risk_columns,
  count(*) FILTER (WHERE overall_risk_score >= 0.6 AND overall_risk_score < 0.8) AS medium_risk_columns, count(*) FILTER (WHERE overall_risk_score >= 0.3 AND overall_risk_score < 0.6) AS low_risk_columns FROM scores)"""
)
def pii_dataset_summary(spark, d):
    return privacy.dataset_summary(_people_scores(spark, d)[0])


_SQL_SUMMARY = """summary AS (SELECT *, CASE WHEN high_risk_columns > 0 THEN 'HIGH' WHEN medium_risk_columns > 0 THEN 'MEDIUM' WHEN columns_with_pii > 0 THEN 'LOW' ELSE 'MINIMAL' END AS overall_risk FROM (
SELECT count(*) AS total_columns, count(*) FILTER (WHERE n_families > 0) AS columns_with_pii, count(*) FILTER (WHERE overall_risk_score >= 0.8) AS high_risk_columns,
  count(*) FILTER (WHERE overall_risk_score >= 0.6 AND overall_risk_score < 0.8) AS medium_risk_columns, count(*) FILTER (WHERE overall_risk_score >= 0.3 AND overall_risk_score < 0.6) AS low_risk_columns FROM scores))"""
_in = lambda words: ", ".join(f"'{w}'" for w in words)
_SQL_NOTES = f"""{_SQL_SUMMARY}, urgent AS (SELECT list(column_name ORDER BY column_name)[1:5] AS v FROM scores WHERE overall_risk_score >= 0.8),
kinds AS (SELECT list(DISTINCT family ORDER BY family) FILTER (WHERE family IN ({_in(P.HIPAA_FAMILIES)}) AND confidence > 0.6) AS hipaa, coalesce(bool_or(family IN ({_in(P.FINANCIAL_FAMILIES)})), false) AS financial FROM every),
notes AS (SELECT summary.*, concat_ws(' | ', CASE WHEN high_risk_columns > 0 THEN 'URGENT: ' || high_risk_columns || ' columns contain high-risk PII requiring immediate attention' END,
    CASE WHEN medium_risk_columns > 0 THEN 'IMPORTANT: ' || medium_risk_columns || ' columns contain medium-risk PII requiring masking' END,
    CASE WHEN columns_with_pii > 0.5 * total_columns THEN 'Dataset contains significant PII - consider comprehensive data anonymization' END,
    CASE WHEN len(v) > 0 THEN 'Priority columns for masking: ' || array_to_string(v, ', ') END) AS priority_actions,
  concat_ws(' | ', CASE WHEN len(hipaa) > 0 THEN 'HIPAA Compliance: Detected healthcare identifiers (' || array_to_string(hipaa, ', ') || ')' END,
    CASE WHEN len(hipaa) > 0 THEN 'Consider HIPAA Safe Harbor de-identification requirements' END,
    CASE WHEN financial THEN 'PCI DSS Compliance: Financial data detected - ensure proper encryption and access controls' END) AS compliance_notes FROM summary, urgent, kinds) """


def _joined(df: DataFrame, *names: str) -> DataFrame:
    """Lists as one text each."""
    return df.withColumns({c: F.array_join(c, " | ") for c in names})


@query(_SQL_SCORES[:-1] + f", {_SQL_NOTES} SELECT * FROM notes")
def pii_dataset_notes(spark, d):
    return _joined(privacy.dataset_notes(*_people_scores(spark, d)), "priority_actions", "compliance_notes")


@query(
    f"""{_SQL_HEALTH[:-1]}, long AS ({_sql_long({"documents": ["source", "lang"], "health": ["CLAIM_ID"]})}), f AS (SELECT DISTINCT column_name, value FROM long WHERE {_sql_any("value", P.PII_FAMILIES["mrn"][2])})
SELECT column_name, string_agg(value, ' | ' ORDER BY value) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS r FROM f) WHERE r <= 5 GROUP BY column_name"""
)
def pii_samples(spark, d):
    return _joined(privacy.samples(profile.frequencies(table(spark, d, "documents"), ["source", "lang"]).unionByName(profile.frequencies(health_table(spark, d), ["CLAIM_ID"])), "mrn"), "samples")


_PHI_WORDS = [w for some in P.PHI_KEYWORDS.values() for w in some]


def _sql_confidence() -> str:
    cells = []
    for c in _FIELDS:
        low, text = c.lower(), c not in _DOUBLES
        share = lambda cond, c=c: f"coalesce(count(*) FILTER (WHERE {cond}) / nullif(count({c}), 0), 0)"
        pii = [f"CASE WHEN {x} > 0.1 THEN {x} ELSE 0 END" for x in ([f"greatest({', '.join(share(_sql_any(c, some)) for some in P.PIPELINE_PII.values())})"] if text else [])]
        pii += [share(_sql_any(c, P.PIPELINE_NAMES))] if "name" in low else []
        pii += ["0.9"] if E.name_has(c, P.PII_KEYWORDS) else []
        phi = ["0.85"] if E.name_has(c, _PHI_WORDS) else []
        phi += ["0.8"] if "date" in low and E.name_has(c, P.PHI_DATE_TERMS) else []
        phi += [f"CASE WHEN {share(_sql_any(c, [P.PIPELINE_MRN]))} > 0.3 THEN 0.9 ELSE 0 END", f"CASE WHEN {share(_sql_any(c, [P.PIPELINE_ICD]))} > 0.2 THEN 0.85 ELSE 0 END"] if text else []
        cells.append(f"SELECT '{c}' AS column_name, round(greatest(0::DOUBLE, {', '.join(pii) or '0'})::DOUBLE, 3) AS pii_confidence, round(greatest(0::DOUBLE, {', '.join(phi) or '0'})::DOUBLE, 3) AS phi_confidence FROM health HAVING count(*) >= 0")
    return f"{_SQL_HEALTH[:-1]}, confidence AS ({' UNION ALL '.join(cells)}) "


_SQL_CONFIDENCE = _sql_confidence()


@query(_SQL_CONFIDENCE + "SELECT *, pii_confidence >= 0.8 AS is_pii, phi_confidence >= 0.9 AS is_phi FROM confidence")
def pipeline_flags(spark, d):
    return privacy.flagged(privacy.pipeline_confidence(health_table(spark, d)))


@query(
    _SQL_CONFIDENCE
    + """SELECT *, CASE WHEN pii_fields + phi_fields = 0 THEN 'NONE' WHEN pii_fields + phi_fields <= 2 THEN 'LOW' WHEN pii_fields + phi_fields <= 5 THEN 'MEDIUM' WHEN pii_fields + phi_fields <= 10 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
FROM (SELECT count(*) AS total_fields, count(*) FILTER (WHERE pii_confidence >= 0.8) AS pii_fields, count(*) FILTER (WHERE phi_confidence >= 0.9) AS phi_fields FROM confidence)"""
)
def risk_band(spark, d):
    return privacy.pipeline_summary(privacy.flagged(privacy.pipeline_confidence(health_table(spark, d))))


@query(
    "SELECT * FROM (VALUES ('PII', 'CLAIM_ID', 0.95::DOUBLE), ('PII', 'MEMBER_ID', 0.95::DOUBLE), ('PII', 'ID', 0.95::DOUBLE), ('PII', 'LAST_NAME', 0.98::DOUBLE), ('PII', 'AGE', 0.9::DOUBLE), ('PII', 'PROVIDER_ZIP', 0.85::DOUBLE),"
    " ('PHI', 'DIAGNOSIS_CODE', 0.95::DOUBLE), ('PHI', 'PROCEDURE_CODE', 0.9::DOUBLE), ('PHI', 'DRG_CODE', 0.85::DOUBLE), ('PHI', 'ICD9_PROCEDURE', 0.9::DOUBLE)) AS t(kind, column_name, confidence)"
)
def declared_fields(spark, d):
    return privacy.declared_fields(health_table(spark, d))


# ---- masking and cleaning

_MASKED = "SELECT {key}, {name} AS contact_name, {name} AS ssn_no, {name} AS email_addr, {name} AS phone_no, {name} AS city, {name} AS condition_code, {name} AS drug_code, {name} AS doctor_id, {name} AS mrn_no FROM {table}"


@query(
    f"""WITH t AS ({_MASKED.format(key="c_custkey", name="CASE WHEN c_custkey % 5 > 0 THEN c_name END", table="customer")}) SELECT c_custkey, CASE WHEN contact_name IS NOT NULL THEN 'MASKED_NAME' END AS contact_name, CASE WHEN ssn_no IS NOT NULL THEN 'XXX-XX-XXXX' END AS ssn_no,
  CASE WHEN email_addr IS NOT NULL THEN 'masked@email.com' END AS email_addr, CASE WHEN phone_no IS NOT NULL THEN 'XXX-XXX-XXXX' END AS phone_no, CASE WHEN city IS NOT NULL THEN 'MASKED_PII' END AS city,
  CASE WHEN condition_code IS NOT NULL THEN 'MASKED_DIAGNOSIS' END AS condition_code, CASE WHEN drug_code IS NOT NULL THEN 'MASKED_MEDICATION' END AS drug_code, CASE WHEN doctor_id IS NOT NULL THEN 'MASKED_PROVIDER' END AS doctor_id,
  CASE WHEN mrn_no IS NOT NULL THEN 'MRN_MASKED' END AS mrn_no FROM t"""
)
def mask_every_kind(spark, d):
    named = spark.sql(_MASKED.format(key="c_custkey", name="CASE WHEN c_custkey % 5 > 0 THEN c_name END", table="{customer}"), customer=table(spark, d, "customer"))
    return redact.mask(named, pii=["contact_name", "ssn_no", "email_addr", "phone_no", "city"], phi=["condition_code", "drug_code", "doctor_id", "mrn_no"])



@query(_SQL_HEALTH + "SELECT CLAIM_ID, ID, CASE WHEN LAST_NAME IS NOT NULL THEN 'MASKED_NAME' END AS LAST_NAME, CASE WHEN PROVIDER_ZIP IS NOT NULL THEN 'MASKED_PII' END AS PROVIDER_ZIP FROM health")
def mask_pii(spark, d):
    return redact.mask(health_table(spark, d), pii=["LAST_NAME", "PROVIDER_ZIP"]).select("CLAIM_ID", "ID", "LAST_NAME", "PROVIDER_ZIP")


@query(
    _SQL_HEALTH
    + """SELECT CLAIM_ID, CASE WHEN DIAGNOSIS_CODE IS NOT NULL THEN 'MASKED_DIAGNOSIS' END AS DIAGNOSIS_CODE, CASE WHEN PROVIDER_SPECIALTY IS NOT NULL THEN 'MASKED_PROVIDER' END AS PROVIDER_SPECIALTY,
  CASE WHEN DRG_CODE IS NOT NULL THEN 'MASKED_PHI' END AS DRG_CODE FROM health"""
)
def mask_phi(spark, d):
    return redact.mask(health_table(spark, d), pii=["DIAGNOSIS_CODE"], phi=["DIAGNOSIS_CODE", "PROVIDER_SPECIALTY", "DRG_CODE"]).select("CLAIM_ID", "DIAGNOSIS_CODE", "PROVIDER_SPECIALTY", "DRG_CODE")


_SQL_REDACTED = (
    _SQL_HEALTH[:-1]
    + """, aged AS (SELECT *, CASE WHEN regexp_matches(AGE, '^\\s*[+-]?\\d+\\s*$') THEN TRY_CAST(AGE AS BIGINT) END AS years FROM health),
redacted AS (SELECT CLAIM_ID, MEMBER_ID, ID, CASE WHEN LAST_NAME IS NOT NULL THEN '[REDACTED_NAME]' END AS LAST_NAME,
  CASE WHEN AGE IS NOT NULL THEN CASE WHEN years < 18 THEN 'Under_18' WHEN years < 30 THEN '18-29' WHEN years < 50 THEN '30-49' WHEN years < 70 THEN '50-69' WHEN years >= 70 THEN '70_Plus' ELSE '[REDACTED_AGE]' END END AS AGE,
  CASE WHEN PROVIDER_ZIP IS NOT NULL THEN CASE WHEN length(PROVIDER_ZIP) >= 3 THEN substr(PROVIDER_ZIP, 1, 3) || 'XX' ELSE '[REDACTED_ZIP]' END END AS PROVIDER_ZIP, DIAGNOSIS_CODE FROM aged) """
)


@query(_SQL_REDACTED + "SELECT * FROM redacted")
def redact_rows(spark, d):
    return redact.redact(health_table(spark, d)).select("CLAIM_ID", "MEMBER_ID", "ID", "LAST_NAME", "AGE", "PROVIDER_ZIP", "DIAGNOSIS_CODE")


@query(_SQL_REDACTED + "SELECT AGE AS bucket, count(*) AS n FROM redacted GROUP BY AGE")
def age_buckets(spark, d):
    return redact.redact(health_table(spark, d)).groupBy(F.col("AGE").alias("bucket")).agg(F.count("*").alias("n"))


@query(_SQL_REDACTED + "SELECT PROVIDER_ZIP AS zip, count(*) AS n FROM redacted GROUP BY PROVIDER_ZIP")
def zip_truncate(spark, d):
    return redact.redact(health_table(spark, d)).groupBy(F.col("PROVIDER_ZIP").alias("zip")).agg(F.count("*").alias("n"))


@query(_SQL_CLEAN + f"SELECT {', '.join(_FIELDS)}, DIAGNOSIS_CODE_VALID FROM cleaned")
def clean_health_rows(spark, d):
    return clean.clean_health(health_table(spark, d))


@query(_SQL_CLEAN + "SELECT DIAGNOSIS_CODE AS code, DIAGNOSIS_CODE_VALID AS valid, count(*) AS n FROM cleaned GROUP BY ALL")
def dx_valid_flags(spark, d):
    cleaned = clean.clean_health(health_table(spark, d))
    return cleaned.groupBy(F.col("DIAGNOSIS_CODE").alias("code"), F.col("DIAGNOSIS_CODE_VALID").alias("valid")).agg(F.count("*").alias("n"))


@query(_SQL_HEALTH + "SELECT CLAIM_ID, CASE WHEN upper(ADMISSION_TYPE) NOT IN ('N/A', 'NA', 'NULL', 'NONE', '') THEN ADMISSION_TYPE END AS ADMISSION_TYPE, CASE WHEN upper(LAST_NAME) NOT IN ('N/A', 'NA', 'NULL', 'NONE', '') THEN LAST_NAME END AS LAST_NAME FROM health")
def json_safe(spark, d):
    return clean.json_safe(health_table(spark, d)).select("CLAIM_ID", "ADMISSION_TYPE", "LAST_NAME")


# ---- splits and links

_SQL_CLAIM = "MEMBER_ID IS NOT NULL AND MEMBER_ID <> ''"


@query(_SQL_HEALTH + f"SELECT {', '.join(P.CLAIM_PROJECTION)} FROM health WHERE {_SQL_CLAIM}")
def split_claims(spark, d):
    return split.split_by_identifier(health_table(spark, d))[0]


@query(_SQL_HEALTH + f"SELECT {', '.join(P.PATIENT_PROJECTION)} FROM health WHERE NOT coalesce({_SQL_CLAIM}, false) AND ID IS NOT NULL AND ID <> ''")
def split_demographics(spark, d):
    return split.split_by_identifier(health_table(spark, d))[1]


def _sql_filled(columns) -> str:
    return "(" + " OR ".join(f"{c} IS NOT NULL" for c in columns) + ")"


@query(_SQL_CLEAN + f"SELECT 'claims' AS side, count(*) AS n FROM cleaned WHERE {_sql_filled(P.CLAIM_FIELDS)} UNION ALL SELECT 'patients', count(*) FROM cleaned WHERE {_sql_filled(P.PATIENT_FIELDS)} UNION ALL SELECT 'union', count(*) FROM cleaned WHERE {_sql_filled(P.CLAIM_FIELDS + P.PATIENT_FIELDS)}")
def split_mixed(spark, d):
    cleaned = clean.clean_health(health_table(spark, d))
    claims, people = split.split_mixed(cleaned)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("side"), "n") for k, df in (("claims", claims), ("patients", people), ("union", split.union_once(cleaned)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_SQL_HEALTH + "SELECT count(*) FILTER (WHERE NOT coalesce(LAST_NAME <> '', false)) AS claims_records, count(*) FILTER (WHERE LAST_NAME <> '') AS patient_records FROM health")
def split_by_name(spark, d):
    return split.count_by_name(health_table(spark, d))


def _linked(spark, d, how):
    claims, people = split.split_by_identifier(health_table(spark, d))
    left = people.select("CLAIM_ID", "ID", "AGE")
    right = claims.select("CLAIM_ID", "MEMBER_ID", "TOTAL_CHARGE")
    return left.join(right, "CLAIM_ID", how)


_SQL_SIDES = _SQL_HEALTH[:-1] + f", claims AS (SELECT CLAIM_ID, MEMBER_ID, TOTAL_CHARGE FROM health WHERE {_SQL_CLAIM}), people AS (SELECT CLAIM_ID, ID, AGE FROM health WHERE MEMBER_ID IS NULL AND ID <> '') "


@query(_SQL_SIDES + "SELECT CLAIM_ID, ID, AGE, MEMBER_ID, TOTAL_CHARGE FROM people JOIN claims USING (CLAIM_ID)")
def claims_by_link_key(spark, d):
    return _linked(spark, d, "inner")


@query(_SQL_SIDES + "SELECT CLAIM_ID, ID, AGE, MEMBER_ID, TOTAL_CHARGE FROM people LEFT JOIN claims USING (CLAIM_ID)")
def claims_by_link_key_left(spark, d):
    return _linked(spark, d, "left")


@query(_SQL_SIDES + "SELECT * FROM people WHERE CLAIM_ID IN (SELECT CLAIM_ID FROM claims)")
def claims_by_link_key_semi(spark, d):
    return _linked(spark, d, "left_semi")


@query(_SQL_SIDES + "SELECT * FROM people p WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.CLAIM_ID = p.CLAIM_ID)")
def claims_by_link_key_anti(spark, d):
    return _linked(spark, d, "left_anti")


@query()
def sample_rows(spark, d):
    return split.sample_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("/", "l_orderkey", "l_linenumber").alias("k")), "k", 1000)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5")
def preview(spark, d):
    return split.preview(table(spark, d, "customer"), "c_custkey").select("c_custkey", "c_name")


# ---- health summaries


@query(_SQL_CLEAN + " UNION ALL ".join(f"SELECT '{c}' AS field, round(count({c}) / count(*), 3) AS completeness FROM cleaned" for c in _FIELDS))
def field_completeness(spark, d):
    return health.field_completeness(clean.clean_health(health_table(spark, d)))


@query(
    "WITH health AS (" + REPEATED.format(orders="orders", customer="customer") + f") SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_records FROM (SELECT count(*) AS n FROM health GROUP BY {', '.join(_FIELDS)})"
)
def duplicate_rows(spark, d):
    return health.duplicate_rows(health_table(spark, d, REPEATED))


@query(
    _SQL_CLEAN.replace(HEALTH.format(orders="orders", customer="customer"), REPEATED.format(orders="orders", customer="customer"), 1)
    + f"""SELECT (SELECT count(*) FROM health) AS total_records, (SELECT count(*) FROM cleaned WHERE {_sql_filled(P.CLAIM_FIELDS)}) AS claims_records,
  (SELECT count(*) FROM cleaned WHERE {_sql_filled(P.PATIENT_FIELDS)}) AS patient_records, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM health GROUP BY {', '.join(_FIELDS)})) AS duplicate_records,
  (SELECT round(0.4 * ({" + ".join(f"count({c})" for c in _FIELDS)} + count(*)) / (count(*) * {len(_FIELDS) + 1}) + 0.4 * avg(DIAGNOSIS_CODE_VALID::INT) + 0.2 * 0.9, 3) FROM cleaned) AS data_quality_score"""
)
def health_summary(spark, d):
    df = health_table(spark, d, REPEATED)
    return health.summary(df, clean.clean_health(df)).drop("issues_found")


_SQL_REPEATED_CLEAN = _SQL_CLEAN.replace(HEALTH.format(orders="orders", customer="customer"), REPEATED.format(orders="orders", customer="customer"), 1)


@query(
    _SQL_REPEATED_CLEAN
    + f"""SELECT issue FROM (SELECT CASE WHEN (SELECT {" + ".join(f"count(*) - count({c})" for c in _FIELDS)} FROM health) <> (SELECT {" + ".join(f"count(*) - count({c})" for c in _FIELDS)} FROM cleaned) THEN 'Missing values standardized' END AS issue
UNION ALL SELECT CASE WHEN n > 0 THEN n || ' duplicate records found' END FROM (SELECT CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM health GROUP BY {', '.join(_FIELDS)}))
UNION ALL SELECT CASE WHEN n > 0 THEN n || ' invalid diagnosis codes' END FROM (SELECT count(*) AS n FROM cleaned WHERE NOT DIAGNOSIS_CODE_VALID)
UNION ALL SELECT CASE WHEN n > 0 THEN n || ' invalid age values' END FROM (SELECT (SELECT count(*) FROM cleaned WHERE AGE IS NULL) - (SELECT count(*) FROM health WHERE AGE IS NULL) AS n)) WHERE issue IS NOT NULL"""
)
def health_issues(spark, d):
    df = health_table(spark, d, REPEATED)
    return health.summary(df, clean.clean_health(df)).select(F.explode("issues_found").alias("issue"))


# ---- schema inference

_SQL_TYPE = """CASE WHEN data_type_hint = 'empty' THEN 'TEXT'
  WHEN data_type_hint = 'integer' THEN CASE WHEN low >= -128 AND high <= 127 THEN 'TINYINT' WHEN low >= -32768 AND high <= 32767 THEN 'SMALLINT' WHEN low >= -2147483648 AND high <= 2147483647 THEN 'INTEGER' ELSE 'BIGINT' END
  WHEN data_type_hint IN ('float', 'currency') THEN 'DECIMAL(10,2)' WHEN data_type_hint = 'date' THEN 'DATE' WHEN data_type_hint = 'boolean' THEN 'BOOLEAN'
  WHEN data_type_hint = 'categorical' THEN CASE WHEN unique_count <= 10 AND longest <= 50 THEN 'ENUM' ELSE 'VARCHAR(' || greatest(longest, 50) || ')' END
  WHEN longest <= 50 THEN 'VARCHAR(50)' WHEN longest <= 255 THEN 'VARCHAR(' || longest || ')' WHEN longest <= 65535 THEN 'TEXT' ELSE 'LONGTEXT' END"""
_SQL_KEYS = """round(CASE WHEN cardinality_rate >= 0.95 THEN 0.4 ELSE 0 END + CASE WHEN null_rate = 0 THEN 0.3 ELSE 0 END + CASE WHEN data_type_hint IN ('integer', 'text') THEN 0.2 ELSE 0 END + CASE WHEN quality_score > 0.8 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS pk_score,
  round(CASE WHEN regexp_matches(lower(column_name), '_id|id|_key|ref') THEN 0.3 ELSE 0 END + CASE WHEN cardinality_rate BETWEEN 0.1 AND 0.8 THEN 0.2 ELSE 0 END + CASE WHEN data_type_hint IN ('integer', 'text') THEN 0.2 ELSE 0 END
  + CASE WHEN null_rate < 0.1 THEN 0.2 ELSE 0 END + CASE WHEN quality_score > 0.7 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS fk_score"""


@query(_LONG_ORDERS + f"SELECT column_name, {_SQL_TYPE} AS sql_type FROM scored")
def sql_type_map(spark, d):
    return schema.infer(table(spark, d, "orders"), _ORDERS).select("column_name", "sql_type")


@query(_LONG_CUSTOMER + f"SELECT column_name, {_SQL_TYPE} AS sql_type FROM scored")
def sql_type_map_customer(spark, d):
    return schema.infer(table(spark, d, "customer")).select("column_name", "sql_type")


@query(_LONG_CUSTOMER + f"SELECT *, pk_score >= 0.7 AS pk_candidate, fk_score >= 0.6 AS fk_candidate FROM (SELECT column_name, {_SQL_KEYS} FROM scored)")
def key_candidates(spark, d):
    return schema.key_scores(profile.profile_columns(table(spark, d, "customer")))


@query(
    _LONG_CUSTOMER
    + """SELECT column_name, 'not_null' AS kind FROM scored WHERE null_rate = 0 AND total_count > 10
UNION ALL SELECT column_name, 'unique' FROM scored WHERE cardinality_rate = 1 AND total_count <= 10000 AND (SELECT count(*) FROM scored) <= 10"""
)
def constraint_table(spark, d):
    return schema.constraint_table(profile.profile_columns(table(spark, d, "customer")))


@query(
    _LONG_ORDERS
    + f"""SELECT coalesce(string_agg(column_name, ' | ' ORDER BY column_name) FILTER (WHERE fk_score >= 0.6), '') AS foreign_keys,
  CASE WHEN count(*) FILTER (WHERE data_type_hint = 'categorical' AND unique_count BETWEEN 5 AND 100) >= 2 THEN string_agg(column_name, ' | ' ORDER BY column_name) FILTER (WHERE data_type_hint = 'categorical' AND unique_count BETWEEN 5 AND 100) ELSE '' END AS hierarchy
FROM (SELECT *, {_SQL_KEYS} FROM scored)"""
)
def schema_relationships(spark, d):
    return _joined(schema.relationships(schema.infer(table(spark, d, "orders"), _ORDERS)), "foreign_keys", "hierarchy")


@query(
    _SQL_HEALTH[:-1]
    + f""", long AS ({_sql_long({"health": ["DIAGNOSIS_CODE", "PROCEDURE_CODE", "CLAIM_ID"]})}) SELECT column_name, {", ".join(f"count(*) FILTER (WHERE regexp_matches(value, '{p}')) / count(value) > 0.7 AS {k}" for k, p in P.MEDICAL.items())},
  regexp_matches(lower(column_name), 'id|key|identifier') AS likely_identifier, regexp_matches(lower(column_name), 'name|title|description') AS likely_name_field,
  regexp_matches(lower(column_name), 'date|time|created|updated') AS likely_temporal FROM long GROUP BY column_name"""
)
def special_patterns(spark, d):
    return schema.special_patterns(profile.cells(health_table(spark, d), ["DIAGNOSIS_CODE", "PROCEDURE_CODE", "CLAIM_ID"]))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, min({c}) >= 0 AS non_negative, count(*) FILTER (WHERE {c} = 0) = 0 AS non_zero,
    min({c}) >= 0 AND max({c}) <= 150 AS likely_age, min({c}) >= 0 AND max({c}) <= 100 AS likely_percentage, min({c}) >= 1900 AND max({c}) <= 2030 AS likely_year FROM lineitem"""
        for c in _LINE
    )
)
def numeric_constraints(spark, d):
    return schema.numeric_constraints(profile.numeric_statistics(table(spark, d, "lineitem"), _LINE))


_FLAGS = {
    "words": ("Yes", "no"), "letters": ("Y", "n"), "digits": ("1", "0"), "logic": ("True", "false"), "other": ("A", "yes"),
}
_FLAGGED = "SELECT " + ", ".join(f"CASE WHEN l_linenumber = 7 THEN CAST(NULL AS VARCHAR(5)) WHEN l_returnflag = 'N' THEN '{a}' ELSE '{b}' END AS {k}" for k, (a, b) in _FLAGS.items()) + ", l_returnflag FROM {lines}"
_SQL_WITHIN = lambda a, b: f"bool_and(v IN ('{a}', '{b}'))"


@query(
    f"""WITH flags AS ({_FLAGGED.format(lines="lineitem")}), long AS ({_sql_long({"flags": [*_FLAGS, "l_returnflag"]})})
SELECT column_name, count(*) FILTER (WHERE v IN ('true', '1', 'yes', 'y')) AS true_count, count(*) FILTER (WHERE v IN ('false', '0', 'no', 'n')) AS false_count,
  CASE WHEN {_SQL_WITHIN('true', 'false')} THEN 'true/false' WHEN {_SQL_WITHIN('1', '0')} THEN '1/0' WHEN {_SQL_WITHIN('yes', 'no')} THEN 'yes/no' WHEN {_SQL_WITHIN('y', 'n')} THEN 'y/n' ELSE 'mixed' END AS representation
FROM (SELECT column_name, lower(value) AS v FROM long) GROUP BY column_name"""
)
def boolean_columns(spark, d):
    return schema.boolean_columns(profile.cells(spark.sql(_FLAGGED, lines=table(spark, d, "lineitem"))))


_SCALED = """SELECT o_orderpriority, o_orderstatus, CASE o_orderkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'medium' ELSE 'odd' END AS level, CASE o_orderkey % 3 WHEN 0 THEN '1st' WHEN 1 THEN '2nd' ELSE '3rd place' END AS place FROM {orders}"""
_SQL_SCALE = " OR ".join(f"list_has_all(v, [{', '.join(f"'{x}'" for x in scale)}])" for scale in P.ORDINAL_SCALES)


@query(
    f"""WITH scaled AS ({_SCALED.format(orders="orders")}), long AS ({_sql_long({"scaled": ["o_orderpriority", "o_orderstatus", "level", "place"]})}),
f AS (SELECT column_name, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL), top AS (SELECT column_name, value FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM f) WHERE r <= 10),
sets AS (SELECT column_name, list(DISTINCT lower(value)) AS v, bool_and(regexp_matches(lower(value), '^[0-9]+(st|nd|rd|th)')) AS ranked FROM top GROUP BY column_name) SELECT column_name, {_SQL_SCALE} OR ranked AS is_ordinal FROM sets"""
)
def ordinal_columns(spark, d):
    return schema.ordinal_columns(profile.frequencies(spark.sql(_SCALED, orders=table(spark, d, "orders"))))


@query(
    f"""WITH f AS (SELECT column_name, value, count(*) AS n FROM ({_sql_long({"orders": ["o_orderstatus", "o_orderpriority"]})}) GROUP BY ALL)
SELECT column_name, value, n, round(n / sum(n) OVER (PARTITION BY column_name), 4) AS frequency FROM f"""
)
def category_frequencies(spark, d):
    return schema.category_frequencies(profile.frequencies(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


def _sql_fields() -> str:
    """CTE fields: the health table's fields without hints, as the pipeline infers them."""
    named = {c: schema.named_type(c) or ("float" if c in _DOUBLES else None) for c in _FIELDS}
    known = " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in named.items() if k)
    context = " ".join(f"WHEN {' OR '.join(f"lower(column_name) LIKE '%{w}%'" for w in words)} THEN '{k}'" for k, words in P.HEALTH_CONTEXT.items())
    return f"""{_SQL_HEALTH[:-1]}, long AS ({_sql_long({"health": _FIELDS}, _DOUBLES)}),
typed AS (SELECT *, {_SQL_NUMBER} AS x, {_sql_any("value", P.DATE_PREFIXES)} AS dated, lower(value) IN ({", ".join(f"'{b}'" for b in P.BOOLEANS)}) AS truth, regexp_replace(value, '[$,]', '', 'g') AS plain FROM long),
sums AS (SELECT column_name, count(*) AS total, count(value) AS filled, count(DISTINCT value) AS uniq, count(*) FILTER (WHERE dated) AS dates, count(x) AS numbers, count(*) FILTER (WHERE x = floor(x)) AS integral, coalesce(bool_and(truth), false) AS truths,
  min(CASE WHEN regexp_matches(plain, '{P.NUMBER}') THEN TRY_CAST(trim(plain) AS DOUBLE) END) AS low, max(CASE WHEN regexp_matches(plain, '{P.NUMBER}') THEN TRY_CAST(trim(plain) AS DOUBLE) END) AS high FROM typed GROUP BY column_name),
fields AS (SELECT *, CASE column_name {known} ELSE CASE WHEN filled = 0 THEN 'unknown' WHEN dates / filled > 0.5 THEN 'datetime' WHEN numbers / filled > 0.8 THEN CASE WHEN integral / numbers > 0.9 THEN 'integer' ELSE 'float' END
  WHEN truths AND uniq <= 2 THEN 'boolean' WHEN uniq / total < 0.1 AND uniq < 50 THEN 'categorical' ELSE 'string' END END AS type, CASE {context} END AS healthcare_category FROM sums) """


_SQL_FIELDS = _sql_fields()
_SQL_HINTS = ", ".join(f"('{c}', '{h['type']}', {repr(h['pattern']) if 'pattern' in h else 'NULL'}, {h.get('min', 'NULL')}::DOUBLE, {h.get('max', 'NULL')}::DOUBLE)" for c, h in P.FIELD_HINTS.items()).replace("\\\\", "\\")


@query(
    _SQL_FIELDS
    + f"""SELECT f.column_name, coalesce(h.type, f.type) AS type, filled < total AS nullable, round((total - filled) * 100 / total, 2) AS null_percentage, round(uniq * 100 / total, 2) AS unique_percentage,
  coalesce(h.low, CASE WHEN f.type IN ('integer', 'float') THEN f.low END) AS min, coalesce(h.high, CASE WHEN f.type IN ('integer', 'float') THEN f.high END) AS max, h.pattern, healthcare_category
FROM fields f LEFT JOIN (VALUES {_SQL_HINTS}) AS h(column_name, type, pattern, low, high) USING (column_name)"""
)
def field_schema(spark, d):
    fields = schema.field_schema(health_table(spark, d), hints=True)
    return fields.select("column_name", "type", "nullable", "null_percentage", "unique_percentage", "min", "max", "pattern", "healthcare_category")


@query(_LONG_CUSTOMER + "SELECT column_name, 'range' AS kind, low AS min, high AS max FROM base WHERE numbers / non_null_count > 0.8")
def value_ranges(spark, d):
    return schema.constraints(schema.field_schema(table(spark, d, "customer"))).filter("kind = 'range'")


@query(_SQL_FIELDS + "SELECT type, count(*) AS n FROM fields GROUP BY type")
def field_type_histogram(spark, d):
    return schema.type_histogram(schema.field_schema(health_table(spark, d)))


@query(
    f"""{_SQL_HEALTH[:-1]}, long AS ({_sql_long({"health": ["CLAIM_ID", "ID", "DIAGNOSIS_CODE"]})})
SELECT column_name, coalesce({", ".join(f"CASE WHEN count(*) FILTER (WHERE regexp_matches(value, '{p}')) / nullif(count(value), 0) > 0.8 THEN '{p}' END" for p in P.PIPELINE_IDS)}) AS pattern FROM long GROUP BY column_name"""
)
def identifier_patterns(spark, d):
    return schema.identifier_patterns(profile.cells(health_table(spark, d), ["CLAIM_ID", "ID", "DIAGNOSIS_CODE"]))


@query(f"SELECT column_name, coalesce(max(length(split_part(value, '.', 2))), 0) AS decimal_places FROM ({_sql_long({'lineitem': ['l_discount', 'l_quantity']}, ('l_discount', 'l_quantity'))}) GROUP BY column_name")
def decimal_places(spark, d):
    return schema.decimal_places(profile.cells(table(spark, d, "lineitem"), ["l_discount", "l_quantity"]))


#: A derived table with a field of every type, all of them text but one.
TYPED = """SELECT CAST(o_orderkey % 90 AS VARCHAR(5)) AS years, CASE WHEN o_orderkey % 10 = 0 THEN 'none' ELSE CAST(o_orderkey % 700 AS VARCHAR(9)) || '.25' END AS amount, o_totalprice AS price,
  CASE WHEN o_orderkey % 8 = 0 THEN CAST(NULL AS VARCHAR(12)) ELSE '2024-0' || CAST(1 + o_orderkey % 9 AS VARCHAR(1)) || '-1' || CAST(o_orderkey % 10 AS VARCHAR(1)) END AS day,
  CASE o_orderkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' ELSE CAST(NULL AS VARCHAR(5)) END AS flag, 'AB' || CAST(1000000 + o_orderkey AS VARCHAR(12)) AS code,
  'note ' || CAST(o_custkey AS VARCHAR(12)) || CASE WHEN o_orderkey % 2 = 0 THEN '!' ELSE '' END AS note FROM {orders}"""
_NO = {k: f"CAST(NULL AS {t})" for k, t in (p.split() for p in schema.DETAILS.replace(" long", " BIGINT").replace(" string", " VARCHAR").replace(" int", " INTEGER").split(", "))}


def _sql_details(column: str, kind: str, **own: str) -> str:
    cells = ", ".join(f"{x} AS {k}" for k, x in (_NO | own).items())
    return f"SELECT '{column}' AS column_name, '{kind}' AS type, {cells} FROM typed"


def _sql_moments(x: str, places: int, **more: str) -> dict:
    median = f"quantile_cont({x}, 0.5)"
    return {"min": f"min({x})", "max": f"max({x})", "mean": f"round(avg({x}), {places})", "median": f"floor({median})" if places == 2 else median, "std": f"round(stddev_samp({x}), {places})", **more}


def _sql_lengths(x: str, **more: str) -> dict:
    flags = {"contains_numbers": f"bool_or(regexp_matches({x}, '\\d'))", "contains_special_chars": f"bool_or(regexp_matches({x}, '[^a-zA-Z0-9\\s]'))"}
    return {"min_length": f"min(length({x}))", "max_length": f"max(length({x}))", "avg_length": f"round(avg(length({x})), 2)", **flags, **more}


_AMOUNT = "TRY_CAST(amount AS DOUBLE)"


@query(
    f"WITH typed AS ({TYPED.format(orders='orders')}) "
    + " UNION ALL ".join((
        _sql_details("years", "integer", **_sql_moments("CAST(years AS DOUBLE)", 2)), _sql_details("amount", "float", **_sql_moments(_AMOUNT, 4, decimal_places="2")),
        _sql_details("price", "float", **_sql_moments("price", 4, decimal_places="max(length(split_part(regexp_replace(printf('%.6f', price), '\\.?0+$', ''), '.', 2)))::INTEGER")),
        _sql_details("day", "datetime", min_date="strftime(min(CAST(day AS DATE)), '%Y-%m-%dT00:00:00')", max_date="strftime(max(CAST(day AS DATE)), '%Y-%m-%dT00:00:00')", date_range_days="max(CAST(day AS DATE)) - min(CAST(day AS DATE))", format_detected="'YYYY-MM-DD'"),
        _sql_details("flag", "boolean", true_count="count(*) FILTER (WHERE flag = 'True')", false_count="count(*) FILTER (WHERE flag = 'false')", true_percentage="round(count(*) FILTER (WHERE flag = 'True') * 100 / count(flag), 2)"),
        _sql_details("code", "string", **_sql_lengths("code", pattern="'^[A-Z]{1,3}\\d{6,10}$'")), _sql_details("note", "string", **_sql_lengths("note")),
    )).replace("CAST(NULL AS VARCHAR) AS distribution, ", "")
)
def field_details(spark, d):
    typed = spark.sql(TYPED, orders=table(spark, d, "orders"))
    return schema.field_details(typed, schema.field_schema(typed)).drop("distribution")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS avg_length, bool_or(regexp_matches({c}, '\\d')) AS has_numbers, bool_or(regexp_matches({c}, '[^a-zA-Z0-9\\s]')) AS has_special_chars,
        CASE {" ".join(f"WHEN count(*) FILTER (WHERE regexp_matches({c}, '{P.VALUE_PATTERNS[k + '_like']}')) > 0.8 * count(*) THEN '{k}'" for k in ("email", "phone", "ssn", "url", "zip_code"))} END AS format,
        min(length({c})) = max(length({c})) AS fixed_length, CASE WHEN min(length({c})) = max(length({c})) THEN min(length({c})) END AS length FROM (SELECT p_name, p_brand, 'https://x.org/' || p_type AS page, CAST(10000 + p_partkey % 90000 AS VARCHAR) AS zip FROM part)"""
        for c in ("p_name", "p_brand", "page", "zip")
    )
)
def text_constraints(spark, d):
    parts = table(spark, d, "part").select("p_name", "p_brand", F.concat(F.lit("https://x.org/"), "p_type").alias("page"), (10000 + F.col("p_partkey") % 90000).cast("string").alias("zip"))
    return rounded(schema.text_constraints(parts, parts.columns))


@query("SELECT 5 AS num_columns, (SELECT count(*) FROM customer) AS num_rows, 'inferred_table' AS table_name, 5 AS n_columns, 0 AS empty_columns")
def schema_documents(spark, d):
    customer = table(spark, d, "customer")
    full, none = schema.schema_document(customer), schema.schema_document(customer.limit(0))
    return full.crossJoin(none.select(F.size("constraints").alias("empty_columns"))).select(F.col("num_columns").cast("int").alias("num_columns"), "num_rows", "table_name", F.size("columns").alias("n_columns"), "empty_columns")


@query(f"WITH typed AS ({TYPED.format(orders='orders')}) SELECT count(*) AS record_count, 7 AS column_count, 7 AS n_fields, 0::BIGINT AS empty_records, 0 AS empty_fields, 0.0::DOUBLE AS empty_score FROM typed")
def field_documents(spark, d):
    typed = spark.sql(TYPED, orders=table(spark, d, "orders"))
    full, none = schema.field_document(typed), schema.field_document(typed.limit(0))
    few = none.select(F.col("record_count").alias("empty_records"), F.size("fields").alias("empty_fields"), F.col("quality_score").alias("empty_score"))
    return full.crossJoin(few).select("record_count", F.col("column_count").cast("int").alias("column_count"), F.size("fields").alias("n_fields"), "empty_records", "empty_fields", "empty_score")


def _sql_distribution(columns: dict[str, str]) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*)::DOUBLE AS n, avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) AS g1, avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) AS b2
        FROM {t}, (SELECT avg({c}) AS m FROM {t})"""
        for c, t in columns.items()
    )
    return f"""WITH moments AS ({rows}),
a AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS beta, 3*(n-1)/(n+1) AS e, 24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5)) AS v,
  6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS s FROM moments),
b AS (SELECT *, -1 + sqrt(2*(beta-1)) AS w2, 6 + 8/s*(2/s + sqrt(1 + 4/(s*s))) AS k, (b2 - e)/sqrt(v) AS x FROM a),
c AS (SELECT *, y / sqrt(2/(w2-1)) AS r, 1 + x*sqrt(2/(k-4)) AS q FROM b),
z AS (SELECT *, 1/sqrt(0.5*ln(w2)) * ln(r + sqrt(r*r+1)) AS z1, (1 - 2/(9*k) - sign(q)*cbrt((1-2/k)/abs(q)))/sqrt(2/(9*k)) AS z2 FROM c)
SELECT column_name, round(g1, 4) AS skewness, CASE WHEN exp(-(z1*z1 + z2*z2)/2) > 0.05 THEN 'normal' WHEN abs(g1) < 0.5 THEN 'symmetric' WHEN g1 > 0.5 THEN 'right_skewed' ELSE 'left_skewed' END AS distribution FROM z"""


@query(_sql_distribution({"l_quantity": "lineitem", "l_extendedprice": "lineitem", "o_totalprice": "orders"}))
def distribution_label(spark, d):
    found = schema.distributions(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).unionByName(schema.distributions(table(spark, d, "orders"), ["o_totalprice"]))
    return rounded(found.select("column_name", "skewness", "distribution"), 4)


# ---- comparison of two tables


@query(
    """WITH v AS (SELECT l_extendedprice AS v, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
r AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS gap FROM v)
SELECT (SELECT round(max(abs(gap)), 6) FROM r) AS statistic, (SELECT sum(a)::BIGINT FROM v) AS n_left, (SELECT sum(b)::BIGINT FROM v) AS n_right"""
)
def ks_statistic(spark, d):
    lines = table(spark, d, "lineitem")
    return rounded(validate.ks_statistic(lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'"), "l_extendedprice"))


@query(
    """WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS a, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS b FROM orders GROUP BY 1),
t AS (SELECT *, a / sum(a) OVER () * sum(b) OVER () AS e FROM c) SELECT round(sum((b - e) * (b - e) / e), 6) AS statistic, count(*) - 1 AS freedom FROM t"""
)
def chi_square_statistic(spark, d):
    orders = table(spark, d, "orders")
    return rounded(validate.chi_square(orders.filter("o_orderkey % 2 = 1"), orders.filter("o_orderkey % 2 = 0"), "o_orderpriority"))


_SQL_OVERLAP = """WITH a AS (SELECT DISTINCT CAST(p_size AS VARCHAR) || p_brand AS v FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT CAST(p_size AS VARCHAR) || p_brand AS v FROM part WHERE p_partkey % 2 = 1),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS every) """


def _halves(spark, d):
    parts = table(spark, d, "part").withColumn("v", F.concat(F.col("p_size").cast("string"), "p_brand"))
    return parts.filter("p_partkey % 2 = 0"), parts.filter("p_partkey % 2 = 1")


@query(_SQL_OVERLAP + "SELECT round(shared / every, 4) AS jaccard FROM n")
def jaccard(spark, d):
    return validate.jaccard(*_halves(spark, d), "v")


@query(_SQL_OVERLAP + "SELECT *, CASE WHEN exact_match_percent < 5 THEN 'LOW' WHEN exact_match_percent < 15 THEN 'MEDIUM' WHEN exact_match_percent < 30 THEN 'HIGH' ELSE 'CRITICAL' END AS risk, exact_match_percent < 10 AS preserved FROM (SELECT round(shared * 100 / na, 2) AS exact_match_percent FROM n)")
def privacy_overlap(spark, d):
    return validate.privacy_overlap(*_halves(spark, d), "v")


_PAIRS = ["l_quantity", "l_extendedprice", "l_discount"]


def _sql_corr() -> str:
    side = lambda odd: " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem WHERE l_orderkey % 2 = {odd}" for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1 :])
    return f"""SELECT a, b, round(l.r, 6) AS r_left, round(r.r, 6) AS r_right, round(abs(l.r - r.r), 6) AS delta, abs(l.r - r.r) <= 0.1 AS passed
FROM ({side(0)}) l JOIN ({side(1)}) r USING (a, b)"""


@query(_sql_corr())
def correlation_delta(spark, d):
    lines = table(spark, d, "lineitem")
    return rounded(validate.correlation_deltas(lines.filter("l_orderkey % 2 = 0"), lines.filter("l_orderkey % 2 = 1"), _PAIRS))


@query(
    _SQL_HEALTH
    + """SELECT 'COINSURANCE' AS field, 'below_range' AS kind, count(*) FILTER (WHERE COINSURANCE < 0) AS violations FROM health UNION ALL
SELECT 'COINSURANCE', 'above_range', count(*) FILTER (WHERE COINSURANCE > 1) FROM health UNION ALL SELECT 'TOTAL_CHARGE', 'below_range', count(*) FILTER (WHERE TOTAL_CHARGE < 0) FROM health UNION ALL
SELECT 'LAST_NAME', 'not_null', count(*) FILTER (WHERE LAST_NAME IS NULL) FROM health UNION ALL
SELECT 'CLAIM_ID', 'unique', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM health GROUP BY CLAIM_ID) UNION ALL SELECT 'ABSENT', 'missing', 1"""
)
def constraint_violations(spark, d):
    return validate.constraint_violations(health_table(spark, d), {"COINSURANCE": (0.0, 1.0), "TOTAL_CHARGE": (0.0, None)}, ["LAST_NAME", "ABSENT"], ["CLAIM_ID"])


def _comparison(spark, d):
    parts = table(spark, d, "part").select("p_size", "p_retailprice", "p_brand", "p_name")
    halves = [parts.filter(f"p_size % 2 = {k}") for k in (0, 1)]
    planted = {"ranges": {"p_size": (5.0, 40.0), "p_retailprice": (0.0, None)}, "not_null": ["p_name"], "unique": ["p_brand"]}
    return validate.validate(halves[0], halves[1], {"p_size": "integer", "p_retailprice": "float", "p_brand": "categorical", "p_name": "string"}, planted)


@query(
    """WITH t AS (SELECT * FROM part WHERE p_size % 2 = 1) SELECT 'constraint' AS family, name, n::DOUBLE AS statistic, false AS passed FROM (SELECT 'p_size:below_range' AS name, count(*) AS n FROM t WHERE p_size < 5 UNION ALL
SELECT 'p_size:above_range', count(*) FROM t WHERE p_size > 40 UNION ALL SELECT 'p_retailprice:below_range', count(*) FROM t WHERE p_retailprice < 0 UNION ALL SELECT 'p_name:not_null', count(*) FROM t WHERE p_name IS NULL UNION ALL
SELECT 'p_brand:unique', count(*) - count(DISTINCT p_brand) FROM t) WHERE n > 0"""
)
def validation_constraints(spark, d):
    return _comparison(spark, d)[0].filter("family = 'constraint'").select("family", "name", "statistic", "passed")


def _sql_ks(c: str) -> str:
    return f"""SELECT 'distribution' AS family, '{c}' AS name, round(max(abs(gap)), 4)::DOUBLE AS statistic, 'ks_asymptotic' AS detail FROM (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS gap
  FROM (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT {c}::DOUBLE AS v, 1 AS a, 0 AS b FROM l UNION ALL SELECT {c}, 0, 1 FROM r) GROUP BY v))"""


def _sql_shared(c: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {c} FROM l INTERSECT SELECT {c} FROM r))"


_COMPARED = ("p_size", "p_retailprice", "p_brand", "p_name")
_SQL_TESTS = f"""WITH l AS (SELECT * FROM part WHERE p_size % 2 = 0), r AS (SELECT * FROM part WHERE p_size % 2 = 1), brands AS (SELECT p_brand, sum(a) AS a, sum(b) AS b FROM (SELECT p_brand, 1 AS a, 0 AS b FROM l UNION ALL SELECT p_brand, 0, 1 FROM r) GROUP BY 1),
leaks AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, round({_sql_shared(c)} * 100 / (SELECT count(DISTINCT {c}) FROM l), 2) AS percent" for c in _COMPARED)})
{_sql_ks("p_size")} UNION ALL {_sql_ks("p_retailprice")}
UNION ALL SELECT 'distribution', 'p_brand', sum((b - e) * (b - e) / e), 'chi_square' FROM (SELECT b, a / sum(a) OVER () * sum(b) OVER () AS e FROM brands)
UNION ALL SELECT 'distribution', 'p_name', round({_sql_shared("p_name")} / (SELECT count(*) FROM (SELECT p_name FROM l UNION SELECT p_name FROM r)), 4), 'jaccard'
UNION ALL SELECT 'correlation', 'p_size/p_retailprice', abs((SELECT corr(p_size, p_retailprice) FROM l) - (SELECT corr(p_size, p_retailprice) FROM r)), CAST(NULL AS VARCHAR)
UNION ALL SELECT 'privacy', name, percent, CASE WHEN percent < 5 THEN 'LOW' WHEN percent < 15 THEN 'MEDIUM' WHEN percent < 30 THEN 'HIGH' ELSE 'CRITICAL' END FROM leaks"""


@query(f"SELECT family, name, round(statistic, 6) AS statistic, detail FROM ({_SQL_TESTS})")
def validation_tests(spark, d):
    """p-values are left to the tests of the closed forms: SQL has no incomplete gamma function."""
    return rounded(_comparison(spark, d)[0].filter("family <> 'constraint'").select("family", "name", "statistic", "detail"))


@query()
def validation_overall(spark, d):
    return _comparison(spark, d)[1]


# ---- synthesis and lifecycles


@query()
def synth_claims(spark, d):
    claims, _ = split.split_by_identifier(health_table(spark, d))
    return synth.claims(spark, claims.count(), claims)


@query()
def synth_demographics(spark, d):
    _, people = split.split_by_identifier(health_table(spark, d))
    return synth.demographics(spark, people.count(), people)


@query()
def synth_numeric(spark, d):
    parts = table(spark, d, "part").select("p_size", "p_retailprice", "p_brand", "p_name")
    return synth.from_schema(parts, schema.field_schema(parts), multiplier=2)


@query()
def pipeline_synthetic(spark, d):
    return pipeline.run(health_table(spark, d)).synthetic


@query()
def upload_demographics(spark, d):
    return pipeline.upload(health_table(spark, d))["synthetic_demographics"]


_SQL_CUSTOMER_SCORES = _SQL_SCORES.replace(_SQL_PEOPLE[:-1], _sql_families({"customer": _CUSTOMER})[:-1].replace(_sql_long({"customer": _CUSTOMER}), _sql_long({"customer": _CUSTOMER}, ("c_acctbal",)), 1), 1)


@query(_SQL_CUSTOMER_SCORES[:-1] + f", {_SQL_NOTES} SELECT *, (SELECT string_agg(column_name || ':' || n_families || ':' || printf('%.4f', overall_risk_score), ' | ' ORDER BY column_name) FROM scores) AS columns FROM notes")
def privacy_report(spark, d):
    one = lambda x: F.concat_ws(":", x.column_name, x.n_families.cast("string"), F.format_string("%.4f", x.overall_risk_score))
    found = privacy.report(table(spark, d, "customer")).withColumn("columns", F.transform("columns", one))
    return _joined(found, "priority_actions", "compliance_notes", "columns")
