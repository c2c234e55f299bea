"""Schema inference over the profile table: SQL types, constraints, keys, special patterns, DDL, and the pipeline's
field schema with healthcare hints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import patterns as P
from ..functions.stats import distribution_label
from . import profile as prof

# ---- the library's schema


def sql_type(hint: Column, low: Column, high: Column, longest: Column, distinct: Column) -> Column:
    """SQL type of a column from its hint, numeric bounds, longest text and number of distinct values."""
    sized = (
        F.when((low >= -128) & (high <= 127), "TINYINT").when((low >= -32768) & (high <= 32767), "SMALLINT").when((low >= -2147483648) & (high <= 2147483647), "INTEGER").otherwise("BIGINT")
    )
    text = (
        F.when(longest <= 50, "VARCHAR(50)").when(longest <= 255, F.concat(F.lit("VARCHAR("), longest.cast("string"), F.lit(")"))).when(longest <= 65535, "TEXT").otherwise("LONGTEXT")
    )
    few = F.when((distinct <= 10) & (longest <= 50), "ENUM").otherwise(F.concat(F.lit("VARCHAR("), F.greatest(longest, F.lit(50)).cast("string"), F.lit(")")))
    return (
        F.when(hint == "empty", "TEXT").when(hint == "integer", sized).when(hint.isin("float", "currency"), "DECIMAL(10,2)").when(hint == "date", "DATE").when(hint == "boolean", "BOOLEAN")
        .when(hint == "categorical", few).otherwise(text)
    )


def _length_sums() -> list[Column]:
    x = E.amount(F.col("value"))
    longest, shortest = (f(F.length("value")).cast("long") for f in (F.max, F.min))
    return [F.min(x).alias("low"), F.max(x).alias("high"), longest.alias("longest"), shortest.alias("shortest")]


def primary_key_score() -> Column:
    return F.round(
        F.when(F.col("cardinality_rate") >= 0.95, 0.4).otherwise(0.0) + F.when(F.col("null_rate") == 0, 0.3).otherwise(0.0)
        + F.when(F.col("data_type_hint").isin("integer", "text"), 0.2).otherwise(0.0) + F.when(F.col("quality_score") > 0.8, 0.1).otherwise(0.0), 6,
    )


def foreign_key_score() -> Column:
    name = F.lower("column_name")
    named = name.contains("_id") | name.contains("id") | name.contains("_key") | name.contains("ref")
    return F.round(
        F.when(named, 0.3).otherwise(0.0) + F.when(F.col("cardinality_rate").between(0.1, 0.8), 0.2).otherwise(0.0)
        + F.when(F.col("data_type_hint").isin("integer", "text"), 0.2).otherwise(0.0) + F.when(F.col("null_rate") < 0.1, 0.2).otherwise(0.0)
        + F.when(F.col("quality_score") > 0.7, 0.1).otherwise(0.0), 6,
    )


def key_scores(profile: DataFrame) -> DataFrame:
    return profile.select(
        "column_name", primary_key_score().alias("pk_score"), (primary_key_score() >= 0.7).alias("pk_candidate"),
        foreign_key_score().alias("fk_score"), (foreign_key_score() >= 0.6).alias("fk_candidate"),
    )


def _medical_sums() -> list[Column]:
    v = F.col("value")
    share = lambda p: E.ratio(F.sum(F.when(E.matches(v, p), F.col("n"))), F.sum(F.when(v.isNotNull(), F.col("n"))))
    return [(share(p) > 0.7).alias(k) for k, p in P.MEDICAL.items()]


def _named(found: DataFrame) -> DataFrame:
    name = F.lower("column_name")
    has = lambda words: reduce(lambda a, b: a | b, (name.contains(w) for w in words))
    return found.withColumns({
        "likely_identifier": has(("id", "key", "identifier")), "likely_name_field": has(("name", "title", "description")), "likely_temporal": has(("date", "time", "created", "updated")),
    })


def special_patterns(values: DataFrame) -> DataFrame:
    """Medical patterns that over 0.7 of a column's non-null values match, and what the column's name suggests."""
    return _named(values.groupBy("column_name").agg(*_medical_sums()))


def numeric_constraints(statistics: DataFrame) -> DataFrame:
    """Bounds, sign and what a range suggests, from :func:`profile.numeric_statistics`."""
    low, high = F.col("min"), F.col("max")
    within = lambda a, b: (low >= a) & (high <= b)
    return statistics.select(
        "column_name", low.alias("min_value"), high.alias("max_value"), (F.col("negatives") == 0).alias("non_negative"), (F.col("zeros") == 0).alias("non_zero"),
        within(0, 150).alias("likely_age"), within(0, 100).alias("likely_percentage"), within(1900, 2030).alias("likely_year"),
    )


def text_format() -> Column:
    """The first format that over 0.8 of all rows have, from the pattern counts."""
    forms = (("email", "email_like"), ("phone", "phone_like"), ("ssn", "ssn_like"), ("url", "url_like"), ("zip_code", "zip_code_like"))
    return F.coalesce(*(F.when(F.col(k) > 0.8 * F.col("total_count"), F.lit(label)) for label, k in forms))


def ordinal_columns(freq: DataFrame) -> DataFrame:
    """(column_name, is_ordinal): the ten most frequent values hold a known scale, or all are ordinal numbers."""
    top = prof.top_values(freq).groupBy("column_name").agg(F.collect_set(F.lower("value")).alias("v"))
    scale = reduce(lambda a, b: a | b, (F.size(F.array_except(F.array(*map(F.lit, s)), "v")) == 0 for s in P.ORDINAL_SCALES))
    return top.select("column_name", (scale | F.forall("v", lambda x: x.rlike(r"^\d+(st|nd|rd|th)"))).alias("is_ordinal"))


def boolean_columns(freq: DataFrame) -> DataFrame:
    """True and false counts, and how the values are written."""
    v = F.lower("value")
    n = lambda words: F.coalesce(F.sum(F.when(v.isin(*words), F.col("n"))), F.lit(0))
    within = lambda words: F.coalesce(F.min(F.when(F.col("value").isNotNull(), v.isin(*words).cast("int"))), F.lit(1)) == 1
    kind = F.when(within(("true", "false")), "true/false").when(within(("1", "0")), "1/0").when(within(("yes", "no")), "yes/no").when(within(("y", "n")), "y/n").otherwise("mixed")
    return freq.groupBy("column_name").agg(n(("true", "1", "yes", "y")).alias("true_count"), n(("false", "0", "no", "n")).alias("false_count"), kind.alias("representation"))


def constraint_table(profile: DataFrame, max_rows: int | None = 10_000, max_columns: int | None = 10) -> DataFrame:
    """(column_name, kind): not_null on tables of over ten rows, unique within the size limits (None: no limit)."""
    rows, cols = F.max("total_count").over(_all()), F.count("*").over(_all())
    sized = profile.withColumns({"rows": rows, "cols": cols})
    fits = (F.lit(True) if max_rows is None else F.col("rows") <= max_rows) & (F.lit(True) if max_columns is None else F.col("cols") <= max_columns)
    not_null = sized.filter((F.col("null_rate") == 0) & (F.col("rows") > 10)).select("column_name", F.lit("not_null").alias("kind"))
    return not_null.unionByName(sized.filter((F.col("cardinality_rate") == 1.0) & fits).select("column_name", F.lit("unique").alias("kind")))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # the profile has one row for each column of a table


def infer(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each column: profile, SQL type, key scores, format, special patterns, domain, and whether a
    categorical column is ordinal.  The profile, one row for each column, is collected, so that values are counted
    of categorical columns alone."""
    columns = list(columns or df.columns)
    table = _named(prof.profile_columns(df, columns, *_length_sums(), *_medical_sums()).drop("issues"))
    table = df.sparkSession.createDataFrame(table.collect(), table.schema)
    scales = [r.column_name for r in table.filter("data_type_hint = 'categorical'").collect()]
    ordinal = ordinal_columns(prof.frequencies(df, scales)) if scales else df.sparkSession.createDataFrame([], "column_name string, is_ordinal boolean")
    table = table.join(ordinal, "column_name", "left").withColumn("is_ordinal", F.coalesce("is_ordinal", F.lit(False)))
    hint = F.col("data_type_hint")
    name = F.lower("column_name")
    geo = reduce(lambda a, b: a | b, (name.contains(w) for w in ("zip", "state", "country", "city", "address")))
    numeric = hint.isin("integer", "float", "currency")
    domain = E.messages(
        (reduce(lambda a, b: a | b, (F.col(k) for k in P.MEDICAL)), "healthcare"),
        ((hint == "currency") | (numeric & (F.col("low") >= 0) & (F.col("high") <= 100)), "financial"),
        ((hint == "date") | F.col("likely_temporal"), "temporal"),
        (geo, "geographic"),
    )
    return table.withColumns({
        "sql_type": sql_type(hint, F.col("low"), F.col("high"), F.col("longest"), F.col("unique_count")),
        "pk_score": primary_key_score(), "fk_score": foreign_key_score(), "format": F.when(hint == "text", text_format()),
        "fixed_length": F.when(hint == "text", F.col("longest") == F.col("shortest")), "domain": domain,
    })


def relationships(schema: DataFrame) -> DataFrame:
    """One row: foreign-key candidates, and columns that may form a hierarchy (two or more categorical ones with 5 to
    100 values).  Functional dependencies are not looked for."""
    fk = F.array_sort(F.collect_list(F.when(F.col("fk_score") >= 0.6, F.col("column_name"))))
    levels = F.array_sort(F.collect_list(F.when((F.col("data_type_hint") == "categorical") & F.col("unique_count").between(5, 100), F.col("column_name"))))
    return schema.agg(fk.alias("foreign_keys"), F.when(F.size(levels) >= 2, levels).otherwise(F.array().cast("array<string>")).alias("hierarchy"))


def to_ddl(schema: DataFrame, table: str, freq: DataFrame | None = None) -> str:
    """CREATE TABLE text.  The schema has one row for each column, which is all that is collected."""
    rows = schema.select("column_name", "sql_type", "null_rate", "pk_score", "cardinality_rate").orderBy("column_name").collect()
    categories = {r.column_name: r.v for r in prof.top_values(freq).groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()} if freq is not None else {}
    lines = []
    for r in rows:
        kind = r.sql_type
        if kind == "ENUM":
            quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in categories.get(r.column_name, []))
            kind = f"ENUM({quoted})" if quoted else "VARCHAR(50)"
        lines.append(f"    {r.column_name} {kind}" + (" NOT NULL" if r.null_rate == 0 else ""))
    keys = [r.column_name for r in rows if r.pk_score >= 0.7]
    if keys:
        lines.append(f"    PRIMARY KEY ({keys[0]})")
    lines += [f"    UNIQUE ({r.column_name})" for r in rows if r.cardinality_rate == 1.0 and r.column_name not in keys[:1]]
    return f"CREATE TABLE {table} (\n" + ",\n".join(lines) + "\n);"


# ---- the pipeline's field schema


def named_type(column: str) -> str | None:
    """Type that a word of the name stands for; words are whole parts of the name, not any substring."""
    parts = column.lower().replace("-", "_").split("_")
    return next((kind for word, kind in P.NAME_TYPES.items() if word in parts or (word in column.lower() and "_" in word)), None)


def _field_sums() -> list[Column]:
    v = F.col("value")
    number = E.number(v)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    dated = reduce(lambda a, b: a | b, (E.matches(v, p) for p in P.DATE_PREFIXES))
    truths = F.coalesce(F.min(F.when(v.isNotNull(), F.lower(v).isin(*P.BOOLEANS).cast("int"))), F.lit(0))
    return [n(dated).alias("dates"), n(number.isNotNull()).alias("numbers"), n(number == F.floor(number)).alias("integral"), truths.alias("all_boolean")]


def field_type(df: DataFrame) -> Column:
    """Type of a field: by name, by physical type, else by shares over all non-null values."""
    kinds = dict(df.dtypes)
    share = lambda a, b: E.ratio(F.col(a), F.col(b))
    guessed = (
        F.when(F.col("non_null_count") == 0, "unknown").when(share("dates", "non_null_count") > 0.5, "datetime")
        .when(share("numbers", "non_null_count") > 0.8, F.when(share("integral", "numbers") > 0.9, "integer").otherwise("float"))
        .when((F.col("all_boolean") == 1) & (F.col("unique_count") <= 2), "boolean")
        .when((share("unique_count", "total_count") < 0.1) & (F.col("unique_count") < 50), "categorical").otherwise("string")
    )
    physical = {"boolean": "boolean", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime"}
    known = {}
    for c, t in kinds.items():
        known[c] = named_type(c) or physical.get(t) or ("integer" if t in ("int", "bigint", "smallint", "tinyint") else "float" if t in ("float", "double") or t.startswith("decimal") else None)
    return reduce(lambda a, kv: F.when(F.col("column_name") == kv[0], F.lit(kv[1])).otherwise(a), ((c, k) for c, k in known.items() if k), guessed)


def field_schema(df: DataFrame, columns: Sequence[str] | None = None, hints: bool = False) -> DataFrame:
    """One row for each field: type, nullability, percentages, constraints, range, category and expected range.

    With ``hints`` the nine healthcare hints override the inferred type and range.
    """
    found = prof.rates(prof.aggregate(prof.cells(df, columns), prof.distinct_counts(df, columns), *_field_sums(), *_length_sums()))
    table = found.select(*prof.COUNTS, field_type(df).alias("type"), "low", "high", "longest", "shortest")
    pct = lambda a: F.round(E.ratio(F.col(a) * 100.0, F.col("total_count")), 2)
    table = table.withColumns({"nullable": F.col("null_count") > 0, "null_percentage": pct("null_count"), "unique_percentage": pct("unique_count")})
    name = F.lower("column_name")
    has = lambda words: reduce(lambda a, b: a | b, (name.contains(w) for w in words))
    category = F.coalesce(*(F.when(has(words), F.lit(k)) for k, words in P.HEALTH_CONTEXT.items()))
    numeric = F.col("type").isin("integer", "float")
    expected = F.coalesce(*(F.when(name.contains(w) & numeric, F.struct(F.lit(a).alias("min"), F.lit(b).alias("max"))) for w, (a, b) in P.EXPECTED_RANGES.items()))
    table = table.withColumns({
        "min": F.when(numeric, F.col("low")), "max": F.when(numeric, F.col("high")), "healthcare_category": category, "expected_range": expected,
        "is_unique": F.col("unique_percentage") == 100, "is_required": F.col("null_count") == 0, "pattern": F.lit(None).cast("string"), "categories": F.lit(None).cast("array<string>"),
    })
    return overlay_hints(table) if hints else table


#: The parts of a field's details, by the kind of the field.
DETAILS = (
    "min double, max double, mean double, median double, std double, distribution string, decimal_places int, min_length long, max_length long, avg_length double, contains_numbers boolean,"
    " contains_special_chars boolean, pattern string, min_date string, max_date string, date_range_days long, format_detected string, true_count long, false_count long, true_percentage double"
)


def field_details(df: DataFrame, fields: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, type and DETAILS): what the schema says about each field by its type, the rest null.

    Numbers that do not parse, dates that do not parse and nulls are left out.  ``fields`` has one row for each
    column, of which names and types are collected; everything else is one aggregate over the rows.  The format of
    dates is that of the smallest value as text.  ``exact=False``: medians in bounded memory.
    """
    kinds, names = dict(df.dtypes), [part.split()[0] for part in DETAILS.split(", ")]
    cells = []
    for c, kind in sorted((r.column_name, r.type) for r in fields.select("column_name", "type").collect()):
        raw, text = F.col(f"`{c}`"), E.to_text(F.col(f"`{c}`"), kinds[c])
        filled, own = F.count(raw), {}
        if kind in ("integer", "float"):
            x = E.number(raw) if kinds[c] == "string" else F.nanvl(raw.cast("double"), F.lit(None).cast("double"))
            places = 2 if kind == "integer" else 4
            median = F.percentile(x, F.lit(0.5)) if exact else F.percentile_approx(x, 0.5, 10_000)
            own = {"min": F.min(x), "max": F.max(x), "mean": F.round(F.avg(x), places), "median": F.floor(median).cast("double") if kind == "integer" else median, "std": F.round(F.stddev_samp(x), places)}
            own["distribution"] = F.struct(F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
            if kind == "float":
                own["decimal_places"] = F.coalesce(F.max(F.length(F.split_part(text, F.lit("."), F.lit(2)))), F.lit(0))
        elif kind == "datetime":
            x = E.parse_date(raw) if kinds[c] == "string" else raw.cast("timestamp_ntz").cast("timestamp")
            days = F.floor((F.max(F.unix_timestamp(x)) - F.min(F.unix_timestamp(x))) / 86400)
            shown = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
            own = {"min_date": shown(F.min(x)), "max_date": shown(F.max(x)), "date_range_days": days, "format_detected": F.when(filled > 0, E.date_format_label(F.min(raw.cast("string"))))}
        elif kind == "boolean":
            word = F.lower(raw.cast("string"))
            true, false = E.count_if(word == "true"), E.count_if(word == "false")
            own = {"true_count": true, "false_count": false, "true_percentage": F.round(E.ratio(true * 100.0, filled), 2)}
        elif kind in ("string", "unknown"):
            n = F.length(text)
            found = [F.when(E.ratio(E.count_if(E.matches(text, p)), filled) > 0.8, F.lit(p)) for p in P.PIPELINE_IDS]
            own = {"min_length": F.min(n), "max_length": F.max(n), "avg_length": F.round(F.avg(n), 2), "contains_numbers": F.max(E.matches(text, r"\d")), "contains_special_chars": F.max(E.matches(text, r"[^a-zA-Z0-9\s]")), "pattern": F.coalesce(*found)}
        empty = F.lit(None).cast("struct<n:bigint,skewness:double,kurtosis:double>")
        types = dict(part.split() for part in DETAILS.split(", "))
        cells.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("type"), *((own.get(k, empty) if k == "distribution" else own.get(k, F.lit(None)).cast(types[k])).alias(k) for k in names)))
    if not cells:
        return df.sparkSession.createDataFrame([], f"column_name string, type string, {DETAILS}")
    rows = df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))
    moments = F.col("distribution")
    return rows.withColumn("distribution", F.when(moments.isNotNull(), distribution_label(moments.n, moments.skewness, moments.kurtosis)))


def text_constraints(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Lengths, character classes, format and fixed length of text columns, as the library's schema has them."""
    stats = prof.text_statistics(df, columns, exact)
    counted = prof.cells(df, columns).groupBy("column_name").agg(F.sum("n").alias("total_count"), *prof.pattern_sums())
    fixed = (F.col("min_length") == F.col("max_length")) & (F.col("min_length") > 0)
    return stats.join(counted, "column_name").select(
        "column_name", "min_length", "max_length", "avg_length", (F.col("contains_digits") > 0).alias("has_numbers"), (F.col("contains_special") > 0).alias("has_special_chars"),
        F.regexp_replace(text_format(), "_like$", "").alias("format"), fixed.alias("fixed_length"), F.when(fixed, F.col("min_length")).alias("length"),
    )


def schema_document(df: DataFrame, columns: Sequence[str] | None = None, table: str = "inferred_table") -> DataFrame:
    """One row: the library's schema of a table with its columns, constraints, relationships, quality and advice; an
    empty table has no columns in it."""
    found = infer(df, columns)
    profile = prof.profile_columns(df, columns)
    every = lambda rows, *names: F.array_sort(F.collect_list(F.struct(*names)))  # noqa: E731, ARG005
    one = found.agg(F.coalesce(F.max("total_count"), F.lit(0)).alias("num_rows"), F.count("*").alias("num_columns"), every(found, "column_name", "sql_type", "data_type_hint", "null_rate", "pk_score", "fk_score", "format", "domain").alias("columns"))
    advice = prof.recommendations(profile).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "recommendation"))), lambda x: x.recommendation).alias("recommendations"))
    parts = [
        constraint_table(profile).agg(every(None, "kind", "column_name").alias("constraints")),
        relationships(found).select(F.struct("foreign_keys", "hierarchy").alias("relationships")),
        prof.dataset_summary(profile).select(F.struct("avg_null_rate", "avg_quality_score", "columns_with_issues", "high_quality_columns").alias("quality_assessment")),
        advice,
    ]
    return reduce(DataFrame.crossJoin, parts, one).select(F.lit(table).alias("table_name"), "*")  # single rows


def field_document(df: DataFrame, hints: bool = False) -> DataFrame:
    """One row: the pipeline's schema of a table: fields with their details, constraints, quality score, types; a
    table without rows has an empty one with score 0."""
    fields = field_schema(df, hints=hints)
    detailed = fields.join(field_details(df, fields).drop("type", "min", "max", "pattern"), "column_name")
    some = F.col("record_count") > 0
    one = detailed.agg(F.coalesce(F.max("total_count"), F.lit(0)).alias("record_count"), F.count("*").alias("column_count"), F.array_sort(F.collect_list(F.struct("column_name", *(c for c in detailed.columns if c not in ("column_name", "expected_range"))))).alias("fields"))
    rules = constraints(fields).agg(F.array_sort(F.collect_list(F.struct("column_name", "kind", "min", "max"))).alias("constraints"))
    kinds = type_histogram(fields).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("data_types_summary"))
    whole = reduce(DataFrame.crossJoin, (rules, kinds, dataset_quality(fields)), one)  # single rows
    return whole.select("record_count", F.when(some, F.col("column_count")).otherwise(0).alias("column_count"), *(F.when(some, F.col(c)).otherwise(F.array()).alias(c) for c in ("fields", "constraints")), F.when(some, F.col("quality_score")).otherwise(0.0).alias("quality_score"), F.when(some, F.col("data_types_summary")).alias("data_types_summary"))


def overlay_hints(fields: DataFrame) -> DataFrame:
    rows = [(c, h["type"], h.get("pattern"), list(h["categories"]) if "categories" in h else None, h.get("min"), h.get("max")) for c, h in P.FIELD_HINTS.items()]
    hints = fields.sparkSession.createDataFrame(rows, "column_name string, h_type string, h_pattern string, h_categories array<string>, h_min double, h_max double")
    out = fields.join(F.broadcast(hints), "column_name", "left")  # nine rows
    return out.withColumns({k: F.coalesce(f"h_{k}", k) for k in ("type", "pattern", "categories", "min", "max")}).drop("h_type", "h_pattern", "h_categories", "h_min", "h_max")


def distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, distribution) of numeric columns by the omnibus normality test and the skewness."""
    cells = []
    for c in columns or prof.numeric_columns(df):
        x = F.col(f"`{c}`").cast("double")
        cells.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")))
    rows = df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))
    return rows.withColumn("distribution", distribution_label(F.col("n"), F.col("skewness"), F.col("kurtosis")))


def category_frequencies(freq: DataFrame) -> DataFrame:
    """(column_name, value, n, frequency to four places) over non-null values."""
    some = freq.filter(F.col("value").isNotNull())
    totals = some.groupBy("column_name").agg(F.sum("n").alias("total"))
    return some.join(totals, "column_name").select("column_name", "value", "n", F.round(F.col("n") / F.col("total"), 4).alias("frequency"))


def identifier_patterns(freq: DataFrame) -> DataFrame:
    """(column_name, pattern): the first id pattern that over 0.8 of a column's values match."""
    v = F.col("value")
    cells = [E.ratio(F.sum(F.when(E.matches(v, p), F.col("n"))), F.sum(F.when(v.isNotNull(), F.col("n")))).alias(f"s{i}") for i, p in enumerate(P.PIPELINE_IDS)]
    found = freq.groupBy("column_name").agg(*cells)
    return found.select("column_name", F.coalesce(*(F.when(F.col(f"s{i}") > 0.8, F.lit(p)) for i, p in enumerate(P.PIPELINE_IDS))).alias("pattern"))


def decimal_places(freq: DataFrame) -> DataFrame:
    part = F.split_part(F.col("value"), F.lit("."), F.lit(2))
    return freq.groupBy("column_name").agg(F.coalesce(F.max(F.length(part)), F.lit(0)).alias("decimal_places"))


def dataset_quality(fields: DataFrame) -> DataFrame:
    """Mean of completeness, a fixed type consistency of 1 and uniqueness, to three places; 0 without fields."""
    complete, unique = F.avg(1 - F.col("null_rate")), F.avg(F.least(F.col("cardinality_rate"), F.lit(1.0)))
    return fields.agg(F.coalesce(F.round((complete + 1.0 + unique) / 3, 3), F.lit(0.0)).alias("quality_score"))


def type_histogram(fields: DataFrame) -> DataFrame:
    return fields.groupBy("type").agg(F.count("*").alias("n"))


def constraints(fields: DataFrame) -> DataFrame:
    """(column_name, kind, min, max): unique, not_null and range constraints of the pipeline."""
    none = F.lit(None).cast("double")
    pick = lambda cond, kind, a=none, b=none: fields.filter(cond).select("column_name", F.lit(kind).alias("kind"), a.alias("min"), b.alias("max"))
    ranged = F.col("type").isin("integer", "float") & F.col("min").isNotNull()
    return pick(F.col("is_unique"), "unique").unionByName(pick(F.col("is_required"), "not_null")).unionByName(pick(ranged, "range", F.col("min"), F.col("max")))
