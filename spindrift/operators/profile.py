"""Column and dataset profiles.

Statistics of a column are sums over its *cells* (column, value, n): grouped by column they are combined where the rows
lie, so no value is shuffled.  Distinct values are counted by 128-bit hashes.  Only what names values (top values,
entropy, samples) needs the table of value *frequencies*, the same three columns with each value once; every function
below takes either, cells with the distinct counts beside them.  Numeric columns get their moments and quantiles in one
wide aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import patterns as P

NUMERIC_TYPES = ("byte", "short", "int", "bigint", "tinyint", "smallint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES or t.startswith("decimal")]


def cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n): every cell as text with n = 1; nothing is grouped yet."""
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    texts = [E.to_text(F.col(f"`{c}`"), kinds[c]).alias(c) for c in columns]
    return df.select(*texts).unpivot([], columns, "column_name", "value").withColumn("n", F.lit(1).cast("long"))


def frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n): how often each column holds each value, as text; null counts as a value here.  Shuffles
    the distinct values."""
    return cells(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, unique_count): how many values each column has, by two hashes of 64 bits, which are all that is
    shuffled."""
    hashed = cells(df, columns).filter(F.col("value").isNotNull()).select("column_name", F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), "value").alias("b"))
    return hashed.groupBy("column_name", "a", "b").agg(F.lit(1).alias("one")).groupBy("column_name").agg(F.count("*").alias("unique_count"))


def aggregate(values: DataFrame, unique: DataFrame | None, *sums: Column) -> DataFrame:
    """One row for each column: ``sums``, total_count, null_count and unique_count, which come from ``unique`` or, where
    each value is there once, from the values themselves."""
    own = [] if unique is not None else [F.count("value").alias("unique_count")]
    total = [F.sum("n").alias("total_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count")]
    found = values.groupBy("column_name").agg(*total, *own, *sums)
    return found if unique is None else found.join(unique, "column_name", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))


def rates(found: DataFrame) -> DataFrame:
    return found.withColumns({
        "non_null_count": F.col("total_count") - F.col("null_count"),
        "null_rate": E.ratio(F.col("null_count"), F.col("total_count")), "cardinality_rate": E.ratio(F.col("unique_count"), F.col("total_count")),
    })


COUNTS = ("column_name", "total_count", "null_count", "non_null_count", "unique_count", "null_rate", "cardinality_rate")


def counts(values: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """total, null, non-null and distinct counts with null_rate and cardinality_rate (distinct / all rows)."""
    return rates(aggregate(values, unique)).select(*COUNTS)


def approximate_counts(df: DataFrame, columns: Sequence[str] | None = None, error: float = 0.02) -> DataFrame:
    """As :func:`counts` in one pass without a shuffle of values; unique_count is approximate (HyperLogLog++)."""
    columns = list(columns or df.columns)
    cells = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("total_count"), F.count(f"`{c}`").alias("non_null_count"), F.approx_count_distinct(f"`{c}`", error).alias("unique_count")) for c in columns]
    rows = df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))
    return rows.select(
        "column_name", "total_count", (F.col("total_count") - F.col("non_null_count")).alias("null_count"), "non_null_count", "unique_count",
        E.ratio(F.col("total_count") - F.col("non_null_count"), F.col("total_count")).alias("null_rate"), E.ratio(F.col("unique_count"), F.col("total_count")).alias("cardinality_rate"),
    )


def top_values(freq: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values of each column; ties in value order.  Spark cuts the ranked rows to k in each
    partition before the window's shuffle, so a column's many values do not meet in one task."""
    some = freq.filter(F.col("value").isNotNull())
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def entropy(freq: DataFrame) -> DataFrame:
    """Categorical statistics: distinct, most and least frequent value with counts, entropy in bits."""
    some = freq.filter(F.col("value").isNotNull())
    totals = some.groupBy("column_name").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    most, least = F.struct((-F.col("n")).alias("n"), F.col("value")), F.struct(F.col("n"), F.col("value"))
    found = some.join(totals, "column_name").groupBy("column_name").agg(
        F.count("*").alias("unique_categories"), F.min(most).alias("most"), F.min(least).alias("least"), F.sum(-p * F.log2(p + 1e-10)).alias("entropy")
    )
    return found.select(
        "column_name", "unique_categories", F.col("most.value").alias("most_frequent"), (-F.col("most.n")).alias("most_frequent_count"),
        F.col("least.value").alias("least_frequent"), F.col("least.n").alias("least_frequent_count"), "entropy",
    )


def _classes() -> dict[str, Column]:
    v = F.col("value")
    parsed = E.number(v)
    return {
        "is_numeric": parsed.isNotNull(),
        "is_integral": parsed.isNotNull() & (parsed == F.floor(parsed)),
        "is_currency": parsed.isNull() & E.any_match(v, P.CURRENCY),
        "is_date": reduce(lambda a, b: a | b, (E.prefix_matches(v, p) for p in P.DATE_PREFIXES)),
        "is_boolean": F.lower(v).isin(*P.BOOLEANS),
    }


def _class_sums() -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.coalesce(v, F.lit(False)), F.col("n"))), F.lit(0)).alias(k) for k, v in _classes().items()]


def _hint() -> Column:
    """From the sums of classes, non_null_count and unique_count."""
    share = lambda k: E.ratio(F.col(k), F.col("non_null_count"))
    return (
        F.when(F.col("non_null_count") == 0, "empty")
        .when(share("is_numeric") >= 0.8, F.when(F.col("is_integral") > F.col("is_numeric") - F.col("is_integral"), "integer").otherwise("float"))
        .when(share("is_currency") >= 0.7, "currency")
        .when(share("is_date") >= 0.7, "date")
        .when(share("is_boolean") >= 0.8, "boolean")
        .when((share("unique_count") <= 0.1) & (F.col("unique_count") <= 50), "categorical")
        .otherwise("text")
    )


def type_hints(values: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """column_name and data_type_hint: empty, integer, float, currency, date, boolean, categorical or text."""
    return rates(aggregate(values, unique, *_class_sums())).select("column_name", _hint().alias("data_type_hint"))


def pattern_sums() -> list[Column]:
    return [F.coalesce(F.sum(F.when(E.matches(F.col("value"), p), F.col("n"))), F.lit(0)).alias(k) for k, p in P.VALUE_PATTERNS.items()]


def pattern_counts(values: DataFrame) -> DataFrame:
    """Rows whose value matches each of the six value patterns."""
    return values.groupBy("column_name").agg(*pattern_sums())


QUARTILES = (0.25, 0.5, 0.75)


def quartiles(df: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    """(column_name, q25, median, q75) of numeric expressions, exact, interpolated between neighbours.

    Approximate quantiles bound each quartile to a few ten-thousandths of the values; those alone are counted and
    ranked.  No task holds a column's values, and what is collected is a few numbers for each column.
    """
    spark, names = df.sparkSession, list(numbers)
    wide = df.select(*(x.cast("double").alias(f"x{k}") for k, x in enumerate(numbers.values())))
    n = wide.agg(*(F.count(f"x{k}") for k in range(len(names)))).first() if names else ()
    full = [k for k in range(len(names)) if n[k]]
    if not full:
        return spark.createDataFrame([(c, None, None, None) for c in names], "column_name string, q25 double, median double, q75 double")
    margin = {k: 2e-4 + 2 / n[k] for k in full}
    points = {k: [p for q in QUARTILES for p in (max(0.0, q - margin[k]), min(1.0, q + margin[k]))] for k in full}
    found = wide.agg(*(F.percentile_approx(f"x{k}", points[k], 10_000) for k in full)).first()
    spots = [(k, i, found[j][2 * i], found[j][2 * i + 1]) for j, k in enumerate(full) for i in range(len(QUARTILES))]
    below = wide.agg(*(E.count_if(F.col(f"x{k}") < low) for k, _, low, _ in spots)).first()
    ranks = []
    for (k, i, _, _), before in zip(spots, below):
        place = QUARTILES[i] * (n[k] - 1)
        ranks.append((k, i, int(place) - before, min(int(place) + 1, n[k] - 1) - before, place - int(place)))
    cells = [F.when(F.col(f"x{k}").between(low, high), F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.col(f"x{k}").alias("v"))) for k, i, low, high in spots]
    near = wide.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).groupBy("cell.k", "cell.i", "cell.v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("k", "i").orderBy("v")
    running = near.withColumn("after", F.sum("n").over(order)).join(F.broadcast(spark.createDataFrame(ranks, "k int, i int, lower long, upper long, part double")), ["k", "i"])  # three rows for each column
    at = lambda r: F.max(F.when((F.col("after") > F.col(r)) & (F.col("after") - F.col("n") <= F.col(r)), F.col("v")))
    ends = running.groupBy("k", "i", "part").agg(at("lower").alias("a"), at("upper").alias("b"))
    value = {(r.k, r.i): r.a if r.a == r.b or not r.part else r.a * (1 - r.part) + r.b * r.part for r in ends.collect()}
    return spark.createDataFrame([(c, *(value.get((k, i)) for i in range(len(QUARTILES)))) for k, c in enumerate(names)], "column_name string, q25 double, median double, q75 double")


def numeric_statistics(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Moments and quartiles of numeric columns (text is parsed as an amount), moments in one wide aggregate.

    Exact quartiles take three more passes (:func:`quartiles`); ``exact=False`` takes approximate ones with the moments.
    """
    kinds = dict(df.dtypes)
    numbers = {}
    for c in columns or numeric_columns(df):
        numbers[c] = E.amount(F.col(f"`{c}`")) if kinds[c] == "string" else F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    cells = []
    for c, x in numbers.items():
        q = F.percentile_approx(x, list(QUARTILES), 10_000)
        shares = [] if exact else [q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75")]
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"), F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                *shares, (F.max(x) - F.min(x)).alias("range"), E.count_if(x == 0).alias("zeros"), E.count_if(x < 0).alias("negatives"), E.count_if(x > 0).alias("positives"),
            )
        )
    if not cells:
        kind = "column_name string, count long, min double, max double, mean double, std double, q25 double, median double, q75 double, range double, zeros long, negatives long, positives long"
        return df.sparkSession.createDataFrame([], kind)
    rows = df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))
    if not exact:
        return rows
    rows = rows.join(F.broadcast(quartiles(df, numbers)), "column_name")  # a row for each column
    return rows.select("column_name", "count", "min", "max", "mean", "std", "q25", "median", "q75", "range", "zeros", "negatives", "positives")


def date_statistics(df: DataFrame, column: str) -> DataFrame:
    """First and last day, span in days, distinct values, modal year and month (ties: the smallest)."""
    kind = dict(df.dtypes)[column]
    x = E.parse_date(F.col(column)) if kind == "string" else F.col(column).cast("timestamp_ntz").cast("timestamp")
    days = F.floor((F.max(F.unix_timestamp("x")) - F.min(F.unix_timestamp("x"))) / 86400)
    found = df.select(x.alias("x")).agg(
        F.min("x").alias("first"), F.max("x").alias("last"), days.alias("range_days"), F.countDistinct("x").alias("unique_dates"),
        F.mode(F.year("x"), True).alias("most_common_year"), F.mode(F.month("x"), True).alias("most_common_month"),
    )
    return found.select(
        F.lit(column).alias("column_name"), F.date_format("first", "yyyy-MM-dd").alias("min_date"), F.date_format("last", "yyyy-MM-dd").alias("max_date"),
        "range_days", "unique_dates", "most_common_year", "most_common_month",
    )


def text_statistics(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Lengths and character classes of text columns, nulls left out."""
    cells = []
    for c in columns:
        x = F.col(f"`{c}`").cast("string")
        n = F.length(x)
        median = F.percentile(n, F.lit(0.5)) if exact else F.percentile_approx(n, 0.5, 10_000).cast("double")
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("avg_length"), median.alias("median_length"),
                E.count_if(x == "").alias("empty_strings"), E.count_if(x.rlike(r"\d")).alias("contains_digits"), E.count_if(x.rlike(r"[^a-zA-Z0-9\s]")).alias("contains_special"),
                E.count_if(E.all_upper(x)).alias("all_uppercase"), E.count_if(E.all_lower(x)).alias("all_lowercase"),
            )
        )
    return df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))


def quality_score() -> Column:
    """From null_rate, cardinality_rate and data_type_hint."""
    penalty = F.when((F.col("cardinality_rate") < 0.01) | (F.col("cardinality_rate") > 0.95), 0.2).otherwise(0.0)
    bonus = F.when(F.col("data_type_hint").isin("integer", "float", "date", "boolean"), 0.1).otherwise(0.0)
    return E.clamp(1.0 - F.col("null_rate") * 0.3 - penalty + bonus, 0.0, 1.0)


def issues() -> Column:
    seen = reduce(lambda a, b: a + b, (F.col(k) for k in P.VALUE_PATTERNS))
    return E.messages(
        (F.col("null_rate") > 0.5, F.concat(F.lit("High null rate: "), F.format_string("%.1f", F.col("null_rate") * 100), F.lit("%"))),
        ((F.col("cardinality_rate") < 0.01) & (F.col("unique_count") > 1), "Very low cardinality - mostly duplicate values"),
        ((F.col("cardinality_rate") > 0.95) & (F.col("total_count") > 100), "Very high cardinality - mostly unique values"),
        ((F.col("data_type_hint") == "text") & (seen > 0) & (seen < 0.8 * F.col("total_count")), "Mixed data types detected"),
    )


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, *more: Column) -> DataFrame:
    """One row for each column: counts, type hint, pattern counts, quality score and issues, and ``more`` sums over the
    cells, all in one aggregate that is combined in place."""
    found = rates(aggregate(cells(df, columns), distinct_counts(df, columns), *_class_sums(), *pattern_sums(), *more))
    table = found.withColumn("data_type_hint", _hint()).drop(*_classes())
    return table.withColumn("quality_score", quality_score()).withColumn("issues", issues())


def dataset_summary(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.max("total_count").alias("total_rows"), F.count("*").alias("total_columns"), (F.max("total_count") * F.count("*")).alias("total_cells"),
        F.avg("null_rate").alias("avg_null_rate"), F.avg("quality_score").alias("avg_quality_score"),
        E.count_if(F.size("issues") > 0).alias("columns_with_issues"), E.count_if(F.col("quality_score") > 0.8).alias("high_quality_columns"),
    )


def recommendations(profile: DataFrame) -> DataFrame:
    """Up to three sentences, each naming the first three columns (by name) that it is about."""
    kinds = (
        ("Consider handling high null rates in: ", F.col("null_rate") > 0.3),
        ("Potential ID columns detected: ", (F.col("cardinality_rate") > 0.95) & F.col("data_type_hint").isin("integer", "text")),
        ("Consider encoding categorical columns: ", (F.col("data_type_hint") == "categorical") & (F.col("unique_count") > 10)),
    )
    found = profile.agg(*(F.slice(F.array_sort(F.collect_list(F.when(cond, F.col("column_name")))), 1, 3).alias(f"k{i}") for i, (_, cond) in enumerate(kinds)))
    sentences = E.messages(*((F.size(f"k{i}") > 0, F.concat(F.lit(text), F.array_join(f"k{i}", ", "))) for i, (text, _) in enumerate(kinds)))
    return found.select(F.posexplode(sentences).alias("position", "recommendation"))
