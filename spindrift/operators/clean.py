"""Cleaning: headers, null spellings, typed fields and healthcare rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import patterns as P


def _distinct(names: Iterable[str]) -> list[str]:
    """Later repeats of a name get _1, _2, ... (and go on where such a name is taken)."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for name in names:
        own = name
        while own in out:
            seen[name] = seen.get(name, 0) + 1
            own = f"{name}_{seen[name]}"
        out.append(own)
    return out


def normalised_headers(names: Sequence[str]) -> list[str]:
    """Lower case, runs of other characters than letters, digits and _ as one _, none at the ends."""
    plain = (re.sub(r"_+", "_", re.sub(r"\W", "_", n.strip())).strip("_").lower() or "unnamed_column" for n in names)
    return _distinct(plain)


def parser_headers(names: Sequence[str]) -> list[str]:
    return _distinct(re.sub(r"[ -]", "_", n.strip()) for n in names)


def upper_headers(names: Sequence[str]) -> list[str]:
    return _distinct(n.strip().upper() for n in names)


def _texts(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def trim_and_null(df: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """Strip text columns; stripped values among ``tokens`` become null."""
    return df.withColumns({c: E.null_tokens(E.strip(F.col(f"`{c}`")), tokens) for c in _texts(df)})


def null_spellings(df: DataFrame, tokens: Iterable[str] = P.HEALTH_NULLS) -> DataFrame:
    """Whole cells among ``tokens`` become null, without stripping."""
    return df.withColumns({c: E.null_tokens(F.col(f"`{c}`"), tokens) for c in _texts(df)})


def json_safe(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.upper(F.col(f"`{c}`")).isin(*P.JSON_NULLS), F.col(f"`{c}`")) for c in _texts(df)})


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows, then columns, that hold nulls only; one aggregate finds the columns."""
    rows = df.na.drop("all")
    filled = rows.agg(*(F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(rows.columns))).first()
    return rows.select(*(f"`{c}`" for i, c in enumerate(rows.columns) if filled[i]))


def basic_clean(df: DataFrame) -> DataFrame:
    """Ingest cleaning: normalised headers, empty rows and columns dropped, text stripped, null spellings removed."""
    return drop_empty(trim_and_null(df.toDF(*normalised_headers(df.columns)), P.INGEST_NULLS))


def parser_clean(df: DataFrame) -> DataFrame:
    named = df.toDF(*parser_headers(df.columns))
    return trim_and_null(drop_empty(named), P.PARSER_NULLS)


def _is_text(df: DataFrame, c: str) -> bool:
    return dict(df.dtypes)[c] == "string"


def health_values(df: DataFrame) -> DataFrame:
    """Upper-case headers, null spellings, known typos and numeric fields (what does not parse becomes null)."""
    out = null_spellings(df.toDF(*upper_headers(df.columns)))
    fixed = {c: F.coalesce(*(F.when(F.col(f"`{c}`") == wrong, F.lit(right)) for wrong, right in P.TYPOS.items()), F.col(f"`{c}`")) for c in _texts(out)}
    out = out.withColumns(fixed)
    numbers = {c: (E.number(F.col(c)) if _is_text(out, c) else F.col(c).cast("double")) for c in P.NUMERIC_FIELDS if c in out.columns}
    return out.withColumns(numbers)


def health_rules(df: DataFrame) -> DataFrame:
    """Values outside their field's rule become null; DIAGNOSIS_CODE_VALID flags codes and keeps them."""
    def keep(c: str, cond: Column) -> Column:
        return F.when(cond, F.col(c))

    age, share = F.col("AGE"), F.col("COINSURANCE")
    rules = {
        "CLAIM_ID": lambda: keep("CLAIM_ID", E.matches(F.col("CLAIM_ID"), "^(IQV|CMS)")),
        "MEMBER_ID": lambda: keep("MEMBER_ID", E.matches(F.col("MEMBER_ID"), "^(M|PT)")),
        "AGE": lambda: keep("AGE", age.between(0, 120) & ~F.isnan(age)),
        "GENDER": lambda: keep("GENDER", F.col("GENDER").isin("M", "F", "Male", "Female")),
        **{c: (lambda c=c: keep(c, (F.col(c) >= 0) & ~F.isnan(c))) for c in ("TOTAL_CHARGE", "COPAY", "CLAIM_COST")},
        "COINSURANCE": lambda: keep("COINSURANCE", share.between(0, 1) & ~F.isnan(share)),
    }
    out = df.withColumns({c: make() for c, make in rules.items() if c in df.columns})
    if "DIAGNOSIS_CODE" in df.columns:
        out = out.withColumn("DIAGNOSIS_CODE_VALID", E.matches(F.col("DIAGNOSIS_CODE"), P.ICD_STRICT))
    return out


def clean_health(df: DataFrame) -> DataFrame:
    return health_rules(health_values(df))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in this order; missing ones are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
