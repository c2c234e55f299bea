"""Splits of a mixed table into claims and patients, and samples.  Three different split rules, each by its name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .clean import project


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def split_by_identifier(df: DataFrame, projected: bool = True) -> tuple[DataFrame, DataFrame]:
    """Claims have a MEMBER_ID, demographics have an ID and no MEMBER_ID, rows with neither are dropped."""
    claims, people = df.filter(_filled("MEMBER_ID")), df.filter(~F.coalesce(_filled("MEMBER_ID"), F.lit(False)) & _filled("ID"))
    return (project(claims, P.CLAIM_PROJECTION), project(people, P.PATIENT_PROJECTION)) if projected else (claims, people)


def count_by_name(df: DataFrame) -> DataFrame:
    """Claims and patients counted by whether LAST_NAME is filled."""
    named = F.coalesce(_filled("LAST_NAME"), F.lit(False))
    return df.agg(F.count_if(~named).alias("claims_records"), F.count_if(named).alias("patient_records"))


def _any(df: DataFrame, columns) -> Column:
    present = [F.col(c).isNotNull() for c in columns if c in df.columns]
    return reduce(lambda a, b: a | b, present) if present else F.lit(False)


def _relevant(df: DataFrame, columns) -> list[str]:
    return [c for c in df.columns if c in columns or c.endswith("_VALID")]


def split_mixed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By any filled field of a side; rows with fields of both sides go to both outputs."""
    claim, patient = _any(df, P.CLAIM_FIELDS), _any(df, P.PATIENT_FIELDS)
    return df.filter(claim).select(*_relevant(df, P.CLAIM_FIELDS)), df.filter(patient).select(*_relevant(df, P.PATIENT_FIELDS))


def union_once(df: DataFrame) -> DataFrame:
    """The rows that either side of :func:`split_mixed` takes, each once."""
    return df.filter(_any(df, P.CLAIM_FIELDS) | _any(df, P.PATIENT_FIELDS))


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def sample_rows(df: DataFrame, key: str, n: int = 10_000, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same ones under any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)
