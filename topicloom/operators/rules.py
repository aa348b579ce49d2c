"""Data-quality rules: filters as DataFrame functions, expectations, layered settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Rule = Callable[[DataFrame], DataFrame]


def needs(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def flag_filter(column: str, value=1, enabled: bool = True) -> Rule:
    def apply(df):
        needs(df, column)
        return df.where(F.col(column) == value) if enabled else df

    return apply


def valid_sample(condition: Column, order: list[str], n: int | None = None) -> Rule:
    def apply(df):
        rows = df.where(condition).orderBy(*order)
        return rows if n is None else rows.limit(n)

    return apply


def null_issues(*columns: str) -> Rule:
    def apply(df):
        needs(df, *columns)
        return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))

    return apply


def chain(df: DataFrame, *rules: Rule) -> DataFrame:
    return reduce(lambda d, r: d.transform(r), rules, df)


def between(column: str, first=None, last=None, enabled: bool = True) -> Rule:
    """Rows from ``first`` to ``last`` (dates or values, both included; None: open)."""

    def apply(df):
        needs(df, column)
        if not enabled:
            return df
        for end, ok in ((first, lambda c: c >= first), (last, lambda c: c <= last)):
            df = df if end is None else df.where(ok(F.col(column)))
        return df

    return apply


def counted(rule: Rule) -> tuple[Rule, tuple[Observation, Observation]]:
    """The rule, and what Spark observes of it: ``rows`` before and after, filled by the first action, without a job of its own."""
    before, after = Observation(), Observation()
    rows = F.count(F.lit(1)).alias("rows")
    return (lambda df: rule(df.observe(before, rows)).observe(after, rows)), (before, after)


@dataclass(frozen=True)
class Checked:
    """The outcome of a validation."""

    errors: tuple[str, ...]

    @property
    def has_errors(self) -> bool:
        return bool(self.errors)


def validate(df: DataFrame, wanted: dict[str, str] | None = None, expectations: dict[str, Column] | None = None, strict: bool = False) -> Checked:
    """Schema errors and broken expectations of a frame, in one pass; ``strict`` raises them. Expectations are looked at only if the schema holds."""
    errors = schema_errors(df, wanted or {})
    if not errors and expectations:
        errors = [f"{r.rule}: {r.failures} of {r.rows} rows" for r in quality_report(df, expectations).where("failures > 0").collect()]  # one row an expectation
    if strict and errors:
        raise ValueError("; ".join(errors))
    return Checked(tuple(errors))


class Frames:
    """Named frames, each made on first use and kept: ``Frames(raw=lambda f: ..., clean=lambda f: f["raw"]...)``."""

    def __init__(self, **makers: Callable[["Frames"], DataFrame]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self).persist(StorageLevel.MEMORY_AND_DISK)
        return self._made[name]

    def clear(self) -> None:
        for df in self._made.values():
            df.unpersist()
        self._made.clear()


def anomalies(df: DataFrame, group: str, value: str, z: float = 2.0) -> DataFrame:
    """(group, side, n, mean_excess): rows more than ``z`` standard deviations from their group's mean, by group and side."""
    s = df.groupBy(group).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    far = df.select(group, value).join(s, group).withColumn("d", F.round((F.col(value) - F.col("m")) / F.nullif("s", F.lit(0.0)), 6)).where(F.abs("d") > z)
    return far.groupBy(group, F.when(F.col("d") > 0, "high").otherwise("low").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("d")) - z, 4).alias("mean_excess"))


def quality_report(df: DataFrame, expectations: dict[str, Column]) -> DataFrame:
    """(rule, failures, rows): how many rows break each expectation, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"f{i}") for i, c in enumerate(expectations.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f{i}").alias("failures"), F.col("rows").alias("rows")) for i, n in enumerate(expectations)])).alias("r")).select("r.*")


def schema_errors(df: DataFrame, wanted: dict[str, str]) -> list[str]:
    """What keeps a frame from the wanted (column, type) schema; empty if nothing."""
    have = dict(df.dtypes)
    return [f"{c}: missing" if c not in have else f"{c}: {have[c]}, not {t}" for c, t in wanted.items() if have.get(c) != t]


def merged(*layers: dict) -> dict:
    """Settings in layers: later ones win, siblings stay."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def root_causes(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_value"))


def comparison(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Attributes side by side."""
    return df.groupBy(row).pivot(column, columns).agg(F.round(F.sum(value), 2))
