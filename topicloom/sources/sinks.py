"""Sinks: features, results, labels, vectors, profiles and reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_version(path: str, old: str = "_v4", new: str = "_v5") -> str:
    """The output name that a rescored feature file takes."""
    return path.replace(old, new) if old in path else path + new


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Sweep, ablation and baseline rows, added to those of earlier runs."""
    df.write.mode("append").parquet(path)


def write_labels(labels: DataFrame, run: str, path: str) -> None:
    """Labels of one run, partitioned by run."""
    labels.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def write_run(labels: DataFrame, run: str, config: dict, path: str) -> None:
    """Labels of one run, and its settings beside them as one JSON document; partitioned by run."""
    write_labels(labels, run, path + "/labels")
    row = labels.sparkSession.createDataFrame([(run, json.dumps(config, sort_keys=True))], "run string, config string")
    row.coalesce(1).write.mode("append").partitionBy("run").json(path + "/config")


def write_profiles(profile: DataFrame, slim: DataFrame, path: str) -> None:
    """Full and slim cluster profiles as nested JSON."""
    write_json(profile, path + "/full")
    write_json(slim, path + "/slim")


def console(df: DataFrame, rows: int = 30, digits: int = 4) -> str:
    """A result table as text, its first ``rows`` rows in columns; numbers with fractions get ``digits`` places."""
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    grid = [df.columns] + [[show(x) for x in r] for r in df.limit(rows).collect()]  # a report
    width = [max(map(len, col)) for col in zip(*grid)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in grid)


def html_table(df: DataFrame, title: str = "Report", rows: int = 1000) -> str:
    """A report as one HTML page, its first ``rows`` rows."""
    cell = lambda tag, x: f"<{tag}>{'' if x is None else html.escape(str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "".join(f"<tr>{''.join(cell('td', x) for x in r)}</tr>" for r in df.limit(rows).collect())
    return f"<!doctype html><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>"


def write_html(df: DataFrame, path: str, title: str = "Report", rows: int = 1000) -> None:
    df.sparkSession.createDataFrame([(html_table(df, title, rows),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_ground_truth(gt: DataFrame, concept_categories: DataFrame, path: str) -> None:
    """The labels, and the labels with their concepts' categories."""
    gt.write.mode("overwrite").parquet(path + "/prompt_labels")
    concept_categories.write.mode("overwrite").parquet(path + "/concept_categories")


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("item_id", F.col("v").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def write_annotation(sample: DataFrame, path: str) -> None:
    """Three tables: what annotators see, the categories, and the key."""
    sample.select("item_id", "prompt").write.mode("overwrite").option("header", True).csv(path + "/annotation")
    sample.select("label").distinct().orderBy("label").coalesce(1).write.mode("overwrite").option("header", True).csv(path + "/category_ref")
    sample.select("item_id", "label").write.mode("overwrite").option("header", True).csv(path + "/answer_key")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").format(kind).option("header", True).save(path)
