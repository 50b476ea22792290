"""Report and metadata sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longspan.sources import contracts


def report_lines(title: str, metrics: DataFrame, notes: Sequence[str] = ()) -> DataFrame:
    """(line_number, line) of a markdown report; ``metrics`` has position, name, value."""
    spark = metrics.sparkSession
    head = [(0, f"# {title}"), (1, ""), (2, "## Metrics")]
    tail = ["", "## Notes", *[f"- {n}" for n in notes]] if notes else []
    fixed = spark.createDataFrame(
        [(0, i, text) for i, text in head] + [(2, i, text) for i, text in enumerate(tail)],
        "section int, position int, line string",
    )
    body = metrics.select(
        F.lit(1).alias("section"),
        F.col("position").cast("int").alias("position"),
        F.format_string("- %s: %.4f", "name", F.bround(F.col("value").cast("double"), 4)).alias("line"),
    )
    # A report has a handful of lines, so one window partition numbers them.
    order = Window.partitionBy(F.lit(0)).orderBy("section", "position")
    return fixed.unionByName(body).select((F.row_number().over(order) - 1).alias("line_number"), "line")


def report_markdown(title: str, metrics: Mapping[str, float], notes: Sequence[str] = (), spark: SparkSession | None = None) -> str:
    """The report as one text, ending in a newline."""
    spark = spark or SparkSession.active()
    rows = spark.createDataFrame(
        [(i, n, float(v)) for i, (n, v) in enumerate(metrics.items())], "position int, name string, value double"
    )
    lines = report_lines(title, rows, notes).orderBy("line_number").collect()
    return "\n".join(r.line for r in lines) + "\n"


def write_report(lines: DataFrame, path: str) -> None:
    """Write the few report lines in order as one text file."""
    lines.orderBy("line_number").select("line").coalesce(1).write.mode("overwrite").text(path)


def model_metadata(spark: SparkSession, framework: str = "pyspark.ml") -> DataFrame:
    """One row: horizons, features and weight per modality, framework."""
    groups = [(m, list(f), float(contracts.GROUP_WEIGHTS[m])) for m, f in contracts.MODEL_GROUPS.items()]
    return spark.createDataFrame(
        [(list(contracts.HORIZON_YEARS), groups, framework)],
        "horizons array<int>, modalities array<struct<modality string, features array<string>, weight double>>, framework string",
    )


def export_models(spark: SparkSession, models: Mapping[str, object], folder: str) -> None:
    """Save fitted ML models under their names, linear ones and the metadata as JSON."""
    for name, model in models.items():
        path = f"{folder.rstrip('/')}/{name}"
        if hasattr(model, "frame"):
            model.frame(spark).coalesce(1).write.mode("overwrite").json(path)
        else:
            model.write().overwrite().save(path)
    model_metadata(spark).coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/config")
