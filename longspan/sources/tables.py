"""Scans: common-model folders, native cohort files, and the cohort registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.sources import contracts

TABLES = ("participants", "visits", "modality_features", "outcomes")

# Rank of a row in its input files; see ``scan_text``.
FILE_ORDER = "__file_order"


@dataclass(frozen=True)
class CohortTables:
    """The four common-model tables of one or more cohorts, as lazy plans."""

    participants: DataFrame
    visits: DataFrame
    modality_features: DataFrame
    outcomes: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def _scan(spark: SparkSession, path: str, expected: str, load: Callable[[str], DataFrame]) -> DataFrame:
    try:
        return load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"{expected} not found at {path}") from error
        raise


def scan_text(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """All-string CSV scan with a column that keeps the order rows have in the file.

    Splits are not read in file order, so the order is the file, the offset of
    the split in it, and the row's place in the split.
    """
    raw = _scan(spark, path, expected, lambda p: spark.read.option("header", True).csv(p))
    return raw.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(FILE_ORDER),
    )


def read_common_model(
    spark: SparkSession, folder: str, cohort: str | None = None, fmt: str = "csv", contract: str | None = None
) -> CohortTables:
    """Read the four tables of a folder, check required columns, apply contract types.

    Columns outside the contract pass through as text (CSV) or as stored
    (Parquet). ``cohort`` relabels the cohort column.
    """
    raw = {}
    for table in TABLES:
        name = f"{table}.{fmt}"
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        raw[table] = _scan(spark, f"{folder.rstrip('/')}/{name}", name, lambda path: reader.format(fmt).load(path))
    return common_model(raw, cohort, contract)


def common_model(raw: Mapping[str, DataFrame], cohort: str | None = None, contract: str | None = None) -> CohortTables:
    """The four tables from DataFrames of any origin, checked and typed by the contract."""
    contracts.check_tables(raw, contract)
    schemas = contracts.contract_schemas(contract)
    frames = {table: contracts.typed(raw[table], schemas[table], cohort) for table in TABLES}
    return CohortTables(**frames)


def write_common_model(tables: CohortTables, folder: str, fmt: str = "parquet") -> None:
    """Write the tables; visits, participants by cohort and measurements by modality."""
    layout = {"participants": ["cohort"], "visits": ["cohort"], "modality_features": ["modality"], "outcomes": []}
    for name, df in tables.named().items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        elif layout[name]:
            writer = writer.partitionBy(*layout[name])
        writer.save(f"{folder.rstrip('/')}/{name}.{fmt}")


# Registered cohorts -> (reader key, default folder).
REGISTRY = {
    "adni": ("adni", "data/raw/adni"),
    "nacc": ("nacc", "data/raw/nacc"),
    "aibl": ("aibl", "data/raw/aibl"),
    "oasis": ("oasis", "data/raw/oasis"),
    "tlsa": ("common", "data/secure/tlsa"),
    "sanscog": ("common", "data/secure/sanscog"),
}


def read_cohort(spark: SparkSession, name: str, folder: str | None = None) -> CohortTables:
    """Read one registered cohort."""
    from longspan.sources import native

    if name not in REGISTRY:
        raise KeyError(f"Unknown cohort: {name}")
    kind, default = REGISTRY[name]
    folder = folder or default
    if kind == "common":
        return read_common_model(spark, folder, cohort=name)
    return native.READERS[kind](spark, folder)


def read_cohorts(spark: SparkSession, folders: Mapping[str, str]) -> CohortTables:
    """Read several registered cohorts and stack their tables."""
    return stack_tables([read_cohort(spark, name, folder) for name, folder in folders.items()])


def stack_tables(cohorts: Sequence[CohortTables]) -> CohortTables:
    parts = [tables.named() for tables in cohorts]
    return CohortTables(
        **{
            table: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p[table] for p in parts])
            for table in TABLES
        }
    )
