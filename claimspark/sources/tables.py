"""Reading the nine source tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.values import null_tokens_to_null, to_flag, to_number
from claimspark.sources.schemas import NULL_TOKENS, NUMERIC_COLUMNS, SOURCE_COLUMNS, text_schema


@dataclass(frozen=True)
class ClaimTables:
    """The nine source tables after typing."""

    claims: DataFrame
    denials: DataFrame
    encounters: DataFrame
    diagnoses: DataFrame
    procedures: DataFrame
    lab_tests: DataFrame
    medications: DataFrame
    patients: DataFrame
    providers: DataFrame


# File name of each table and its field
TABLE_FIELDS = {
    "claims_and_billing": "claims",
    "denials": "denials",
    "encounters": "encounters",
    "diagnoses": "diagnoses",
    "procedures": "procedures",
    "lab_tests": "lab_tests",
    "medications": "medications",
    "patients": "patients",
    "providers": "providers",
}


def read_csv_table(
    spark: SparkSession, path: str, table: str, columns: tuple[str, ...] | None = None, multi_line: bool = False
) -> DataFrame:
    """A CSV file (or folder of files) as text columns, in the column order of its header.

    A cell that goes over several lines needs `multi_line`, which reads each file in one task;
    without it such a file is an error, never two rows. `_order` gives the place of each row in its file, for keep-first rules.
    """
    columns = columns or SOURCE_COLUMNS[table]
    lines = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("enforceSchema", False)
        .schema(text_schema(columns))
        .csv(path)
    )
    ordered = lines.select(
        *[F.col(f"`{c}`") for c in columns if c != "_order"],
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_order"),
    )
    return null_tokens_to_null(ordered, NULL_TOKENS)


def read_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of a CSV file, from its first line alone."""
    return tuple(spark.read.option("header", True).csv(path).columns)


def typed(df: DataFrame) -> DataFrame:
    """Amounts to double and flags to boolean, where the table has them."""
    columns = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in NUMERIC_COLUMNS:
            c = to_number(c)
        elif name in ("primary_flag", "chronic_flag"):
            c = to_flag(c)
        columns.append(c.alias(name))
    return df.select(*columns)


def read_claim_tables(spark: SparkSession, folder: str, multi_line: bool = False) -> ClaimTables:
    """All nine tables from `<folder>/<table>.csv`."""

    def table(name: str) -> DataFrame:
        path = f"{folder}/{name}.csv"
        return typed(read_csv_table(spark, path, name, read_header(spark, path), multi_line))

    return ClaimTables(**{field: table(name) for name, field in TABLE_FIELDS.items()})


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works for any file system Spark can reach."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def resolve_sources(
    spark: SparkSession, raw: tuple[str, str], augmented: tuple[str, str], no_augment: bool = False
) -> tuple[str, str, bool]:
    """(claims path, denials path, used augmented): the augmented pair only if both files exist."""
    if not no_augment and all(path_exists(spark, p) for p in augmented):
        return (*augmented, True)
    return (*raw, False)


def default_training_folder(spark: SparkSession, augmented: str, raw: str, train_table: str = "train") -> str:
    """The augmented folder if it has a training table, else the raw one."""
    return augmented if path_exists(spark, f"{augmented}/{train_table}") else raw


def read_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation tables written by `sinks.write_split`."""
    return spark.read.parquet(f"{folder}/train"), spark.read.parquet(f"{folder}/eval")
