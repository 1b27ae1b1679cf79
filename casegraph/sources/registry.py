"""Reading public registries with declared types; rows that do not fit are kept apart with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from casegraph.functions.text import normalize_name
from casegraph.operators.crossref import REGISTRIES
from casegraph.sources.schemas import REGISTRIES as SCHEMAS


def read_registry(spark: SparkSession, path: str, kind: str, fmt: str = "csv") -> DataFrame:
    """A registry with its ``normalized_name``; CSV files have a header line. A faulty row stops the reading."""
    reader = spark.read.schema(SCHEMAS[kind])
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return with_normalized_name(reader.format(fmt).load(path), kind)


def with_normalized_name(registry: DataFrame, kind: str) -> DataFrame:
    return registry.withColumn("normalized_name", normalize_name(F.col(REGISTRIES[kind].name_col)))


def load_registry(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows of the CSV files of a registry, in one reading of each.

    Files have a header line with the declared columns in order. A row is rejected if it has too
    few or too many fields, if a field is not of its declared type, or if it has no id or no name;
    ``rejected`` is (line, reasons): the raw line and one reason for each fault, in column order.
    Amounts have at most the digits that are declared; an empty field is null.
    """
    target = T.StructType.fromDDL(SCHEMAS[kind])
    name_col = REGISTRIES[kind].name_col
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in target] + [T.StructField("_line", T.StringType())])
    rows = (
        spark.read.schema(raw).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line").option("escape", '"').option("recursiveFileLookup", "true")
        .option("columnPruning", False).csv(path)  # fields are counted in full rows only
    )

    def typed(field: T.StructField) -> Column:
        value = F.trim(F.col(field.name))
        if isinstance(field.dataType, T.StringType):
            return F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            # a cast would round; more decimals than declared are a fault
            plain = value.rlike(rf"^[+-]?\d+(\.\d{{1,{field.dataType.scale}}})?$")
            return F.when(plain, value).try_cast(field.dataType)
        return value.try_cast(field.dataType)

    given = {f.name: F.trim(F.col(f.name)) != "" for f in target}
    faults = [F.when(F.col("_line").isNotNull(), F.lit("wrong number of fields"))]
    for f in target:
        if f.name in ("id", name_col):
            faults.append(F.when(F.col("_line").isNull() & ~F.coalesce(given[f.name], F.lit(False)), F.lit(f"no {f.name}")))
        if not isinstance(f.dataType, T.StringType):
            faults.append(F.when(F.col("_line").isNull() & given[f.name] & typed(f).isNull(), F.lit(f"invalid {f.name}")))
    checked = rows.withColumn("_reasons", F.array_compact(F.array(*faults)))
    good = checked.where(F.size("_reasons") == 0).select(*[typed(f).alias(f.name) for f in target])
    whole = F.coalesce("_line", F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("")) for f in target]))
    rejected = checked.where(F.size("_reasons") > 0).select(whole.alias("line"), F.col("_reasons").alias("reasons"))
    return with_normalized_name(good, kind), rejected
