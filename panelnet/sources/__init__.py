"""Readers, writers and the joins that align raw tables with a versioned dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, CSV (with header) or JSON by the path's suffix; a schema is checked, not only applied."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if kind == "json":
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema else reader).json(path)
    df = spark.read.parquet(path)
    if schema:
        have = dict(df.dtypes)
        wrong = {f.name: (f.dataType.simpleString(), have.get(f.name)) for f in schema if have.get(f.name) != f.dataType.simpleString()}
        if wrong:
            raise ValueError(f"{path}: columns differ from the schema: {wrong}")
        df = df.select(schema.names)
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; as many files as df has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_document(df: DataFrame, path: str, variable: str | None = None) -> None:
    """Each row of df as JSON text; with variable as a script that assigns it (`name = {...};`)."""
    doc = F.to_json(F.struct("*"))
    df.select((F.concat(F.lit(f"{variable} = "), doc, F.lit(";")) if variable else doc).alias("value")).write.mode("overwrite").text(path)


def parse_script_document(text: Column, variable: str, schema: str) -> Column:
    """The inverse of write_json_document with a variable."""
    return F.from_json(F.regexp_extract(text, rf"(?s)^{variable} = (.*);\s*$", 1), schema)


def latest_version(versions: DataFrame, key: str = "territory_id") -> DataFrame:
    """The newest version of each key by (year_to, year_from); rows without a key are dropped."""
    w = W.partitionBy(key).orderBy(F.desc("year_to"), F.desc("year_from"))
    return versions.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def interval_join(fact: DataFrame, versions: DataFrame, code: str = "code", year: str = "year") -> DataFrame:
    """fact rows with the dictionary versions valid in their year, both ends included: an equi-join with a residual."""
    v = versions.select(F.col(code).alias("_code"), "territory_id", "year_from", "year_to")
    return fact.join(v, (F.col(code) == F.col("_code")) & F.col(year).between(F.col("year_from"), F.col("year_to"))).drop("_code", "year_from", "year_to")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in an explicit order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_types(nodes: DataFrame, column: str, excluded: list[str]) -> DataFrame:
    """Rows whose type is not excluded; a null type stays."""
    return nodes.where(~F.coalesce(F.col(column).isin(excluded), F.lit(False)))


def edges_within(edges: DataFrame, ids: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with both ends among ids(node_id)."""
    a, b = ids.select(F.col("node_id").alias(src)), ids.select(F.col("node_id").alias(dst))
    return edges.join(a, src, "left_semi").join(b, dst, "left_semi")


def search_names(names: DataFrame, column: str, text: str, limit: int = 10) -> DataFrame:
    """Case-insensitive substring search for at least two characters: the first `limit` in order of name."""
    if len(text) < 2:
        return names.limit(0)
    return names.where(F.lower(column).contains(text.lower())).orderBy(column).limit(limit)
