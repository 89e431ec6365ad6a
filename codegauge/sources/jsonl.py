"""Scans that keep the benchmark's reading rules: object records, blank lines, keys and ordinals."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contracts, windows


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, value): text lines with a sort key that follows file order, whatever order splits are read in.

    ordinal orders the lines inside a file: the byte offset of the split, then the line's place in it. It is not dense.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return raw.withColumn("at", F.monotonically_increasing_id()).select("file", F.struct("block", "at").alias("ordinal"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """One row for each non-blank line, which must be an object; fields as the schema has them, and their ordinal.

    A line that is no object raises when it is read; with tolerant (S11) it is left out, and `rejected` gives it.
    """
    found = lines(spark, path).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    if tolerant:
        found = found.where(is_object)
    else:
        found = found.withColumn("value", F.when(is_object, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no object: "), F.substring("value", 1, 80)))))
    return found.select(F.from_json("value", schema).alias("r"), "ordinal").select("r.*", "ordinal")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The lines that a tolerant scan leaves out."""
    found = lines(spark, path).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    return found.where(~F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))).select("file", "ordinal", "value")


def transformed_lines(spark: SparkSession, path: str, field: str, change, keep_original: bool = False) -> DataFrame:
    """(value, changed): each line with one text field changed; other fields keep their types and order.

    Bad and blank lines, and those where the field is no string, pass as they are. change maps a Column to a Column. With keep_original the result goes to <field>_norm.
    """
    t = lines(spark, path)
    at = f"$['{field}']"
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), at, "variant")) == "STRING"
    old = F.when(is_text, F.get_json_object("value", at))
    target = f"{field}_norm" if keep_original else field
    new = change(old)

    @F.pandas_udf("string")
    def put(value: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([v if x is None else json.dumps(json.loads(v) | {target: x}, ensure_ascii=False) for v, x in zip(value, text)], dtype=object)

    ok = old.isNotNull() & new.isNotNull()
    t = t.select("file", "ordinal", put("value", F.when(ok, new)).alias("value"), F.coalesce(ok & (old != new), F.lit(False)).alias("changed"))
    return t.orderBy("file", "ordinal").select("value", "changed")


def load_index(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """S1 with a unique key that is a non-empty string in the file; a number does not pass as one."""
    typed = lines(spark, path).where(F.trim("value") != "").select(F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "variant")).alias("kind"), F.substring("value", 1, 60).alias("line"))
    contracts.enforce(typed.where(~F.col("kind").eqNullSafe("STRING")).select("line"), f"{key} is no string")
    rows = read_jsonl(spark, path, schema)
    contracts.enforce(contracts.bad_keys(rows, key), f"bad or repeated {key}")
    return rows


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S3: columns of a Parquet table; NaN becomes null, as in the reference's frames."""
    df = spark.read.parquet(path).select(*columns)
    return df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S4."""
    return spark.read.csv(path, header=True, schema=schema, nanValue="nan", mode="FAILFAST")


def read_reports(spark: SparkSession, pattern: str, schema: T.StructType, number: str | None = None) -> DataFrame:
    """One document a file, with its name; number is a pattern whose first group orders the files."""
    df = spark.read.schema(schema).option("multiLine", True).json(pattern).select("*", F.col("_metadata.file_name").alias("file"))
    if number is None:
        return df.withColumn("batch", F.lit(None).cast("long"))
    return df.where(F.col("file").rlike(number)).withColumn("batch", F.regexp_extract("file", number, 1).cast("long"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A two-column CSV of rule and category; an empty category is "--"."""
    return spark.read.csv(path, header=True, schema="rule string, odc string").select(F.trim("rule").alias("rule"), F.coalesce(F.nullif(F.trim("odc"), F.lit("")), F.lit("--")).alias("odc"))


def with_index(found: DataFrame) -> DataFrame:
    """lines' rows with idx, which counts them from 0, densely, in order of files and of places in them; no task holds a file."""
    return windows.before(found.withColumn("one", F.lit(1)), [], ["file", "ordinal"], "one", "idx").drop("one")


def dataset_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, idx): idx counts the non-blank lines from 0, in order of file names and lines."""
    keys = with_index(lines(spark, path).where(F.trim("value") != "")).select(F.get_json_object("value", f"$.{key}").alias("key"), F.col("idx").cast("long").alias("idx"))
    contracts.enforce(contracts.bad_keys(keys, "key"), "dataset keys")
    return keys


def require_inputs(spark: SparkSession, files: list[str] = (), folders: list[str] = ()) -> None:
    """Raises with all inputs that are missing or of the wrong kind; any Hadoop file system."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    bad = []
    for p, want_folder in [*((f, False) for f in files), *((f, True) for f in folders)]:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path) or fs.getFileStatus(path).isDirectory() != want_folder:
            bad.append(p)
    if bad:
        raise FileNotFoundError("missing inputs: " + ", ".join(sorted(bad)[:10]))


def only(df: DataFrame, key: str, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Given ids, all of which must be there, or a number of rows."""
    if ids is not None:
        wanted = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} string")
        contracts.enforce(contracts.missing(wanted, df, [key]), f"no such {key}")
        df = df.where(F.col(key).isin(*ids))
    return df if limit is None else df.limit(limit)


def merged_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row an id, ids with conflicting bodies) of fetched rules (id, body); how many repeated is n - 1."""
    by = rules.groupBy("id").agg(F.min("body").alias("body"), F.count("*").alias("n"), F.countDistinct("body").alias("bodies"))
    return by.select("id", "body", "n"), by.where("bodies > 1").select("id")
