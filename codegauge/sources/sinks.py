"""Sinks: Spark's committers make a write whole or absent; documents of one row are written by the driver."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contracts


def _finite(df: DataFrame) -> DataFrame:
    """NaN and infinities may not be written: they raise."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{f.name} is not finite")).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(out)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """A folder of JSON lines; an existing one is refused unless overwrite. Returns the rows written."""
    seen = Observation()
    _finite(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.option("ignoreNullFields", False).mode("overwrite" if overwrite else "errorifexists").json(path)
    return seen.get["rows"]


def write_document(row: dict, df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON document with sorted keys, through a temporary name; df gives the session."""
    def clean(x):
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("not finite")
        return {k: clean(v) for k, v in x.items()} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, list) else x

    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray((json.dumps(clean(row), sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode()))
    finally:
        stream.close()
    fs.delete(target, False)
    fs.rename(part, target)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """K4, K9: one CSV part with a header, for results of a few rows."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """K5: zstd Parquet, read back and held against what was written: rows and schema."""

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").mode("overwrite" if overwrite else "errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    kinds = lambda d: [(f.name, f.dataType) for f in d.schema.fields]
    if back.count() != seen.get["rows"] or kinds(back) != kinds(df):
        raise contracts.ContractError(f"{path} does not hold what was written")
    return seen.get["rows"]


def write_profiled(df: DataFrame, path: str, by: str, groups: tuple[str, ...], nulls: tuple[str, ...] = (), zeros: tuple[str, ...] = (), overwrite: bool = False) -> list[tuple[str, str, int, int | None, int | None]]:
    """Writes df as K5 does and returns (group, column, rows, nulls, zeros) of each group of `by`, counted while it is written.

    Zeros are null for columns of `nulls` alone, nulls for columns of `zeros` alone. groups are few and known; other values of `by` are counted under "other".
    """
    columns = list(dict.fromkeys((*nulls, *zeros)))
    named = {**{g: F.col(by).eqNullSafe(F.lit(g)) for g in groups}, "other": ~F.coalesce(F.col(by).isin(*groups), F.lit(False))}
    counts = {}
    for i, inside in enumerate(named.values()):
        counts[f"n{i}"] = F.count_if(inside)
        for j, c in enumerate(columns):
            counts[f"n{i}_{j}"] = F.count_if(inside & F.col(c).isNull())
            counts[f"z{i}_{j}"] = F.count_if(inside & (F.col(c) == 0))
    seen = Observation()
    write_table(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), path, overwrite)
    got = seen.get
    return [(g, c, got[f"n{i}"], got[f"n{i}_{j}"] if c in nulls else None, got[f"z{i}_{j}"] if c in zeros else None) for i, g in enumerate(named) for j, c in enumerate(columns) if g != "other" or got[f"n{i}"]]


def write_by_author(df: DataFrame, path: str, author: str = "author", overwrite: bool = False) -> None:
    """K6: a folder for each author; authors without rows get none."""
    df.repartition(author, F.pmod(F.xxhash64(*[c for c in df.columns if c != author]), F.lit(8))).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(author).json(path)


def markdown(df: DataFrame, percents: tuple[str, ...] = (), most: int = 1000) -> str:
    """K7: a small result as a table; shares in percent, an em dash for null. A result of more than `most` rows is no report and raises."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda c, v: "—" if v is None else f"{100 * v:.1f}%" if c in percents else f"{v:.3f}" if isinstance(v, float) else str(v)
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(show(c, r[c]) for c in df.columns) + " |" for r in rows]) + "\n"
