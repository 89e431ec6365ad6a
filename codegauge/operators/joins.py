"""Joins with the benchmark's integrity rules."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.store import written
from . import contracts, windows


def with_predictions(tasks: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every task with its code, "" where none was submitted, and whether one was."""
    p = predictions.select("task_id", F.col("code").alias("code"), F.lit(True).alias("submitted"))
    return tasks.join(p, "task_id", "left").withColumn("code", F.coalesce("code", F.lit(""))).withColumn("submitted", F.coalesce("submitted", F.lit(False)))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "key sets differ") -> DataFrame:
    """Inner join of two sides whose key sets must be equal."""
    contracts.enforce(contracts.unequal_keys(left, right, keys), how)
    return left.join(right, keys)


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """1:1 join; the other columns end in _a and _b. Repeated keys on a side raise."""
    for side in (a, b):
        contracts.enforce(side.groupBy(*keys).count().where("count > 1"), "keys repeat")
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in a.columns if c not in keys])
    return left.join(b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys]), keys)


def ordered_subset(results: DataFrame, wanted: DataFrame, key: str = "task_id", ordinal: str = "ordinal") -> DataFrame:
    """The rows of the wanted keys (key, ordinal), in that order; a key without a row raises."""
    contracts.enforce(contracts.missing(wanted, results, [key]), "no result for")
    return wanted.select(key, ordinal).join(results, key).orderBy(ordinal)


def eligible(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of eligible keys, eligible keys that have no row)."""
    return rows.join(keys.select(key).distinct(), key, "left_semi"), contracts.missing(keys, rows, [key])


def with_category(findings: DataFrame, mapping: DataFrame, rule: str = "rule") -> DataFrame:
    """The rule's category, "--" where the map has none. The planner broadcasts the map if it is small."""
    return findings.join(mapping.select(F.col(mapping.columns[0]).alias(rule), F.col(mapping.columns[1]).alias("odc")), rule, "left").withColumn("odc", F.coalesce("odc", F.lit("--")))


def first_alias(symbols, mapping: dict[str, str]):
    """(alias, category) of the first of the comma-separated aliases that the map has; map is a literal."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    names = F.transform(F.split(symbols, ","), lambda s: F.trim(s))
    alias = F.get(F.filter(names, lambda s: F.map_contains_key(table, s)), F.lit(0))
    return alias, F.when(alias.isNotNull(), F.try_element_at(table, alias))


def attach_code(selected: DataFrame, dataset: DataFrame, fields: dict[str, str], key: str = "hm_index") -> DataFrame:
    """Selected (key, author, ...) with the code that the dataset's row of the key has in the author's field; null is no code.

    Every selected row must find its dataset row: one that does not raises in the join's own pass, so nothing is read twice.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("author"), F.coalesce(F.col(c), F.lit("")).alias("code")) for a, c in fields.items()])).alias("x")
    long = dataset.join(selected.select(key).distinct(), key, "left_semi").select(key, cells).select(key, "x.*")
    joined = selected.join(long, [key, "author"], "left")
    missing = F.raise_error(F.concat(F.lit("no dataset row for "), F.col(key).cast("string"), F.lit(", "), F.coalesce("author", F.lit("null"))))
    return joined.withColumn("code", F.coalesce("code", missing))


def ordinal_of(path: Column, pattern: str) -> Column:
    """The number, counted from 1, that is the pattern's first group, as one counted from 0; null where there is none."""
    n = F.regexp_extract(path, pattern, 1)
    return F.when(n != "", F.try_subtract(n.try_cast("long"), F.lit(1)))


def by_path_ordinal(paths: DataFrame, keys: DataFrame, path: str = "path", extension: str = r"(?:py|java|c)") -> DataFrame:
    """Paths ending in _<n>.<extension> to keys (key, idx): n counts from 1, idx from 0. Others get a null key."""
    return paths.withColumn("idx", ordinal_of(F.col(path), rf"_(\d+)\.{extension}$")).join(keys, "idx", "left")


def java_files(snippets: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(author, idx, type_name) to file names; the second of a name in file order is Name_2.java.

    overrides (file, idx, author) replace what the rule gives.
    """
    base = F.regexp_replace("type_name", r"[^A-Za-z0-9_]", "_")
    n = F.row_number().over(Window.partitionBy("author", "base").orderBy("idx"))
    named = snippets.withColumn("base", base).withColumn("n", n)
    files = named.select("author", "idx", F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), F.lit(".java")).alias("file"))
    if overrides is None:
        return files
    first = overrides.select("author", "idx", "file")
    return files.join(first.select("author", "file"), ["author", "file"], "left_anti").select("author", "idx", "file").unionByName(first)


class _Open:
    """Spans that are open at a point of a sweep by start, but for those that another one outdoes.

    Of two spans that reach as far as an end, the narrower one, then the one of lower idx, is the parent. So a span is of no more use once one
    that reaches at least as far is preferred to it: what is left has rising ends and is ever less preferred.
    """

    def __init__(self) -> None:
        self.ends: list = []
        self.spans: list[tuple] = []  # (width, idx, start, end)

    def parent(self, end):
        at = bisect_left(self.ends, end)
        return self.spans[at][1] if at < len(self.ends) else None

    def add(self, start, end, idx) -> None:
        span = (end - start, idx, start, end)
        to = bisect_right(self.ends, end)
        if to < len(self.ends) and self.spans[to][:2] < span[:2]:
            return
        at = to
        while at and self.spans[at - 1][:2] > span[:2]:
            at -= 1
        if at and self.ends[at - 1] == end:
            return
        self.ends[at:to], self.spans[at:to] = [end], [span]

    def close(self, start) -> None:
        """Spans that end before start hold nothing that starts there."""
        if self.ends and self.ends[0] < start:
            at = bisect_left(self.ends, start)
            del self.ends[:at], self.spans[:at]


def _swept(rows: DataFrame, file: str, left_open: bool) -> DataFrame:
    """Spans (file, part, start, end, idx, carried) in order of start, the wider ones first: each one's parent, or the spans left open by each part."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spans = None, _Open()

        def rest() -> list[tuple]:
            return [(*now, start, end, idx) for _, idx, start, end in spans.spans] if left_open and now is not None else []

        for b in batches:
            out = []
            for f, part, start, end, idx, carried in zip(*(b.column(c).to_pylist() for c in (file, "part", "start", "end", "idx", "carried"))):
                if (f, part) != now:
                    out += rest()
                    now, spans = (f, part), _Open()
                spans.close(start)
                if not left_open and not carried:
                    out.append((f, part, start, end, spans.parent(end)))
                spans.add(start, end, idx)
            if out:
                yield batch(out)
        if last := rest():
            yield batch(last)

    names = [file, "part", "start", "end", "idx" if left_open else "parent"]
    types = [rows.schema[c].dataType for c in (file, "part", "start", "end", "idx")]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)

    arrow = [to_arrow_type(t) for t in types]
    return rows.mapInArrow(run, ", ".join(f"`{n}` {kinds['idx' if n == 'parent' else n]}" for n in names))


def parents(spans: DataFrame, file: str = "row_id") -> DataFrame:
    """For spans (file, idx, start, end) the smallest strictly containing span of the file, ties to the lowest idx.

    One sweep over the spans in order of start, with the spans that are open. Spans are counted by (start, end) first, so that equal ones
    meet once. They are dealt to ranges of (file, start): a file of many spans lies in several, and each takes over
    what the ranges before it leave open.
    """
    one = spans.groupBy(file, "start", "end").agg(F.min("idx").alias("idx"))
    order = [file, F.col("start"), F.col("end").desc()]
    dealt = written(one.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part")), "spans")
    parts = dealt.groupBy(file, "part").agg(F.min("start").alias("from"))
    several = written(parts.withColumn("n", F.count("*").over(Window.partitionBy(file))).where("n > 1").drop("n"), "span-parts")
    rows = dealt.withColumn("carried", F.lit(False))
    if not several.isEmpty():
        split = dealt.join(several.select(file, "part"), [file, "part"], "left_semi").withColumn("carried", F.lit(False))
        left = _swept(split.repartition(file, "part").sortWithinPartitions(file, "part", "start", F.desc("end")), file, True)
        later = several.select(file, F.col("part").alias("to"), "from")
        carried = left.join(later, file).where((F.col("to") > F.col("part")) & (F.col("end") >= F.col("from")))
        rows = rows.unionByName(carried.select(file, "start", "end", "idx", F.col("to").alias("part"), F.lit(True).alias("carried")))
    best = _swept(rows.repartition(file, "part").sortWithinPartitions(file, "part", "start", F.desc("end")), file, False)
    return spans.join(best.select(file, "start", "end", "parent"), [file, "start", "end"], "left")


def primary(functions: DataFrame, keys: list[str], index: str = "function_index", order: list[str] = ()) -> DataFrame:
    """Of each key the first row, in the given order, whose function index in its sample is 0; rows with a null key go."""
    rows = functions.where(F.col(index) == 0).dropna(subset=keys)
    return windows.keep_first(rows, keys, list(order) or keys)


def author_pairs(values: DataFrame, key: list[str], author: str = "author", value: str = "value") -> DataFrame:
    """For each key the pairs of authors f1 < f2 with their values."""
    left = values.select(*key, F.col(author).alias("f1"), F.col(value).alias("v1"))
    return left.join(values.select(*key, F.col(author).alias("f2"), F.col(value).alias("v2")), key).where("f1 < f2")
