"""Mixing sources to target token shares by entropy balancing.

Each source i must give target_i words. Among the document rates r in (0, CAP) that do so, entropy balancing
takes those nearest to 1 in (bounded) relative entropy, which tilts them exponentially in the document's size:

    r / (CAP - r) = 1 / (CAP - 1) * exp(lambda_i * size / scale_i)

lambda_i is the root of the gradient of the convex dual, sum(size * r) = target_i. All sources step together:
one distributed aggregation over the counts of (source, size) for each safeguarded Newton step. Rates are then rounded to whole
copies. Documents of one source and size share a rate, so a group gives floor(rate) copies of each and one more
of as many as are still due; what a size cannot round is carried to the next smaller size of the source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS, CAP = (5, 2, 1), 3
#: Documents of one source and size are ranked in lots of about so many, so that no task gets a large group.
LOT = 256
SALTS = 16


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.expr(f"regexp_count(text, r'{shared.WORD}')"), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(by_source: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """by_source (source, source_size) with weight and target: min(cap * source_size, level * weight), where
    the one level shares out all words. Sources rank by code point, null last.

    The level is found by repeated sharing: a source above its cap is held there and the rest is shared again.
    Each round is an aggregate whose one row comes to the driver.
    """
    spark = by_source.sparkSession
    # Dense ranks without one task that sorts everything: rank in a range partition plus the rows before it.
    ranged = by_source.repartitionByRange(F.col("source").isNull(), F.coalesce("source", F.lit(""))).withColumn("part", F.spark_partition_id())
    ranged = shared.written(ranged, "sources")
    order = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    before, total = {}, 0
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        before[part], total = total, total + n
    if not before:
        return by_source.select("*", F.lit(0).cast("double").alias("weight"), F.lit(0).cast("double").alias("target"))
    start = spark.createDataFrame(list(before.items()), "part int, start long")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = ranged.withColumn("n", F.row_number().over(order)).join(start, "part").withColumn("weight", F.element_at(cycle, (F.pmod(F.col("start") + F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")))
    w = shared.written(w.select("source", "source_size", "weight"), "source-weights")
    level = 0.0
    while True:  # each round holds at least one more source at its cap
        held = F.col("source_size") * float(cap) <= F.lit(level) * F.col("weight")
        row = w.agg(F.sum("source_size"), F.sum(F.when(held, F.col("source_size") * float(cap)).otherwise(0.0)), F.sum(F.when(~held, F.col("weight")).otherwise(0.0))).first()
        new = (row[0] - row[1]) / row[2] if row[2] else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return w.select("source", "source_size", "weight", F.least(F.col("source_size") * float(cap), F.lit(level) * F.col("weight")).alias("target"))


def _rate(lam: str, cap: float) -> str:
    """The rate as SQL; written so that exp() never overflows."""
    return f"{cap}D / (1D + {cap - 1}D * exp(-greatest(-500D, least(500D, {lam} * size / scale))))"


def multipliers(hist: DataFrame, goals: DataFrame, cap: float = CAP, steps: int = 60, close: float = 1e-9) -> DataFrame:
    """(source_key, lambda, scale) with sum(n * size * rate) = target in each source of hist (source_key, size, n).

    Newton from 0 inside a bracket that every step narrows; where Newton leaves the bracket, its middle is taken.
    """
    scale = hist.groupBy("source_key").agg(F.try_divide(F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")), F.sum(F.col("size") * F.col("n"))).alias("scale"))
    state = goals.where("target > 0 and target < source_size * %r" % float(cap)).join(scale, "source_key").select("source_key", "target", "scale", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(1.0).alias("off"))
    state = shared.written(state, "newton")
    for _ in range(steps):
        r = F.expr(_rate("lam", float(cap)))
        terms = hist.join(state, "source_key").where("size > 0")
        got = terms.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size") * r).alias("f"), F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("scale") * r * (1 - r / float(cap))).alias("df"))
        new = state.join(got, "source_key").withColumn("gap", F.col("f") - F.col("target"))
        new = new.withColumn("low", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("high")))
        step = F.expr("lam - gap / nullif(df, 0D)")
        new = new.withColumn("step", F.when(step.isNull() | ~(step > F.col("low")) | ~(step < F.col("high")), (F.col("low") + F.col("high")) / 2).otherwise(step))
        off = F.abs(F.col("gap")) / F.col("target")
        new = new.select("source_key", "target", "scale", F.when(off <= close, F.col("lam")).otherwise(F.col("step")).alias("lam"), "low", "high", off.alias("off"))
        old, state = state, shared.written(new, "newton")
        shared.drop_written(old)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= close:
            break
    return state.select("source_key", "lam", "scale")


def _round_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the largest size down: copies for all, and how many get one more; the words left over are carried."""
    pdf = pdf.sort_values("size", ascending=False)
    base = np.floor(pdf["rate"].to_numpy() + 1e-12)
    part, carry, extra = np.maximum(pdf["rate"].to_numpy() - base, 0.0), 0.0, []
    for s, n, f in zip(pdf["size"].tolist(), pdf["n"].tolist(), part.tolist()):
        due = carry + n * f * s
        m = min(n, max(0, round(due / s))) if s and f > 0 else 0
        carry = due - m * s
        extra.append(m)
    return pdf.assign(base=base.astype("int64"), extra=np.array(extra, "int64"))[["source_key", "size", "n", "rate", "base", "extra"]]


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row for each row of docs: doc_id, source, text_hash, size, source_size, target, rate, copies, taken.

    size counts the words of the whole text (null and empty: 0); a document without words is never copied. Null
    is a source of its own, ranked last. Rows that repeat are documents of their own. Only doc_id, source and
    text are read. An empty table gives no rows. The same table always gives the same copies.
    """
    rows = shared.written(sizes(docs), "doc-sizes")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = rows.withColumn("source_key", key)
    hist = shared.written(rows.groupBy("source_key", "size").agg(F.count("*").alias("n")), "size-counts")
    by_source = hist.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_source = by_source.withColumn("source", F.expr("if(source_key = 'n', null, substring(source_key, 2))"))
    goals = targets(by_source.select("source", "source_size"), weights, cap)
    goals = shared.written(goals.withColumn("source_key", key).select("source_key", "source_size", "target"), "targets")
    lam = multipliers(hist, goals, cap)
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("target") <= 0, 0.0).when(F.col("lam").isNull(), float(cap)).otherwise(F.expr(_rate("lam", float(cap))))
    rated = hist.join(goals, "source_key").join(lam, "source_key", "left").select("source_key", "size", "n", rate.alias("rate"))
    plan = rated.groupBy("source_key").applyInPandas(_round_source, "source_key string, size long, n long, rate double, base long, extra long")
    plan = shared.written(plan.join(goals, "source_key"), "copies")
    # Which documents get one more copy: those first by hash, in lots; a lot counts those left out where they are fewer.
    # A large group meets its plan in SALTS places, and is ranked in lots; equal rows get equal ranks and so equal copies.
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hashed = F.xxhash64("doc_id", "text_hash", F.lit(7))
    placed = rows.withColumn("salt", F.pmod(hashed, F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["source_key", "size", "salt"])  # the planner does not count the salts: it would broadcast
    placed = placed.withColumn("lots", (F.col("n") / LOT).cast("long") + 1)
    placed = placed.withColumn("lot", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("lots")))
    share = lambda due: F.expr(f"((lot + 1) * {due}) div lots - (lot * {due}) div lots")
    same = Window.partitionBy("source_key", "size", "lot")
    placed = placed.withColumn("k", F.rank().over(same.orderBy(hashed, "doc_id", "text_hash"))).withColumn("in_lot", F.count("*").over(same))
    more = F.when(F.col("extra") * 2 <= F.col("n"), F.col("k") <= share("extra")).otherwise(F.col("k") <= F.col("in_lot") - share("(n - extra)"))
    placed = placed.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.least(F.col("base") + more.cast("long"), F.lit(cap))).cast("long"))
    return placed.select("doc_id", "source", "text_hash", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to cap times), all columns as they were."""
    i, h, s, c = shared.fresh(docs, "id", "hash", "source", "copies")
    got = mix(docs, weights, cap).where("copies > 0").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("source").alias(s), F.col("copies").cast("int").alias(c)).distinct()
    on = docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(h)) & docs["source"].eqNullSafe(F.col(s))
    return docs.join(got.hint("merge"), on).withColumn(c, F.explode(F.array_repeat(F.lit(1), F.col(c)))).select([docs[x] for x in docs.columns])
