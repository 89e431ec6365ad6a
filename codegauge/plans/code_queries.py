"""Queries over code that Spark writes from the customers: a function of some parameters, nested tests and assignments for each.

What the scanners must find follows from the numbers the code is made of, so SQL can say it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import masking, scan
from ..operators import joins
from ..sources.store import spread
from . import evaluate
from .registry import query, t

# Parameters, nested ifs, further assignments, and whether a function stands inside.
_MADE = "(select c_custkey as id, 1 + c_custkey % 4 as k, c_nationkey % 4 as d, c_custkey % 5 as s, (c_custkey % 3 = 0)::int as nested from customer)"
_LINES = {
    "python": """concat(array(concat('def f', id, '(', parameters, '):'), concat('    # note ', id)), if(nested = 1, array('    def g(q):', '        return q'), array()),
        transform(slice(sequence(1, 4), 1, d), i -> concat(repeat('    ', i), 'if p0:')), array(concat(repeat('    ', d + 1), 'x = 1')), array_repeat('    x = 1', s), array(concat('    return ', id + 1000)))""",
    "c": """concat(array(concat('int f', id, '(int ', replace(parameters, ', ', ', int '), ') {'), concat('    /* note ', id, ' */')), transform(slice(sequence(1, 4), 1, d), i -> concat(repeat('    ', i), 'if (p0) {')),
        array(concat(repeat('    ', d + 1), 'x = 1;')), transform(slice(sequence(1, 4), 1, d), i -> concat(repeat('    ', d + 1 - i), '}')), array_repeat('    x = 1;', s), array(concat('    return ', id + 1000, '; // end'), '}'))""",
}


def made(spark, sf: str) -> DataFrame:
    """(id, k, d, s, nested, name, python, c); what reads the code takes long, so rows are dealt out first."""
    c = F.col
    customers = t(spark, sf, "customer")
    rows = spread(customers.select("c_custkey", "c_nationkey"), customers.count(), "c_custkey").select(c("c_custkey").cast("int").alias("id"), *[x.cast("int").alias(n) for n, x in (("k", 1 + c("c_custkey") % 4), ("d", c("c_nationkey") % 4), ("s", c("c_custkey") % 5))])
    rows = rows.withColumn("nested", (c("id") % 3 == 0).cast("int")).withColumn("name", F.concat(F.lit("f"), "id")).withColumn("parameters", F.expr("array_join(transform(sequence(0, k - 1), i -> concat('p', i)), ', ')"))
    return rows.select("*", *[F.expr(f"array_join({lines}, '\\n')").alias(language) for language, lines in _LINES.items()])


def samples(spark, sf: str) -> DataFrame:
    """(id, language, name, k, code, arity): both languages' code of each; every third arity is one too many."""
    both = F.explode(F.array(*[F.struct(F.lit(x).alias("language"), F.col(x).alias("code")) for x in _LINES])).alias("x")
    return made(spark, sf).select("id", "name", "k", (F.col("k") + (F.col("id") % 3 == 1).cast("int")).alias("arity"), both).select("id", "name", "k", "arity", "x.*")


@query(f"""select id, 'python' as language, true as parseable, true as target_present, id % 3 <> 1 as arity_ok, false as stub, false as constant, 4 + 2 * k + 3 * d + 3 + 3 * s + 2 + 8 * nested as token_count, d + s + 2 + 2 * nested as statement_count from {_MADE}
    union all select id, 'c', true, true, id % 3 <> 1, false, false, 21 + 3 * k + 6 * d + 4 * s, s + 2 + d from {_MADE}""")
def code_facts(spark, sf):
    """Structure of each sample against its signature."""
    x = samples(spark, sf).withColumn("key", F.struct("id", "language"))
    facts = scan.with_facts(x.select(F.concat_ws(":", "id", "language").alias("key"), "language", "code", "name", "arity"), "key", functions=False)
    at = F.split("key", ":")
    return facts.select(at[0].cast("int").alias("id"), at[1].alias("language"), *[f"facts.{c}" for c in ("parseable", "target_present", "arity_ok", "stub", "constant", "token_count", "statement_count")])


@query(f"""select id, language, uid, parent, place, name, detected, nloc::double as nloc, ccn::double as ccn, parameters::double as parameters, nesting::double as nesting, (o + a)::double as vocabulary, round((all_o + all_a) * log2(o + a), 6) as volume, line_from, line_to from (
    select id, 'python' as language, id || ':code:0' as uid, null as parent, 0 as place, 'f' || id as name, 1 + nested as detected, 3 + 2 * nested + d + s as nloc, 1 + d as ccn, k as parameters, d as nesting,
        6 + (k > 1)::int + (d > 0)::int as o, k + 4 + 2 * nested as a, 5 * (1 + nested) + 2 * d + k + s as all_o, 4 + k + 3 * nested + d + 2 * s as all_a, 1 as line_from, 4 + 2 * nested + d + s as line_to from {_MADE}
    union all select id, 'python', id || ':code:1', id || ':code:0', 1, 'f' || id || '.g', 2, 2, 1, 1, 0, 5, 2, 5, 3, 3, 4 from {_MADE} where nested = 1
    union all select id, 'c', id || ':code:0', null, 0, 'f' || id, 1, 4 + 2 * d + s, 1 + d, k, d, 8 + (k > 1)::int + (d > 0)::int, k + 4, 8 + 2 * k + 5 * d + 2 * s, 4 + k + d + 2 * s, 1, 5 + 2 * d + s from {_MADE})""")
def function_records(spark, sf):
    """The functions of each sample as rows."""
    got = scan.function_records(samples(spark, sf).select(F.col("id").cast("string").alias("row_id"), F.lit("code").alias("field"), "language", "code"))
    vocabulary = F.col("distinct_operators") + F.col("distinct_operands")
    return got.select(
        F.col("row_id").cast("int").alias("id"), "language", F.col("function_uid").alias("uid"), F.col("parent_uid").alias("parent"), F.col("source_order").alias("place"), "name", "detected", "nloc", "ccn", F.col("parameter_count").alias("parameters"),
        F.col("max_nesting_depth").alias("nesting"), vocabulary.alias("vocabulary"), F.round("halstead_volume", 6).alias("volume"), F.col("start").alias("line_from"), F.col("end").alias("line_to"),
    )


@query(f"select id, 1 + nested as detected, 1 + nested as computable, 0 as dropped, nested, 1 as outermost, case when nested = 1 then id || ':code:0 ' || id || ':code:1' else id || ':code:0' end as uids, case when nested = 1 then 'f' || id || ' f' || id || '.g' else 'f' || id end as names from {_MADE}")
def function_counts(spark, sf):
    """Counts, uids and names of each Python sample's functions."""
    x = made(spark, sf).select(F.col("id").cast("string").alias("row_id"), F.lit("code").alias("field"), F.lit("python").alias("language"), F.col("python").alias("code"))
    got = scan.sample_summary(scan.function_records(x), ["row_id"])
    short = {f"function_count_{c}": c for c in ("detected", "computable", "dropped", "nested", "outermost")}
    return got.select(F.col("row_id").cast("int").alias("id"), *[F.col(c).alias(n) for c, n in short.items()], F.array_join("function_uids", " ").alias("uids"), F.array_join("function_names", " ").alias("names"))


def _scanned(f):
    """A function of a text as a Column, Arrow-batched."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda c: None if c is None else f(c))

    return run


_PARAMETERS = "array_to_string(list_transform(range(0, k), lambda i: {}), ',')"
_REST = "case when nested = 1 then 'def{g}({q}):return{r}' else '' end || repeat('if{p}:', d) || repeat('{x}={n}', 1 + s) || 'return{n}'"


@query(f"""select id, 'def<FUNC>(' || {_PARAMETERS.format("'<PARAM>'")} || '):#note' || id || {_REST.format(g="<FUNC>", q="<PARAM>", r="<VAR>", p="<VAR>", x="<VAR>", n="<NUM>")} as structure,
    'defID(' || {_PARAMETERS.format("'ID'")} || '):#ID' || id || case when nested = 1 then 'defID(ID):returnID' else '' end || repeat('ifID:', d) || repeat('ID=1', 1 + s) || 'return' || (id + 1000) as placeholder,
    'def' || h('f' || id) || '(' || {_PARAMETERS.format("h('p' || i)")} || '):#' || h('note') || id || case when nested = 1 then 'def' || h('g') || '(' || h('q') || '):return' || h('q') else '' end || repeat('if' || h('p0') || ':', d) || repeat(h('x') || '=1', 1 + s) || 'return' || (id + 1000) as global_hash from {_MADE}""".replace("h('f' || id)", "'ID_' || left(sha1('f' || id), 8)").replace("h('p' || i)", "'ID_' || left(sha1('p' || i), 8)").replace("h('note')", "'ID_' || left(sha1('note'), 8)").replace("h('g')", "'ID_' || left(sha1('g'), 8)").replace("h('q')", "'ID_' || left(sha1('q'), 8)").replace("h('p0')", "'ID_' || left(sha1('p0'), 8)").replace("h('x')", "'ID_' || left(sha1('x'), 8)"))
def masked_python(spark, sf):
    """identifiers of each sample masked; white space, which masks may move, left out."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    modes = {m.replace("-", "_"): _scanned(lambda c, m=m: masking.masked(c, "python", m))("python") for m in ("structure", "placeholder", "global-hash")}
    return made(spark, sf).select("id", *[bare(c).alias(n) for n, c in modes.items()])


@query(f"""select id, 'deff' || id || '(' || {_PARAMETERS.format("'p' || i")} || '):' || {_REST.format(g="g", q="q", r="q", p="p0", x="x", n="1").replace("'return1'", "'return' || (id + 1000)")} as python,
    'intf' || id || '(' || {_PARAMETERS.format("'intp' || i")} || ')' || chr(123) || repeat('if(p0)' || chr(123), d) || 'x=1;' || repeat(chr(125), d) || repeat('x=1;', s) || 'return' || (id + 1000) || ';' || chr(125) as c,
    3 + 2 * nested + d + s as python_lines, 4 + 2 * d + s as c_lines from {_MADE}""")
def without_comments(spark, sf):
    """comments removed, and physical lines."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    plain = {x: _scanned(lambda c, x=x: masking.without_trivia(c, x))(x) for x in _LINES}
    return made(spark, sf).select("id", *[bare(c).alias(n) for n, c in plain.items()], *[scan.nloc(F.col(x), x).alias(f"{x}_lines") for x in _LINES])


@query(f"""select id, 'int<FUNC>(' || {_PARAMETERS.format("'int<PARAM>'")} || ')' || chr(123) || repeat('if(<VAR>)' || chr(123), d) || '<VAR>=<NUM>;' || repeat(chr(125), d) || repeat('<VAR>=<NUM>;', s) || 'return<NUM>;' || chr(125) as structure,
    'int<ID>(' || {_PARAMETERS.format("'int<ID>'")} || ')' || chr(123) || repeat('if(<ID>)' || chr(123), d) || '<ID>=1;' || repeat(chr(125), d) || repeat('<ID>=1;', s) || 'return' || (id + 1000) || ';' || chr(125) as placeholder,
    'intID_' || left(sha1('f' || id), 6) || '(' || {_PARAMETERS.format("'intID_' || left(sha1('p' || i), 6)")} || ')' || chr(123) || repeat('if(ID_' || left(sha1('p0'), 6) || ')' || chr(123), d) || 'ID_' || left(sha1('x'), 6) || '=1;' || repeat(chr(125), d) || repeat('ID_' || left(sha1('x'), 6) || '=1;', s) || 'return' || (id + 1000) || ';' || chr(125) as global_hash from {_MADE}""")
def masked_c(spark, sf):
    """the same of the C samples, without their comments."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    modes = {m.replace("-", "_"): _scanned(lambda c, m=m: masking.masked(masking.without_trivia(c, "c"), "c", m))("c") for m in ("structure", "placeholder", "global-hash")}
    return made(spark, sf).select("id", *[bare(c).alias(n) for n, c in modes.items()])


# Submissions of each kind, by customer: what becomes of them is known.
_KINDS = ("unsubmitted", "empty", "unreadable", "other name", "other arity", "stub", "constant", "small", "whole")
_STATUS = "case kind when 0 then 'empty' when 1 then 'empty' when 2 then 'parse_error' when 3 then 'target_missing' when 4 then 'arity_mismatch' when 5 then 'explicit_stub' when 6 then 'constant_noop' when 7 then 'undersized' else case when d + s + nested > 0 then 'nontrivial' else 'undersized' end end"  # two statements are few


def evaluated(spark, sf: str) -> DataFrame:
    """The result of one submission a customer."""
    x = made(spark, sf).withColumn("task_id", F.concat(F.lit("python:"), F.lpad(F.col("id").cast("string"), 9, "0"))).withColumn("kind", F.col("id") % len(_KINDS))
    head = F.concat(F.lit("def "), "name", F.lit("("), "parameters", F.lit("):\n"))
    code = F.when(F.col("kind") == 1, " ").when(F.col("kind") == 2, "def f(:").when(F.col("kind") == 3, F.replace("python", F.concat(F.lit("def "), "name"), F.lit("def other"))).when(F.col("kind") == 4, F.replace("python", F.lit("(p0"), F.lit("(more, p0")))
    code = code.when(F.col("kind") == 5, F.concat(head, F.lit("    pass\n"))).when(F.col("kind") == 6, F.concat(head, F.lit("    return 0\n"))).when(F.col("kind") == 7, F.concat(head, F.lit("    return p0\n"))).otherwise(F.col("python"))
    signature = F.struct(F.concat(F.lit("def "), "name", F.lit("("), "parameters", F.lit(")")).alias("text"), F.col("name").alias("name"), F.col("k").alias("arity")).cast(schemas.SIGNATURE)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schemas.TASK.fields} | {"benchmark_version": F.lit(schemas.BENCHMARK_VERSION), "language": F.lit("python"), "source_id": F.col("id").cast("string"), "stratum": F.lit("clean_control"), "signature": signature}
    tasks = x.select(*[blank.get(f.name, F.col(f.name)).alias(f.name) if f.name != "task_id" else "task_id" for f in schemas.TASK.fields])
    human = {f.name: F.lit(None).cast(f.dataType) for f in schemas.STRUCTURE.fields} | {"token_count": F.lit(1000), "ast_node_count": F.lit(1000)}
    human = F.struct(*[c.cast(schemas.STRUCTURE[n].dataType).alias(n) for n, c in human.items()])
    given = {"human_metrics": human, "human_complexity": F.struct(F.lit(1.0).alias("nloc"), F.lit(1.0).alias("halstead_v")).cast(schemas.REFERENCE["human_complexity"].dataType), "content_sha256": F.lit("-")}
    references = x.select("task_id", *[given[f.name].alias(f.name) for f in schemas.REFERENCE.fields if f.name != "task_id"])
    return evaluate.evaluate(tasks, references, x.where("kind <> 0").select("task_id", code.alias("code")))


@query(f"select 'python:' || lpad(id::varchar, 9, '0') as task_id, kind <> 0 as submitted, {_STATUS} as status, kind not in (0, 1, 2) as parseable, kind > 3 as target_present, kind > 4 as target_matches_arity, kind in (0, 1, 5) as explicit_stub, kind = 8 and d + s + nested > 0 as strict_nontrivial from (select *, id % 9 as kind from {_MADE})")
def evaluated_tasks(spark, sf):
    """The status of each submission."""
    return evaluated(spark, sf).select("task_id", "submitted", "status", "parseable", "target_present", "target_matches_arity", "explicit_stub", "strict_nontrivial")


@query("select count(*) as tasks, round(avg((id % 9 <> 0)::int), 9) as submitted, round(avg((id % 9 > 2)::int), 9) as parseable, round(avg((id % 9 > 3)::int), 9) as target_present, round(avg((id % 9 > 5)::int), 9) as nonstub, round(avg((id % 9 = 8 and d + s + nested > 0)::int), 9) as strict_nontrivial, "
       f"round(avg(case when id % 9 = 8 and d + s + nested > 0 then nloc end), 9) as nloc_mean from (select *, case when nested = 1 then (3 + 2 + d + s + 2) / 2.0 else 3 + d + s end as nloc from {_MADE})")  # fmt: skip
def evaluated_summary(spark, sf):
    """A1, A4: rates and means over the submissions' results."""
    got = evaluate.summarize(evaluated(spark, sf))
    return got.select("tasks", *[F.round(c, 9).alias(c) for c in ("submitted", "parseable", "target_present", "nonstub", "strict_nontrivial", "nloc_mean")])


@query(f"select id as hm_index, author, case author when 'human' then 3 + 2 * nested + d + s else 3 + 2 * nested + d + s + 1 end as sample_nloc from {_MADE}, (values ('human'), ('model')) as a(author)")
def attached_nloc(spark, sf):
    """Each author's lines of code, from the dataset's row of the key."""
    dataset = made(spark, sf).select(F.col("id").alias("hm_index"), F.col("python").alias("human_code"), F.concat("python", F.lit("\n# end\nlast = 1\n")).alias("model_code"))
    authors = {"human": "human_code", "model": "model_code"}
    selected = dataset.select("hm_index", F.explode(F.array(*map(F.lit, authors))).alias("author"))
    return scan.sample_nloc(joins.attach_code(selected, dataset, authors), "python").select("hm_index", "author", "sample_nloc")
