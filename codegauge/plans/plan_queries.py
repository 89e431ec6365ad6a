"""Queries of the benchmark's own plans and text functions, over rows that Spark makes from the customers and lines of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import masking, text
from ..sources.store import spread
from . import build, report
from .registry import query, t

# Texts


def _java_samples(spark, sf) -> DataFrame:
    """(id, code): a class, a method or a statement for each customer."""
    customers = t(spark, sf, "customer")
    rows = spread(customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n")), customers.count(), "id")
    kind = F.col("id") % 3
    whole = F.format_string("package p%d;\nimport a.B%d;\n\npublic class C%d {\n    int x;\n}", "n", "id", "id")
    method = F.format_string("import a.B%d;\npublic int m%d(int a) {\n    return a;\n}\n", "id", "id")
    code = F.when(kind == 0, whole).when(kind == 1, method).otherwise(F.format_string("int x = %d;", "id"))
    return rows.select("id", code.alias("code"))


@query("""select c_custkey as id, case c_custkey % 3 when 0 then 'package<PKG>;import<PKG>.<SYM>;publicclass<CLASS>{int<VAR>;}' when 1 then 'import<PKG>.<SYM>;publicint<METHOD>(int<PARAM>){return<VAR>;}' else 'int<VAR>=<NUM>;' end as structure,
    case c_custkey % 3 when 0 then 'package<ID>;import<ID>.<ID>;publicclass<ID>{int<ID>;}' when 1 then 'import<ID>.<ID>;publicint<ID>(int<ID>){return<ID>;}' else 'int<ID>=' || c_custkey || ';' end as placeholder from customer""")
def masked_java(spark, sf):
    """identifiers of the Java samples masked; white space left out."""

    def masks(mode: str):
        return F.pandas_udf(lambda batch: batch.map(lambda c: masking.masked(c, "java", mode)), "string")("code")

    rows = _java_samples(spark, sf)
    return rows.select("id", *[F.regexp_replace(masks(m), r"\s+", "").alias(m) for m in ("structure", "placeholder")])

_JAVA = "(select c_custkey as id, c_nationkey as n, c_custkey % 3 as kind from customer)"


@query(f"""select id, case kind when 0 then 'public class C' || id || ' {{' || chr(10) || repeat(' ', 4) || 'int x;' || chr(10) || '}}' when 1 then 'public int m' || id || '(int a) {{' || chr(10) || repeat(' ', 4) || 'return a;' || chr(10) || '}}' else 'int x = ' || id || ';' end as body,
    case when kind = 0 then 'C' || id end as type_name, kind = 1 as orphan, case kind when 0 then 'package p' || n || ';' || chr(10) || chr(10) || 'import a.B' || id || ';' || chr(10) || chr(10) || 'public class C' || id || ' {{' || chr(10) || repeat(' ', 4) || 'int x;' || chr(10) || '}}' || chr(10)
    when 1 then 'import a.B' || id || ';' || chr(10) || chr(10) || 'public class Submission {{' || chr(10) || repeat(' ', 4) || 'public int m' || id || '(int a) {{' || chr(10) || repeat(' ', 8) || 'return a;' || chr(10) || repeat(' ', 4) || '}}' || chr(10) || '}}' || chr(10)
    else 'public class Submission {{' || chr(10) || repeat(' ', 4) || 'int x = ' || id || ';' || chr(10) || '}}' || chr(10) end as wrapped from {_JAVA}""")
def java_texts(spark, sf):
    """Java samples of three kinds without their imports, and put into a class."""
    rows = _java_samples(spark, sf).withColumn("body", text.java_body(F.col("code")))
    return rows.select("id", "body", text.java_type_name(F.col("code")).alias("type_name"), text.has_orphan_methods(F.col("body")).alias("orphan"), text.wrap_java(F.col("code")).alias("wrapped"))


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_linenumber <> 3 then 'src/f' || l_orderkey || '.c' end as path, case when l_linenumber <> 3 then l_linenumber end as line, case when l_linenumber <> 3 then l_suppkey end as at, case when l_linenumber <> 3 then 'warning' end as severity,
    case when l_linenumber <> 3 then 'part ' || l_partkey || ' [unused]' end as message, case when l_linenumber <> 3 then 'bugprone-' || lower(l_returnflag) || ',misc' end as rules from lineitem""")
def compiler_lines(spark, sf):
    """diagnostics of a compiler; lines of another form are none."""
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat(F.lit("src/f"), "l_orderkey", F.lit(".c:"), "l_linenumber", F.lit(":"), "l_suppkey", F.when(F.col("l_linenumber") == 3, " note").otherwise(":"), F.lit(" warning: part "), "l_partkey", F.lit(" [unused] [bugprone-"), F.lower("l_returnflag"), F.lit(",misc]")).alias("value"))
    got = lines.withColumn("d", text.compiler_line(F.col("value")))
    return got.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "d.path", F.col("d.line").alias("line"), F.col("d.column").alias("at"), "d.severity", "d.message", F.col("d.check").alias("rules"))


@query("""select c_custkey as id, 'Implement the following C function. Return code only. Preserve the required function name and parameters.' || chr(10) || chr(10) || 'Signature:' || chr(10) || 'int ' || c_name || '(int a, int b)' || chr(10) || chr(10) || 'Specification:' || chr(10) || c_mktsegment as prompt,
    case when c_nationkey % 3 = 0 then 0 else c_nationkey % 3 end as arity, case when c_acctbal > 0 then printf('%.1f%%', 100 * round(c_nationkey / 8.0, 3)) else '—' end as share from customer""")
def prompts(spark, sf):
    """What is asked, parameters counted, and shares as the report shows them."""
    c = F.col
    parameters = F.when(c("c_nationkey") % 3 == 0, F.when(c("c_nationkey") % 2 == 0, "void").otherwise(" ")).when(c("c_nationkey") % 3 == 1, "int a").otherwise("int a, int b")
    signature = F.concat(F.lit("int "), "c_name", F.lit("(int a, int b)"))
    share = F.when(c("c_acctbal") > 0, F.round(c("c_nationkey") / 8.0, 3))
    return t(spark, sf, "customer").select(c("c_custkey").alias("id"), text.prompt(F.lit("C"), F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")), signature).alias("prompt"), text.arity(parameters).alias("arity"), text.percent(share).alias("share"))


# Metrics and hard tasks

_AUTHORS = schemas.AUTHORS["c"]


def _author_rows(spark, sf) -> DataFrame:
    """(id, j, author): each customer with the authors, numbered from 0 for the human."""
    authors = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(a).alias("author")) for j, a in enumerate(_AUTHORS)])).alias("x")
    return t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), authors).select("id", "x.*")


_ROWS = "(select c_custkey as id, j, author from customer, (values (0, 'human'), (1, 'gptoss'), (2, 'dsc'), (3, 'qwen')) as a(j, author))"
_NUMBERS = {"nloc": "case when j > 0 and (id * j) % 7 = 0 then 0.5 else 10.0 end", "checking": "(id * j) % 5", "assignment": "(id + j) % 3 * (j > 0)::int", "vulns": "id // greatest(j, 1) % 3 * (j > 0)::int"}


def _numbers(spark, sf, *keys: str) -> DataFrame:
    """Figures of each customer and author, dealt by keys to tasks that do not grow with the input."""
    i, j = F.col("id"), F.col("j")
    model = (j > 0).cast("long")
    rows = _author_rows(spark, sf).withColumn("hm_index", F.col("id").cast("string"))
    return spread(rows, len(_AUTHORS) * t(spark, sf, "customer").count(), *keys, share=50_000).withColumns({"nloc": F.when((j > 0) & (i * j % 7 == 0), 0.5).otherwise(10.0), "checking": i * j % 5, "assignment": (i + j) % 3 * model, "vulns": F.expr("id div greatest(j, 1) % 3") * model})


@query(f"""select id::varchar as hm_index, author, 5 + id % 4 as sample_nloc, {_NUMBERS["nloc"]} as nloc, 1.5 as mi, round((1 + id % 5) * log2(10), 9) as naturalness, {_NUMBERS["checking"]} + {_NUMBERS["assignment"]} as defects_total, {_NUMBERS["checking"]} as def_checking, {_NUMBERS["vulns"]} as vulns_total from {_ROWS} where id % 6 <> 5""")
def metrics_table(spark, sf):
    """Means, findings and entropies to one long table; rows without finite entropy go."""
    rows = _numbers(spark, sf, "hm_index", "author")
    stored = {k: F.lit(1.5) for k in schemas.TABLE_NAME_OF} | {"nloc_mean": F.col("nloc")}
    complexity = rows.select("hm_index", "author", (5 + F.col("id") % 4).alias("sample_nloc"), F.lit(1).cast("long").alias("function_count_computable"), *[c.alias(k) for k, c in stored.items()])
    parts = {c: F.lit(0).cast("long") for c in schemas.ODC_COLUMNS} | {"def_checking": F.col("checking"), "def_assignment": F.col("assignment")}
    defects = rows.select("hm_index", "author", (F.col("checking") + F.col("assignment")).alias("defects_total"), *[c.alias(n) for n, c in parts.items()])
    entropy = rows.select("hm_index", "author", F.when(F.col("id") % 6 == 5, F.lit(float("nan"))).otherwise(1.0 + F.col("id") % 5).alias("legacy"))
    got = build.metrics_table(complexity, defects, rows.select("hm_index", "author", F.col("vulns").alias("vulns_total"), F.col("vulns").alias("vulns_high_sev")), entropy)
    return got.select("hm_index", "author", "sample_nloc", "nloc", "mi", F.round("naturalness", 9).alias("naturalness"), "defects_total", "def_checking", "vulns_total")


def _long(spark, sf) -> DataFrame:
    """The metrics table with what the hard tasks are chosen by."""
    named = {c: F.lit(0) for c in schemas.ODC_COLUMNS} | {"hm_index": F.col("hm_index"), "author": F.col("author"), "nloc": F.col("nloc"), "halstead_v": F.col("nloc") * 3, "def_checking": F.col("checking"), "def_assignment": F.col("assignment"), "defects_total": F.col("checking") + F.col("assignment"), "vulns_total": F.col("vulns"), "vulns_high_sev": F.col("vulns")}
    return _numbers(spark, sf, "hm_index").select(*[named.get(f.name, F.lit(1)).cast(f.dataType).alias(f.name) for f in schemas.METRICS_LONG.fields])



@query(f"""with r as (select id, j, {_NUMBERS["nloc"]} >= 1 as ok, {_NUMBERS["checking"]} as c, {_NUMBERS["assignment"]} as a, {_NUMBERS["vulns"]} as v from {_ROWS} where j > 0), b as (select *, c + a + v as burden, ok and c + a + v >= 4 as hard from r),
    g as (select id, list_sort(list(case when ok then burden else -1 end), 'DESC')[2] as score, count(*) filter (hard and a > 0) >= 2 as on_a, count(*) filter (hard and c > 0) >= 2 as on_c, count(*) filter (hard and v > 0) >= 2 as potential,
        count(*) filter (ok and burden > 0) as affected, count(*) filter (ok and v > 0) as vulnerable from b group by id)
    select id::varchar as hm_index, score::int as score, array_to_string(list_filter([case when on_a then 'def_assignment' end, case when on_c then 'def_checking' end], lambda x: x is not null), ',') as consensus, potential, affected::int as affected, vulnerable::int as vulnerable
    from g where score >= 4 and (on_a or on_c or potential)""")
def hard_tasks(spark, sf):
    """Keys that may be hard enough, with who found what."""
    d = build.evidence(_long(spark, sf), "c", 4).select("hm_index", "difficulty.*")
    return d.select("hm_index", "score", F.array_join("consensus_odc", ",").alias("consensus"), F.col("potential_cwe_consensus").alias("potential"), F.col("affected_models").alias("affected"), F.col("vulnerable_models").alias("vulnerable"))


# Reports over results

_RESULT = "(select c_custkey as id, case c_custkey % 3 when 0 then 'python' when 1 then 'java' else 'c' end as language, c_custkey % 10 <> 0 as submitted, c_custkey % 10 > 1 as parseable, c_custkey % 10 > 2 as target_present, c_custkey % 10 > 3 as nonstub, c_custkey % 10 > 4 as strict, c_custkey % 4 as d, c_custkey % 7 // 4 as v from customer)"


def _results(spark, sf, shift: int = 0) -> DataFrame:
    """A result a customer; shift moves who fails."""
    i = F.col("c_custkey").cast("long")
    k = (i + shift) % 10
    language = F.when(i % 3 == 0, "python").when(i % 3 == 1, "java").otherwise("c")
    flags = {"submitted": k != 0, "parseable": k > 1, "target_present": k > 2, "nonstub": k > 3, "strict_nontrivial": k > 4}
    zero = F.lit(0).cast("long")
    outcomes = {c: zero for c in schemas.OUTCOMES} | {"defects_total": i % 4, "def_checking": i % 4, "vulns_total": F.expr("c_custkey % 7 div 4").cast("long"), "vulns_high_sev": zero}
    cwes = F.when(i % 7 > 3, F.array(F.concat(F.lit("CWE-"), (i % 5).cast("string")), F.lit("CWE-9"))).otherwise(F.array().cast("array<string>"))
    return t(spark, sf, "customer").select(i.cast("string").alias("task_id"), language.alias("language"), *[c.alias(n) for n, c in {**flags, **outcomes}.items()], cwes.alias("cwes"))


_RATES = """case metric when 'submitted_rate' then k <> 0 when 'parseable_rate' then k > 1 when 'target_present_rate' then k > 2 when 'nonstub_rate' then k > 3 when 'strict_nontrivial_rate' then k > 4 when 'defect_free_rate' then d = 0 when 'vulnerability_free_rate' then v = 0
    when 'high_severity_free_rate' then true when 'clean_nonstub_at_1' then k > 3 and d = 0 and v = 0 else k > 4 and d = 0 and v = 0 end"""


@query(f"""with m as (select unnest(['submitted_rate', 'parseable_rate', 'target_present_rate', 'nonstub_rate', 'strict_nontrivial_rate', 'defect_free_rate', 'vulnerability_free_rate', 'high_severity_free_rate', 'clean_nonstub_at_1', 'clean_strict_at_1']) as metric),
    x as (select id, language, metric, ({_RATES.replace("k ", "(id % 10) ")})::int as a, ({_RATES.replace("k ", "((id + 3) % 10) ")})::int as b from {_RESULT}, m)
    select 'other' as baseline, language, metric, round(avg(a), 9) as submission, round(avg(b), 9) as baseline_value, round(avg(a - b), 9) as delta, count(*) as n from x group by language, metric""")
def compared_rates(spark, sf):
    """The ten rates of two result sets, paired by task."""
    got = report.compare(_results(spark, sf), {"other": _results(spark, sf, 3)}, resamples=20)
    return got.select("baseline", "language", "metric", *[F.round(c, 9).alias(c) for c in ("submission", "baseline_value", "delta")], "n")


@query(f"""select case when grouping(language) = 1 then 'ALL' else language end as scope, 'm' as author, metric, round(avg((x > 0)::int), 9) as incidence from (select language, unnest(['defects_total', 'vulns_total', 'def_timing']) as metric, unnest([d, v, 0]) as x from {_RESULT})
    group by grouping sets ((metric), (language, metric))""")
def incidence_scopes(spark, sf):
    """Incidence over all results and by language, from one pass."""
    got = report.distributions(_results(spark, sf).withColumn("author", F.lit("m")), ("defects_total", "vulns_total", "def_timing"))
    return got.select("scope", "author", "metric", F.round("incidence", 9).alias("incidence"))


@query(f"""select case when grouping(language) = 1 then 'ALL' else language end as scope, 'm' as author, cwe, count(*) as count from (select language, unnest(['CWE-' || id % 5, 'CWE-9']) as cwe from {_RESULT} where id % 7 > 3) group by grouping sets ((cwe), (language, cwe))""")
def cwe_scopes(spark, sf):
    """How many results name each CWE."""
    return report.cwe_distribution(_results(spark, sf).withColumn("author", F.lit("m")))


@query(f"select odc, round(avg(x) filter (language = 'python'), 9) as python, round(avg(x) filter (language = 'java'), 9) as java, round(avg(x) filter (language = 'c'), 9) as c from (select language, unnest(['def_assignment', 'def_algorithm', 'def_interface', 'def_checking', 'def_timing', 'def_function_class_object']) as odc, unnest([0, 0, 0, (d > 0)::int, 0, 0]) as x from {_RESULT}) group by odc")
def odc_by_language(spark, sf):
    """A16."""
    got = report.odc_table(_results(spark, sf))
    return got.select("odc", *[F.round(g, 9).alias(g) for g in schemas.LANGUAGES])
