"""Operators applied to the driver's tables, each with the same result as DuckDB SQL where SQL has it.

The tables hold no source code, so columns stand in: event types for authors, users for keys, regions for categories.
Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import contracts, findings, gates, joins, ngram, sets, stats, windows
from ..sources.store import spread
from . import report
from .registry import ORACLE, QUERIES, query, t  # noqa: F401

TYPES = ("click", "error", "purchase", "signup", "view")


def labelled(spark: SparkSession, sf: str, how: str = "inner") -> DataFrame:
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", how)


# Rates, incidences and conditional means


@query("select lang, count(*) as tasks, round(avg(case when l.doc_id is not null then 1.0 else 0.0 end), 6) as submitted_rate, round(avg(case when coalesce(quality, 0) = 1 then 1.0 else 0.0 end), 6) as quality_rate from documents d left join labels l using (doc_id) group by lang")
def rate_by_language(spark, sf):
    docs = labelled(spark, sf, "left")
    return docs.groupBy("lang").agg(F.count("*").alias("tasks"), F.round(gates.rate(F.col("quality").isNotNull()), 6).alias("submitted_rate"), F.round(gates.rate(F.coalesce(F.col("quality"), F.lit(0)) == 1), 6).alias("quality_rate"))


@query("""select source, case when count(toxic) = count(*) then round(avg(case when toxic > 0 then 1.0 else 0.0 end), 6) end as all_scanned,
    round(avg(case when toxic is null then null when toxic > 0 then 1.0 else 0.0 end), 6) as over_scanned from documents left join labels using (doc_id) group by source""")
def incidence_guarded(spark, sf):
    docs = labelled(spark, sf, "left")
    return docs.groupBy("source").agg(F.round(gates.incidence(F.col("toxic"), F.col("toxic")), 6).alias("all_scanned"), F.round(gates.rate(F.col("toxic") > 0), 6).alias("over_scanned"))


@query("select lang, round(avg(case when n_chars > 500 and coalesce(toxic = 0, false) and coalesce(quality = 1, false) then 1.0 else 0.0 end), 6) as clean_strict from documents left join labels using (doc_id) group by lang")
def clean_strict(spark, sf):
    zero = F.coalesce(F.col("toxic") == 0, F.lit(False)) & F.coalesce(F.col("quality") == 1, F.lit(False))
    return labelled(spark, sf, "left").groupBy("lang").agg(F.round(gates.rate((F.col("n_chars") > 500) & zero), 6).alias("clean_strict"))


@query("select lang, round(avg(case when quality = 1 then n_chars end), 6) as strict_chars, round(avg(case when quality = 0 then n_chars end), 6) as other_chars from documents left join labels using (doc_id) group by lang")
def conditional_means(spark, sf):
    return labelled(spark, sf, "left").groupBy("lang").agg(*[F.round(gates.mean_if(F.col("n_chars"), F.col("quality") == q), 6).alias(n) for q, n in ((1, "strict_chars"), (0, "other_chars"))])


@query("select label, round(sum(floor(x * 1000)) / count(*), 6) as mean_component, count(*) as components from (select label, unnest(embedding)::double as x from embeddings) group by label")
def explode_mean(spark, sf):
    mean, count = gates.members(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)))
    return t(spark, sf, "embeddings").groupBy("label").agg(F.round(mean, 6).alias("mean_component"), count.alias("components"))


_SQL_TOKEN = r"'[A-Za-z_]\w*|\d+(?:\.\d+)?|==|!=|<=|>=|&&|\|\||->|[^\s]'"


@query(f"select lang, count(distinct tok) as distinct_tokens from (select lang, unnest(regexp_extract_all(text, {_SQL_TOKEN})) as tok from documents) group by lang")
def corpus_distinct_tokens(spark, sf):
    each = t(spark, sf, "documents").select("lang", F.explode(text.lexical_set(F.col("text"), unicode=False)).alias("tok")).distinct()
    return each.groupBy("lang").agg(F.count("*").alias("distinct_tokens"))


@query(f"select doc_id, len(regexp_extract_all(text, {_SQL_TOKEN}))::int as tokens from documents")
def token_counts(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(text.tokens(F.col("text"), unicode=False)).alias("tokens"))


@query("select doc_id, sha256(text) as sha from (select *, row_number() over (partition by sha256(text) order by doc_id) as n from documents) where n = 1")
def sha_dedup_first(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", text.sha256(F.col("text")).alias("sha"))
    return windows.keep_first(docs, ["sha"], ["doc_id"])


# Difficulty, gates and consensus over events: type for author, user for key


def _burdens(spark, sf) -> DataFrame:
    ev = t(spark, sf, "events").where(F.col("event_type").isin(*TYPES))
    return ev.groupBy("user_id", F.col("event_type").alias("author")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("v"))


_BURDEN_SQL = "select user_id, " + ", ".join(f"count(*) filter (event_type = '{a}') as n_{a}, (sum(floor(value)) filter (event_type = '{a}'))::bigint as v_{a}" for a in TYPES) + " from events group by user_id"


def _wide(spark, sf) -> DataFrame:
    w = gates.wide(_burdens(spark, sf), "user_id", TYPES, ("n", "v"))
    return w.select("user_id", *[F.coalesce(F.col(f"n__{a}"), F.lit(0)).alias(f"n_{a}") for a in TYPES], *[F.col(f"v__{a}").alias(f"v_{a}") for a in TYPES])


@query(f"select * from ({_BURDEN_SQL}) where {' and '.join(f'v_{a} is not null' for a in TYPES)}")
def pivot_complete_cases(spark, sf):
    return gates.complete(_wide(spark, sf), [f"v_{a}" for a in TYPES])


@query(f"select user_id, case when v_click > 0 and v_view > 0 then round(v_click::double / v_view, 6) end as ratio, coalesce(v_click > 0 and v_view > 0 and (v_click::double / v_view >= 1.0 or n_click::double / n_view >= 1.0), false) as passes from ({_BURDEN_SQL})")
def ratio_gate(spark, sf):
    c = F.col
    r1, _, ok = gates.complexity_gate(c("v_click").cast("double"), c("n_click").cast("double"), c("v_view").cast("double"), c("n_view").cast("double"), 1.0)
    return _wide(spark, sf).select("user_id", F.round(r1, 6).alias("ratio"), F.coalesce(ok, F.lit(False)).alias("passes"))


@query(f"select user_id, list_sort([{', '.join(f'n_{a}' for a in TYPES)}], 'desc')[2] as score from ({_BURDEN_SQL})")
def second_largest_burden(spark, sf):
    return _wide(spark, sf).select("user_id", windows.kth_largest([F.col(f"n_{a}") for a in TYPES], 2).alias("score"))


@query(f"select user_id, ({' + '.join(f'(n_{a} >= 15)::int' for a in TYPES)})::int as agreed from ({_BURDEN_SQL}) where ({' + '.join(f'(n_{a} >= 15)::int' for a in TYPES)}) >= 2")
def consensus_count(spark, sf):
    agreed = gates.count_true([F.col(f"n_{a}") >= 15 for a in TYPES])
    return _wide(spark, sf).select("user_id", agreed.alias("agreed")).where("agreed >= 2")


@query("""select o_custkey, string_agg(l_returnflag, ',' order by l_returnflag) as flags from (select o_custkey, l_returnflag from (select distinct o_custkey, o_orderpriority, l_returnflag
    from orders join lineitem on l_orderkey = o_orderkey) group by 1, 2 having count(*) >= 2) group by o_custkey""")
def category_consensus(spark, sf):
    rows = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    got = gates.consensus_values(rows, "o_custkey", "o_orderpriority", "l_returnflag")
    return got.select("o_custkey", F.array_join("values", ",").alias("flags"))


@query(f"select user_id, case when n_purchase >= 15 and n_click >= 15 then 'mixed_consensus' when n_purchase >= 15 then 'vulnerability_consensus' else 'defect_consensus' end as stratum from ({_BURDEN_SQL})")
def stratum_case(spark, sf):
    some = lambda c: F.when(F.col(c) >= 15, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return _wide(spark, sf).select("user_id", gates.stratum(some("n_purchase"), some("n_click")).alias("stratum"))


# Findings: line items for findings, regions for categories

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _findings(spark, sf) -> DataFrame:
    supplier = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    mapping = supplier.select(F.col("s_suppkey").alias("rule"), F.col("r_name").alias("odc"))
    found = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("rule"), F.col("l_linenumber").alias("line"))
    return joins.with_category(found, mapping)


_FINDINGS_SQL = "select l_orderkey as key, l_suppkey as rule, coalesce(r_name, '--') as odc, l_linenumber as line from lineitem left join (select s_suppkey, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) on s_suppkey = l_suppkey"


@query(f"select o_orderkey as key, count(rule) as defects_total, {', '.join(f'''count(*) filter (odc = '{r}') as c{i}''' for i, r in enumerate(REGIONS))} from orders left join (select distinct * from ({_FINDINGS_SQL}) where odc <> '--' and rule not in (1, 2, 3)) f on f.key = o_orderkey group by o_orderkey")
def finding_dedup_pivot(spark, sf):
    # Findings and keys by key in the same small parts: they are made distinct, counted and met there.
    rows = t(spark, sf, "lineitem").count()
    found = spread(_findings(spark, sf).where(~findings.excluded(F.col("rule").cast("string"), ("1", "2", "3"))), rows, "key", share=500_000)
    keys = spread(t(spark, sf, "orders").select(F.col("o_orderkey").alias("key")), rows, "key", share=500_000).hint("merge")
    return findings.defect_counts(keys, found, ["key"], {r: f"c{i}" for i, r in enumerate(REGIONS)}, tuple(f"c{i}" for i in range(len(REGIONS))))


@query("""select l_orderkey as key, count(*) as vulns_total, count(*) filter (severity = 'R') as vulns_high_sev, string_agg(distinct cwe, ',' order by cwe) as cwes from
    (select distinct l_orderkey, 'CWE-' || l_suppkey as cwe, l_returnflag as severity, l_linenumber as lines from lineitem where l_linestatus = 'O') group by 1""")
def severity_dedup(spark, sf):
    li = t(spark, sf, "lineitem").where("l_linestatus = 'O'")
    rows = li.select(F.col("l_orderkey").alias("key"), F.array(F.concat(F.lit(" cwe-"), F.col("l_suppkey").cast("string"), F.lit(": x"))).alias("cwes"), F.when(F.col("l_returnflag") == "R", "error").otherwise("info").alias("severity"), F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.col("l_returnflag")).alias("lines"))
    out = findings.vulnerability_counts(rows, rows, ["key"])
    return out.select("key", "vulns_total", "vulns_high_sev", F.array_join("cwes", ",").alias("cwes"))


@query("select l_orderkey, string_agg(distinct l_shipmode_like, ',' order by l_shipmode_like) as modes from (select l_orderkey, l_returnflag || l_linestatus as l_shipmode_like from lineitem) group by 1")
def sorted_distinct_set(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("m"))
    return li.groupBy("l_orderkey").agg(F.array_join(sets.distinct_sorted(F.col("m")), ",").alias("modes"))


_ALIASES = {"green": "Checking", "red": "Interface", "blue": "Timing", "small": "Algorithm", "Widget": "Assignment"}
_ALIAS_LIST = ", ".join(f"'{k}'" for k in _ALIASES)


@query(f"""select p_partkey, list_filter(string_split(p_name, ' '), lambda x: x in ({_ALIAS_LIST}))[1] as alias,
    case list_filter(string_split(p_name, ' '), lambda x: x in ({_ALIAS_LIST}))[1] {' '.join(f"when '{k}' then '{v}'" for k, v in _ALIASES.items())} end as odc from part""")
def first_match_alias(spark, sf):
    alias, odc = joins.first_alias(F.translate("p_name", " ", ","), _ALIASES)
    return t(spark, sf, "part").select("p_partkey", alias.alias("alias"), odc.alias("odc"))


@query("select p_partkey, p_brand from part where not (starts_with(p_brand, 'Brand#1') or p_brand in ('Brand#22', 'Brand#33'))")
def prefix_exclusion(spark, sf):
    return t(spark, sf, "part").where(~findings.excluded(F.col("p_brand"), ("Brand#22", "Brand#33"), ("Brand#1",))).select("p_partkey", "p_brand")


#: Chains of aliases, and the categories of rules, for the findings that parts stand for.
_CHAINS = ("missing-module-docstring", "unused-variable", "GodClass", "EmptyCatchBlock", "misc-include-cleaner", "cert-x, bugprone-y", "readability-z,bugprone-y", "no-category", "google-doc", "readability-z")
_CATEGORIES = {
    "missing-module-docstring": "Interface", "unused-variable": "Assignment", "GodClass": "Function/Class/Object", "EmptyCatchBlock": "Checking", "misc-include-cleaner": "Interface",
    "bugprone-y": "Algorithm", "cert-x": "--", "google-doc": "Documentation", "readability-z": "Checking",
}


@query(
    f"""with found as (select p_size as unit, ['python', 'java', 'c'][1 + p_size % 3] as language, [{", ".join(f"'{c}'" for c in _CHAINS)}][1 + p_partkey % 10] as chain, p_partkey % 7 as line from part),
    categories(alias, odc) as (values {", ".join(f"('{k}', '{v}')" for k, v in _CATEGORIES.items())}),
    chains as (select distinct chain from found),
    aliases as (select chain, unnest(range(len(string_split(chain, ',')))) as place, trim(unnest(string_split(chain, ','))) as alias from chains),
    firsts as (select chain, arg_min(alias, place) as rule, arg_min(odc, place) as odc from aliases join categories using (alias) where odc <> '--' group by chain),
    kept as (select distinct unit, rule, odc, line from found join firsts using (chain) where not (language = 'python' and rule = 'missing-module-docstring') and not (language = 'java' and rule = 'GodClass')
        and not (language = 'c' and (rule in ('misc-include-cleaner') or starts_with(rule, 'readability-') or odc in ('Documentation', 'Build/Package/Merg'))) and not (odc = 'Documentation'))
    select unit, count(rule) as defects_total, count(rule) filter (odc = 'Assignment') as def_assignment, count(rule) filter (odc = 'Algorithm') as def_algorithm, count(rule) filter (odc = 'Interface') as def_interface,
    count(rule) filter (odc = 'Checking') as def_checking, count(rule) filter (odc = 'Timing') as def_timing, count(rule) filter (odc = 'Function/Class/Object') as def_function_class_object
    from (select distinct unit from found) left join kept using (unit) group by unit"""
)
def excluded_findings(spark, sf):
    part = t(spark, sf, "part")
    language = F.element_at(F.array(*map(F.lit, ("python", "java", "c"))), (1 + F.col("p_size") % 3).cast("int")).alias("language")
    chain = F.element_at(F.array(*map(F.lit, _CHAINS)), (1 + F.col("p_partkey") % 10).cast("int")).alias("rule")
    found = part.select(F.col("p_size").alias("unit"), language, chain, (F.col("p_partkey") % 7).alias("line"))
    found = findings.resolved(found, spark.createDataFrame(list(_CATEGORIES.items()), "rule string, odc string"))
    # Documentation is left out in C by its list; other languages would raise at it, so their rows stay out here.
    kept = found.where(findings.countable(F.col("language"), F.col("rule"), F.col("odc"))).where((F.col("language") == "c") | (F.col("odc") != "Documentation"))
    return findings.defect_counts(part.select(F.col("p_size").alias("unit")), kept, ["unit"])


@query("select upper(case when p_type = '' then '' else p_type end) as label, count(*) as n from part group by 1")
def label_normalise(spark, sf):
    label = F.get(text.normalized_cwes(F.array(F.concat(F.lit(" "), F.col("p_type")))), F.lit(0))
    return t(spark, sf, "part").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(r"select p_partkey, case when regexp_matches(upper(p_brand), '^BRAND#\d+') then 'CWE-' || regexp_extract(upper(p_brand), '^BRAND#(\d+)', 1) else upper(p_brand) end as cwe from part")
def cwe_normalise(spark, sf):
    raw = F.regexp_replace("p_brand", "(?i)^brand#", " cwe-")
    return t(spark, sf, "part").select("p_partkey", F.get(text.normalized_cwes(F.array(F.concat(raw, F.lit(": text")))), F.lit(0)).alias("cwe"))


# Keys: sets, semi and anti joins, order


@query("select k, side as only_in from (select l_orderkey as k, 'left' as side from (select distinct l_orderkey from lineitem) where l_orderkey not in (select o_orderkey from orders) union all select o_orderkey, 'right' from orders where o_orderkey not in (select l_orderkey from lineitem))")
def key_equality(spark, sf):
    # Both sides by key in the same small parts: keys are made distinct and met there, however many there are.
    lines, orders = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    rows = lines.count()
    a, b = (spread(d.select(F.col(c).alias("k")), rows, "k", share=500_000).distinct().hint("merge") for d, c in ((lines, "l_orderkey"), (orders, "o_orderkey")))
    return contracts.unequal_keys(a, b, ["k"])


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_unknown(spark, sf):
    return contracts.missing(t(spark, sf, "documents"), t(spark, sf, "labels"), ["doc_id"])


@query("select o_orderkey, o_totalprice from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def semi_eligible(spark, sf):
    keys = t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.eligible(t(spark, sf, "orders"), keys, "o_orderkey")[0].select("o_orderkey", "o_totalprice")


@query("select doc_id, row_number() over (order by crc, doc_id) as place, n_chars from (select doc_id, quality * 1000 + toxic as crc from labels) join documents using (doc_id)")
def ordered_subset(spark, sf):
    wanted = t(spark, sf, "labels").select("doc_id", (F.col("quality") * 1000 + F.col("toxic")).alias("crc"))
    # Dense places without one task that sorts everything: counts of each class first, then a rank inside it by id ranges.
    classes = wanted.groupBy("crc").agg(F.count("*").alias("n"))
    before = classes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("crc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a few classes
    placed = wanted.join(F.broadcast(before), "crc").withColumn("ordinal", F.col("before") + F.row_number().over(Window.partitionBy("crc").orderBy("doc_id")))
    return joins.ordered_subset(t(spark, sf, "documents").select("doc_id", "n_chars"), placed, "doc_id").select("doc_id", F.col("ordinal").alias("place"), "n_chars")


@query("select lang, round(avg(quality), 6) as submission, round(avg(toxic), 6) as baseline_value, round(avg(quality - toxic), 6) as delta, count(*) as n from documents join labels using (doc_id) group by lang")
def paired_delta(spark, sf):
    rows = labelled(spark, sf)
    both = joins.paired(rows.select("doc_id", "lang", F.col("quality").alias("x")), rows.select("doc_id", "lang", F.col("toxic").alias("x")), ["doc_id", "lang"])
    got = stats.paired_deltas(both.select("lang", F.col("x_a").alias("a"), F.col("x_b").alias("b")), ["lang"], resamples=0)
    return got.select("lang", *[F.round(c, 6).alias(c) for c in ("submission", "baseline_value", "delta")], "n")


@query("select a, n from (select 'both' as a, count(*) as n from (select o_orderkey from orders intersect select l_orderkey from lineitem) union all select 'either', count(*) from (select o_orderkey from orders union select l_orderkey from lineitem) union all select 'orders_only', count(*) from (select o_orderkey from orders except select l_orderkey from lineitem))")
def split_sets(spark, sf):
    o, li = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return sets.sizes(o, li, ["k"], {"both": "both", "either": "either", "orders_only": "left"}).select(F.col("name").alias("a"), "n")


# Summaries


@query("select l_returnflag, round(sum(l_quantity), 2) as l_quantity_sum, round(avg(l_quantity), 6) as l_quantity_mean, median(l_quantity) as l_quantity_median, min(l_quantity) as l_quantity_min, max(l_quantity) as l_quantity_max from lineitem group by 1")
def five_way_summary(spark, sf):
    got = t(spark, sf, "lineitem").groupBy("l_returnflag").agg(*gates.five_way("l_quantity"))
    return got.withColumn("l_quantity_sum", F.round("l_quantity_sum", 2)).withColumn("l_quantity_mean", F.round("l_quantity_mean", 6))


@query("select o_orderpriority, count(*) as seen, count(*) filter (items is null) as empty, count(*) filter (items > 1) as multiple, count(*) filter (items = 1) as single, coalesce(sum(items), 0)::bigint as detected from orders left join (select l_orderkey, count(*) as items from lineitem group by 1) on l_orderkey = o_orderkey group by 1")
def count_accounting(spark, sf):
    items = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    return t(spark, sf, "orders").join(items, "o_orderkey", "left").groupBy("o_orderpriority").agg(*gates.accounting(F.col("items")))


@query("""select coalesce(event_type, 'ALL') as scope, count(value) as n, round(avg(value), 6) as mean, min(value) as least, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.9), 6) as p90,
    max(value) as greatest, round(stddev_samp(value), 6) as deviation from events group by grouping sets ((event_type), ())""")
def dist_summary_all(spark, sf):
    got = t(spark, sf, "events").groupingSets([[F.col("event_type")], []], F.col("event_type")).agg(*gates.distribution("value"))
    return got.select(F.coalesce("event_type", F.lit("ALL")).alias("scope"), "n", *[F.round(c, 6).alias(c) if c in ("mean", "median", "p90", "deviation") else c for c in ("mean", "least", "median", "p90", "greatest", "deviation")])


@query("select categories, count(*) as units from (select l_orderkey, count(distinct l_suppkey % 5) as categories from lineitem group by 1) group by 1")
def histogram_of_distinct(spark, sf):
    return findings.categories_per_unit(t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("c")), "l_orderkey", "c")


@query("select count(*) as defects, count(distinct l_orderkey) as defective, round(count(distinct l_orderkey)::double / (select count(*) from orders), 6) as share, round(count(*)::double / count(distinct l_orderkey), 6) as mean_per_defective from lineitem")
def study_totals(spark, sf):
    got = findings.study_report(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("u")), t(spark, sf, "orders").select(F.col("o_orderkey").alias("u")), "u")
    return got.select("defects", "defective", F.round("share", 6).alias("share"), F.round("mean_per_defective", 6).alias("mean_per_defective"))


@query("select l_suppkey, count(*) as n from lineitem group by 1 order by n desc, l_suppkey limit 10")
def topn_rules(spark, sf):
    return windows.top_n(t(spark, sf, "lineitem"), "l_suppkey", 10)


@query("select event_id, row_number() over (partition by user_id, event_type order by event_id) as occurrence from events")
def occurrence_number(spark, sf):
    return t(spark, sf, "events").select("event_id", windows.occurrence(["user_id", "event_type"], ["event_id"]).cast("long").alias("occurrence"))


@query("select l_orderkey, l_linenumber, l_suppkey, l_partkey, row_number() over (partition by l_orderkey order by l_quantity, l_extendedprice, l_linenumber, l_suppkey, l_partkey) - 1 as source_order from lineitem")
def source_order_rank(spark, sf):
    n = windows.occurrence(["l_orderkey"], ["l_quantity", "l_extendedprice", "l_linenumber", "l_suppkey", "l_partkey"])
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (n - 1).cast("long").alias("source_order"))


# Rank statistics


@query("select distinct l_returnflag, l_quantity, count(*) over (partition by l_returnflag, l_quantity) as n, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as rank from lineitem")
def avg_rank_ties(spark, sf):
    got = windows.average_ranks(t(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return got.select("l_returnflag", "l_quantity", "n", F.col("rank").cast("double").alias("rank"))


_SIDES = "select case when event_type = 'click' then 1 else 2 end as side, value from events where event_type in ('click', 'view')"


@query(f"""select n1, n2, round(r1 - n1 * (n1 + 1) / 2.0, 3) as u, round(2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 6) as delta from (select count(*) filter (side = 1) as n1, count(*) filter (side = 2) as n2,
    sum(case when side = 1 then r end) as r1 from (select side, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as r from ({_SIDES})))""")
def mwu_cliffs(spark, sf):
    ev = t(spark, sf, "events").where(F.col("event_type").isin("click", "view")).select(F.lit("value").alias("metric"), F.when(F.col("event_type") == "click", 1).otherwise(2).alias("side"), "value")
    return stats.rank_sums(ev, ["metric"], "side", "value").select("n1", "n2", F.round(F.col("u").cast("double"), 3).alias("u"), F.round("delta", 6).alias("delta"))


@query("select round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as t from (select avg(value) filter (event_type = 'click') as m1, avg(value) filter (event_type = 'view') as m2, var_samp(value) filter (event_type = 'click') as v1, var_samp(value) filter (event_type = 'view') as v2, count(*) filter (event_type = 'click') as n1, count(*) filter (event_type = 'view') as n2 from events)")
def welch_t(spark, sf):
    side = lambda a: F.when(F.col("event_type") == a, F.col("value"))
    one = t(spark, sf, "events").agg(*[f(side(a)).alias(f"{n}{i}") for i, a in ((1, "click"), (2, "view")) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    c = F.col
    return one.select(F.round(stats.welch_t(c("n1"), c("m1"), c("v1"), c("n2"), c("m2"), c("v2")), 6).alias("t"))


@query("""select p_brand, round(least(1.0, min(p * m / k) over (order by p, k rows between current row and unbounded following)), 9) as q from
    (select p_brand, p, row_number() over (order by p) as k, count(*) over () as m from (select p_brand, 1.0 / (1 + count(*) + p_brand_no::int) as p from (select p_brand, regexp_extract(p_brand, '(\\d+)', 1) as p_brand_no from part) group by p_brand, p_brand_no))""")
def bh_qvalues(spark, sf):
    tests = t(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", (1.0 / (1 + F.col("n") + F.regexp_extract("p_brand", r"(\d+)", 1).cast("int"))).alias("p"))
    return windows.benjamini_hochberg(tests).select("p_brand", F.round("q", 9).alias("q"))


@query("""select l_returnflag, count(*) as n, round(sum(case when d > 0 then r else 0 end), 3) as w_plus, round(sum(case when d < 0 then r else 0 end), 3) as w_minus, round(avg(case when d > 0 then 1.0 else 0.0 end), 6) as dominance from
    (select l_returnflag, d, rank() over (partition by l_returnflag order by abs(d)) + (count(*) over (partition by l_returnflag, abs(d)) - 1) / 2.0 as r from (select l_returnflag, l_quantity - 25 as d from lineitem where l_quantity <> 25)) group by 1""")
def wilcoxon_w(spark, sf):
    li = t(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.lit(25.0).alias("base"))
    got = stats.wilcoxon_sums(li, ["l_returnflag"], "l_quantity", "base")
    return got.select("l_returnflag", "n", F.round(F.col("w_plus").cast("double"), 3).alias("w_plus"), F.round(F.col("w_minus").cast("double"), 3).alias("w_minus"), F.round("dominance", 6).alias("dominance"))


_SPANS = "select l_orderkey as row_id, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) - 1 as idx, l_linenumber as s, l_linenumber + l_quantity::int as e from lineitem"


@query(f"""with spans as ({_SPANS}) select c.row_id, c.idx, coalesce((select p.idx from spans p where p.row_id = c.row_id and p.s <= c.s and p.e >= c.e and (p.s < c.s or p.e > c.e) order by p.e - p.s, p.idx limit 1), -1) as parent from spans c""")
def range_parent(spark, sf):
    li = t(spark, sf, "lineitem")
    idx = windows.occurrence(["l_orderkey"], ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]).cast("long") - 1
    spans = li.select(F.col("l_orderkey").alias("row_id"), idx.alias("idx"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end"))
    return joins.parents(spans).select("row_id", "idx", F.coalesce("parent", F.lit(-1)).alias("parent"))


# Scalar functions


@query(r"select page_id, (try_cast(nullif(regexp_extract(url, '/(\d+)(\?|#|$)', 1), '') as int) - 1)::varchar as idx from pages")
def url_ordinal_key(spark, sf):
    return t(spark, sf, "pages").select("page_id", joins.ordinal_of(F.col("url"), r"/(\d+)(\?|#|$)").cast("string").alias("idx"))


@query("select event_id, json_extract_string(props, '$.k') as k, coalesce(json_extract_string(props, '$.extra.metadata.cwe'), 'none') as cwe from events")
def json_path_default(spark, sf):
    return t(spark, sf, "events").select("event_id", text.json_path(F.col("props"), "$.k").alias("k"), text.json_path(F.col("props"), "$.extra.metadata.cwe", "none").alias("cwe"))


@query("""select l_orderkey, l_linenumber, l_suppkey, l_partkey, round(greatest(0.0, (171 - 5.2 * ln(greatest(v, 1.0)) - 0.23 * l_linenumber - 16.2 * ln(greatest(l_quantity, 1.0))) * 100 / 171), 6) as mi, round(v * (l_linenumber / 2.0 * (n2 / l_quantity)), 3) as effort from
    (select *, (n1 + n2) * log2(l_linenumber + l_quantity) as v from (select *, l_suppkey::double as n1, l_partkey::double as n2 from lineitem))""")
def mi_formula(spark, sf):
    d = lambda c: F.col(c).cast("double")
    v, _, effort = text.halstead(d("l_linenumber"), d("l_quantity"), d("l_suppkey"), d("l_partkey"))
    mi = text.maintainability(v, F.col("l_linenumber"), F.col("l_quantity"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(mi, 6).alias("mi"), F.round(effort, 3).alias("effort"))


@query("select event_id, event_type from events order by case when event_type = 'purchase' and value > 90 then 0 when event_type = 'purchase' then 1 else 2 end, event_id limit 1")
def priority_first(spark, sf):
    buy = F.col("event_type") == "purchase"
    return windows.first_by_priority(t(spark, sf, "events"), [buy & (F.col("value") > 90), buy, F.lit(True)], "event_id").select("event_id", "event_type")


@query("select doc_id, 'ID_' || substr(sha1(text), 1, 8) as short_id, sha256(lang || chr(10) || source || chr(10) || text) as content from documents")
def hash_ids(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.short_id(F.col("text")).alias("short_id"), text.content_hash(F.col("lang"), F.col("source"), F.col("text")).alias("content"))


@query("select c_custkey, 'c:' || c_name as task_id, case when strpos(c_name, '#') > 0 then split_part(c_name, '#', 2) end as number, printf('%d%%', floor(abs(c_acctbal))::bigint) as shown from customer")
def id_and_format(spark, sf):
    c = t(spark, sf, "customer")
    short = text.short_name(F.regexp_replace("c_name", "#", "::"))
    return c.select("c_custkey", text.task_id(F.lit("c"), F.col("c_name")).alias("task_id"), F.when(F.col("c_name").contains("#"), short).alias("number"), F.concat(F.format_string("%d", F.floor(F.abs("c_acctbal"))), F.lit("%")).alias("shown"))


@query("select event_type, count(*) filter (value is null) as nulls, count(*) filter (value = 0) as zeros, count(*) filter (isnan(value) or isinf(value)) as odd from events group by 1")
def finite_accounting(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(*[c.alias(n) for n, c in gates.value_counts(F.col("value")).items()])


@query("select n_name, count(*) as customers, case n_regionkey when 0 then 2 when 1 then 1 else 3 end as region_rank from customer join nation on c_nationkey = n_nationkey group by n_name, n_regionkey order by region_rank, n_name")
def ordered_domain(spark, sf):
    x = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "n_regionkey").agg(F.count("*").alias("customers"))
    rank = gates.cascade([(F.col("n_regionkey") == 0, 2), (F.col("n_regionkey") == 1, 1)], 3)
    return windows.in_order(x.select("n_name", "customers", rank.alias("region_rank")), "region_rank", (1, 2, 3), "n_name")


@query("select coalesce(mkt, 'ALL') as scope, flag, round(avg(case when q > 25 then 1.0 else 0.0 end), 6) as incidence from (select c_mktsegment as mkt, l_returnflag as flag, l_quantity as q from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey) group by grouping sets ((flag), (mkt, flag))")
def scope_distribution(spark, sf):
    x = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    x = x.select(F.col("c_mktsegment").alias("mkt"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"))
    return report.scopes(x, "mkt", ["flag"], {"incidence": F.round(gates.rate(F.col("q") > 25), 6)})


# Contracts as queries: the rows that violate them


@query("select l_orderkey || ':' || l_linenumber as k, count(*) as n from lineitem group by 1 having count(*) > 1")
def contract_keys(spark, sf):
    return contracts.bad_keys(t(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("k")), "k")


@query("""select c_custkey, col as "column", v as value from (select c_custkey, 'c_acctbal' as col, c_acctbal as v from customer where c_acctbal <= 0 or c_acctbal is null union all select c_custkey, 'c_nationkey', c_nationkey::double from customer where c_nationkey < 0)""")
def contract_domain(spark, sf):
    return contracts.outside(t(spark, sf, "customer"), "c_custkey", ("c_acctbal",), ("c_nationkey",))


@query("select o_custkey, p as author from (select distinct o_custkey from orders), (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) as p) where (o_custkey, p) not in (select o_custkey, o_orderpriority from orders)")
def contract_coverage(spark, sf):
    o = t(spark, sf, "orders")
    return contracts.uncovered(o.select("o_custkey", F.col("o_orderpriority").alias("author")), o.select("o_custkey").distinct(), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("select distinct p_brand as rule, p_type as odc, now from part join (select p_brand, min(p_type) as now from part group by 1) using (p_brand) where p_type <> now")
def contract_stale_map(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_brand").alias("rule"), F.col("p_type").alias("odc"))
    return contracts.stale_mapping(p, p.groupBy("rule").agg(F.min("odc").alias("odc")))


@query("select distinct event_type from events where event_type not in ('click', 'view')")
def contract_categories(spark, sf):
    return contracts.unknown_values(t(spark, sf, "events"), "event_type", ("click", "view"))


@query("select o_orderkey, o_totalprice from orders join (select l_orderkey, sum(floor(l_quantity)) as q, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey where q <> n * 25")
def contract_sums(spark, sf):
    li = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.floor("l_quantity")).alias("q"), (F.count("*") * 25).alias("n"))
    bad = contracts.broken_sums(li, "o_orderkey", "q", ("n",))
    return t(spark, sf, "orders").join(bad, "o_orderkey").select("o_orderkey", "o_totalprice")


# More joins and summaries


@query("select coalesce(why, 'kept') as why, count(*) as n from (select case when n_chars < 100 then 'short' when quality = 0 then 'not_strict' when row_number() over (partition by sha256(text) order by doc_id) > 1 then 'exact_duplicate' end as why from documents left join labels using (doc_id)) group by 1")
def drop_reasons(spark, sf):
    docs = labelled(spark, sf, "left").withColumn("sha", text.sha256(F.col("text")))
    x = docs.join(docs.groupBy("sha").agg(F.min("doc_id").alias("first")), "sha")
    why = gates.cascade([(F.col("n_chars") < 100, "short"), (F.col("quality") == 0, "not_strict"), (F.col("doc_id") > F.col("first"), "exact_duplicate")], "kept")
    return x.groupBy(why.alias("why")).agg(F.count("*").alias("n"))


@query("select p_type as cwe, p_brand as severity, count(*) as n from part group by 1, 2 order by n desc, cwe, severity limit 10")
def security_top(spark, sf):
    from . import report

    return report.security_report(t(spark, sf, "part").select(F.col("p_partkey").alias("u"), F.col("p_type").alias("cwe"), F.col("p_brand").alias("severity")), "u")[1]


@query("select a.event_type as f1, b.event_type as f2, count(*) as users, round(avg(a.v - b.v), 6) as delta from (select user_id, event_type, count(*) as v from events group by 1, 2) a join (select user_id, event_type, count(*) as v from events group by 1, 2) b on a.user_id = b.user_id and a.event_type < b.event_type group by 1, 2")
def author_pairs(spark, sf):
    per = t(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("author")).agg(F.count("*").alias("value"))
    return joins.author_pairs(per, ["user_id"]).groupBy("f1", "f2").agg(F.count("*").alias("users"), F.round(F.avg(F.col("v1") - F.col("v2")), 6).alias("delta"))


@query("select l_returnflag, round(avg(case when l_linestatus = 'O' then l_discount end), 6) as o, round(avg(case when l_linestatus = 'F' then l_discount end), 6) as f from lineitem group by 1")
def pivot_means(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.round(gates.mean_if(F.col("l_discount"), F.col("l_linestatus") == x), 6).alias(x.lower()) for x in "OF"])


@query("select event_type as author, event_id as idx, 'U' || user_id || case when n > 1 then '_' || n else '' end || '.java' as file from (select *, row_number() over (partition by event_type, user_id order by event_id) as n from events)")
def file_names(spark, sf):
    ev = t(spark, sf, "events").select(F.col("event_type").alias("author"), F.col("event_id").alias("idx"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("type_name"))
    return joins.java_files(ev)


@query("select l_orderkey, string_agg(s, ',' order by s) as merged from (select distinct l_orderkey, unnest([l_returnflag, l_linestatus]) as s from lineitem) group by 1")
def merged_sets(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(sets.merged(F.array("l_returnflag", "l_linestatus")), ",").alias("merged"))


_OVER = ", ".join(f"case when n_{a} > 12 then '{a}:' || n_{a} end" for a in TYPES)


@query(f"select user_id, array_to_string(list_filter([{_OVER}], lambda x: x is not null), ',') as counts from ({_BURDEN_SQL})")
def nonzero_map(spark, sf):
    over = [F.when(F.col(f"n_{a}") > 12, F.col(f"n_{a}")).otherwise(0) for a in TYPES]
    m = text.nonzero(F.array(*[F.lit(a) for a in TYPES]), F.array(*over))
    shown = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return _wide(spark, sf).select("user_id", shown.alias("counts"))


@query(r"select page_id, lower(regexp_extract(url, '^(\w+)://', 1)) as scheme, case when regexp_matches(url, '[?]') then split_part(url, '?', 2) end as query from pages")
def url_parts(spark, sf):
    u = F.col("url")
    return t(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract(u, r"^(\w+)://", 1)).alias("scheme"), F.when(u.contains("?"), F.get(F.split(u, r"\?"), F.lit(1))).alias("query"))


# No SQL: resampling, hashing into folds, language models


@query()
def bootstrap_ci(spark, sf):
    rows = labelled(spark, sf).select(F.lit("toxic").alias("baseline"), F.col("lang").alias("language"), F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"))
    return stats.paired_deltas(rows, ["baseline", "language", "metric"])


@query()
def pairwise_statistics(spark, sf):
    ev = t(spark, sf, "events").select(F.lit("value").alias("metric"), F.col("event_type").alias("author"), "value")
    return stats.pairwise(ev)


@query("""with e as (select event_type as a, value as v from events where value is not null and not isnan(value)), m as (select a, count(*) as n, avg(v) as m, var_samp(v) as s from e group by a),
    p as (select x.a as f1, y.a as f2, x.n as n1, y.n as n2, (x.m - y.m) / sqrt(x.s / x.n + y.s / y.n) as t from m x join m y on x.a < y.a),
    r as (select f1, f2, a, rank() over (partition by f1, f2 order by v) + (count(*) over (partition by f1, f2, v) - 1) / 2.0 as r from p join e on a in (f1, f2)),
    u as (select f1, f2, sum(r) filter (a = f1) as r1 from r group by f1, f2)
    select 'value' as metric, f1, f2, n1, n2, round(t, 6) as t, r1 - n1 * (n1 + 1) / 2.0 as u, round(2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 9) as delta from p join u using (f1, f2)""")
def pairwise_tests(spark, sf):
    ev = t(spark, sf, "events").select(F.lit("value").alias("metric"), F.col("event_type").alias("author"), "value")
    return stats.pairwise(ev, resamples=0).select("metric", "f1", "f2", "n1", "n2", F.round("t", 6).alias("t"), "u", F.round("delta", 9).alias("delta"))


@query()
def seeded_sample(spark, sf):
    return windows.seeded_sample(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 20, 7, ["lang"])


@query()
def fold_sizes(spark, sf):
    return t(spark, sf, "documents").groupBy(windows.fold(F.col("doc_id"), 10, 42).alias("fold")).agg(F.count("*").alias("n"))


_TURNS = 2_000


@query()
def naturalness(spark, sf):
    """Trigram cross-entropy of benchmark passages under a model of conversations."""
    words = lambda c: text.split_words(F.lower(c))
    turns = t(spark, sf, "conversations").select("text")
    tasks = max(spark.sparkContext.defaultParallelism, -(-(n := turns.count()) // _TURNS))
    # Turns are dealt to tasks of so many, and their grams to as many tasks: none has more the more there are.
    raw = ngram.counts_by_fold(spread(turns, n, share=_TURNS).select(F.lit(0).alias("fold"), words(F.col("text")).alias("tokens")), 3)
    return ngram.score(t(spark, sf, "benchmark").select(F.col("item_id").alias("sample_idx"), words(F.col("text")).alias("tokens")), ngram.train(raw, 3, tasks), tasks=tasks)


_FOLDS = 5


@query("""with d as (select source as author, doc_id % 5 as fold, list_concat(['<s>'], list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), ['</s>']) as t from documents where text is not null),
    g as (select author, fold, k, array_to_string(t[e - k + 1:e], ' ') as gram, array_to_string(t[e - k + 2:e], ' ') as suffix, t[e - k + 1] = '<s>' as starts, t[e - k + 2] = '<s>' as suffix_starts from d, unnest(range(1, len(t) + 1)) as a(e), unnest([1, 2, 3]) as b(k) where k <= e),
    c as (select author, k, gram, any_value(suffix) as suffix, any_value(starts) as starts, any_value(suffix_starts) as suffix_starts, [count(*) filter (fold <> 0), count(*) filter (fold <> 1), count(*) filter (fold <> 2), count(*) filter (fold <> 3), count(*) filter (fold <> 4)] as n from g group by author, k, gram),
    n as (select author, f, k, suffix, starts, suffix_starts, n[f + 1] as n from c, unnest(range(5)) as h(f) where n[f + 1] > 0),
    l as (select 'top' as kind, author, f, k, n from n where k > 1 union all select 'low', author, f, k, n from n where k = 2 and starts union all select 'low', author, f, k - 1, count(*) from n where k > 1 and not suffix_starts group by author, f, k, suffix)
    select kind, author, k, f as fold, count(*) as grams, sum(n)::bigint as total, count(*) filter (n = 1) as t1, count(*) filter (n = 2) as t2, count(*) filter (n = 3) as t3, count(*) filter (n = 4) as t4
    from l group by kind, author, k, f""")
def ngram_fold_counts(spark, sf):
    """What is left of each source's n-gram counts when a fold is held out."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    docs = t(spark, sf, "documents").where("text is not null").select(F.col("source").alias("author"), (F.col("doc_id") % _FOLDS).cast("int").alias("fold"), words.alias("tokens"))
    rows = ngram.fold_sizes(docs, 3, _FOLDS).select("kind", "author", "k", F.posexplode("by_fold").alias("fold", "c"))
    return rows.where("c.grams > 0").select("kind", "author", "k", "fold", "c.*")


@query()
def naturalness_grid(spark, sf):
    """Cross-entropy of each role's turns under each role's models of two to four words, a fifth of the conversations held out."""
    turns = t(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("sample_idx"), F.col("role").alias("author"), F.pmod(F.xxhash64("conv_id"), F.lit(_FOLDS)).cast("int").alias("fold"), text.split_words(F.lower(F.coalesce("text", F.lit("")))).alias("tokens"))
    scores = ngram.grid(turns, [2, 3, 4], _FOLDS)
    return scores.groupBy("train_author", "author", "order", "fold").agg(F.count("*").alias("samples"), F.sum("tokens").alias("tokens"), F.avg("cross_entropy_bits").alias("cross_entropy_bits"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """documents with labels, token facts, a status cascade, and rates by language."""
    docs = labelled(spark, sf, "left").withColumn("n", F.size(text.tokens(F.col("text"))))
    status = gates.cascade([(F.col("n") == 0, "empty"), (F.col("n") < 20, "undersized"), (F.coalesce(F.col("quality"), F.lit(1)) == 0, "explicit_stub")], "nontrivial")
    return docs.withColumn("status", status).groupBy("lang").agg(F.count("*").alias("tasks"), gates.rate(F.col("status") == "nontrivial").alias("strict_rate"), F.avg("n").alias("token_count_mean"))


from . import code_queries, plan_queries, study_queries  # noqa: E402, F401
