"""Queries over study reports, contracts, and round trips of given tables through sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contracts, findings, gates, sets
from ..sources import jsonl, sinks, store
from .registry import query, t

# Reports


@query("""with f as (select l_returnflag as c, l_suppkey as r, l_linenumber as p from lineitem), a as (
    select 'total' as section, null::varchar as category, null::varchar as name, count(*) as n from f union all select 'category', null, c, count(*) from f group by c union all select 'rule', null, r::varchar, count(*) from f group by r
    union all select 'rule_in_category', c, r::varchar, count(*) from f group by c, r union all select 'priority', null, p::varchar, count(*) from f group by p)
    select * from (select *, row_number() over (partition by section, category order by n desc, name) as place from a) where section not like 'rule%' or place <= 10""")
def defect_study(spark, sf):
    """Lines of orders as findings."""
    return findings.defect_study(t(spark, sf, "lineitem"), "l_returnflag", "l_suppkey", "l_linenumber")


@query("""select 'lineitem' as part, * from (select coalesce(l_returnflag, '-') as author, count(*) as n, count(*) filter (l_discount is null) as discount_nulls, count(*) filter (l_discount = 0) as discount_zeros, count(*) filter (l_tax = 0) as tax_zeros from lineitem group by 1)""")
def profiled_write(spark, sf):
    """Nulls and zeros by group, counted while the table is written."""
    rows = t(spark, sf, "lineitem").withColumn("author", F.coalesce("l_returnflag", F.lit("-")))
    got = sinks.write_profiled(rows, store.place(spark, "profiled"), "author", ("A", "N", "R"), ("l_discount",), ("l_discount", "l_tax"))
    cells = {(g, c): x for g, c, *x in got}
    out = [("lineitem", g, cells[g, "l_discount"][0], cells[g, "l_discount"][1], cells[g, "l_discount"][2], cells[g, "l_tax"][2]) for g in dict.fromkeys(g for g, _ in cells)]
    return spark.createDataFrame(out, "part string, author string, n long, discount_nulls long, discount_zeros long, tax_zeros long").where("n > 0")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, rule from (select *, unnest(list_filter([case when not coalesce(l_discount <= l_tax, false) then 'discount below tax' end,
    case when not coalesce(l_quantity > 0 and l_quantity < 45, false) then 'quantity in range' end], lambda x: x is not null)) as rule from lineitem)""")
def contract_rules(spark, sf):
    """Named conditions between a row's numbers, all in one pass."""
    rules = {"discount below tax": "l_discount <= l_tax", "quantity in range": "l_quantity > 0 and l_quantity < 45"}
    return contracts.broken_rules(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], rules)


@query("select l_returnflag, count(*) as functions, count(*) filter (l_quantity - 10 <= 0 or l_linenumber - 1 <= 0 or l_suppkey % 7 = 0) as degenerate from lineitem group by 1")
def degenerate_functions(spark, sf):
    """P15."""
    none = gates.degenerate(F.col("l_quantity") - 10, F.col("l_linenumber") - 1, F.nullif(F.col("l_suppkey") % 7, F.lit(0)))
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("functions"), F.count_if(none).alias("degenerate"))


@query("select o_custkey as k from orders where o_orderpriority = '1-URGENT' except select o_custkey from orders where o_orderpriority in ('2-HIGH', '3-MEDIUM')")
def uncovered_union(spark, sf):
    """T5: keys that the union of other sets lacks."""
    by = lambda p: t(spark, sf, "orders").where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("k"))
    return sets.not_covered(by("1-URGENT"), [by("2-HIGH"), by("3-MEDIUM")], ["k"])


@query("select o_custkey as k from orders where o_orderpriority = '1-URGENT' intersect select o_custkey from orders where o_orderpriority = '5-LOW'")
def shared_keys(spark, sf):
    """T4."""
    by = lambda p: t(spark, sf, "orders").where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("k"))
    return sets.intersection(by("1-URGENT"), by("5-LOW"), ["k"])


# Round trips


def _customers(spark, sf):
    c = F.col
    return t(spark, sf, "customer").select(F.concat(F.lit("c"), F.lpad(c("c_custkey").cast("string"), 9, "0")).alias("key"), c("c_name").alias("name"), c("c_nationkey").cast("long").alias("nation"), F.when(c("c_acctbal") > 0, c("c_acctbal").cast("double")).alias("balance"))


_CUSTOMERS = "(select 'c' || lpad(c_custkey::varchar, 9, '0') as key, c_name as name, c_nationkey::bigint as nation, case when c_acctbal > 0 then c_acctbal::double end as balance from customer)"
_CUSTOMER = T.StructType([T.StructField("key", T.StringType()), T.StructField("name", T.StringType()), T.StructField("nation", T.LongType()), T.StructField("balance", T.DoubleType())])


@query(f"select key, name, nation, balance from {_CUSTOMERS}")
def json_round_trip(spark, sf):
    """Written as JSON lines and read again by unique key."""
    sinks.write_jsonl(_customers(spark, sf), path := store.place(spark, "customers"))
    return jsonl.load_index(spark, path, _CUSTOMER, "key").drop("ordinal")


def _spoilt(spark, sf) -> str:
    """Customers as JSON lines of which some are blank, cut off or no object."""
    rows = _customers(spark, sf)
    kind = F.substring("key", -1, 1)
    line = F.when(kind == "3", F.lit("  ")).when(kind == "5", F.concat(F.lit('{"key": "'), "key")).when(kind == "7", F.concat(F.lit('["'), "key", F.lit('"]'))).otherwise(F.to_json(F.struct("*")))
    rows.select(line.alias("value")).write.text(path := store.place(spark, "spoilt"))
    return path


@query(f"select key, name, nation, balance from {_CUSTOMERS} where right(key, 1) not in ('3', '5', '7')")
def tolerant_scan(spark, sf):
    """Lines that can not be read are left out."""
    return jsonl.read_jsonl(spark, _spoilt(spark, sf), _CUSTOMER, tolerant=True).drop("ordinal")


@query(f"""select case right(key, 1) when '5' then '{{"key": "' || key else '["' || key || '"]' end as value from {_CUSTOMERS} where right(key, 1) in ('5', '7')""")
def rejected_lines(spark, sf):
    """And these are they."""
    return jsonl.rejected(spark, _spoilt(spark, sf)).select("value")


@query(f"select key, row_number() over (order by key) - 1 as idx from {_CUSTOMERS}")
def dataset_ordinals(spark, sf):
    """Places of keys in files that were written in order of keys."""
    _customers(spark, sf).repartitionByRange(5, "key").sortWithinPartitions("key").write.option("ignoreNullFields", False).json(path := store.place(spark, "dataset"))
    return jsonl.dataset_keys(spark, path, "key")


@query(f"select key, upper(name) as name, nation, balance from {_CUSTOMERS} where right(key, 1) not in ('3', '5', '7')")
def transformed_lines(spark, sf):
    """One field of each line changed; what can not be read passes as it is."""
    changed = jsonl.transformed_lines(spark, _spoilt(spark, sf), "name", F.upper)
    changed.select("value").write.text(path := store.place(spark, "transformed"))
    return jsonl.read_jsonl(spark, path, _CUSTOMER, tolerant=True).drop("ordinal")


@query("select event_id, user_id, event_type, case when value > 10 then value end as value from events")
def table_round_trip(spark, sf):
    """K5, S3: written as a table that is held against what was written, and read with NaN as null."""
    rows = t(spark, sf, "events").select("event_id", "user_id", "event_type", F.when(F.col("value") > 10, F.col("value")).otherwise(F.lit(float("nan"))).alias("value"))
    sinks.write_table(rows, path := store.place(spark, "events"))
    return jsonl.read_table(spark, path, ["event_id", "user_id", "event_type", "value"])


@query("select event_type as author, count(*) as n, count(distinct user_id) as users from events group by 1")
def author_files(spark, sf):
    """K6: a folder of JSON lines for each author."""
    sinks.write_by_author(t(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("author")), path := store.place(spark, "authors"))
    return spark.read.schema("event_id long, user_id long, author string").json(path).groupBy("author").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"select key, name, nation, balance from {_CUSTOMERS}")
def csv_round_trip(spark, sf):
    """K4, S4."""
    sinks.write_csv(_customers(spark, sf), path := store.place(spark, "csv"))
    return jsonl.read_csv(spark, path, _CUSTOMER)


@query("select p_brand || '_' || p_size as id, min(p_type) as body, count(*) as n, count(distinct p_type) > 1 as conflict from part group by 1")
def rule_merge(spark, sf):
    """Rules by id, and the ids whose bodies differ."""
    rows = t(spark, sf, "part").select(F.concat_ws("_", "p_brand", "p_size").alias("id"), F.col("p_type").alias("body"))
    one, conflicts = jsonl.merged_rules(rows)
    return one.join(conflicts.withColumn("conflict", F.lit(True)), "id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


@query("select orders.o_orderkey as id, o_orderpriority, o_totalprice from orders where o_orderkey in (select min(o_orderkey) from orders group by o_orderpriority)")
def chosen_rows(spark, sf):
    """The rows of given ids, all of which must be there."""
    orders = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderpriority", "o_totalprice")
    ids = [r.id for r in t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.min("o_orderkey").cast("string").alias("id")).collect()]  # a few priorities
    return jsonl.only(orders, "id", ids).withColumn("id", F.col("id").cast("long"))
