"""Relational idioms on the order tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import profile, sampling, sets

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register the decorated function with its DuckDB text."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, *names: str):
    frames = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return frames[0] if len(frames) == 1 else frames


@query("select sum((text is null)::int)::bigint as text, sum((lang is null)::int)::bigint as lang, sum((source is null)::int)::bigint as source from documents")
def null_profile(spark, sf_dir) -> DataFrame:
    return profile.null_counts(t(spark, sf_dir, "documents").select("text", "lang", "source"))


@query("select c_mktsegment, count(*) as n from customer group by 1")
def group_count_sorted(spark, sf_dir) -> DataFrame:
    return profile.value_counts(t(spark, sf_dir, "customer"), "c_mktsegment")


@query("select c_custkey, count(*) as n from customer group by 1 having count(*) > 1")
def duplicate_ids(spark, sf_dir) -> DataFrame:
    return profile.duplicates(t(spark, sf_dir, "customer"), "c_custkey")


@query("""select o_custkey, trim(unnest(string_split(ids, ','))) as o_orderkey
  from (select o_custkey, string_agg(o_orderkey::varchar, ',') as ids from orders group by 1)""")
def list_to_pairs(spark, sf_dir) -> DataFrame:
    from ..sources.tables import list_to_pairs as explode

    lists = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ",").alias("ids"))
    return explode(lists, "o_custkey", "ids", "o_orderkey")


@query("""select n_name, o_orderpriority, count(*) as n, sum(o_totalprice) as total
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where r_name = 'ASIA' or r_regionkey = 1 group by all""")
def join_chain(spark, sf_dir) -> DataFrame:
    o, c, n, r = t(spark, sf_dir, "orders", "customer", "nation", "region")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.filter((F.col("r_name") == "ASIA") | (F.col("r_regionkey") == 1)).groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("""select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey and abs(o_totalprice - l_extendedprice) <= 1000""")
def join_with_residual(spark, sf_dir) -> DataFrame:
    o, l = t(spark, sf_dir, "orders", "lineitem")
    return o.join(l, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.abs(F.col("o_totalprice") - F.col("l_extendedprice")) <= 1000)).select("o_orderkey", "l_linenumber")


@query("""select distinct l_orderkey, l_linenumber from lineitem join supplier on l_suppkey = s_suppkey
  where l_partkey = s_suppkey or l_orderkey % 1000 = s_suppkey or l_linenumber = s_suppkey""")
def join_disjunction(spark, sf_dir) -> DataFrame:
    """A disjunction under an equality, as a union of equi-joins."""
    l, s = t(spark, sf_dir, "lineitem", "supplier")
    base = F.col("l_suppkey") == F.col("s_suppkey")
    arms = [F.col("l_partkey"), F.col("l_orderkey") % 1000, F.col("l_linenumber").cast("long")]
    return sets.union_distinct([l.join(s, base & (a == F.col("s_suppkey"))).select("l_orderkey", "l_linenumber") for a in arms])


@query("select c_custkey, coalesce(max(o_orderpriority), '') as priority from customer left join orders on c_custkey = o_custkey group by 1")
def left_join_coalesce(spark, sf_dir) -> DataFrame:
    c, o = t(spark, sf_dir, "customer", "orders")
    best = o.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("priority"))
    return c.join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("priority", F.lit("")).alias("priority"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join(spark, sf_dir) -> DataFrame:
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 200000)")
def not_in(spark, sf_dir) -> DataFrame:
    c, o = t(spark, sf_dir, "customer", "orders")
    return sets.not_in(c, "c_custkey", o.filter("o_totalprice > 200000"), "o_custkey").select("c_custkey")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def semi_join(spark, sf_dir) -> DataFrame:
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""select coalesce(a.k, b.k) as k, coalesce(a.n, 0) as orders, coalesce(b.n, 0) as suppliers from
  (select o_custkey % 150 as k, count(*) as n from orders group by 1) a full join (select s_suppkey + 100 as k, count(*) as n from supplier group by 1) b on a.k = b.k""")
def full_outer_join(spark, sf_dir) -> DataFrame:
    o, s = t(spark, sf_dir, "orders", "supplier")
    a = o.groupBy((F.col("o_custkey") % 150).alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = s.groupBy((F.col("s_suppkey") + 100).alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "outer").select("k", F.coalesce("a", F.lit(0)).alias("orders"), F.coalesce("b", F.lit(0)).alias("suppliers"))


@query("""with s as (select row_number() over (order by c_custkey) as r, c_custkey from customer), u as (select row_number() over (order by s_suppkey) as r, s_suppkey from supplier)
  select c_custkey, s_suppkey from s join u using (r)""")
def positional_zip(spark, sf_dir) -> DataFrame:
    c, s = t(spark, sf_dir, "customer", "supplier")
    return sets.zip_by_order(c.select("c_custkey"), "c_custkey", s.select("s_suppkey"), "s_suppkey")


@query("select p_partkey, unnest(list_distinct(string_split(p_name, ' '))) as word from part")
def lateral_tokens(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))


@query("""select o_custkey, count(*) as n, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as finished, count(distinct o_orderpriority) as priorities,
  min(o_totalprice) as low, avg(o_totalprice) as mean, max(o_totalprice) as high from orders group by 1 having count(*) between 5 and 12""")
def conditional_aggregates(spark, sf_dir) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    out = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.countDistinct("o_orderpriority").alias("priorities"),
        F.min(price).alias("low"), F.avg(price).alias("mean"), F.max(price).alias("high"),
    )
    return out.filter(F.col("n").between(5, 12))


@query("""select count(*) as n, median(k)::double as median, quantile_cont(k, 0.75)::double as p75, quantile_cont(k, 0.9)::double as p90, quantile_cont(k, 0.95)::double as p95, quantile_cont(k, 0.99)::double as p99
  from (select o_custkey, count(*) as k from orders group by 1)""")
def fan_out_percentiles(spark, sf_dir) -> DataFrame:
    return profile.percentiles(t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")), "k")


@query("""select case when k <= 5 then '1-5' when k <= 10 then '6-10' when k <= 20 then '11-20' else '21+' end as bucket, count(*) as n, min(k) as low
  from (select o_custkey, count(*) as k from orders group by 1) group by 1""")
def bucket_histogram(spark, sf_dir) -> DataFrame:
    return profile.histogram(t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")), "k", ((5, "1-5"), (10, "6-10"), (20, "11-20")), "21+")


@query("select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_totalprice desc, o_orderkey) as ids from orders group by 1")
def ordered_list_aggregate(spark, sf_dir) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k"))))
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(items, lambda x: x["k"].cast("string")), ",").alias("ids"))


@query("select o_custkey, o_orderkey from (select *, count(*) over (partition by o_custkey) as n from orders) where n <= 8")
def fan_out_cap(spark, sf_dir) -> DataFrame:
    return sets.fan_out_cap(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 8)


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
def top_k_per_group(spark, sf_dir) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("o_custkey", "o_orderkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def order_limit(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select o_orderkey from orders order by md5('7:' || o_orderkey), o_orderkey limit 100")
def seeded_sample(spark, sf_dir) -> DataFrame:
    return sampling.seeded(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


@query("select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by md5('3:' || o_orderkey), o_orderkey) as r from orders) where r <= 20")
def class_quota(spark, sf_dir) -> DataFrame:
    return sampling.quota(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 20, 3)


@query("select o_orderkey, (('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 4)::bigint as part from orders")
def hash_split(spark, sf_dir) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    return o.select("o_orderkey", sampling.part_of(F.col("o_orderkey"), 4).alias("part"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(spark, sf_dir) -> DataFrame:
    c, s = t(spark, sf_dir, "customer", "supplier")
    return sets.union_distinct([c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))])


@query("select o_custkey as k from orders except select c_custkey from customer where c_acctbal > 0")
def except_distinct(spark, sf_dir) -> DataFrame:
    c, o = t(spark, sf_dir, "customer", "orders")
    return o.select(F.col("o_custkey").alias("k")).subtract(c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal > 0")
def intersect_distinct(spark, sf_dir) -> DataFrame:
    c, o = t(spark, sf_dir, "customer", "orders")
    return o.select(F.col("o_custkey").alias("k")).intersect(c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("""with n as (select distinct l_orderkey as a, l_partkey as b from lineitem where l_quantity > 20), o as (select distinct l_orderkey as a, l_partkey as b from lineitem where l_quantity > 35),
  d as (select * from n where not exists (select 1 from o where o.a = n.a and o.b = n.b))
  select (select count(*) from o) as old, (select count(*) from d) as added, (select count(*) from (select * from o union select * from n)) as total""")
def delta_check(spark, sf_dir) -> DataFrame:
    l = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), "l_quantity")
    return sets.delta_check(l.filter("l_quantity > 20").select("a", "b"), l.filter("l_quantity > 35").select("a", "b"))


@query("""select p_partkey, lower(replace(p_name, ' ', '_')) as slug, substr(p_type, 1, 5) as head, right(p_type, 4) as tail, length(p_name) as n, split_part(p_name, ' ', 2) as second,
  strpos(p_name, 'e')::bigint as place, regexp_extract(p_brand, '([0-9]+)', 1) as digits, translate(p_name, 'aei', '431') as leet, p_name like '%e%' as has_e, regexp_matches(p_type, '^[A-Z]') as upper_start from part""")
def string_functions(spark, sf_dir) -> DataFrame:
    n, ty = F.col("p_name"), F.col("p_type")
    return t(spark, sf_dir, "part").select(
        "p_partkey", F.lower(F.replace(n, F.lit(" "), F.lit("_"))).alias("slug"), F.substring(ty, 1, 5).alias("head"), F.right(ty, F.lit(4)).alias("tail"),
        F.char_length(n).alias("n"), F.split_part(n, F.lit(" "), F.lit(2)).alias("second"), F.instr(n, "e").cast("long").alias("place"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.translate(n, "aei", "431").alias("leet"), n.like("%e%").alias("has_e"), ty.rlike("^[A-Z]").alias("upper_start"),
    )


@query("""select p_partkey, array_to_string(list_sort(list_filter(ws, lambda w: length(w) > 3)), '_') as bag, array_to_string(list_reverse_sort(ws)[1:2], '|') as top, len(list_intersect(ws, ts))::int as shared,
  coalesce(ws[3], '') as third, list_contains(ws, 'x') as has_x, array_to_string(regexp_extract_all(p_type, '[A-Z]'), '') as capitals
  from (select *, string_split(p_name, ' ') as ws, string_split(lower(p_type), ' ') as ts from part)""")
def array_functions(spark, sf_dir) -> DataFrame:
    p = t(spark, sf_dir, "part").withColumns({"ws": F.split("p_name", " "), "ts": F.split(F.lower("p_type"), " ")})
    return p.select(
        "p_partkey", F.array_join(F.sort_array(F.filter("ws", lambda w: F.char_length(w) > 3)), "_").alias("bag"), F.array_join(F.slice(F.sort_array("ws", False), 1, 2), "|").alias("top"),
        F.size(F.array_intersect("ws", "ts")).alias("shared"), F.coalesce(F.get("ws", F.lit(2)), F.lit("")).alias("third"), F.array_contains("ws", "x").alias("has_x"),
        F.array_join(F.regexp_extract_all("p_type", F.lit("[A-Z]"), F.lit(0)), "").alias("capitals"),
    )


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base_price, sum(l_extendedprice * (1 - l_discount)) as sum_disc_price,
  avg(l_quantity) as avg_qty, avg(l_discount) as avg_disc, count(*) as count_order from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, sf_dir) -> DataFrame:
    l = t(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base_price"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"),
        F.avg("l_quantity").alias("avg_qty"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
    )
