"""Further registered queries: sampling plans, stores, heads and modes, forms of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import generation, lookup
from ..sources import tables
from .registry import query, table


@query("select c_custkey || '_n' || i as sample from customer, (select unnest(range(1, 4)) as i) where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and i = 1)")
def repeat_samples(spark, sf_dir):
    bugs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("instance_id"))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.col("o_custkey").cast("string"), F.lit("_n1")).alias("sample"))
    return generation.samples(bugs, 3, done).select("sample")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders where o_orderstatus = 'F') where r = 1")
def first_hit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return generation.first_hit(o, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query("select user_id, max(value) as value from events group by 1 having max(value) >= 50")
def group_max(spark, sf_dir):
    return generation.group_max(table(spark, sf_dir, "events"), "user_id", ["value"], 50)


@query("select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, event_type) as r from (select user_id, event_type, count(*) as n from events group by 1, 2)) where r = 1")
def most_common_item(spark, sf_dir):
    return generation.most_common(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as r from conversations) where r <= 5")
def head_per_list(spark, sf_dir):
    return generation.head(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 5)


@query("select p_partkey as k, 'new' as v from part where p_partkey % 3 = 0 union all select p_partkey, 'old' from part where p_partkey % 3 <> 0 and p_partkey % 2 = 0")
def keyed_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    old, new = p.where("k % 2 = 0").withColumn("v", F.lit("old")), p.where("k % 3 = 0").withColumn("v", F.lit("new"))
    return tables.upsert(old, new, "k")


@query("select c_custkey, min(o_orderkey) as o_orderkey from customer left join orders on o_custkey = c_custkey group by 1")
def point_lookup(spark, sf_dir):
    store = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(store, "c_custkey", "left")


@query("with k as (select distinct p_brand as keyword from part), a as (select keyword, p_partkey from k join part on p_brand = keyword and p_size > 45), b as (select keyword, p_partkey from k join part on p_brand = keyword and p_size <= 2) select * from a union all select * from b where keyword not in (select keyword from a)")
def fallback_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("keyword"), "p_partkey", "p_size")
    return lookup.with_fallback(p.where("p_size > 45").drop("p_size"), p.where("p_size <= 2").drop("p_size"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 'tests/t' || p_partkey || '.py' end as directive from part")
def test_directives(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("tests/t"), k, F.lit(".py"))).otherwise("data/x.json")
    patch = F.concat(F.lit("diff --git a/x b/"), name, F.lit("\n+a\n"))
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(tx.test_directives(patch), F.lit(1)).alias("directive"))


@query("select distinct p_size % 2 = 1 as flag, p_size from part")
def bool_cast(spark, sf_dir):
    word = F.when(F.col("p_size") % 2 == 1, "Yes").otherwise("f")
    return table(spark, sf_dir, "part").select(tx.string_to_bool(word).alias("flag"), "p_size").distinct()


@query("select page_id, coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') as title from pages")
def between_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(tx.between(F.col("html"), "<title>", "</title>"), F.lit("")).alias("title"))


@query("select p_partkey, '@@ -' || p_size || ',2 +' || p_size || ',' || (1 + p_partkey % 3) || ' @@' as header from part")
def hunk_headers(spark, sf_dir):
    lines = F.concat(F.array(F.lit(" a"), F.lit("-b")), F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int")), lambda i: F.when(i > 0, "+c")))
    lines = F.filter(lines, lambda x: x.isNotNull())
    return table(spark, sf_dir, "part").select("p_partkey", generation.hunk_header(F.col("p_size"), F.col("p_size"), lines).alias("header"))
