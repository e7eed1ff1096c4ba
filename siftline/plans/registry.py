"""Registered queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import bm25, lookup, outcomes, setjoin, trees
from ..streaming import chat

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a file of few splits gives few tasks, and what follows costs more than moving its rows once."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def tokens(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return spread(df.select(*keep, text)).select(*keep, tx.identifier_tokens(F.col(text)).alias("tokens"))


# Identifier tokens of a column {0} in DuckDB.
_TOK = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(regexp_replace(regexp_replace(replace(coalesce({0}, ''), '.py', ''), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '[^a-z0-9_]', ' ', 'g'), '[_\s]+'), lambda t: case when t = 'tests' then 'test' else t end), lambda t: t <> '' and t <> 'test')"""
_DOCS = f"d as (select doc_id, {_TOK.format('text')} as tokens from documents)"
_ITEMS = f"q as (select item_id, {_TOK.format('text')} as tokens from benchmark)"


def _bm25_sql(q: str, d: str, out: str) -> str:
    """CTEs of a BM25 of q(item_id, tokens) over d(doc_id, tokens), named with prefix out."""
    return f"""
{out}_ab as (select count(*) as n, avg(len(tokens)) as avgdl from {d}),
{out}_tf as (select doc_id, token, count(*) as tf, any_value(dl) as dl from (select doc_id, len(tokens) as dl, unnest(tokens) as token from {d}) group by 1, 2),
{out}_raw as (select token, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select token, count(*) as df from {out}_tf group by 1), {out}_ab),
{out}_idf as (select token, case when raw < 0 then 0.25 * (select avg(raw) from {out}_raw) else raw end as idf from {out}_raw),
{out}_q as (select item_id, token, count(*) as times from (select item_id, unnest(tokens) as token from {q}) group by 1, 2),
{out} as (select item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from {out}_q join {out}_idf using (token) join {out}_tf using (token), {out}_ab group by 1, 2)"""


def _scaled(value: str, key: str = "item_id") -> str:
    w = f"over (partition by {key})"
    return f"case when max({value}) {w} > min({value}) {w} then round(({value} - min({value}) {w}) / (max({value}) {w} - min({value}) {w}), 6) else 0.0 end"


@query(f"select doc_id, len(tokens) as n_tokens, len(list_distinct(tokens)) as n_distinct, tokens[1] as first_token from (with {_DOCS} select * from d)")
def tokenize_docs(spark, sf_dir):
    t = F.col("tokens")
    d = tokens(table(spark, sf_dir, "documents"), "text", "doc_id")
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.try_element_at(t, F.lit(1)).alias("first_token"))


@query(f"with {_ITEMS}, {_DOCS}, {_bm25_sql('q', 'd', 's')} select item_id, doc_id, score, rnk from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rnk from s) where rnk <= 3")
def bm25_topk(spark, sf_dir):
    q, d = tokens(table(spark, sf_dir, "benchmark"), "text", "item_id"), tokens(table(spark, sf_dir, "documents"), "text", "doc_id")
    return bm25.top_k(bm25.top_scores(q, d, 3), 3)


def _scaled_of(value: str) -> str:
    """min-max of value within item_id, where documents without a row count as 0."""
    w = "over (partition by item_id)"
    some = f"count(*) {w} < (select count(*) from d)"
    lo, hi = f"case when {some} then least(0.0, min({value}) {w}) else min({value}) {w} end", f"case when {some} then greatest(0.0, max({value}) {w}) else max({value}) {w} end"
    return f"case when {hi} > {lo} then round(({value} - {lo}) / ({hi} - {lo}), 6) else 0.0 end"


@query(f"with {_ITEMS}, {_DOCS}, {_bm25_sql('q', 'd', 's')} select item_id, doc_id, {_scaled_of('score')} as sim from s")
def bm25_minmax(spark, sf_dir):
    q, d = tokens(table(spark, sf_dir, "benchmark"), "text", "item_id"), tokens(table(spark, sf_dir, "documents"), "text", "doc_id")
    return bm25.min_max_of(bm25.scores(q, d), d, "score", "sim").drop("score")


_NAME_DOC = f"n as (select doc_id, {_TOK.format('coalesce(source, chr(32)) || chr(32) || coalesce(lang, chr(32)) || chr(32) || coalesce(split_part(text, chr(10), 1), chr(32))')} as tokens from documents)"


@query(
    f"with {_ITEMS}, {_DOCS}, {_NAME_DOC}, {_bm25_sql('q', 'n', 'a')}, {_bm25_sql('q', 'd', 'b')},"
    f"sa as (select item_id, doc_id, {_scaled_of('score')} as x from a), sb as (select item_id, doc_id, {_scaled_of('score')} as y from b),"
    "r as (select item_id, doc_id, coalesce(x, 0.0) as name_sim, coalesce(y, 0.0) as code_sim, 0.5 * coalesce(x, 0.0) + 0.5 * coalesce(y, 0.0) as raw from sa full join sb using (item_id, doc_id)),"
    f"m as (select item_id, doc_id, name_sim, code_sim, {_scaled_of('raw')} as sem from r)"
    "select item_id, doc_id, name_sim, code_sim, sem, rnk from (select *, row_number() over (partition by item_id order by sem desc, doc_id) as rnk from m) where rnk <= 5"
)
def semantic_blend_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    q, code = tokens(table(spark, sf_dir, "benchmark"), "text", "item_id"), tokens(docs, "text", "doc_id")
    label = F.concat_ws(" ", *[F.coalesce(c, F.lit(" ")) for c in (F.col("source"), F.col("lang"), F.substring_index("text", "\n", 1))])
    name = docs.select("doc_id", tx.identifier_tokens(label).alias("tokens"))
    return bm25.top_k(bm25.blend(bm25.scores(q, name), bm25.scores(q, code), docs), 5, by="sem")


@query("select o_custkey, o_orderkey, bucket from (select *, rank() over (partition by o_custkey order by bucket desc) as r from (select o_custkey, o_orderkey, cast(floor(o_totalprice / 50000) as bigint) as bucket from orders)) where r <= 2")
def topk_with_ties(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 50000).alias("bucket"))
    r = F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("bucket")))
    return o.withColumn("r", r).where("r <= 2").drop("r")


@query("select p_partkey, round(exp(p_size / 10.0) / sum(exp(p_size / 10.0)) over (partition by p_brand), 6) as p from part")
def softmax_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") / 10.0).alias("x"))
    return bm25.soft_max(p, "x", "p", "p_brand").select("p_partkey", "p")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def subset_semi(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.not_done(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("select c_custkey from customer where (select count(*) from orders where o_custkey = c_custkey) < 5")
def resume_multi(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.not_done(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey", 5)


@query("select o_orderkey from orders where o_orderkey >= 100 and o_orderkey < 5000")
def range_scan(spark, sf_dir):
    return lookup.between_ids(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 5000)


@query("select d.doc_id, l.doc_id is null as parse_error, coalesce(l.toxic = 1, false) as has_error, coalesce(l.quality = 0, false) as is_fib, coalesce(l.quality = 1 and l.toxic = 0, false) as success from documents d left join labels l on l.doc_id = d.doc_id")
def tri_state_flags(spark, sf_dir):
    l = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "k")  # noqa: E741
    d = table(spark, sf_dir, "documents").select("doc_id").join(l, F.col("doc_id") == F.col("k"), "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return d.select("doc_id", F.col("k").isNull().alias("parse_error"), no(F.col("toxic") == 1).alias("has_error"), no(F.col("quality") == 0).alias("is_fib"), no((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("success"))


@query("with e as (select user_id, cast(ts as date) as d, bool_or(event_type = 'error') as bad from events group by 1, 2) select b.user_id, cast(b.d as varchar) as d, b.bad and not coalesce(a.bad, true) as success from e b left join e a on a.user_id = b.user_id and a.d = b.d + 1")
def fail_to_pass(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.bool_or(F.col("event_type") == "error").alias("bad"))
    after = e.select(F.col("user_id").alias("u"), F.date_sub("d", 1).alias("before"), F.col("bad").alias("bad_after"))
    j = e.join(after, (F.col("user_id") == F.col("u")) & (F.col("d") == F.col("before")), "left")
    return j.select("user_id", F.col("d").cast("string").alias("d"), outcomes.fail_to_pass(F.col("bad"), F.col("bad_after")).alias("success"))


@query("with r as (select n_regionkey as r_regionkey, min(n_nationkey) as lo, max(n_nationkey) as hi from nation group by 1) select r_regionkey, count(*) as n_points from customer join r on c_nationkey between lo and hi group by 1")
def range_join_lines(spark, sf_dir):
    r = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.min("n_nationkey").alias("lo"), F.max("n_nationkey").alias("hi"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return lookup.range_join(c, r, "c_nationkey", "lo", "hi", 5).groupBy("r_regionkey").agg(F.sum("n").alias("n_points"))


_NODES = """
node as (select 'r' || r_regionkey as node_id, null as parent_id, upper(substr(r_name, 1, 1)) as name from region
 union all select 'n' || n_nationkey, 'r' || n_regionkey, upper(substr(n_name, 1, 1)) from nation
 union all select 'c' || c_custkey, 'n' || c_nationkey, upper(substr(c_name, 1, 1)) from customer)"""


def _nodes(spark, sf_dir):
    initial = lambda c: F.upper(F.substring(c, 1, 1)).alias("name")
    sid = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.array().cast("array<string>").alias("ancestors")
    r = table(spark, sf_dir, "region").select(sid("r", "r_regionkey").alias("node_id"), initial("r_name"), none)
    n = table(spark, sf_dir, "nation").select(sid("n", "n_nationkey").alias("node_id"), initial("n_name"), F.array(sid("r", "n_regionkey")).alias("ancestors"), "n_nationkey")
    up = n.select("n_nationkey", F.concat(F.array("node_id"), "ancestors").alias("ancestors"))
    c = table(spark, sf_dir, "customer").join(up, F.col("c_nationkey") == F.col("n_nationkey")).select(sid("c", "c_custkey").alias("node_id"), initial("c_name"), "ancestors")
    return r.unionByName(n.drop("n_nationkey")).unionByName(c)


@query(f"with {_NODES}, k as (select distinct name as keyword from node), hit as (select keyword, node_id, parent_id from k join node on name = keyword), up as (select h.keyword, h.node_id, p.node_id as a from hit h join node p on p.node_id = h.parent_id union all select h.keyword, h.node_id, g.node_id from hit h join node p on p.node_id = h.parent_id join node g on g.node_id = p.parent_id) select keyword, node_id from hit h where not exists (select 1 from up join hit x on x.keyword = up.keyword and x.node_id = up.a where up.keyword = h.keyword and up.node_id = h.node_id)")
def name_join_hidden(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return lookup.visible_matches(n.select(F.col("name").alias("keyword")).distinct(), n)


@query("with k as (select p_type || '.' || p_name as keyword from part) select distinct keyword, p_partkey from k join part on p_type || '.' || p_name = keyword")
def suffix_path_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    keywords = p.select(F.concat_ws(".", "p_type", "p_name").alias("keyword")).distinct()
    nodes = p.select(F.col("p_partkey").alias("node_id"), F.array("p_brand", "p_type", "p_name").alias("path"))
    return lookup.path_matches(keywords, nodes).distinct().withColumnRenamed("node_id", "p_partkey")


@query("with a as (select distinct user_id, event_type from events where day(ts) <= 15), b as (select distinct user_id, event_type from events where day(ts) > 15) select u.user_id, exists (select 1 from a join b using (user_id, event_type) where user_id = u.user_id) as matched from (select distinct user_id from events) u")
def exists_pair(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = e.where(F.dayofmonth("ts") <= 15), e.where(F.dayofmonth("ts") > 15)
    both = a.select("user_id", "event_type").join(b.select("user_id", "event_type"), ["user_id", "event_type"], "left_semi").select("user_id").distinct().withColumn("hit", F.lit(True))
    return e.select("user_id").distinct().join(both, "user_id", "left").select("user_id", F.coalesce("hit", F.lit(False)).alias("matched"))


@query("with k as (select distinct cast(json_extract(props, '$.k') as int) as k from events union all select null) select k from k where not exists (select 1 from (select n_nationkey as x from nation union all select null) where x is not distinct from k)")
def null_safe_anti(spark, sf_dir):
    null = spark.range(1).select(F.lit(None).cast("int").alias("k"))
    k = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k")).distinct().union(null)
    return lookup.missing_rows(k, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).union(null), ["k"])


@query("select flag, count(*) as n from lineitem join (values ('R', 'returned'), ('A', 'accepted')) t(f, flag) on l_returnflag = f group by 1")
def config_join(spark, sf_dir):
    dim = spark.sql("select * from values ('R', 'returned'), ('A', 'accepted') as t(f, flag)")  # two rows
    return table(spark, sf_dir, "lineitem").join(F.broadcast(dim), F.col("l_returnflag") == F.col("f")).groupBy("flag").agg(F.count("*").alias("n"))


def _hits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("keyword"), F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("path"), F.col("p_type").alias("parent_id"))


_HITS = "h as (select distinct unnest(string_split(p_name, ' ')) as keyword, p_partkey, p_brand, p_type from part), s as (select *, 1.0 / count(*) over (partition by keyword) as s from h), t as (select *, sum(s) over (partition by p_partkey) as ns, sum(s) over (partition by p_brand) as fs from s)"


@query(f"with {_HITS} select distinct p_partkey, round(ns, 6) as node_score, round(fs, 6) as file_score from t")
def keyword_node_score(spark, sf_dir):
    s = lookup.ambiguity_scores(_hits(spark, sf_dir))
    return s.select(F.col("node_id").alias("p_partkey"), F.round("node_score", 6).alias("node_score"), F.round("file_score", 6).alias("file_score")).distinct()


@query(f"with {_HITS}, u as (select p_type, sum(s) as ps from t group by 1), f as (select keyword, p_partkey, round(ns + fs + ps, 6) as total from t join u using (p_type)) select keyword, p_partkey, total from (select *, row_number() over (partition by keyword order by total desc, p_partkey) as r from f) where r = 1")
def keyword_best_node(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    s = lookup.ambiguity_scores(hits)
    share = hits.withColumn("s", 1.0 / F.count("*").over(Window.partitionBy("keyword")))
    parents = share.groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("s").alias("node_score"))
    return lookup.best_nodes(s, parents).withColumnRenamed("node_id", "p_partkey")


@query(f"with {_DOCS} select token, count(*) as df from (select distinct doc_id, unnest(tokens) as token from d) group by 1")
def document_frequency(spark, sf_dir):
    return bm25.document_frequency(tokens(table(spark, sf_dir, "documents"), "text", "doc_id"))


@query(f"with {_DOCS}, f as (select token, count(*) as df from (select distinct doc_id, unnest(tokens) as token from d) group by 1), n as (select count(*) as n from documents) select token, round(case when token in ('the', 'und') then 1.0 when df >= n then 0.1 else greatest(0.1, 0.1 + 0.8 * log10(n / (df + 1.0)) / case when n > 1 then log10(n) else 1 end) end, 6) as weight from f, n")
def node_weights(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = d.agg(F.count("*").alias("n"))
    f = bm25.document_frequency(tokens(d, "text", "doc_id")).crossJoin(F.broadcast(n))
    return f.select("token", F.round(trees.node_weight(F.col("df"), F.col("n"), F.col("token").isin("the", "und")), 6).alias("weight"))


@query("select doc_id, count(*) filter (where l like '+%') as added, count(*) filter (where l like '-%') as removed, count(*) filter (where not (l like '+%' or l like '-%')) as context from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l from documents) group by 1")
def hunk_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
    n = lambda f: F.size(F.filter("ls", f)).cast("long")
    add, cut = (lambda x: x.startswith("+")), (lambda x: x.startswith("-"))
    return lines.select("doc_id", n(add).alias("added"), n(cut).alias("removed"), n(lambda x: ~(add(x) | cut(x))).alias("context"))


_MASK = "{0}"
for _p, _t in tx.VOLATILE:
    _MASK = f"regexp_replace({_MASK}, '{_p}', '{_t}', 'g')"


@query(f"with t as (select page_id, {_MASK.format(chr(39) + 'line ' + chr(39) + ' || (page_id % 7) || ' + chr(39) + ' in 0x' + chr(39) + ' || (page_id % 3) || ' + chr(39) + ' of ' + chr(39) + ' || (page_id % 5)')} as rep from pages) select rep, count(*) as n, min(page_id) as first_page from t group by 1")
def output_clusters(spark, sf_dir):
    s = lambda k: F.pmod(F.col("page_id"), F.lit(k)).cast("string")
    out = F.concat(F.lit("line "), s(7), F.lit(" in 0x"), s(3), F.lit(" of "), s(5))
    return table(spark, sf_dir, "pages").groupBy(tx.mask_volatile(out).alias("rep")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def _features(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("bug"), F.concat("o_orderstatus", F.lit("-"), F.substring("o_orderpriority", 1, 1)).alias("cluster"), F.col("o_orderkey").alias("test"), F.col("o_orderkey").alias("pos"),
        F.floor(F.col("o_totalprice") / 1000).alias("length"), F.pmod(F.col("o_orderkey"), F.lit(4)).alias("assertions"), (F.substring("o_orderpriority", 1, 1) == "1").alias("exception_match"),
        (F.col("o_orderstatus") == "P").alias("trace_match"), (F.col("o_orderstatus") == "F").alias("success"),
    )


_FEAT = "f as (select o_custkey as bug, o_orderstatus || '-' || substr(o_orderpriority, 1, 1) as cluster, o_orderkey as test, cast(floor(o_totalprice / 1000) as bigint) as length, o_orderkey % 4 as assertions, substr(o_orderpriority, 1, 1) = '1' as em, o_orderstatus = 'P' as tm, o_orderstatus = 'F' as success from orders)"
_RANK = (
    f"{_FEAT}, c as (select bug, cluster, count(*) as size, min(length) as ml, min(assertions) as ma, min(test) as fp, arg_min(cast(em as int) + 2 * cast(tm as int), test) as m from f group by 1, 2),"
    "g as (select *, max(size) over w as xs, max(ml) over w as xl, max(ma) over w as xa from c window w as (partition by bug, m > 0)),"
    "sc as (select bug, cluster, m, fp, round(0.3 * 100 * ln(1 + size) / ln(1 + xs) + 0.5 * (100 - 100 * ln(1 + ml) / ln(1 + greatest(xl, 1))) + 0.2 * (100 - 100 * ln(1 + ma) / ln(1 + greatest(xa, 1))), 6) as score from g),"
    "rk as (select f.*, score, row_number() over (partition by f.bug order by (m > 0) desc, score desc, fp, f.cluster, em desc, assertions, length, test) as rnk from f join sc using (bug, cluster)),"
    "fs as (select bug, coalesce(min(rnk) filter (where success), 100000) as first_rank, count(*) as num from rk group by 1)"
)


@query(f"with {_FEAT} select bug, cluster, count(*) as size, min(length) as min_len, min(assertions) as min_asserts from f group by 1, 2")
def cluster_features(spark, sf_dir):
    return _features(spark, sf_dir).groupBy("bug", "cluster").agg(F.count("*").alias("size"), F.min("length").alias("min_len"), F.min("assertions").alias("min_asserts"))


@query(f"with {_RANK} select bug, test, rnk, score from rk")
def rank_tests(spark, sf_dir):
    return outcomes.rank_tests(_features(spark, sf_dir)).select("bug", "test", "rnk", "score")


@query(f"with {_RANK} select bug, first_rank from fs")
def first_success_rank(spark, sf_dir):
    return outcomes.first_success(outcomes.rank_tests(_features(spark, sf_dir))).select("bug", "first_rank")


@query(f"with {_RANK} select n, count(*) filter (where first_rank <= n) as acc, round(avg(case when first_rank <= n then 1.0 else 0.0 end), 6) as frac from fs, (values (1), (3), (5)) t(n) group by 1")
def acc_at_n(spark, sf_dir):
    return outcomes.accuracy(outcomes.first_success(outcomes.rank_tests(_features(spark, sf_dir))))


@query(f"with {_RANK}, w as (select n, case when first_rank <= n then first_rank - 1 else least(num, n) end as w from fs, (values (1), (3), (5)) t(n)) select n, cast(sum(w) as bigint) as total, round(avg(w), 6) as mean from w group by 1")
def wasted_effort(spark, sf_dir):
    return outcomes.wasted_effort(outcomes.first_success(outcomes.rank_tests(_features(spark, sf_dir))))


@query(f"with {_FEAT}, r as (select seed, bug, success, row_number() over (partition by seed, bug order by md5(seed || '-' || test)) as rnk from f, (select unnest(range(100)) as seed)), fs as (select seed, bug, coalesce(min(rnk) filter (where success), 100000) as fr from r group by 1, 2) select cast(seed as int) as seed, n, count(*) filter (where fr <= n) as acc from fs, (values (1), (3), (5)) t(n) group by 1, 2")
def random_baseline_md5(spark, sf_dir):
    first = outcomes.shuffled_first_success(spread(_features(spark, sf_dir).select("bug", "test", "success")), 100, "test").withColumnRenamed("first_rank", "fr")
    rows = first.withColumn("n", F.explode(F.array(*[F.lit(x) for x in (1, 3, 5)])))
    return rows.groupBy("seed", "n").agg(F.count_if(F.col("fr") <= F.col("n")).alias("acc"))


@query("with a as (select doc_id from documents order by n_chars desc, doc_id limit 20), b as (select doc_id from documents order by n_chars, doc_id limit 20), c as (select doc_id from documents order by doc_id limit 20), p as (select doc_id from labels where quality = 1) select doc_id from a union select doc_id from b union select doc_id from c union select doc_id from p")
def union_distinct_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tops = [d.orderBy(*o).limit(20).select("doc_id") for o in ((F.desc("n_chars"), "doc_id"), ("n_chars", "doc_id"), ("doc_id",))]  # top-k lists
    out = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    for t in tops:
        out = out.union(t)
    return out.distinct()


@query("select p_brand, seg, p_partkey from (select p_brand, list_last(string_split(p_name, ' ')) as seg, p_partkey, row_number() over (partition by p_brand, list_last(string_split(p_name, ' ')) order by p_partkey) as r from part) where r = 1")
def keep_first_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.element_at(F.split("p_name", " "), -1).alias("seg"), "p_partkey")
    return lookup.keep_first(p, ["p_brand", "seg"], ["p_partkey"])


_ERR = "t as (select doc_id, coalesce(text, '') || chr(10) || 'ValueError: ' || coalesce(lang, '') || ': ' || doc_id || chr(10) || 'BadWarning: x' || chr(10) || 'ValueError: ' || coalesce(lang, '') || ': ' || doc_id || ' ' as text from documents)"


def _with_errors(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    line = F.concat(F.lit("ValueError: "), F.coalesce("lang", F.lit("")), F.lit(": "), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line, F.lit("\nBadWarning: x\n"), line, F.lit(" ")).alias("text"))


@query(f"with {_ERR}, m as (select doc_id, list_concat(list_concat(regexp_extract_all(text, '(\\w+Error: .+)', 1), regexp_extract_all(text, '(\\w+Exception: .+)', 1)), regexp_extract_all(text, '(\\w+Warning: .+)', 1)) as ms from t), x as (select doc_id, unnest(ms) as msg, generate_subscripts(ms, 1) as p from m), y as (select *, row_number() over (partition by doc_id, trim(msg) order by p) as r from x) select doc_id, row_number() over (partition by doc_id order by p) - 1 as pos, trim(msg) as msg from y where r = 1")
def dedup_messages(spark, sf_dir):
    d = _with_errors(spark, sf_dir).select("doc_id", F.posexplode(tx.error_lines(F.col("text"))).alias("pos", "msg"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("msg").alias("msg"))


@query(f"with {_ERR}, x as (select doc_id, unnest(regexp_extract_all(text, '(\\w+Error: .+)', 1)) as m, generate_subscripts(regexp_extract_all(text, '(\\w+Error: .+)', 1), 1) - 1 as pos from t) select doc_id, cast(pos as int) as pos, split_part(m, ':', 1) as type, substr(m, strpos(m, ':') + 1) as content from x")
def extract_errors(spark, sf_dir):
    d = _with_errors(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(tx.ERROR_LINES[0]), F.lit(1))).alias("pos", "m"))
    return d.select("doc_id", "pos", tx.error_type(F.col("m")).alias("type"), tx.error_content(F.col("m")).alias("content"))


_WORDS = f"w as (select doc_id, source, list_distinct({_TOK.format('text')}) as tokens from documents)"


@query(f"with {_WORDS}, x as (select source, doc_id, len(tokens) as n, unnest(tokens) as t from w), p as (select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as i, any_value(a.n) as na, any_value(b.n) as nb from x a join x b on a.source = b.source and a.t = b.t and a.doc_id < b.doc_id and least(a.n, b.n) > 0.5 * greatest(a.n, b.n) group by 1, 2) select doc_a, doc_b, round(i / (na + nb - i), 6) as j from p where round(i / (na + nb - i), 6) > 0.5")
def jaccard_pairs(spark, sf_dir):
    sets = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", F.array_distinct(tx.identifier_tokens(F.col("text"))).alias("tokens"))
    return setjoin.jaccard(sets.where("source is not null"), 0.5, "source")


@query(f"with {_ITEMS}, {_DOCS}, a as (select item_id, unnest(list_distinct(tokens)) as t, len(list_distinct(tokens)) as n from q), b as (select doc_id, unnest(list_distinct(tokens)) as t from d), s as (select item_id, doc_id, round(count(*) / any_value(n), 6) as score from a join b using (t) group by 1, 2) select item_id, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id desc) as r from s) where r = 1")
def containment_best(spark, sf_dir):
    q, d = tokens(table(spark, sf_dir, "benchmark"), "text", "item_id"), tokens(table(spark, sf_dir, "documents"), "text", "doc_id")
    return setjoin.best_containers(q, d).groupBy("item_id", "score").agg(F.max("doc_id").alias("doc_id")).select("item_id", "doc_id", "score")


@query(f"select doc_id, md5({_MASK.format('text')}) as masked_md5 from documents")
def mask_volatile(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(tx.mask_volatile(F.col("text"))).alias("masked_md5"))


_WRAP = "'<think>no</think><result>```python' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10) || '```' || chr(10) || coalesce(role, '') || '```</result>'"


@query(f"with t as (select conv_id, turn, regexp_extract_all(regexp_extract(list_last(string_split({_WRAP}, '</think>')), '(?s)<result>(.*?)</result>', 1), '(?s)```(?:python)?(.*?)```', 1) as b from conversations) select conv_id, turn, trim(b[1], chr(32) || chr(9) || chr(10) || chr(13)) as first_block, trim(list_last(b), chr(32) || chr(9) || chr(10) || chr(13)) as last_block from t")
def extract_fenced(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = F.concat(F.lit("<think>no</think><result>```python\n"), F.coalesce("text", F.lit("")), F.lit("\n```\n```\n"), F.coalesce("role", F.lit("")), F.lit("```</result>"))
    return c.select("conv_id", "turn", tx.first_fence(tx.tagged(s)).alias("first_block"), tx.last_fence(tx.tagged(s)).alias("last_block"))


@query("with e as (select user_id, count(*) filter (where event_type = 'click') as a, count(*) filter (where event_type = 'error') as b from events group by 1), t as (select user_id, a || ' failed, ' || a || ' failed, ' || b || ' error in 1s' as log from e) select user_id, cast(list_sum(list_transform(regexp_extract_all(log, '(\\d+) failed', 1), lambda x: cast(x as bigint))) as bigint) as failed, cast(list_sum(list_transform(regexp_extract_all(log, '(\\d+) error in', 1), lambda x: cast(x as bigint))) as bigint) as errors from t")
def log_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").cast("string").alias("a"), F.count_if(F.col("event_type") == "error").cast("string").alias("b"))
    log = F.concat("a", F.lit(" failed, "), "a", F.lit(" failed, "), "b", F.lit(" error in 1s"))
    return e.select("user_id", tx.captured_sum(log, r"(\d+) failed").alias("failed"), tx.captured_sum(log, r"(\d+) error in").alias("errors"))


@query("select conv_id, turn, md5(replace(replace('Role: {role}' || chr(10) || '{text}', '{role}', coalesce(role, '')), '{text}', coalesce(text, ''))) as prompt_md5 from conversations")
def prompt_fill(spark, sf_dir):
    p = tx.fill_template(F.lit("Role: {role}\n{text}"), {"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(p).alias("prompt_md5"))


@query("with f as (select conv_id, role, '- ' || coalesce(role, '') || chr(10) || coalesce(text, '') as b, min(turn) as t from conversations group by 1, 2, 3) select conv_id, md5(string_agg(b, chr(10) order by t, b)) as prompt_md5 from f group by 1")
def format_context(spark, sf_dir):
    b = F.concat(F.lit("- "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("b")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", b).agg(F.min("turn").alias("t"))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("t", "b"))), lambda x: x["b"])
    return c.groupBy("conv_id").agg(F.md5(F.array_join(blocks, "\n")).alias("prompt_md5"))


@query("select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as snippet from documents where text is not null")
def snippet_by_range(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.snippet(F.col("text"), 2, 4).alias("snippet"))


@query("with l as (select doc_id, string_split(text, chr(10)) as ls from documents), x as (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from l) select doc_id, i as line_no, md5(array_to_string(ls[greatest(1, i - 3):i + 3], chr(10))) as snippet from x where contains(ls[i], 'icense')")
def line_context_grep(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").contains("icense")).select("doc_id", F.split("text", "\n").alias("ls"))
    hits = F.filter(F.transform("ls", lambda x, i: F.when(x.contains("icense"), i + 1)), lambda x: x.isNotNull())
    d = d.withColumn("line_no", F.explode(hits))
    a = F.greatest(F.lit(1), F.col("line_no") - 3)
    return d.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5(F.array_join(F.slice("ls", a, F.col("line_no") + 4 - a), "\n")).alias("snippet"))


@query("select distinct unnest(['src/' || (p_partkey % 50) || '.py', 'tests/' || (p_partkey % 20) || '.py']) as path from part")
def diff_files(spark, sf_dir):
    s = lambda k: F.pmod(F.col("p_partkey"), F.lit(k)).cast("string")
    patch = F.concat(F.lit("diff --git a/src/"), s(50), F.lit(".py b/src/"), s(50), F.lit(".py\n+x\ndiff --git a/tests/"), s(20), F.lit(".py b/tests/"), s(20), F.lit(".py\n-y\n"))
    return table(spark, sf_dir, "part").select(F.explode(tx.diff_files(patch)).alias("path")).distinct()


def _edges(spark, sf_dir):
    """Each part calls those of half and of a third of its number."""
    i = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(i.alias("src"), F.explode(F.array(F.floor(i / 2), F.floor(i / 3))).alias("dst"))
    return p.distinct()


def _roots(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("root"))


_EDGES = "e as (select distinct cast(i as varchar) as src, cast(unnest([i // 2, i // 3]) as varchar) as dst from (select p_partkey as i from part)), roots as (select p_partkey as root from part)"


def _unfold_sql(cycles: bool) -> str:
    again = "list_contains(t.path, e.dst) and t.depth + 1 < 5" if cycles else "false"
    return f"with recursive {_EDGES}, t as (select root, [cast(root as varchar)] as path, 0 as depth, cast(root as varchar) as name, false as truncated, false as recursive_ from roots union all select t.root, list_append(t.path, e.dst), t.depth + 1, e.dst, t.depth + 1 = 5, {again} from t join e on t.name = e.src where not t.truncated and not t.recursive_)"


@query(f"{_unfold_sql(True)} select root, depth, name, truncated, recursive_ as recursive, count(*) as n from t group by all")
def call_tree_unfold(spark, sf_dir):
    t = trees.unfold(_roots(spark, sf_dir), _edges(spark, sf_dir))
    return t.groupBy("root", "depth", "name", "truncated", "recursive").agg(F.count("*").alias("n"))


@query(f"{_unfold_sql(False)} select root, depth, count(*) as n from t group by 1, 2")
def call_tree_query_unfold(spark, sf_dir):
    return trees.unfold(_roots(spark, sf_dir), _edges(spark, sf_dir), stop_at_cycles=False).groupBy("root", "depth").agg(F.count("*").alias("n"))


def _weighted(spark, sf_dir, depth=trees.DEPTH):
    t = trees.unfold(_roots(spark, sf_dir), _edges(spark, sf_dir), depth)
    total = t.agg(F.count_distinct("root").alias("total"))
    d = trees.tree_df(t).withColumnRenamed("name", "k")
    j = t.join(d, t["name"] == d["k"], "left").crossJoin(F.broadcast(total))
    return j.withColumn("weight", trees.node_weight(F.coalesce("df", F.lit(0)), F.col("total"), F.col("name") == "7")).drop("k")


@query(f"{_unfold_sql(True)}, d as (select name, count(distinct root) as df from t where depth > 0 group by 1), n as (select count(distinct root) as n from t) select root, round(sum(case when t.name = '7' then 1.0 when coalesce(df, 0) = 0 or df >= n then 0.1 else greatest(0.1, 0.1 + 0.8 * log10(n / (df + 1.0)) / log10(n)) end), 6) as total from t left join d on d.name = t.name, n group by 1")
def subtree_weight(spark, sf_dir):
    return _weighted(spark, sf_dir).groupBy("root").agg(F.round(F.sum("weight"), 6).alias("total"))


@query("select c_custkey, r_name || '.' || n_name || '.' || c_name as full_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def qualified_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.concat_ws(".", "r_name", "n_name", F.regexp_replace("c_name", r"\.py$", "")).alias("full_name"))


@query(f"with recursive {_EDGES}, r as (select root, cast(root as varchar) as node from roots union select r.root, e.dst from r join e on e.src = r.node) select root, cast(node as bigint) as node from r")
def import_closure(spark, sf_dir):
    return trees.closure(_edges(spark, sf_dir), _roots(spark, sf_dir))


@query("select conv_id, count(*) as n_turns, md5(string_agg(coalesce(text, ''), '' order by turn)) as text_md5 from conversations group by 1")
def chat_fold(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    pieces = c.select(F.col("conv_id").alias("conv"), F.col("turn").alias("seq"), F.lit(0).alias("index"), none.alias("id"), none.alias("type"), F.col("role").alias("name"), none.alias("arguments"), F.coalesce("text", F.lit("")).alias("content"))
    n = c.groupBy(F.col("conv_id").alias("k")).agg(F.count("*").alias("n_turns"))
    return chat.fold(pieces).join(n, F.col("conv") == F.col("k")).select(F.col("conv").alias("conv_id"), "n_turns", F.md5("content").alias("text_md5"))


@query()
def tree_edit_similarity(spark, sf_dir):
    """Trees of depth 3 of each root and of the three next ones."""
    g = trees.gathered(_weighted(spark, sf_dir, 3))
    a, b = g.select(F.col("root").alias("root_a"), F.col("tree").alias("tree_a")), g.select(F.col("root").alias("root_b"), F.col("tree").alias("tree_b"))
    a = a.withColumn("next", F.explode(F.sequence(F.col("root_a") + 1, F.col("root_a") + 3)))
    return trees.similarities(a.join(b, F.col("next") == F.col("root_b")).drop("next"))


@query()
def blended_tree_semantic(spark, sf_dir):
    s = tree_edit_similarity(spark, sf_dir)
    s = bm25.min_max(s, "sim", "call_sim", "root_a")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("root_b"), (F.col("p_size") / 50.0).alias("sem"))
    return s.join(p, "root_b").select("root_a", "root_b", F.round(0.5 * F.col("sem") + 0.5 * F.col("call_sim"), 6).alias("score"))
