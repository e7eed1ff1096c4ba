"""Queries along structure trees: regions, nations, customers and their orders as one tree of four levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import generation, lemmas, structure, trees
from ..sources.documents import staged
from .registry import _TOK, _weighted, query, table


def _nodes(spark, sf_dir, names: tuple[str, str, str, str]):
    """node_id, parent_id, name of each level; names are SQL expressions."""
    level = lambda t, i, up, name: table(spark, sf_dir, t).selectExpr(f"{i} as node_id", f"{up} as parent_id", f"{name} as name")
    r, n, c, o = names
    rows = level("region", "'r' || r_regionkey", "cast(null as string)", r).unionByName(level("nation", "'n' || n_nationkey", "'r' || n_regionkey", n))
    return rows.unionByName(level("customer", "'c' || c_custkey", "'n' || c_nationkey", c)).unionByName(level("orders", "'o' || o_orderkey", "'c' || o_custkey", o))


def _sql(names: tuple[str, str, str, str]) -> str:
    """CTEs node and t(node_id, parent_id, name, path, key, ups) of the same tree, from the roots down."""
    r, n, c, o = names
    return f"""recursive node as (select 'r' || r_regionkey as node_id, cast(null as varchar) as parent_id, {r} as name from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, {n} from nation union all select 'c' || c_custkey, 'n' || c_nationkey, {c} from customer
  union all select 'o' || o_orderkey, 'c' || o_custkey, {o} from orders),
t as (select node_id, parent_id, name, [name] as path, [row(0, name, node_id)] as key, cast([] as varchar[]) as ups from node where parent_id is null
  union all select c.node_id, c.parent_id, c.name, list_append(t.path, c.name), list_append(t.key, row(0, c.name, c.node_id)), list_append(t.ups, t.node_id) from t join node c on c.parent_id = t.node_id)"""


_WHOLE = ("r_name", "n_name", "c_mktsegment", "o_orderpriority")
_LETTERS = ("upper(substr(r_name, 1, 1))", "upper(substr(n_name, 1, 1))", "upper(substr(c_mktsegment, 1, 1))", "substr(o_orderpriority, 3, 1)")


@query(
    f"with {_sql(_WHOLE)}, step as (select node_id, key from t union all select node_id, list_append(key, row(1, '', '')) from t),"
    " tour as (select node_id, row_number() over (order by key) - 1 as pos from step)"
    " select node_id, parent_id, any_value(len(path)) - 1 as depth, any_value(array_to_string(path, '.')) as full_name, min(pos) as enter, max(pos) as leave from t join tour using (node_id) group by 1, 2"
)
def structure_intervals(spark, sf_dir):
    tree = structure.full_name(structure.labelled(_nodes(spark, sf_dir, _WHOLE)))
    return tree.select("node_id", "parent_id", "depth", "full_name", "enter", "leave")


@query(
    f"with {_sql(_WHOLE)}, up as (select node_id, unnest(ups) as top_id from t)"
    " select top_id, count(*) as n_below, count(o_orderkey) as n_orders, round(sum(o_totalprice), 2) as total from up left join orders on node_id = 'o' || o_orderkey group by 1"
)
def structure_totals(spark, sf_dir):
    tree = structure.labelled(_nodes(spark, sf_dir, _WHOLE))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"), "o_orderkey", "o_totalprice")
    rows = structure.below(tree, tree).join(o, "node_id", "left")
    return rows.groupBy("top_id").agg(F.count("*").alias("n_below"), F.count("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    f"with {_sql(_WHOLE)}, up as (select node_id, unnest(ups) as top_id, unnest(range(len(ups), 0, -1)) as distance from t join orders on node_id = 'o' || o_orderkey where o_totalprice > 200000)"
    " select node_id, top_id, cast(distance as int) as distance from up"
)
def structure_ancestors(spark, sf_dir):
    tree = structure.labelled(_nodes(spark, sf_dir, _WHOLE))
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"))
    return structure.above(tree, tree.join(dear, "node_id", "left_semi"))


@query(f"with {_sql(_LETTERS)} select node_id, name from t where not list_contains(path[:-2], name)")
def structure_topmost(spark, sf_dir):
    return structure.topmost(structure.labelled(_nodes(spark, sf_dir, _LETTERS))).select("node_id", "name")


# Keywords and the project that is stripped from them: two parts that many nodes share, a nation's own, one that is no node,
# and full paths.
_KEYWORDS = [("seg || '.' || pri", "nat"), ("nat || '.' || seg", "nat"), ("'other.' || nat", "reg"), ("reg || '.' || seg || '.' || pri", "'none'"), ("nat || '.' || seg || '.' || pri", "'none'")]
_JOINED = "select r_name as reg, n_name as nat, c_mktsegment as seg, o_orderpriority as pri from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


@query(
    f"""with {_sql(_WHOLE)}, j as ({_JOINED}), k as ({" union ".join(f"select {k} as keyword, {p} as project from j" for k, p in _KEYWORDS)}),
p as (select distinct keyword, case when len(string_split(keyword, '.')) > 1 and string_split(keyword, '.')[1] = project then string_split(keyword, '.')[2:] else string_split(keyword, '.') end as parts from k),
seen as (select * from t where not list_contains(path[:-2], name)), m as (select name, count(*) as n from seen group by 1)
select distinct keyword, node_id from p join m on m.name = parts[-1] join seen on seen.name = m.name where n = 1 or path[-len(parts):] = parts"""
)
def dotted_lookup(spark, sf_dir):
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    j = j.selectExpr("r_name as reg", "n_name as nat", "c_mktsegment as seg", "o_orderpriority as pri").distinct()
    keywords = j.select(F.explode(F.array(*[F.struct(F.expr(k).alias("keyword"), F.expr(p).alias("project")) for k, p in _KEYWORDS])).alias("k")).select("k.*")
    return structure.dotted_matches(keywords, structure.labelled(_nodes(spark, sf_dir, _WHOLE))).distinct()


# The events of a user as the lines of a file, by their value: + and - are changes. Each 25 lines are an old hunk, with a gap
# of 100 old lines behind each second one.
_PATCH = """select user_id % 7 as patch, user_id as file, n // 25 as old_hunk, n % 25 as line_no,
  case cast(floor(value) as int) % 10 when 0 then '+' when 1 then '-' else ' ' end || event_type as line, n from
  (select user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events where event_type is not null and value is not null)"""
_STARTS = """select *, 1 + 100 * (old_hunk // 2) + coalesce(sum(case when line not like '+%' then 1 end) over (partition by patch, file order by n rows between unbounded preceding and 1 preceding), 0) as run,
  first_value(n) over (partition by patch, file, old_hunk order by line_no) as n0 from p"""


def _patch_lines(spark, sf_dir):
    """lines of generation.minimal_hunks; a hunk's first old line is what its first line would be counted as."""
    table(spark, sf_dir, "events").createOrReplaceTempView("siftline_events")
    sql = _PATCH.replace("//", "div").replace("from events", "from siftline_events")
    lines = spark.sql(f"with p as ({sql}), s as ({_STARTS.replace('//', 'div')}) select patch, file, old_hunk, line_no, line, first_value(run) over (partition by patch, file, old_hunk order by line_no) as pre_start from s")
    return lines.select("patch", "file", "old_hunk", F.col("pre_start").cast("long").alias("pre_start"), F.col("line_no").cast("long").alias("line_no"), "line")


@query(
    f"""with p as ({_PATCH}), s as ({_STARTS}), l as (select patch, file, old_hunk, line_no, line, n, first_value(run) over (partition by patch, file, old_hunk order by line_no) as pre_start, left(line, 1) as c from s),
k as (select *, max(line_no) filter (where c <> ' ') over (h rows unbounded preceding) as last, min(line_no) filter (where c <> ' ') over (h rows between current row and unbounded following) as next,
  pre_start + count(*) filter (where c <> '+') over (h rows between unbounded preceding and current row) - case when c <> '+' then 1 else 0 end as at_ from l window h as (partition by patch, file, old_hunk order by line_no)),
kept as (select *, case when c <> '+' then 1 else 0 end as old from k where line_no - last <= 1 or next - line_no <= 1),
b as (select *, case when lag(at_ + old) over f = at_ then 0 else 1 end as begins from kept window f as (partition by patch, file order by n)),
i as (select *, sum(begins) over (partition by patch, file order by n rows unbounded preceding) as hunk from b),
g as (select patch, file, hunk, min(at_) as pre_start, sum(old) as pre_len, count(*) filter (where c <> '-') as post_len, string_agg(line, chr(10) order by n) as body from i group by 1, 2, 3)
select patch, file, hunk, pre_start, pre_len, pre_start + coalesce(sum(post_len - pre_len) over (partition by patch, file order by hunk rows between unbounded preceding and 1 preceding), 0) as post_start, post_len, md5(body) as body_md5 from g"""
)
def minimal_patches(spark, sf_dir):
    h = generation.minimal_hunks(_patch_lines(spark, sf_dir))
    return h.select("patch", "file", "hunk", "pre_start", "pre_len", "post_start", "post_len", F.md5("body").alias("body_md5"))


_WORDS = f"w as (select unnest({_TOK.format('text')}) as token from documents)"
_FORMS = ", ".join(f"({i}, '{e}', '{to}')" for i, (e, to) in enumerate(lemmas.ENDINGS))
_LEMMA_MAP = f"""{_WORDS}, v as (select token as word, count(*) as n from w group by 1 having count(*) >= 2),
tries as (select word, left(word, length(word) - length(e)) || t as lemma, i from (select distinct token as word from w) x, (values {_FORMS}) r(i, e, t) where suffix(word, e) and not regexp_matches(word, '(ss|us)$')),
map as (select word, arg_min(lemma, i) as lemma from tries where length(lemma) > 2 and lemma in (select word from v) group by 1)"""


def _document_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(tx.identifier_tokens(F.col("text"))).alias("token"))


@query(f"with {_LEMMA_MAP} select * from map")
def noun_lemmas(spark, sf_dir):
    t = _document_tokens(spark, sf_dir)
    return lemmas.base_forms(t.select(F.col("token").alias("word")), lemmas.vocabulary(t))


@query(f"with {_LEMMA_MAP} select coalesce(lemma, token) as token, count(*) as n from w left join map on word = token group by 1")
def lemma_frequency(spark, sf_dir):
    t = _document_tokens(spark, sf_dir)
    return lemmas.lemmatised(t, noun_lemmas(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n"))


@query()
def most_similar_trees(spark, sf_dir):
    """Of the twelve next roots of each the two whose trees are most similar."""
    g = staged(trees.gathered(_weighted(spark, sf_dir, 3)))
    pairs = g.select(F.col("root").alias("root_a"), F.explode(F.sequence(F.col("root") + 1, F.col("root") + 12)).alias("root_b"))
    return trees.most_similar_of(pairs.join(g.select(F.col("root").alias("root_b")), "root_b", "left_semi"), g, 2)
