"""The queries opN_<name> and pipeline of this subpackage, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression
from .bands import near_prices
from .chat import digests, format_windows
from .jaccard import linked_components
from .language import identify, train
from .lloyd import clusters
from .mixing import plan_mix
from .mixing_model import score
from .neighbours import nearest
from .packing import pack
from .quality import quality_rules
from .sharding import kd_shards
from .substrings import passages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.drop("cleaned")


ORACLES["op1_quality_rules"] = r"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
win as (select doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) as win
        from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select doc_id, win from win group by 1, 2 having count(*) > 1),
cov as (select doc_id, count(*) as n from (select distinct doc_id, i + o as p from (select doc_id, i from win join rep using (doc_id, win)),
        (values (0), (1), (2)) t(o)) group by 1),
ln as (select doc_id, source, text, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as p from d),
dup as (select doc_id, count(*) - count(distinct l) as n from ln where trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' group by 1),
nl as (select doc_id, source, text, p, l, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) as x from ln),
hosts as (select source, count(distinct text) as n from d group by 1),
bad as (select a.source, x from (select source, x, count(distinct text) as n from nl where x <> '' group by 1, 2) a
        join hosts h on a.source is not distinct from h.source where a.n > 10 and a.n > 0.1 * h.n),
gone as (select doc_id, count(*) as n, sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) as words
         from nl join bad on nl.x = bad.x and nl.source is not distinct from bad.source group by 1),
m as (select d.doc_id, cast(len(w.w) as bigint) as n_words, cast(length(array_to_string(w.w, '')) as bigint) as word_chars,
      cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
      cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, cast(len(w.w) - coalesce(gone.words, 0) as bigint) as words_left,
      cast(coalesce(gone.n, 0) as bigint) as n_lines_removed
      from d join w using (doc_id) left join dup using (doc_id) left join cov using (doc_id) left join gone using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and words_left >= 50 and words_left >= 0.3 * n_words as kept,
  words_left, n_lines_removed
from m
"""


@query
def op4_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    return digests(format_windows(rows.unionByName(more)))


ORACLES["op4_budgeted_windows"] = r"""
with src as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
tok as (select *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 as tokens,
  18 - 4 + length(role) + length(text) + len(regexp_extract_all(role, '[\\#<]')) + len(regexp_extract_all(text, '[\\#<]')) as chars from src),
pre as (select *, row_number() over w - 1 as seq, coalesce(sum(tokens) over (w rows between unbounded preceding and 1 preceding), 0) as at0
  from tok window w as (partition by conv_id order by turn nulls first, role, text)),
sys as (select conv_id, tokens as st, chars as sc from pre where seq = 0 and role = 'system'),
said as (select p.*, at0 - coalesce(st, 0) as pos, greatest(1, 2048 - 256 - coalesce(st, 0)) as room
  from pre p left join sys on p.conv_id is not distinct from sys.conv_id where not (seq = 0 and role = 'system')),
win as (select *, pos // room + (pos + tokens - 1) // room as win from said),
heads as (select conv_id, win, min(pos) as w_at from win group by 1, 2),
parts as (select conv_id, win, chars from win
  union all select h.conv_id, h.win, t.chars from heads h join win t on t.conv_id is not distinct from h.conv_id and t.pos + t.tokens <= h.w_at and t.pos >= h.w_at - 256
  union all select s.conv_id, coalesce(h.win, 0), sc from sys s left join heads h on h.conv_id is not distinct from s.conv_id),
sizes as (select conv_id, cast(sum(chars) as bigint) as formatted_chars, count(distinct win) as n_windows from parts group by 1),
said2 as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by seq)) as turns_sha256,
  coalesce(string_agg(text, '' order by seq) filter (where role = 'assistant'), '') as loss from pre group by 1)
select s.conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, n_windows
from said2 s join sizes z on s.conv_id is not distinct from z.conv_id
"""


@query
def op6_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan_mix(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position")


@query
def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


ORACLES["op5_signature_tree_join"] = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w)),
n as (select doc_id, count(*) as n from sh group by 1),
hit as (select a.doc_id as x, b.doc_id as y, count(*) as i from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select x, y from hit join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 80 * (a.n + b.n - i)),
reach as (select x as v, x as r from link union select link.y as v, reach.r from reach join link on link.x = reach.v)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(c.m, d.doc_id) as component_id
from documents d left join n using (doc_id) left join (select v, min(r) as m from reach group by 1) c on c.v = d.doc_id
"""


@query
def op3_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


@query
def op10_bidirectional_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = train(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


ORACLES["op8_vantage_trees"] = r"""
with v as (select vec_id, cast(embedding as double[]) as v from embeddings where embedding is not null and vec_id is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""


@query
def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    out = score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op11_plain_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds unrolled: c0 are the first centroids (one row a component), a<i> the assignments to c<i>."""
    sql = f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select cast(row_number() over (order by sha256('3:' || vec_id) nulls last, v) - 1 as int) as c, v as m from v qualify c < {k})"""
    for i in range(rounds + 1):
        sql += f""",
a{i} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d from (select r, c, cast(list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) as bigint) as d from v, c{i}) group by r)"""
        if i < rounds:
            sql += f""",
s{i} as (select c, i, cast(sum(x) as bigint) as s, count(*) as n from (select c, unnest(v) as x, unnest(range(1, 65)) as i from a{i} join v using (r)) group by 1, 2),
c{i + 1} as materialized (select o.c, coalesce(n.m, o.m) as m from c{i} o left join (select c, list((s - ((s % n) + n) % n) // n order by i) as m from s{i} group by 1) n using (c))"""
    return (
        sql
        + f"""
select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join v using (r) join c{rounds} using (c)
"""
    )


ORACLES["op11_plain_lloyd"] = _lloyd_sql()


@query
def op12_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_prices(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"))


ORACLES["op12_band_join"] = r"""
with raw as (select *, 2 * cast(floor(100 * amount + 0.5) as bigint) + quantity as a, 2 * quantity as b from sale_lines
  where sale_id is not null and item_id is not null and quantity is not null and amount is not null and quantity <> 0),
l as (select sale_id, line_no, item_id, (a - ((a % b) + b) % b) // b as u from raw),
i as (select row_number() over () as r, item_id, cast(floor(100 * price + 0.5) as bigint) as p from items),
byte as (select sale_id, line_no, item_id, cast(sale_id as varchar) || ',' || cast(line_no as varchar) || ',' || cast(item_id as varchar) as name from (select distinct sale_id, line_no, item_id from l)),
t as (select n, list_reduce(list_prepend(cast(n as bigint), range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c from range(256) t(n)),
tab as (select list(c order by n) as t from t),
crc as (select sale_id, line_no, item_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda j: cast(ascii(name[j]) as bigint))),
  lambda c, x: xor(tab.t[(xor(c, x) & 255) + 1], c >> 8))) as crc from byte, tab),
pairs as (select i.r, i.item_id, abs(l.u - p) as gap, l.u, l.sale_id, l.line_no, l.item_id as line_item_id, crc
  from i join l on l.u between p - greatest(10, 2 * p // 1000) and p + greatest(10, 2 * p // 1000) and l.item_id <> i.item_id join crc on crc.sale_id = l.sale_id and crc.line_no = l.line_no and crc.item_id = l.item_id),
ranked as (select *, row_number() over (partition by r order by gap, u, sale_id, line_no, line_item_id) as rank from pairs),
sums as (select r, count(*) as n_pairs, cast(sum(gap) as bigint) as gap_sum, cast(sum(crc) as bigint) as lines_crc from pairs group by r)
select i.item_id, cast(coalesce(rank, 0) as int) as rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0) as n_pairs, coalesce(gap_sum, 0) as gap_sum, coalesce(lines_crc, 0) as lines_crc
from i left join sums using (r) left join (select * from ranked where rank <= 5) k on k.r = i.r
"""


@query
def op13_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learns = compression.learns(F.col("doc_id"), 4, 2)
    model = compression.train(docs.where(learns), labels.withColumnRenamed("quality", "label"))
    out = compression.score(docs, model)
    return out.select("doc_id", (~learns).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "difference")
