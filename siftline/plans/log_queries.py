"""Queries of run logs, included texts and similar messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import includes, messages, runlogs
from ..sources import documents, lines
from ..streaming import chat
from .registry import query, table

# A log for each user, in one of three dialects: an event is a line, by its type and value. Spark and DuckDB share the text.
_LINE = """case user_id % 3
  when 0 then case v when 0 then '____ test_' || event_type || ' ____' when 1 then '=== FAILURES ===' when 2 then '== short test summary info ==' when 3 then 'FAILED a.py::test_' || event_type
    when 4 then '2 failed, 3 passed' when 5 then event_type || ', 1 error in 3s' when 6 then 'ERROR b.py::' || event_type else event_type || ' at work' end
  when 1 then case v when 0 then 'FAIL: test_' || event_type when 1 then 'ERROR: ' || event_type when 2 then 'Ran 3 tests' when 3 then 'FAILED (failures=2, errors=1)' else event_type || ' at work' end
  else case v when 0 then '___ test_' || event_type when 1 then 'FAIL ' || event_type when 2 then '= tests finished: 4 passed, 2 failed, in 3 s =' when 3 then '= tests finished: with 1 exceptions =' when 4 then '___ other' else event_type || ' at work' end end"""
_DIALECT = "case user_id % 3 when 0 then 'pytest' when 1 then 'unittest' else 'finished' end"
_V = "cast(floor(value) as int) % 10"
_NUMBERED = f"select user_id, event_type, {_V} as v, row_number() over (partition by user_id order by ts, event_id) - 1 as line_no from events"
_LINES = f"""lines as (select user_id as run_id, line_no, {_LINE} as line, {_DIALECT} as dialect from ({_NUMBERED}) where event_type is not null and v is not null)"""


def _lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_type", f"{_V} as v", "row_number() over (partition by user_id order by ts, event_id) - 1 as line_no")
    return e.where("event_type is not null and v is not null").selectExpr("user_id as run_id", "cast(line_no as long) as line_no", f"{_LINE} as line", f"{_DIALECT} as dialect")


def _each(value) -> str:
    """value(dialect) of a line's own dialect in SQL."""
    return "case dialect " + " ".join(f"when '{n}' then {value(d)}" for n, d in runlogs.DIALECTS.items()) + " end"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SUM = lambda p: f"coalesce(list_sum(list_transform(regexp_extract_all(line, {_quoted(p)}, 1), lambda x: cast(x as bigint))), 0)"
_MARKS = f"""marks as (select *, {_each(lambda d: _SUM(d.failed))} as failed, {_each(lambda d: _SUM(d.errors))} as errors, {_each(lambda d: str(d.first_end))} as early,
  {_each(lambda d: f"regexp_matches(line, {_quoted(d.begins)})")} as b, {_each(lambda d: f"regexp_matches(line, {_quoted(d.ends)})")} as e,
  {_each(lambda d: f"regexp_extract(line, {_quoted(d.heading)}, 1)")} as about from lines),
ends as (select *, min(line_no) filter (where e) over (partition by run_id) as e0 from marks),
runs as (select run_id, cast(sum(failed) as bigint) as n_failed, cast(sum(errors) as bigint) as n_errors, any_value(early) as early, any_value(e0) as e0, max(line_no) filter (where e) as e1,
  max(line_no) filter (where b) as b1, max(line_no) filter (where b and line_no < e0) as b0, max(line_no) + 1 as n from ends group by 1),
spans as (select *, case when early and e0 is not null then b0 else b1 end as a, case when early then e0 else e1 end as z from runs),
outcome as (select run_id, n_failed, n_errors, case when n_errors > 0 then -1 when n_failed > 0 then 1 else 0 end as status,
  case when n_failed + n_errors > 0 then a end as first, case when n_failed + n_errors > 0 and a is not null then case when z > a then z else n end end as last from spans),
numbered as (select *, count(*) filter (where about <> '') over w as section, max(case when about <> '' then line_no end) over w as at from marks window w as (partition by run_id order by line_no rows unbounded preceding)),
told as (select x.run_id, x.line_no, x.line, x.section, h.about, x.line_no - x.at as "offset" from numbered x left join marks h on h.run_id = x.run_id and h.line_no = x.at)"""


@query(f"with {_LINES}, {_MARKS} select * from outcome")
def log_outcomes(spark, sf_dir):
    return runlogs.outcomes(_lines(spark, sf_dir))


@query(f"with {_LINES}, ids as (select run_id, unnest({_each(lambda d: f'regexp_extract_all(line, {_quoted(d.ids)}, 1)')}) as t from lines) select distinct run_id, trim(t) as test_id from ids where trim(t) <> ''")
def log_failed_tests(spark, sf_dir):
    return runlogs.failed_tests(_lines(spark, sf_dir))


@query(f"with {_LINES}, {_MARKS} select t.* from told t join outcome o on o.run_id = t.run_id and t.line_no >= o.first and t.line_no < o.last")
def log_reports(spark, sf_dir):
    return runlogs.reports(_lines(spark, sf_dir)).select("run_id", "line_no", "line", "section", "about", "offset")


# Parts include those of a third and a fifth of their key; some name the next one, which names them back, and some none.
_TEMPLATE = """p_name || ' [%{t' || (p_partkey // 3) || '}' || case when p_size % 3 = 0 then p_type else '%{t' || (p_partkey // 5) || '} ' || p_brand end || ']'
  || case p_partkey % 40 when 7 then '%{t' || (p_partkey + 1) || '}' when 8 then '%{t' || (p_partkey - 1) || '}' when 9 then '%{none}' else '' end"""


def _templates(spark, sf_dir, text: str):
    return table(spark, sf_dir, "part").where("p_partkey > 0").selectExpr("'t' || p_partkey as name", text.replace("//", "div") + " as text")


def _expanded_sql(text: str, mark: str, left: str) -> str:
    """Recursive SQL of the same texts: split is a mark's pattern, left how an open mark is put back."""
    return f"""with recursive t as (select 't' || p_partkey as name, {text} as text from part where p_partkey > 0),
cut as (select name, regexp_split_to_array(text, '{mark}') as l, regexp_extract_all(text, '{mark}', 1) as m from t),
parts as (select name, 2 * (i - 1) as place, l[i] as text, cast(null as varchar) as of_ from cut, unnest(range(1, len(l) + 1)) r(i) union all select name, 2 * i - 1, {left}, m[i] from cut, unnest(range(1, len(m) + 1)) r(i)),
rows as (select name as root, [place] as key, text, of_, [name] as trail from parts
  union all select r.root, list_append(r.key, p.place), p.text, p.of_, list_append(r.trail, r.of_) from rows r join parts p on p.name = r.of_ where not list_contains(r.trail, r.of_))
select t.name, md5(coalesce(string_agg(r.text, '' order by r.key), '')) as text_md5 from t left join (select * from rows where of_ is null or list_contains(trail, of_) or of_ not in (select name from t)) r on r.root = t.name group by 1"""


@query(_expanded_sql(_TEMPLATE, r"%\{(?:.*?)\}", "'%{' || m[i] || '}'").replace(r"regexp_extract_all(text, '%\{(?:.*?)\}', 1)", r"regexp_extract_all(text, '%\{(.*?)\}', 1)"))
def expanded_templates(spark, sf_dir):
    return includes.expanded(_templates(spark, sf_dir, _TEMPLATE)).select("name", F.md5("text").alias("text_md5"))


@query()
def similar_messages(spark, sf_dir):
    """Whether a line of a document resembles one of the document before it."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = lambda key: d.select(key.alias("key"), F.explode(F.split("text", "\n")).alias("text"))
    found = messages.similar_keys(lines(F.col("doc_id")), lines(F.col("doc_id") + 1))
    return d.select("doc_id").join(found, F.col("doc_id") == F.col("key"), "left").select("doc_id", F.col("key").isNotNull().alias("similar"))


@query("select conv_id, count(*) as n_turns, md5(string_agg(coalesce(text, ''), '' order by turn)) as text_md5 from conversations group by 1")
def chat_fold_stream(spark, sf_dir):
    """The turns of conversations as a stream of pieces, folded with state; the last turn of each carries the end mark. A stream
    reads folders or patterns, so the table, which may be one file, is named by a pattern."""
    c = table(spark, sf_dir, "conversations")
    ends = c.groupBy(F.col("conv_id").alias("e_id")).agg(F.max("turn").alias("end"), F.count("*").alias("n_turns"))
    none = F.lit(None).cast("string")
    s = spark.readStream.schema(c.schema).parquet(f"{sf_dir}/conversations.parque[t]").join(ends, F.col("conv_id") == F.col("e_id"))
    pieces = s.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("seq"), F.lit(0).alias("index"), none.alias("id"), none.alias("type"), F.col("role").alias("name"),
        none.alias("arguments"), F.coalesce("text", F.lit("")).alias("content"), (F.col("turn") == F.col("end")).alias("last"),
    )
    out = documents.scratch(spark)
    with chat.rocks_db(spark):
        chat.fold_stream(pieces).writeStream.format("parquet").option("path", out).option("checkpointLocation", documents.scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    folded = spark.read.schema(chat.FOLDED).parquet(out).select(F.col("conv").cast("long").alias("conv_id"), F.md5("content").alias("text_md5"))
    return folded.join(ends, F.col("conv_id") == F.col("e_id")).select("conv_id", "n_turns", "text_md5")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus <> 'P'")
def committed_lines(spark, sf_dir):
    """Two jobs that append to one folder of JSON lines, the second one twice."""
    lines.register(spark)
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), documents.scratch(spark)
    for status, job in (("F", "first"), ("O", "second"), ("O", "second")):
        o.where(F.col("o_orderstatus") == status).write.format("siftline_lines").mode("append").options(path=path, job=job).save()
    return spark.read.format("siftline_lines").schema(o.schema).option("path", path).load()
