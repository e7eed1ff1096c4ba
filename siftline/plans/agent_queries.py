"""Registered queries: files as sources and sinks, lookups of an agent, projects, masks and forms of text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fuzzy
from ..functions import text as tx
from ..operators import agent, bm25, code, generation, lookup, outcomes, projects, trees
from ..sources import documents, tables
from .python_queries import _files
from .registry import _FEAT, _features, query, spread, table

# JSON, CSV, JSON lines, saved trees


@query("select r_name as key, count(*) as n, min(n_name) as first_name from nation join region on r_regionkey = n_regionkey group by 1")
def keyed_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = documents.scratch(spark)
    documents.write_keyed_json(n.groupBy("r_name").agg(F.collect_list("n_name").alias("names")), path, "r_name", "names")
    back = documents.read_keyed_json(spark, path, "array<string>")
    return back.select("key", F.size("value").cast("long").alias("n"), F.array_min("value").alias("first_name"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def json_rows(spark, sf_dir):
    n, path = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), documents.scratch(spark)
    n.write.json(path)
    kinds = dict(n.dtypes)
    return documents.read_lines(spark, path, ", ".join(f"{c} {kinds[c]}" for c in n.columns))


@query("select doc_id, md5(coalesce(text, '')) as text_md5, source from documents")
def csv_rows(spark, sf_dir):
    d, path = table(spark, sf_dir, "documents"), documents.scratch(spark)
    documents.write_csv(d.select("doc_id", F.base64(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text"), "source"), path)
    back = documents.read_csv(spark, path, "doc_id long, text string, source string")
    return back.select("doc_id", F.md5(F.coalesce(F.unbase64("text"), F.lit("").cast("binary"))).alias("text_md5"), "source")


@query("select o_orderstatus, count(*) as n from (select * from orders where o_orderstatus = 'F' union all select * from orders where o_orderstatus <> 'P') group by 1")
def jsonl_append(spark, sf_dir):
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), documents.scratch(spark)
    documents.append_lines(o.where("o_orderstatus = 'F'"), path)
    documents.append_lines(o.where("o_orderstatus <> 'P'"), path)
    return documents.read_lines(spark, path, "o_orderkey long, o_orderstatus string").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("select c_custkey as node, c_nationkey as parent from customer")
def saved_trees(spark, sf_dir):
    path = documents.scratch(spark)
    documents.save_trees(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("parent")), path)
    return documents.load_trees(spark, path)


@query("select p_partkey as root, 0 as depth, 'p' || p_partkey as name from part union all select p_partkey, 1, p_brand from part union all select p_partkey, 1, p_type from part union all select p_partkey, 2, 'leaf' from part")
def tree_from_json(spark, sf_dir):
    kids = F.array(F.struct(F.col("p_brand").alias("name"), F.array(F.struct(F.lit("leaf").alias("name"))).alias("children")), F.struct(F.col("p_type").alias("name"), F.array().cast("array<struct<name: string>>").alias("children")))
    tree = F.to_json(F.struct(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), kids.alias("children")))
    return trees.tree_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("root"), tree.alias("tree"))).drop("path")


# lookups


@query("select p_name as name, p_brand as file, b.p_partkey as node_id from (select distinct p_name, p_brand from part) a join (select p_partkey, p_name as name, p_brand || '/' || p_type as path from part) b on a.p_name = b.name and contains(b.path, a.p_brand)")
def nodes_by_name_and_file(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("path"))
    return lookup.nodes_in_files(p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("file")).distinct(), nodes)


@query("select c_custkey, c_name in (select 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') from orders where o_orderstatus = 'P') as same_name, c_nationkey in (select n_nationkey from nation where n_regionkey = 1) as same_file from customer")
def membership_flags(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("file"))
    names = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"), F.lit(None).cast("string").alias("file"))
    files = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lit(None).cast("string").alias("name"), F.col("n_nationkey").cast("string").alias("file"))
    return lookup.membership_flags(t, names.union(files)).drop("name", "file")


_WORD1 = "string_split(p_name, ' ')[1]"


@query(f"with defs as (select {_WORD1} as name, p_type || '/' || p_partkey as path from part), names as (select distinct unnest(string_split(p_name, ' ')) as name from part) select names.name, min(path) as path from names left join defs on defs.name = names.name group by 1")
def first_definition(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    defs = p.select(F.element_at(words, 1).alias("name"), F.concat_ws("/", "p_type", F.col("p_partkey").cast("string")).alias("path"))
    return lookup.first_definitions(p.select(F.explode(words).alias("name")), defs)


_TREE = "files as (select 'lib/' || replace(p_type, ' ', '_') || '/tests/part_' || p_partkey || case when p_partkey % 5 = 0 then '.txt' else '.py' end as path from part)"


def _paths(spark, sf_dir):
    end = F.when(F.col("p_partkey") % 5 == 0, ".txt").otherwise(".py")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("lib/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/tests/part_"), F.col("p_partkey").cast("string"), end).alias("path"))


@query(
    f"with {_TREE}, asked as (select unnest(['lib', 'nowhere', 'lib/ECONOMY/tests']) as folder), child as (select distinct folder, case when strpos(substr(path, length(folder) + 2), '/') > 0 then folder || '/' || split_part(substr(path, length(folder) + 2), '/', 1) || '/' else path end as entry from asked join files on starts_with(path, folder || '/'))"
    " select folder, coalesce((select string_agg(entry, chr(10) order by entry) from child c where c.folder = a.folder and (entry like '%.py' or entry like '%/')), 'Error: Path ' || folder || ' does not exist') as answer from asked a"
)
def agent_list_folder(spark, sf_dir):
    return agent.list_folders(spark.createDataFrame([("lib/",), ("nowhere",), ("lib/ECONOMY/tests",)], "folder string"), _paths(spark, sf_dir))


@query(f"with {_TREE} select 'lib/**/tests/' as test_dir, string_agg(distinct regexp_replace(path, '/[^/]*$', ''), chr(10) order by regexp_replace(path, '/[^/]*$', '')) as answer from files union all select 'lib/', string_agg(distinct 'lib/' || split_part(path, '/', 2), chr(10) order by 'lib/' || split_part(path, '/', 2)) from files")
def agent_list_root(spark, sf_dir):
    return agent.list_roots(spark.createDataFrame([("lib/**/tests/",), ("lib/",)], "test_dir string"), _paths(spark, sf_dir))


@query("select 'part_' || p_partkey || '.py' as file, 'TestPart' || p_partkey || '.test_size' as answer from part union all select 'none.py', 'Error: File none.py does not exist'")
def agent_list_definitions(spark, sf_dir):
    files = _files(spark, sf_dir)
    none = spark.createDataFrame([("none.py",)], "file string")
    return agent.list_definitions(files.select(F.col("path").alias("file")).union(none), code.callable_table(files), files)


_TEST = "'class TestPart' || p_partkey || '(Base):' || chr(10) || '    def test_size(self):' || chr(10) || '        assert self.size == LIMIT  # checked' || chr(10) || '        self.assertTrue(c())'"
_HELPER = "'def helper(x):' || chr(10) || '    return os.path.join(x)'"


@query(
    f"with p as (select p_partkey, 'part_' || p_partkey || '.py' as file from part) select file, 'TestPart' || p_partkey || '.test_size' as function, {_TEST} as answer from p union all select file, 'TestPart' || p_partkey || '::test_size', {_TEST} from p union all select file, 'helper', {_HELPER} from p"
    " union all select file, 'other', 'Error: Function other not found in ' || file from p union all select 'none.py', 'f', 'Error: File none.py does not exist'"
)
def agent_read_function(spark, sf_dir):
    files = _files(spark, sf_dir)
    name = F.regexp_replace(F.regexp_replace("path", "part_", "TestPart"), r"\.py$", "")
    asked = files.select(F.col("path").alias("file"), F.explode(F.array(F.concat(name, F.lit(".test_size")), F.concat(name, F.lit("::test_size")), F.lit("helper"), F.lit("other"))).alias("function"))
    return agent.read_function(asked.union(spark.createDataFrame([("none.py", "f")], "file string, function string")), code.callable_table(files), files)


@query(f"select 'b-' || p_partkey as instance_id, 'part_' || p_partkey || '.py' as file, 'TestPart' || p_partkey || '.test_size' as function, {_TEST} as content from part where p_partkey % 3 = 0 union all select 'b-' || p_partkey, 'part_' || p_partkey || '.py', 'gone', null from part where p_partkey % 3 = 0")
def related_tests(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("b-"), F.col("p_partkey").cast("string")).alias("instance_id"), F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % 3 == 0).alias("has"))
    one = lambda f: F.struct(F.concat(F.lit("part_"), "k", F.lit(".py")).alias("file"), f.alias("function"))
    related = p.where("has").select("instance_id", F.array(one(F.concat(F.lit("TestPart"), "k", F.lit(".test_size"))), one(F.lit("gone"))).alias("tests"))
    return lookup.related_tests(p, related, code.callable_table(_files(spark, sf_dir)))


@query("select 'part_' || p_partkey || '.py' as path, 'test_size' as src, 'self' as prefix, 'assertTrue' as dst from part union all select 'part_' || p_partkey || '.py', 'test_size', '', 'c' from part union all select 'part_' || p_partkey || '.py', 'helper', 'os.path', 'join' from part")
def call_prefixes(spark, sf_dir):
    return code.call_table(_files(spark, sf_dir))


@query("with r as (select p_partkey as k, p_size, unnest(list_distinct([p_partkey // 2, p_partkey // 3])) as d from part) select 'part_' || k || '.py' as path, 1 + r.p_size % 3 + 1 as line, 'f_' || d as name, 'part_' || d || '.py' as to_path, 1 + t.p_size % 3 as to_line from r join part t on t.p_partkey = d")
def reference_edges(spark, sf_dir):
    """Files whose functions call those of two others; a function stands behind as many comments as its part's size says."""
    f = table(spark, sf_dir, "part").selectExpr("concat('part_', p_partkey, '.py') as path", "concat(repeat('# sized\\n', p_size % 3), 'def f_', p_partkey, '():\\n    return f_', p_partkey div 2, '(f_', p_partkey div 3, ')\\n') as content")
    return code.reference_edges(f)


# projects and commands


_P12 = "['astropy/astropy', 'django/django', 'matplotlib/matplotlib', 'mwaskom/seaborn', 'pallets/flask', 'psf/requests', 'pydata/xarray', 'pylint-dev/pylint', 'pytest-dev/pytest', 'scikit-learn/scikit-learn', 'sphinx-doc/sphinx', 'sympy/sympy', 'else/where']"


def _repos(spark, sf_dir):
    names = F.array(*[F.lit(p[0]) for p in projects.PROJECTS], F.lit("else/where"))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 13 + 1).cast("int")).alias("repo"))


@query(
    f"with p as (select p_partkey, ({_P12})[p_partkey % 13 + 1] as repo from part), s as (select *, split_part(repo, '/', 2) as short from p) select p_partkey, repo,"
    " case short when 'matplotlib' then 'lib/matplotlib' when 'flask' then 'src/flask' when 'requests' then 'src/requests' when 'pytest' then 'src/_pytest' when 'scikit-learn' then 'sklearn' when 'where' then null else short end as source_dir,"
    " case short when 'astropy' then 'astropy/**/tests/' when 'matplotlib' then 'lib/**/tests/' when 'requests' then '' when 'xarray' then 'xarray/tests/' when 'pytest' then 'testing/' when 'scikit-learn' then 'sklearn/**/tests/' when 'sympy' then 'sympy/**/tests/' when 'where' then null else 'tests/' end as test_dir from s"
)
def project_lookup(spark, sf_dir):
    return projects.with_project(_repos(spark, sf_dir))


@query(
    f"with p as (select p_partkey, split_part(({_P12})[p_partkey % 13 + 1], '/', 2) as short, 'tests/t' || p_partkey || '.py' as f from part) select p_partkey, case short when 'seaborn' then 'pytest --no-header --show-capture=no --disable-warnings ' || f || '::A::test_x' when 'pytest' then 'pytest --disable-warnings --show-capture=no ' || f || '::A::test_x -v'"
    " when 'django' then './tests/runtests.py --settings=test_sqlite t' || p_partkey || '.A.test_x' when 'sympy' then 'PYTHONWARNINGS=''ignore::UserWarning,ignore::SyntaxWarning'' bin/test -C ' || f || ' -k A.test_x' when 'where' then null"
    " else 'python -m pytest --no-header --tb=short --show-capture=no --disable-warnings -p no:cacheprovider ' || f || '::A::test_x' end as command from p"
)
def run_commands(spark, sf_dir):
    test = F.concat(F.lit("tests/t"), F.col("p_partkey").cast("string"), F.lit(".py::A.test_x"))
    return _repos(spark, sf_dir).select("p_partkey", projects.run_command(F.col("repo"), test).alias("command"))


@query("select p_partkey, 'setup_a__' || p_size || '__' || (p_partkey % 4) as environment, 'a.b' || p_partkey as module, 'b' as project, case when p_partkey % 4 < 3 then 'coverage run -m run' || (p_partkey % 4) || ' t.py u.py' else 't.py u.py' end as command from part")
def spec_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key, version = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 4).cast("string")
    specs = p.select(
        "p_partkey", generation.environment_name(F.concat(F.lit("a/"), F.col("p_size").cast("string")), version).alias("environment"), generation.module_name(F.concat(F.lit("a/b"), key, F.lit(".py"))).alias("module"),
        tx.project_of(F.concat(F.lit("a__b-"), key)).alias("project"), F.lit("a").alias("repo"), version.alias("version"), F.array(F.lit("t.py"), F.lit("u.py")).alias("directives"),
    )
    matrix = spark.range(3).select(F.lit("a").alias("repo"), F.col("id").cast("string").alias("version"), F.concat(F.lit("run"), F.col("id").cast("string")).alias("test_cmd"))
    return generation.test_command(specs, matrix, coverage=True).select("p_partkey", "environment", "module", "project", "command")


# paths, logs, masks


@query(f"with {_TREE} select path, len(list_filter(regexp_split_to_array(lower(path), ' |_|/|\\.'), lambda w: w in ('test', 'tests', 'testing'))) > 0 as is_test, not (path like 'build%' or path like 'doc%') and not (path like 'test%' or path like 'unittest\\_%' escape '\\') as searched from (select path from files union all select substr(path, 5) from files union all select 'doc/' || path from files union all select 'tests/' || path from files)")
def path_predicates(spark, sf_dir):
    f = _paths(spark, sf_dir)
    c = F.col("path")
    every = f.union(f.select(F.substring("path", 5, 1000))).union(f.select(F.concat(F.lit("doc/"), c))).union(f.select(F.concat(F.lit("tests/"), c)))
    return every.select("path", tx.is_test(c).alias("is_test"), tx.is_searched(c).alias("searched"))


@query("with t as (select doc_id, coalesce(text, '') || case doc_id % 4 when 0 then chr(10) || 'ImportError: x' when 1 then chr(10) || 'no Attribute FAILED' when 2 then chr(10) || 'import y' else '' end as log from documents) select doc_id, len(list_filter(string_split(lower(log), chr(10)), lambda x: (contains(x, 'attribute') or contains(x, 'import')) and (contains(x, 'error') or contains(x, 'fail')))) > 0 as hit from t")
def import_errors(spark, sf_dir):
    more = F.element_at(F.array(*[F.lit(x) for x in ("\nImportError: x", "\nno Attribute FAILED", "\nimport y", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.mentions_import_error(F.concat(F.coalesce("text", F.lit("")), more)).alias("hit"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 'E [TEST_ID] in [TEST_NAME]' else 'E [TEST_ID] ([TEST_NAME]) at [TEST_PATH].py' end as masked from part")
def masked_ids(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    new = F.col("p_partkey") % 2 == 0
    failed = F.when(new, F.concat(F.lit("a/t"), k, F.lit(".py::test_"), k, F.lit(" - boom"))).otherwise(F.concat(F.lit("test_q"), k, F.lit(" (a.t"), k, F.lit(".Case)")))
    out = F.when(new, F.concat(F.lit("E a/t"), k, F.lit(".py in test_"), k)).otherwise(F.concat(F.lit("E a.t"), k, F.lit(".Case (test_q"), k, F.lit(") at a/t"), k, F.lit(".py")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.mask_ids(out, failed).alias("masked"))


@query("with d as (select doc_id, string_split(text, chr(10)) as l from documents where not contains(text, '```')) select doc_id, j as pos, 9 * j + 4 as start, 9 * j + 7 as \"end\", array_to_string(l[7 * j + 4 : 7 * j + 6], chr(10)) as content from (select doc_id, l, unnest(range(len(l) // 7 + 1)) as j from d) where 7 * j + 5 < len(l)")
def code_block_lines(spark, sf_dir):
    """Each third to fifth of seven lines of a document in fences of their own lines."""
    fence = lambda i, at, line, end: F.when(i % 7 == at, F.concat(F.lit("" if end else "```\n"), line, F.lit("\n```" if end else ""))).otherwise(line)
    lines = F.transform(F.split("text", "\n"), lambda line, i: fence(i, 5, fence(i, 3, line, False), True))
    d = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("```"))).select("doc_id", F.array_join(lines, "\n").alias("text"))
    return d.select("doc_id", F.posexplode(tx.code_blocks(F.col("text"))).alias("pos", "b")).select("doc_id", "pos", "b.*")


_CODE_MASK = """with p as (select d.doc_id, coalesce(d.text, '') as said, coalesce(c.text, '') as code from documents d left join documents c on c.doc_id = d.doc_id - 1),
q as (select doc_id, list_transform(string_split(said, chr(10)), lambda x: trim(x, {blanks})) as l,
  array_to_string(list_filter(list_transform(string_split(code, chr(10)), lambda x: trim(x, {blanks})), lambda x: x <> ''), ' ') as j from p),
m as (select doc_id, list_transform(l, lambda x: case when length(x) > 0 and len(list_filter(range(1, length(x) - cast(floor(length(x) * 0.8) as int) + 1), lambda i: contains(j, substr(x, i, cast(floor(length(x) * 0.8) as int) + 1)))) > 0 then '[CODE]' else x end) as l from q)
select doc_id, len(list_filter(l, lambda x: x = '[CODE]')) as n_masked, md5(array_to_string(l, chr(10))) as masked_md5 from m"""


@query(_CODE_MASK.replace("{blanks}", "' ' || chr(9) || chr(13) || chr(12) || chr(11)"))
def code_mask(spark, sf_dir):
    """Lines of each document that mostly stand in the one before it."""
    d = table(spark, sf_dir, "documents")
    code = d.select((F.col("doc_id") + 1).alias("c_id"), F.col("text").alias("code"))
    rows = d.join(code, F.col("doc_id") == F.col("c_id"), "left").select("doc_id", tx.mask_code(F.col("code"), F.coalesce("text", F.lit(""))).alias("l"))
    return rows.select("doc_id", F.size(F.filter("l", lambda x: x == "[CODE]")).alias("n_masked"), F.md5(F.array_join("l", "\n")).alias("masked_md5"))


@query("select conv_id, turn, case when turn % 2 = 0 then coalesce(text, '') else 'a' || coalesce(text, '') end as context from conversations where coalesce(text, '') not like '%<%code>%'")
def context_code(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(~F.coalesce("text", F.lit("")).like("%<%code>%"))
    t = F.coalesce("text", F.lit(""))
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x<code>old</code><code>"), t, F.lit("</code> y"))).otherwise(F.concat(F.lit("a"), t))
    return c.select("conv_id", "turn", tx.tagged_code(said).alias("context"))


@query("with x as (select doc_id, unnest(['AError: ' || doc_id, 'BWarning: w', 'E   Failed: f', 'Failed:']) as msg, unnest([0, 1, 2, 3]) as pos from documents) select * from x")
def output_errors(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    log = F.concat(F.lit("AError: "), k, F.lit("\nE   Failed: f\nBWarning: w\nAError: "), k, F.lit(" \nsome test: Failed\nE   Failed: f"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.output_error_lines(log)).alias("pos", "msg"))


@query("select doc_id, unnest([0, 1]) as pos, unnest(['ValueError: ' || doc_id, 'OtherError: x']) as msg from documents")
def report_messages(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    log = F.concat(F.lit('seen\n  File "a.py", line 3, in run\n    x = f()\nValueError: '), k, F.lit("\n\nOtherError: x\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", log.alias("log"), F.transform(fuzzy.report_traces(log), lambda t: t["message"]).alias("traced"))
    return d.select("doc_id", F.posexplode(tx.all_messages(F.col("traced"), tx.error_lines(F.col("log")))).alias("pos", "msg")).withColumn("msg", F.trim("msg"))


# forms of text


@query("select doc_id, 'red' || doc_id as plain, 'x = 1' || chr(10) || doc_id as fenced, case doc_id % 3 when 0 then '+d' || doc_id when 1 then '-e' || doc_id || chr(10) else 'raw' || doc_id end as diff, 'a b c' as cleaned, doc_id % 2 = 0 as has_code from documents")
def text_forms(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    answer = F.element_at(F.array(F.concat(F.lit("so <diff>+d"), k, F.lit("</diff>")), F.concat(F.lit("so ```patch\n-e"), k, F.lit("\n```")), F.concat(F.lit("raw"), k)), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.strip_ansi(F.concat(F.lit("\x1b[31mred"), k, F.lit("\x1b[0m"))).alias("plain"), tx.trim_fence(F.concat(F.lit("```python\nx = 1\n"), k, F.lit("\n```\n"))).alias("fenced"), tx.extract_diff(answer).alias("diff"),
        tx.clean_value(F.lit("[a...b]...[c]")).alias("cleaned"), tx.contains_code(F.concat(F.lit("if x:\n    y  = "), (F.col("doc_id") % 2).cast("string")), F.lit("y = 0")).alias("has_code"),
    )


@query("select doc_id, 'a' || doc_id || ',b' as items, 'numpy,pytest' as needs, case when doc_id % 2 = 0 then 'Boom' || doc_id else 'UnknownError' end as fallback, case when doc_id % 3 = 0 then 'Output too long, unable to parse' end as guard, 'TestA,test_' || doc_id as names from documents")
def text_lists(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    log = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x\nE   e: Boom"), k)).otherwise("x")
    long = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("x\n"), 1001)).otherwise("x")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(tx.string_list(F.concat(F.lit("['a"), k, F.lit("', \"b\"]  # c"))), ",").alias("items"), F.array_join(tx.requirement_lines(F.lit("# all\n-e .\nnumpy\n\npytest\n.[test]")), ",").alias("needs"), tx.fallback_error(log).alias("fallback"), tx.too_long_guard(long).alias("guard"),
        F.array_join(tx.test_names(F.concat(F.lit("class TestA(B):\n    def test_"), k, F.lit("(self): pass\n    def other(): pass"))), ",").alias("names"),
    )


# heads and outcomes


@query("select doc_id, n_chars, row_number() over (order by n_chars desc, doc_id) as rnk from documents qualify rnk <= 20")
def top_20(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20).withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))


@query("select user_id, event_id, value from events where value > 0")
def positive_scores(spark, sf_dir):
    return bm25.positive(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value")


@query("select o_custkey, arg_max(o_orderkey, o_totalprice) as best from orders group by 1")
def first_of_ranked(spark, sf_dir):
    ranked = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.reverse(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey")))).alias("ranked"))
    return ranked.select("o_custkey", F.element_at("ranked", 1)["o_orderkey"].alias("best"))


@query("with l as (select p_brand, p_partkey, p_size % 5 as added, p_size % 3 as removed from part) select p_partkey, cast(coalesce(sum(added - removed) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0) as bigint) as delta from l")
def hunk_deltas(spark, sf_dir):
    h = table(spark, sf_dir, "part").select(F.col("p_brand").alias("patch"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 5).alias("added"), (F.col("p_size") % 3).alias("removed"))
    return generation.running_delta(h).select(F.col("pos").alias("p_partkey"), "delta")


@query(f"with {_FEAT}, r as (select seed, bug, success, row_number() over (partition by seed, bug order by md5(seed || '-' || test)) as rnk from f, (select unnest(range(100)) as seed)), fs as (select seed, bug, coalesce(min(rnk) filter (where success), 100000) as fr, count(*) as num from r group by 1, 2) select cast(seed as int) as seed, n, cast(sum(case when fr <= n then fr - 1 else least(num, n) end) as bigint) as total from fs, (values (1), (3), (5)) t(n) group by 1, 2")
def random_wasted_effort(spark, sf_dir):
    first = outcomes.shuffled_first_success(spread(_features(spark, sf_dir).select("bug", "test", "success")), 100, "test")
    rows = first.withColumn("n", F.explode(F.array(*[F.lit(x) for x in (1, 3, 5)])))
    waste = F.when(F.col("first_rank") <= F.col("n"), F.col("first_rank") - 1).otherwise(F.least("num", "n"))
    return rows.groupBy("seed", "n").agg(F.sum(waste).alias("total"))


@query("select conv_id, case when conv_id % 3 = 0 then 'done' when conv_id % 3 = 1 then 'errors' else 'turns' end as outcome, case when conv_id % 3 = 0 then 2 when conv_id % 3 = 1 then 21 else 41 end as n from (select distinct conv_id from conversations)")
def agent_outcomes(spark, sf_dir):
    def provider(said):
        k = int(said[0].split()[-1]) % 3
        return ("ok", [] if k == 0 else [("look", "x" if k == 1 else "y")])

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv")).distinct().withColumn("prompt", F.concat(F.lit("ask "), F.col("conv").cast("string")))
    out = tables.converse(c, provider, lambda name, x: "Error: no" if x == "x" else "fine")
    return out.select(F.col("conv").alias("conv_id"), "outcome", F.size("transcript").alias("n"))


@query("select c_custkey as instance_id from customer")
def id_list(spark, sf_dir):
    path = documents.scratch(spark)
    table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("value")).write.text(path)
    return tables.read_ids(spark, path).select(F.col("instance_id").cast("long").alias("instance_id"))
