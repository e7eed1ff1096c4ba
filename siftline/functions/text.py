"""Text functions as column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of test names that carry no meaning, and the plural the lemmatiser folds.
DROPPED_TOKENS = ["", "test"]
LEMMAS = {"tests": "test"}

#: What volatile parts of a test's output become, in this order.
VOLATILE = [
    (r"0x[0-9a-fA-F]+", "[MEM_ADDR]"),
    (r"\.py:[0-9]+", ".py:[LINE_NUM]"),
    (r"line [0-9]+", "line [LINE_NUM]"),
    (r"in [0-9]+(\.[0-9]+)*s", "in [TIME]s"),
    (r"\^+", "^"),
    (r"-+", "-"),
    (r"_+", "_"),
    (r"=+", "="),
]

#: What an error line looks like, in the order in which kinds are collected.
ERROR_LINES = [r"(\w+Error: .+)", r"(\w+Exception: .+)", r"(\w+Warning: .+)"]
FAILED_LINES = [r"(?m)^(E\s*Failed: .+)", r"(?m)^(.+:\s*Failed)$"]

#: Path endings that hold no tests.
NON_TEST_EXTENSIONS = [".json", ".png", "csv", ".txt", ".md", ".jpg", ".jpeg", ".pkl", ".yml", ".yaml", ".toml"]


def identifier_tokens(name: Column, lemmas: dict[str, str] = LEMMAS) -> Column:
    """Lower-case parts of identifiers and words: camel case and non-alphanumerics split, `test` dropped."""
    s = F.replace(F.coalesce(name, F.lit("")), F.lit(".py"), F.lit(""))
    s = F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1_$2")
    s = F.regexp_replace(s, r"([A-Z])([A-Z][a-z])", "$1_$2")
    tokens = F.split(F.lower(s), r"[^a-z0-9]+")

    def lemma(t: Column) -> Column:
        out = t
        for word, to in lemmas.items():
            out = F.when(t == word, F.lit(to)).otherwise(out)
        return out

    return F.filter(F.transform(tokens, lambda t: lemma(t)), lambda t: ~t.isin(DROPPED_TOKENS))


def mask_volatile(text: Column) -> Column:
    for pattern, to in VOLATILE:
        text = F.regexp_replace(text, pattern, to)
    return text


def mask_code(code: Column, output: Column, limit: float = 0.8) -> Column:
    """Trimmed lines of output; [CODE] stands for those of which a stretch of more than `limit` of the line also stands in
    the code, its lines trimmed and joined by blanks. Null code masks nothing.

    The longest common stretch isn't needed, only whether one of the least length that is enough is there. All stretches of
    that length hold the middle of the line, so one search rules out most lines; the others are tried stretch by stretch.
    """
    blanks = F.lit(" \t\r\f\v")
    lines = lambda x: F.transform(F.split(x, "\n"), lambda v: F.btrim(v, blanks))
    joined = F.array_join(F.filter(lines(F.coalesce(code, F.lit(""))), lambda v: v != ""), " ")

    def one(line: Column, known: Column) -> Column:
        n = F.length(line)
        enough = F.floor(n * limit).cast("int") + 1
        middle = F.substr(line, n - enough + 1, 2 * enough - n)
        tries = F.exists(F.sequence(F.lit(1), n - enough + 1), lambda i: F.contains(known, F.substr(line, i, enough)))
        return F.when((n > 0) & F.contains(known, middle) & tries, "[CODE]").otherwise(line)

    # The joined code as a variable of a lambda: it is computed once a row.
    return F.get(F.transform(F.array(joined), lambda known: F.transform(lines(output), lambda line: one(line, known))), F.lit(0))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;]*m", "")


def error_lines(text: Column) -> Column:
    """Error, exception and warning lines in this order, trim-equal ones once."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ERROR_LINES]))
    return F.filter(found, lambda m, i: F.array_position(F.transform(found, lambda x: F.trim(x)), F.trim(m)) == i + 1)


def output_error_lines(text: Column) -> Column:
    """error_lines of a test's output, and its two forms of Failed; the second form becomes `Failed:`."""
    kinds = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in [*ERROR_LINES, FAILED_LINES[0]]]))
    first = F.filter(kinds, lambda m, i: F.array_position(F.transform(kinds, lambda x: F.trim(x)), F.trim(m)) == i + 1)
    seen = F.transform(first, lambda x: F.trim(x))
    last = F.filter(F.regexp_extract_all(text, F.lit(FAILED_LINES[1]), F.lit(1)), lambda m: ~F.array_contains(seen, F.trim(m)))
    return F.concat(first, F.transform(last, lambda m: F.lit("Failed:")))


def all_messages(traced: Column, lines: Column) -> Column:
    """Messages of stack traces, then error lines that equal none of them up to blanks at the ends."""
    seen = F.transform(traced, lambda x: F.trim(x))
    return F.concat(traced, F.filter(lines, lambda m: ~F.array_contains(seen, F.trim(m))))


def error_type(message: Column) -> Column:
    return F.substring_index(message, ":", 1)


def error_content(message: Column) -> Column:
    at = F.locate(":", message)
    return F.when(at > 0, F.substring(message, at + 1, F.length(message))).otherwise("")


def fallback_error(output: Column) -> Column:
    """Type of an output without error lines: what follows the last `: ` of a last line that starts with E."""
    last = F.element_at(F.split(output, "\n"), -1)
    return F.when(last.startswith("E"), F.element_at(F.split(last, ": "), -1)).otherwise("UnknownError")


def too_long_guard(output: Column, limit: int = 1000) -> Column:
    """The constant message of an output of more than `limit` lines, else null."""
    text = F.when(output.contains("RecursionError"), "RecursionError: maximum recursion depth exceeded").otherwise("Output too long, unable to parse")
    return F.when(F.size(F.split(output, "\n")) > limit, text)


FENCE = r"(?s)```(?:python)?(.*?)```"


def tagged(text: Column) -> Column:
    """What follows the last </think>, then the inside of the first result tag if there is one."""
    after = F.when(text.contains("<think>"), F.element_at(F.split(text, "</think>"), -1)).otherwise(text)
    return F.when(after.rlike(r"(?s)<result>.*?</result>"), F.trim(F.regexp_extract(after, r"(?s)<result>(.*?)</result>", 1))).otherwise(after)


def fenced_blocks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), lambda x: F.btrim(x, F.lit(" \n\t\r")))


def first_fence(text: Column) -> Column:
    return F.coalesce(F.try_element_at(fenced_blocks(text), F.lit(1)), text)


def last_fence(text: Column) -> Column:
    return F.coalesce(F.try_element_at(fenced_blocks(text), F.lit(-1)), text)


def trim_fence(text: Column) -> Column:
    """Without fences at the ends and the language name behind the first."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(python)?", ""), r"```\s*$", ""), F.lit(" \n\t\r"))


def string_list(text: Column) -> Column:
    """A list literal of strings, comments stripped and quotes in either form."""
    bare = F.replace(F.regexp_replace(text, r"#.*", ""), F.lit("'"), F.lit('"'))
    return F.from_json(bare, "array<string>")


def between(text: Column, first: str, last: str) -> Column:
    """Text between two markers, or empty."""
    a = F.instr(text, first)
    rest = F.substring(text, a + len(first), F.length(text))
    b = F.instr(rest, last)
    return F.when((a > 0) & (b > 0), F.substring(rest, F.lit(1), b - 1)).otherwise("")


def test_names(code: Column) -> Column:
    """Names of test classes and functions by their lines, up to the bracket."""
    lines = F.filter(F.split(code, "\n"), lambda x: (x.contains("class ") & x.contains("Test")) | x.contains("def test_"))
    return F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"(?:class|def)\s+([^(:]*)", 1)))


def captured_sum(text: Column, pattern: str) -> Column:
    """Sum of all numbers that the pattern's group captures."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def snippet(text: Column, start: int, end: int, numbered: bool = False) -> Column:
    """Lines start to end, counted from 1, ends included."""
    lines = F.slice(F.split(text, "\n"), start, end - start + 1)
    if numbered:
        lines = F.transform(lines, lambda x, i: F.concat((i + start).cast("string"), F.lit(" "), x))
    return F.array_join(lines, "\n")


def contains_code(text: Column, code: Column) -> Column:
    """Containment up to white space."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return flat(text).contains(flat(code))


def diff_files(patch: Column) -> Column:
    """Changed paths of a unified diff, both sides, each once."""
    sides = [F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/(\S+) b/(\S+)"), F.lit(i)) for i in (1, 2)]
    return F.array_distinct(F.flatten(F.array(*sides)))


def test_directives(patch: Column, dotted: bool = False) -> Column:
    """Test files that a patch touches; as modules, if dotted."""
    files = F.filter(F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/.* b/(.*)$"), F.lit(1))), lambda f: ~_any_ending(f))
    if not dotted:
        return files
    bare = lambda f: F.regexp_replace(F.regexp_replace(f, r"\.py$", ""), r"^tests/", "")
    return F.transform(files, lambda f: F.replace(bare(f), F.lit("/"), F.lit(".")))


def _any_ending(f: Column) -> Column:
    hit = F.lit(False)
    for e in NON_TEST_EXTENSIONS:
        hit = hit | f.endswith(e)
    return hit


def extract_diff(response: Column) -> Column:
    """A diff in a tag, in a fence, in another fence, or the text itself."""
    found = [F.regexp_extract(response, p, 1) for p in (r"(?s)<(?:diff|patch)>(.*?)</(?:diff|patch)>", r"(?s)```(?:diff|patch)\n(.*?)```", r"(?s)```\w*\n(.*?)```")]
    return F.coalesce(*[F.when(x != "", x) for x in found], response)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def string_to_bool(v: Column) -> Column:
    low = F.lower(v)
    wrong = F.raise_error(F.concat(F.lit("not a truth value: "), v)).cast("boolean")
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False).otherwise(wrong)


def clean_value(s: Column) -> Column:
    return F.replace(F.translate(s, "[]", ""), F.lit("..."), F.lit(" "))


def requirement_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: ~(F.trim(x).startswith("-e .") | F.trim(x).startswith("#") | F.trim(x).startswith(".[test") | (F.trim(x) == "")))


#: Words of a path or a name that make it one of tests.
TEST_WORDS = ["test", "tests", "testing"]

#: Begins of paths that hold no sources to search.
EXCLUDED_PREFIXES = [
    "build", "doc", "requests/packages", "tests/regrtest_data", "tests/input", "tests/functional", "tests/roots",
    "sphinx/templates/latex", "tests/test_runner_apps/tagged/", "django/conf/app_template/",
]


def is_test(name: Column) -> Column:
    """Whether any word of a path or a name is one of tests."""
    return F.arrays_overlap(F.split(F.lower(name), r" |_|/|\."), F.array(*[F.lit(w) for w in TEST_WORDS]))


def is_searched(path: Column, project: Column | None = None) -> Column:
    """Whether a path is one of sources to search: none of the excluded begins, and no tests, but for pytest's own."""
    out = F.lit(False)
    for e in EXCLUDED_PREFIXES:
        out = out | path.startswith(e)
    tests = path.startswith("test") | path.startswith("unittest_")
    return ~out & (~tests if project is None else ~tests | project.contains("pytest"))


def mentions_import_error(log: Column) -> Column:
    """Whether any line mentions attribute or import, and any such line error or fail."""
    lines = F.filter(F.split(F.lower(log), "\n"), lambda x: x.contains("attribute") | x.contains("import"))
    return F.exists(lines, lambda x: x.contains("error") | x.contains("fail"))


def mask_ids(output: Column, failed_id: Column) -> Column:
    """A test's output with its id, name and path as [TEST_ID], [TEST_NAME] and [TEST_PATH]; ids are `path::name ...` or
    `name (module.Class)`."""
    first = F.element_at(F.split(F.trim(failed_id), " "), 1)
    colons, dotted = F.split(first, "::"), F.element_at(F.split(F.element_at(F.split(F.trim(failed_id), r"\)"), 1), r"\("), -1)
    parts = F.split(dotted, r"\.")
    path = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    old = failed_id.contains("::")
    mask = lambda s, what, to: F.when(F.length(what) > 0, F.replace(s, what, F.lit(to))).otherwise(s)
    out = mask(output, F.when(old, F.element_at(colons, 1)).otherwise(dotted), "[TEST_ID]")
    out = mask(out, F.when(old, F.try_element_at(colons, F.lit(2))).otherwise(first), "[TEST_NAME]")
    return mask(out, F.when(~old, path), "[TEST_PATH]")


def code_blocks(text: Column) -> Column:
    """(start, end, content) of fenced blocks: lines from 0, from the line behind the opening fence, end exclusive; blocks in
    one line have none."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(```.*?```)"), F.lit(1))
    none = F.array().cast("array<struct<at: int, b: string>>")

    def placed(acc: Column, b: Column) -> Column:  # a block begins at the first fence behind the one before
        at = F.call_function("locate", b, text, acc["past"])
        return F.struct((at + F.length(b)).alias("past"), F.array_append(acc["out"], F.struct(at.alias("at"), b.alias("b"))).alias("out"))

    blocks = F.aggregate(found, F.struct(F.lit(1).alias("past"), none.alias("out")), placed)["out"]

    def block(x: Column) -> Column:
        inside = F.split(x["b"], "\n")
        start = F.size(F.split(F.substr(text, F.lit(1), x["at"] - 1), "\n"))
        return F.struct(start.alias("start"), (start + F.size(inside) - 2).alias("end"), F.array_join(F.slice(inside, 2, F.size(inside) - 2), "\n").alias("content"))

    return F.transform(F.filter(blocks, lambda x: x["b"].contains("\n")), block)


def tagged_code(text: Column) -> Column:
    """What the last <code> tag holds; the text itself, if there is none."""
    inside = F.element_at(F.split(F.element_at(F.split(text, "<code>"), -1), "</code>"), 1)
    return F.when(text.contains("<code>"), inside).otherwise(text)


def project_of(instance_id: Column) -> Column:
    """Project of an id `owner__project-123`."""
    return F.regexp_replace(F.element_at(F.split(instance_id, "__"), -1), r"-\d+$", "")
