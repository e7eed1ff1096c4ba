"""Tables of what source files define: classes, functions, variables, tests, imports. One parse a file."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFINITIONS = "path string, kind string, parent string, name string, start_line int, end_line int, code string, signature string"
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _lines(node: ast.AST) -> tuple[int, int]:
    first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
    return first, node.end_lineno


def class_signature(node: ast.ClassDef) -> str:
    """Header, docstring, assignments and the heads of methods."""
    out = [f"class {node.name}({', '.join(ast.unparse(b) for b in node.bases)}):" if node.bases else f"class {node.name}:"]
    doc = ast.get_docstring(node)
    if doc:
        out.append(f'    """{doc}"""')
    for n in node.body:
        if isinstance(n, FUNCTIONS):
            out += [f"    @{ast.unparse(d)}" for d in n.decorator_list]
            out.append(f"    {'async ' if isinstance(n, ast.AsyncFunctionDef) else ''}def {n.name}({ast.unparse(n.args)})")
        elif isinstance(n, (ast.Assign, ast.AnnAssign)) and "__doc__" not in (s := ast.unparse(n)):
            out.append(f"    {s}")
    return "\n".join(out)


def definitions(path: str, source: str) -> list[tuple]:
    """Rows of a file; none if it doesn't parse. Classes and functions at any depth with the class that holds them
    (class_function), functions of the module, functions within those (inner_function), and the module's variables."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines, rows = source.splitlines(), []

    def add(kind, parent, name, node, signature=None):
        a, b = _lines(node)
        rows.append((path, kind, parent, name, a, b, "\n".join(lines[a - 1 : b]), signature))

    def walk(node, parent, holder=None):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef):
                add("class", parent, n.name, n, class_signature(n))
                walk(n, n.name, n)
            elif isinstance(n, FUNCTIONS):
                kind = "function" if holder is None else ("class_function" if parent else "inner_function")
                add(kind, parent, n.name, n)
                walk(n, parent, n)
            else:
                if isinstance(node, ast.Module) and isinstance(n, (ast.Assign, ast.AnnAssign)):
                    for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                        if isinstance(t, ast.Name):
                            add("global_var", "", t.id, n)
                walk(n, parent, holder)

    walk(tree, "")
    return rows


CALLABLES = "path string, parent string, name string, start_line int, end_line int, is_test boolean, content string"


def callables(path: str, source: str) -> list[tuple]:
    """Functions of the module and methods of its classes, with their decorators; methods also with the decorators and the
    first line of their class. Tests: functions named test*, and methods with test in their name of classes that have Test
    in their own or in a base's name."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines = source.split("\n")
    text = lambda nodes: "".join("\n".join(lines[n.lineno - 1 : n.end_lineno]) + "\n" for n in nodes)
    whole = lambda f: text(f.decorator_list) + "\n".join(lines[f.lineno - 1 : f.end_lineno])
    rows = []
    for n in tree.body:
        if isinstance(n, FUNCTIONS):
            rows.append((path, "", n.name, *_lines(n), n.name.startswith("test"), whole(n)))
        elif isinstance(n, ast.ClassDef):
            of_tests = "Test" in n.name or any("Test" in b.id for b in n.bases if isinstance(b, ast.Name))
            head = text(n.decorator_list) + lines[n.lineno - 1] + "\n"
            rows += [(path, n.name, f.name, *_lines(f), of_tests and "test" in f.name, head + whole(f)) for f in n.body if isinstance(f, FUNCTIONS)]
    return rows


def imports(path: str, source: str) -> list[tuple]:
    """(path, module, name, alias): a row for each imported name; from-imports have both."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    rows = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            rows += [(path, a.name, None, a.asname) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            rows += [(path, "." * n.level + (n.module or ""), a.name, a.asname) for a in n.names]
    return rows


def calls(path: str, source: str) -> list[tuple]:
    """(path, src, prefix, dst): what the body of each function calls, by name; prefix: what stands before the last dot."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    rows = set()
    for f in ast.walk(tree):
        if isinstance(f, FUNCTIONS):
            for n in ast.walk(f):
                if isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
                    rows.add((path, f.name, "", n.func.id))
                elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute):
                    rows.add((path, f.name, ast.unparse(n.func.value), n.func.attr))
    return sorted(rows)


def references(path: str, source: str) -> list[tuple]:
    """(path, name, line): names that are read, as they stand or behind a dot."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    read = [(n.id if isinstance(n, ast.Name) else n.attr, n.lineno) for n in ast.walk(tree) if isinstance(n, (ast.Name, ast.Attribute)) and isinstance(n.ctx, ast.Load)]
    return sorted({(path, name, line) for name, line in read})


def _table(files: DataFrame, f, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for p, s in zip(frame["path"], frame["content"], strict=True) for r in f(p, s or "")], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def definition_table(files: DataFrame) -> DataFrame:
    return _table(files, definitions, DEFINITIONS)


def callable_table(files: DataFrame) -> DataFrame:
    return _table(files, callables, CALLABLES)


def test_table(files: DataFrame) -> DataFrame:
    """The tests among callable_table."""
    return callable_table(files).where("is_test")


def import_table(files: DataFrame) -> DataFrame:
    return _table(files, imports, "path string, module string, name string, alias string")


def call_table(files: DataFrame) -> DataFrame:
    return _table(files, calls, "path string, src string, prefix string, dst string")


def reference_edges(files: DataFrame) -> DataFrame:
    """(path, line, name, to_path, to_line): reads of a name that a class or function of any file bears, by name."""
    d = definition_table(files).where("kind <> 'global_var'").select("name", F.col("path").alias("to_path"), F.col("start_line").alias("to_line"))
    return _table(files, references, "path string, name string, line int").join(d, "name").select("path", "line", "name", "to_path", "to_line")
