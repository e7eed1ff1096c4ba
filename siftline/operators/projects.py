"""Projects: where their sources and tests are, and how a test of theirs is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Repository, folder of sources, folder of tests (a pattern).
PROJECTS = [
    ("astropy/astropy", "astropy", "astropy/**/tests/"),
    ("django/django", "django", "tests/"),
    ("matplotlib/matplotlib", "lib/matplotlib", "lib/**/tests/"),
    ("mwaskom/seaborn", "seaborn", "tests/"),
    ("pallets/flask", "src/flask", "tests/"),
    ("psf/requests", "src/requests", ""),
    ("pydata/xarray", "xarray", "xarray/tests/"),
    ("pylint-dev/pylint", "pylint", "tests/"),
    ("pytest-dev/pytest", "src/_pytest", "testing/"),
    ("scikit-learn/scikit-learn", "sklearn", "sklearn/**/tests/"),
    ("sphinx-doc/sphinx", "sphinx", "tests/"),
    ("sympy/sympy", "sympy", "sympy/**/tests/"),
]

#: How a test is run, by the last part of the repository's name; all others as the last one.
COMMANDS = {
    "seaborn": "pytest --no-header --show-capture=no --disable-warnings {}",
    "pytest": "pytest --disable-warnings --show-capture=no {} -v",
    "django": "./tests/runtests.py --settings=test_sqlite {}",
    "sympy": "PYTHONWARNINGS='ignore::UserWarning,ignore::SyntaxWarning' bin/test -C {} -k {}",
    "": "python -m pytest --no-header --tb=short --show-capture=no --disable-warnings -p no:cacheprovider {}",
}


def project_table(spark: SparkSession) -> DataFrame:
    """(repo, source_dir, test_dir), a row a project."""
    return spark.createDataFrame(PROJECTS, "repo string, source_dir string, test_dir string")


def with_project(rows: DataFrame) -> DataFrame:
    """rows(repo) with source_dir and test_dir; null for unknown ones. The projects are a dozen rows."""
    return rows.join(F.broadcast(project_table(rows.sparkSession)), "repo", "left")


def run_command(repo: Column, test: Column) -> Column:
    """The shell command for a test `path::Class.name`; null for projects that aren't known."""
    short = F.element_at(F.split(repo, "/"), -1)
    parts = F.split(test, "::")
    last = F.replace(F.element_at(parts, -1), F.lit("."), F.lit("::"))
    pytest = F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last)), "::")
    django = F.regexp_replace(F.replace(F.replace(F.replace(test, F.lit(".py"), F.lit("")), F.lit("/"), F.lit(".")), F.lit("::"), F.lit(".")), r"^tests\.", "")
    put = lambda name, *values: F.format_string(COMMANDS[name].replace("{}", "%s"), *values)
    known = [p[0].split("/")[1] for p in PROJECTS]
    return (
        F.when(short == "seaborn", put("seaborn", pytest))
        .when(short == "pytest", put("pytest", pytest))
        .when(short == "django", put("django", django))
        .when(short == "sympy", put("sympy", F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))))
        .when(short.isin(known), put("", pytest))
    )
