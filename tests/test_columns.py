import posixpath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v STRING").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("src/{old => new}/b.ts", "src/new/b.ts"),
        ("src/{old => }/b.ts", "src/b.ts"),
        ("a.txt => b.txt", "b.txt"),
        ("src/a.ts", "src/a.ts"),
    ],
)
def test_rename(spark, raw, expected):
    assert one(spark, raw, C.resolve_rename) == expected


def test_path_parts(spark):
    df = spark.createDataFrame([("a/b/Main.TS",), (".gitignore",), ("x/.env",)], "path STRING")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in C.path_parts("path").items()]).collect()]
    assert got == [(".ts", "Main.TS", "a/b", "a", 3), ("", ".gitignore", "", ".gitignore", 1), ("", ".env", "x", "x", 2)]


@pytest.mark.parametrize(
    "subject, style",
    [
        ("feat: add login", "conventional"),
        ("fix(core)!: y", "conventional"),
        ("PROJ-12 thing", "jira"),
        ("Closes #3", "github"),
        ("🎉 party", "emoji"),
        ("123 foo", "emoji"),
        ("just words", "free"),
    ],
)
def test_commit_style(spark, subject, style):
    assert one(spark, subject, C.commit_style) == style


@pytest.mark.parametrize(
    "path, style",
    [
        ("src/user-service.ts", "kebab"),
        ("a/user_service.py", "snake"),
        ("userService.js", "camel"),
        ("UserService.java", "pascal"),
        ("user.ts", None),
    ],
)
def test_naming(spark, path, style):
    assert one(spark, path, C.naming_style) == style


def test_test_location(spark):
    assert one(spark, "tests/a.test.ts", C.test_location) == "separate"
    assert one(spark, "src/a_test.go", C.test_location) == "colocated"
    assert one(spark, "src/FooTest.java", C.test_location) == "colocated"
    assert one(spark, "src/FooTest.java", lambda c: C.test_location(c, "convention")) is None
    assert one(spark, "src/a.ts", C.test_location) is None


def test_dependency_and_type_roles(spark):
    assert one(spark, "org:Spring-Boot-Starter-Web", C.dependency_group) == "web"
    assert one(spark, "left-pad", C.dependency_group) == "other"
    assert one(spark, "OrderConfiguration", C.type_role) == "Configuration"
    assert one(spark, "OrderService", C.type_role) == "Business service"
    assert one(spark, "Order", C.type_role) == ""


def test_grades(spark):
    df = spark.createDataFrame([(s,) for s in (80, 79, 65, 50, 35, 34)], "s INT")
    assert [r[0] for r in df.select(C.grade("s")).collect()] == ["A", "B", "B", "C", "D", "F"]
    assert [r[0] for r in df.select(C.grade("s", fv.HEALTH_CUTS)).collect()] == ["B", "C", "D", "F", "F", "F"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "..", ".", ""]), min_size=1, max_size=6), min_size=1, max_size=20))
def test_normalise_path(spark, parts):
    paths = ["/".join(p) for p in parts]
    df = spark.createDataFrame([(p,) for p in paths], "p STRING")
    once = [r[0] for r in df.select(C.normalise_path(F.col("p"))).collect()]
    expected = [posixpath.normpath("./" + p) for p in paths]
    assert once == ["" if e == "." else e for e in expected]
    again = spark.createDataFrame([(p,) for p in once], "p STRING").select(C.normalise_path(F.col("p")))
    assert [r[0] for r in again.collect()] == once
