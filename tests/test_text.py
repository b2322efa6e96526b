import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T


def machine(text):
    """The word rule, sign by sign."""
    out, word = [], ""

    def close():
        nonlocal word
        if len(word) > 1:
            out.append(word.lower())
        word = ""

    for i, c in enumerate(text):
        if not re.match(r"[A-Za-z0-9]", c):
            close()
            continue
        before = word[-1:]
        after = text[i + 1 : i + 2]
        if word and c.isupper() and (before.islower() or (re.match(r"[A-Z0-9]", before) and re.match(r"[a-z]", after))):
            close()
        word += c
    close()
    return out


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("handleLogin", ["handle", "login"]),
        ("MyComponent", ["my", "component"]),
        ("hash_password", ["hash", "password"]),
        ("a b c", []),
        ("", []),
        ("XMLParser", ["xml", "parser"]),
        ("user2Name", ["user2", "name"]),
        ("user2NAME", ["user2name"]),
        ("ABc", ["bc"]),
        ("aB", []),
    ],
)
def test_tokens(text, tokens):
    assert T.tokens_of(text) == tokens


@given(st.text(alphabet="abzABZ019_ -\u212a\u00e9", max_size=30))
@settings(max_examples=400, deadline=None)
def test_tokens_follow_the_machine(text):
    assert T.tokens_of(text) == machine(text)


def test_tokens_in_spark_equal_those_in_python(spark):
    texts = ["handleLogin", "XMLParser user2Name", "caf\u00e9Bar K\u212aey", "", "A1Bc_dEF"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokenize(F.col("t")).alias("x")).collect()
    assert all(r["x"] == T.tokens_of(r["t"]) for r in rows)


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("*.ts", "src/foo.ts", False),
        ("**/*.ts", "src/deep/nested/foo.ts", True),
        ("?.ts", "ab.ts", False),
        ("*.d.ts", "fooXdXts", False),
        ("**/test_*.py", "test_auth.py", False),
        ("**/test_*.py", "a/test_auth.py", True),
        ("a+b/*.ts", "a+b/c.ts", True),
    ],
)
def test_glob(glob, path, hit):
    assert bool(re.search(T.glob_regex(glob), path)) is hit


def test_columns(spark):
    df = spark.createDataFrame([("src/a/b.tsx", "x\ny\n"), ("main.go", "")], "path string, c string")
    rows = df.select(T.language(F.col("path")), T.ancestors(F.col("path")), T.line_count(F.col("c")), T.base_name(F.col("path")), T.directory(F.col("path"))).collect()
    assert [tuple(r) for r in rows] == [("tsx", ["src", "src/a"], 3, "b.tsx", "src/a"), ("go", [], 1, "main.go", "")]
    names = spark.createDataFrame([("a_b",), ("axb",), ("a!b",), ("A_B",)], "n string")
    assert {r[0] for r in names.where(T.name_matches(F.col("n"), "a_b")).collect()} == {"a_b", "A_B"}
    assert {r[0] for r in names.where(T.name_matches(F.col("n"), "a!*")).collect()} == {"a!b"}
    ages = spark.range(1).select(*[T.age_text(F.lit(0), F.lit(ms)) for ms in (59_000, 90_000, 7_200_000, 200_000_000)]).first()
    assert tuple(ages) == ("just now", "2m ago", "2h ago", "2d ago")
