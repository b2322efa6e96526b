"""Call trees grown by passes against a plain depth-first walk."""

import random

import pytest

from lodestone.operators.graph import call_tree, call_tree_rows


def walked(edges, names, root, depth):
    """Pre-order rows of the recursive walk: a symbol expands where it is met first."""
    out, seen = [], set()

    def visit(name, line, level):
        opens = name in names and name not in seen and level < depth
        out.append((level, name, line, opens))
        if opens:
            seen.add(name)
            for _, line_, callee in sorted(edges.get(name, ())):
                visit(callee, line_, level + 1)

    visit(root, None, 0)
    return out


@pytest.mark.parametrize("seed, depth", [(1, 2), (2, 4), (3, 5)])
def test_tree_is_the_walk(spark, seed, depth):
    rng = random.Random(seed)
    names = [f"f{k}" for k in range(9)]
    edges = {n: {(s, rng.randint(1, 50), rng.choice([*names, "print", "x.y"])) for s in range(rng.randint(0, 4))} for n in names}
    edges["f0"] |= {(9, 9, "f5"), (10, 10, "f0"), (11, 11, "f7")}
    files = spark.createDataFrame([(1, "a.ts")], "file_id long, path string")
    symbols = spark.createDataFrame([(k, 1, n, "function", k) for k, n in enumerate(names)], "symbol_id long, file_id long, name string, kind string, start_line int")
    rows = [(names.index(n), c, line, s) for n, calls in edges.items() for s, line, c in calls]
    calls = spark.createDataFrame(rows + rows[:3], "caller_symbol_id long, callee_name string, line int, seq int")
    got = [(r["depth"], r["name"], r["line"], r["expanded"]) for r in call_tree(calls, symbols, files, "F0", depth=depth)]
    assert got == walked(edges, set(names), "f0", depth)


def test_no_such_function(spark):
    symbols = spark.createDataFrame([(1, 1, "f", "class", 1)], "symbol_id long, file_id long, name string, kind string, start_line int")
    files = spark.createDataFrame([(1, "a.ts")], "file_id long, path string")
    calls = spark.createDataFrame([(1, "f", 1, 1)], "caller_symbol_id long, callee_name string, line int, seq int")
    assert call_tree_rows(calls, symbols, files, "f").count() == 0
