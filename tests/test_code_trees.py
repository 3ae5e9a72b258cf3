import random

import pytest

from sourcelake import analyze
from sourcelake.operators import clustering, code_trees, trees
from tests.test_similarity import sequential

FILES = "repo string, path string, content string"


def nodes_of(spark, content, path="a.py"):
    rows = code_trees.code_tree_nodes(spark.createDataFrame([("r", path, content)], FILES)).collect()
    return sorted(rows, key=lambda r: r.node_id)


def drawn(rows):
    """Types as nested lists, by parent and child order."""
    kids = {}
    for r in sorted(rows, key=lambda r: r.child_ord):
        kids.setdefault(r.parent_id, []).append(r)
    walk = lambda r: (r.type, [walk(k) for k in kids.get(r.node_id, [])]) if r.node_id in kids else r.type
    return walk(kids[None][0])


def test_python_blocks(spark):
    text = '''"""Doc.
class Hidden: pass
"""
import os  # def no(): pass

def f(a, b=[1,
            2], c="if x:"):
    if a and \\
            b:
        return {k: v for k in a}

\t# only a comment
    else_ = 1
class C:
  def g(self): return 1
'''
    assert drawn(nodes_of(spark, text)) == ("module", [
        "line", "import",
        ("def", [("(", ["["]), ("if", ["and", ("return", [("{", ["for", "in"])])]), "line"]),
        ("class", [("def", ["(", "return"])]),
    ])


def test_script_blocks(spark):
    text = '''// function no() {}
import { a } from "./{";
export class A { m(x) { return `${x} if (`; } }
const f = async (x) => { if (x) { throw [x]; } };
'''
    assert drawn(nodes_of(spark, text, "a.ts")) == ("module", [
        "import", "{", "export", "class", ("{", ["(", ("{", ["return"])]),
        "const", "async", "(", ("{", ["if", "(", ("{", ["throw", "["])]),
    ])


def test_broken_and_empty_files(spark):
    assert drawn(nodes_of(spark, "")) == "module" and drawn(nodes_of(spark, None)) == "module"
    assert drawn(nodes_of(spark, ")) if (a\n    return [b\n")) == ("module", [("line", ["if", ("(", ["return", "["])])])
    assert nodes_of(spark, "x", "a.txt") == []
    assert code_trees.code_tree_nodes(spark.createDataFrame([], FILES)).count() == 0


def test_parents_as_a_stack_gives_them(spark):
    random.seed(4)
    widths = [random.choice([0, 1, 2, 4, 7, 8]) for _ in range(200)]
    text = "\n".join(" " * w + "x" for w in widths)
    want, stack = [], []
    for n, w in enumerate(widths, 1):
        while stack and stack[-1][0] >= w:
            stack.pop()
        want.append(stack[-1][1] if stack else 0)
        stack.append((w, n))
    rows = nodes_of(spark, text)
    assert [r.parent_id for r in rows[1:]] == want
    kids = {}
    for r in rows:
        kids.setdefault(r.parent_id, []).append(r.node_id)
    seen, todo = [], [0]
    while todo:  # a stack gives the last child first
        seen.append(todo.pop())
        todo.extend(kids.get(seen[-1], []))
    assert [r.node_id for r in sorted(rows, key=lambda r: r.visit_ord)] == seen


CONTROLLER = '''import {{ load }} from "./store";

export function run(key: string): string {{
  const found = load(key);
  return "{0}" + found;
}}
'''


def test_controllers_of_one_shape_are_a_cluster(spark):
    files = [
        ("r", "first.ts", CONTROLLER.format("one")), ("r", "second.ts", CONTROLLER.format("two") + "\n// end\n"),
        ("r", "store.ts", "export function load(k: string) { for (const x of []) { if (x) { return k; } } }\n"),
        ("r", "index.ts", 'import { run } from "./first";\nrun("x");\n'), ("other", "first.ts", CONTROLLER.format("one")),
    ]
    df = spark.createDataFrame(files, FILES)
    found = clustering.greedy_cluster(code_trees.tree_fingerprints(df), 0.85).collect()
    assert {(r.repo, r.representative, r.member) for r in found} == {("r", "first.ts", "first.ts"), ("r", "first.ts", "second.ts")}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_are_those_of_the_sequential_loop(spark, seed):
    random.seed(seed)
    forms = ["if a:\n    b()\n", "for x in y:\n    c([1])\n", "def f(x):\n    return {x}\n", "class C:\n  def m(self):\n    pass\n", "import os\n"]
    files = [("r", f"f{i:03d}.py", "".join(random.choices(forms, k=random.randint(1, 5)))) for i in range(60)]
    sets = code_trees.tree_fingerprints(spark.createDataFrame(files, FILES))
    want = sequential({("r", r.path): frozenset(r.hashes) for r in sets.collect()}, 0.85)
    found = clustering.greedy_cluster(sets, 0.85).collect()
    assert {(r.representative, r.member) for r in found} == {(first, p) for (_, first), members in want.items() for p in members}


def test_max_nodes_takes_the_first_visited(spark):
    df = spark.createDataFrame([("r", "a.py", "import a\n" * 3 + "if x:\n    f([1])\n")], FILES)
    few, all_ = (code_trees.tree_fingerprints(df, max_nodes=n).first().hashes for n in (2, None))
    assert len(few) == 2 and len(all_) == 6 and set(few) < set(all_)
    assert trees.subtree_hash(code_trees.code_tree_nodes(df)).count() == 8


def test_pipeline_clusters_by_trees_or_shapes(spark):
    rows = [("r", f"{n}.ts", CONTROLLER.format(n), None) for n in ("a", "b")] + [("r", "tests/c.ts", CONTROLLER.format("c"), None)]
    df = spark.createDataFrame(rows, FILES + ", mtime timestamp")
    for by in ("trees", "shapes"):
        assert {r.member for r in analyze(df, by=by).members.collect()} == {"a.ts", "b.ts"}
    with pytest.raises(ValueError):
        analyze(df, by="names")


def test_trees_need_no_windows_and_few_exchanges(spark):
    """One for the rows of a tree, one for its nodes, one for its distinct hashes; texts are read once."""
    df = spark.createDataFrame([("r", "a.py", "if x:\n    f([1])\n")], FILES)
    hashed = trees.fingerprint_set(trees.subtree_hash(code_trees.code_tree_nodes(df)))
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan and plan.count("Exchange hashpartitioning") == 3 and plan.count("Scan ExistingRDD") == 1


def test_rows_that_share_a_tree_and_odd_line_ends(spark):
    """Copies of a row have their tokens beside each other; a lone CR ends a line."""
    row = ("r", "a.py", "if x:\r    f(\r\n1)\n")
    once, twice = (code_trees.code_tree_nodes(spark.createDataFrame([row] * k, FILES)) for k in (1, 2))
    assert [r.type for r in once.orderBy("node_id").collect()] == ["module", "if", "line", "("]
    assert sorted((r.type, r.node_id, r.parent_id) for r in twice.collect()) == [
        ("(", 5, 4), ("(", 6, 4), ("if", 1, 0), ("if", 2, 0), ("line", 3, 2), ("line", 4, 2), ("module", 0, None), ("module", 0, None)
    ]
