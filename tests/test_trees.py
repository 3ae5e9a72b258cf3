import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sourcelake.operators import trees


def sha(text):
    return hashlib.sha1(text.encode()).hexdigest()


def shape(tree, node, depth):
    kind, kids = tree[node]
    if depth == 0:
        return sha(kind)
    return sha(kind + "(" + ",".join(shape(tree, k, depth - 1) for k in kids) + ")")


def random_tree(seed, n=60):
    rng = random.Random(seed)
    tree = {0: (rng.choice("abc"), [])}
    for i in range(1, n):
        tree[rng.randrange(i)][1].append(i)
        tree[i] = (rng.choice("abc"), [])
    return tree


def visits(tree, limit):
    """Last child first: the order a stack gives."""
    stack, out = [0], []
    while stack and len(out) < limit:
        node = stack.pop()
        out.append(node)
        stack.extend(tree[node][1])
    return out


def node_rows(name, tree):
    order = {n: i + 1 for i, n in enumerate(visits(tree, len(tree)))}
    parent = {k: (n, i) for n, (_, kids) in tree.items() for i, k in enumerate(kids)}
    return [(name, n, parent.get(n, (None, 0))[0], parent.get(n, (None, 0))[1], order[n], tree[n][0]) for n in tree]


NODES = "tree_id string, node_id bigint, parent_id bigint, child_ord int, visit_ord bigint, type string"


@pytest.mark.parametrize("depth,colocate", [(0, True), (1, True), (4, True), (4, False)])
def test_subtree_hash(spark, depth, colocate):
    forest = {f"t{i}": random_tree(i) for i in range(3)}
    df = spark.createDataFrame([r for name, t in forest.items() for r in node_rows(name, t)], NODES)
    got = {(r.tree_id, r.node_id): r.h for r in trees.subtree_hash(df, depth, colocate).collect()}
    assert got == {(name, n): shape(t, n, depth) for name, t in forest.items() for n in t}


def test_rounds_share_one_exchange(spark):
    df = spark.createDataFrame(node_rows("t", random_tree(1)), NODES)
    plan = trees.subtree_hash(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fingerprint_set_takes_the_first_visited(spark):
    tree = random_tree(5)
    df = trees.subtree_hash(spark.createDataFrame(node_rows("t", tree), NODES))
    got = {r.h for r in trees.fingerprint_set(df, max_nodes=20).collect()}
    assert got == {shape(tree, n, 4) for n in visits(tree, 20)}


def test_html_nodes(spark):
    html = ("<html><head><title>x</title><script>var a='<div>';</script></head><body><!-- <ul> --><div class=a><p>t<br>"
            "<ul><LI>1</LI><li>2</li></ul></div><div></div></body>")
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    nodes = {r.node_id: r for r in trees.html_tree_nodes(df, "page_id", "html").collect()}
    types = {n: r.type for n, r in nodes.items()}
    parents = [(types[n], types.get(r.parent_id)) for n, r in sorted(nodes.items())]
    assert parents == [("html", None), ("head", "html"), ("title", "head"), ("body", "html"), ("div", "body"), ("p", "div"),
                       ("br", "p"), ("ul", "p"), ("li", "ul"), ("li", "ul"), ("div", "body")]
    visited = [types[r.node_id] for r in sorted(nodes.values(), key=lambda r: r.visit_ord)]
    assert visited == ["html", "body", "div", "div", "p", "ul", "li", "li", "br", "head", "title"]
    assert [r.child_ord for r in sorted(nodes.values(), key=lambda r: r.node_id) if r.type == "li"] == [1, 2]


def test_hash_ignores_names_but_not_shape(spark):
    pages = [(1, "<div><a>x</a><ul></ul></div>"), (2, "<div class=q><a href=z>other</a><ul></ul></div>"), (3, "<div><ul></ul><a></a></div>")]
    df = trees.html_tree_nodes(spark.createDataFrame(pages, "page_id int, html string"), "page_id", "html")
    root = {r.tree_id: r.h for r in trees.subtree_hash(df).where(F.col("parent_id").isNull()).collect()}
    assert root["1"] == root["2"] != root["3"]


def test_hashes_beside_each_other_are_those_of_the_rounds(spark):
    """Also for ids and places that repeat, orphans, and nodes without a type or an id."""
    schema = "tree_id string, node_id bigint, parent_id bigint, child_ord int, visit_ord bigint, type string"
    rows = [
        ("a", 0, None, 1, 1, "x"), ("a", 1, 0, 1, 2, "y"), ("a", 2, 0, 1, 3, "z"), ("a", 3, 1, None, 4, "w"), ("a", 3, 1, None, 4, "w"),
        ("a", 4, 9, 1, 5, "orphan"), ("a", 5, 2, 1, 6, None), ("a", None, 2, 2, 7, "nameless"), ("a", 6, 3, 1, 8, "q"), (None, 0, None, 1, 1, "x"),
    ]
    df = spark.createDataFrame(rows, schema)
    for depth in (1, 2, 4):
        found = [sorted(map(tuple, trees.subtree_hash(df, depth, colocate=c).collect()), key=repr) for c in (True, False)]
        assert found[0] == found[1] and len(found[0]) == 8
