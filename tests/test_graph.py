import pytest
from pyspark.sql import functions as F

from sourcelake import schemas
from sourcelake.functions.paths import ancestors, extension, normalize, stem
from sourcelake.operators import graph, structure

STRUCT = "repo string, path string, language string, imports array<string>"


def make(spark, *files):
    lang = {"py": "python", "js": "javascript", "ts": "typescript"}
    return spark.createDataFrame(
        [("r", p, lang.get(p.rsplit(".", 1)[-1], "typescript"), list(i)) for p, i in files], STRUCT
    )


def targets(spark, files, path, **options):
    resolved = graph.resolve_imports(make(spark, *files), **options).where(F.col("path") == path)
    return [r.dst for r in resolved.orderBy("pos").collect()]


def test_python_candidates(spark):
    files = [("main.py", ["import m", "import pkg", "from a.b import c", "import x, m", "from .m import y", "import os", "import m"]),
             ("m.py", []), ("m/__init__.py", []), ("pkg/__init__.py", []), ("a/b.py", [])]
    assert targets(spark, files, "main.py") == ["m.py", "pkg/__init__.py", "a/b.py", None, None, None, "m.py"]


def test_script_candidates(spark):
    imports = ['import a from "./x";', 'import "./y.js";', "require:../lib", "require:./z.service", 'import {\n a\n} from "./x";',
               'import r from "react";', "require:..", "require:./d/../x", "require:./d", "require:../../up", "require:./w"]
    files = [("src/m.ts", imports), ("src/x.ts", []), ("src/x/index.js", []), ("src/y.ts", []), ("lib/index.js", []),
             ("src/z.service.ts", []), ("index.js", []), ("src/d/index.tsx", []), ("up.js", []), ("src/w.js", []), ("src/w.tsx", [])]
    assert targets(spark, files, "src/m.ts") == [
        "src/x.ts", None, "lib/index.js", None, None, None, None, "src/x.ts", "src/d/index.tsx", None, "src/w.tsx"]


def test_root_index_is_missed(spark):
    """``..`` from one level down folds to ``.``, which names no file."""
    files = [("a/m.js", ["require:../", "require:../index"]), ("index.js", [])]
    assert targets(spark, files, "a/m.js") == [None, "index.js"]


def test_relative_and_rooted_options(spark):
    files = [("p/q/m.py", ["from .n import x", "from ..o import y", "from . import z", "from ....far import f", "import lib"]),
             ("p/q/n.py", []), ("p/o.py", []), ("p/q/__init__.py", []), ("far.py", []), ("src/lib.py", [])]
    assert targets(spark, files, "p/q/m.py") == [None] * 5
    assert targets(spark, files, "p/q/m.py", resolve_relative=True, source_roots=["src"]) == [
        "p/q/n.py", "p/o.py", "p/q/__init__.py", None, "src/lib.py"]


def test_keys_equal_candidate_join(spark, rows):
    """Joining on names gives what trying every candidate in order gives."""
    files = make(spark, ("a/m.ts", ['import q from "./n";', "require:./o", "require:../top", "require:./n.js"]), ("a/n.tsx", []),
                 ("a/n.js", []), ("a/o/index.js", []), ("a/o/index.ts", []), ("top.jsx", []), ("m.py", ["import a.k", "import b"]),
                 ("a/k/__init__.py", []), ("b.py", []), ("b/__init__.py", []))
    tried = graph.import_candidates(graph.import_rows(files)).join(
        files.select("repo", F.col("path").alias("candidate")), ["repo", "candidate"])
    best = tried.groupBy("repo", "path", "pos").agg(F.min_by("candidate", "ord").alias("dst"))
    found = graph.resolve_imports(files).where("dst is not null")
    assert rows(best) == rows(found, "repo", "path", "pos", "dst") and best.count() == 6


def test_graph_views(spark):
    files = make(spark, ("a.py", ["import b", "import b", "import os"]), ("b.py", []), ("c.py", ["import sys"]))
    resolved = graph.resolve_imports(files, keep_empty=True)
    nodes = {r.path: (r.depends_on, r.external_imports) for r in graph.adjacency(resolved).collect()}
    assert nodes == {"a.py": (["b.py", "b.py"], ["import os"]), "b.py": ([], []), "c.py": ([], ["import sys"])}
    assert sorted(r.path for r in graph.leaf_nodes(graph.adjacency(resolved)).collect()) == ["b.py", "c.py"]
    assert graph.dependency_edges(resolved).count() == 2
    assert sorted(r.import_text for r in graph.external_imports(resolved).collect()) == ["import os", "import sys"]


def test_repositories_do_not_mix(spark):
    df = spark.createDataFrame([("r", "a.py", "python", ["import b"]), ("s", "b.py", "python", [])], STRUCT)
    assert [r.dst for r in graph.resolve_imports(df).collect()] == [None]


@pytest.mark.parametrize("raw,folded", [
    ("a/./b", "a/b"), ("a/../b", "b"), ("../a", "../a"), ("a/..", "."), ("a/../../b", "../b"), ("", "."), ("a//b/", "a/b"), ("../../x/..", "../.."),
])
def test_normalize(spark, raw, folded):
    assert spark.createDataFrame([(raw,)], "p string").select(normalize(F.col("p"))).first()[0] == folded


def test_path_parts(spark):
    df = spark.createDataFrame([("a/b.c/d.e.py",), (".env",), ("x.",), ("n",)], "p string")
    got = [tuple(r) for r in df.select(extension(F.col("p")), stem(F.col("p")), ancestors(F.col("p"))).collect()]
    assert got == [(".py", "d.e", ["a", "a/b.c"]), ("", ".env", []), (".", "x", []), ("", "n", [])]


def test_hot_module_is_split(spark):
    """A module that most files import: adaptive execution splits its partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        files = spark.range(20000).repartition(8).select(
            F.lit("r").alias("repo"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("path"),
            F.lit("python").alias("language"),
            F.array(F.lit("import f0"), F.concat(F.lit("import f"), F.col("id").cast("string"))).alias("imports"))
        resolved = graph.resolve_imports(files)
        edges = resolved.select(F.count("dst").alias("n"))
        assert edges.collect()[0].n == 40000
        resolved.write.format("noop").mode("overwrite").save()
        rows = resolved.collect()
        assert len(rows) == 40000
        assert "skew=true" in resolved._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sample_shapes(spark):
    """A small application whose five modules import one another."""
    texts = {
        "config.py": "DEBUG = True\n", "database.py": "from config import DEBUG\n\ndef connect(): pass\n",
        "models.py": "from database import connect\n\nclass User:\n    def to_dict(self): pass\n",
        "utils.py": "from config import DEBUG\n\ndef log(): pass\n",
        "main.py": "from utils import log\nfrom models import User\n\ndef main(): log()\n",
    }
    df = spark.createDataFrame([("app", p, t, None) for p, t in texts.items()], schemas.FILES)
    resolved = graph.resolve_imports(structure.extract_structure(df), keep_empty=True)
    assert sorted((r.src, r.dst) for r in graph.dependency_edges(resolved).collect()) == [
        ("database.py", "config.py"), ("main.py", "models.py"), ("main.py", "utils.py"), ("models.py", "database.py"), ("utils.py", "config.py")]
    assert [r.path for r in graph.leaf_nodes(graph.adjacency(resolved)).collect()] == ["config.py"]


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_statements_are_searched_once(spark):
    rows = graph.import_rows(make(spark, ("src/m.ts", ['import a from "./x";', "require: ", 'import b from " "', "import"]), ("m.py", ["import a"])))
    keys = graph.import_keys(rows)
    assert plan(keys).count(graph.ESM_SPECIFIER) == plan(keys).count(graph.FROM_IMPORT) == 1
    assert sorted((r.pos, r.kind, r.key) for r in keys.collect() if r.path == "src/m.ts") == [
        (0, "script", "src/x"), (1, "none", "src/m.ts"), (2, "none", "src/m.ts"), (3, "none", "src/m.ts")]


def test_module_keys_are_hashed_not_sorted(spark):
    paths = ["src/m.py", "m.py", "src/p/__init__.py", "src/q.py", "src/q/__init__.py", "x.tsx", "x/index.ts", "y.jsx", "y/index.js", "z/index.jsx", None]
    files = spark.createDataFrame([("r", p) for p in [*paths, "m.py"]] + [(None, "m.py")], "repo string, path string")
    keys = graph.module_keys(files, ["src"])
    assert "SortAggregate" not in plan(keys, "executedPlan")
    found = {(r.kind, r.key): r.target for r in keys.where("repo = 'r' and key is not null").collect()}
    assert {k: t for k, t in found.items() if k[0] != "file"} == {
        ("py", "src/m"): "src/m.py", ("py", "m"): "m.py", ("py", "src/p"): "src/p/__init__.py", ("py", "p"): "src/p/__init__.py",
        ("py", "src/q"): "src/q.py", ("py", "q"): "src/q.py", ("py", "src/q/__init__"): "src/q/__init__.py", ("py", "q/__init__"): "src/q/__init__.py",
        ("py", "src/p/__init__"): "src/p/__init__.py", ("py", "p/__init__"): "src/p/__init__.py",
        ("script", "x"): "x.tsx", ("script", "x/index"): "x/index.ts", ("script", "y"): "y.jsx", ("script", "y/index"): "y/index.js",
        ("script", "z"): "z/index.jsx", ("script", "z/index"): "z/index.jsx"}
    assert all(t == k for (kind, k), t in found.items() if kind == "file")


def test_hashes_change_no_join_or_group(spark):
    files = make(spark, ("m.py", ["import a", "import os"]), ("m.py", ["import a"]), ("a.py", [])).unionByName(
        spark.createDataFrame([(None, "a.py", "python", ["import a"]), (None, None, "python", [])], STRUCT))
    resolved = graph.resolve_imports(files, keep_empty=True)
    nodes = graph.adjacency(resolved)
    assert nodes.columns == ["repo", "path", "depends_on", "external_imports"]
    assert sorted(map(tuple, nodes.collect()), key=repr) == sorted([
        ("r", "m.py", ["a.py", "a.py"], ["import os"]), ("r", "a.py", [], []), (None, "a.py", [], ["import a"]), (None, None, [], [])], key=repr)
    assert "_hash" in plan(resolved).split("Join", 1)[1].split("\n", 1)[0]
