import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sourcelake import schemas
from sourcelake.operators import structure, summaries
from sourcelake.sources.cache import append_cache, import_json_cache, read_cache, write_cache

SHAPE = "path string, classes array<string>, functions array<string>, imports array<string>"


@pytest.mark.parametrize("path,classes,functions,imports,expected", [
    ("a/x.py", ["A"], ["f", "g"], [], "Module x with 2 functions, 1 classes. Leaf dependency with no internal imports."),
    ("x.ts", [], ["h"], ['import { q } from "./util";'], 'Module x with 1 functions, 0 classes. Depends on: util";.'),
    ("x.js", [], [], ["require:./lib/a.js", "require:node:fs"], "Module x with 0 functions, 0 classes. Depends on: a, node:fs."),
    ("x.py", [], [], ["from a import b"], "Module x with 0 functions, 0 classes."),
    ("x.py", [], [], ["import a.b as c", "from q import r", "import z, y", "import fourth"], "Module x with 0 functions, 0 classes. Depends on: a.b, z,, fourth."),
    ("models.py", ["User", "B"], [], ["from d import e"], "Data models. Defines User and fetch_user for DB access."),
    ("models.py", [], [], ["from d import e"], "Data models. Defines entities and fetch_user for DB access."),
    ("d/utils.py", [], [], ["from d import e"], "Utility functions for logging and response formatting."),
    ("x.ts", [], [], ["import './side.css'"], "Module x with 0 functions, 0 classes. Depends on: side.css."),
])
def test_template(spark, path, classes, functions, imports, expected):
    df = spark.createDataFrame([(path, classes, functions, imports)], SHAPE)
    assert df.select(summaries.template_summary(*[F.col(c) for c in df.columns])).first()[0] == expected


def test_prompt(spark):
    files = spark.createDataFrame([("r", "a.py", "import x\nclass A: pass\n", None)], schemas.FILES)
    text = summaries.summary_prompt(structure.extract_structure(files, keep_content=True)).first().prompt
    assert text.startswith("Summarize this Python module for a codebase overview artifact.\n\nFile: a.py\n\nStructure:\n"
                           "Classes: ['A']\nFunctions: []\nImports: ['import x']\n\nSource code:\n```python\nimport x\nclass A: pass\n\n```\n")
    assert text.endswith("not implementation details.\n\nSummary:")


def test_quoted_like_python(spark):
    from sourcelake.functions.text import quoted_list

    items = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash", "line\nbreak\ttab"]
    assert spark.createDataFrame([(items,)], "a array<string>").select(quoted_list(F.col("a"))).first()[0] == repr(items)


def test_cache(spark, rows, tmp_path):
    when = datetime(2024, 1, 2, tzinfo=timezone.utc)
    files = spark.createDataFrame([("r", "a.py", "", when), ("r", "b.py", "", when), ("r", "c.py", "", None)], schemas.FILES)
    shape = structure.extract_structure(files)
    keys = {r.path: r.key for r in summaries.summarize(shape).collect()}
    assert keys["a.py"] == "r|a.py|1704153600|sourcelake-1" and keys["c.py"] == "r|c.py|0|sourcelake-1"
    cache = spark.createDataFrame([(keys["a.py"], "known"), (keys["b.py"], ""), ("old", "kept")], schemas.SUMMARY_CACHE)
    got = {r.path: r.summary for r in summaries.cached_summaries(shape, cache).collect()}
    assert got["a.py"] == "known" and got["b.py"].startswith("Module b") and got["c.py"].startswith("Module c")
    misses = dict(rows(summaries.cache_misses(cache, shape)))
    assert misses == {keys["b.py"]: got["b.py"], keys["c.py"]: got["c.py"]}
    path = write_cache(cache, str(tmp_path / "cache"))
    for _ in range(2):  # a second run adds nothing
        append_cache(spark, path, shape)
        assert read_cache(spark, path).count() == 5
        merged = dict(rows(summaries.cache_entries(read_cache(spark, path))))
        assert merged == {keys["a.py"]: "known", keys["b.py"]: got["b.py"], keys["c.py"]: got["c.py"], "old": "kept"}


def test_hits_are_not_computed(spark):
    plan = summaries.cached_summaries(
        spark.createDataFrame([], schemas.STRUCTURES), spark.createDataFrame([], schemas.SUMMARY_CACHE)
    )._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Module ") < plan.index("Join ")


def test_cache_files(spark, tmp_path, rows):
    assert read_cache(spark, str(tmp_path / "none")).count() == 0
    path = write_cache(spark.createDataFrame([("k", "v")], schemas.SUMMARY_CACHE), str(tmp_path / "v1"))
    assert rows(read_cache(spark, path)) == [("k", "v")]
    for name, text, want in [("good", json.dumps({"a": "1", "b": 2, "c": "ü"}, indent=2), [("a", "1"), ("c", "ü")]),
                             ("broken", '{"a": "1"', []), ("list", "[1]", []), ("text", '"x"', [])]:
        (tmp_path / f"{name}.json").write_text(text)
        assert rows(import_json_cache(spark, str(tmp_path / f"{name}.json"))) == want
    assert import_json_cache(spark, str(tmp_path / "missing.json")).count() == 0


def test_inject(spark, rows):
    modules = spark.createDataFrame([("r", "a", "old"), ("r", "b", "old")], "repo string, path string, summary string")
    new = spark.createDataFrame([("r", "a", "new"), ("r", "z", "new")], "repo string, path string, summary string")
    assert rows(summaries.inject_summaries(modules, new)) == [("r", "a", "new"), ("r", "b", "old")]
