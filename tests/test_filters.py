import pytest

from sourcelake.operators import filters

PATHS = "repo string, path string"


def kept(df):
    return sorted(r.path for r in df.collect())


def table(spark, *paths):
    return spark.createDataFrame([("r", p) for p in paths], PATHS)


def test_extension_is_case_sensitive(spark):
    df = table(spark, "a.py", "A.PY", "b.js", "c.tsx", ".py")
    assert kept(filters.filter_extension(df)) == [".py", "a.py"]
    assert kept(filters.filter_extension(df, filters.DEFAULT_EXTENSIONS)) == [".py", "a.py", "b.js", "c.tsx"]
    assert filters.parse_extensions(".py, .js,,") == [".py", ".js"]


def test_test_directories_go_and_test_files_stay(spark):
    df = table(spark, "tests/a.py", "x/Spec/b.py", "test_main.py", "x/__tests__/c.js", "contest/d.py", "test/e.py")
    assert kept(filters.filter_tests(df)) == ["contest/d.py", "test_main.py"]


def test_lock_files(spark):
    assert kept(filters.filter_filenames(table(spark, "a/poetry.lock", "Poetry.lock", "x.lock"))) == ["Poetry.lock", "x.lock"]


def test_count_source_files(spark):
    df = table(spark, "a.py", "dist/b.js", "x/build/c.ts", "d.ts", "e.tsx", "node_modules/f.js")
    assert filters.count_source_files(df).collect()[0].source_files == 2


@pytest.mark.parametrize("rules,paths,expected", [
    ("temp\n!keep.py", ["temp/keep.py", "x/keep.py", "x/temp", "temporary/a.py"], ["temporary/a.py", "x/keep.py"]),
    ("build/\n!build/keep.py", ["build/a.py", "build/keep.py", "x/build/b.py"], ["build/keep.py"]),
    ("/root.py\nsub/one.py", ["root.py", "x/root.py", "sub/one.py", "x/sub/one.py"], ["x/root.py", "x/sub/one.py"]),
    ("a/**/z.py", ["a/z.py", "a/b/z.py", "a/b/c/z.py", "x/a/z.py"], ["x/a/z.py"]),
    ("**/gen\nlogs/**", ["gen/a.py", "x/gen/b.py", "logs/a/b.py", "logs.py"], ["logs.py"]),
    ("*.t?\n[!ab]c.py\n[xy]1.py", ["q.ts", "q.tsx", "ac.py", "zc.py", "x1.py", "z1.py"], ["ac.py", "q.tsx", "z1.py"]),
    ("# note\n\n\\#hash.py\n\\!bang.py", ["#hash.py", "!bang.py", "note"], ["note"]),
    ("a+b(1).py\n[oops.py\nx^y", ["a+b(1).py", "aab(1).py", "[oops.py", "x^y", "xy"], ["aab(1).py", "xy"]),
    ("*.py\n!main.py", ["a.py", "main.py", "x/main.py"], ["main.py", "x/main.py"]),
    ("x/*\n!x/keep", ["x/a", "x/keep", "x/keep/b", "x/a/keep"], ["x/keep", "x/keep/b"]),
    ("", ["__pycache__/a.py", "a/.git/b", "a.pyc", ".env", ".envrc", "venv/x.py", "myvenv/x.py"], [".envrc", "myvenv/x.py"]),
])
def test_ignore_rules(spark, rules, paths, expected):
    parsed = filters.parse_ignore_rules(spark.createDataFrame([("r", rules)], "repo string, content string"))
    assert kept(filters.filter_ignored(table(spark, *paths), parsed)) == expected


def test_rules_belong_to_their_repository(spark):
    rules = filters.parse_ignore_rules(spark.createDataFrame([("r", "a.py")], "repo string, content string"))
    df = spark.createDataFrame([("r", "a.py"), ("s", "a.py"), ("s", "venv/a.py")], PATHS)
    assert [tuple(r) for r in filters.filter_ignored(df, rules).collect()] == [("s", "a.py")]
    assert kept(filters.filter_ignored(df)) == ["a.py", "a.py"]


def test_content_stays_where_it_is(spark):
    """Rules and ignored directories come to the files; the last matching rule wins within a merged run, too."""
    rows = [("r", p, "text", None) for p in ("a/x.py", "gen/y.py", "gen/keep.py", "keep/z.py", "b/keep.ts", "top.js")]
    files = spark.createDataFrame(rows + [("s", "gen/y.py", "text", None)], "repo string, path string, content string, mtime timestamp")
    ignore = spark.createDataFrame([("r", "gen/\nz*\n*.ts\n!keep.ts\n*.js\n")], "repo string, content string")
    kept = filters.select_files(files, rules=filters.parse_ignore_rules(ignore))
    assert sorted((r.repo, r.path) for r in kept.collect()) == [("r", "a/x.py"), ("r", "b/keep.ts"), ("s", "gen/y.py")]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_prompts_read_each_text_once(spark):
    from sourcelake.operators import structure, summaries

    files = spark.createDataFrame([("r", "a.py", "import x\n", None)], "repo string, path string, content string, mtime timestamp")
    plan = summaries.summary_prompt(structure.extract_structure(files, keep_content=True))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
