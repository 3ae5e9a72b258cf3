"""Order files are judged and rendered once each."""

import datetime
import re

from pyspark.sql import functions as F

from sourcelake.operators import structure, summaries
from sourcelake.plans import corpus


def tables(spark, folder):
    day = datetime.date(2024, 1, 2)
    spark.createDataFrame([(0, day), (1, day), (3, None), (15, day), (15, day), (None, day)], "o_orderkey bigint, o_orderdate date").write.parquet(f"{folder}/orders.parquet")
    lines = [(15, 2, 7, 1), (15, 1, 9, 1), (15, 1, 9, 2), (1, 1, 4, 1), (None, 1, 1, 1), (8, 1, 1, 1), (3, None, None, 1)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_path_filters_stay_above_the_join(spark, tmp_path):
    readable, _ = structure.split_languages(corpus.order_files(spark, tables(spark, tmp_path)))
    below = optimized(readable).split("Join LeftOuter", 1)[1].split("\n", 1)[1]
    assert "orders/order_" not in below


def test_order_files(spark, tmp_path):
    rows = corpus.order_files(spark, tables(spark, tmp_path)).collect()
    texts = {r["path"]: r["content"] for r in rows}
    assert sorted((r["path"] or "", r["repo"] or "") for r in rows) == [
        ("", ""), ("orders/order_0.py", "repo_0"), ("orders/order_1.ts", "repo_1"),
        ("orders/order_15.js", "repo_3"), ("orders/order_15.js", "repo_3"), ("orders/order_3.js", "repo_3"),
    ]
    assert texts[None] == ""
    assert re.findall(r"part_\d+", texts["orders/order_15.js"]) == ["part_9", "part_9", "part_7"]
    assert texts["orders/order_0.py"] == corpus.PY_ORDER.replace("{imports}", "").replace("{wide}", corpus.PY_WIDE).replace("{extra}", corpus.PY_EXTRA).replace("{k}", "0")
    assert texts["orders/order_1.ts"] == corpus.TS_ORDER.replace("{imports}", 'import { Item } from "../parts/part_4";\n').replace("{k}", "1")


def by_pattern(path):
    if path and re.search(r"[^./][^/]*\.[^./]*\Z", path):
        for suffix, language in structure.LANGUAGES.items():
            if path.lower().endswith(suffix):
                return language
    return "unknown"


def test_language_without_patterns(spark):
    paths = [
        "a.py", "A.PY", ".py", "..py", "a..py", "x/.py", "x/...py", "x/a...ts", "x.d/.js", "x.py/y", "py", "x/py", "", None, "a.py\n", "\n.py",
        "a.tsx", "a.d.ts", "a.JsX", "a.b/c.js", "a.js.", "İ.py", "a.pİ", "ſ.tſ", "é.ts", "/.ts", ".a.ts", "a/.b.jsx", "...", "a b.ts", " .ts",
    ]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", structure.detect_language(F.col("path")).alias("l"))
    assert {r["path"]: r["l"] for r in df.collect()} == {p: by_pattern(p) for p in paths}
    assert "RLIKE" not in optimized(df)


def test_entries_are_stripped_once(spark):
    df = spark.createDataFrame([([" import a \n", "from x import y", "require:./p/q.js", 'import z from "./w.ts"', " "],)], "i array<string>")
    out = df.select(summaries.dependency_mentions(F.col("i")).alias("m"))
    assert out.first()["m"] == ["a", "q", "w"]
    assert optimized(out).count("\x0b") == 2  # the entry, and what follows "from"


def test_import_lines_are_put_together_without_lambdas(spark, tmp_path):
    files = corpus.order_files(spark, tables(spark, tmp_path))
    assert "transform(" not in optimized(files)
    texts = {r["path"]: r["content"] for r in files.collect()}
    assert texts["orders/order_3.js"].startswith('"use strict";\nconst fs')  # its only line names no part
    assert 'require("../parts/part_9");\nrequire("../parts/part_9");\nrequire("../parts/part_7");\nconst fs' in texts["orders/order_15.js"]
