"""Source files rendered from the benchmark tables.

``code_files``: an order becomes a Python, TypeScript or JavaScript file that
imports one module per line item; a part becomes the modules imported.  Both
belong to repository ``key % 4``, so an import resolves iff the keys agree
modulo 4, which lets a relational query check every text operator.
``doc_files``: a document becomes a commented Python file of the repository
named by its language.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PY_ORDER = '''"""Order {k}.
import decoy_{k}
def decoy():
"""
# import commented
{imports}import os
{wide}

class Order{k}:
    """def hidden(): import hidden"""

    def total(self):
        text = "# not a comment"
        return text


async def load_{k}(key):
    # def commented(): pass
    return key
{extra}'''
PY_WIDE = "from tools import (  # several\n    first,\n    second,\n)\n"
PY_EXTRA = "\n\ndef extra_{k}():\n    import json\n    return json\n"
TS_ORDER = '''/* Order {k}
import decoy from "./decoy";
*/
// export function commented() {}
{imports}import fs from "fs";

export interface Line{k} { id: number }
export type Key{k} = string;
export enum Status{k} { Open, Closed }

export class Order{k} {
  total(): string { return "// not a comment"; }
}

export function load{k}(key: Key{k}): Key{k} {
  const note = `import hidden from "hidden";`;
  return key;
}
'''
JS_ORDER = '''"use strict";
{imports}const fs = require("fs");

class Order{k} {
  total() { return 0; }
}

function load{k}(key) {
  // require("commented")
  return key;
}

module.exports = { Order{k}, load{k} };
'''
PY_PART = "class Item:\n    def price(self):\n        return {k}\n"
TS_PART = "export class Item {\n  price(): number { return {k}; }\n}\n"
JS_PART = "class Item {\n  price() { return {k}; }\n}\n\nmodule.exports = { Item };\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash ``df`` over all cores if its files give fewer splits than there are
    cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _render(template: str, **values: Column) -> Column:
    """The template with its ``{name}`` fields filled in, put together in one step."""
    pieces = re.split("{(" + "|".join(values) + ")}", template)  # text and names in turn
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces) if i % 2 or x])


def _repo(key: Column) -> Column:
    return F.concat(F.lit("repo_"), (key % 4).cast("string"))


def _midnight(day: Column) -> Column:
    """Timestamp of a calendar day in UTC, whatever the session's zone."""
    return F.timestamp_seconds(F.unix_date(day.cast("date")).cast("bigint") * 86400)


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lists are made where the lines of an order meet: partial ones before the shuffle would be sorted there as well.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    keys = F.array_join(F.col("items")["l_partkey"].cast("array<string>"), "\n")  # "" without any
    lines = lines.select("l_orderkey", keys.alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    # The lines are about as many as the orders: never a side to broadcast.
    rows = orders.join(lines.hint("shuffle_hash"), orders.o_orderkey == lines.l_orderkey, "left")
    key = F.col("o_orderkey")
    k = key.cast("string")
    statement = lambda before, after: F.when(F.col("items") != "", F.concat(
        F.lit(before), F.replace("items", F.lit("\n"), F.lit(after + before)), F.lit(after)
    )).otherwise(F.lit(""))
    python = _render(
        PY_ORDER,
        imports=statement("from parts.part_", " import Item\n"),
        wide=F.when(key % 5 == 0, F.lit(PY_WIDE)).otherwise(F.lit("")),
        extra=F.when(key % 3 == 0, _render(PY_EXTRA, k=k)).otherwise(F.lit("")),
        k=k,
    )
    typescript = _render(TS_ORDER, imports=statement('import { Item } from "../parts/part_', '";\n'), k=k)
    javascript = _render(JS_ORDER, imports=statement('require("../parts/part_', '");\n'), k=k)
    which = key % 4
    # A filter on paths stays above the generated column: it is judged once a file, not on every line before the join.
    path = F.concat(F.lit("orders/order_"), k, order_suffix(key))
    return rows.select("*", F.explode_outer(F.array(path)).alias("path")).select(
        _repo(key).alias("repo"),
        "path",
        F.coalesce(  # never NULL, and known to be: no test of it is pushed below the rendering
            F.when(which == 1, typescript).when(which == 3, javascript).otherwise(python), F.lit("")
        ).alias("content"),
        _midnight(F.col("o_orderdate")).alias("mtime"),
    )


def order_suffix(key: Column) -> Column:
    return F.when(key % 4 == 1, F.lit(".ts")).when(key % 4 == 3, F.lit(".js")).otherwise(F.lit(".py"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a Python and a script module, plain or as a package; every
    16th key has both Python forms, to put candidate order to the test."""
    key = F.col("p_partkey")
    k = key.cast("string")
    base = F.concat(F.lit("parts/part_"), k)
    plain = key % 8 < 4
    entry = lambda suffix, template: F.struct(
        F.concat(base, F.lit(suffix)).alias("path"), _render(template, k=k).alias("content")
    )
    none = F.lit(None).cast("struct<path:string,content:string>")
    variants = F.array(
        F.when(plain, entry(".py", PY_PART)).otherwise(entry("/__init__.py", PY_PART)),
        F.when(key % 16 == 0, entry("/__init__.py", PY_PART)).otherwise(none),
        F.when(plain, entry(".ts", TS_PART)).otherwise(entry("/index.js", JS_PART)),
    )
    return (
        spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
        .select(_repo(key).alias("repo"), F.explode_outer(variants).alias("v"))
        .where(F.col("v").isNotNull())
        .select("repo", "v.path", F.coalesce("v.content", F.lit("")).alias("content"), F.timestamp_seconds(F.lit(946684800)).alias("mtime"))
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_files(spark, sf_dir).unionByName(part_files(spark, sf_dir))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document i imports document i/2, by two statement forms; every fifth none."""
    key = F.col("doc_id")
    target = F.floor(key / 2).cast("string")
    statement = (
        F.when(key % 5 == 0, F.lit(""))
        .when(key % 2 == 0, F.concat(F.lit("from docs.doc_"), target, F.lit(" import body\n")))
        .otherwise(F.concat(F.lit("import docs.doc_"), target, F.lit("\n")))
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return spread(documents, "doc_id").select(
        F.col("lang").alias("repo"),
        F.concat(F.lit("docs/doc_"), key.cast("string"), F.lit(".py")).alias("path"),
        F.coalesce(
            F.concat(statement, F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# "))), F.lit("")
        ).alias("content"),
        F.timestamp_seconds(F.lit(1577836800) + key).alias("mtime"),
    )


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' own texts, under the paths of :func:`doc_files`."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    path = F.concat(F.lit("docs/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return documents.select(F.col("lang").alias("repo"), path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


TREE_FOLDERS = ("_gen/", ".git/", "a/b/c/", "", ".cfg/d/")
TREE_SUFFIXES = (".py", ".ts", ".md", ".jsx")


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their language's tree, in folders of all kinds; one in
    four has a suffix that is not read, every third has lines that end as on Windows."""
    key = F.col("doc_id")
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    return documents.select(
        F.coalesce("lang", F.lit("none")).alias("repo"),
        F.concat(of(TREE_FOLDERS), F.lit("doc_"), key.cast("string"), of(TREE_SUFFIXES)).alias("path"),
        F.when(key % 3 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text).alias("content"),
    )


def scattered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, path)``: one path per order, in all the places selection rules
    care about."""
    key = F.col("o_orderkey")
    k, suffix, place = key.cast("string"), order_suffix(key), F.floor(key / 4) % 20
    name = F.concat(F.lit("order_"), k, suffix)
    shapes = {
        0: F.concat(F.lit("tests/"), name),
        1: F.concat(F.lit("node_modules/"), name),
        2: F.concat(F.lit("build/"), name),
        3: F.concat(F.lit("orders/order_"), k, F.upper(suffix)),
        4: F.concat(F.lit("orders/"), k, F.lit("/poetry.lock")),
        5: F.concat(F.lit("Spec/"), name),
        6: F.concat(F.lit("orders/test_"), name),
        7: F.concat(F.lit("temp/keep_"), k, suffix),
        8: F.concat(F.lit("x/keep_"), k, suffix),
        9: F.concat(F.lit("a/__pycache__/"), name),
        10: F.concat(F.lit("gen_"), (key % 2).cast("string"), F.lit("/"), name),
        11: F.concat(F.lit("dist/"), name),
        12: F.concat(F.lit("deep/a/b/out/"), name),
        13: F.concat(F.lit("orders/order_"), k, F.lit(".spec"), suffix),
        14: F.concat(F.lit("logs/"), name),
    }
    path = F.concat(F.lit("orders/"), name)
    for i, shape in shapes.items():
        path = F.when(place == i, shape).otherwise(path)
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return orders.select(_repo(key).alias("repo"), path.alias("path"))


def scattered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order files of :func:`code_files` at the places of :func:`scattered_paths`, and its part files."""
    key = lambda path: F.regexp_extract(path, r"(?:order_|keep_|orders/)(\d+)", 1)
    orders = order_files(spark, sf_dir).withColumn("k", key(F.col("path"))).drop("path")
    placed = scattered_paths(spark, sf_dir).select(key(F.col("path")).alias("k"), "path").join(orders, "k")
    return placed.select("repo", "path", "content", "mtime").unionByName(part_files(spark, sf_dir))


IGNORE_TEXT = "# generated\n\ntemp\nx/*\n!keep_*\ngen_0/\ndeep/**/out/\n*.spec.?s\n/logs/order_*[02468].*\n"


def ignore_files(paths: DataFrame) -> DataFrame:
    """A root ignore file per repository; ``repo_3`` has one more rule."""
    return paths.select("repo").distinct().select(
        "repo",
        F.concat(F.lit(IGNORE_TEXT), F.when(F.col("repo") == "repo_3", F.lit("/dist\n")).otherwise(F.lit(""))).alias("content"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions about language repositories; every fifth is
    about a repository that does not exist."""
    item = F.col("item_id")
    languages = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "absent")])
    return table(spark, sf_dir, "benchmark").select(
        F.element_at(languages, (item % 5 + 1).cast("int")).alias("repo"),
        (F.floor(item / 5) + 1).cast("int").alias("q_no"),
        F.col("text").alias("question"),
    )
