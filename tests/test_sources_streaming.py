from datetime import datetime, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sourcelake import schemas
from sourcelake.operators.ordinals import ordinals
from sourcelake.operators.structure import extract_structure
from sourcelake.sources import files as source_files
from sourcelake.sources.files import pack_files, scan_files, scan_selected, write_trees
from sourcelake.streaming.incremental import incremental_summaries, read_batches, summarize_stream


def test_scan_tree(spark, tmp_path):
    tree = {
        "a.py": b"import x\r\ny = 1\rz\n", "pkg/__init__.py": b"", "pkg/_deep/m.ts": "// ü\n".encode(), "notes.txt": b"no",
        "pkg/bad.py": b"\xff\xfe", ".gitignore": b"gen/\n", "gen/g.py": b"1", ".git/x.py": b"1", "sp ace/q.js": b"1",
    }
    for name, data in tree.items():
        path = tmp_path / "one" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.py").write_text("b")
    files = scan_files(spark, {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")})
    got = {(r.repo, r.path): r for r in files.collect()}
    assert sorted(p for r, p in got if r == "one") == [
        "a.py", "gen/g.py", "pkg/__init__.py", "pkg/_deep/m.ts", "pkg/bad.py", "sp ace/q.js"]
    assert got["one", "a.py"].content == "import x\ny = 1\nz\n" and got["one", "pkg/bad.py"].content is None
    assert got["one", "pkg/_deep/m.ts"].content == "// ü\n" and got["two", "b.py"].content == "b"
    seconds = int((tmp_path / "two" / "b.py").stat().st_mtime)
    assert files.where("repo = 'two'").select(F.unix_seconds("mtime")).first()[0] == seconds
    kept = scan_selected(spark, {"one": str(tmp_path / "one")})
    assert sorted(r.path for r in kept.collect()) == [
        "a.py", "pkg/__init__.py", "pkg/_deep/m.ts", "pkg/bad.py", "sp ace/q.js"]


@pytest.mark.parametrize("target", [1 << 20, 7 << 20])
def test_packs_hold_their_bytes(spark, target):
    """No pack passes twice its target, unless it is one file; small files share packs."""
    sizes = [(i * 7919) % 200_000 for i in range(3000)] + [9 << 20, 30 << 20, 0, 0]
    rows = [("hot" if i % 3 else f"r{i % 7}", f"d{i % 11}/f{i}", size) for i, size in enumerate(sizes)]
    packed, packs = pack_files(spark.createDataFrame(rows, "repo string, path string, size bigint"), target)
    held = {}
    for r in packed.collect():
        held.setdefault(r.pack, []).append(r.size)
    assert sorted(sum(held.values(), [])) == sorted(sizes) and set(held) <= set(range(packs))
    cost = lambda pack: sum(pack) + len(pack) * source_files.OPEN_BYTES
    assert all(len(p) == 1 or cost(p) < 2 * target for p in held.values())
    large = sum(s + source_files.OPEN_BYTES > target for s in sizes)
    assert large >= 2 and packs <= cost(sizes) // target + 1 + large


def test_packs_of_nothing(spark):
    packed, packs = pack_files(spark.createDataFrame([], "repo string, path string, size bigint"))
    assert packs == 0 and packed.isEmpty()


def test_trees_written_and_read(spark, tmp_path):
    rows = [("a", "x/__init__.py", "é\r\n"), ("a", "_y.js", None), ("b b", "deep/er/.z.ts", "1"), ("b b", "no.txt", "2")]
    roots = write_trees(spark.createDataFrame(rows, "repo string, path string, content string"), str(tmp_path))
    got = {(r.repo, r.path): r.content for r in scan_files(spark, roots).collect()}
    assert got == {("a", "x/__init__.py"): "é\n", ("a", "_y.js"): "", ("b b", "deep/er/.z.ts"): "1"}
    with pytest.raises(Exception, match="outside its tree"):
        write_trees(spark.createDataFrame([("a", "../x.py", "")], "repo string, path string, content string"), str(tmp_path))


def versions(spark, path, *entries):
    rows = [("r", p, text, datetime(2024, 1, day, tzinfo=timezone.utc)) for p, text, day in entries]
    spark.createDataFrame(rows, schemas.FILES).write.mode("append").parquet(path)


@pytest.mark.parametrize("watermark", [None, ("mtime", "7 days")])
def test_incremental_runs(spark, tmp_path, watermark):
    source, cache, marks = (str(tmp_path / n) for n in ("in", "cache", "marks"))

    def run():
        stream = spark.readStream.schema(schemas.FILES).parquet(source)
        rows = summarize_stream(stream)
        if watermark:  # the event time has to be among the columns
            rows = extract_structure(stream).select(
                F.concat_ws("|", "repo", "path", F.unix_seconds("mtime").cast("string")).alias("key"),
                F.col("path").alias("summary"), "mtime")
        incremental_summaries(rows, cache, marks, watermark=watermark).awaitTermination()
        return [r.key for r in read_batches(spark, cache).collect()]

    versions(spark, source, ("a.py", "x", 1), ("a.py", "x", 1), ("b.py", "y", 1))
    assert len(run()) == 2
    versions(spark, source, ("a.py", "x", 1), ("a.py", "x2", 2), ("c.py", "z", 2))
    keys = run()
    assert len(keys) == len(set(keys)) == 4
    assert sorted(run()) == sorted(keys)


def test_ordinals_equal_a_window(spark, rows):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.md5(F.col("id").cast("string")).alias("o"))
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("bigint"))
    assert rows(ordinals(df, ["g"], ["o"], "n")) == rows(want)
