"""Source trees as a ``files`` table.

Spark's own file listing skips names that start with ``_`` or ``.``, which
would lose ``__init__.py`` and ``.gitignore``.  Directories are therefore
listed by tasks, one level of the tree per round, and contents are read by
tasks after the cheap name filters, through the Arrow file systems (local,
HDFS, object stores).  Files are dealt to the reading tasks by their sizes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelake.functions.text import newlines
from sourcelake.operators.filters import DEFAULT_EXTENSIONS, has_extension, root_ignore_rules, select_files
from sourcelake.session import materialize

_ENTRIES = "repo string, root string, path string, is_dir boolean, size bigint, seconds bigint"
READ_BYTES = 32 << 20  # text handed back to Spark at a time
OPEN_BYTES = 64 << 10  # what opening a file costs, in bytes read meanwhile
MOST_PACKS = 50_000  # reading tasks; beyond so many, each reads more


def _opened() -> Callable:
    """Root URIs to their file system and folder, each opened once a task."""
    from pyarrow import fs

    return cache(fs.FileSystem.from_uri)


def _list_children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    opened = _opened()
    for batch in batches:
        for row in batch.itertuples(index=False):
            system, base = opened(row.root)
            folder = f"{base.rstrip('/')}/{row.path}".rstrip("/")
            prefix = row.path + "/" if row.path else ""
            infos = system.get_file_info(fs.FileSelector(folder))
            yield pd.DataFrame(
                [
                    (row.repo, row.root, prefix + i.base_name, i.type == fs.FileType.Directory, i.size or 0,
                     (i.mtime_ns or 0) // 1_000_000_000)
                    for i in infos
                ],
                columns=["repo", "root", "path", "is_dir", "size", "seconds"],
            )


def list_trees(roots: DataFrame, skip_directories=(".git",)) -> DataFrame:
    """``(repo, root)`` -> every file below each root, with size and mtime.

    ``root`` is a URI.  A round lists all directories of one depth in parallel,
    so a repository of any width spreads over the cluster."""
    level = roots.select("repo", "root", F.lit("").alias("path"))
    found = None
    while True:
        tasks = roots.sparkSession.sparkContext.defaultParallelism
        entries = materialize(
            level.repartition(tasks, "repo", "path").mapInPandas(_list_children, _ENTRIES), "listing"
        )
        files = entries.where(~F.col("is_dir"))
        found = files if found is None else found.unionByName(files)
        level = entries.where("is_dir").select("repo", "root", "path").where(
            ~F.regexp_extract("path", "[^/]*$", 0).isin(*skip_directories)
        )
        if level.isEmpty():
            return found.drop("is_dir")


def pack_files(listing: DataFrame, target: int | None = None) -> tuple[DataFrame, int]:
    """``listing`` with the ``pack`` each file is read in, and how many packs there are.

    Small files in path order fill packs of ``target`` bytes, which a pack passes by
    less than one file; a file larger than that is a pack of its own.  ``target`` is
    what Spark's own readers take for a split unless given.  Positions are sums
    over range-partitioned slices, so no task sees all files."""
    spark = listing.sparkSession
    weight = F.col("size") + OPEN_BYTES
    ranged = materialize(
        listing.repartitionByRange("repo", "path").withColumn("_slice", F.spark_partition_id()), "ranged-listing"
    )
    whole = ranged.agg(F.sum(weight)).first()[0] or 0
    if target is None:
        most = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB"))
        target = max(OPEN_BYTES, min(most, whole // spark.sparkContext.defaultParallelism))
    target = max(target, whole // MOST_PACKS + 1)
    rows = ranged.withColumn("_small", F.when(weight <= target, weight).otherwise(0)).withColumn("_large", (weight > target).cast("bigint"))
    slices = rows.groupBy("_slice").agg(F.sum("_small").alias("_s"), F.sum("_large").alias("_l"))
    total = slices.agg(F.coalesce(F.sum("_s"), F.lit(0)), F.coalesce(F.sum("_l"), F.lit(0))).first()
    small_packs = -(-total[0] // target)
    # A row per slice, as many as shuffle partitions.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_slice", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_s", "_l")])
    before = Window.partitionBy("_slice").orderBy("repo", "path").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda own, offset: F.coalesce(F.sum(own).over(before), F.lit(0)) + F.col(offset)
    placed = rows.join(offsets, "_slice").withColumn("_at", at("_small", "_s")).withColumn("_nth", at("_large", "_l"))
    pack = F.when(F.col("_large") == 1, F.col("_nth") + small_packs).otherwise(F.floor(F.col("_at") / target))
    return placed.select(*listing.columns, pack.cast("int").alias("pack")), int(small_packs + total[1])


def _read_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    opened = _opened()
    for batch in batches:
        done, held = [], 0
        for row in batch.itertuples(index=False):
            system, base = opened(row.root)
            with system.open_input_stream(f"{base.rstrip('/')}/{row.path}") as stream:
                data = stream.read()
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                text = None
            done.append((row.repo, row.path, text, row.seconds))
            held += len(data)
            if held >= READ_BYTES:
                yield pd.DataFrame(done, columns=["repo", "path", "content", "seconds"])
                done, held = [], 0
        yield pd.DataFrame(done, columns=["repo", "path", "content", "seconds"])


def read_files(listing: DataFrame) -> DataFrame:
    """``files`` rows of listed files, newlines normalised.

    A task reads a pack of :func:`pack_files`.  Text that is not UTF-8 becomes NULL
    content, which ``split_languages`` sets aside."""
    packed, packs = pack_files(listing)
    rows = packed.repartitionById(max(1, packs), "pack").mapInPandas(
        _read_contents, "repo string, path string, content string, seconds bigint"
    )
    return rows.select(
        "repo", "path", newlines(F.col("content")).alias("content"), F.timestamp_seconds("seconds").alias("mtime")
    )


def _write_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    opened = _opened()
    for batch in batches:
        for row in batch.itertuples(index=False):
            system, base = opened(row.root)
            if row.path.startswith("/") or ".." in row.path.split("/"):
                raise ValueError(f"path outside its tree: {row.path}")
            name = f"{base.rstrip('/')}/{row.path}"
            system.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(name) as stream:
                stream.write((row.content or "").encode())
        yield batch[["repo", "root"]].drop_duplicates()


def write_trees(files: DataFrame, base: str) -> DataFrame:
    """Write ``files`` (``repo, path, content``) below ``base/<repo>``, and give
    the ``(repo, root)`` table that :func:`scan_files` takes.

    Tasks write the files they hold; one that runs again writes the same."""
    root = F.concat(F.lit(_uri(base).rstrip("/") + "/"), F.replace(F.url_encode("repo"), F.lit("+"), F.lit("%20")))
    rows = files.select("repo", root.alias("root"), "path", "content")
    return materialize(rows.mapInPandas(_write_contents, "repo string, root string"), "written").distinct()


def _uri(path: str) -> str:
    return path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else "file://" + quote(path)


def _roots(spark: SparkSession, roots: dict[str, str] | DataFrame) -> DataFrame:
    if isinstance(roots, dict):
        rows = [(repo, _uri(root)) for repo, root in roots.items()]
        return spark.createDataFrame(rows, "repo string, root string")
    return roots


def scan_files(spark: SparkSession, roots: dict[str, str] | DataFrame, extensions=DEFAULT_EXTENSIONS) -> DataFrame:
    """Read every file with one of the suffixes.  ``roots`` maps repository names
    to root URIs, or is a ``(repo, root)`` table."""
    listing = list_trees(_roots(spark, roots))
    return read_files(listing.where(has_extension(F.col("path"), extensions)))


def scan_selected(spark: SparkSession, roots: dict[str, str] | DataFrame, **selection) -> DataFrame:
    """Read the files that all selection rules keep, ignore files included.

    The rules work on the listing, so contents of other files are never read
    and no content moves between tasks.  ``selection`` as for ``select_files``."""
    listing = list_trees(_roots(spark, roots))
    rules = root_ignore_rules(read_files(listing.where(F.col("path") == ".gitignore")))
    return read_files(select_files(listing, rules=rules, **selection))
