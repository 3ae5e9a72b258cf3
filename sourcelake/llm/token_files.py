"""Token ids in Parquet: one list a document, in the order of ids, read by column, row group and page."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sourcelake.llm.keys import whole_text

#: Words whose ids a task remembers before it lets go of them, which bounds its memory.
REMEMBERED = 1 << 19
#: New words that are encoded together.
TOGETHER = 1 << 12
#: Bytes of the texts that a task encodes together.
RUN_BYTES = 1 << 22
#: Id after every document.
END = 2

SCHEMA = "doc_id bigint, file int, file_start bigint, n_tokens bigint, tokens array<int>"

#: Version 2 pages: numbers that mostly differ are packed as deltas, ids by a dictionary.  Row groups
#: and pages are small enough that their minima and maxima, which the footer and the page index hold, tell ids apart.
FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


class WordIds:
    """Ids of texts by those of their words, each word of which is encoded once and remembered.

    The tokenizer must drop white space, so that no piece spans two words: new
    words are then encoded together, with spaces between, and the offsets of their
    pieces tell them apart."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Ids of each word, as the bytes of 32-bit integers.
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        for i in range(0, len(new), TOGETHER):
            some = new[i:i + TOGETHER]
            texts = [w.decode("utf-8", "replace") for w in some]
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            first = np.array([a for a, _ in found.offsets], dtype=np.int64)
            cuts = (4 * np.searchsorted(first, starts)).tolist()
            ids = np.array(found.ids, dtype=np.int32).tobytes()
            for w, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                self.known[w] = ids[a:b]

    def encode(self, texts: list[bytes], end: int) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut, new = [text.split() for text in texts], set()
        for words in cut:
            new.update(words)
        self.learn(new)
        last, look_up = np.int32(end).tobytes(), self.known.__getitem__
        for words in cut:
            yield np.frombuffer(b"".join(map(look_up, words)) + last, dtype=np.int32)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path)


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of :data:`RUN_BYTES`, or of one row."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > RUN_BYTES:
            yield first, i
            first, held = i, 0
        held += n
    if sizes:
        yield first, len(sizes)


def encoded(docs: DataFrame, path: str, end: int = END, files: int | None = None) -> DataFrame:
    """Rows of :data:`SCHEMA` in ascending ``doc_id`` order over partitions and
    inside each: ``file`` is the partition, ``file_start`` the ids before the
    document in it.

    Texts are dealt to ranges of ids, sorted on disk where they do not fit,
    and encoded in that order, so ids themselves are never shuffled."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text"))
    ranged = texts.repartitionByRange(files, order[0]) if files else texts.repartitionByRange(order[0])
    texts = ranged.sortWithinPartitions(*order).withColumn("file", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, start = word_ids(path), 0

        def rows(keys: list, file: int, starts: list[int], sizes: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([file] * len(keys), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), lists],
                ["doc_id", "file", "file_start", "n_tokens", "tokens"],
            )

        for batch in batches:
            keys, texts, files = (batch.column(c).to_pylist() for c in ("doc_id", "text", "file"))
            for a, b in _runs([len(t) for t in texts]):
                ids = list(ids_of.encode(texts[a:b], end))
                sizes = [len(found) for found in ids]
                starts = [start, *(start + n for n in accumulate(sizes))]
                start = starts.pop()
                yield rows(keys[a:b], files[a], starts, sizes, ids)

    return texts.mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, path: str, out: str, end: int = END, files: int | None = None) -> None:
    """Writes every document of ``docs`` with its ids to Parquet in ``out`` (:data:`FORMAT`),
    in as many files as shuffles have partitions, or in ``files``.

    NULL text counts as empty: its list is ``end`` alone.  Rows without
    ``doc_id`` come last; rows that share one follow each other in the order of
    their texts.  An empty table gives files without rows; other columns are not written."""
    encoded(docs, path, end, files).write.options(**FORMAT).parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, tokens`` of what :func:`write_tokens` wrote;
    ``start`` counts the ids of all documents before.

    Files hold starts within themselves; a row per file, of which there are as many as
    shuffle partitions, is summed from the metadata columns and has the rest.  A filter on ``doc_id`` reaches the
    files' row groups and pages, and ``tokens`` is read only if it is asked for."""
    rows = spark.read.schema(SCHEMA).parquet(out)
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "file").select("doc_id", (F.col("offset") + F.col("file_start")).alias("start"), "n_tokens", "tokens")


def with_crc32(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`read_tokens` with ``ids_crc32`` in place of ``tokens``:
    of the ids as little-endian unsigned 32-bit integers."""

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            ends = ends - ends[0]
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
