"""Token counts of whole texts, from a table of pre-tokens."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sourcelake.llm.keys import whole_text
from sourcelake.session import materialize

#: Pre-tokens that make up at least one in so many of all occurrences are
#: handed to every task; there can be no more of them than this.
COMMON = 1 << 19
#: Words a task remembers or counts before it lets go of them, which bounds its memory.
REMEMBERED = 1 << 18


class PreTokenizer:
    """Splits words into the pre-tokens of a tokenizer file, and counts the pieces of one.

    Words are what ASCII white space separates; the tokenizer must drop white
    space, so that no piece spans two words.  Pre-tokens are kept as readable
    text.  Words of Latin letters, whose classes and lower case are the same
    everywhere, go through the file's own pattern here; all others, and all
    words of a tokenizer of another make, through the library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = _latin_pattern(json.loads(self.tokenizer.to_str()))

    def split(self, word: bytes) -> list[str]:
        text = word.decode("utf-8", "replace")
        for a in self.added:
            if a in text:
                return [text]
        if self.pattern and (word.isascii() or not _BEYOND_LATIN.search(text)):
            return self.pattern.findall(text.lower())
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pretoken: str) -> int:
        return len(self.tokenizer.encode(pretoken, add_special_tokens=False).ids)


_BEYOND_LATIN = re.compile("[^\\x00-\u024f]")


def _latin_pattern(spec: dict) -> regex.Pattern | None:
    """The pattern whose matches are the pre-tokens, if the file lower-cases,
    splits by one pattern and does nothing else to Latin letters."""
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or spec["normalizer"]["normalizers"][1]["pattern"] != {"Regex": r"\s+"}:
        return None
    if [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[1]["use_regex"] or splits[1]["add_prefix_space"]:
        return None
    split = splits[0]
    return regex.compile(split["pattern"]["Regex"]) if split["invert"] and split["behavior"] == "Removed" and "Regex" in split["pattern"] else None


@lru_cache(maxsize=4)
def pre_tokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)


def pretoken_table(docs: DataFrame, path: str) -> DataFrame:
    """``(pretoken, n, pieces)``: each distinct pre-token of all texts, its
    occurrences, and its pieces, counted once."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words = pre_tokenizer(path).split, Counter()

        def flush() -> pa.RecordBatch:
            found: Counter = Counter()
            for word, n in words.items():
                for p in split(word):
                    found[p] += n
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(found.values(), pa.int64())], ["pretoken", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words.update(text.split())
                if len(words) > REMEMBERED:
                    yield flush()
        yield flush()

    @F.pandas_udf("int")
    def pieces(pretokens: pd.Series) -> pd.Series:
        count = pre_tokenizer(path).pieces
        return pd.Series([count(p) for p in pretokens], dtype="int32")

    texts = docs.select(whole_text().cast("binary").alias("text"))
    counted = texts.mapInArrow(occurrences, "pretoken string, n bigint").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return counted.select("pretoken", "n", pieces("pretoken").alias("pieces"))


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``, as
    the tokenizer in ``path`` counts the whole text without adding tokens.

    Every distinct pre-token is encoded once (:func:`pretoken_table`).  A
    document's pre-tokens are then summed without ids: the common ones, of
    which there are at most :data:`COMMON` however large the corpus, from a
    table that every task holds; the others, none of which is frequent enough
    to skew a join, by a join on the pre-token.

    NULL text counts as empty and has 0 tokens.  Rows with the same or no
    ``doc_id`` are counted one by one.  Empty table, no rows; other columns are
    ignored."""
    pretokens = materialize(pretoken_table(docs, path), "pretokens")
    total = pretokens.agg(F.sum("n")).first()[0] or 0
    common = pretokens.where(F.col("n") * COMMON >= total).select("pretoken", "pieces").toPandas()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(common["pretoken"], common["pieces"].tolist(), strict=True)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, have = pre_tokenizer(path).split, known.value
        seen: dict[bytes, tuple[int, tuple[str, ...]]] = {}

        def look_up(word: bytes) -> tuple[int, tuple[str, ...]]:
            parts = split(word)
            found = sum(have.get(p, 0) for p in parts), tuple(p for p in parts if p not in have)
            seen[word] = found
            return found

        for batch in batches:
            sums, rare, times = [], [], []
            for text in batch.column("text").to_pylist():
                n, other = 0, {}
                for word, k in Counter(text.split()).items():
                    pieces, rest = seen.get(word) or look_up(word)
                    n += pieces * k
                    for p in rest:
                        other[p] = other.get(p, 0) + k
                sums.append(n)
                rare.append(list(other))
                times.append(list(other.values()))
                if len(seen) > REMEMBERED:
                    seen.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums, pa.int64()),
                 pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "n", "rare", "times"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text"), F.octet_length(whole_text()).cast("bigint").alias("n_bytes"))
    counted = texts.mapInArrow(frequencies, "doc_id bigint, n_bytes bigint, n bigint, rare array<string>, times array<bigint>")
    rows = materialize(counted.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    pairs = rows.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("p"))
    joined = pairs.select("row", F.col("p.rare").alias("pretoken"), F.col("p.times").alias("times")).join(
        pretokens.select("pretoken", "pieces"), "pretoken"
    )
    others = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n_tokens = F.col("n") + F.coalesce("more", F.lit(0))
    return rows.select("row", "doc_id", "n_bytes", "n").join(others, "row", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
