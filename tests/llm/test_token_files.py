import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from sourcelake.llm import token_files as tf
from tests.llm.test_token_counts import TEXTS

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, start bigint, file string, tokens int, n_tokens string"


def sample(seed, n):
    random.seed(seed)
    words = ["Water", "it's", "éclair", "2024", "zyzzyva", "你好", "<|endoftext|>", "--", "x y", "áb"]
    rows = [(i, t, 1, "f", 2, "n") for i, t in enumerate(TEXTS)]
    rows += [(random.randint(100, 10**12), random.choice([" ", "\n", "\t"]).join(random.choices(words, k=random.randint(0, 60))), 1, "", 0, "") for _ in range(n)]
    rows += [(None, "same row", 1, "", 0, "")] * 2 + [(5, "again", 0, "", 0, ""), (5, "again", 0, "", 0, ""), (-4, "before", 0, "", 0, ""), (None, None, 0, "", 0, "")]
    random.shuffle(rows)
    return rows


def brute(rows):
    encode, start, out = Tokenizer.from_file(PATH).encode, 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        ids = [*encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_round_trip(spark, tmp_path):
    rows = sample(1, 300)
    out = str(tmp_path / "ids")
    tf.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH, out, files=3)
    back = tf.read_tokens(spark, out)
    want = brute(rows)
    assert sorted(((r.start, r.doc_id, r.n_tokens, r.tokens) for r in back.collect()), key=repr) == sorted(((s, d, n, ids) for d, s, n, _, ids in want), key=repr)
    got = tf.with_crc32(back)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((w[:4] for w in want), key=repr)
    # Files follow each other, and rows in them, by doc_id.
    ids = [i for f in sorted(glob.glob(f"{out}/*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert ids == [w[0] for w in want] and len(glob.glob(f"{out}/*.parquet")) == 3


def test_runs_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "RUN_BYTES", 50)
    monkeypatch.setattr(tf, "TOGETHER", 3)
    rows = sample(2, 60)
    tf.write_tokens(spark.createDataFrame(rows, SCHEMA), PATH, str(tmp_path / "ids"))
    got = tf.with_crc32(tf.read_tokens(spark, str(tmp_path / "ids"))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((w[:4] for w in brute(rows)), key=repr)


def test_words_encoded_together_are_those_of_the_library():
    random.seed(6)
    signs = [chr(c) for c in [*range(33, 0x250), 0x300, 0x301, 0x2003, 0x3000, 0x4f60, 0xfb01, 0x1f926]] + list("stmdrvel'" * 30)
    words = ["".join(random.choices(signs, k=random.randint(1, 9))).encode() for _ in range(5000)]
    ours, library = tf.WordIds(PATH), Tokenizer.from_file(PATH)
    ours.learn(set(words))
    assert all(np.frombuffer(ours.known[w], np.int32).tolist() == library.encode(w.decode(), add_special_tokens=False).ids for w in words)


def test_format(spark, tmp_path):
    """Lists by dictionary, numbers as deltas, several row groups, a page index."""
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('word ', id % 97, ' other ', id % 89) AS text")
    out = str(tmp_path / "ids")
    small = tf.FORMAT | {"parquet.block.size": str(64 << 10)}
    tf.encoded(docs, PATH).write.options(**small).parquet(out)
    meta = pq.ParquetFile(sorted(glob.glob(f"{out}/*.parquet"))[0]).metadata
    assert meta.num_row_groups > 1
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())


def test_selective_reads(spark, tmp_path):
    out = str(tmp_path / "ids")
    tf.write_tokens(spark.range(1000).selectExpr("id AS doc_id", "'a few words' AS text"), PATH, out)
    back = tf.read_tokens(spark, out)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "array<int>" in plan(back) and "array<int>" not in plan(back.select("doc_id", "start", "n_tokens"))
    some = back.where("doc_id BETWEEN 10 AND 12")
    assert "GreaterThanOrEqual(doc_id,10)" in plan(some)
    assert [r.start for r in some.orderBy("doc_id").collect()] == [40, 44, 48]


def test_no_rows(spark, tmp_path):
    tf.write_tokens(spark.createDataFrame([], SCHEMA), PATH, str(tmp_path / "ids"))
    assert tf.with_crc32(tf.read_tokens(spark, str(tmp_path / "ids"))).count() == 0
