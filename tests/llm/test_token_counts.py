import random

import public_tokenizers
from tokenizers import Tokenizer

from sourcelake.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, n bigint, row string, pieces int, pretoken string"
TEXTS = [
    "", None, " ", "Don't stop, it's 2024!", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> x<|endoftext|><|endoftext|>",
    "ΣΑΣ Σ σίγμας", "İstanbul ıI", "é café ́x", "a b c　d\u0085e\u001cf​g", "x\ty\r\nz\x0bq\x0cw",
    "你好，世界 1234", "🤦🏼‍♂️ ok", "we'll we've I'd 'tis '' '", "ﬁ Å Å K ſ", "a\0b \0 \0c", "word " * 3000, "q" * 20000,
]


def test_counts_are_the_librarys(spark):
    rows = [(i, t, 1, "r", 2, "p") for i, t in enumerate(TEXTS)] + [(None, "same row", 1, "", 0, "")] * 3 + [(3, "again", 0, "", 0, "")]
    got = [tuple(r) for r in tc.token_counts(spark.createDataFrame(rows, SCHEMA), PATH, limit=100).collect()]
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_latin_words_split_as_in_the_library():
    random.seed(5)
    ours = tc.pre_tokenizer(PATH)
    signs = [chr(c) for c in range(33, 0x250) if not chr(c).isspace()] + list("stmdrvel'" * 20)
    for _ in range(3000):
        word = "".join(random.choices(signs, k=random.randint(1, 9)))
        normal = ours.tokenizer.normalizer.normalize_str(word)
        want = [normal[a:b] for _, (a, b) in ours.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        assert ours.split(word.encode()) == want, word


def test_rare_pretokens_are_joined(spark, monkeypatch):
    monkeypatch.setattr(tc, "COMMON", 3)
    docs = spark.createDataFrame([(1, "the the the cat"), (2, "the dog, the cat"), (2**60 + 1, "zyzzyva")], "doc_id bigint, text string")
    tokenizer = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs, PATH).collect()}
    assert got == {r.doc_id: len(tokenizer.encode(r.text).ids) for r in docs.collect()}


def test_no_rows(spark):
    assert tc.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0
