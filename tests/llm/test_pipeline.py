"""The stages on a small corpus, each held against a plain loop over what the one before kept."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from sourcelake.llm.quality import quality_scores
from tests.llm import test_decontaminate, test_line_dedup, test_mixing, test_simhash_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, n_lines string, _dk string"


def corpus(seed):
    random.seed(seed)
    words = [a + b for a in ("an", "the", "wa", "é", "sto", "lin") for b in ("re", "ti", "on", "ed", "ow", "ma", "k")]
    passage = lambda k: " ".join(random.choices(words, k=k))
    items = [(i, passage(random.choice([14, 25, 40]))) for i in range(8)]
    lines = [passage(12) for _ in range(6)]
    rows, labels = [], []
    for i in range(110):
        body = [passage(random.randint(4, 40)) for _ in range(random.randint(1, 4))]
        bad = i % 9 == 4
        if i % 5 == 1:
            body.append(random.choice(lines))
        if i % 8 == 2:
            body[0] += " " + random.choice(items)[1]
        if i % 7 == 3:
            text = rows[-1][1].replace(random.choice(words), "other", 1)
        else:
            text = "\n".join(body)
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, random.choice(["en", "de", None]), random.choice(["s1", "s10", "s2", None]), len(text), "r", "k", "d"))
        labels.append((i, int(not bad), 0))
    rows += [(200, None, None, None, None, "", "", ""), (201, "", "en", "s1", 0, "", "", ""), (None, passage(30), "en", "s2", 0, "", "", ""), rows[0], rows[0]]
    return rows, labels, items


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, labels, items = corpus(1)
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs[-1], folder).write.parquet(f"{folder}/{i}")
        docs.append(spark.read.parquet(f"{folder}/{i}"))
    return folder, items, docs


def plain(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_columns(stages):
    _, _, docs = stages
    assert all(d.columns == docs[0].columns for d in docs[1:-1])
    extra = docs[4].where("doc_id < 200").select("_row", "n_lines", "_dk").distinct().collect()
    assert [tuple(r) for r in extra] == [("r", "k", "d")]
    assert docs[-1].columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_quality(spark, stages):
    folder, _, docs = stages
    scores = quality_scores(docs[0], spark.read.parquet(f"{folder}/labels.parquet")).collect()
    gone = {r.doc_id for r in scores if not r.keep}
    assert len(gone) >= 8 and plain(docs[1]) == [r for r in plain(docs[0]) if r[0] not in gone]


def test_lines(stages):
    _, _, docs = stages
    before = plain(docs[1])
    after = Counter((r[0], r[1], r[2] - r[3], r[3]) for r in test_line_dedup.brute(before))
    want = []
    for text_of, n in after.items():
        doc_id, text, _, dropped = text_of
        if not dropped or text.strip():
            want += [(doc_id, text)] * n
    got = plain(docs[2])
    assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(want, key=repr) and len(got) < len(before)
    assert all(r[4] == len(r[1]) for r in got if r[1] and r[0] is not None)


def test_near_copies(stages):
    _, _, docs = stages
    before = plain(docs[2])
    prints = [test_simhash_dedup.fingerprint(r[1], 4) for r in before]
    keep = set(test_simhash_dedup.components(prints, [r[0] for r in before], 4))
    alone = {r[0] for r, c in zip(before, test_simhash_dedup.components(prints, [r[0] for r in before], 4), strict=True) if c is None}
    assert [r[0] for r in plain(docs[3])] == sorted(keep | alone, key=lambda i: repr((i,)))


def test_contamination(stages):
    _, items, docs = stages
    words = test_decontaminate.words
    want = [r for r in plain(docs[3]) if not any(test_decontaminate.overlap(words(r[1]), words(x)) for _, x in items)]
    assert plain(docs[4]) == want and len(want) < docs[3].count()


def test_mix(stages):
    _, _, docs = stages
    before = [(r[0], r[1], r[3]) for r in plain(docs[4])]
    size, target = test_mixing.targets(before)
    source, got = {r[0]: r[2] for r in before}, defaultdict(int)
    for r in docs[5].collect():
        assert 0 <= r.taken <= 3 * r.size and r.source_size == size[source[r.doc_id]]
        got[source[r.doc_id]] += r.taken
    assert docs[5].count() == len(before) and all(abs(got[s] - target[s]) <= 1 for s in target)


def test_run_is_the_stages(spark, stages):
    folder, _, docs = stages
    assert sorted(map(repr, cp.run(spark, folder).collect())) == sorted(map(repr, docs[5].collect()))


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
