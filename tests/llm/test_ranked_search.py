import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sourcelake.llm import ranked_search as rs

DOCS = "doc_id bigint, text string, q string, rank int, terms string, score int"
ITEMS = "item_id bigint, text string, q string, doc_id int"


def terms(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(docs, items, k=10):
    counts = [(d[0], Counter(terms(d[1]))) for d in docs]
    counts = [(i, c) for i, c in counts if c]
    n_all, l_all = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item_id, text, *_ in items:
        scored = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n_all // l_all
            scored.append((-sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c), i is None, i or 0))
        best = sorted(s for s in scored if s[0] < 0)[:k]
        out += [(item_id, r, None if none else i, -s) for r, (s, none, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


def sample(seed, n):
    random.seed(seed)
    words = ["the", "water", "É", "é", "x1", "Zug", "don't", "a_b", "你好", "last"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda k: random.choice([" ", ", ", "\n"]).join(random.choices(words, weights, k=k))
    docs = [(random.randint(0, 10**12), text(random.choice([1, 3, 30, 200])), "q", 1, "t", 2) for _ in range(n)]
    docs += [(7, docs[0][1], "", 0, "", 0), (6, docs[0][1], "", 0, "", 0), (None, docs[0][1], "", 0, "", 0), (8, None, "", 0, "", 0), (9, " .,-", "", 0, "", 0), docs[1], docs[1]]
    docs.append((10, "water " * 30_000, "", 0, "", 0))
    items = [(i, text(random.choice([1, 2, 12, 40])), "q", 1) for i in range(12)]
    return docs, items + [(50, None, "", 0), (51, "!!", "", 0), (None, "water zug", "", 0), (52, "nowhere", "", 0)]


@pytest.mark.parametrize("seed,cells,block", [(1, 1 << 22, 1 << 16), (2, 1, 30)])
def test_best_are_those_of_all(spark, monkeypatch, seed, cells, block):
    """Whole, and in many shards and blocks of items."""
    monkeypatch.setattr(rs, "SHARD_CELLS", cells)
    monkeypatch.setattr(rs, "BLOCK_TERMS", block)
    monkeypatch.setattr(rs, "FIRST_READ", 4)
    docs, items = sample(seed, 400)
    got = rs.ranked_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_reading_stops_early_and_ties_stay():
    """Many documents, two lists: few are met, but all with the score of the last."""
    random.seed(4)
    n = 20_000
    doc, term = np.tile(np.arange(n), 2), np.repeat([0, 1], n)
    impact = np.array([random.randint(1, 500) for _ in range(2 * n)], dtype=np.int64)
    impact[[5, 50, 500, n + 5, n + 50, n + 500]] = 1000
    lists = rs.ImpactLists(doc, term, impact, n, 2)
    weights = np.array([3, 2], dtype=np.int64)
    docs, scores = lists.best([0, 1], weights, 1, 2)
    want = weights @ impact.reshape(2, n)
    assert len(docs) < n / 10 and all(scores == want[docs])
    assert {int(d) for d, s in zip(docs, scores) if s == 5000} == {5, 50, 500}


def test_no_rows(spark):
    docs, items = sample(1, 3)
    none = lambda s: spark.createDataFrame([], s)
    assert rs.ranked_search(none(DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert rs.ranked_search(spark.createDataFrame(docs, DOCS), none(ITEMS)).count() == 0
