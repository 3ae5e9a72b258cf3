import hashlib
import random
import re
from collections import defaultdict

from sourcelake.llm import exact_dedup as ed

SCHEMA = "doc_id bigint, text string, name string, row string, n int, pos int"


def brute(rows):
    bare = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for i, b in enumerate(bare):
        groups[b].append(i)
    out = []
    for b, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i))
        for i in members:
            out.append((rows[i][0], rows[best][0], len(members), i == best, hashlib.sha256(b.encode()).hexdigest()))
    return sorted(out, key=repr)


def sample(seed, n):
    random.seed(seed)
    words = ["añb", "c", "dé", "🙂", "xyz"]
    rows = []
    for i in range(n):
        text = " ".join(random.choices(words, k=random.choice([1, 2, 3, 8, 9, 40])))
        rows.append((i, text, "x", "r", 1, 2))
        if i % 3 == 0:
            rows.append((i + 1000, text.replace(" ", random.choice(["", "\n", "  ", "\t\x0b"])), "x", "r", 1, 2))
    rows += [(5000, "", "", "", 0, 0), (5001, None, "", "", 0, 0), (5002, " \n", "", "", 0, 0), (None, "", "", "", 0, 0), (5003, " ", "", "", 0, 0)]
    return rows + [(7, "twice", "", "", 0, 0)] * 2 + [(None, None, None, None, None, None)] * 2


def test_groups_match_plain_comparison(spark, monkeypatch, rows):
    monkeypatch.setattr(ed, "BLOCK_BYTES", 4)
    data = sample(1, 120)
    assert rows(ed.exact_groups(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_hot_blocks_and_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(ed, "BLOCK_BYTES", 4)
    monkeypatch.setattr(ed, "BUCKETS", 3)
    data = sample(2, 30) + [(9000 + i, "same long text " * 9 + str(i % 2), "", "", 0, 0) for i in range(700)]
    assert rows(ed.exact_groups(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_no_rows(spark):
    assert ed.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
