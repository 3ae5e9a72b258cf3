import random
import re
from collections import defaultdict

from sourcelake.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size int, n int, target string, row string"


def sample(seed, n, sources):
    random.seed(seed)
    rows = []
    for i in range(n):
        k = random.choice([0, 1, 3, 8, 20, 150])
        rows.append((i, random.choice([" ", "\n", " \t"]).join(random.choices(["a", "bé", "c🙂", "d "], k=k)), random.choice(sources), 1, 1, "", ""))
    return rows + [(None, None, None, 0, 0, "", ""), (n, None, sources[0], 0, 0, "", "")] + [rows[0]] * 3


def targets(rows, weights=(5, 2, 1), repeats=3):
    size = defaultdict(int)
    for r in rows:
        size[r[2]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(size.values())
    while True:
        share = (total - sum(fixed.values())) / (sum(w for s, w in weight.items() if s not in fixed) or 1)
        over = {s: repeats * size[s] for s in order if s not in fixed and weight[s] * share > repeats * size[s]}
        if not over:
            return size, {s: fixed.get(s, weight[s] * share) for s in order}
        fixed |= over


def check(spark, rows):
    out = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    again = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    size, target = targets(rows)
    got, source = defaultdict(int), {r[0]: r[2] for r in rows}
    for r in out:
        s = source[r.doc_id]
        assert r.taken % (r.size or 1) == 0 and 0 <= r.taken <= 3 * r.size
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        got[s] += r.taken
    return got, target


def test_sources_meet_their_targets(spark):
    rows = sample(1, 400, ["src10", "src2", "é", None, "zz", "B"])
    got, target = check(spark, rows)
    assert all(abs(got[s] - target[s]) <= 1 for s in target)


def test_hot_lengths_are_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 7)
    monkeypatch.setattr(mixing, "SPAN", 30)
    rows = [(i, "w " * 5, "hot", 1, 1, "", "") for i in range(300)] + [(1000 + i, "w " * (i % 4 + 1), "b", 1, 1, "", "") for i in range(40)]
    got, target = check(spark, rows)
    assert all(abs(got[s] - target[s]) <= 3 for s in target)


def test_fit_is_as_near_as_any_choice():
    random.seed(3)
    for _ in range(300):
        lengths = sorted(random.sample(range(1, 40), k=random.randint(1, 5)), reverse=True)
        counts = [random.randint(1, 4) for _ in lengths]
        budget = random.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = mixing.fit(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(taken, counts, strict=True))
        got = sum(n * k for n, k in zip(lengths, taken, strict=True))
        assert abs(got - budget) == min(abs(s - budget) for s in sums)


def test_large_budgets_spread_over_lengths():
    lengths = list(range(3000, 0, -1))
    counts = [50] * 3000
    budget = sum(a * b for a, b in zip(lengths, counts, strict=True)) // 2 + 1
    taken = mixing.fit(lengths, counts, budget)
    assert sum(n * k for n, k in zip(lengths, taken, strict=True)) == budget
    assert 20 <= sum(taken[:1000]) / 1000 <= 30 and 20 <= sum(taken[-1000:]) / 1000 <= 30


def test_one_long_document_and_no_rows(spark):
    assert mixing.fit([10**9], [1], 4 * 10**8) == [0] and mixing.fit([10**6], [1], 6 * 10**5) == [1]
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
