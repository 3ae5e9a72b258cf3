import random

import numpy as np
import pyarrow as pa

from sourcelake.llm import quality as q

SCHEMA = "doc_id bigint, text string, lang string, source string, dk bigint, y string"
LABELS = "doc_id bigint, quality int, text string"


def sample(seed, n):
    random.seed(seed)
    words = "the of anred tion wher ingly on thes é and zu".split()
    docs, labels = [], []
    for i in range(n):
        body = random.choices(words, k=random.randint(5, 150))
        bad = random.random() < 0.3
        if bad:
            kind = i // 3 % 3
            body = [w.upper() + "!!" for w in body] if kind == 0 else [w for w in body for _ in range(9)] if kind == 1 else [w + "###" for w in body]
        docs.append((i, random.choice([" ", " ", ".\n"]).join(body), random.choice(["en", None]), random.choice(["a", "b", None]), 1, "y"))
        labels.append((i, int(not bad), "t"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = sample(1, 2000)
    known = [x for x in labels if x[0] % 3]
    out = q.quality_scores(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(known, LABELS)).collect()
    assert len(out) == len(docs)
    right = [r.keep == bool(labels[r.doc_id][1]) for r in out if r.doc_id % 3 == 0]
    assert np.mean(right) > 0.95
    again = q.quality_scores(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(known, LABELS)).collect()
    assert sorted((r.doc_id, round(r.score, 4), r.keep) for r in out) == sorted((r.doc_id, round(r.score, 4), r.keep) for r in again)


def test_views_learn_from_each_other():
    """With the few labels that the page view has it is no good; the text view's labels mend it."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 3000).astype(float)
    text = np.column_stack((y * 6 - 3 + rng.normal(size=3000), rng.normal(size=3000)))
    meta = np.column_stack([y * 1.5 + rng.normal(size=3000)] + [rng.normal(size=3000) for _ in range(25)])
    few, rest = slice(0, 40), slice(1000, 3000)
    scores = []
    for rounds in (0, 3):
        spread = [(x.mean(axis=0), x.std(axis=0)) for x in (text, meta)]
        pool = lambda teachers, learners: q.exchange_sums((text[rest], meta[rest]), teachers, learners)
        _, page = q.co_train((text[few], meta[few], y[few]), spread, pool, rounds)
        scores.append(np.mean((page.logits(meta[40:1000]) > np.median(page.logits(meta[40:1000]))) == y[40:1000]))
    assert scores[1] > scores[0] + 0.03


def test_odd_rows(spark, rows):
    docs, labels = sample(3, 200)
    odd = [(None, None, None, None, None, None), (None, "", None, "", 0, ""), (500, "\0", "", "", 0, ""), (501, "x " * 300_000, "en", "a", 0, ""), docs[0], docs[0]]
    frame = spark.createDataFrame(docs + odd, SCHEMA)
    twice = labels + [(0, None, ""), (1, 1 - labels[1][1], ""), (None, 1, ""), (999, 0, "")]
    out = q.quality_scores(frame, spark.createDataFrame(twice, LABELS)).collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in out)
    kept = q.keep_good(frame, spark.createDataFrame(twice, LABELS))
    assert kept.columns == frame.columns and kept.count() == sum(r.keep for r in out)
    one_kind = spark.createDataFrame([x for x in labels if x[1]], LABELS)
    assert q.quality_scores(frame, one_kind).where("keep and score is null").count() == len(out)
    assert q.quality_scores(frame, spark.createDataFrame([], LABELS)).where("keep").count() == len(out)
    assert q.quality_scores(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, LABELS)).count() == 0


def plain_fit(x, y, w, mean, scale, penalty=3.0):
    """The same loss by ordinary gradient steps."""
    rows = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    ridge = np.full(rows.shape[1], penalty)
    ridge[-1] = 1e-6
    v = np.zeros(rows.shape[1])
    bound = 0.25 * np.linalg.eigvalsh((rows * w[:, None]).T @ rows)[-1] + penalty
    for _ in range(20_000):
        v += (rows.T @ (w * (y - q.sigmoid(rows @ v))) - ridge * v) / bound
    return v


def test_a_round_learns_from_every_sure_row():
    """A round's weights are those of a plain fit over the labelled rows and all
    the rows that the other view was sure of, whose weights add up to theirs."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 1500).astype(float)
    a = np.column_stack((y * 5 - 2.5 + rng.normal(size=1500), rng.normal(size=1500)))
    b = np.column_stack((y * 4 - 2 + rng.normal(size=1500), rng.normal(size=1500)))
    few, rest = np.arange(200), np.arange(200, 1500)
    fit = few[few % 5 != 0]
    spread = [(x.mean(axis=0), x.std(axis=0)) for x in (a, b)]
    pool = lambda teachers, learners: q.exchange_sums((a[rest], b[rest]), teachers, learners)
    before, _ = q.co_train((a[few], b[few], y[few]), spread, pool, 0)
    _, after = q.co_train((a[few], b[few], y[few]), spread, pool, 1)
    p = q.sigmoid(before.logits(a[rest]))
    sure = (p <= q.CONFIDENT) | (p >= 1 - q.CONFIDENT)
    x = np.vstack((b[fit], b[rest][sure]))
    weight = np.concatenate((np.ones(len(fit)), np.full(sure.sum(), q.PSEUDO_SHARE * len(fit) / sure.sum())))
    want = plain_fit(x, np.concatenate((y[fit], p[sure] > 0.5)), weight, *spread[1])
    assert sure.sum() > 500 and np.abs(after.weights - want).max() < 1e-3


def test_sums_cover_every_row(spark):
    """Sums by Spark are those of one array of all rows, however they are dealt."""
    rng = np.random.default_rng(7)
    text, meta = rng.random((40_000, q.TEXT_SIZE), np.float32), rng.random((40_000, q.META_SIZE), np.float32)
    table = pa.table({"text_view": list(text), "meta_view": list(meta)})
    frame = spark.createDataFrame(table)
    view = lambda size, seed: q.View(np.full(size, 0.5), np.full(size, 0.3), np.random.default_rng(seed).normal(size=size + 1))
    teachers, learners = (view(q.TEXT_SIZE, 1), view(q.META_SIZE, 2)), (view(q.TEXT_SIZE, 3), view(q.META_SIZE, 4))
    sums = lambda x: q.exchange_sums(x, teachers, learners)
    want = sums((text, meta))
    for parts in (1, 7):
        got = q._added(frame.repartition(parts), 40_000, sums)
        assert np.allclose(got, want, rtol=1e-6, atol=1e-4)
    assert want[-1] > 16_000


def test_steps_that_go_too_far_are_halved():
    """From weights that are sure of the wrong answers plain Newton steps run away."""
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 800).astype(float)
    x = np.column_stack((y * 4 - 2 + rng.normal(size=800), rng.normal(size=800)))
    ends = []
    for start in (np.zeros(3), np.array([-9.0, 4.0, 6.0]), np.array([40.0, -30.0, 20.0])):
        *_, view = q._descend(q.View(np.zeros(2), np.ones(2), start), lambda v: q.newton_sums(x, v, y), 3.0)
        ends.append(view.weights)
    want = plain_fit(x, y, np.ones(800), np.zeros(2), np.ones(2))
    assert all(np.abs(end - want).max() < 1e-3 for end in ends)
