import random

import pytest
from pyspark.sql import functions as F

from sourcelake.operators.clustering import cluster_ids, greedy_cluster, independent_rounds, similar_pairs
from sourcelake.operators.shingles import jaccard

SETS = "repo string, path string, hashes array<bigint>"


def similarity(a, b):
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b) if a and b else 0.0


def sequential(files, threshold):
    """One path after the other, as the rule is stated."""
    out = {}
    for repo in {r for r, _ in files}:
        paths = sorted(p for r, p in files if r == repo)
        assigned = set()
        for first in paths:
            if first in assigned:
                continue
            members = [p for p in paths if p not in assigned and p > first
                       and similarity(files[repo, first], files[repo, p]) >= threshold]
            if members:
                assigned.update([first, *members])
                out[repo, first] = sorted([first, *members])
    return out


def random_files(seed, n=60, repos=2):
    """Families of near copies, exact copies, strangers and empty files."""
    rng = random.Random(seed)
    bases = [set(rng.sample(range(200), rng.randint(1, 20))) for _ in range(8)]
    files = {}
    for i in range(n):
        base = set(rng.choice(bases))
        kind = rng.random()
        if kind < 0.1:
            base = set()
        elif kind < 0.7:
            for _ in range(rng.randint(1, 3)):
                base ^= {rng.randint(0, 200)}
        files[f"r{rng.randrange(repos)}", f"f{i:03d}"] = base
    return files


def as_sets(spark, files):
    return spark.createDataFrame([(r, p, sorted(h)) for (r, p), h in files.items()], SETS)


@pytest.mark.parametrize("seed,threshold,hot,block", [
    (1, 0.85, 4096, 512), (2, 0.6, 4096, 3), (3, 0.5, 3, 2), (4, 0.85, 2, 2), (5, 0.3, 4, 4), (6, 1.0, 2, 3),
])
def test_greedy_equals_sequential(spark, seed, threshold, hot, block):
    files = random_files(seed)
    got = {}
    for r in greedy_cluster(as_sets(spark, files), threshold, hot_bucket=hot, block=block).collect():
        got.setdefault((r.repo, r.representative), []).append(r.member)
    assert {k: sorted(v) for k, v in got.items()} == sequential(files, threshold)


def test_family_of_near_copies_is_peeled(spark):
    """All members of a hot family are similar: one pass takes them all."""
    files = {("r", f"f{i:03d}"): set(range(40)) | {1000 + i} for i in range(80)}
    got = greedy_cluster(as_sets(spark, files), 0.85, hot_bucket=8, block=4).collect()
    assert {r.representative for r in got} == {"f000"} and len(got) == 80


@pytest.mark.parametrize("threshold", [0.0, 1.5])
def test_threshold_outside_range(spark, threshold):
    files = {("r", "a"): {1}, ("r", "b"): {1}, ("r", "c"): {9}}
    got = greedy_cluster(as_sets(spark, files), threshold).collect()
    assert len(got) == (3 if threshold == 0 else 0)


def test_chain_is_not_transitive(spark):
    files = {("r", "a"): {1, 2, 3, 4}, ("r", "b"): {2, 3, 4, 5}, ("r", "c"): {3, 4, 5, 6}}
    got = greedy_cluster(as_sets(spark, files), 0.6).collect()
    assert sorted(r.member for r in got) == ["a", "b"]


@pytest.mark.parametrize("seed,threshold", [(1, 0.85), (2, 0.5), (3, 0.3)])
def test_similar_pairs_are_openers_and_members(spark, seed, threshold):
    files = random_files(seed, n=50)
    got = {(r.repo, r.opener, r.member): r.similarity for r in similar_pairs(as_sets(spark, files), threshold).collect()}
    want = {
        (repo, first, p): similarity(files[repo, first], files[repo, p])
        for (repo, first), members in sequential(files, threshold).items() for p in members if p != first
    }
    assert got == pytest.approx(want)


def test_pairs_grow_with_the_family(spark):
    for n in (60, 120):
        files = {("r", f"f{i:03d}"): set(range(40)) | {1000 + i} for i in range(n)}
        assert similar_pairs(as_sets(spark, files), 0.85).count() == n - 1


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), ([], [1]), ([1, 2], [2, 3])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 / 3]


def test_cluster_ids_and_fingerprint(spark):
    import hashlib

    members = [("r", "a", "a"), ("r", "a", "b"), ("r", "c", "c"), ("r", "c", "d"), ("s", "x", "x"), ("s", "x", "y")]
    df = spark.createDataFrame(members, "repo string, representative string, member string")
    got = {(r.repo, r.cluster_id): r for r in cluster_ids(df, 0.85).collect()}
    assert sorted(got) == [("r", "cluster_1"), ("r", "cluster_2"), ("s", "cluster_1")]
    digests = [hashlib.sha1(m).hexdigest() for m in (b"c", b"d")]
    sums = [str(sum(int(d[8 * i:8 * i + 8], 16) for d in digests)) for i in range(5)]
    assert got["r", "cluster_2"].fingerprint == hashlib.sha1("|".join(["c", "2", *sums]).encode()).hexdigest()
    assert got["s", "cluster_1"].size == 2


def test_cluster_fingerprint_depends_on_all_members(spark):
    base = [("r", "m000", f"m{i:03d}") for i in range(50)]
    schema = "repo string, representative string, member string"
    digest = lambda rows: cluster_ids(spark.createDataFrame(rows, schema), 0.85).first().fingerprint
    assert digest(base) == digest(base[::-1]) != digest(base[:-1] + [("r", "m000", "other")])


def first_independent(edges, nodes):
    chosen = set()
    for v in sorted(nodes):
        if not any((u, v) in edges for u in chosen):
            chosen.add(v)
    return chosen


@pytest.mark.parametrize("seed,rounds,local", [(7, 4, 1000), (8, 1, 1000), (9, 1, 5)])
def test_independent_rounds_on_random_graphs(spark, seed, rounds, local):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)}
    names = [("r", f"{u:02d}", f"{v:02d}") for u, v in edges]
    df = spark.createDataFrame(names, "repo string, u string, v string")
    taken = {int(r.v) for r in independent_rounds(df, rounds, local).collect()}
    touched = {x for e in edges for x in e}
    assert taken == touched - first_independent(edges, touched)


def test_long_chain_of_versions(spark):
    """Each version resembles only its neighbours, in path order."""
    names = [("r", f"{i:04d}", f"{i + 1:04d}") for i in range(600)]
    df = spark.createDataFrame(names, "repo string, u string, v string")
    taken = {r.v for r in independent_rounds(df, rounds=2).collect()}
    assert taken == {f"{i:04d}" for i in range(601) if i % 2}
