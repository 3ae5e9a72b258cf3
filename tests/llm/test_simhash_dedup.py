import random

import xxhash
from pyspark.sql import functions as F

from sourcelake.llm import simhash_dedup as sd

SCHEMA = "doc_id bigint, text string, fp string, k1 string, a bigint"


def fingerprint(text, words):
    parts = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    shingles = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, distance):
    """Smallest id in reach of every fingerprint, comparing all with all."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for other in distinct[:i]:
            if (p ^ other).bit_count() <= distance:
                root[find(p)] = find(other)
    least = {}
    for p, i in zip(prints, ids, strict=True):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for p in prints]


def sample(seed, n):
    random.seed(seed)
    words = ["the", "A", "é", "of", "water", "Run", "xy", "on"]
    base = [random.choices(words, k=k) for k in (0, 2, 3, 4, 30, 120, 300)]
    rows = []
    for i in range(n):
        text = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 5])):
            if text:
                text[random.randrange(len(text))] = random.choice(words)
        rows.append((i, random.choice([" ", "\n", "\t "]).join(text), "f", "k", 1))
    return rows + [(None, None, None, None, None), (None, "own words here to be alone now", "", "", 0), (n, "", "", "", 0), rows[5], rows[5], rows[9]]


def test_groups_match_plain_comparison(spark):
    for distance in (0, 1, 3, 4, 6):
        data = sample(distance, 150)
        out = sd.simhash_groups(spark.createDataFrame(data, SCHEMA), 4, distance).collect()
        prints = [fingerprint(r[1], 4) for r in data]
        want = components(prints, [r[0] for r in data], distance)
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=repr) == sorted(
            ((r[0], f"{p:016x}", c) for r, p, c in zip(data, prints, want, strict=True)), key=repr
        )
        links = {f"{p:016x}": sum(0 < (p ^ o).bit_count() <= distance for o in set(prints)) for p in set(prints)}
        assert all(r.n_links == links[r.fingerprint] for r in out)


def test_every_pair_of_bits_is_found_once(spark):
    random.seed(8)
    base = random.getrandbits(64)
    prints = {base} | {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)} | {base ^ (1 << 63), base ^ (0b1111 << 60)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = sd.near_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), 4).collect()
    got = [frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in found]
    want = {frozenset((p, o)) for p in prints for o in prints if 0 < (p ^ o).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_document_of_each_group_stays(spark):
    data = sample(4, 150)
    frame = spark.createDataFrame(data, SCHEMA)
    kept = sd.near_dedup(frame, 4, 4)
    prints = [fingerprint(r[1], 4) for r in data]
    want = components(prints, [r[0] for r in data], 4)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(set(want) | {None} if None in want else set(want), key=repr)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sd.simhash_groups(none).count() == 0 and sd.near_dedup(none).count() == 0


def test_variants_are_not_broadcast(spark):
    """64 rows for each fingerprint, whose size Spark takes for that of the fingerprints."""
    links = sd.near_links(spark.range(100).select(F.col("id").alias("fp")))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
