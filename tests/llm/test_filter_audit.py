import random
import re
from itertools import permutations

import pytest

from sourcelake.llm import filter_audit as fa

SCHEMA = "doc_id bigint, text string, lang string, mask int, part string, k1 string, n int"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        f for f, bad in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", bool(re.search("[#$%&*|]", text))),
        ) if bad
    }


def brute(rows, labels):
    """Every order applied to the documents one after the other."""
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    good = {x[0] for x in labels if x[1] == 1 and x[0] is not None}
    toxic = {x[0] for x in labels if x[2] == 1 and x[0] is not None}
    parts = {}
    for r in rows:
        bad = fails(r[1] or "")
        if r[0] is not None and r[0] > least[r[1] or ""]:
            bad.add("E")
        parts.setdefault(r[2] or "", []).append((r[0], bad))
    out = []
    for part, docs in parts.items():
        total, found = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                found.append((
                    part, "".join(order), step, len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f,
                ))
        out += [(*r[:-1], total[r[-1]]) for r in found]
    return sorted(out)


def sample(seed):
    random.seed(seed)
    rows = []
    for i in range(150):
        words = [random.choice("abcdefgh") + str(random.randint(0, random.choice([5, 900]))) for _ in range(random.choice([0, 5, 99, 100, 130]))]
        if random.random() < 0.3:
            words = [w.upper() for w in words]
        text = random.choice([" ", "\n", "\t \x0b", "  "]).join(words) + random.choice(["", "", " #", " | é", "$"])
        rows.append((i, random.choice([text, text, rows[-1][1] if rows else text]), random.choice(["en", "de", None, ""]), 1, "p", "k", 2))
    rows += [(None, rows[0][1], "en", 0, "", "", 0), (None, None, None, 0, "", "", 0), rows[3], rows[3], (500, "x " * 30_000, "zz", 0, "", "", 0)]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1]), "p") for i in range(0, 150, 2)] + [(0, 1, 1, "p"), (None, 1, 1, "p"), (900, 1, 1, "p")]
    return rows, labels


def test_every_order_as_applied(spark):
    rows, labels = sample(3)
    got = fa.filter_audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_no_rows(spark):
    assert fa.filter_audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_swaps_lead_through_all_orders(n):
    order = list(range(n))
    seen = {tuple(order)}
    for level in fa.adjacent_swaps(n):
        order[level], order[level + 1] = order[level + 1], order[level]
        seen.add(tuple(order))
    assert seen == set(permutations(range(n)))


def test_diagrams_share_and_keep_counts():
    random.seed(2)
    counts = {m: (random.randint(0, 3), random.randint(0, 1), 0) for m in range(32)}
    diagram = fa.Diagram([0, 1, 2, 3, 4], counts)
    whole = diagram.weight(diagram.root)
    assert whole == tuple(map(sum, zip(*counts.values())))
    for level in fa.adjacent_swaps(5):
        diagram.swap(level)
        assert diagram.weight(diagram.root) == whole
        assert diagram.root == fa.Diagram(diagram.order, counts).root
    empty = fa.Diagram([0, 1, 2, 3, 4], {})
    assert len({id(x) for x in empty._nodes.values()}) == 6
