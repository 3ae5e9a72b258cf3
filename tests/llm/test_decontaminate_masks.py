from itertools import combinations

import pytest

from sourcelake.llm import decontaminate as dc


def fits(masks, n, misses):
    """Whether some mask lies in ``n`` words with every miss outside its ones."""
    return any(all(not (0 <= x - at < len(m) and m[x - at] == "1") for x in misses) for m in masks for at in range(n - len(m) + 1))


def test_masks_fit_wherever_two_of_thirteen_words_differ():
    assert [x for x in combinations(range(13), 2) if not fits(dc.MASKS, 13, x)] == []


def found(spark, lengths):
    """The items of each length of which some placement of permitted misses goes unnoticed."""
    items, docs, owner = [], [], {}
    for n in lengths:
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for misses in combinations(range(n), n // 5):
            owner[len(docs)] = n
            docs.append((len(docs), " ".join(["own", "words", *("other" if i in misses else w for i, w in enumerate(words)), "end"])))
    out = dc.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), fuzzy=True)
    return {owner[r.doc_id] for r in out.collect() if list(r["items"]) != [owner[r.doc_id]]}


def test_overlaps_are_found_wherever_words_differ(spark):
    assert found(spark, [13, 14]) == set()


@pytest.mark.parametrize("n", range(1, 13))
def test_masks_of_short_items_fit_wherever_words_differ(n):
    assert [x for x in combinations(range(n), n // 5) if not fits(dc.item_masks(n, fuzzy=True), n, x)] == []


def test_short_items_are_found_wherever_words_differ(spark):
    assert found(spark, range(1, 13)) == set()
