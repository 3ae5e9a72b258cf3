import random

from sourcelake.llm import decontaminate as dc

SCHEMA = "doc_id bigint, text string, item_id string, pos int, dk string"
EDGES = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def words(text):
    return [w.strip(EDGES) for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").split()]


def overlap(doc, item):
    """Most words of ``item`` in agreeing stretches, over all shifts that share a seed."""
    masks = [m for m in dc.MASKS if len(m) <= len(item)]
    if len(item) < max(map(len, dc.MASKS)):
        masks.append("1" * len(item))
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
        inside = [0 <= i + shift < len(doc) for i in range(len(item))]
        hit = any(
            all(inside[p + i] and (s == "0" or same[p + i]) for i, s in enumerate(m)) for m in masks for p in range(len(item) - len(m) + 1)
        )
        width = min(dc.MIN_WORDS, len(item))
        if hit and item:
            covered = set()
            for p in range(len(item) - width + 1):
                if all(inside[p:p + width]) and sum(same[p:p + width]) >= dc.AGREEMENT * width - 1e-9:
                    covered |= set(range(p, p + width))
            best = max(best, len(covered))
    return best


def sample(seed):
    random.seed(seed)
    vocabulary = ["the", "of", "Zürich", "an", "x", "water", "on", "1", "go", "red", "ta", "ki"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([1, 3, 9, 12, 20, 60])))) for i in range(14)] + [(20, None), (21, ""), (3, "the of")]
    docs = []
    for i in range(80):
        body = random.choices(vocabulary, k=random.randint(0, 60))
        if i % 2:
            part = (random.choice(items)[1] or "").split()
            part = part[random.randint(0, 3):]
            for _ in range(random.randint(0, 4)):
                if part:
                    part[random.randrange(len(part))] = "other"
            at = random.randint(0, len(body))
            body[at:at] = part
        docs.append((i, random.choice([" ", "\n", ", "]).join(body).upper(), "s", 1, "k"))
    return docs + [(None, None, None, None, None), (None, docs[1][1], "", 0, ""), docs[1], docs[1], (99, "", "", 0, "")], items


def test_overlaps_match_plain_comparison(spark):
    docs, items = sample(1)
    out = dc.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted(((r.doc_id, r.contaminated, list(r.items), r.words) for r in out.collect()), key=repr)
    want = []
    for doc_id, text, *_ in docs:
        found = {}
        for item_id, item in items:
            n = overlap(words(text), words(item))
            if n:
                found[item_id] = max(n, found.get(item_id, 0))
        want.append((doc_id, bool(found), sorted(found), max(found.values(), default=0)))
    assert sum(w[1] for w in want) > 20
    assert got == sorted(want, key=repr)


def any_overlap(doc, item):
    """Most words of ``item`` in agreeing stretches over all shifts, whatever seeds they share."""
    best, width = 0, min(dc.MIN_WORDS, len(item))
    for shift in range(-len(item) + 1, len(doc) if item else 0):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
        covered = set()
        for p in range(max(0, -shift), min(len(item), len(doc) - shift) - width + 1):
            if sum(same[p:p + width]) >= dc.AGREEMENT * width - 1e-9:
                covered |= set(range(p, p + width))
        best = max(best, len(covered))
    return best


def test_overlaps_wherever_words_differ(spark):
    docs, items = sample(4)
    out = dc.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"), fuzzy=True)
    got = sorted(((r.doc_id, r.contaminated, list(r.items), r.words) for r in out.collect()), key=repr)
    want = []
    for doc_id, text, *_ in docs:
        found = {}
        for item_id, item in items:
            n = any_overlap(words(text), words(item))
            if n:
                found[item_id] = max(n, found.get(item_id, 0))
        want.append((doc_id, bool(found), sorted(found), max(found.values(), default=0)))
    assert sum(w[1] for w in want) > 20
    assert got == sorted(want, key=repr)


def test_a_seed_of_many_items_and_documents(spark):
    phrase = "these eight words are in every single text"
    items = [(i, phrase + " " + " ".join(f"item{i}word{k}" for k in range(12))) for i in range(150)]
    docs = [(i, f"start {i} {phrase} " + " ".join(f"doc{i}word{k}" for k in range(12)), "s", 1, "k") for i in range(300)]
    docs.append((300, " . ".join(text for _, text in items), "s", 1, "k"))
    out = dc.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"), fuzzy=True)
    assert [(r.doc_id, list(r.items), r.words) for r in out.where("contaminated").collect()] == [(300, list(range(150)), 20)]


def test_documents_are_dropped_whole(spark, rows):
    docs, items = sample(2)
    frame, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    clean = [r.doc_id for r in dc.contamination(frame, bench).where("not contaminated").collect()]
    left = dc.drop_contaminated(frame, bench)
    assert left.columns == frame.columns and sorted([r.doc_id for r in left.collect()], key=repr) == sorted(clean, key=repr)


def test_no_rows(spark):
    docs, items = sample(3)
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert dc.contamination(none, bench).count() == 0
    assert dc.contamination(some, bench.limit(0)).where("contaminated").count() == 0
