import random
import re

import pytest
from pyspark.sql import functions as F

from sourcelake.llm import pii

SCHEMA = "doc_id bigint, text string, base string, kind int, start bigint"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    """The plain patterns, matched as they are written."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m)]
    return sorted(found)


def test_plain_spans_match_the_patterns():
    random.seed(3)
    for _ in range(4000):
        text = "".join(random.choices("a_@@..-+ 0123456789%(é", k=random.randint(0, 60)))
        got = sorted((a, pii.KINDS.index(k), b) for k, spans in pii.plain(text).items() for a, b in spans)
        assert got == brute(text), text
    for _ in range(300):
        digits = "".join(random.choices("0123456789", k=random.randint(12, 21)))
        text = random.choice(["x {} y", "{}"]).format(digits)
        assert sorted((a, pii.KINDS.index(k), b) for k, s in pii.plain(text).items() for a, b in s) == brute(text)


@pytest.mark.parametrize("text,kind,source", [
    ("mail jane [at] corp (dot) org now", "email", "jane [at] corp (dot) org"),
    ("mail jane.d at corp dot org now", "email", "jane.d at corp dot org"),
    ("é jane＠corp．org", "email", "jane＠corp．org"),
    ("x j​ane@cоrp.org", "email", "j​ane@cоrp.org"),
    ("call five five five, one two three, four five six seven!", "phone", "five five five, one two three, four five six seven"),
    ("call plus one 555 two three four 5678 ok", "phone", "plus one 555 two three four 5678"),
    ("pay ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
])
def test_disguises_map_back_to_the_source(text, kind, source):
    added = pii.disguised(text, pii.plain(text))
    assert [(text[a:b], k) for a, b, k in added] == [(source, kind)]


@pytest.mark.parametrize("text", [
    "look at that", "we met at noon. two or three dot", "meet me at example.com", "un deux trois", "café naïve", "plain a@b.co 10.0.0.1",
    "one two three four", "Привет мир", "[x] (y) {z}",
])
def test_clean_texts_gain_nothing(text):
    assert pii.disguised(text, pii.plain(text)) == []


def test_long_runs_take_linear_time():
    text = "a" * 200_000 + "@x " + "1" * 200_000 + " " + "+1" * 50_000 + "@" * 50_000
    assert pii.plain(text)["email"] == []


def test_rows(spark):
    texts = ["a@b.co é 1.2.3.4", None, "", "x jane [at] corp [dot] org a@b.co"]
    docs = spark.createDataFrame([(i, t, "", 1, 2) for i, t in enumerate(texts)] + [(None, "z@z.zz", "", 0, 0)] * 2, SCHEMA)
    out = pii.pii_spans(docs).select(
        "doc_id", pii.span_list(F.col("base")).alias("b"), pii.span_list(F.col("added")).alias("a"), pii.count_kind(F.col("base"), 0).alias("n")
    )
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([
        (0, "email:0:6,ip:9:16", "", 1), (1, "", "", 0), (2, "", "", 0), (3, "email:27:33", "email:2:26", 1),
        (None, "email:0:6", "", 1), (None, "email:0:6", "", 1),
    ], key=repr)
    assert pii.pii_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    masked = pii.pii_spans(docs).where("doc_id = 3").join(docs.select("doc_id", "text"), "doc_id").select(
        pii.redact(F.col("text"), F.array_sort(F.concat("base", "added")))
    )
    assert masked.first()[0] == "x [email] [email]"
