import time

import pytest
from pyspark.sql import functions as F

from sourcelake.llm import pii


def added(text):
    return [(text[a:b], k) for a, b, k in pii.disguised(text, pii.plain(text))]


@pytest.mark.parametrize("source", [
    "jane AT corp DOT org", "Jane At Corp Dot Org", "jane at corp Punkt org", "jane at corp PUNKT org", "jane arroba corp Punto org", "jane arobase corp POINT org",
])
def test_signs_said_in_any_case(source):
    assert added(f"mail {source}, please") == [(source, "email")]


@pytest.mark.parametrize("source,kind", [
    ("jane@corp dot org", "email"),
    ("jane [at] corp dot org", "email"),
    ("jane at corp [dot] org", "email"),
    ("jane at mail.corp dot org", "email"),
    ("jane dot doe@corp dot org", "email"),
    ("+49 171 555 one two 34", "phone"),
    ("+49 171 55 five 12 34", "phone"),
    ("+4 nine 1 seven 1 five 5 five 1 two 3", "phone"),
    ("4111 1111 1111 11 one one", "card"),
    ("4111 1111 1111 111 one", "card"),
    ("192 dot 168 dot zero dot 1", "ip"),
    ("192.168.zero.1", "ip"),
    ("192 dot 168 dot 1 dot 5", "ip"),
    ("192.168 Punkt 1.5", "ip"),
    ("jane_at_corp_dot_org", "email"),
    ("jane_dot_doe_AT_mail.corp_DOT_org", "email"),
    ("jane dot q dot doe at mail dot corp dot org", "email"),
    ("jаne@corp.org", "email"),
    ("jane@corp.org dot uk", "email"),
])
def test_partial_disguises(source, kind):
    assert added(f"see {source}, please") == [(source, kind)]


@pytest.mark.parametrize("text", ["meet me (tomorrow) at example.com", "jane [x] at corp.org", "two 10 one 11", "at one. two. 3", "1.2 and 3.4", "look_at_start.jpg", "version 3 dot 5"])
def test_places_and_numbers_gain_nothing(text):
    assert added(text) == []


def test_long_dotted_runs_take_linear_time():
    assert added("x dot y " + "a." * 100_000 + " " + "1." * 100_000 + "one 2 " * 50_000) == []


@pytest.mark.parametrize("piece", ["a dot ", "a at ", "a at b dot ", "a_at_b_dot_", "a_dot_", "1 dot ", "one dot ", "a@b dot ", "@ at "])
def test_long_said_texts_take_linear_time(piece):
    text = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    pii.disguised(text, pii.plain(text))
    assert time.perf_counter() - start < 10


def test_a_megabyte_of_said_dots_takes_under_a_second():
    text = "a dot " * 170_000
    start = time.perf_counter()
    assert added(text) == [] and time.perf_counter() - start < 1


def test_a_widened_span_is_redacted_whole(spark):
    out = pii.pii_spans(spark.createDataFrame([(1, "write jаne@corp.org now")], "doc_id bigint, text string"))
    row = out.first()
    assert [(s.start, s.kind, s.end) for s in row.base] == [(8, 0, 19)] and [(s.start, s.kind, s.end) for s in row.added] == [(6, 0, 19)]
    both = out.select(F.array_sort(F.concat("base", "added")).alias("spans"), F.lit("write jаne@corp.org now").alias("text"))
    assert both.select(pii.redact(F.col("text"), F.col("spans"))).first()[0] == "write [email] now"
