import base64
import math
import random
import re

from pyspark.sql import functions as F

from sourcelake.llm import secrets

SCHEMA = "doc_id bigint, text string, hit string, row string, kind int"


def brute(text):
    rules = (
        (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m))


def pieces(seed, n):
    random.seed(seed)
    parts = ["token", "Secret", "API_KEY", "apikey", "password", "paſſwd", " = ", ":", "'", '"', " ", "=", "é🙂", "abc", "abcdef", "AKIA", "AKIAAKIA",
             "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "x.y", "-"]
    return [(i, "".join(random.choices(parts, k=random.randint(0, 14))), "h", "r", 1) for i in range(n)]


def test_base_spans_match_the_patterns(spark):
    data = pieces(1, 800) + [(None, None, None, None, None), (None, "", "", "", 0), (5, "token=abcdefg", "", "", 0), (5, "token=abcdefg", "", "", 0)]
    out = secrets.secret_spans(spark.createDataFrame(data, SCHEMA)).select("doc_id", "base").collect()
    got = sorted(((r.doc_id, [(s.start, s.kind, s.end) for s in r.base]) for r in out), key=repr)
    assert got == sorted(((r[0], brute(r[1])) for r in data), key=repr)


def test_departure_is_the_three_tests(spark):
    random.seed(2)
    codes = [[random.randint(1, 16) for _ in range(random.randint(16, 60))] for _ in range(50)]

    def want(x, k=16.0):
        n, mean = len(x), sum(x) / len(x)
        chi = sum((x.count(c) - n / k) ** 2 / (n / k) for c in range(1, 17))
        z = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))
        spread = sum((v - mean) ** 2 for v in x)
        serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / spread
        high = [2 * v > k for v in x]
        n1 = sum(high)
        n2, runs = n - n1, 1 + sum(a != b for a, b in zip(high, high[1:]))
        mu = 2 * n1 * n2 / n + 1
        var = (mu - 1) * (2 * n1 * n2 - n) / (n * (n - 1))
        return max(z, 0) + abs((runs - mu) / math.sqrt(var)) + abs((serial + 1 / n) * math.sqrt(n))

    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c array<int>")
    got = {r.i: r.s for r in df.select("i", secrets.departure(F.col("c"), F.lit(16.0)).alias("s")).collect()}
    assert all(abs(got[i] - want(c)) < 1e-6 for i, c in enumerate(codes))


def test_random_strings_are_told_from_words(spark):
    random.seed(4)
    syllables = ["an", "the", "ti", "on", "er", "ing", "sh", "or", "ed", "re"]
    word = lambda k: "".join(random.choices(syllables, k=k))
    data, planted = [], set()
    for i in range(400):
        text = " ".join(word(random.randint(1, 4)) for _ in range(40)) + " " + word(12) + " " + "-".join(word(3) for _ in range(6)) + " end"
        if i % 4 == 0:
            text += " key " + base64.b64encode(random.randbytes(30)).decode() + " x"
            planted.add(i)
        data.append((i, text, "", "", 0))
    out = secrets.secret_spans(spark.createDataFrame(data, SCHEMA)).where(F.size("added") > 0)
    found = {r.doc_id for r in out.collect()}
    assert len(found & planted) >= 0.9 * len(planted) and len(found - planted) <= 0.02 * len(found)


def words_of(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "the", "ti", "on", "er", "ing", "sh", "or", "ed", "re", "lo", "mi", "us"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def test_one_rare_key_is_tested(spark):
    key = base64.b32encode(random.Random(7).randbytes(35)).decode()
    assert len(key) == 56
    texts = [words_of(800, i) for i in range(300)] + [words_of(400, 300) + f" {key} " + words_of(400, 301)]
    out = secrets.secret_spans(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)).where(F.size("added") > 0).collect()
    at = texts[300].index(key)
    assert [(r.doc_id, [(s.start, s.kind, s.end) for s in r.added]) for r in out] == [(300, [(at, 3, at + 56)])]


def test_strings_without_text_of_their_length_are_tested(spark):
    rng = random.Random(8)
    blob = base64.b64encode(rng.randbytes(30_000)).decode()
    alone = "".join(rng.choices(secrets.ENCODINGS[5][1], k=90))
    texts = [blob, alone, "abcdefghijklmnop" * 40, "a" * 300]
    out = secrets.secret_spans(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.doc_id for r in out if r.added} == {0, 1}


def test_every_encoding_has_a_null(spark):
    strata = [(code, band) for code in range(len(secrets.ENCODINGS)) for band in (8, 12, 30)]
    rows = secrets.running_text(spark.createDataFrame([], SCHEMA), strata).collect()
    assert {r._code for r in rows if r._k >= 1} == set(range(len(secrets.ENCODINGS))) and all(8 <= r._band <= 30 for r in rows)


def test_no_rows_and_long_texts(spark):
    assert secrets.secret_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "0123456789abcdef" * 3 + " "
    out = secrets.secret_spans(spark.createDataFrame([(1, long * 5000, "", "", 0)], SCHEMA)).first()
    assert [(s.start, s.kind, s.end) for s in out.base] == brute(long * 5000)
