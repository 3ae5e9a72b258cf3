"""Secrets in whole texts: known shapes, and strings that pass a battery of randomness tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelake.llm.keys import whole_text
from sourcelake.session import materialize

KINDS = ("assign", "access", "hex", "random")

# The shapes.  The runs of "access" and "hex" are as long as they can be, so
# asking for the length in the pattern finds just those that a later look at the length would keep.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}+"
_HEX = r"[0-9a-f]{24,}+"
_CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}+"

#: Encodings from narrow to wide: the signs, and what a string of it looks like.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", "^([0-9a-f]+|[0-9A-F]+)$"),
    ("base32", _UPPER + "234567", "^[A-Z2-7]+$"),
    ("lower", _LOWER, "^[a-z]+$"),
    ("base36", _DIGITS + _LOWER, "^([0-9a-z]+|[0-9A-Z]+)$"),
    ("letters", _LOWER + _UPPER, "^[A-Za-z]+$"),
    ("base62", _DIGITS + _LOWER + _UPPER, "^[0-9A-Za-z]+$"),
    ("base64", _DIGITS + _LOWER + _UPPER + "+/", ""),
)
FOLDED = ("hex", "base36")
#: Running text that every corpus is taken to hold besides its own.
RUNNING_TEXT = (
    "A secret is a string that only its owner should know, and it is drawn by a machine so that nobody can guess it from "
    "the signs that came before. Words are not like that: some letters come far more often than others, and the next one "
    "can mostly be told from the last.",
    "People write names for their files, headings for their pages and long compounds for the things that they work with, and "
    "these may be as long as a key without being one. Whoever looks for keys has to know how such running text behaves when "
    "it is measured in the same way.",
    "The shorter a string is the less can be said about it, for chance alone makes a few letters look even or uneven. "
    "Therefore each length has its own measure, and what cannot be told from writing at that length is left where it stands.",
)
#: Signs of the shortest string that is tested.
LEAST = 16
#: ``-log10 p`` is counted in steps of one in so many, up to a bound.
STEPS, MOST = 50, 60
#: Random strings depart by 2 on average and by more than this about once in a thousand times.
NOT_RANDOM = 6.0


def _finds(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(found: Column, between: Column, kind: int) -> Column:
    """Each find with the length of the text between it and the one before."""
    rows = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda hit, before: F.struct(hit.alias("hit"), before.alias("before")))

    def place(r: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(r["before"]).cast("bigint").alias("gap"), r["hit"].alias("hit"))

    return F.when(F.size(found) > 0, F.transform(rows, place))


def _scan(docs: DataFrame) -> DataFrame:
    """``row, doc_id, finds`` for every row, in one reading of the texts."""
    patterns = (_ASSIGN, _ACCESS, _HEX, _CANDIDATE)
    text = F.col("_text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("_text"))
    rows = rows.select("row", "doc_id", "_text", *[_finds(text, p).alias(f"_f{k}") for k, p in enumerate(patterns)])
    cut = [F.when(F.size(f"_f{k}") > 0, F.split(text, p, -1)).alias(f"_b{k}") for k, p in enumerate(patterns)]
    rows = rows.select("row", "doc_id", *[f"_f{k}" for k in range(len(patterns))], *cut)
    placed = [F.coalesce(_placed(F.col(f"_f{k}"), F.col(f"_b{k}"), k), F.array().cast(_FINDS)) for k in range(len(patterns))]
    return rows.select("row", "doc_id", F.concat(*placed).alias("finds"))


_FINDS = "array<struct<kind:int,i:int,gap:bigint,hit:string>>"


def _spans(scanned: DataFrame) -> DataFrame:
    """Finds with their place: ``row, kind, start, end, hit``."""
    finds = scanned.where(F.size("finds") > 0).select("row", F.explode("finds").alias("f")).select("row", "f.*")
    length = F.char_length("hit").cast("bigint")
    end = F.sum(F.col("gap") + length).over(Window.partitionBy("row", "kind").orderBy("i"))
    placed = finds.withColumn("end", end).withColumn("start", F.col("end") - length)
    long_enough = (F.col("kind") != 0) | (F.char_length(F.regexp_extract("hit", _ASSIGN, 2)) >= 6)
    return placed.where(long_enough).select("row", "kind", "start", "end", "hit")


# --- the battery --------------------------------------------------------------


def encoding(string: Column) -> Column:
    """The narrowest encoding that has all signs of ``string``; NULL for plain numbers."""
    found = F.lit(len(ENCODINGS) - 1)
    for k, (_, _, shape) in reversed(list(enumerate(ENCODINGS[:-1]))):
        found = F.when(string.rlike(shape), F.lit(k)).otherwise(found)
    return F.when(~string.rlike("^[0-9]+$"), found)


def _codes(string: Column, code: Column) -> Column:
    """Each sign's place in the alphabet of encoding ``code``, from 1; 0 if it is not in it."""
    folded = F.when(code.isin(*[k for k, e in enumerate(ENCODINGS) if e[0] in FOLDED]), F.lower(string)).otherwise(string)
    alphabet = F.element_at(F.array(*[F.lit(e[1]) for e in ENCODINGS]), code + 1)
    return F.transform(F.split(F.translate(folded, "-_", "+/"), ""), lambda c: F.instr(alphabet, c))


def departure(codes: Column, symbols: Column) -> Column:
    """How far a string is from random signs of an alphabet of ``symbols``: the
    sum of what chi-squared uniformity, the runs test about the alphabet's
    middle and the serial correlation depart from it, each in its standard
    deviations.  About 2 for random strings at any length."""
    n = F.size(codes).cast("double")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "sum", "square", "cross", "high", "turns", "seen")])

    def step(s: Column, code: Column) -> Column:
        x = code.cast("double")
        high = lambda v: (v * 2 > symbols).cast("double")
        return F.struct(
            x.alias("x"), (s["sum"] + x).alias("sum"), (s["square"] + x * x).alias("square"), (s["cross"] + s["x"] * x).alias("cross"),
            (s["high"] + high(x)).alias("high"), (s["turns"] + s["seen"] * F.abs(high(x) - high(s["x"]))).alias("turns"), F.lit(1.0).alias("seen"),
        )

    tally = F.struct(F.lit(-1).alias("x"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"))

    def count(s: Column, code: Column) -> Column:
        run = F.when(s["x"] == code, s["run"] + 1).otherwise(F.lit(1.0))
        return F.struct(code.alias("x"), run.alias("run"), (s["squares"] + 2 * run - 1).alias("squares"))

    s = F.aggregate(codes, zero, step)
    chi = symbols / n * F.aggregate(F.array_sort(codes), tally, count)["squares"] - n
    z_chi = (chi - (symbols - 1)) / F.sqrt(2 * (symbols - 1) * (1 - 1 / n))
    mean = s["sum"] / n
    ends = F.element_at(codes, 1) + F.element_at(codes, -1)
    spread = s["square"] - n * mean * mean
    serial = (s["cross"] - mean * (2 * s["sum"] - ends) + (n - 1) * mean * mean) / spread
    z_serial = F.when(spread > 1e-9, (serial + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    both = 2 * s["high"] * (n - s["high"])
    variance = both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(variance > 1e-9, (s["turns"] - both / n) / F.sqrt(variance)).otherwise(F.sqrt(n))
    return F.greatest(z_chi, F.lit(0.0)) + F.abs(z_runs) + F.abs(z_serial)


def _log_tail(z: Column) -> Column:
    """``-log10`` of the standard normal's lower tail at ``z``, by a rational approximation of its ratio to the density."""
    x = F.greatest(-z, F.lit(0.0))
    mills = 2 / (x + F.sqrt(x * x + 8 / 3.141592653589793))
    density = x * x / 2 + 0.5 * 1.8378770664093453
    return F.when(z >= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (density - F.log(mills)) / 2.302585092994046))


def _band(length: Column) -> Column:
    """Half-octave of a length."""
    return F.floor(2 * F.log2(length)).cast("int")


def _symbols(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(len(e[1]))) for e in ENCODINGS]), code + 1)


def running_text(docs: DataFrame, strata: list[tuple[int, int]]) -> DataFrame:
    """``_code, _band, _k, _m, _sd``: how running text departs from randomness
    in the encodings and bands of ``strata``.

    Every document gives one decoy for each encoding: as many of its letters
    from some place, without its candidates, as strings of one of the bands
    have, which is drawn by a hash of the text; all its letters if it has
    fewer.  Decoys are in the case of their encoding, and their words are joined
    by a hyphen in the one that has such signs.  :data:`RUNNING_TEXT` counts as
    further documents."""
    spark = docs.sparkSession
    texts = docs.select(whole_text().alias("text")).union(spark.createDataFrame([(t,) for t in RUNNING_TEXT], "text string"))
    prose = F.regexp_replace("text", _CANDIDATE, " ")
    bare, joined = (F.regexp_replace(prose, "[^A-Za-z0-9]++", sign) for sign in ("", "-"))
    wide = any(ENCODINGS[code][0] == "base64" for code, _ in strata)
    rows = texts.select(F.xxhash64("text").alias("_h"), bare.alias("bare"), (joined if wide else F.lit("")).alias("joined"))

    def decoy(code: int) -> Column:
        letters = F.col("joined" if ENCODINGS[code][0] == "base64" else "bare")
        sizes = F.array(*[F.lit(int(2 ** ((2 * band + 1) / 4))) for c, band in strata if c == code])
        drawn = F.element_at(sizes, (F.pmod(F.xxhash64("_h", F.lit(code)), F.size(sizes)) + 1).cast("int"))
        size = F.least(drawn, F.char_length(letters))
        start = F.pmod(F.xxhash64("_h", F.lit(-1 - code)), F.char_length(letters) - size + 1).cast("int")
        part = F.substring(letters, start + 1, size)
        cased = {"base32": F.upper, "lower": F.lower}.get(ENCODINGS[code][0], lambda x: x)(part)
        return F.struct(F.lit(code).alias("_code"), cased.alias("decoy"))

    each = F.array(*map(decoy, sorted({code for code, _ in strata})))
    found = rows.select(F.explode_outer(each).alias("x")).select("x.*").where(F.char_length("decoy") >= LEAST)
    apart = departure(_codes(F.col("decoy"), F.col("_code")), _symbols(F.col("_code")))
    found = found.select("_code", _band(F.char_length("decoy")).alias("_band"), apart.alias("_d"))
    return found.groupBy("_code", "_band").agg(F.count("_d").alias("_k"), F.avg("_d").alias("_m"), F.stddev("_d").alias("_sd"))


def random_strings(candidates: DataFrame, docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Those rows of ``candidates`` (``hit`` and others) whose ``hit`` is a random string.

    A candidate's departure from randomness in its own encoding is held
    against that of running text of all ``docs`` (:func:`running_text`) in the same
    encoding and band of length, since short strings tell less; the chance that
    running text lies as near to random is the candidate's p.  Where no two
    texts are as long, the longest band below that has two decoys counts, or
    the shortest above, or else one with a single decoy, so that every candidate is tested; short text departs
    less than long text, which makes p larger.  In each stratum
    the false discovery rate is
    held at ``rate`` by the step-up rule of Benjamini and Hochberg, over counts
    of p in fixed steps: a table of bounded size.  What departs by more than
    :data:`NOT_RANDOM` fails the battery whatever the corpus."""
    hit = F.regexp_replace("hit", "=+$", "")
    rows = candidates.withColumn("_hit", hit).withColumn("_code", encoding(F.col("_hit")))
    rows = rows.where(F.col("_code").isNotNull() & (F.char_length("_hit") >= LEAST))
    rows = rows.withColumn("_s", departure(_codes(F.col("_hit"), F.col("_code")), _symbols(F.col("_code"))))
    rows = materialize(rows.withColumn("_band", _band(F.char_length("_hit"))).drop("_hit"), "candidates")
    stratum = ["_code", "_band"]
    # Encodings times half-octaves: a few hundred at most.
    strata = sorted((r._code, r._band) for r in rows.select(*stratum).distinct().collect())
    if not strata:
        return candidates.where("false")
    null = materialize(running_text(docs, strata), "null")
    own = rows.sparkSession.createDataFrame(strata, "_code int, _band int")
    nearest = F.max_by(F.struct("_m", "_sd"), F.struct(F.col("_k") >= 2, F.col("n._band") <= F.col("o._band"), -F.abs(F.col("n._band") - F.col("o._band"))))
    null = own.alias("o").join(null.alias("n"), F.col("o._code") == F.col("n._code")).groupBy("o._code", "o._band").agg(nearest.alias("_null"))
    null = F.broadcast(materialize(null.select("_code", "_band", "_null.*"), "nulls"))
    z = (F.col("_s") - F.col("_m")) / F.greatest(F.col("_sd"), F.lit(0.5))
    step = F.floor(F.least(_log_tail(z), F.lit(float(MOST))) * STEPS).cast("int")
    judged = rows.join(null, stratum).withColumn("_step", step)
    counts = judged.groupBy(*stratum, "_step").agg(F.count("*").alias("_n"))
    from_top = Window.partitionBy(*stratum).orderBy(F.desc("_step"))
    counts = counts.withColumn("_rank", F.sum("_n").over(from_top)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*stratum)))
    passing = F.pow(F.lit(10.0), -F.col("_step") / F.lit(float(STEPS))) * F.col("_all") <= F.lit(rate) * F.col("_rank")
    least = counts.where(passing).groupBy(*stratum).agg(F.min("_step").alias("_least"))
    least = F.broadcast(materialize(least, "thresholds"))
    return judged.join(least, stratum).where((F.col("_step") >= F.col("_least")) & (F.col("_s") <= NOT_RANDOM)).select(*candidates.columns)


def secret_spans(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` for every row: arrays of
    ``(start, kind, end)`` in code points, end exclusive, ``kind`` an index into
    :data:`KINDS`, sorted.

    ``base`` holds the known shapes, ``added`` the random strings of 20 signs
    and more (:func:`random_strings`) that lie in no base span.  Finds are laid
    out by the lengths of what lies between them.  NULL counts as empty; an
    empty table gives no rows; rows that repeat are each reported; other
    columns are ignored."""
    scanned = materialize(_scan(docs), "scanned")
    spans = materialize(_spans(scanned), "spans")
    span = F.struct("start", "kind", "end")
    base = spans.where("kind < 3").select("row", span.alias("base"), F.lit(None).cast(_SPAN).alias("added"))
    extra = random_strings(spans.where("kind = 3"), docs, rate).select("row", F.lit(None).cast(_SPAN).alias("base"), span.alias("added"))
    by_row = base.union(extra).groupBy("row").agg(F.array_sort(F.collect_list("base")).alias("base"), F.array_sort(F.collect_list("added")).alias("added"))
    outside = lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    by_row = by_row.select("row", "base", F.filter("added", outside).alias("added"))
    none = F.array().cast(f"array<{_SPAN}>")
    return scanned.select("row", "doc_id").join(by_row, "row", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added")
    )


_SPAN = "struct<start:bigint,kind:int,end:bigint>"
