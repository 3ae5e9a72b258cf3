"""Quality by co-training: one classifier reads the text, another what is known of the page."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelake.llm.keys import whole_text, without
from sourcelake.session import materialize

#: The models are fitted on about so many labelled rows at most, drawn by hash, and
#: on all unlabelled rows that a view is sure of.
MAX_LABELLED = 16_000
ROUNDS = 3
#: A view hands over rows whose calibrated chance is this near to 0 or 1; together
#: they weigh so many times what the labelled rows do, however many they are.
CONFIDENT = 0.02
PSEUDO_SHARE = 1.0
#: Documents whose combined score is below are rejected.
KEEP_FROM = 0.5

TRIGRAMS, LANGS, SOURCES = 128, 8, 16
TEXT_SIZE, META_SIZE = TRIGRAMS + 2, 10 + LANGS + SOURCES
_CHUNK = 1 << 20
_BLOCK = 4096
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = False


def _slot(value: str | None, size: int) -> int:
    return xxhash.xxh64_intdigest((value or "").encode(), 5) % size


def text_view(text: bytes) -> np.ndarray:
    """Shares of hashed byte trigrams, as square roots, of words that repeat
    the one before, and of different words."""
    codes = np.frombuffer(text, np.uint8)
    counts = np.zeros(TRIGRAMS)
    for at in range(0, max(len(codes) - 2, 0), _CHUNK):
        c = codes[at:at + _CHUNK + 2].astype(np.uint32)
        h = c[:-2] * np.uint32(2654435761) + c[1:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
        counts += np.bincount((h ^ h >> np.uint32(15)) * np.uint32(668265263) >> np.uint32(25), minlength=TRIGRAMS)
    words = text.split()
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words))
    different = np.log1p(len(set(words))) / np.log1p(max(1, len(words)))
    return np.concatenate((np.sqrt(counts / max(1, counts.sum())), [again, different])).astype(np.float32)


def meta_view(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """Length, layout, the shares of kinds of signs, language and source."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, lines = max(1, len(text)), text.split(b"\n")
    widths = list(map(len, lines))
    known = [
        np.log1p(len(text)), np.log1p(len(lines)), np.log1p(np.mean(widths)), np.log1p(max(widths)), len(set(lines)) / len(lines),
        *(counts[kind].sum() / n for kind in (_UPPER, _DIGIT, _SPACE, _SIGN)), counts[128:].sum() / n,
    ]
    out = np.zeros(META_SIZE, np.float32)
    out[:10] = known
    out[10 + _slot(lang, LANGS)] = 1
    out[10 + LANGS + _slot(source, SOURCES)] = 1
    return out


def views(docs: DataFrame) -> DataFrame:
    """``doc_id, dk, text_view, meta_view`` for every row; ``dk`` is the text's hash."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            a = [text_view(t) for t in texts]
            b = [meta_view(t, x, y) for t, x, y in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("dk"), _lists(a, TEXT_SIZE), _lists(b, META_SIZE)], ["doc_id", "dk", "text_view", "meta_view"]
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole_text()).alias("dk"), whole_text().cast("binary").alias("text"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
    )
    return rows.mapInArrow(measure, "doc_id bigint, dk bigint, text_view array<float>, meta_view array<float>")


def _lists(rows: list[np.ndarray], size: int, kind: pa.DataType = pa.float32()) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.empty(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(flat, kind))


# --- the models ---------------------------------------------------------------


@dataclass(frozen=True)
class View:
    """A logistic model over standardised features, with a calibrating line over its logits."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        raw = [np.clip(block @ self.weights, -20, 20) for block in _blocks(x, self.mean, self.scale)]
        return self.slope * np.concatenate([np.empty(0), *raw]) + self.shift


def _blocks(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Iterator[np.ndarray]:
    """Standardised rows with a column of ones, some at a time."""
    for at in range(0, len(x), _BLOCK):
        rows = (x[at:at + _BLOCK] - mean) / scale
        yield np.hstack((rows, np.ones((len(rows), 1))))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def newton_sums(x: np.ndarray, view: View, y: np.ndarray) -> np.ndarray:
    """What a Newton step of a logistic model needs of its rows, in one flat array
    that adds up: the bend of the loss, its pull, the loss and the number of rows."""
    size = x.shape[1] + 1
    bend, pull, loss, at = np.zeros((size, size)), np.zeros(size), 0.0, 0
    for rows in _blocks(x, view.mean, view.scale):
        z, said = rows @ view.weights, y[at:at + len(rows)]
        p = sigmoid(z)
        bend += (rows * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ rows
        pull += rows.T @ (said - p)
        loss += float(np.sum(np.logaddexp(0, z) - said * z))
        at += len(rows)
    return np.concatenate((bend.ravel(), pull, [loss, at]))


def _descend(view: View, sums: Callable[[View], np.ndarray], penalty: float) -> Iterator[View]:
    """The view after each Newton step, until steps are small.  A step after which the
    loss is higher is halved."""
    size = len(view.weights)
    ridge = np.full(size, penalty)
    ridge[-1] = 1e-6
    best, least, move = view, np.inf, np.zeros(size)
    for _ in range(30):
        total = sums(view)
        loss = total[-2] + 0.5 * ridge @ view.weights**2
        if loss <= least + 1e-9 * abs(least) or np.isinf(least):
            bend, pull = total[:size * size].reshape(size, size), total[size * size:-2]
            best, least = view, loss
            move = np.linalg.solve(bend + np.diag(ridge), pull - ridge * view.weights)
        else:
            move = move / 2
        view = replace(best, weights=best.weights + move)
        yield view
        if np.abs(move).max() < 1e-4:
            return
    yield best


def calibrated(view: View, held_x: np.ndarray, held_y: np.ndarray) -> View:
    """The view with a line over its logits that fits rows held out."""
    view = replace(view, slope=1.0, shift=0.0)
    if 0 < held_y.sum() < len(held_y):
        z = view.logits(held_x)[:, None]
        *_, line = _descend(View(np.zeros(1), np.ones(1), np.zeros(2)), lambda v: newton_sums(z, v, held_y), 0.1)
        view = replace(view, slope=max(float(line.weights[0]), 0.05), shift=float(line.weights[1]))
    return view


# --- the exchange -------------------------------------------------------------

Pair = tuple[View, View]


def exchange_sums(rows: tuple[np.ndarray, np.ndarray], teachers: Pair, learners: Pair) -> np.ndarray:
    """Both learners' :func:`newton_sums` over the rows that the other view's teacher is sure of."""
    found = []
    for x, other, teacher, learner in zip(rows, rows[::-1], teachers[::-1], learners, strict=True):
        p = sigmoid(teacher.logits(other))
        sure = (p <= CONFIDENT) | (p >= 1 - CONFIDENT)
        found.append(newton_sums(x[sure], learner, (p[sure] > 0.5).astype(float)))
    return np.concatenate(found)


def moments(rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of both views' features, then of their squares."""
    wide = [x.astype(np.float64) for x in rows]
    return np.concatenate([x.sum(axis=0) for x in wide] + [np.square(x).sum(axis=0) for x in wide])


def co_train(
    labelled: tuple[np.ndarray, np.ndarray, np.ndarray],
    spread: list[tuple[np.ndarray, np.ndarray]],
    pool: Callable[[Pair, Pair], np.ndarray],
    rounds: int = ROUNDS,
) -> Pair | None:
    """The text and the page view after ``rounds`` of exchange, or None if the
    labels are not of both kinds.

    ``spread`` is the mean and the scale of each view's features, ``pool`` gives
    :func:`exchange_sums` over all unlabelled rows.  A fifth of the labelled rows is
    held out for calibration.  Both views are fitted on the others; then, in each
    round, again on them and on the rows that the other view was sure of before."""
    *known, y = labelled
    held = np.arange(len(y)) % 5 == 0
    if not 0 < y[~held].sum() < (~held).sum():
        return None
    own = [lambda v, x=x[~held]: newton_sums(x, v, y[~held]) for x in known]
    views = []
    for (mean, scale), sums in zip(spread, own, strict=True):
        *_, fitted = _descend(View(mean, scale, np.zeros(len(mean) + 1)), sums, 3.0)
        views.append(fitted)
    views = [calibrated(v, x[held], y[held]) for v, x in zip(views, known, strict=True)]
    for _ in range(rounds):
        views = _learn(tuple(views), own, pool)
        views = [calibrated(v, x[held], y[held]) for v, x in zip(views, known, strict=True)]
    return views[0], views[1]


def _learn(teachers: Pair, own: list[Callable[[View], np.ndarray]], pool: Callable[[Pair, Pair], np.ndarray]) -> list[View]:
    """Both views fitted anew side by side, so that a step of both reads the pool once."""
    learners, split = list(teachers), (len(teachers[0].weights) + 1) * len(teachers[0].weights) + 2
    now: list[np.ndarray] = []

    def both(i: int) -> Callable[[View], np.ndarray]:
        def total(view: View) -> np.ndarray:
            mine = own[i](view)
            return mine + now[i] * (PSEUDO_SHARE * mine[-1] / max(1.0, now[i][-1]))

        return total

    steps = [_descend(view, both(i), 3.0) for i, view in enumerate(learners)]
    moving = [True, True]
    while any(moving):
        sums = pool(teachers, (learners[0], learners[1]))
        now[:] = sums[:split], sums[split:]
        for i in (0, 1):
            after = next(steps[i], None) if moving[i] else None
            moving[i] = after is not None
            learners[i] = after or learners[i]
    return learners


#: Sums over rows are added as whole multiples of their number over this, so that
#: their order, and tasks that run twice, make no difference.
_GRAIN = 2.0**40


def _added(rows: DataFrame, count: int, of: Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray]) -> np.ndarray:
    """``of`` over all ``rows``: a task adds up its own, Spark the tasks', slot by slot."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(of(_both(batch)) for batch in batches if batch.num_rows)
        if not np.isscalar(total):
            whole = np.rint(total / count * _GRAIN).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_lists([whole], len(whole), pa.int64())], ["sums"])

    slots = rows.mapInArrow(part, "sums array<bigint>").select(F.posexplode("sums").alias("slot", "sum"))
    found = slots.groupBy("slot").agg(F.sum("sum").alias("sum")).toArrow()
    return found["sum"].to_numpy()[np.argsort(found["slot"].to_numpy())] / _GRAIN * count


def _both(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_flat(batch.column(name)).reshape(-1, size) for name, size in (("text_view", TEXT_SIZE), ("meta_view", META_SIZE)))


def _spread(rows: DataFrame, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and scale of every feature over all rows."""
    sums = _added(rows, count, moments) / count
    mean, square = np.split(sums, 2)
    scale = np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 1e-3)
    return [(mean[:TEXT_SIZE], scale[:TEXT_SIZE]), (mean[TEXT_SIZE:], scale[TEXT_SIZE:])]


def _drawn(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both views and ``y`` of about ``most`` rows at most, drawn by a hash of id
    and text, in an order that does not depend on where they lie."""
    total = rows.count()
    part = F.pmod(F.xxhash64("doc_id", "dk"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, total)))
    found = rows.where(part).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "dk", "text_view", "meta_view", "y").toArrow().combine_chunks()
    order = np.lexsort((found["doc_id"].to_numpy(), found["dk"].to_numpy()))
    text, meta = _both(found)
    return text[order], meta[order], found["y"].to_numpy()[order]


def _flat(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False)


def quality_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, dk, p_text, p_meta, score, keep`` for every row of ``docs``
    (``doc_id, text, lang, source``), by views co-trained on ``labels``
    (``doc_id, quality``).

    Features of all rows are written once.  Models are fitted on a bounded sample of
    the labelled rows (:data:`MAX_LABELLED`) and on all unlabelled ones, of which a step
    needs sums only; then every row is scored: ``score`` is the chance at the mean of
    both calibrated logits, and rows from :data:`KEEP_FROM` are kept.

    NULL text counts as empty, NULL language and source as values of their own;
    rows that repeat score alike; labels that disagree on an id count by their
    mean; without labels of both kinds every score is NULL and every row kept;
    an empty table gives no rows; other columns are ignored."""
    known = materialize(views(docs), "views")
    said = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    labelled = _drawn(known.join(said, "doc_id"), MAX_LABELLED)
    both_kinds = len(np.unique(labelled[2])) == 2
    models = None
    if both_kinds:
        pool = materialize(known.join(said, "doc_id", "left_anti").select("text_view", "meta_view"), "pool")
        n_pool = pool.count()
        exchange = lambda teachers, learners: _added(pool, n_pool, lambda x: exchange_sums(x, teachers, learners))
        models = co_train(labelled, _spread(known, known.count()), exchange, rounds if n_pool else 0)
    if models is None:
        none = F.lit(None).cast("double")
        return known.select("doc_id", "dk", none.alias("p_text"), none.alias("p_meta"), none.alias("score"), F.lit(True).alias("keep"))
    text_model, meta_model = models

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = _both(batch)
            a, b = text_model.logits(text), meta_model.logits(meta)
            chances = [np.round(sigmoid(z), 6) for z in (a, b, (a + b) / 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("dk"), *map(pa.array, chances), pa.array(chances[2] >= KEEP_FROM)],
                ["doc_id", "dk", "p_text", "p_meta", "score", "keep"],
            )

    return known.mapInArrow(score, "doc_id bigint, dk bigint, p_text double, p_meta double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` less the documents that the views reject; all columns stay."""
    rejected = quality_scores(docs, labels).where("not keep").select("doc_id", "dk").distinct()
    return without(docs, materialize(rejected, "rejected"))
