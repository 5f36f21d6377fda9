"""Quality classifier by co-training on two views of a document.

Text view: how its characters follow each other (histogram of pairs of character classes), how many
of its words are new, repeated at once, or long. Metadata view: language, source and length. Both
are logistic regressions. In each round every view labels the documents of an unlabelled pool that
it is confident of, and the other view learns from them next. A part of the labelled rows that
neither view learns from calibrates each view (Platt scaling), and a last regression over both
calibrated views gives the score.

Fitting uses bounded samples: `labelled` labelled documents and a pool of `pool` others, those with
the smallest hash of their doc_id. Their views (about 1.5 kB a row) meet in one task, which returns the
weights alone, so no row reaches the driver. Of the labelled rows three fifths teach, a fifth
calibrates, and a fifth takes no part: the model's `auc` is of those. Scoring covers every document
whole, in one pass without a shuffle.

Defined results: labels without quality are ignored, of several for a document the mean counts; null
or empty text, null lang, source, n_chars are values like any other; without labels of both kinds
every score is the share of good labels (1 if there are none); repeated rows are scored each; an
empty table gives an empty result; other columns are ignored by `scores` and pass through `keep_good`.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import binary, through_arrow

LABELLED_MOST, POOL_MOST, ROUNDS, SURE, KEEP = 20_000, 20_000, 3, 0.97, 0.5
SOURCES, LANGS, SIZES = 64, 16, 20

_CLASSES = np.full(256, 15, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!?", b"|", b"*", b"#%&$@", b"'\"-:;()", b"<>{}[]=_/\\+~^`")):
    _CLASSES[np.frombuffer(_chars, np.uint8)] = _i
_CLASSES[128:] = 14


def text_view(text: bytes | None) -> np.ndarray:
    text = text or b""
    out = np.zeros(256 + 6, np.float32)
    if len(text) > 1:
        c = _CLASSES[np.frombuffer(text, np.uint8)]
        out[:256] = np.sqrt(np.bincount(c[:-1].astype(np.int16) * 16 + c[1:], minlength=256) / (len(text) - 1))
    words = text.split()
    n = len(words)
    if n:
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        lines = text.split(b"\n")
        out[256:] = (len(set(words)) / n, same / n, math.log(len(text) / n), len(set(lines)) / len(lines), math.log1p(n) / 10, 1)
    return out


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(SOURCES + LANGS + SIZES + 1, np.float32)
    out[crc32((source or "").encode()) % SOURCES] = 1
    out[SOURCES + crc32((lang or "").encode()) % LANGS] = 1
    out[SOURCES + LANGS + min(SIZES - 1, max(0, n_chars or 0).bit_length())] = 1
    out[-1] = 1
    return out


VIEWS = "doc_id long, text_view binary, meta_view binary"


def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lang, source, size = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "source", "n_chars"))
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([text_view(t).tobytes() for t in binary(batch.column("text"))], pa.binary()),
            pa.array([meta_view(*x).tobytes() for x in zip(lang, source, size, strict=True)], pa.binary()),
        ], ["doc_id", "text_view", "meta_view"])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of an L2 logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        gradient, hessian = ridge * w, ridge * np.eye(len(w))
        for c in range(0, len(x), 4096):  # in double precision a few rows at a time
            part, own = x[c : c + 4096].astype(np.float64), weight[c : c + 4096]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            gradient = gradient + part.T @ (own * (p - y[c : c + 4096]))
            hessian += (part * (own * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, sure: float = SURE) -> dict:
    """Weights of both views, their calibration, and of the views together. fold: rows for calibration only."""
    learn, seen = ~fold, [text, meta]
    pools, guess = [pool_text, pool_meta], [np.full(len(pool_text), np.nan) for _ in range(2)]
    w: list[np.ndarray] = [np.empty(0)] * 2
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(rounds + 1):
        for v in range(2):
            taught = ~np.isnan(guess[1 - v])  # by the other view
            x = np.concatenate((seen[v][learn], pools[v][taught]))
            t = np.concatenate((y[learn], guess[1 - v][taught]))
            k = np.concatenate((np.ones(learn.sum()), np.full(taught.sum(), 0.3)))
            w[v] = logistic(x, t, k)
        for v in range(2):
            # Confidence is of probabilities calibrated on rows that the view has not learnt from.
            a, b = logistic(np.stack((seen[v][fold] @ w[v], np.ones(fold.sum())), 1), y[fold], np.ones(fold.sum()), 0.1)
            p = sigmoid(pools[v] @ w[v] * a + b)
            guess[v] = np.where(p >= sure, 1.0, np.where(p <= 1 - sure, 0.0, np.nan))
    platt, z = [], []
    for v in range(2):
        s = seen[v][fold] @ w[v]
        platt.append(logistic(np.stack((s, np.ones(len(s))), 1), y[fold], np.ones(len(s)), 0.1))
        z.append(s * platt[v][0] + platt[v][1])
    both = logistic(np.stack((*z, np.ones(len(z[0]))), 1), y[fold], np.ones(len(z[0])), 0.1)
    return {"w": w, "platt": platt, "both": both}


def matrix(rows: pa.Table, column: str) -> np.ndarray:
    """The values of a column of equally long vectors, as they lie in Arrow's buffer."""
    if not rows.num_rows:
        return np.empty((0, 1), np.float32)
    values = rows.column(column).combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.float32)[ends[0] // 4 : ends[-1] // 4].reshape(len(values), -1)


def ranked_auc(y: np.ndarray, s: np.ndarray) -> float | None:
    """Share of pairs of a good and a bad row that the score puts in order; ties count half."""
    good, bad = np.sort(s[y == 1]), s[y == 0]
    if not len(good) or not len(bad):
        return None
    below, upto = np.searchsorted(good, bad, "left"), np.searchsorted(good, bad, "right")
    return float((len(good) - upto + (upto - below) / 2).mean() / len(good))


def together(z: list[np.ndarray], both: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z[0] * both[0] + z[1] * both[1] + both[2], -30, 30)))


def fitted(rows: pa.Table) -> dict | float:
    """The model of the bounded samples' rows (doc_id, text_view, meta_view, good)."""
    if rows.num_rows:
        order = np.lexsort((rows.column("good").is_null().to_numpy(), rows.column("doc_id").to_numpy()))
        rows = rows.take(pa.array(order))
    good = rows.column("good").to_pandas().to_numpy(np.float64)
    own = ~np.isnan(good)
    y = good[own]
    part = np.array([crc32(str(d).encode()) % 5 for d in rows.column("doc_id").to_numpy()[own].tolist()], np.int64)
    if any(len(set(y[p].tolist())) < 2 for p in (part == 0, part > 1)):
        return float(y.mean()) if len(y) else 1.0
    views = [matrix(rows, "text_view"), matrix(rows, "meta_view")]
    seen, pools = [v[own] for v in views], [v[~own] for v in views]
    del views
    rest = part != 1
    model = cotrain(seen[0][rest], seen[1][rest], y[rest], part[rest] == 0, *pools)
    z = [seen[v][~rest] @ model["w"][v] * model["platt"][v][0] + model["platt"][v][1] for v in range(2)]
    return model | {"auc": ranked_auc(y[~rest], together(z, model["both"])), "tested": int((~rest).sum())}


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED_MOST, pool: int = POOL_MOST) -> dict | float:
    """The model, or the share of good labels where there is nothing to tell apart."""
    wide = columns(docs)
    spread = F.xxhash64("doc_id")
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    chosen = marks.orderBy(spread, "doc_id").limit(labelled)
    others = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").join(marks.select("doc_id"), "doc_id", "left_anti").orderBy(spread, "doc_id").limit(pool)
    # Both are at most `labelled` and `pool` rows of an id and a bit.
    some = F.broadcast(chosen.unionByName(others.distinct().withColumn("good", F.lit(None).cast("int"))))
    rows = wide.join(some, "doc_id").mapInArrow(with_good, VIEWS + ", good int")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(batches)
        if every:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(pa.Table.from_batches(every)))], pa.binary())], ["model"])

    # One task holds the samples: labelled + pool rows of fixed size.
    found = rows.repartition(1).mapInArrow(solve, "model binary").first()
    return pickle.loads(bytes(found["model"])) if found else 1.0


def columns(docs: DataFrame) -> DataFrame:
    """What the views are made of."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def with_good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in views(iter([batch])):
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column("good").cast(pa.int32())], [*out.schema.names, "good"])


def probabilities(batch: pa.RecordBatch, model: dict | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text view, metadata view, both) of each row."""
    n = batch.num_rows
    if isinstance(model, float):
        return (np.full(n, model),) * 3
    out = next(views(iter([batch])))
    z = [np.stack([np.frombuffer(v, np.float32) for v in out.column(c).to_pylist()]) @ w * p[0] + p[1] for c, w, p in zip(("text_view", "meta_view"), model["w"], model["platt"], strict=True)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    return sigmoid(z[0]), sigmoid(z[1]), together(z, model["both"])


SCORES = "doc_id long, text_score double, meta_score double, score double, kept boolean"


def scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (probability of quality), kept."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, 1000):
                part = batch.slice(c, 1000)
                a, b, both = probabilities(part, model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= keep)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return columns(docs).mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    model = fit(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, 1000):
                part = batch.slice(c, 1000)
                struct = pa.RecordBatch.from_arrays([part.column(names.index(x)).cast(t) for x, t in (("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()))], ["doc_id", "text", "lang", "source", "n_chars"])
                yield part.filter(pa.array(probabilities(struct, model)[2] >= keep))

    return through_arrow(docs, run)
