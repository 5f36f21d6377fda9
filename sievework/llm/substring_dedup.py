"""Substring deduplication by level-wise doubling.

A window of `window` words that two documents share holds a shared window of every smaller length.
Levels therefore go from short to long: lengths window / 4, window / 2, window (rounded up), each at
most twice the one before. At the first level one short window of every full-length window is
enough, namely those with the smallest hash (both documents pick the same), about one in twenty.
Windows that repeat across documents are extended to twice their length, to the right and to the
left; at the last level to every full-length window around them. What does not repeat ends there,
and when no candidate survives so does the search.

At the last level a window is removed in all documents but those with the smallest doc_id that
have it; windows are judged on the input. Windows are compared by hashes of their words' hashes:
within a bucket by 32 bits and the bucket's place at short levels, which only thin candidates out,
and by 128 bits (two hashes that share nothing but the words) at the last, which decides.

Defined results: words are separated by ASCII white space; a null or empty text has no words and
nothing removed; a row without doc_id neither removes nor loses words; repeated rows and rows of one
doc_id do not remove each other's words; an empty table gives an empty result; other columns are
ignored by `report` and pass through `removed_text` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import exchange
from sievework.llm.common import WordHashes, binary, checkpointed, pieces, rolling, sliding

WINDOW = 50
ENTRIES = 1_500_000
BUCKET_BYTES = 40_000_000  # text for each bucket of the exchange


def levels(window: int) -> list[int]:
    return sorted({-(-window // 4), -(-window // 2), window})


def tag_of(text: Column) -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def picked(short: np.ndarray, starts: np.ndarray, counts: np.ndarray, window: int, width: int) -> np.ndarray:
    """Places of the short windows with the smallest hash of some full window of one document.

    short: hash of the short window at each word of all documents in a row."""
    span = window - width + 1  # short windows in a full one
    total = int(counts.sum())
    full = np.zeros(max(0, total - window + 1), bool)
    edge = np.zeros(total + 1, np.int32)
    long = counts >= window
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, starts[long] + counts[long] - window + 1, -1)
    full = np.cumsum(edge)[: len(full)] > 0
    if not len(full):
        return np.empty(0, np.int64)
    low = np.where(full, sliding(short, span)[: len(full)], np.uint64(0))
    padded = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
    most = sliding(padded, span, np.maximum)
    return np.flatnonzero((most[: len(short)] == short[: len(most)]) & (most[: len(short)] > 0))


class Sender:
    """Holds entries of a level until there are enough to send."""

    def __init__(self, buckets: int, question: str):
        self.buckets, self.question, self.held, self.size = buckets, question, [], 0

    def add(self, h: np.ndarray, owner: np.ndarray, tag: np.ndarray, place: np.ndarray, *check: np.ndarray) -> None:
        self.held.append((h, owner, tag, place.astype(np.int32), *check))
        self.size += len(h)

    def full(self) -> bool:
        return self.size >= ENTRIES

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            h, owner, *more = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.size = [], 0
            yield from exchange.pack(h, owner, self.buckets, self.question, *more)


def first_level(window: int, width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, out = WordHashes(), Sender(buckets, "shared")
        for batch in batches:
            for part in pieces(batch):
                ids = part.column("doc_id").to_pylist()
                texts = [t or b"" for t in binary(part.column("text"))]
                words = [t.split() for t in texts]
                tags = np.asarray(part.column("tag"))
                counts = np.array([len(w) for w in words], np.int64)
                yield exchange.table(kind=np.full(len(ids), 2, np.int32), bucket=((tags >> 16) % buckets).astype(np.int32), owner=pa.array(ids, pa.int64()), tag=tags, n=counts, note=[sha(w) for w in words])
                flat = cache.of([w for ws in words for w in ws])
                if len(flat) < window:
                    continue
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
                short = rolling(flat, width)
                at = picked(short, starts, counts, window, width)
                doc = np.searchsorted(starts, at, side="right") - 1
                named = np.array([d is not None for d in ids])
                keep = named[doc]
                at, doc = at[keep], doc[keep]
                owner = np.array([d or 0 for d in ids], np.int64)
                out.add(short[at], owner[doc], tags[doc], at - starts[doc])
                if out.full():
                    yield from out.send()
        yield from out.send()

    return run


def places(blobs: list[bytes] | None) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(blobs or []), np.int32)).astype(np.int64)


def next_level(window: int, before: int, width: int, buckets: int):
    """From places where windows of `before` words repeat to windows of `width` words that hold them."""
    last = width == window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, second, out = WordHashes(), WordHashes(seed=1), Sender(buckets, "later" if last else "shared")
        for batch in batches:
            for owner, tag, text, blobs in zip(*(batch.column(c).to_pylist() if c != "text" else binary(batch.column(c)) for c in ("doc_id", "tag", "text", "found")), strict=True):
                words = text.split()
                h = rolling(cache.of(words), width)
                at = places(blobs)
                if last:
                    reach = np.zeros(len(h) + width + 2, np.int32)
                    np.add.at(reach, np.maximum(at - (width - before), 0), 1)
                    np.add.at(reach, at + 1, -1)
                    start = np.flatnonzero(np.cumsum(reach)[: len(h)] > 0)
                else:
                    start = np.unique(np.concatenate((at, at - (width - before))))
                    start = start[(start >= 0) & (start < len(h))]
                if len(start):
                    check = [rolling(second.of(words), width)[start]] if last else []
                    out.add(h[start], np.full(len(start), owner, np.int64), np.full(len(start), tag, np.int64), start, *check)
                if out.full():
                    yield from out.send()
        yield from out.send()

    return run


def covered(n: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a window that starts at one of the places covers."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n] > 0


def cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for owner, tag, text, blobs in zip(*(batch.column(c).to_pylist() if c != "text" else binary(batch.column(c)) for c in ("doc_id", "tag", "text", "found")), strict=True):
                words = text.split()
                gone = covered(len(words), places(blobs), window)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((owner, tag, int(gone.sum()), sha(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "tag", "n_removed", "kept_sha256", "kept_text"])

    return run


CUT = "doc_id long, tag long, n_removed long, kept_sha256 string, kept_text string"


def search(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, n_words, whole sha and copies of every row; doc_id, tag, n_removed, kept_sha256,
    kept_text of every distinct row that loses words)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tag_of(F.col("text")).alias("tag"))
    buckets = exchange.buckets_of(texts, BUCKET_BYTES)  # answers come once for each document and bucket
    lengths = levels(window)
    found = exchange.settled(texts.mapInArrow(first_level(window, lengths[0], buckets), exchange.SCHEMA), buckets, "shared")
    found = checkpointed(found.select("kind", "owner", "tag", "n", "note", "payloads"))
    rows = found.where("kind = 2").groupBy(F.col("owner").alias("doc_id"), "tag").agg(F.max("n").alias("n_words"), F.max("note").alias("whole"), F.count("*").alias("copies"))

    def candidates(answers: DataFrame) -> DataFrame:
        # At most one place for each word of a document.
        return answers.where("kind = 1").groupBy(F.col("owner").alias("doc_id"), "tag").agg(F.collect_list("payloads").alias("found"))

    # From here on only documents with candidates move, once with their text.
    held = checkpointed(texts.where("doc_id is not null and text is not null").join(candidates(found), ["doc_id", "tag"]))
    source = held
    for i, (before, width) in enumerate(zip(lengths, lengths[1:], strict=False)):
        question = "later" if width == window else "shared"
        found = checkpointed(exchange.settled(source.mapInArrow(next_level(window, before, width, buckets), exchange.SCHEMA), buckets, question).select("kind", "owner", "tag", "payloads"))
        source = held.drop("found").join(candidates(found), ["doc_id", "tag"])
    lost = source.mapInArrow(cut(window), CUT)
    return rows, lost


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    rows, lost = search(docs, window)
    lost = lost.dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", "n_removed", "kept_sha256")
    every = rows.join(lost, ["doc_id", "tag"], "left")
    return every.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    ).drop("copy")


def removed_text(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with text cut to the words that stay where any are removed."""
    _, lost = search(docs, window)
    lost = lost.select(F.col("doc_id").alias("sieve_id"), "tag", "kept_text").dropDuplicates(["sieve_id", "tag"])
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), tag_of(F.col("text")).alias("own"))
    joined = row.join(lost, (F.col("id") == F.col("sieve_id")) & (F.col("own") == F.col("tag")), "left")
    return joined.select(*[(F.coalesce("kept_text", "row.text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
