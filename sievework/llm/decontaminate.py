"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are looked for in blocks of `ITEMS` (each block is one pass over all documents, so
what is held in memory stays the same however many items there are). For a block:

1. the document frequency of its words is counted over all documents (TF-IDF);
2. a distributed randomised SVD of the TF-IDF matrix of its items and of the passages (32 words) of
   all documents gives the latent space. One more pass over the documents counts how often two of
   its words stand in a passage; the decomposition works on these counts, whose size is the
   vocabulary's. All passages together weigh as much as those of `WEIGH_AS` documents;
3. every passage of every document (16, 32 or 64 words, a step of a quarter or less) is projected
   and compared with the items of that length by cosine. The norm is the passage's whole TF-IDF
   norm, where words outside the block's vocabulary count as rarest; a passage whose known words
   cannot reach the bound by their weight alone is not multiplied. As that norm grows with the number
   of documents and with the words around an item, a stretch is a candidate as well, whatever its
   cosine, if it has so many of an item's words that verification can succeed; so none is lost;
4. candidates are verified by the longest common subsequence of words with the item: at least
   `COPY` of the item's words, or `PARAPHRASE` of them if its answer is there too. An item's answer
   is its column `answer`, or else its last quarter.

Defined results: words are runs of ASCII letters, digits and other characters beyond ASCII,
A-Z lower-cased; items without words and null or empty texts match nothing; items of fewer than
`LEAST` words must occur whole; rows without doc_id are reported with null; repeated documents
are reported once each, repeated items once; an empty table gives an empty result; other columns
are ignored by `matches` and pass through `clean` unchanged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import binary, blob, checkpointed, runs, through_arrow

ITEMS, WEIGH_AS, RANK, NEAR = 256, 2_000, 256, 0.4
#: Weight of the items' rows in the decomposition, so that the space is first of all theirs.
ITEM_WEIGHT = 20.0
COPY, PARAPHRASE, ANSWER, LEAST = 0.8, 0.55, 0.6, 6
COMMON = 0.02  # share of documents from which on a word has no weight
LENGTHS, STEP = (16, 32, 64), 4
ITEM_WORDS = 64  # longer items are looked for by passages of so many words

_BYTES = bytearray(range(256))
for _b in range(128):
    if not chr(_b).isalnum():
        _BYTES[_b] = 32
_BYTES = bytes(_BYTES).lower()


def words_in(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTES).split()


@dataclass
class Block:
    """What is looked for in one pass."""

    ids: list  # item_id of each passage
    words: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: dict[bytes, int]


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """Passages of the distinct items, at most ITEMS together."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select("item_id", "text", answer.alias("answer")).distinct().orderBy("item_id", "text")
    ids, words, answers = [], [], []
    for r in rows.toLocalIterator():
        w, own = words_in((r["text"] or "").encode()), words_in((r["answer"] or "").encode())
        for a in range(0, len(w), ITEM_WORDS):
            part = w[a : a + ITEM_WORDS]
            if a and len(part) < ITEM_WORDS:  # the last passage is of full length too
                part = w[-ITEM_WORDS:]
            ids.append(r["item_id"])
            words.append(part)
            answers.append(own or part[-max(1, len(part) // 4) :])
        if len(ids) >= ITEMS:
            yield Block(ids, words, answers, {v: i for i, v in enumerate(sorted({x for p in words for x in p}))})
            ids, words, answers = [], [], []
    if ids:
        yield Block(ids, words, answers, {v: i for i, v in enumerate(sorted({x for p in words for x in p}))})


def inverse_frequency(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """IDF of the vocabulary's words over all documents, the same with 0 for common words, that of a word in none, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, known = np.zeros(len(vocabulary), np.int64), 0, vocabulary.keys()
        for batch in batches:
            n += batch.num_rows
            for t in binary(batch.column("text")):
                there = known & set(words_in(t))
                counts[[vocabulary[w] for w in there]] += 1
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(counts[hit], n))], ["word", "n"])

    df, n = np.zeros(len(vocabulary)), 0
    for w, c in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect():  # a row a word
        if w < 0:
            n = c
        else:
            df[w] = c
    idf = np.log((n + 1) / (df + 1)) + 1
    return idf, np.where(df > COMMON * n, 0.0, idf), math.log(n + 1) + 1, n


def part_of(block: Block, which: list[int]) -> Block:
    """Some of a block's passages, with its whole vocabulary."""
    return Block([block.ids[i] for i in which], [block.words[i] for i in which], [block.answers[i] for i in which], block.vocabulary)


def vector(words: list[bytes], vocabulary: dict[bytes, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and TF-IDF weights of a passage."""
    count = Counter(vocabulary[w] for w in words if w in vocabulary)
    at = np.fromiter(count, np.int64, len(count))
    return at, np.fromiter(count.values(), np.float64, len(count)) * idf[at]


def sampled_passages(docs: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, size: int) -> DataFrame:
    """Sparse rows (words, weights) of the passages of a few documents, to look at. Nothing that is found or reported uses it."""
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, weight = [], []
            for t in binary(batch.column("text")):
                words = words_in(t)
                for a in range(0, len(words), LENGTHS[1]):
                    x, y = vector(words[a : a + LENGTHS[1]], vocabulary, idf)
                    if len(x):
                        at.append(x.tobytes())
                        weight.append(y.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(weight, pa.binary())], ["at", "weight"])

    # At most `size` ids.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(run, "at binary, weight binary")


PAIRS_AT_ONCE, BLOCK_CELLS = 2_000_000, 1_000_000
COUNTS = "block int, cell binary, n binary"


def rows_each(dims: int) -> int:
    """Rows of a block of the matrix of counts."""
    return max(1, min(64, BLOCK_CELLS // max(1, dims)))


def pair_cells(texts: list[bytes | None], number: dict[bytes, int], dims: int) -> Iterator[np.ndarray]:
    """Cells (row * dims + column) of each two places of a passage, the same place twice too, where words of number stand.

    A pair of words is in one of its two cells only, decided by their numbers, so that rows are about equally full."""
    at, passage, base, size = [], [], 0, 0

    def cells() -> np.ndarray:
        w, p = np.concatenate(at), np.concatenate(passage)
        out = [w * dims + w]
        for d in range(1, LENGTHS[1]):
            near = np.flatnonzero(p[d:] == p[:-d])
            if not len(near):
                break
            low, high = np.minimum(w[near], w[near + d]), np.maximum(w[near], w[near + d])
            odd = (low + high) & 1 == 1
            out.append(np.where(odd, high, low) * dims + np.where(odd, low, high))
            same = low[low == high]
            out.append(same * dims + same)  # in either order
        at.clear()
        passage.clear()
        return np.concatenate(out)

    for t in texts:
        words = words_in(t)
        w = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
        spots = np.flatnonzero(w >= 0)
        if len(spots):
            at.append(w[spots])
            passage.append(spots // LENGTHS[1] + base)
            size += len(spots)
        base += len(words) // LENGTHS[1] + 1
        if size >= 100_000:
            yield cells()
            size = 0
    if size:
        yield cells()


def pair_counts(docs: DataFrame, vocabulary: dict[bytes, int], weights: np.ndarray) -> DataFrame:
    """For blocks of rows the counts of pair_cells over all passages of all documents. Words without weight are left out."""
    dims = len(vocabulary)
    each = rows_each(dims)
    number = {w: i for w, i in vocabulary.items() if weights[i] > 0}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            block = cell // (each * dims)
            heads, lengths = runs(block)
            cell, n = (cell - block * each * dims).astype(np.uint32), n.astype(np.uint32)
            spans = list(zip(heads.tolist(), (heads + lengths).tolist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(block[heads], pa.int32()), pa.array([blob(cell[a:b]) for a, b in spans], pa.binary()), pa.array([blob(n[a:b]) for a, b in spans], pa.binary())], ["block", "cell", "n"])

        for batch in batches:
            for cells in pair_cells(binary(batch.column("text")), number, dims):
                held.append(cells)
                size += len(cells)
                if size >= PAIRS_AT_ONCE:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(each * dims, np.int64)

        def done() -> pa.RecordBatch:
            cell = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([blob(cell)], pa.binary()), pa.array([blob(total[cell])], pa.binary())], ["block", "cell", "n"])

        for batch in batches:
            for block, cell, n in zip(*(batch.column(c).to_pylist() for c in ("block", "cell", "n")), strict=True):
                if now is not None and block != now:
                    yield done()
                    total[:] = 0
                now = block
                total[np.frombuffer(cell, np.uint32)] += np.frombuffer(n, np.uint32)
        if now is not None:
            yield done()

    return checkpointed(docs.select("text").mapInArrow(count, COUNTS).repartition("block").sortWithinPartitions("block").mapInArrow(add, COUNTS))


def latent_space(counts: DataFrame, share: float, weights: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], rank: int = RANK, rounds: int = 2, seed: int = 1) -> np.ndarray:
    """Right singular vectors (dims x rank) of the passages' and items' matrix: randomised subspace
    iteration, where each partition multiplies its blocks of the passages' counts (pair_counts) and only dims x rank sums
    leave it. share: weight of a passage."""
    dims = len(weights)
    rank, each = max(1, min(rank, dims)), rows_each(dims)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dims, min(dims, rank + 8))))[0].astype(np.float32)
    for _ in range(rounds + 1):
        basis = q

        def run(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            out, weighed = np.zeros(basis.shape), basis * weights[:, None]
            for batch in batches:
                for block, cell, n in zip(*(batch.column(c).to_pylist() for c in ("block", "cell", "n")), strict=True):
                    part = np.zeros(each * dims)
                    part[np.frombuffer(cell, np.int64)] = np.frombuffer(n, np.int64)
                    rows = np.arange(block * each, min(dims, (block + 1) * each))
                    part = part.reshape(each, dims)[: len(rows)]
                    out[rows] += part @ weighed
                    part[np.arange(len(rows)), rows] = 0  # the pair's other cell
                    out += part.T @ weighed[rows]
            out *= share * weights[:, None]
            hit = np.flatnonzero(np.abs(out).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array([out[i].tobytes() for i in hit.tolist()], pa.binary())], ["row", "sums"])

        def solve(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            y = np.zeros(basis.shape)
            for at, weight in items:
                y[at] += ITEM_WEIGHT**2 * np.outer(weight, weight @ basis[at])
            for batch in batches:
                for row, sums in zip(batch.column("row").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    y[row] += np.frombuffer(sums, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([np.linalg.qr(y)[0].astype(np.float32).tobytes()], pa.binary())], ["q"])

        # 8 * dims rows at most meet in one task, and dims x rank numbers leave it.
        found = counts.coalesce(8).mapInArrow(run, "row long, sums binary").repartition(1).mapInArrow(solve, "q binary").first()
        q = np.frombuffer(bytes(found["q"]), np.float32).reshape(basis.shape)  # half as large for the driver
    return q[:, :rank]


class Subsequence:
    """Longest common subsequence with a fixed word list, by bit vectors."""

    def __init__(self, words: list[bytes]):
        self.n, self.masks = len(words), {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.full = (1 << self.n) - 1

    def length(self, words: list[bytes]) -> int:
        v = self.full
        for w in words:
            m = self.masks.get(w)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & self.full
        return self.n - v.bit_count()


def stretches(near: np.ndarray, item: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the passages (cells near, by item and place) that overlap, at most four lengths together."""
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (near[1:] > near[:-1] + width)))
    run_start = np.maximum.accumulate(np.where(new, np.arange(len(near)), 0))
    new |= (near - near[run_start]) // (3 * width) != np.append(0, ((near - near[run_start]) // (3 * width))[:-1])
    heads = np.flatnonzero(new)
    return heads, np.append(heads[1:], len(near)) - 1


class Finder:
    def __init__(self, block: Block, idf: np.ndarray, rarest: float, space: np.ndarray, near: float):
        self.block, self.vocabulary, self.near = block, block.vocabulary, near
        self.weight = np.append(idf, rarest)
        self.place = np.zeros((len(idf) + 1, space.shape[1]), np.float32)
        self.place[:-1] = space * idf[:, None]
        vectors = [vector(w, block.vocabulary, idf) for w in block.words]
        norms = np.array([max(1e-12, math.sqrt(float((v * v).sum()))) for _, v in vectors])
        self.items = np.stack([v @ space[at] for at, v in vectors]).astype(np.float32) / norms[:, None].astype(np.float32)
        size = np.array([len(w) for w in block.words])
        self.has = np.zeros((len(idf) + 1, len(size)), np.uint8)  # a passage has ITEM_WORDS words at most
        for i, w in enumerate(block.words):
            for v, c in Counter(w).items():
                self.has[block.vocabulary[v], i] = c
        self.needs = np.where(size < LEAST, size, np.ceil(PARAPHRASE * size - 1e-9).astype(np.int64))
        # Cells that any stretch of one and a half lengths lies in.
        self.widths = -(-(size + size // 2 - 1) // STEP) + 1
        self.groups = []
        for i, n in enumerate(LENGTHS):
            own = np.flatnonzero((size <= n) & (size > (LENGTHS[i - 1] if i else 0)))
            if len(own):
                self.groups.append((n, own, self.items[own].T.copy()))
        self.whole = [Subsequence(w) for w in block.words]
        self.answer = [Subsequence(w) for w in block.answers]

    def candidates(self, at: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, last word, cosine) of stretches of near passages of one document. at: word numbers."""
        n = len(at)
        cut = np.arange(0, n, STEP)
        known = at < len(self.weight) - 1
        square = self.weight[at] ** 2
        cells = np.add.reduceat(np.stack((square, square * known), 1), cut)
        sums = np.concatenate((np.zeros((1, 2)), np.cumsum(cells, 0)))
        for size, own, items in self.groups:
            width = min(size // STEP, len(cut))
            total = sums[width:] - sums[:-width]
            # The cosine is at most the share of the known words' weight.
            rows = np.flatnonzero((total[:, 1] >= self.near**2 * total[:, 0]) & (total[:, 1] > 0))
            if not len(rows):
                continue
            # Running sums of word places over the cells that these passages have.
            edge = np.zeros(len(cut) + 1, np.int32)
            np.add.at(edge, rows, 1)
            np.add.at(edge, rows + width, -1)
            needed = np.cumsum(edge[:-1]) > 0
            number = np.cumsum(needed) - 1
            spots = np.flatnonzero(known & needed[np.arange(n) // STEP])
            latent = np.zeros((int(needed.sum()) + 1, self.place.shape[1]), np.float32)
            cell = number[spots // STEP]
            heads = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            latent[cell[heads] + 1] = np.add.reduceat(self.place[at[spots]], heads)
            np.cumsum(latent, 0, out=latent)
            first = number[rows]
            cosine = (latent[first + width] - latent[first]) @ items / np.sqrt(total[rows, 0])[:, None].astype(np.float32)
            near, item = np.nonzero(cosine >= self.near)
            if not len(near):
                continue
            value = cosine[near, item]
            order = np.lexsort((near, item))
            near, item, value = rows[near[order]], item[order], value[order]
            heads, tails = stretches(near, item, width)
            for i, a, b, c in zip(own[item[heads]].tolist(), (near[heads] * STEP).tolist(), ((near[tails] + width) * STEP).tolist(), np.maximum.reduceat(value, heads).tolist(), strict=True):
                yield i, a, b, c

    def holding(self, at: np.ndarray) -> Iterator[tuple[int, int, int, None]]:
        """(item, first word, last word, None) of stretches with as many of an item's words as verification asks for."""
        word, count = np.unique(at, return_counts=True)
        whole = np.minimum(self.has[word], np.minimum(count, ITEM_WORDS).astype(np.uint8)[:, None]).sum(0, dtype=np.int64)
        likely = np.flatnonzero(whole >= self.needs)
        if not len(likely):
            return
        edges = np.append(np.arange(0, len(at), STEP), len(at))
        sums = np.concatenate((np.zeros((1, len(likely)), np.int32), np.cumsum(self.has[np.ix_(at, likely)] > 0, 0, dtype=np.int32)))[edges]
        for width in np.unique(self.widths[likely]).tolist():
            column = np.flatnonzero(self.widths[likely] == width)
            own, width = likely[column], min(width, len(edges) - 1)
            item, near = np.nonzero(((sums[width:, column] - sums[:-width, column]) >= self.needs[own]).T)
            if not len(near):
                continue
            heads, tails = stretches(near, item, width)
            for i, a, b in zip(own[item[heads]].tolist(), (near[heads] * STEP).tolist(), ((near[tails] + width) * STEP).tolist(), strict=True):
                yield i, a, b, None

    def cosine(self, item: int, at: np.ndarray) -> float:
        norm = math.sqrt(float((self.weight[at] ** 2).sum()))
        return float(self.place[at].sum(0) @ self.items[item]) / norm if norm else 0.0

    def search(self, text: bytes | None) -> list[tuple]:
        """(item_id, cosine, overlap, answered, first_word) of the items found in a text."""
        words = words_in(text)
        if not words:
            return []
        none = len(self.weight) - 1
        at = np.fromiter(map(self.vocabulary.get, words, repeat(none)), np.int64, len(words))
        best: dict = {}
        for item, first, last, cosine in chain(self.candidates(at), self.holding(at)):
            length = len(self.block.words[item])
            reach = words[max(0, first - length // 2) : last + length // 2]
            whole = self.whole[item]
            if whole.length(reach) < PARAPHRASE * length:
                continue
            # Of any stretch of about the item's length.
            found = max(whole.length(reach[a : a + length + length // 2]) for a in range(0, max(1, len(reach) - length + 1), max(1, length // 4)))
            overlap = found / length
            own = self.answer[item]
            answered = own.length(reach) >= ANSWER * own.n
            if (overlap >= COPY if length >= LEAST else found == length) or (length >= LEAST and overlap >= PARAPHRASE and answered):
                key = self.block.ids[item]
                if key not in best or best[key][2] < overlap:
                    best[key] = (key, self.cosine(item, at[first:last]) if cosine is None else cosine, overlap, answered, first)
        return list(best.values())


FOUND = "doc_id long, item_id long, cosine double, overlap double, answered boolean, first_word long"
PAIRS = [("item_id", pa.int64()), ("cosine", pa.float64()), ("overlap", pa.float64()), ("answered", pa.bool_()), ("first_word", pa.int64())]


def finders(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> Iterator[list[Finder]]:
    """What each pass looks for. Words that very many documents have weigh nothing, unless an item has little
    else: such items are looked for with all weights, beside the others and in the same pass."""
    for block in blocks(benchmark):
        idf, telling, rarest, n = inverse_frequency(docs, block.vocabulary)
        poor = [sum(telling[block.vocabulary[w]] > 0 for w in set(p)) < 3 for p in block.words]
        counts = pair_counts(docs, block.vocabulary, idf if any(poor) else telling)
        held = []
        for few, weights in ((False, telling), (True, idf)):
            own = [i for i, p in enumerate(poor) if p == few]
            if own:
                items = [vector(block.words[i], block.vocabulary, weights) for i in own]
                space = latent_space(counts, min(1.0, WEIGH_AS / max(1, n)), weights, items)
                held.append(Finder(part_of(block, own), weights, rarest, space, near))
        yield held


def found_in(held: list[Finder], text: bytes | None) -> list[tuple]:
    """Every finder's items in a text; an item found by several is reported with its best overlap."""
    best: dict = {}
    for finder in held:
        for hit in finder.search(text):
            if hit[0] not in best or best[hit[0]][2] < hit[2]:
                best[hit[0]] = hit
    return list(best.values())


def matches(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, item_id, cosine, overlap, answered, first_word of every document and item found in it."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], FOUND)
    for finder in finders(docs, benchmark, near):
        held = spark.sparkContext.broadcast(finder)  # of one block: bounded by ITEMS

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), binary(batch.column("text")), strict=True) for hit in found_in(held.value, t)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *(t for _, t in PAIRS)], strict=True)], ["doc_id", *(n for n, _ in PAIRS)])

        found = found.unionByName(docs.mapInArrow(run, FOUND))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    spark, place = docs.sparkSession, docs.columns.index("text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for finder in finders(slim, benchmark, near):
        held = spark.sparkContext.broadcast(finder)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found_in(held.value, t) for t in binary(batch.column(place))], pa.bool_()))

        docs = through_arrow(docs, run)
    return docs
