"""Language-model scores from a probabilistic suffix tree, beside a plain word model.

The tree's symbols are bytes of the normalised text: its words, A-Z lower-cased, joined by one
space and closed by a line end (neither is in a word, so word sequences and such strings are the
same thing). A context is the run of up to `DEPTH` bytes before a symbol; before a text's first
byte stand line ends.

Counting: every context of DEPTH bytes with its next symbol is counted over all training texts;
shorter contexts are sums of longer ones. Smoothing: a context's distribution is its counts plus as
many pseudo-counts as it has different symbols, dealt out like the distribution of its longest
retained proper suffix (down to add-half byte counts). Divergence test: a context is retained if it
was seen `least` times and its count times the Kullback-Leibler divergence of its distribution from
that suffix's exceeds half its number of symbols times the logarithm of its count. Scoring: each
symbol is predicted by the longest retained suffix of what precedes it.

The whole model is broadcast while it has at most `entries` rows; a larger one is split by its
contexts' last two bytes, and each part scores its own positions in a pass of its own.

The word model is exact: counts of words (as 64-bit hashes) come from one aggregation. Words that
make up more than 2**-20 of all tokens, a million at most, are broadcast; the others are joined.

Defined results: a null or empty text is the end token alone; a null doc_id is in the training part;
repeated rows each count and are each answered; with no training rows at all both models are
uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import WordHashes, binary, checkpointed, runs

DEPTH, LEAST = 5, 16
MODEL_ENTRIES = 4_000_000
FREQUENT = 1 << 20
CHUNK = 1_000_000  # symbols looked at together
END_KEY = xxhash.xxh3_64_intdigest(b"\n")
U8 = np.uint64(8)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % 5 == 1


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, texts) of up to CHUNK bytes, or one long text."""
    for batch in batches:
        ids, texts, a, size = batch.column("doc_id").to_pylist(), [t or b"" for t in binary(batch.column("text"))], 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > CHUNK:
                yield ids[a:i], texts[a:i]
                a, size = i, 0
            size += len(t)
        if a < len(ids):
            yield ids[a:], texts[a:]


def symbols(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Grams (DEPTH context bytes, the nearest first, then the symbol) of all texts, and how many each has."""
    pad = b"\n" * DEPTH
    strings = [b" ".join(w) + b"\n" for w in words]
    flat = np.frombuffer(pad + pad.join(strings), np.uint8)
    count = np.fromiter(map(len, strings), np.int64, len(strings))
    n = len(flat) - DEPTH
    gram = flat[DEPTH:].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        gram |= flat[DEPTH - d : DEPTH - d + n].astype(np.uint64) << np.uint64(8 * (DEPTH - d + 1))
    real = np.zeros(n + 1, np.int8)
    starts = np.cumsum(count + DEPTH) - count - DEPTH
    np.add.at(real, starts, 1)
    np.add.at(real, np.minimum(starts + count, n), -1)
    return gram[np.cumsum(real[:n]) > 0], count


class Tally:
    """Running counts of 64-bit keys."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        u, c = np.unique(keys, return_counts=True)
        every, counts = np.concatenate((self.keys, u)), np.concatenate((self.counts, c))
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order]
        starts, _ = runs(every)
        self.keys, self.counts = every[starts], np.add.reduceat(counts, starts) if len(starts) else counts

    def take(self, kind: int) -> Iterator[pa.RecordBatch]:
        keys, counts = self.keys.view(np.int64), self.counts
        self.__init__()
        for c in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[c : c + 100_000]), kind, np.int32)), pa.array(keys[c : c + 100_000]), pa.array(counts[c : c + 100_000])], ["kind", "key", "cnt"])


def count_training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, words, grams = WordHashes(), Tally(), Tally()
    for ids, texts in chunks(batches):
        split = [t.lower().split() for d, t in zip(ids, texts, strict=True) if not held_out(d)]
        if split:
            words.add(np.concatenate((cache.of([w for ws in split for w in ws]), np.full(len(split), END_KEY, np.uint64))))
            grams.add(symbols(split)[0])
        for kind, tally in enumerate((words, grams)):
            if len(tally.keys) > 3_000_000:
                yield from tally.take(kind)
    yield from words.take(0)
    yield from grams.take(1)


class Node:
    """A retained context: depth, probabilities of its symbols, what is left for others."""

    __slots__ = ("key", "symbol", "p", "left", "parent")

    def __init__(self, key: int, symbol: np.ndarray, count: np.ndarray, parent: Node | None, dense: np.ndarray | None = None):
        self.key, self.symbol, self.parent = key, symbol, parent
        if parent is None:
            self.p, self.left = dense, 0.0
        else:
            total = float(count.sum()) + len(symbol)
            self.p, self.left = (count + len(symbol) * parent.of(symbol)) / total, len(symbol) / total

    def of(self, symbol: np.ndarray) -> np.ndarray:
        if self.parent is None:
            return self.p[symbol]
        at = np.searchsorted(self.symbol, symbol)
        hit = (at < len(self.symbol)) & (self.symbol[np.minimum(at, len(self.symbol) - 1)] == symbol)
        out = np.empty(len(symbol))
        out[hit] = self.p[at[hit]]
        if not hit.all():
            out[~hit] = self.left * self.parent.of(symbol[~hit])
        return out

    def gain(self, count: np.ndarray) -> float:
        """Count times the divergence of this distribution from the parent's."""
        base = self.parent.of(self.symbol)
        rest = max(0.0, 1 - float(base.sum())) * self.left
        return float(count.sum()) * (float((self.p * np.log(self.p / base)).sum()) + rest * math.log(self.left))


def state_key(context: int, depth: int) -> int:
    """context: DEPTH bytes, the nearest first; those beyond depth are dropped."""
    shift = 8 * (DEPTH - depth)
    return (context >> shift << shift) << 3 | depth


def grow(parent: Node, context: np.ndarray, symbol: np.ndarray, count: np.ndarray, depth: int, least: int, out: list[Node]) -> None:
    """Retained nodes among the contexts of `depth` bytes that the sorted rows hold, and below them."""
    group = context >> np.uint64(8 * (DEPTH - depth))
    starts, lengths = runs(group)
    totals = np.add.reduceat(count, starts)
    for a, n, total in zip(starts.tolist(), lengths.tolist(), totals.tolist(), strict=True):
        if total < least:
            continue
        s, inverse = np.unique(symbol[a : a + n], return_inverse=True)
        c = np.bincount(inverse, count[a : a + n])
        node = Node(state_key(int(context[a]), depth), s, c, parent)
        kept = node.gain(c) > 0.5 * len(s) * math.log(total)
        if kept:
            out.append(node)
        if depth < DEPTH:
            grow(node if kept else parent, context[a : a + n], symbol[a : a + n], count[a : a + n], depth + 1, least, out)


NODES = "prefix int, state long, parent long, symbol int, value double"


def as_rows(nodes: list[Node]) -> pa.Table:
    """A row for each node (symbol -1: log10 of what is left) and for each of its symbols."""
    prefix, state, parent, symbol, value = [], [], [], [], []
    for n in nodes:
        k = len(n.symbol) + 1
        prefix += [n.key >> 3 >> 8 * (DEPTH - 2)] * k
        state += [n.key] * k
        parent += [n.parent.key] * k
        symbol += [-1, *n.symbol.tolist()]
        value += [math.log10(n.left), *np.log10(n.p).tolist()]
    return pa.table({"prefix": pa.array(prefix, pa.int32()), "state": pa.array(state, pa.int64()), "parent": pa.array(parent, pa.int64()), "symbol": pa.array(symbol, pa.int32()), "value": pa.array(value, pa.float64())})


def top_nodes(bytes_counted: list[tuple[int, int, int]], least: int) -> tuple[Node, dict[int, Node]]:
    """The root and the retained one-byte contexts, from counts of (byte before, byte): 65,536 rows at most."""
    count = np.zeros((256, 256), np.int64)
    for b, s, c in bytes_counted:
        count[b, s] = c
    total = count.sum(0)
    root = Node(0, np.arange(256), total, None, (total + 0.5) / (total.sum() + 128.0))
    top = {}
    for b in range(256):
        s = np.flatnonzero(count[b])
        c = count[b, s]
        if c.sum() >= least:
            node = Node(state_key(b << 8 * (DEPTH - 1), 1), s, c, root)
            if node.gain(c) > 0.5 * len(s) * math.log(c.sum()):
                top[b] = node
    return root, top


class Model:
    """Sorted arrays of the nodes, for look-up of many grams."""

    def __init__(self, root: Node, state: np.ndarray, parent: np.ndarray, symbol: np.ndarray, value: np.ndarray):
        self.root = np.log10(root.p)
        order = np.lexsort((symbol, state))
        state, parent, symbol, value = state[order], parent[order], symbol[order], value[order]
        own = symbol < 0
        self.state, self.left = state[own], value[own]
        self.parent = np.searchsorted(self.state, parent[own])
        self.parent[parent[own] == 0] = -1
        self.entry, self.value = state[~own] << 8 | symbol[~own], value[~own]

    def score(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        gram = gram.astype(np.int64)
        symbol, context = gram & 255, gram >> 8
        at = np.full(len(gram), -1, np.int64)
        for depth in range(DEPTH, 0, -1) if len(self.state) else ():
            open_ = np.flatnonzero(at < 0)
            shift = 8 * (DEPTH - depth)
            key = (context[open_] >> shift << shift) << 3 | depth
            i = np.minimum(np.searchsorted(self.state, key), len(self.state) - 1)
            at[open_] = np.where(self.state[i] == key, i, -1)
        out, rest = np.zeros(len(gram)), np.arange(len(gram))
        while len(rest):
            done = rest[at[rest] < 0]
            out[done] += self.root[symbol[done]]
            rest = rest[at[rest] >= 0]
            if not len(rest):
                break
            key = self.state[at[rest]] << 8 | symbol[rest]
            i = np.minimum(np.searchsorted(self.entry, key), len(self.entry) - 1)
            hit = self.entry[i] == key
            out[rest[hit]] += self.value[i[hit]]
            rest = rest[~hit]
            out[rest] += self.left[at[rest]]
            at[rest] = self.parent[at[rest]]
        return out


def row_key(doc_id: int | None, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, seed=0 if doc_id is None else doc_id & (2**63 - 1)) - (1 << 63)


SCORED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("tf", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
SCORED_DDL = "kind int, key long, doc_id long, row long, tf long, tokens long, known long, base double, score double"


def score_texts(model, frequent, low: int, high: int, first: bool):
    """Rows of documents (kind 2) and, in the first pass, of words that are not frequent (kind 0).

    Positions are scored whose context's last two bytes are from low up to high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, tree = WordHashes(), model.value
        keys, counts = frequent.value
        for ids, texts in chunks(batches):
            split = [t.lower().split() for t in texts]
            row = np.array([row_key(d, t) for d, t in zip(ids, texts, strict=True)], np.int64)
            gram, count = symbols(split)
            u, inverse = np.unique(gram, return_inverse=True)
            value = np.zeros(len(u))
            prefix = u >> np.uint64(8 * (DEPTH - 1))
            own = slice(int(np.searchsorted(prefix, low)), int(np.searchsorted(prefix, high)))
            value[own] = tree.score(u[own])
            score = np.add.reduceat(value[inverse], np.cumsum(count) - count)
            n = len(ids)
            out = {"kind": np.full(n, 2, np.int32), "key": row, "doc_id": pa.array(ids, pa.int64()), "row": row, "score": score}
            if first:
                tokens = np.array([len(w) + 1 for w in split], np.int64)
                h = np.full(int(tokens.sum()), END_KEY, np.uint64)
                ends = np.cumsum(tokens) - 1
                word = np.ones(len(h), bool)
                word[ends] = False
                h[word] = cache.of([w for ws in split for w in ws])
                uh, inverse = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, uh), max(0, len(keys) - 1))
                hit = keys[at] == uh if len(keys) else np.zeros(len(uh), bool)
                part = np.where(hit, np.log10(counts[at] + 0.5), 0.0) if len(keys) else np.zeros(len(uh))
                starts = ends - tokens + 1
                out |= {"tokens": tokens, "known": np.add.reduceat(hit[inverse].astype(np.int64), starts), "base": np.add.reduceat(part[inverse], starts), "tf": np.ones(n, np.int64)}
                rare = np.flatnonzero(~hit[inverse])
                doc = np.repeat(np.arange(n), tokens)[rare]
                pair = doc * len(uh) + inverse[rare]
                pair, tf = np.unique(pair, return_counts=True)
                doc, which = pair // max(1, len(uh)), pair % max(1, len(uh))
                named = pa.array(ids, pa.int64())
                for c in range(0, len(pair), 100_000):
                    s = slice(c, c + 100_000)
                    yield rows_of(kind=np.zeros(len(pair[s]), np.int32), key=uh[which[s]].view(np.int64), doc_id=named.take(pa.array(doc[s])), row=row[doc[s]], tf=tf[s])
            yield rows_of(**out)

    return run


def rows_of(**columns) -> pa.RecordBatch:
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCORED], schema=SCORED)


def train(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, Node]:
    """(counts: kind, key, cnt over all training texts; nodes of the tree; its root)."""
    counts = checkpointed(docs.mapInArrow(count_training, "kind int, key long, cnt long").groupBy("kind", "key").agg(F.sum("cnt").alias("cnt")))
    grams = counts.where("kind = 1").select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(255).cast("int").alias("symbol"), "cnt")
    last = F.shiftright("context", 8 * (DEPTH - 1))
    pairs = grams.groupBy(last.alias("b"), "symbol").agg(F.sum("cnt").alias("c")).collect()  # 65,536 rows at most
    root, top = top_nodes([tuple(r) for r in pairs], least)

    def subtree(group: pa.Table) -> pa.Table:
        context = group.column("context").to_numpy().astype(np.uint64)
        order = np.argsort(context, kind="stable")
        context = context[order]
        symbol, count = group.column("symbol").to_numpy()[order].astype(np.int64), group.column("cnt").to_numpy()[order]
        nodes: list[Node] = []
        if len(context) and count.sum() >= least:
            grow(top.get(int(context[0]) >> 8 * (DEPTH - 1), root), context, symbol, count, 2, least, nodes)
        return as_rows(nodes)

    # A group is what ends in two given bytes: 2**24 contexts at most, whatever the corpus has.
    nodes = checkpointed(grams.groupBy(F.shiftright("context", 8 * (DEPTH - 2)).alias("p")).applyInArrow(subtree, NODES))
    first = as_rows([top[b] for b in sorted(top)])
    return counts, nodes.unionByName(docs.sparkSession.createDataFrame(first.to_pandas(), NODES)) if first.num_rows else nodes, root


def score(docs: DataFrame, *, least: int = LEAST, entries: int = MODEL_ENTRIES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, nodes, root = train(docs, least)
    words = counts.where("kind = 0")
    n, v = words.agg(F.coalesce(F.sum("cnt"), F.lit(0)), F.count("*")).first()
    often = words.where(F.col("cnt") * FREQUENT >= n).select("key", "cnt").toArrow()  # FREQUENT rows at most
    key = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    frequent = spark.sparkContext.broadcast((key[order], often.column("cnt").to_numpy()[order].astype(np.float64)))

    # Parts of the model by the contexts' last two bytes; one part unless it is too large.
    sizes = nodes.groupBy("prefix").count().orderBy("prefix").collect()  # 65,536 rows at most
    short = {p for p, in nodes.where(F.col("state").bitwiseAND(7) == 1).select("prefix").distinct().collect()}
    cuts, held = [0], 0
    for p, c in sizes:
        if held and held + c > entries:
            cuts.append(p)
            held = 0
        held += 0 if p in short else c
    passes = []
    for low, high in zip(cuts, [*cuts[1:], 1 << 16], strict=True):
        part = nodes if len(cuts) == 1 else nodes.where(F.col("prefix").between(low, high - 1) | (F.col("state").bitwiseAND(7) == 1))
        a = part.select("state", "parent", "symbol", "value").toArrow()
        model = spark.sparkContext.broadcast(Model(root, *(a.column(c).to_numpy() for c in ("state", "parent", "symbol", "value"))))
        passes.append(docs.mapInArrow(score_texts(model, frequent, low, high, not passes), SCORED_DDL))
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more)
    known = words.select("key", F.col("cnt").alias("c"))
    c = F.when(F.col("kind") == 0, F.coalesce("c", F.lit(0)))
    added = rows.join(known, "key", "left").select(
        "doc_id", "row", F.when(F.col("kind") == 2, F.col("tf")).alias("copies"), "tokens",
        F.when(F.col("kind") == 0, F.when(c > 0, F.col("tf")).otherwise(0)).otherwise(F.col("known")).alias("known"),
        F.when(F.col("kind") == 0, F.col("tf") * F.log10(c + 0.5)).otherwise(F.col("base")).alias("base"), "score",
    )
    each = added.groupBy("doc_id", "row").agg(*[F.sum(x).alias(x) for x in ("copies", "tokens", "known", "base", "score")])
    copies = F.col("copies")
    tokens = F.expr("tokens div copies")
    return each.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)).alias("held_out"),
        tokens.alias("n_tokens"), F.expr("known div copies").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / copies - tokens * math.log10(n + 0.5 * (v + 1))).alias("base_score"), (F.col("score") / copies).alias("score"),
        F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"),
    ).drop("copy")
