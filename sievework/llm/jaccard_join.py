"""N-gram Jaccard join with token-combination prefixes.

Tokens of a document are the 64-bit hashes of its distinct word 5-grams, in the order of their
hash. A set of n tokens that reaches similarity t misses at most m = n - ceil(t n) of them with any
partner, so

1. of the first 2 m + 1 tokens (an extended prefix) at least m' + 1 are in a partner's prefix too, m' being the
   m of the smallest partner that the similarity allows. Documents with fewer tokens there that any
   other document has there are settled; a passage that many documents have in common is too short to
   keep them in.
2. for the documents left, all tokens are put in one order, the rarest first (by the number of sets
   that have them, then by hash). The first token that a pair shares is among the first m + 1 of both; a
   set with more than m tokens of its own is settled. If that token is rare (in at most `rare`
   sets) it is an index key alone. Otherwise all that the pair shares is frequent, and frequent
   tokens of a longer prefix are combined, two that follow each other among the set's frequent
   tokens: the pair shares l of them, its members interrupt that sequence less than l - 1
   times together, so two that follow each other are in both. No partner is lost, and a passage that
   many documents have in common brings no strangers together, as it comes last.
3. documents that share a key form candidate components (keys are linked to their smallest
   document, never in pairs), and within them whole sets are compared, in blocks of `block`: first
   within blocks, then by delegates, then those not yet known to hang together (true_links).
   Only spanning links leave a block.

Equal sets are one node throughout. Defined results: words are separated by ASCII white space,
A-Z lower-cased; fewer words than 5 are one token; null or empty text has an empty set and links
with nothing; a row without doc_id has component null and links with nothing; repeated rows are
answered each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import exchange
from sievework.llm.common import WordHashes, binary, blob, checkpointed, pieces, rolling, runs, whole_row
from sievework.llm.components import connected_components

WIDTH, PERCENT, RARE, BLOCK = 5, 80, 64, 1024
BLOCK_BYTES = 64_000_000  # of tokens, of a block on average
DELEGATES = 16  # sets of a component found in a block that stand for it in the second comparison
ENTRIES = 1_500_000  # entries that a map task holds before it sends them
BUCKET_BYTES = 20_000_000  # text for each bucket of the exchange


def token_sets(texts: list[bytes | None], cache: WordHashes, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct tokens of each text."""
    words = [(t or b"").lower().split() for t in texts]
    flat = cache.of([w for ws in words for w in ws])
    every = rolling(flat, width)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= width:
            out.append(np.unique(every[at : at + n - width + 1]))
        elif n:
            out.append(rolling(flat[at : at + n], n))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def missed(n: int, percent: int) -> int:
    """Tokens of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


def prefix(n: int, percent: int) -> tuple[int, int]:
    """Length of the first extended prefix, and how many of it any partner has in its own."""
    e = min(n, 2 * missed(n, percent) + 1)
    least = -(-percent * n // 100)  # size of the smallest partner, whose prefix shows the fewest
    return e, min(least, missed(least, percent) + 1)


def key_prefix(n: int, percent: int) -> int:
    """Length of the second: as many shared tokens as both sides can interrupt, and two more."""
    partner = n * 100 // percent + 1
    return min(n, 2 * missed(n, percent) + missed(partner, percent) + 3)


def index_keys(percent: int, rare: int):
    """(k1, key) of each set, from its size n and its tokens ts (df, h) that other sets have, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, keys = [], []
            ts = batch.column("ts")
            offsets, flat = np.asarray(ts.offsets), ts.values
            df, h = np.asarray(flat.field("df")), np.asarray(flat.field("h")).view(np.uint64)
            for i, (k1, n) in enumerate(zip(batch.column("k1").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                a, b = int(offsets[i]), int(offsets[i + 1])
                alone = n - (b - a)  # tokens that no other set has come first in the order
                m = missed(n, percent)
                if alone > m:
                    continue
                end = min(b, a + m + 1 - alone)
                split = a + int(np.searchsorted(df[a:b], rare, "right"))
                own = [h[a : min(end, split)]]
                if end > split:
                    frequent = h[split : max(split, min(b, a + key_prefix(n, percent) - alone))]
                    own.append(rolling(frequent, 2))
                own = np.concatenate(own)
                owners.append(np.full(len(own), k1, np.int64))
                keys.append(own.view(np.int64))
            if owners:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), pa.array(np.concatenate(keys))], ["k1", "key"])

    return run


def identity(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(blob(tokens))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sent_sets(percent: int, width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size, seen = WordHashes(), [], 0, set()

        def flush():
            if held:
                owner = np.repeat(np.array([k for _, k in held], np.int64), [len(h) for h, _ in held])
                yield from exchange.pack(np.concatenate([h for h, _ in held]), owner, buckets, "shared")
            held.clear()
            seen.clear()

        for batch in (p for b in batches for p in pieces(b)):
            ids, keys, sizes = batch.column("doc_id").to_pylist(), [], []
            for d, tokens in zip(ids, token_sets(binary(batch.column("text")), cache, width), strict=True):
                n = len(tokens)
                k1, k2 = identity(tokens) if n else (0, 0)
                keys.append((k1, k2))
                sizes.append(n)
                if n and d is not None and k1 not in seen:
                    seen.add(k1)
                    e = prefix(n, percent)[0]
                    held.append((tokens[:e].copy(), k1))  # not a view of all tokens
                    size += e
            k1 = np.array([k for k, _ in keys], np.int64)
            yield exchange.table(kind=np.full(len(ids), 2, np.int32), bucket=(k1 % buckets).astype(np.int32), owner=k1, tag=np.array([k for _, k in keys], np.int64), n=np.array(sizes, np.int64), note=[None if d is None else str(d) for d in ids])
            if size >= ENTRIES:
                yield from flush()
                size = 0
        yield from flush()

    return run


def compare(sets: list[np.ndarray], percent: int, dense: int = 8) -> np.ndarray:
    """Smallest index that each set reaches by links among the given sets."""
    g = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate(sets) if g else np.empty(0, np.uint64)
    who = np.repeat(np.arange(g), size)
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    starts, lengths = runs(token)
    common = np.zeros((g, g), np.int32)
    # Tokens that many sets have: a matrix product; tokens that few have: pairs of their sets.
    many = np.flatnonzero((lengths > max(8, g // dense)))
    for c in range(0, len(many), 4096):
        part = many[c : c + 4096]
        m = np.zeros((g, len(part)), np.float32)
        for j, r in enumerate(part):
            m[who[starts[r] : starts[r] + lengths[r]], j] = 1
        common += (m @ m.T).astype(np.int32)
    flat = common.reshape(-1)
    few = (lengths > 1) & (lengths <= max(8, g // dense))
    for d in np.unique(lengths[few]).tolist():
        rows = starts[few & (lengths == d)]
        a, b = np.triu_indices(d, 1)
        step = max(1, 2_000_000 // len(a))
        for c in range(0, len(rows), step):
            part = rows[c : c + step, None]
            pair = (who[part + a] * g + who[part + b]).ravel()
            u, k = np.unique(pair, return_counts=True)
            flat[u] += k.astype(np.int32)
    common = np.triu(common, 1)
    linked = 100 * common.astype(np.int64) >= percent * (size[:, None] + size[None, :] - common)
    linked = np.triu(linked & (common > 0), 1)
    linked |= linked.T
    label = np.arange(g)
    while True:
        low = np.where(linked, label[None, :], g).min(axis=1, initial=g)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def labelled(percent: int):
    """k1, k2 of each set of a group, its name a and the name b of the least set that it reaches in the group."""

    def run(group: pa.Table) -> pa.Table:
        k1, k2 = group.column("k1").to_numpy(), group.column("k2").to_numpy()
        label = compare([np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()], percent)
        name = [f"{a & (2**64 - 1):016x}{b & (2**64 - 1):016x}" for a, b in zip(k1.tolist(), k2.tolist(), strict=True)]
        return pa.table({"cc": group.column("cc"), "k1": group.column("k1"), "k2": group.column("k2"), "a": pa.array(name, pa.string()), "b": pa.array([name[i] for i in label.tolist()], pa.string())})

    return run


LABELS = "cc long, k1 long, k2 long, a string, b string"


def true_links(whole_sets: DataFrame, named: DataFrame, percent: int, block: int) -> DataFrame:
    """Spanning links (a, b) among the sets of each candidate component (named: k1, cc, blocks).

    Sets that are known to hang together need not meet, so a large component is worked off in three steps:
    every set is compared within its own block; delegates of what was found there are compared once
    across blocks; then sets of different found components meet, block by block. Members of the
    largest found component never meet each other there, so a family of copies costs its size."""
    placed = whole_sets.join(named, "k1").withColumn("own", F.pmod("k2", "blocks").cast("int"))
    first = checkpointed(placed.select("cc", "own", "k1", "k2", "tokens").groupBy("cc", "own").applyInArrow(labelled(percent), LABELS))
    edges = first.where("a <> b").select("a", "b")
    large = named.where("blocks > 1").select("cc", "blocks").distinct()
    if large.isEmpty():
        return edges
    inside = first.join(large, "cc")
    # A found component has at most `block` members here.
    one_of = F.row_number().over(Window.partitionBy("b").orderBy("k1", "k2"))
    delegates = inside.withColumn("i", one_of).where(F.col("i") <= DELEGATES).select("cc", "k1", "k2")
    rooms = delegates.groupBy("cc").agg(F.ceil(F.count("*") / block).cast("int").alias("rooms"))
    seats = delegates.join(rooms, "cc").withColumn("room", F.pmod("k2", "rooms").cast("int"))
    second = checkpointed(whole_sets.join(seats, ["k1", "k2"]).select("cc", "room", "k1", "k2", "tokens").groupBy("cc", "room").applyInArrow(labelled(percent), LABELS))
    edges = edges.unionByName(second.where("a <> b").select("a", "b"))
    known = connected_components(inside.where("a <> b").select("a", "b").unionByName(second.where("a <> b").select("a", "b")))
    members = checkpointed(inside.select("cc", "k1", "k2", "a").join(known.withColumnRenamed("node", "a"), "a", "left").select("cc", "k1", "k2", F.coalesce("label", "a").alias("found")))
    found = members.groupBy("cc", "found").agg(F.count("*").alias("n"))
    main = found.groupBy("cc").agg(F.max_by("found", F.struct("n", "found")).alias("main"), F.max("n").alias("in_main"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    if main.isEmpty():
        return edges
    mains, rests = (F.ceil(F.col(c) / block).cast("int") for c in ("in_main", "rest"))
    is_main = F.col("found") == F.col("main")
    roles = members.join(main, "cc").withColumns({"mains": mains, "every": mains + rests, "is_main": is_main})
    spot = F.when(F.col("is_main"), F.pmod("k2", "mains")).otherwise(F.col("mains") + F.pmod("k2", F.col("every") - F.col("mains"))).cast("int")
    # Blocks of the largest found component meet the others' blocks only; those meet every block.
    other = F.sequence(F.when(F.col("is_main"), F.col("mains")).otherwise(F.lit(0)), F.col("every") - 1)
    met = whole_sets.join(roles.select("cc", "k1", "k2", spot.alias("spot"), other.alias("other")), ["k1", "k2"]).withColumn("other", F.explode("other"))
    met = met.select("cc", F.least("spot", "other").alias("x"), F.greatest("spot", "other").alias("y"), "k1", "k2", "tokens")
    third = met.groupBy("cc", "x", "y").applyInArrow(labelled(percent), LABELS)
    return edges.unionByName(third.where("a <> b").select("a", "b"))


def node(k1: str = "k1", k2: str = "k2"):
    return F.concat(F.lpad(F.lower(F.hex(k1)), 16, "0"), F.lpad(F.lower(F.hex(k2)), 16, "0"))


def links(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, rare: int = RARE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, k1, k2, n; true spanning links a, b between set names)."""
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100: below, two sets may share frequent tokens and no two in a row")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = exchange.buckets_of(texts, BUCKET_BYTES)  # about two million entries each
    answers = exchange.settled(texts.mapInArrow(sent_sets(percent, width, buckets), exchange.SCHEMA), buckets, "shared")
    # Rows of documents stay as they are (one for each copy); counts of shared tokens are added up.
    rows = checkpointed(answers.groupBy("kind", F.col("owner").alias("k1"), F.col("tag").alias("k2"), "note").agg(F.sum("n").alias("total"), F.max("n").alias("n"), F.count("*").alias("copies")))
    members = rows.where("kind = 2").select(F.col("note").cast("long").alias("doc_id"), "k1", "k2", "n", "copies")
    shared = rows.where("kind = 1").groupBy("k1").agg(F.sum("total").alias("shared"))
    smallest = f"(({percent} * n + 99) div 100)"
    need = F.least(F.expr(smallest), F.expr(f"{smallest} - (({percent} * {smallest} + 99) div 100) + 1"))
    sets = members.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "copies")).alias("rep"), F.max("n").alias("n"))
    alive = sets.join(shared, "k1").where(F.col("shared") >= need)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in (p for b in batches for p in pieces(b)):
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            sets = token_sets(binary(batch.column("text")), cache, width)
            keep = [i for i, s in enumerate(sets) if len(s) and identity(s) == (k1[i], k2[i])]
            again = batch.column("again").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([k1[i] for i in keep], pa.int64()), pa.array([k2[i] for i in keep], pa.int64()), again, pa.array([blob(sets[i]) for i in keep], pa.binary())], ["k1", "k2", "again", "tokens"])

    wanted = alive.select(F.col("rep.doc_id").alias("doc_id"), (F.col("rep.copies") > 1).alias("again"), "k1", "k2")
    found = texts.where("doc_id is not null").join(wanted, "doc_id").select("k1", "k2", "again", "text").mapInArrow(whole, "k1 long, k2 long, again boolean, tokens binary")
    # Only rows that are repeated whole can come twice; they alone are shuffled to be single again.
    found = checkpointed(found)
    whole_sets = found.where("not again").unionByName(found.where("again").dropDuplicates(["k1", "k2"])).drop("again")

    def all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1 = np.asarray(batch.column("k1"))
            for c in range(0, len(k1), 500):
                sets = [np.frombuffer(t, np.int64) for t in batch.column("tokens").slice(c, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k1[c : c + 500], [len(s) for s in sets])), pa.array(np.concatenate(sets))], ["k1", "h"])

    tokens = whole_sets.select("k1", "tokens").mapInArrow(all_tokens, "k1 long, h long")
    counted = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    listed = tokens.join(counted, "h").groupBy("k1").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("ts"))
    lengths = whole_sets.select("k1", F.expr("cast(octet_length(tokens) div 8 as int)").alias("n"))
    keys = checkpointed(listed.join(lengths, "k1").mapInArrow(index_keys(percent, rare), "k1 long, key long"))
    lows = keys.groupBy("key").agg(F.count("*").alias("sets"), F.min("k1").alias("low")).where("sets > 1")
    linked = keys.join(lows, "key").select(F.col("k1").alias("a"), F.col("low").alias("b"))
    candidates = connected_components(linked.where("a <> b"))

    candidates = candidates.select(F.col("node").alias("k1"), F.col("label").alias("cc"))
    # Blocks have `block` sets and BLOCK_BYTES of tokens on average.
    bytes_ = F.sum(F.col("n").cast("long")) * 8
    sizes = candidates.join(lengths, "k1").groupBy("cc").agg(F.ceil(F.greatest(F.count("*") / block, bytes_ / BLOCK_BYTES)).cast("int").alias("blocks"))
    named = candidates.join(sizes, "cc")
    return members, true_links(whole_sets, named, percent, block)


def components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, rare: int = RARE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    members, edges = links(docs, percent, width, rare, block)
    members = members.withColumn("node", node())
    names = connected_components(edges)
    inside = members.where("n > 0 and doc_id is not null")
    by_set = inside.groupBy("node").agg(F.min("doc_id").alias("least"))
    by_label = by_set.join(names, "node").groupBy("label").agg(F.min("least").alias("component"))
    found = names.join(by_label, "label").select("node", "component")
    by_set = by_set.join(found, "node", "left").select("node", F.coalesce("component", "least").alias("component"))
    answer = inside.join(by_set, "node").select("doc_id", "n", "component", "copies")
    alone = members.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"), "copies")
    every = answer.unionByName(alone)
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def deduplicate(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The documents that stay: of each component the row with the smallest doc_id (all rows that have it)."""
    row = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"))
    gone = components(docs, percent, width).where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct()
    return row.join(gone, "id", "left_anti").select("row.*")
