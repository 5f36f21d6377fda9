"""One exchange that tells which of very many hashes occur for more than one owner.

Rows of a hash each would cost more in Spark's row format than the hashes themselves, and a hash
that a third of all owners have would land in one task. So the map side packs the hashes of a
bucket into one binary value, and settles what it can by itself first: of hashes that it has seen
for several owners it answers for all its own entries and sends one marker alone. A task of the
reduce side therefore gets at most one entry of a hash from each map-side batch.

Two questions can be asked of an entry (hash, owner, payload):
`shared`: does another owner have the hash?  `later`: does a smaller owner have it?
`shared` is asked to thin candidates out and compares 32 bits within a bucket (buckets grow with the
input); `later` decides, and compares all 64 and, where given, 64 more of a second hash (`check`).

Buckets are sized by bytes of text, and each has a partition of its own: a task of the reduce side
holds the entries of one bucket, whatever the number and the length of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import blob, mixed, runs

#: kind 0: entries to be looked up in their bucket; 1: answers (owner, tag, payloads); 2: what passes through.
SCHEMA = "kind int, bucket int, owner long, tag long, n long, note string, hashes binary, owners binary, tags binary, payloads binary"
ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("owner", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("note", pa.string()), ("hashes", pa.binary()), ("owners", pa.binary()), ("tags", pa.binary()), ("payloads", pa.binary())])
LOW = np.uint64(0xFFFFFFFF)
#: Owner of a marker: a hash that a map task has settled, and that others need to know of.
MARK = -(1 << 63)


def buckets_of(texts: DataFrame, each: int) -> int:
    """Buckets for about `each` bytes of text; 12 at least, so that small inputs use several tasks too."""
    return max(12, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // each))


def settled(sent: DataFrame, buckets: int, question: str) -> DataFrame:
    """The exchange itself: every bucket is a partition."""
    return sent.repartitionById(buckets, "bucket").mapInArrow(lambda batches: settle(batches, buckets, question), SCHEMA)


def table(**columns) -> pa.RecordBatch:
    """A batch of the given columns; those not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ARROW], schema=ARROW)


def answered(owner: np.ndarray, tag: np.ndarray | None, payload: np.ndarray | None, spread: int) -> Iterator[pa.RecordBatch]:
    """One answer for each (owner, tag): its payloads sorted, or only their number."""
    if not len(owner):
        return
    if tag is None:
        owner = np.sort(owner)
        new = owner[1:] != owner[:-1]
    else:
        order = np.lexsort((payload, tag, owner))
        owner, tag, payload = owner[order], tag[order], payload[order]
        new = (owner[1:] != owner[:-1]) | (tag[1:] != tag[:-1])
    starts = np.flatnonzero(np.concatenate(([True], new)))
    ends = np.append(starts[1:], len(owner))
    for c in range(0, len(starts), 10_000):
        a, b = starts[c : c + 10_000], ends[c : c + 10_000]
        k = owner[a]
        columns = {"kind": np.ones(len(a), np.int32), "bucket": (k % spread).astype(np.int32), "owner": k, "n": b - a}
        if tag is not None:
            at = np.append(a - a[0], b[-1] - a[0]).astype(np.int32) * 4
            columns |= {"tag": tag[a], "payloads": pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(payload[a[0] : b[-1]].tobytes())])}
        yield table(**columns)


def equal(g: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal hashes, in both halves where there are two."""
    if check is None or not len(g):
        return runs(g)
    starts = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (check[1:] != check[:-1]))))
    return starts, np.diff(np.append(starts, len(g)))


def sorting(g: np.ndarray, check: np.ndarray | None, owner: np.ndarray) -> np.ndarray:
    return np.lexsort((owner, g) if check is None else (owner, check, g))


def pack(h: np.ndarray, owner: np.ndarray, buckets: int, question: str, tag: np.ndarray | None = None, payload: np.ndarray | None = None, check: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows for the exchange from a batch's entries.

    payload (32-bit) is what the answer to an entry holds, and tag tells rows of one owner apart;
    without them answers are counts. check is a second hash; `later` always sends one (zeros if none is given)."""
    g = mixed(h)
    if question == "later" and check is None:
        check = np.zeros(len(g), np.uint64)
    order = sorting(g, check, owner)
    g, owner = g[order], owner[order]
    tag, payload, check = (None if x is None else x[order] for x in (tag, payload, check))
    starts, lengths = equal(g, check)
    if question == "shared":
        several = owner[starts] != owner[starts + lengths - 1]
        done = np.repeat(several, lengths)
    else:
        done = owner > np.repeat(owner[starts], lengths)
    yield from answered(owner[done], *(None if x is None else x[done] for x in (tag, payload)), buckets)
    sent = ~done
    if question == "shared":
        owner = owner.copy()
        owner[starts[several]] = MARK
        sent[starts[several]] = True
    g, owner = g[sent], owner[sent]
    tag, payload, check = (None if x is None else x[sent] for x in (tag, payload, check))
    bucket = ((g >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)).tolist()
    low = (g & LOW).astype(np.uint32) if question == "shared" else np.stack((g, check), axis=1)
    parts = [(b, slice(cuts[b], cuts[b + 1])) for b in range(buckets) if cuts[b] < cuts[b + 1]]
    for c in range(0, len(parts), 64):
        some = parts[c : c + 64]
        of = lambda x: [b"" if x is None else blob(x[s]) for _, s in some]  # noqa: E731, B023
        yield table(kind=[0] * len(some), bucket=[b for b, _ in some], hashes=of(low), owners=of(owner), tags=of(tag), payloads=of(payload))


def settle(batches: Iterator[pa.RecordBatch], spread: int, question: str) -> Iterator[pa.RecordBatch]:
    """The reduce side: passes kinds 1 and 2 on, answers kind 0."""
    waiting: dict[int, list[tuple]] = {}
    for batch in batches:
        ask = np.asarray(batch.column("kind")) == 0
        if not ask.all():
            yield batch.filter(pa.array(~ask))
        own = batch.filter(pa.array(ask))
        for b, *values in zip(*(own.column(c).to_pylist() for c in ("bucket", "hashes", "owners", "tags", "payloads")), strict=True):
            waiting.setdefault(b, []).append(tuple(values))
    for b in sorted(waiting):
        parts = waiting.pop(b)
        h, owner, tag, payload = (np.frombuffer(b"".join(p[i] for p in parts), t) for i, t in enumerate((np.uint32 if question == "shared" else np.uint64, np.int64, np.int64, np.int32)))
        del parts
        h, check = (h, None) if question == "shared" else h.reshape(-1, 2).T
        order = sorting(h, check, owner)
        h, check, owner = h[order], None if check is None else check[order], owner[order]
        tag, payload = (x[order] if len(x) else None for x in (tag, payload))
        starts, lengths = equal(h, check)
        if question == "shared":
            hit = np.repeat(owner[starts] != owner[starts + lengths - 1], lengths) & (owner != MARK)
        else:
            hit = owner > np.repeat(owner[starts], lengths)
        yield from answered(owner[hit], *(None if x is None else x[hit] for x in (tag, payload)), spread)
