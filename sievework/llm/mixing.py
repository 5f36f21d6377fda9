"""Mixing to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source x language x topic, and a cell weighs its tokens. The table of
cells is raked: in turn each margin's weights are scaled to its targets, until all three fit to
within `TOLERANCE` (or, where empty cells make the margins contradict each other, until a cycle no
longer brings them nearer). A
document's calibrated rate is its cell's raked share of the budget over the cell's tokens; it is
taken floor(rate) times and once more with the fraction as probability, decided by a hash of its
doc_id and text, so that a run can be repeated.

Targets are shares by value; "" stands for all values without a target of their own, which keep
their proportions to each other; None for a whole margin means equal shares for all its values.
Values that do not occur are left out and the others scaled up. If the margins contradict each
other because cells are empty, the last margin (topic) is the one that fits.

Defined results: null sources and languages are values of their own, apart from empty ones, and have no
target but that of ""; null or empty text has no
tokens, and a document without tokens is taken at the rate of its cell, 0 if the cell has none;
repeated rows are decided alike; an empty table gives an empty result; other columns pass through
`sample` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, whole_row

MARGINS = ("source", "lang", "topic")
CYCLES = 200  # at most; a cycle over a few cells costs nothing
TOLERANCE = 1e-9
CELLS_FEW = 50_000
Targets = Mapping[str, Mapping[str, float] | None]


def topic_of(text: Column) -> Column:
    """Register of a text from its marks: tabular, symbolic, shouted, brief or prose."""
    text = F.coalesce(text, F.lit(""))
    size = F.char_length(text)

    def share(marks: str) -> Column:
        rest = text
        for mark in marks:  # a search for one mark skims the bytes; translate would look every character up
            rest = F.replace(rest, F.lit(mark), F.lit(""))
        return (size - F.char_length(rest)) / F.greatest(size, F.lit(1))

    return F.when(size < 200, "brief").when(share("|") > 0.02, "tabular").when(share("*#%&$") > 0.05, "symbolic").when(share("!") > 0.02, "shouted").otherwise("prose")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """In [0, 1), from a hash of the row's doc_id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def target_share(margin: str, targets: Mapping[str, float] | None) -> Column:
    """Unscaled target of a margin's row. Columns: value, w (its tokens), all others' tokens in rest."""
    if targets is None:
        return F.lit(1.0)
    named = F.create_map(*[x for k, v in targets.items() if k for x in (F.lit(k), F.lit(float(v)))]) if any(targets) else None
    rest = F.lit(float(targets.get("", 0.0))) * F.col("w") / F.nullif(F.col("rest"), F.lit(0.0))
    own = F.try_element_at(named, F.coalesce("value", F.lit(""))) if named is not None else F.lit(None).cast("double")
    return F.coalesce(own, rest, F.lit(0.0))


def margin_targets(cells: DataFrame, margin: str, targets: Mapping[str, float] | None) -> DataFrame:
    """value, share: shares of the values that occur with tokens; they add up to 1."""
    rows = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("w").alias("w")).where("w > 0")
    named = [k for k in targets or () if k]
    other = F.when(F.col("value").isNull() | ~F.col("value").isin(named), F.col("w")) if named else F.col("w")
    rows = rows.withColumn("rest", rows.agg(F.sum(other)).scalar())
    rows = rows.select("value", target_share(margin, targets).alias("t"))
    total = rows.agg(F.sum("t")).scalar()
    return rows.select("value", (F.col("t") / total).alias("share"))


def residual(cells: DataFrame) -> float:
    """Largest difference of a margin's raked share from its target; cells: MARGINS, share_<margin>, r."""
    off = [cells.groupBy(m).agg(F.sum("r").alias("have"), F.max(f"share_{m}").alias("aim")).where("aim is not null").agg(F.max(F.abs(F.col("have") - F.col("aim"))).alias("d")) for m in MARGINS]
    rows = off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max("d")).first()
    return rows[0] or 0.0


def scaled(now: DataFrame, m: str) -> DataFrame:
    """One margin's step."""
    have = now.groupBy(F.col(m).alias("value")).agg(F.sum("r").alias("have"))
    joined = now.join(have, F.col(m).eqNullSafe(F.col("value")))
    return joined.withColumn("r", F.coalesce(F.col("r") * F.col(f"share_{m}") / F.nullif("have", F.lit(0.0)), F.lit(0.0))).drop("value", "have")


def raked(rows: Sequence[Row], cycles: int, tolerance: float, at_once: int) -> np.ndarray:
    """The raked weights of a small table of cells: MARGINS, share_<margin>, r. The same steps as over a DataFrame."""
    r, off, done = np.array([x["r"] for x in rows], np.float64), math.inf, 0
    margins = []
    for m in MARGINS:
        number: dict = {}
        at = np.array([number.setdefault(x[m], len(number)) for x in rows], np.int64)
        aim = np.full(len(number), np.nan)
        aim[at] = [math.nan if x[f"share_{m}"] is None else x[f"share_{m}"] for x in rows]
        margins.append((at, aim))
    while len(r) and done < cycles:
        for _ in range(min(at_once, cycles - done)):
            for at, aim in margins:
                have = np.bincount(at, r, len(aim))
                r = r * np.nan_to_num(aim)[at] / np.where(have > 0, have, 1.0)[at]
        done, was = done + at_once, off
        off = max((float(np.nanmax(np.abs(np.bincount(at, r, len(aim)) - aim))) for at, aim in margins if not np.isnan(aim).all()), default=0.0)
        if off <= tolerance or off > 0.99 * was:
            break
    return r


def rake(cells: DataFrame, targets: Targets, cycles: int = CYCLES, few: int = CELLS_FEW, tolerance: float = TOLERANCE, at_once: int = 5) -> DataFrame:
    """cells (source, lang, topic, w) with raked weight r; weights add up to 1 where any cell has tokens.

    Up to `few` cells (they are counted) are raked in the driver's memory, as every step over a DataFrame is a job
    whose plan the driver holds; more of them by an aggregation and a join for each step, written out after it. Both
    do the same arithmetic. The fit is looked at after every `at_once` cycles; raking ends when all margins are within
    `tolerance`, when that no longer improves by a hundredth, or after `cycles`."""
    now = cells
    for m in MARGINS:
        aims = margin_targets(cells, m, targets.get(m)).select(F.col("value").alias(f"value_{m}"), F.col("share").alias(f"share_{m}"))
        now = now.join(aims, F.col(m).eqNullSafe(F.col(f"value_{m}")), "left").drop(f"value_{m}")
    total = cells.agg(F.sum("w")).scalar()
    now = checkpointed(now.withColumn("r", F.coalesce(F.col("w") / F.nullif(total, F.lit(0.0)), F.lit(0.0))))
    if now.count() <= few:
        rows = now.collect()  # at most `few`
        columns = [pa.array([x[m] for x in rows], pa.string()) for m in MARGINS]
        columns += [pa.array([x["w"] for x in rows], pa.float64()), pa.array(raked(rows, cycles, tolerance, at_once))]
        return cells.sparkSession.createDataFrame(pa.table(columns, [*MARGINS, "w", "r"]))
    done, off = 0, math.inf
    while done < cycles:
        for _ in range(min(at_once, cycles - done)):
            for m in MARGINS:
                now = checkpointed(scaled(now, m))
        done, was, off = done + at_once, off, residual(now)
        if off <= tolerance or off > 0.99 * was:
            break
    return now.drop(*[f"share_{m}" for m in MARGINS])


def rated(docs: DataFrame, targets: Targets, budget: float = 0.3, cycles: int = CYCLES, seed: int = 7, topic: Column | None = None) -> DataFrame:
    """docs with cell_source, cell_lang, cell_topic, tokens, rate, copies.

    budget: tokens to take as a share of all tokens."""
    topic = topic_of(F.col("text")) if topic is None else topic
    facts = docs.select(
        whole_row(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        topic.alias("topic"), n_tokens(F.col("text")).alias("tokens"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"),
    )
    cells = checkpointed(facts.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("w")))
    all_tokens = cells.agg(F.sum("w")).scalar()
    rates = checkpointed(rake(cells, targets, cycles)).select(*MARGINS, F.coalesce(F.col("r") * budget * all_tokens / F.nullif(F.col("w"), F.lit(0.0)), F.lit(0.0)).alias("rate"))
    # Broadcast only if the table of cells was counted to be small; else Spark splits a hot cell's rows.
    rates = rates.select(*[F.col(m).alias(f"of_{m}") for m in MARGINS], "rate")
    same = F.col("source").eqNullSafe(F.col("of_source")) & F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("topic") == F.col("of_topic"))
    known = facts.join(F.broadcast(rates) if cells.count() <= CELLS_FEW else rates, same)
    whole = F.floor("rate")
    return known.withColumn("copies", (whole + F.when(F.col("u") < F.col("rate") - whole, 1).otherwise(0)).cast("long"))


def decisions(docs: DataFrame, targets: Targets, **options) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, rate, copies."""
    slim = docs.select("doc_id", "source", "lang", "text")
    return rated(slim, targets, **options).select("doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "rate", "copies")


def sample(docs: DataFrame, targets: Targets, **options) -> DataFrame:
    """The documents that are taken, with all their columns and the number of copies."""
    rows = rated(docs, targets, **options).where("copies > 0")
    return rows.select("row.*", F.col("copies").alias("copies" if "copies" not in docs.columns else "mix_copies"))
