"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so (after a sentence mark or line end, at least
`CHUNK_LEAST` and at most `CHUNK_MOST` characters on), every chunk gets an identifier, and a
document's recipe is the ordered list of its chunks' identifiers. Equal recipes mean equal texts
because identifiers are verified: chunks are deduplicated, combined before the shuffle, so that a
chunk moves once however many documents have it, and an identifier must have one chunk; else the next kind is taken, and the last kind is the chunk's text itself. After that
only recipes move, never documents.

Defined results: a null text counts as empty; empty texts are equal to each other; rows without
doc_id take part, but a row with a doc_id is kept before them; of repeated rows with the same
largest doc_id exactly one is kept; an empty table gives an empty result; other columns pass
through `deduplicate` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, whole_row

CHUNK_LEAST, CHUNK_MOST = 512, 4096

#: Kinds of identifier, from narrow to exact.
IDENTIFIERS: Sequence[Callable[[Column], Column]] = (
    lambda chunk: F.unhex(F.sha2(chunk, 256)),
    lambda chunk: chunk,
)


def chunks(text: Column, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> Column:
    """The text's chunks, in order; joined they are the text."""
    pattern = f"(?s).{{{least},{most}}}?(?<=[.!?;\\n\\u3002])|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def verified(texts: DataFrame, identifier: Callable[[Column], Column]) -> bool:
    """Whether no two different chunks share an identifier."""
    # A chunk that a third of all documents have is one row per task; identifiers alone are counted.
    single = texts.select(F.explode(chunks(F.col("text"))).alias("chunk")).distinct()
    return single.groupBy(identifier(F.col("chunk")).alias("id")).count().where("count > 1").isEmpty()


def recipes(docs: DataFrame, identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS) -> DataFrame:
    """doc_id, recipe, text_sha256 of every row; recipes are equal exactly where texts are."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for identifier in identifiers[:-1]:
        if verified(texts, identifier):
            break
    else:
        identifier = identifiers[-1]
    return texts.select(
        "doc_id",
        F.transform(chunks(F.col("text")), identifier).alias("recipe"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def groups(docs: DataFrame, identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = checkpointed(recipes(docs, identifiers).withColumn("tie", F.monotonically_increasing_id()))
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", (-F.col("tie")).alias("tie")))
    same = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1")
    return (
        rows.join(same, "recipe", "left")
        .select(
            "doc_id",
            F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("best").isNull() | (F.col("best.tie") == -F.col("tie"))).alias("kept"),
            "text_sha256",
        )
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay: of equal texts the row with the largest doc_id.

    Copies that are dropped are a minority that carry only their doc_id and digest; the rows that
    stay are found by anti-join on both, and exact repeats of a kept row go by their number."""
    row = whole_row(docs).alias("row")
    own = docs.select(row, F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    found = groups(docs)
    drop = found.groupBy(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s")).agg(
        F.sum(F.col("kept").cast("int")).alias("stay"), F.count("*").alias("there")
    ).where("stay < there")
    joined = own.join(drop, own["id"].eqNullSafe(drop["d"]) & (own["digest"] == drop["s"]), "left")
    clean = joined.where("there is null").select("row.*")
    # A kept row with repeats of itself: its columns may differ from theirs, so one is taken.
    again = joined.where("stay > 0").groupBy("d", "s").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return clean.unionByName(again.select("row.*"))
