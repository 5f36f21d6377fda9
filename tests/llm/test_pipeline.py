import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import cotraining, decontaminate, mixing
from sievework.llm.queries import MIX, ORACLE_SQL, QUERIES, table

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import brute_components  # noqa: E402

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def odd(df):
    """The table with columns whose names operators use themselves, or that need quoting."""
    return df.withColumns({"row": F.lit(1), "kept": F.lit("k"), "a.b": F.lit(2), "rate": F.lit(3), "m": F.create_map(F.lit("x"), F.lit("y"))})


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    first = rows.orderBy("doc_id").limit(70)
    schema = rows.schema.simpleString()[7:-1]
    strange = spark.createDataFrame([(None, "one two three four five six seven", None, None, None), (9001, None, "en", "s", 0), (9002, "", None, "s", None), (9003, " \n", "en", None, 2), (9004, "word " * 30_000, "en", "s", 150_000)], schema)
    return odd(first.unionByName(first.limit(5)).unionByName(strange)).cache()


def seen(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, docs):
    """Each stage on what its predecessor kept, against brute force or the operator's own decisions."""
    rows = docs
    good = STAGES["quality classifier"](spark, rows, DATA).cache()
    kept = {(r.doc_id, r.kept) for r in cotraining.scores(rows, table(spark, DATA, "labels")).collect()}
    assert good.columns == docs.columns and {d for d, k in kept if k} == {d for d, _ in seen(good)} and seen(good) <= seen(docs)

    exact = STAGES["exact dedup"](spark, good, DATA).cache()
    by = defaultdict(list)
    for (d, t), n in seen(good).items():
        by[t or ""] += [d] * n
    assert exact.columns == docs.columns
    assert Counter((d, t or "") for d, t in seen(exact).elements()) == Counter((max((x for x in v if x is not None), default=None), t) for t, v in by.items())

    near = STAGES["n-gram Jaccard join"](spark, exact, DATA).cache()
    pairs = list(seen(exact).elements())
    gone = {d for (d, t), (_, c) in brute_components(pairs).items() if d is not None and c < d}
    assert near.columns == docs.columns and seen(near) == Counter(p for p in pairs if p[0] not in gone)

    clean = STAGES["benchmark decontamination"](spark, near, DATA).cache()
    hit = {r.doc_id for r in decontaminate.matches(near, table(spark, DATA, "benchmark")).collect()}
    assert clean.columns == docs.columns and seen(clean) == Counter({k: n for k, n in seen(near).items() if k[0] not in hit})

    mixed = STAGES["mixing sources"](spark, clean, DATA)
    taken = Counter(r.doc_id for r in mixing.decisions(clean, MIX).collect() if r.copies > 0)
    assert mixed.columns == [*docs.columns, "copies"] and Counter(r.doc_id for r in mixed.collect()) == taken


def test_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_run(spark):
    before = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == [*before.columns, "copies"] and 0 < rows.count() < before.count()
    known = {r.h for r in before.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()}
    assert {hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows.collect()} <= known


def test_registered():
    assert len(QUERIES) == 10 and set(ORACLE_SQL) <= set(QUERIES)
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
