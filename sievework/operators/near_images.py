"""Near-duplicate images: perceptual hashes within a Hamming distance, and a greedy choice of which stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.order import written

BITS = 64


def band(h: Column, i: int, bands: int) -> Column:
    """The i-th of `bands` runs of bits."""
    low, high = BITS * i // bands, BITS * (i + 1) // bands
    if high - low == BITS:
        return h
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def near_pairs(hashes: DataFrame, threshold: int = 5) -> DataFrame:
    """a, b, distance of distinct hashes that differ in at most `threshold` bits, a < b.

    Two such hashes agree in one of threshold + 1 bands, so hashes meet by band and number; equal hashes are one row
    here, however many images have them. hashes: column phash (long)."""
    distinct = hashes.where("phash is not null").select("phash").distinct()
    bands = threshold + 1
    keyed = distinct.select("phash", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), band(F.col("phash"), i, bands).alias("v")) for i in range(bands)])).alias("k"))
    left, right = keyed.select(F.col("phash").alias("a"), "k"), keyed.select(F.col("phash").alias("b"), "k")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # A pair is kept at the first band that it shares.
    first = F.coalesce(*[F.when(band(F.col("a"), i, bands) == band(F.col("b"), i, bands), i) for i in range(bands)])
    met = left.join(right, "k").where((F.col("a") < F.col("b")) & (first == F.col("k.i")))
    return met.select("a", "b", distance.alias("distance")).where(F.col("distance") <= threshold)


def greedy(images: DataFrame, order: str, threshold: int = 5) -> DataFrame:
    """images (phash and the order, which tells rows apart) with column accepted: taken in order, an image is accepted if
    it is further than the threshold from all accepted before it.

    Of equal hashes the first alone can be accepted. Among those a round settles every hash whose earlier neighbours are
    settled: one is out if any of them is in. Rounds are as many as the longest chain of neighbours in order."""
    first = images.where("phash is not null").groupBy("phash").agg(F.min(order).alias("at"))
    pairs = near_pairs(images, threshold)
    at = lambda c: first.select(F.col("phash").alias(c), F.col("at").alias(f"at_{c}"))
    placed = pairs.join(at("a"), "a").join(at("b"), "b")
    later = F.col("at_a") < F.col("at_b")
    edges = written(placed.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("late")))
    state = written(first.select("phash", F.lit(None).cast("boolean").alias("taken")))
    while True:
        known = edges.join(state.select(F.col("phash").alias("early"), "taken"), "early")
        seen = known.groupBy(F.col("late").alias("phash")).agg(F.max("taken").alias("blocked"), F.bool_and(F.col("taken").isNotNull()).alias("settled"))
        ruled = F.when(F.coalesce("blocked", F.lit(False)), False).when(F.coalesce("settled", F.lit(True)), True)
        state = written(state.join(seen, "phash", "left").select("phash", F.coalesce("taken", ruled).alias("taken")))
        if state.where("taken is null").isEmpty():
            break
    chosen = first.join(state, "phash").select(F.col("phash").alias("sieve_h"), F.col("at").alias("sieve_at"), "taken")
    out = images.join(chosen, F.col("phash") == F.col("sieve_h"), "left")
    return out.withColumn("accepted", F.coalesce(F.col("taken") & (F.col(order) == F.col("sieve_at")), F.lit(False))).drop("sieve_h", "sieve_at", "taken")
