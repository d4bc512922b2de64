"""Mixing sources to target weights by Poisson replication (only DataFrame functions).

The target rate of a source is its share of the mixture, times the size of all sources,
divided by its own size.  Each document draws its number of copies from a Poisson
distribution with that mean, inverted from a hash of seed, id and text, so the draw is the
same on every run; the copies are then shuffled globally by another hash.

* A source without entry in ``weights`` has ``default_weight``; a null source is a source.
* Size is the number of characters (null and empty texts: 0).  A source of size 0 cannot
  have a share: its rate is 0, and so it is if its weight is 0.
* Rates have no cap.  Above ``_STEP`` a rate is cut into equal parts whose independent
  draws are added, which is the same distribution and never underflows.
* Rows that share id and text draw the same count; null ids and texts hash as empty.  Result columns replace input columns of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import over, stored, whole_rows

#: Largest mean that is inverted at once, and the terms of the sum beyond which nothing of
#: a 52-bit hash is left.
_STEP, _TERMS = 4.0, 32
#: Source tables up to this many rows are broadcast; longer ones are joined by shuffling.
_BROADCAST_SOURCES = 10_000
RESULTS = ["rate", "copy", "shuffle_key"]


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, key: Column) -> Column:
    """Inverse of the Poisson distribution at a hash of the key: terms p(k) are added until
    the sum exceeds the hash."""
    parts = F.ceil(rate / _STEP).cast("int")

    def draw(i: Column) -> Column:
        mean, u = rate / parts, uniform(F.concat(key, F.lit(":"), i.cast("string")))
        start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), u.alias("u"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * mean / k
            more = s["u"] >= s["cdf"]
            return F.struct(
                F.when(more, k).otherwise(s["k"]).alias("k"),
                F.when(more, p).otherwise(s["p"]).alias("p"),
                F.when(more, s["cdf"] + p).otherwise(s["cdf"]).alias("cdf"),
                s["u"].alias("u"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step, lambda s: s["k"])

    drawn = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + draw(i))
    return F.when(rate > 0, drawn).otherwise(0)


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float) -> DataFrame:
    """source, rate: one row for each source.

    The weights' map is a literal; sizes are one aggregate with map-side combination."""
    weight = F.lit(default_weight)
    if weights:
        table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
        weight = F.coalesce(F.element_at(table, F.col("source")), weight)
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    sized = stored(
        sizes.select("source", "size", F.when(F.col("size") > 0, weight).otherwise(0.0).alias("weight")), "sources"
    )
    size, weights_sum = sized.agg(F.sum("size"), F.sum("weight")).first()
    rate = F.col("weight") / F.lit(float(weights_sum or 1)) * F.lit(float(size or 0)) / F.col("size")
    return sized.select("source", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, seed: int = 17, id: str = "doc_id"
) -> DataFrame:
    """One row for each copy of each document, in random places.

    Adds ``rate``, ``copy`` (from 1) and ``shuffle_key``: rows are dealt to partitions by
    that key and sorted by it inside them.
    """
    rates = source_rates(docs, weights, default_weight)
    if rates.count() <= _BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    row = whole_rows(docs)
    joined = row.join(rates, F.col("row").getField("source").eqNullSafe(rates["source"]))
    # By id and text: different rows of one id, or of none, have draws of their own.
    id_text, digest = F.col("row").getField(id).cast("string"), F.md5(F.coalesce(F.col("row").getField("text"), F.lit("")))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit("")), F.lit(":"), digest)
    counted = joined.select("row", "rate", key.alias("key"), poisson(F.col("rate"), key).alias("n"))
    copies = counted.where("n > 0").select(
        "row", "rate", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")
    )
    keyed = copies.select(
        "row", "rate", "copy", F.md5(F.concat("key", F.lit("#"), F.col("copy").cast("string"))).alias("shuffle_key")
    )
    return over(keyed, RESULTS).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
