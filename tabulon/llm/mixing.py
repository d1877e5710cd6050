"""Mixing sources to target weights by Poisson replication.

Each source's repetition rate is ``total * weight / sum of weights / rows of the source``.  A document is
repeated a Poisson number of times with that mean: the distribution function is inverted at a uniform value
hashed from the document, so a rerun or a recomputed partition draws the same counts.  Copies are then
dealt out and ordered by a hash of (document, copy), a global shuffle that samples nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import md5_unit, without

#: Means above this are drawn as a sum of independent Poisson counts of smaller mean, so that no
#: distribution table has more than a few hundred entries.
MAX_MEAN = 32.0
OTHER = "*"


def source_rates(docs: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """One row per stratum that occurs: ``stratum, n_rows, rate, parts, cdf``; at most len(weights) + 1 rows.

    ``cdf`` is the Poisson distribution function of mean ``rate / parts``, with an entry for each count up to
    where it is 1 in double precision.
    """
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in weights]), F.array(*[F.lit(float(v)) for v in weights.values()]))
    counts = docs.groupBy(_stratum(weights).alias("stratum")).agg(F.count(F.lit(1)).alias("n_rows"))
    known = counts.withColumn("weight", F.coalesce(pairs[F.col("stratum")], F.lit(0.0)))
    sums = known.agg(F.sum("weight").alias("w"), F.sum("n_rows").alias("n"))
    rates = known.crossJoin(F.broadcast(sums)).withColumn("rate", (F.lit(total) if total is not None else F.col("n")) * F.try_divide(F.col("weight"), F.col("w")) / F.col("n_rows"))
    rates = rates.withColumn("rate", F.coalesce("rate", F.lit(0.0))).withColumn("parts", F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    top = F.ceil(mean + F.sqrt(mean) * 12 + 24).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct((-mean).alias("lp"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf")),
        lambda a, k: F.struct((a["lp"] + F.log(F.greatest(mean, F.lit(1e-300)) / k)).alias("lp"), (a["c"] + F.exp(a["lp"] + F.log(F.greatest(mean, F.lit(1e-300)) / k))).alias("c"), F.concat(a["cdf"], F.array(a["c"] + F.exp(a["lp"] + F.log(F.greatest(mean, F.lit(1e-300)) / k)))).alias("cdf")),
        lambda a: a["cdf"],
    )
    return rates.select("stratum", "n_rows", "rate", "parts", grown.alias("cdf"))


def _stratum(weights: dict[str, float]):
    return F.when(F.col("source").isin([k for k in weights if k != OTHER]), F.col("source")).otherwise(OTHER)


def mix(docs: DataFrame, weights: dict[str, float], total: float | None = None, seed: int = 7) -> DataFrame:
    """The documents, each as often as drawn, in shuffled order, with ``part``, ``copy`` and ``shuffle_key``.

    ``weights`` maps a source to its share; sources that are null or not listed share the weight of ``"*"``
    (0 where it isn't given).  ``total`` is the expected number of rows out, by default the number of rows
    in.  Copies of a document differ in (part, copy).  Rows with equal doc_id draw equal counts.  An empty
    table gives an empty result; other columns pass through, but for those called as the three that are added.
    """
    docs = without(docs, ["part", "copy", "shuffle_key"])
    rates = source_rates(docs, weights, total).select(F.col("stratum").alias("__s"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    joined = docs.withColumn("__s", _stratum(weights)).join(F.broadcast(rates), "__s")
    parts = joined.withColumn("part", F.explode(F.sequence(F.lit(1), "__parts")))
    u = md5_unit(F.lit(seed), F.col("doc_id"), F.col("part"))
    drawn = parts.withColumn("__u", u).withColumn("__n", F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))))
    copies = drawn.where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "__n")))
    keyed = copies.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("order"), F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "part", "copy")), 1, 15), 16, 10).cast("long"))
    return keyed.drop("__s", "__parts", "__cdf", "__u", "__n").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
