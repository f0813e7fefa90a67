"""Mixing sources to target weights by systematic sampling (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a length class; a hot source is ranked in this many parts for each class.
SLICES = 4096
#: Ratio between the bounds of neighbouring length classes.
CLASS_RATIO = 1.25


def source_rates(sizes: DataFrame, targets: DataFrame, total: int) -> DataFrame:
    """Expected copies per record of every source with a target and with tokens.

    ``rate = min(max_repeats, target_share * total / tokens)``. Several targets
    of one source add up in share and take the smallest cap; a null share or cap
    counts as 0.
    """
    t = (targets.where(F.col("source").isNotNull())
         .groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")))
    rate = F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.lit(float(total)) / F.col("tokens"))
    return (t.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("records", F.coalesce("records", F.lit(0)))
            .withColumn("rate", F.when(F.col("tokens") > 0, F.greatest(rate, F.lit(0.0))).otherwise(0.0)))


def source_sizes(counted: DataFrame) -> DataFrame:
    """Records and tokens of every source; partial sums come before the shuffle."""
    return counted.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"))


def draw(counted: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """Draw the mixture: one row ``doc_id, source, copy, n_tokens`` per copy.

    ``counted`` has ``doc_id, source, n_tokens`` for every record. ``total`` is
    the size of the mixture in tokens, by default that of all records. Each
    record of a source gets the same expected number of copies (its rate); the
    running sum of these within the source, shifted by one random offset, emits
    the record once for each integer it crosses, so no record is used more often
    than its cap and the number of records is exact to one. Records are ranked
    by length class first, which makes the number of tokens nearly exact too.

    The running sum is a rank: records are counted in (source, class, slice)
    blocks, the counts are summed over a source's blocks (at most ``SLICES``
    for a class), and ranks within a block are added. No task sees a whole source.

    Records without source, tokens or target are not drawn; a source without
    records or with cap 0 gives none; repeated records count as records.
    """
    if total is None:
        total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    rates = source_rates(source_sizes(counted), targets, total).where("rate > 0").select("source", "rate")
    key = ["source", "cls", "slice"]
    r = F.xxhash64("doc_id", F.lit(seed))
    rows = (counted.select("doc_id", "source", "n_tokens").where("n_tokens > 0").join(rates, "source")
            .withColumn("r", r)
            .withColumn("cls", F.floor(F.log(F.col("n_tokens").cast("double")) / F.log(F.lit(CLASS_RATIO))).cast("int"))
            .withColumn("slice", F.pmod("r", F.lit(SLICES)).cast("int")))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("n_tokens", "r", "doc_id")))
    blocks = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("cls", "slice").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    u = F.pmod(F.xxhash64("source", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    upto = lambda k: F.floor(k * F.col("rate") + u)
    k = F.col("before") + F.col("rn")
    return (ranked.join(blocks, key)
            .withColumn("copies", (upto(k) - upto(k - 1)).cast("int")).where("copies > 0")
            .select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n_tokens"))


def shares(drawn: DataFrame, counted: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """The share each source of ``targets`` really got, beside its target."""
    if total is None:
        total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count("*").alias("drawn_records"), F.max("copy").alias("most_copies"))
    rows = source_rates(source_sizes(counted), targets, total).join(got, "source", "left")
    rows = rows.select("source", "target_share", "max_repeats", F.col("tokens").alias("available_tokens"),
                       F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("drawn_records", F.lit(0)).alias("drawn_records"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
                       (F.col("drawn_tokens") / F.lit(float(max(total, 1)))).alias("share_of_budget"))
    all_drawn = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target source
    return rows.withColumn("actual_share", F.when(all_drawn > 0, F.col("drawn_tokens") / all_drawn).otherwise(0.0)).na.fill(0.0, ["share_of_budget"])
