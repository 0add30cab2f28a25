"""Seeded samples and selections; the draw is a hash of seed and id, so it does not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256)


def simple_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.select(key).distinct().orderBy(draw(key, seed), key).limit(n)


def stratified_sample(df: DataFrame, key: str, stratum: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """(key, stratum): up to the given number of keys of each stratum. Keys must be unique."""
    w = Window.partitionBy(stratum).orderBy(draw(key, seed), key)
    want = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(stratum))
    most = max(sizes.values())
    ranked = df.where(F.col(stratum).isin(list(sizes))).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    return ranked.where(F.col("__r") <= want).select(key, stratum)


def allocate(groups: DataFrame, group: str, size: str, target: int) -> DataFrame:
    """Largest-remainder allocation of ``target`` in proportion to ``size``: (group, size, allocated).

    Ties of remainders go to the larger and then to the smaller group. Only the groups that get one more
    are ordered, by a top-k.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    if not total:
        return groups.select(group, size, F.lit(0).cast("long").alias("allocated"))
    exact = groups.withColumn("__x", F.col(size) * target).withColumn("__a", F.floor(F.col("__x") / total)).withColumn("__m", F.col("__x") % total)
    left = target - (exact.agg(F.sum("__a")).first()[0] or 0)
    more = exact.orderBy(F.desc("__m"), F.desc(size), group).limit(int(left)).select(group, F.lit(1).alias("__e"))
    return exact.join(more, group, "left").select(group, size, (F.col("__a") + F.coalesce("__e", F.lit(0))).alias("allocated"))


def proportional_sample(df: DataFrame, key: str, group: str, target: int, seed: int) -> DataFrame:
    """(key, group): a sample of ``target`` rows with groups in proportion."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col(group).isNotNull())
    plan = allocate(sizes, group, "n", target)
    w = Window.partitionBy(group).orderBy(draw(key, seed), key)
    return df.join(plan, group).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.col("allocated")).select(key, group)


def pick_until(groups: DataFrame, group: str, size: str, target: int) -> DataFrame:
    """Largest groups first until ``target`` is reached, the one that crosses it included; ties by name.

    The crossing size is found on the histogram of sizes, so only groups of exactly that size are ordered.
    """
    hist = groups.where(F.col(size) > 0).groupBy(size).agg(F.count(F.lit(1)).alias("k")).withColumn("s", F.col(size) * F.col("k"))
    w = Window.orderBy(F.desc(size))
    row = hist.withColumn("c", F.sum("s").over(w)).where(F.col("c") >= target).orderBy("c").limit(1).collect()
    if not row:
        raise ValueError("the groups together do not reach the target")
    at, before = row[0][size], row[0]["c"] - row[0]["s"]
    need = -(-(target - before) // at)
    return groups.where(F.col(size) > at).select(group, size).union(groups.where(F.col(size) == at).orderBy(group).limit(int(need)).select(group, size))
