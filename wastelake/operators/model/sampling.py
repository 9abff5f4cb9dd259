"""Deterministic samples by seeded hash order: no random generator, no full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wastelake.functions import hashing as H


def priority(seed: int = H.SEED) -> Column:
    return H.uniform("sample", F.col("bin_id"), F.col("date"), seed=seed)


def bottom_k(rows: DataFrame, k: int, seed: int = H.SEED) -> DataFrame:
    """The k rows with the smallest seeded hash of (bin, date)."""
    return rows.withColumn("priority", priority(seed)).orderBy("priority", "bin_id", "date").limit(k)


def stratified_bottom_k(rows: DataFrame, k: int, schemas: list[list[str]], seed: int = H.SEED) -> DataFrame:
    """One mandatory row (smallest hash) per stratum of each schema, filled up to k by hash order."""
    keyed = rows.withColumn("priority", priority(seed))
    firsts = None
    for schema in schemas:
        best = keyed.groupBy(*schema).agg(F.min(F.struct("priority", "bin_id", "date")).alias("m")).select("m.bin_id", "m.date")
        firsts = best if firsts is None else firsts.unionByName(best)
    firsts = firsts.distinct().withColumn("mandatory", F.lit(True))
    needed = firsts.count()  # one number; the strata must fit the sample
    if needed > k:
        raise ValueError(f"{needed} strata exceed the sample limit {k}; raise it explicitly")
    marked = keyed.join(firsts, ["bin_id", "date"], "left").withColumn("mandatory", F.coalesce("mandatory", F.lit(False)))
    return marked.orderBy(F.desc("mandatory"), "priority", "bin_id", "date").limit(k)


def pool_sample(bins: DataFrame, pools: int, extremes: int = 5) -> DataFrame:
    """Bins of whole (site, stream) pools: the first by hash, the first of every stratum, the most loaded.

    bins: id, site_id, waste_type, object_group, district, exposure, capacity_m3.
    """
    key = ["site_id", "waste_type"]
    ranked = bins.withColumn("rank", H.uniform("pool", F.col("site_id"), F.col("waste_type")))
    first = ranked.select("rank", *key).distinct().orderBy("rank", *key).limit(pools).select(*key)
    labels = F.explode(
        F.array(
            F.concat(F.lit("type:"), F.coalesce("object_group", F.lit(""))), F.concat(F.lit("waste:"), F.col("waste_type")),
            F.concat(F.lit("district:"), F.coalesce("district", F.lit(""))), F.concat(F.lit("zero:"), (F.col("exposure") == 0).cast("string")),
        )
    )
    strata = ranked.select("rank", *key, labels.alias("label")).groupBy("label").agg(F.min(F.struct("rank", *key)).alias("m")).select("m.site_id", "m.waste_type")
    top = ranked.orderBy(F.desc(F.col("exposure") / F.col("capacity_m3")), "id").limit(extremes).select(*key)
    chosen = first.unionByName(strata).unionByName(top).distinct()
    return bins.join(chosen, key, "left_semi")


def site_holdout(rows: DataFrame, fraction: float) -> DataFrame:
    """Marks rows of held-out sites: the given share of sites by hash order, at least one."""
    sites = rows.select("site_id").distinct()
    n = max(1, int(sites.count() * fraction))
    held = sites.withColumn("rank", H.uniform("holdout", F.col("site_id"))).orderBy("rank", "site_id").limit(n)
    return rows.join(held.select("site_id", F.lit(True).alias("held_out")), "site_id", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def mask_history(rows: DataFrame, history_columns: list[str]) -> DataFrame:
    """Cold start: history inputs of held-out sites become unknown."""
    return rows.withColumns({c: F.when(~F.col("held_out"), F.col(c)) for c in history_columns})
