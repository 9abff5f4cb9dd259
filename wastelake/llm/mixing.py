"""Mixing sources to target weights by whole repetitions and one hash-seeded Bernoulli copy.

Words are summed per source, a target per source is found by sharing the wanted total by weight
under a cap, and every document is taken floor(rate) times plus once more with probability equal to
the fraction of the rate. The draw is a hash of the seed and the id, so reruns and retries agree.

Only sums per source are shuffled, with map-side combine; the table of sources joins back as written
rows, so Spark sends it to the documents where it is small and else splits a hot source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wastelake.llm.common import free_name, whole_text, word_count
from wastelake.session import materialize

SHARE, CAP, SEED = 1.5, 2.0, 42
#: Weights given to the sources in code-point order, again and again.
CYCLE = (5, 2, 1)
#: Hex digits of the draw: 52 bits, exact in a double.
DIGITS = 13


def draw(id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def cycled_weights(sources: DataFrame, cycle: Sequence[float] = CYCLE) -> DataFrame:
    """source, weight: the weights in turn over the sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(x)) for x in cycle])
    return sources.select("source", weights[(place % len(cycle)).cast("int")].alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size) and (source, weight).

    The total is `share` of all sizes. Filling by weight until a source meets `cap` times its size, and
    sharing the excess again, ends where every capped source lies below one common level: so sources
    are ordered by cap over weight, and one is capped when its own level is below the level of what the
    sources before it leave; the first that is not capped tells the common level. One row per source passes here, never a document.
    """
    level = F.col("_cap") / F.col("weight")
    before = Window.orderBy(level, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")))
    s = s.select("s.source", "source_size", "weight", (F.col("source_size") * float(cap)).alias("_cap"))
    s = s.withColumn("_total", F.sum("source_size").over(whole) * float(share)).withColumn("_weights", F.sum("weight").over(whole))
    left = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("_left", left).withColumn("_capped", level <= F.col("_left"))
    free = ~F.col("_capped")
    common = F.max(F.when(free, F.col("_left"))).over(whole)
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(common * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, id: str, source: str, text: str) -> DataFrame:
    named = [F.col(f"`{id}`").alias("doc_id"), F.col(f"`{source}`").alias("source")]
    return materialize(docs.select(*named, word_count(whole_text(text)).alias("size")), "sizes")


def _goals(sized: DataFrame, weights: DataFrame | None, share: float, cap: float) -> DataFrame:
    """source, source_size, target: one written row per source."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return materialize(targets(sizes, cycled_weights(sizes) if weights is None else weights, share, cap), "targets")


def copies_of(id: Column, source_size: Column, target: Column, seed: int = SEED) -> Column:
    """floor(rate), and one more with probability equal to the fraction."""
    rate = F.when(source_size > 0, target / source_size).otherwise(0.0)
    return (F.floor(rate) + (draw(id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def plan_copies(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: DataFrame | None = None, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies for every row.

    Size is the number of words, 0 for null; null is a source of its own. A source without words has
    target 0 and its documents are not taken. Rows with one id draw alike, so repeated rows are taken
    equally often; a null id draws as the text 'null'. An empty table gives no rows, other columns are
    not read. `weights` holds (source, weight) with weights above 0; without it CYCLE is dealt out.
    """
    sized = _sized(docs, id, source, text)
    joined = sized.alias("d").join(_goals(sized, weights, share, cap).alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    return joined.select("doc_id", "size", "source_size", "target", copies_of(F.col("doc_id"), F.col("source_size"), F.col("target"), seed).alias("copies"))


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: DataFrame | None = None, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of `docs` with all columns, each as often as its copies; see plan_copies.

    The rows meet the table of sources alone, so no text moves while that table is small enough to be sent to them.
    """
    names = {n: free_name(docs, n) for n in ("_source", "_size", "_target", "_copies")}
    goals = _goals(_sized(docs, id, source, text), weights, share, cap).toDF(names["_source"], names["_size"], names["_target"])
    joined = docs.join(goals, docs[f"`{source}`"].eqNullSafe(goals[names["_source"]]))
    counted = joined.withColumn(names["_copies"], copies_of(docs[f"`{id}`"], F.col(names["_size"]), F.col(names["_target"]), seed)).where(F.col(names["_copies"]) > 0)
    return counted.withColumn(names["_copies"], F.explode(F.sequence(F.lit(1), F.col(names["_copies"]).cast("int")))).select(*[docs[f"`{c}`"] for c in docs.columns])


def op4(docs: DataFrame) -> DataFrame:
    """The contract's rows: words taken of every document."""
    return plan_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
p AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS room
      FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN cap / weight <= room THEN cap ELSE weight * max(CASE WHEN cap / weight > room THEN room END) OVER () END AS target FROM p),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, {DIGITS}))::BIGINT / {16**DIGITS}::DOUBLE AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size AS taken FROM r
"""
