"""Document fingerprints by spot signatures, with expressions only.

An anchor is a common word. The chain of the next content words (words that are no anchors) after a run of
anchors forms one signature; a text's set of signatures is its fingerprint, and likeness is the Jaccard
coefficient of two sets. Boilerplate holds few anchors, running prose many, so the signatures follow the prose.

Sets of sizes m <= n have a Jaccard coefficient of at most m / n. `matches` therefore partitions the sets by
size, so that a set meets only its own partition and the next, drops pairs by that bound and by the rarest
signatures two alike sets must share, and computes the coefficient for the rest. Equal sets are one class: they
are compared once, and a hot class of copies never expands into pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wastelake.llm.common import shuffle_width, whole_text, with_place
from wastelake.session import materialize

CHAIN, THRESHOLD = 3, 0.8
#: Most ranges of ids in one pass, and how many of them are looked through at a time.
RANGES, FINE = 16_384, 128
# Common words of English, German, French and Spanish.
ANCHORS = {
    "en": "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were what which who will with you",
    "de": "als am an auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in ist mit nach nicht sich sie sind so und von war wie wird zu zum zur",
    "fr": "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous",
    "es": "al como con de del el ella en es esta este fue ha la las le lo los más no o para pero por que se sin su sus también un una y ya",
}
STOP = sorted({w for words in ANCHORS.values() for w in words.split()})
#: Words: runs of letters and digits in any script.
WORD = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _content_places(words: Column) -> Column:
    """Places of the words that are no anchors."""
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~words[i].isin(STOP))


def with_signatures(df: DataFrame, text: Column, name: str, chain: int = CHAIN) -> DataFrame:
    """`df` with the sorted set of 64-bit signatures of `text` as column `name`.

    A chain is the first content word after an anchor and the content words after it, `chain` in all. Near the
    end of a text a chain is as long as the rest. A text with words but without any anchor before a content
    word has one signature, its whole word sequence; a text without words has none.
    """
    words, places = f"{name}_words", f"{name}_places"
    no_places, no_hashes = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<bigint>)")
    df = df.withColumn(words, words_of(text))
    df = df.withColumn(places, F.when(F.size(words) > 0, _content_places(F.col(words))).otherwise(no_places))
    w, p = F.col(words), F.col(places)

    def follows(j: Column) -> Column:
        """Whether content word j has an anchor right before it."""
        return p[j] > F.when(j > 0, F.get(p, j - 1)).otherwise(F.lit(-1)) + 1

    def chained(j: Column) -> Column:
        """Missing words at the end are null and hash to the seed before them."""
        return F.xxhash64(*[F.get(w, F.get(p, j + k)) for k in range(chain)])

    spots = F.when(F.size(p) > 0, F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), follows), chained)).otherwise(no_hashes)
    df = df.withColumn(name, F.array_sort(F.array_distinct(spots)))
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(no_hashes)
    return df.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(whole)).drop(words, places)


def digest(signatures: Column) -> Column:
    """The fingerprint as text: number of signatures and a hash of the sorted set."""
    return F.concat_ws("-", F.size(signatures).cast("string"), F.lower(F.lpad(F.hex(F.xxhash64(signatures)), 16, "0")))


def jaccard(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard coefficient of two sets; 0 without comparing them where their sizes rule out `at_least`. Two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    bound = (small == 0) | (small < large * at_least)
    return F.when(large == 0, 1.0).when(bound, 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def size_partition(size: Column, threshold: float) -> Column:
    """Number of the partition of a set size: sets whose sizes allow the threshold are at most one partition apart."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) - 1e-9).cast("int")


def matches(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class) of every row, and pairs (a, b, jaccard) of different classes at or above the threshold.

    A class holds the rows with one set of signatures; rows without words are the class of the empty set, which
    matches no other. Two sets with coefficient t share a signature among the first n - ceil(t n) + 1 of each
    when both are in one order; the order is by rarity, so candidates meet on rare signatures. Null texts count
    as empty, null ids are kept, an empty table gives empty frames.
    """
    rows = with_signatures(docs.select(F.col(f"`{id}`").alias("doc_id"), whole_text(text).alias("_text")), F.col("_text"), "sigs", chain)
    signed = materialize(rows.select("doc_id", digest(F.col("sigs")).alias("class"), "sigs"), "signatures")
    sets = materialize(signed.groupBy("class").agg(F.first("sigs").alias("sigs")).where(F.size("sigs") > 0), "sets")
    each = sets.select("class", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rarity = materialize(each.groupBy("sig").agg(F.count("*").alias("df")), "rarity")
    ranked = each.join(rarity, "sig").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("order"))
    first = F.slice("order", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    heads = materialize(ranked.select("class", "n", size_partition(F.col("n"), threshold).alias("part"), F.explode(first).alias("h")).select("class", "n", "part", F.col("h.sig").alias("sig")), "heads")
    lower = heads.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    near = lower.alias("x").join(heads.alias("y"), ["sig", "part"]).where("x.class != y.class and (x.n < y.n or (x.n = y.n and x.class < y.class))").where(F.col("x.n") >= F.col("y.n") * threshold)
    pairs = near.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    left, right = sets.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb"), threshold).alias("jaccard"))
    return signed.select("doc_id", "class"), scored.where(F.col("jaccard") >= threshold)


def _range_of(id: Column, starts: list[int]) -> Column:
    """Number of the range an id lies in, by a coarse and a fine look at the sorted starts."""
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    up_to = lambda xs: F.size(F.filter(xs, lambda b: b <= id))
    coarse = F.greatest(up_to(array(starts[::FINE])) - 1, F.lit(0)) * FINE
    return coarse + up_to(F.slice(array(starts), coarse + 1, F.lit(FINE))) - 1


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, next: every row with the text of the next row by id, after the last the first.

    Rows go by id (null last), then by their place in the table. They are cut into ranges of ids at values that
    occur; each range gets the rows of the next range's first id as guests, so that its last row finds its
    successor there, and the windows stay as small as the ranges.
    """
    rows, _ = with_place(docs.select(F.col(f"`{id}`").alias("doc_id"), whole_text(text).alias("text")))
    parts = min(RANGES, 4 * shuffle_width(docs.sparkSession))
    marks = rows.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(parts)], 100 * parts).alias("m")).first()["m"]
    starts = sorted(set(marks or [])) or [0]
    place = F.when(F.col("doc_id").isNull(), len(starts) - 1).otherwise(_range_of(F.col("doc_id"), starts))
    own = rows.select("doc_id", "_row", "text", F.greatest(place, F.lit(0)).alias("range"), F.lit(0).alias("guest"))
    guests = own.where(F.col("doc_id").isin(starts) if marks else F.col("doc_id").isNull()).withColumn("range", F.pmod(F.col("range") - 1, F.lit(len(starts)))).withColumn("guest", F.lit(1))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_last(), "_row")
    return own.unionByName(guests).withColumn("next", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next")


def op3(docs: DataFrame) -> DataFrame:
    """The contract's rows: fingerprints of each text, of its edit, and their likeness.

    A single row's next document is itself.
    """
    df = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next"), F.lit(1), half)))
    for source, name in (("text", "own"), ("edited", "changed"), ("next", "following")):
        df = with_signatures(df, F.col(source), name)
    return df.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("own")).alias("fingerprint"),
        digest(F.col("changed")).alias("edited_fingerprint"),
        jaccard(F.col("own"), F.col("changed")).alias("near_edited"),
        jaccard(F.col("own"), F.col("following")).alias("near_next"),
    )
