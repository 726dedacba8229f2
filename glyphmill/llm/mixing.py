"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Sizes are counted once; each source's target is filled first by complete epochs of all of its documents, and
what is left by documents in ascending order of their exponential keys (-ln u over the quality weight), up to
the budget in words. The order is never built: ever finer ranges of keys, with prefix sums of their words, close in
on the key at which the budget ends, and each document compares its own key with that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import staged, text_or_empty

#: Most times that a document may be taken; targets stop at this multiple of their source's size.
MOST_EPOCHS = 3
#: Ranges that an interval of keys is cut into at once.
RANGES = 4096
#: Documents of this mean word length weigh most.
USUAL_WORD = 6.0
#: Signs and digits that prose holds few of.
SIGNS = "0123456789{}[]<>|\\/#$%&*+=@^_~"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    """0.25 to 1: how near the characters a word are to the usual number, on a log scale, times the share of characters that are no signs."""
    chars = F.length(text)
    ratio = chars / F.greatest(words, F.lit(1)) / F.lit(USUAL_WORD)
    prose = F.length(F.translate(text, SIGNS, "")) / F.greatest(chars, F.lit(1))
    return F.greatest(F.lit(0.25), prose / (F.lit(1.0) + F.abs(F.log(F.greatest(ratio, F.lit(1e-6))))))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from 48 bits of the MD5 of id and text; a null id counts as the text 'null'."""
    digest = F.substring(F.md5(F.concat_ws("\x1f", F.coalesce(doc_id.cast("string"), F.lit("null")), text).cast("binary")), 1, 12)
    return (F.conv(digest, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def keyed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """docs with _size (words), _key (exponential over the weight) and _scan (the part of the scan that a row is in)."""
    text = text_or_empty()
    with_size = docs.withColumn("_size", word_count(text)).withColumn("_scan", F.spark_partition_id())
    return with_size.withColumn("_key", -F.log(uniform(F.col("doc_id"), text)) / (quality_weight(text, F.col("_size")) if weight is None else weight))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. A target stops
    at MOST_EPOCHS times its source's size; the excess is shared anew by weight until no target is above. The
    sources are taken in order of size to weight: a source is at its limit if its limit is below the share that
    it would get of what the limits before it leave.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = ranked.withColumn("total", F.sum("source_size").over(everything)).select(
        "source", "source_size", "weight",
        (F.col("total") - MOST_EPOCHS * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("weights"),
    )
    limit = F.lit(MOST_EPOCHS) * F.col("source_size")
    at_limit = limit * F.col("weights") <= F.col("left") * F.col("weight")
    level = F.min(F.when(~at_limit, F.struct(F.col("source_size") / F.col("weight"), F.col("left"), F.col("weights")))).over(everything)
    return shared.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(at_limit, limit.cast("double")).otherwise(F.col("weight") * F.col("level.left") / F.col("level.weights")).alias("target"),
    )


def _cuts(own: DataFrame) -> DataFrame:
    """(_source, source_size, target, _epochs, budget, _cut, _before, _ties) of each source.

    _cut: the key at which the budget ends; _before: words of smaller keys; _ties: rows with that very key. Every round
    cuts each source's interval into RANGES and goes on with the one where the budget ends, until that holds one key.
    """
    narrow = staged(own.select("source", "_size", "_key"), "mixing-keys")
    sums = staged(narrow.groupBy("source").agg(F.sum("_size").alias("source_size"), F.min("_key").alias("low"), F.max("_key").alias("high"), F.count("*").alias("_ties")), "mixing-sums")
    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long")
    targets = source_targets(sums.select("source", "source_size")).withColumn("_epochs", epochs).withColumn("budget", F.floor("target").cast("long") - F.col("_epochs") * F.col("source_size"))
    bounds = sums.select(F.col("source").alias("_source"), "low", "high", "_ties")
    state = staged(targets.join(bounds, targets["source"].eqNullSafe(bounds["_source"])).drop("source").withColumn("_before", F.lit(0).cast("long")), "mixing-state")
    order = Window.partitionBy("_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    kept = ["_source", "source_size", "target", "_epochs", "budget"]
    while not (open_ := state.filter("high > low AND source_size > 0")).isEmpty():
        inside = narrow.join(open_.drop("_ties"), narrow["source"].eqNullSafe(open_["_source"]) & (F.col("_key") >= F.col("low")) & (F.col("_key") <= F.col("high")))
        place = F.least(F.lit(RANGES - 1), F.floor((F.col("_key") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES)).cast("int")
        ranges = inside.groupBy(*kept, "_before", place.alias("range")).agg(F.sum("_size").alias("words"), F.min("_key").alias("low"), F.max("_key").alias("high"), F.count("*").alias("_ties"))
        ahead = F.col("_before") + F.coalesce(F.sum("words").over(order), F.lit(0))
        ends = ranges.withColumn("ahead", ahead).filter("ahead <= budget AND budget < ahead + words").select(*kept, "low", "high", "_ties", F.col("ahead").alias("_before"))
        state = staged(state.filter("NOT (high > low AND source_size > 0)").unionByName(ends), "mixing-state")
    return state.select(*kept, F.col("low").alias("_cut"), "_before", "_ties")


def _placed(own: DataFrame, cuts: DataFrame) -> DataFrame:
    """own (with _size, _key, _scan) with source_size, target, _epochs and _part."""
    joined = own.join(cuts, own["source"].eqNullSafe(cuts["_source"]))
    left = F.col("budget") - F.col("_before")
    part = F.when(F.col("_key") < F.col("_cut"), F.col("_size")).when(F.col("_key") > F.col("_cut"), F.lit(0).cast("long"))
    alone = part.otherwise(F.least(F.col("_size"), left))
    if cuts.filter("_ties > 1").isEmpty():
        found = joined.withColumn("_part", alone)
    else:  # rows with the cut's key are copies of one text under one id: numbered within each part of the scan
        tied = (F.col("_key") == F.col("_cut")) & (F.col("_ties") > 1)
        copies = joined.filter(tied)
        counts = copies.groupBy(F.col("_source").alias("s"), F.col("_scan").alias("p")).agg(F.count("*").alias("n"))
        offsets = counts.withColumn("_ahead", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        numbered = copies.withColumn("_n", F.row_number().over(Window.partitionBy("_source", "_scan").orderBy("_key")) - 1).join(offsets, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_scan") == F.col("p")))
        shared = numbered.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_size"), left - (F.col("_ahead") + F.col("_n")) * F.col("_size")))).drop("s", "p", "n", "_ahead", "_n")
        found = joined.filter(~tied).withColumn("_part", alone).unionByName(shared)
    return found.drop("_source", "budget", "_cut", "_before", "_ties", "_key", "_scan")


def _taken(placed: DataFrame) -> DataFrame:
    return placed.withColumn("size", F.col("_size")).withColumn("taken", F.col("_epochs") * F.col("_size") + F.col("_part")).drop("_size")


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, taken, _epochs and _part (words of the last, partial epoch).

    weight: a quality weight above zero (quality_weight if not given). taken is the number of words that the mix takes
    from the row: whole epochs times its size, and in the last epoch all, none, or, for the one row of a source where
    its budget ends, as many words as are left. So each source's taken words are its target without the fraction. Null
    text has size 0 and takes nothing; null sources are one source, the last; of copies of one text under one doc_id as
    many are taken as the budget reaches; an empty table gives no rows; other columns stay (names with these meanings
    are replaced). Texts are never shuffled, but for such copies at the end of a budget.
    """
    clash = {"size", "source_size", "target", "taken", "_epochs", "_part", "_size", "_key", "_scan", "_cut", "_before", "_source", "_ties", "budget"}
    own = keyed(docs.drop(*clash), weight)
    return _taken(_placed(own, _cuts(own)))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows that the mix takes, with the columns of docs: a row for each epoch, the last one cut to its words.

    Documents without words have nothing to take and stay once, as they are; so do columns of any other name.
    """
    given = docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))
    epoch = F.explode(F.sequence(F.lit(1), F.greatest(F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_epochs") + F.when(F.col("_part") > 0, 1).otherwise(0)), F.lit(0)))).alias("_epoch")
    kept = mix(given).filter((F.col("size") == 0) | (F.col("taken") > 0)).select("*", epoch)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = (F.col("_epoch") > F.col("_epochs")) & (F.col("_part") < F.col("size"))
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_part").cast("int")), "")).otherwise(F.col("text"))
    changed = kept.select("_row", cut.alias("_is_cut"), text.alias("_new"))
    length = F.when(F.col("_is_cut"), F.length("_new").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None
    own = {"text": F.col("_new"), "n_chars": length}
    return changed.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op4_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = staged(keyed(docs).select("doc_id", "source", "_size", "_key", "_scan"), "mixing-sizes")
    return _taken(_placed(own, _cuts(own))).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH counted AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents),
keyed AS (
  SELECT doc_id, source, text, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || chr(31) || text), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
         / greatest(0.25, length(translate(text, '0123456789{}[]<>|\\/#$%&*+=@^_~', ''))::DOUBLE / greatest(length(text), 1)
                          / (1.0::DOUBLE + abs(ln(greatest(length(text)::DOUBLE / greatest(size, 1) / 6.0::DOUBLE, 1e-6))))) AS key
  FROM counted),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         (sum(source_size) OVER ())::BIGINT AS total FROM sources),
shared AS (
  SELECT *, total - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_over,
         (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
  FROM ranked),
level AS (
  SELECT left_over, weights FROM shared WHERE NOT 3 * source_size * weights <= left_over * weight
  ORDER BY source_size / weight, left_over, weights LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size * weights <= left_over * weight THEN (3 * source_size)::DOUBLE
              ELSE (weight * (SELECT left_over FROM level))::DOUBLE / (SELECT weights FROM level) END AS target
  FROM shared),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
placed AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs,
         floor(b.target)::BIGINT - b.epochs * b.source_size AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - ahead)))::BIGINT AS taken
FROM placed
"""
