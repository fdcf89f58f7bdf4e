"""Mixing sources to target weights.

Method.  Systematic sampling.  The total size is the largest for which every
source can give its share with each document used at most ``max_repeats``
times (or a given total, capped sources then falling short).  Within a source
the documents' expected copies are prefix-summed in a seeded hash order; with
one random offset per source, a document is emitted once per integer boundary
its interval crosses.  Sizes are tokens of a public tokenizer.

The prefix sum is two-level: ranks inside hash buckets of bounded size, plus
bucket offsets, so a source with a third of all rows isn't sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.llm.tokenizer import FOLDER, token_counts
from kinelake.session import cut

BUCKET_ROWS = 50_000
SEED = 20260101


def _plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None) -> DataFrame:
    """Per listed source: its documents and tokens, expected copies e and the total aimed at.  One row per source."""
    listed = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    by = listed.join(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("size")), "source", "left")
    by = by.na.fill(0, ["n_docs", "size"])
    room = by.where("size > 0").agg(F.min(F.col("max_repeats") * F.col("size") / F.col("target_share")).alias("total"))
    if total_tokens is not None:
        room = room.select(F.lit(float(total_tokens)).alias("total"))
    e = F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("total") / F.col("size"))
    return by.crossJoin(F.broadcast(room)).withColumn("expected", F.when(F.col("size") > 0, e).otherwise(F.lit(0.0)))


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED, folder: str = FOLDER) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    mix: doc_id, source, n_tokens, copies (1 to max_repeats) of every document
    used.  shares: source, target_share, max_repeats, n_docs, size (tokens
    there), binding (all its documents are used as often as allowed, so it limits
    the total), docs_used, copies, tokens, share (of the mix's tokens), one row
    per listed source.  Documents of unlisted or null sources and documents
    without tokens (null, empty) are never used; a listed source without
    documents has zeros; ``targets`` with repeated sources keep the larger
    values; an empty table gives an empty mix.
    """
    sized = token_counts(documents, ["doc_id", "source"], folder=folder).where("n_tokens > 0 and source is not null")
    sized = cut(sized)
    plan = cut(_plan(sized, targets, total_tokens))  # one row per source of the targets table
    n = sized.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = sized.withColumn("h", order).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    per_bucket = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("rows_here"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("rows_here").over(w), F.lit(0))).drop("rows_here")
    inside = Window.partitionBy("source", "bucket").orderBy("n_tokens", "h", "doc_id")  # by size, so that every stretch of ranks has all sizes
    ranked = rows.withColumn("r", F.row_number().over(inside)).join(offsets, ["source", "bucket"]).withColumn("r", F.col("r") + F.col("offset"))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = ranked.join(plan.select("source", "expected"), "source")
    copies = F.floor(F.col("r") * F.col("expected") + start) - F.floor((F.col("r") - 1) * F.col("expected") + start)
    mix = drawn.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")
    got = mix.groupBy("source").agg(F.count(F.lit(1)).alias("docs_used"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    shares = plan.select("source", "target_share", "max_repeats", "n_docs", "size", ((F.col("size") > 0) & (F.col("expected") >= F.col("max_repeats") - 1e-9)).alias("binding")).join(got, "source", "left").na.fill(0, ["docs_used", "copies", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over one row per listed source
    shares = shares.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
    return mix, shares
