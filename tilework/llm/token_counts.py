"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of
from .words import default_path, encoder

#: Lengths that one window task accumulates; block totals carry on from block to block.
BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents encode to each length, over whole texts.

    A null text counts as empty (length 0), repeated rows count each, other
    columns are ignored, an empty table gives no rows. Each task emits a row per
    distinct length it met; Spark sums them.
    """
    path = tokenizer or default_path()

    def lengths(batches):
        found: Counter = Counter()
        for batch in batches:
            found.update(len(encoder(path).encode(x)) // 2 for x in batch.column(0).to_pylist())
            if len(found) > 100_000:
                yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})
                found = Counter()
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    counted = docs.select(text_of(docs).alias("text")).mapInArrow(lengths, "n_tokens long, n long")
    return counted.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, as a context limit:

    docs_at_least, tokens_at_least (documents of L tokens or more),
    truncated_tokens (the corpus with every document cut to L), n_tokens_total,
    rank_from and rank_to (the ranks, from 1, of its documents by length).
    Lengths are dealt into blocks, whose totals are carried on, so no task has all.
    """
    h = histogram.select("n_tokens", "n_docs").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_tokens") * F.col("n_docs")
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens")).select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(everything).alias("all_docs"), F.sum("tokens").over(everything).alias("all_tokens"),
    )
    here = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    out = h.join(blocks, "block").withColumns({"docs_at_least": F.sum("n_docs").over(here) + F.col("docs_later"), "tokens_at_least": F.sum(tokens).over(here) + F.col("tokens_later")})
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        F.col("all_tokens").alias("n_tokens_total"),
        (F.col("all_docs") - F.col("docs_at_least") + 1).alias("rank_from"), (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("rank_to"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that reach it, the corpus' tokens once cut to it, and the share that is kept.

    No documents of that length or more: nothing is cut. Limits are a short list given by the caller.
    """
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    total = sums.agg(F.max("n_tokens_total").alias("total"))
    reach = sums.join(F.broadcast(asked), F.col("n_tokens") >= F.col("context_limit")).groupBy("context_limit").agg(F.max("docs_at_least").alias("docs"), F.max("tokens_at_least").alias("tokens"))
    out = asked.join(F.broadcast(total)).join(reach, "context_limit", "left").na.fill(0, ["docs", "tokens", "total"])
    kept = F.col("total") - F.col("tokens") + F.col("docs") * F.col("context_limit")
    return out.select("context_limit", F.col("docs").alias("docs_at_least"), kept.alias("truncated_tokens"), F.when(F.col("total") > 0, kept / F.col("total")).alias("kept_share"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q: the least length that at least q of the documents do not exceed (none for an empty corpus)."""
    asked = sums.sparkSession.createDataFrame([(float(q),) for q in shares], "q double")
    n = sums.agg(F.max("rank_to").alias("n"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    return sums.crossJoin(F.broadcast(n)).join(F.broadcast(asked), rank.between(F.col("rank_from"), F.col("rank_to"))).select("q", "n_tokens")
