"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import stored

#: Lengths per step of the two-level running sums.
STEP = 4096


def histogram(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length; NULL and empty texts have length 0."""
    return bpe.encode(df.select("text"), ranks_path, pattern, with_ids=False).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(lengths: DataFrame) -> DataFrame:
    """What every context limit that is a length met in the data would hold.

    `lengths` has (n_tokens, n_docs).  Suffix sums over the lengths give, per length L: docs_over (documents longer
    than L), tokens_over (their tokens), truncated_tokens (all tokens left if documents are cut at L),
    all_docs, all_tokens, and quantile (share of documents of at most L tokens).  An empty table gives
    no rows.  Sums run inside steps of lengths and over the totals of the steps, so no task holds the table.
    """
    own = stored(lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).withColumns(
        {"step": F.expr(f"n_tokens DIV {STEP}"), "tokens": F.expr("n_tokens * n_docs")}))
    after = "ORDER BY {} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    steps = own.groupBy("step").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    steps = steps.select("step", *[F.expr(f"coalesce(sum({c}) OVER ({after.format('step')}), 0)").alias(f"{c}_later") for c in "dt"],
                         F.expr("sum(d) OVER ()").alias("all_docs"), F.expr("sum(t) OVER ()").alias("all_tokens"))
    inside = own.withColumns({f"{c}_in": F.expr(f"coalesce(sum({v}) OVER (PARTITION BY step {after.format('n_tokens')}), 0)")
                              for c, v in (("d", "n_docs"), ("t", "tokens"))})
    return inside.join(steps, "step").select(
        "n_tokens", "n_docs", (F.col("d_in") + F.col("d_later")).alias("docs_over"), (F.col("t_in") + F.col("t_later")).alias("tokens_over"),
        "all_docs", "all_tokens").select(
        "*", F.expr("all_tokens - tokens_over + n_tokens * docs_over").alias("truncated_tokens"),
        F.expr("(all_docs - docs_over) / all_docs").alias("quantile"))


def at_limits(table: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context, truncated_tokens, docs_over) of a few given limits, from the rows of `context_table`.

    Between two lengths the total rises with the limit by one token for every longer document; below the
    shortest every document is cut.  An empty table gives NULLs.
    """
    cols = []
    for n in limits:
        below = F.max(F.expr(f"CASE WHEN n_tokens <= {int(n)} THEN struct(n_tokens, docs_over, truncated_tokens) END"))
        cols.append(F.struct(F.lit(int(n)).cast("long").alias("context"), below.alias("b"), F.max("all_docs").alias("all_docs")))
    return table.agg(F.array(*cols).alias("found")).select(F.explode("found").alias("r")).select(
        "r.context", F.expr("coalesce(r.b.truncated_tokens + (r.context - r.b.n_tokens) * r.b.docs_over, r.context * r.all_docs)").alias("truncated_tokens"),
        F.expr("coalesce(r.b.docs_over, r.all_docs)").alias("docs_over"))
