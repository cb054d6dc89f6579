"""Code simplification: which tokens of a function are kept.

Own definition of the five strategies; ``ratio`` is the share of tokens that stays. Ranks and
running totals inside a function use the bucketed helpers, so a very large function is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linescope.functions.rows import exploded
from linescope.operators.attention import low_rated_tokens
from linescope.operators.ranking import hash_rank, running_distinct, running_totals
from linescope.session import materialise

STRATEGIES = ["slim", "token", "statement", "random", "frequency"]


def _function_sizes(statements: DataFrame) -> DataFrame:
    return statements.groupBy("func_id").agg(F.sum(F.size("tokens")).alias("_size"))


def _keep_target(ratio: float):
    return F.ceil(F.lit(ratio) * F.col("_size"))


def drop_statements(statements: DataFrame, ratio: float) -> DataFrame:
    """Drop the lowest-weighted statements while at least ``ceil(ratio * tokens)`` tokens remain."""
    sized = statements.withColumn("_n", F.size("tokens").cast("bigint"))
    ordered = running_totals(sized, "weight", {"_n": "_dropped_before"}, "stmt_id", part=["func_id"])
    joined = ordered.join(_function_sizes(statements), "func_id")
    # A statement goes when the tokens left after it still reach the target.
    kept = F.col("_size") - F.col("_dropped_before") - F.col("_n") < _keep_target(ratio)
    return joined.where(kept).drop("_n", "_dropped_before", "_size")


def drop_tokens(statements: DataFrame, low: DataFrame) -> DataFrame:
    """(func_id, stmt_id, pos, token) without the low-rated tokens."""
    rows = token_rows(statements)
    return rows.join(low.select("token"), "token", "left_anti").select("func_id", "stmt_id", "pos", "token")


def token_rows(statements: DataFrame) -> DataFrame:
    """(func_id, stmt_id, pos, token), pos 1-based inside the statement."""
    return exploded(statements, ["func_id", "stmt_id"], F.col("tokens"), "token", "at").select(
        "func_id", "stmt_id", (F.col("at") + 1).alias("pos"), "token"
    )


def _with_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_id", F.concat_ws(":", "func_id", "stmt_id", "pos"))


def drop_rare_tokens(statements: DataFrame, weights: DataFrame, ratio: float, seed: object = 42) -> DataFrame:
    """(func_id, stmt_id, pos, token) of the ``ceil(ratio * tokens)`` most frequent tokens of every function.

    Numbers of tokens by function and frequency say at which frequency the cut of a function falls; only the tokens of
    that frequency are ordered, by hash. Tokens move without ids or hashes.
    """
    known = weights.select("token", F.col("frequency").cast("bigint").alias("_freq"))
    rated = materialise(
        token_rows(statements).join(known, "token", "left").withColumn("_freq", F.coalesce("_freq", F.lit(0))), "rated-tokens"
    )
    counts = rated.groupBy("func_id", "_freq").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_distinct(counts, "_freq", {"_n": "_before"}, ["func_id"]).join(_function_sizes(statements), "func_id")
    gone = F.col("_size") - _keep_target(ratio) - F.col("_before")
    split = (gone > 0) & (gone < F.col("_n"))
    cuts = placed.groupBy("func_id").agg(
        F.min(F.when(gone <= 0, F.col("_freq"))).alias("_least"),
        F.max(F.when(split, F.col("_freq"))).alias("_split"),
        F.max(F.when(split, gone)).alias("_gone"),
    )
    tied = F.coalesce(F.col("_freq") == F.col("_split"), F.lit(False))
    near = materialise(
        rated.join(cuts, "func_id")
        .where(tied | (F.col("_freq") >= F.col("_least")))
        .select("func_id", "stmt_id", "pos", "token", F.when(tied, F.col("_gone")).alias("_gone")),
        "kept-tokens",
    )
    ranked = hash_rank(_with_id(near.where(F.col("_gone").isNotNull())), "_id", seed, part=["func_id"], rank="_rank")
    columns = ["func_id", "stmt_id", "pos", "token"]
    return near.where(F.col("_gone").isNull()).select(columns).unionByName(ranked.where(F.col("_rank") >= F.col("_gone")).select(columns))


def simplify(
    statements: DataFrame, weights: DataFrame, strategy: str, ratio: float = 0.6, low: int = 5000, seed: object = 42
) -> DataFrame:
    """Kept tokens ``(func_id, stmt_id, pos, token)`` of statements ``(func_id, stmt_id, tokens, weight)``.

    ``weights`` is the token table ``(token, weight, frequency)``.
    """
    if strategy == "statement":
        return token_rows(drop_statements(statements, ratio))
    if strategy == "token":
        return drop_tokens(statements, low_rated_tokens(weights, low))
    if strategy == "slim":
        return drop_tokens(drop_statements(statements, ratio), low_rated_tokens(weights, low))
    if strategy == "random":
        ranked = hash_rank(_with_id(token_rows(statements)), "_id", seed, part=["func_id"], rank="_rank")
        joined = ranked.join(_function_sizes(statements), "func_id")
        return joined.where(F.col("_rank") < _keep_target(ratio)).select("func_id", "stmt_id", "pos", "token")
    if strategy == "frequency":
        return drop_rare_tokens(statements, weights, ratio, seed)
    raise ValueError(f"unknown strategy {strategy!r}")


def simplified_code(kept: DataFrame) -> DataFrame:
    """(func_id, stmt_id, text): kept tokens of each statement in order."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return kept.groupBy("func_id", "stmt_id").agg(
        F.array_join(F.transform(in_order, lambda s: s["token"]), " ").alias("text")
    )
