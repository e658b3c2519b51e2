"""Mixing sources by temperature: shares to a power, found by bisection, realised as block permutations.

Each source's share of all tokens is raised to one exponent between 0 (equal weights) and 1 (natural weights). Bisection
finds the smallest exponent whose largest repetition of a source stays within a limit, or the largest whose entropy is at
least a target. Each round tries the middle points of the next four halvings in one grouped aggregation over the table of sources.

A source then owes its weight's part of the token budget. It pays in epochs, each a permutation of all its rows by a keyed
hash, the last one cut where the budget is met. The mix is dealt into blocks of about `block_tokens`: every source gives each
block the same part of its budget, and within a block rows of all sources are permuted by another keyed hash.

Positions within an epoch are running token sums in hash order. They are summed in three levels (coarse ranges, fine ranges,
rows), so no task ever orders more than one small range, however large a source is. Only column expressions are used.

Defined cases: a row counts at least one token, so null and empty texts take part; a null source is the source with the
empty name; rows that tie in the hash are repeated rows and change places freely; if even the natural weights repeat more
than the limit, they are used; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.shared import broadcast_if_small, written

REPEAT_LIMIT = 2.0
BLOCK_TOKENS = 1_000_000
SEED = 17
COARSE_BITS = 8
FINE_ROWS = 256
HALVINGS = 4
ROUNDS = 8
BROADCAST_ROWS = 100_000


def token_count(text: Column) -> Column:
    """Runs of characters that are not white space, one at least."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"\S++")), F.lit(0)), F.lit(1)).cast("long")


def source_sizes(rows: DataFrame) -> DataFrame:
    """(source, tokens, rows, log_share) of a table with source and tokens."""
    sizes = written(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "sizes")
    total = sizes.agg(F.sum("tokens")).first()[0] or 1
    return sizes.withColumn("log_share", F.log(F.col("tokens") / F.lit(float(total))))


def _tried(sizes: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """For each exponent: log of the weights' sum, their entropy, and largest over least growth of a share."""
    each = sizes.select("log_share", F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    power, growth = F.exp(F.col("a") * F.col("log_share")), F.exp((F.col("a") - 1.0) * F.col("log_share"))
    found = each.groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.col("a") * F.col("log_share")).alias("s"),
        F.max(growth).alias("most"), F.min(growth).alias("least"),
    )
    return {r["a"]: (r["z"], math.log(r["z"]) - r["s"] / r["z"], r["most"], r["least"]) for r in found.collect()}


def bisected_exponent(
    sizes: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None, budget_share: float | None = None
) -> float:
    """The exponent that meets the repetition limit or the entropy target.

    `budget_share` is the budget as a share of all tokens; without it the budget is the least that uses every row once.
    """
    if (repeat_limit is None) == (target_entropy is None):
        raise ValueError("give either a repetition limit or a target entropy")

    def met(tried: tuple) -> bool:
        z, entropy, most, least = tried
        if target_entropy is not None:
            return entropy >= target_entropy
        return (most / least if budget_share is None else most / z * budget_share) <= repeat_limit

    # Entropy is met below some exponent, the limit above one; search for the border from the side that meets it.
    low, high = 0.0, 1.0
    ends = _tried(sizes, [low, high])
    if len(ends) < 2:
        return 1.0
    best, other = (low, high) if target_entropy is None else (high, low)
    if met(ends[best]):
        return best
    best, other = other, best  # the end that meets it, if any does
    if not met(ends[best]):
        return best
    for _ in range(ROUNDS):
        parts = 1 << HALVINGS
        points = [best + (other - best) * i / parts for i in range(1, parts)]
        tried = _tried(sizes, points)
        reached = 0
        for i, p in enumerate(points, 1):
            if not met(tried[p]):
                break
            reached = i
        best, other = best + (other - best) * reached / parts, best + (other - best) * (reached + 1) / parts
    return best


def quotas(sizes: DataFrame, exponent: float, budget_tokens: int | None = None) -> DataFrame:
    """(source, tokens, rows, weight, quota): normalised weights and the tokens each source gives to the mix."""
    power = F.exp(F.lit(exponent) * F.col("log_share"))
    summed = sizes.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("need")).first()
    z, need = summed["z"] or 1.0, summed["need"] or 0.0
    budget = need * z if budget_tokens is None else float(budget_tokens)
    weight = power / F.lit(z)
    return sizes.select("source", "tokens", "rows", weight.alias("weight"), F.round(weight * budget).cast("long").alias("quota"))


def _with_offsets(draws: DataFrame) -> DataFrame:
    """Adds `before`: tokens that stand before a row in the hash order of its source and epoch."""
    ranged = draws.withColumn("coarse", F.shiftrightunsigned("h", 64 - COARSE_BITS))
    rest = F.shiftrightunsigned(F.shiftleft("h", COARSE_BITS), 33)  # the next 31 bits
    coarse = ranged.groupBy("source", "epoch", "coarse").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    in_epoch = Window.partitionBy("source", "epoch").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = written(
        coarse.select(
            "source", "epoch", "coarse", F.coalesce(F.sum("t").over(in_epoch), F.lit(0)).alias("coarse_before"),
            F.ceil(F.col("n") / FINE_ROWS).alias("parts"),
        ),
        "coarse",
    )
    keys = ["source", "epoch", "coarse"]
    ranged = ranged.join(broadcast_if_small(coarse, coarse.count(), BROADCAST_ROWS), keys).withColumn(
        "fine", F.shiftright(rest * F.col("parts"), 31)
    )
    fine = ranged.groupBy(*keys, "fine").agg(F.sum("tokens").alias("t"))
    in_coarse = Window.partitionBy(*keys).orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.select(*keys, "fine", F.coalesce(F.sum("t").over(in_coarse), F.lit(0)).alias("fine_before"))
    in_fine = Window.partitionBy(*keys, "fine").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(fine, [*keys, "fine"]).withColumn(
        "before", F.col("coarse_before") + F.col("fine_before") + F.coalesce(F.sum("tokens").over(in_fine), F.lit(0))
    )


def mixed(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    repeat_limit: float | None = REPEAT_LIMIT,
    target_entropy: float | None = None,
    budget_tokens: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """One row per use of an input row: key, source, n_tokens, epoch, block, block_order (ascending within the block)."""
    body = F.coalesce(df[text].cast("string"), F.lit(""))
    rows = written(
        df.select(
            df[key].alias("own_key"), F.coalesce(df[source].cast("string"), F.lit("")).alias("source"), token_count(body).alias("tokens"),
            F.xxhash64(df[key], body).alias("mark"),
        ),
        "rows",
    )
    sizes = source_sizes(rows)
    share = None
    if budget_tokens is not None:
        share = budget_tokens / (sizes.agg(F.sum("tokens")).first()[0] or 1)
    owed = quotas(sizes, bisected_exponent(sizes, repeat_limit, target_entropy, share), budget_tokens)
    owed = written(owed.where("quota > 0"), "quotas")
    budget, count = owed.agg(F.sum("quota"), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil((budget or 0) / block_tokens))
    epochs = F.ceil(F.col("quota") / F.col("source_tokens")).cast("int")
    draws = (
        rows.join(broadcast_if_small(owed.select("source", F.col("tokens").alias("source_tokens"), "quota"), count, BROADCAST_ROWS), "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
        .withColumn("h", F.xxhash64(F.lit(seed), "epoch", "mark"))
    )
    placed = _with_offsets(draws).withColumn("at", F.col("epoch") * F.col("source_tokens") + F.col("before"))
    taken = placed.where(F.col("at") < F.col("quota")).withColumn(
        "block", F.floor(F.col("at") / F.col("quota") * F.lit(float(blocks))).cast("long")
    )
    return taken.select(
        F.col("own_key").alias(key), "source", F.col("tokens").alias("n_tokens"), "epoch", "block",
        F.xxhash64(F.lit(seed), "block", "h").alias("block_order"),
    )
