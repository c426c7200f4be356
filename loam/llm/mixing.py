"""Mixing sources to target weights.

Every record of a source gets the same expected number of uses, m = (tokens wanted) / (tokens there). Its whole part
is fixed; its fraction is rounded by pivotal sampling, weighted by size: two records exchange mass (fraction times
tokens, so that the source's total stays) in a random direction until one of them is whole. Blocks of records are
worked on in parallel; each leaves one undecided record, and these go up a tree of blocks until one a source is left,
which a draw decides. So each source ends within one record of its goal, and every record keeps its expectation.

The total is the largest at which no source needs more than max_repeats uses of a record, unless given. With a given
total a source that cannot reach its share gives all it may. Shares are those of the targets whose source occurs,
brought to a sum of 1.

Defined cases: sources are compared after trimming and lower-casing; records of no target source, with null source,
or without tokens are not used; targets without records have share 0 reached; repeated targets of a source: the
largest share stands; null or negative shares count as 0, null max_repeats as 1; draws depend on seed and doc_id only.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.text import squeeze
from loam.storage import cut

BLOCK = 2000
EPS = 1e-9


def source_name(c) -> F.Column:
    return F.lower(squeeze(c))


def pivotal(frac: list[float], size: list[float], draw) -> list[float]:
    """Fractions after pairwise transfers; all but one at most are 0 or 1; sum(frac * size) stays."""
    f = list(frac)
    held = -1
    for i in range(len(f)):
        if f[i] <= EPS or f[i] >= 1 - EPS:
            f[i] = float(round(f[i]))
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        # Mass that can flow to a (up) or from a (down).
        up = min((1 - f[a]) * size[a], f[b] * size[b])
        down = min(f[a] * size[a], (1 - f[b]) * size[b])
        move = up if draw() * (up + down) < down else -down
        f[a] += move / size[a]
        f[b] -= move / size[b]
        held = -1
        for k in (a, b):
            if f[k] <= EPS or f[k] >= 1 - EPS:
                f[k] = float(round(f[k]))
            else:
                held = k
    return f


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, there, n, goal, m): one row for each target source."""
    t = targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")).where("source is not null")
    t = t.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*")
    s = sizes.groupBy("source").agg(F.sum("n_tokens").alias("there"), F.count("*").alias("n"))
    joined = t.join(s, "source", "left").fillna(0, ["there", "n"]).withColumn("share", F.when(F.col("there") > 0, F.col("target_share")).otherwise(0.0))
    one = joined.agg(F.sum("share").alias("all"), F.min(F.when(F.col("share") > 0, F.col("there") * F.col("max_repeats") / F.col("share"))).alias("least")).first()
    whole = one["all"] or 1.0
    aim = float(total) if total is not None else (one["least"] or 0.0) * whole
    return joined.withColumn("goal_share", F.col("share") / whole).withColumn("goal", F.col("goal_share") * aim).withColumn("m", F.when(F.col("there") > 0, F.least(F.col("goal") / F.col("there"), F.col("max_repeats").cast("double"))).otherwise(0.0)).drop("share")


def mix(records: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 17, total: float | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(chosen, goals) of records (key, source, n_tokens): chosen is (key, source, n_tokens, uses) with uses over 0."""
    sizes = records.select(key, source_name(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).where("source is not null and n_tokens > 0")
    sizes = cut(sizes.join(targets.select(source_name(F.col("source")).alias("source")).distinct(), "source", "left_semi"))
    goals = plan(sizes, targets, total)
    most = goals.agg(F.max("n")).first()[0] or 0
    fixed = sizes.join(goals.select("source", "m", "n"), "source").select(key, "source", "n_tokens", F.floor("m").cast("int").alias("base"), (F.col("m") - F.floor("m")).alias("frac"), F.expr(f"greatest(1, cast(ceil(n / {float(block)}) as bigint))").alias("blocks"))
    state = fixed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), key), F.col("blocks"))).drop("blocks")
    schema = f"{key} bigint, source string, n_tokens bigint, base int, frac double, block bigint"

    def level(depth: int):
        def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            import random

            rng = random.Random(hashlib.sha256(f"{seed}|{depth}|{group[0]}|{group[1]}".encode()).digest())
            rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
            rows["frac"] = pivotal(rows["frac"].tolist(), rows["n_tokens"].astype(float).tolist(), rng.random)
            rows["block"] //= block
            return rows[[key, "source", "n_tokens", "base", "frac", "block"]]

        return run

    done, depth, blocks = None, 0, max(1, -(-most // block))
    while True:
        out = cut(state.groupBy("source", "block").applyInPandas(level(depth), schema))
        whole = out.where((F.col("frac") == 0) | (F.col("frac") == 1))
        done = whole if done is None else done.unionByName(whole)
        state = out.where((F.col("frac") > 0) & (F.col("frac") < 1))
        if blocks <= 1:
            break
        blocks, depth = -(-blocks // block), depth + 1
    # One record a source at most is left.
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), key), F.lit(1 << 53)) / float(1 << 53)
    done = done.unionByName(state.withColumn("frac", F.when(draw < F.col("frac"), 1.0).otherwise(0.0)))
    return done.select(key, "source", "n_tokens", (F.col("base") + F.col("frac").cast("int")).alias("uses")).where("uses > 0"), goals


def shares(chosen: DataFrame, goals: DataFrame) -> DataFrame:
    """What each source was to give and gives."""
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    out = goals.join(got, "source", "left").fillna(0, ["tokens", "records", "most_uses"])
    whole = out.agg(F.sum("tokens")).first()[0] or 1
    return out.select("source", "target_share", F.round("goal_share", 6).alias("goal_share"), "max_repeats", F.col("there").cast("bigint").alias("tokens_there"), F.col("tokens").cast("bigint").alias("tokens"), "records", F.col("most_uses").cast("int").alias("most_uses"), F.round(F.col("tokens") / F.lit(float(whole)), 6).alias("reached_share"))
