"""Response cache: eligible answers stored by hyperplane signature, looked up by similar question vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loam.operators import vectors

# Seconds an answer is kept, signature bits, radius, least similarity, candidates, size of a bucket.
TTL_S, BITS, RADIUS, LEAST, CANDIDATES, BUCKET = 7 * 86400, 16, 1, 0.92, 200, 1000


def _bucket(df: DataFrame) -> list[str]:
    return ["model_key", "sig"] if "model_key" in df.columns else ["sig"]


def usable(text: Column, sources: Column, confidence: Column) -> Column:
    """Whether an answer may be stored or served: a text, sources, and a confidence over 0."""
    return F.coalesce((F.trim(text) != "") & (F.size(sources) > 0) & (confidence > 0) & ~F.isnan(confidence), F.lit(False))


def item_id(vector: Column, text: Column) -> Column:
    """The id of a stored answer: of its vector and its text."""
    return F.left(F.sha2(F.concat_ws("|", F.array_join(F.transform(vector, lambda x: x.cast("float").cast("string")), ","), text), 256), F.lit(32))


def put(answers: DataFrame, planes: list[list[float]], bucket: int = BUCKET) -> DataFrame:
    """Eligible answers (item_id, embedding, text, sources, confidence, language, created_at[, model_key]) with their
    signature; of a full bucket the latest stay. Buckets of different models are apart."""
    kept = answers.where(usable(F.col("text"), F.col("sources"), F.col("confidence"))).withColumn("sig", vectors.signature(F.col("embedding"), planes))
    return kept.withColumn("n", F.row_number().over(W.partitionBy(*_bucket(answers)).orderBy(F.desc("created_at"), F.desc("item_id")))).where(F.col("n") <= bucket).drop("n")


def look_up(questions: DataFrame, cache: DataFrame, planes: list[list[float]], now: Column, least: float = LEAST, radius: int = RADIUS, candidates: int = CANDIDATES, ttl_s: int = TTL_S) -> DataFrame:
    """(q_id, item_id, score): the best stored answer of each question (q_id, embedding, language[, model_key]) in its
    language, by the same model."""
    asked = questions.withColumn("sig", vectors.signature(F.col("embedding"), planes))
    around = F.transform(F.array(*map(F.lit, vectors.masks(len(planes), radius))), lambda m: F.col("sig").bitwiseXOR(m.cast("bigint")))
    near = asked.select("q_id", F.col("embedding").alias("q"), *[c for c in _bucket(questions) if c != "sig"], "language", F.explode(around).alias("sig"))
    fresh = cache.where(F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_s)) >= now)
    met = near.join(fresh, [*_bucket(questions), "language"])
    first = met.withColumn("n", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("created_at"), "item_id"))).where(F.col("n") <= candidates)
    scored = first.withColumn("score", F.round(vectors.cosine(F.col("q"), F.col("embedding")), 6)).where(F.col("score") >= least)
    best = scored.groupBy("q_id").agg(F.max_by(F.struct("item_id", "score"), F.struct("score", -F.col("item_id"))).alias("x"))
    return best.select("q_id", "x.*")
