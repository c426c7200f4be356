"""Cosine search, sources, and locality-sensitive hashing by random hyperplanes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loam.operators.links import LINK_SCORE


#: Queries held by a worker at a time; more are worked on in further blocks.
QUERY_BLOCK = 4096
# Hits of a query, characters of a source's text.
TOP_K, SOURCE_TEXT = 8, 200


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n == 0, F.lit(1e-12)).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, least: float | None = None) -> DataFrame:
    """(q_id, vec_id, score): the k most similar vectors of each query, itself excepted; ties by id.

    Queries are a stated set. They are read in blocks of about QUERY_BLOCK; each block meets all vectors in one scan of
    matrix products, partitions keep their own best k, and a window over the few rows left picks the best.
    """
    held = queries.select("q_id", "embedding").where("embedding is not null")
    blocks = (held.count() + QUERY_BLOCK - 1) // QUERY_BLOCK
    numbered = held.withColumn("b", F.pmod(F.xxhash64("q_id"), F.lit(max(blocks, 1))))
    out = None
    for b in range(max(blocks, 1)):
        q = numbered.where(F.col("b") == b).toPandas()
        ids = q["q_id"].to_numpy()
        m = np.stack([np.asarray(x, dtype=np.float64) for x in q["embedding"]]) if len(q) else np.zeros((0, 1))
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

        def run(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, m: np.ndarray = m) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            for batch in batches:
                batch = batch[[x is not None and len(x) == m.shape[1] for x in batch["embedding"]]]
                if len(batch) == 0 or len(ids) == 0:
                    continue
                v = np.stack([np.asarray(x, dtype=np.float64) for x in batch["embedding"]])
                sim = np.round((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ m.T, 6) + 0.0
                vec = batch["vec_id"].to_numpy()
                sim[vec[:, None] == ids[None, :]] = -9
                order = np.lexsort((np.broadcast_to(vec[:, None], sim.shape), -sim), axis=0)[:k]
                cols = np.broadcast_to(np.arange(len(ids)), order.shape)
                new = pd.DataFrame({"q_id": ids[cols].ravel(), "vec_id": vec[order].ravel(), "score": sim[order, cols].ravel()})
                new = new[new["score"] > -9]
                best = new if best is None else pd.concat([best, new])
                best = best.sort_values(["q_id", "score", "vec_id"], ascending=[True, False, True]).groupby("q_id", sort=False).head(k)
            if best is not None:
                yield best if least is None else best[best["score"] >= least]

        part = vectors.select("vec_id", "embedding").mapInPandas(run, "q_id bigint, vec_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("place", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "vec_id")).cast("bigint"))
    return ranked.where(F.col("place") <= k)


def link_sources(matched: DataFrame, links: DataFrame) -> DataFrame:
    """(q_id, place, url, title, score, text, source): matched links (q_id, key, rank) as sources of one score."""
    held = matched.join(links.select("key", "type", "url", "text", "context"), "key")
    return held.select("q_id", F.col("rank").alias("place"), "url", F.col("text").alias("title"), F.lit(LINK_SCORE).alias("score"), F.coalesce(F.nullif("context", F.lit("")), "text").alias("text"), F.col("type").alias("source"))


def sources(hits: DataFrame, docs: DataFrame, least: float, linked: DataFrame | None = None) -> DataFrame:
    """Sources of hits: score filter, the first in hit order for each url, rows without url kept, then by score.

    linked are the sources of links: they come after those of documents, so a url found in a document stays with it.
    """
    held = hits.join(docs.select(F.col("doc_id").alias("vec_id"), "url", "title", "text"), "vec_id")
    if linked is not None:
        parts = held.select("q_id", F.struct(F.lit(0).alias("kind"), "place").alias("place"), "url", "title", "score", F.concat(F.substring(F.coalesce("text", F.lit("")), 1, SOURCE_TEXT), F.lit("...")).alias("text"), F.lit("document").alias("source"))
        both = parts.unionByName(linked.withColumn("place", F.struct(F.lit(1).alias("kind"), "place"))).where(F.coalesce("score", F.lit(0.0)) >= least)
        one = F.row_number().over(W.partitionBy("q_id", "url").orderBy("place"))
        return both.withColumn("n", one).where("n = 1 or url is null or url = ''").withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "place")).cast("bigint")).drop("n", "place")
    kept = held.where(F.coalesce("score", F.lit(0.0)) >= least).select("q_id", "place", "url", "title", "score", F.concat(F.substring(F.coalesce("text", F.lit("")), 1, SOURCE_TEXT), F.lit("...")).alias("text"))
    first = F.row_number().over(W.partitionBy("q_id", "url").orderBy("place"))
    return kept.withColumn("n", first).where("n = 1 or url is null or url = ''").drop("n").withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "place")).cast("bigint")).drop("place")


def confidence(hits: DataFrame) -> DataFrame:
    return hits.groupBy("q_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("confidence"))


# Hyperplanes: a seeded 32-bit generator and normal draws give the same planes everywhere ---------------------------


def uniform(seed: int):
    """Uniform draws of the mulberry32 generator."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    return draw


def gaussian(draw) -> float:
    u = v = 0.0
    while u == 0:
        u = draw()
    while v == 0:
        v = draw()
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def plane_seed(space: str, model: str, dim: int) -> int:
    return int(hashlib.sha256(f"{space}:{model}:{dim}".encode()).hexdigest()[:8], 16)


def planes(bits: int, dim: int, space: str = "resp:v1", model: str = "default") -> list[list[float]]:
    draw, out = uniform(plane_seed(space, model, dim)), []
    for _ in range(bits):
        v = [gaussian(draw) for _ in range(dim)]
        n = math.sqrt(sum(x * x for x in v)) or 1e-12
        out.append([x / n for x in v])
    return out


def signature(vec: Column, hyper: list[list[float]]) -> Column:
    """Bit b is set where the vector lies on the positive side of plane b."""
    held = F.lit(0).cast("bigint")
    for b, p in enumerate(hyper):
        plane = F.array(*map(F.lit, p))
        held = held + F.when(F.round(dot(vec, plane), 9) >= 0, F.lit(1 << b)).otherwise(0).cast("bigint")
    return held


def masks(bits: int, radius: int) -> list[int]:
    """Signature changes within a Hamming radius; over 2 behaves as 2."""
    out = [0]
    if radius >= 1:
        out += [1 << i for i in range(bits)]
    if radius >= 2:
        out += [(1 << i) ^ (1 << j) for i in range(bits) for j in range(i + 1, bits)]
    return out


def near(queries: DataFrame, items: DataFrame, bits: int, radius: int, apart: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, vec_id): pairs whose signatures differ in at most radius bits: an equi-join on neighbour signatures.

    apart names further columns of both sides that must be equal, such as the model that made the vectors."""
    around = F.transform(F.array(*map(F.lit, masks(bits, radius))), lambda m: F.col("sig").bitwiseXOR(m.cast("bigint")))
    asked = queries.select("q_id", *apart, F.explode(around).alias("sig"))
    return asked.join(items.select("vec_id", *apart, "sig"), [*apart, "sig"]).where(F.col("q_id") != F.col("vec_id")).select("q_id", "vec_id")


def near_any(queries: DataFrame, items: DataFrame, tables: list[list[list[float]]], radius: int) -> DataFrame:
    """(q_id, vec_id): pairs that are near in any of several tables of hyperplanes; both sides are (vec_id, embedding)."""
    every = None
    for hyper in tables:
        sign = lambda df: df.select("vec_id", signature(F.col("embedding"), hyper).alias("sig"))  # noqa: B023, E731
        part = near(sign(queries).withColumnRenamed("vec_id", "q_id"), sign(items), len(hyper), radius)
        every = part if every is None else every.unionByName(part)
    return every.distinct()


def best_hit(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(q_id, vec_id, score): the most similar usable candidate of each query; the first id of equals."""
    v = vectors.select("vec_id", "embedding")
    q = v.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    scored = pairs.join(v, "vec_id").join(q, "q_id").select("q_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    best = scored.groupBy("q_id").agg(F.max_by(F.struct("vec_id", "score"), F.struct("score", -F.col("vec_id"))).alias("x"))
    return best.select("q_id", "x.*").where(F.col("score") >= least)


