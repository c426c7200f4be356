"""The engine over a folder of tables: ingest, preview, ask, statistics, sources, links, reset.

Ledgers and vectors are Parquet tables in versions: a run writes new versions beside the old ones and then moves the
pointer, so a lost run leaves the last state readable.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from loam.functions.text import chunk_id, query_key, short_hash
from loam.operators import chunk, conversation, crawl, items, ledger, links, vectors
from loam.sources import snapshots

LEDGER_PAGES = "url string, content_hash string, version bigint, deleted boolean"
LEDGER_CHUNKS = "url string, chunk_id string, text_hash string"
VECTORS = "chunk_id string, url string, text string, embedding array<float>"
QUERY_CACHE = "key string, embedding array<float>"
_TABLES = {"ledger_pages": LEDGER_PAGES, "ledger_chunks": LEDGER_CHUNKS, "vectors": VECTORS, "query_cache": QUERY_CACHE}
#: Texts that an embedder gets at a time.
EMBED_BATCH = 100


def embedder(embed: Callable[[list[str]], list[list[float]]], size: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """A column function of an embedder of lists; it sees at most size texts at a time, and no nulls."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.dropna()
            made: list[list[float]] = []
            for i in range(0, len(texts), size):
                made += embed(texts.iloc[i : i + size].tolist())
            yield pd.Series(made, index=texts.index, dtype=object).reindex(s.index).map(lambda x: x if isinstance(x, list) else None)

    return run


class Engine:
    """embed turns a text column into a column of float arrays; generate turns a prompt into an answer."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[Column], Column], generate: Callable[[str], str] | None = None) -> None:
        self.spark, self.folder, self.embed, self.generate = spark, folder.rstrip("/"), embed, generate

    def _version(self) -> int:
        try:
            return max((r["version"] for r in self.spark.read.json(f"{self.folder}/_versions").select("version").collect()), default=0)
        except Exception:  # noqa: BLE001 - no version yet
            return 0

    def read(self, name: str) -> DataFrame:
        v = self._version()
        return self.spark.read.parquet(f"{self.folder}/{name}/v={v}") if v else self.spark.createDataFrame([], _TABLES[name])

    def _commit(self, tables: dict[str, DataFrame]) -> None:
        v = self._version() + 1
        for name in _TABLES:
            df = tables[name] if name in tables else self.read(name)
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={v}")
        self.spark.createDataFrame([(v,)], "version bigint").coalesce(1).write.mode("append").json(f"{self.folder}/_versions")

    def _plan(self, pages: DataFrame, pdfs: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        every = (items.items(pages, pdfs) if rows is None else items.all_items(pages, pdfs, rows)).select("url", "text", "title", "category")
        plan = ledger.page_plan(every, self.read("ledger_pages"))
        changed = every.join(plan.where("status <> 'UNCHANGED'").select("url"), "url", "left_semi")
        pieces = chunk.chunks(changed, "url", "text").withColumn("text_hash", F.sha2("chunk", 256))
        return plan, pieces.withColumn("chunk_id", chunk_id(F.col("url"), F.col("idx"), F.col("text_hash"))), every

    def preview(self, pages: DataFrame, pdfs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """(status, n): what a run would do, without writing."""
        return self._plan(pages, pdfs, rows)[0].groupBy("status").agg(F.count("*").alias("n"))

    def ingest(self, pages: DataFrame, pdfs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """Take in one snapshot; with its links also the directory and the statistics. Returns the counts of the run."""
        plan, pieces, _ = self._plan(pages, pdfs, rows)
        old = self.read("ledger_chunks")
        new = ledger.to_embed(pieces, old)
        gone = ledger.stale(pieces, old).dropDuplicates(["chunk_id"])
        counts = plan.groupBy("status").agg(F.count("*").alias("n")).unionByName(new.agg(F.lit("EMBED").alias("status"), F.count("*").alias("n"))).unionByName(gone.agg(F.lit("DELETE").alias("status"), F.count("*").alias("n")))
        told = self.spark.createDataFrame(counts.collect(), counts.schema)
        kept = self.read("vectors").join(gone.select("chunk_id"), "chunk_id", "left_anti").join(new.select("chunk_id"), "chunk_id", "left_anti")
        fresh = new.select("chunk_id", "url", F.col("chunk").alias("text"), self.embed(F.col("chunk")).cast("array<float>").alias("embedding"))
        self._commit({"ledger_pages": ledger.merge_pages(plan, self.read("ledger_pages")), "ledger_chunks": ledger.merge_chunks(pieces, old), "vectors": kept.unionByName(fresh)})
        return told

    def ask(self, questions: DataFrame, history: DataFrame | None = None, k: int = vectors.TOP_K) -> DataFrame:
        """(q_id, confidence, context, prompt) of questions (q_id, question[, session_id])."""
        held = self.read("vectors").withColumn("vec_id", F.xxhash64("chunk_id"))
        asked = questions.select("q_id", self.embed(F.col("question")).alias("embedding"))
        hits = vectors.top_k(held, asked, k)
        docs = held.select(F.col("vec_id").alias("doc_id"), F.col("url").alias("title"), "text")
        out = questions.join(vectors.confidence(hits), "q_id", "left").join(conversation.context(hits, docs), "q_id", "left")
        if history is not None and "session_id" in questions.columns:
            out = out.join(conversation.prompt_history(history), "session_id", "left")
        else:
            out = out.withColumn("history", F.lit(None).cast("string"))
        prompt = F.concat_ws("\n\n", F.concat(F.lit("Answer from the sources below.\n"), F.coalesce("context", F.lit("No sources."))), F.concat(F.lit("Earlier turns:\n"), F.col("history")), F.concat(F.lit("Question: "), F.col("question")))
        return out.select("q_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "context", prompt.alias("prompt"))

    def embed_queries(self, questions: DataFrame) -> DataFrame:
        """(q_id, embedding) of questions (q_id, question): vectors of known questions are taken from the cache, and the
        first spelling of a new one makes its vector, which is kept for later."""
        key = short_hash(query_key(F.col("question")))
        keyed = questions.where("question is not null").select("q_id", "question", key.alias("key"))
        known = self.read("query_cache")
        first = keyed.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by("question", "q_id").alias("question"))
        made = first.select("key", self.embed(F.col("question")).cast("array<float>").alias("embedding"))
        self._commit({"query_cache": known.unionByName(made)})
        return keyed.select("q_id", "key").join(self.read("query_cache"), "key").select("q_id", "embedding")

    def frames(self, questions: DataFrame, history: DataFrame | None = None) -> Iterator[str]:
        """Answers as a stream of JSON frames: chunks of each answer, its end, or an error in its place."""
        frame = lambda event, q, **data: json.dumps({"event": event, "q_id": q, **data}, ensure_ascii=False)
        for r in self.ask(questions, history).toLocalIterator():
            try:
                said = self.generate(r["prompt"]) if self.generate else r["prompt"]
                for part in [said] if isinstance(said, str) else said:
                    yield frame("chunk", r["q_id"], text=part)
                yield frame("end", r["q_id"], confidence=r["confidence"])
            except Exception as e:  # noqa: BLE001 - the generator is the caller's
                yield frame("error", r["q_id"], message=str(e))

    def answers(self, questions: DataFrame, history: DataFrame | None = None):
        """(q_id, answer) one by one, for a stream of frames."""
        for r in self.ask(questions, history).toLocalIterator():
            yield r["q_id"], self.generate(r["prompt"]) if self.generate else r["prompt"]

    def stats(self) -> DataFrame:
        """(name, n): rows of each table."""
        parts = [self.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in _TABLES]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every

    def sources(self, path: str) -> DataFrame:
        """Snapshot files with their counts, the latest first."""
        return snapshots.summary(snapshots.read_snapshots(self.spark, path)).orderBy(F.desc_nulls_last("timestamp"), F.desc("file"))

    @staticmethod
    def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int, priority: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
        return crawl.budgeted(edges, seeds, max_depth, max_pages, priority, excluded)

    @staticmethod
    def links(rows: DataFrame, kind: str = "all") -> DataFrame:
        return rows if kind == "all" else rows.where(F.col("link_type") == kind)

    @staticmethod
    def link_database(rows: DataFrame, pages: DataFrame, pdfs: DataFrame) -> DataFrame:
        return links.link_database(rows, pages, pdfs)

    def reset(self) -> None:
        """Empty all tables, as a new version."""
        self._commit({n: self.spark.createDataFrame([], s) for n, s in _TABLES.items()})
