"""Encoding with a public byte-level BPE vocabulary, inside the JVM.

Texts are cut into words by the vocabulary's pattern. Only distinct words are encoded: a fold over the bytes of a
word merges, again and again, the adjacent pair whose concatenation has the lowest rank, until no pair has one. Ranks
come from a literal map (an array of small maps, addressed by a checksum, as a lookup in a Spark map is a scan).
Texts travel through no shuffle: of the distinct chunks between spaces, with their ids, the most frequent (a fixed
bound) are broadcast, and a second scan looks chunks up and joins their ids. A chunk that is not among them leaves a
hole, and holes are filled by a join with the table of the other chunks. Decoding concatenates the pieces' bytes.

Bytes are held as ISO-8859-1 strings, one character a byte.

Defined cases: null and empty texts give an empty list; no special token is added or recognised; white space is
encoded as any other text; a word over LONG_WORD bytes is merged by a heap in Python, with the same result, as a fold
over arrays is quadratic.
"""

from __future__ import annotations

import base64
import heapq
import json
import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loam.storage import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_WORD = 400
#: So many chunks at most are broadcast; the occurrences of all others are joined with theirs.
HOT_CHUNKS = 200_000

_S = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_S = "[^" + _S[1:]
#: The vocabulary's word pattern in Java's syntax.
PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S[1:-1]}\p{{L}}\p{{N}}]+|{_S}+(?!{_NOT_S})|{_S}+"


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def words(text: Column) -> Column:
    """The pieces of a text that are encoded one by one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def as_bytes(c: Column) -> Column:
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def bucket_count(n: int) -> int:
    return max(16, 1 << max(0, n // 2).bit_length())


def literal_map(entries: dict[str, object], value_type: str) -> tuple[Column, int]:
    """A literal array of maps; an entry lies in the map that the checksum of its key names."""
    n = bucket_count(len(entries))
    buckets: list[dict[str, object]] = [{} for _ in range(n)]
    for k, v in entries.items():
        buckets[zlib.crc32(k.encode()) % n][k] = v
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), f"array<map<string,{value_type}>>"), n


def look_up(held: tuple[Column, int], key: Column) -> Column:
    """The entry's value, or null."""
    return F.try_element_at(F.get(held[0], F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(held[1])).cast("int")), key)


def fold_merges(word: Column, rank: tuple[Column, int]) -> Column:
    """Symbols of a word (one character a byte) after all ranked merges."""
    chars = F.split(word, "")
    pair_rank = lambda a, b: look_up(rank, F.concat(a, b))
    ranks = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), pair_rank)

    def merge(state: Column, _: Column) -> Column:
        s, r = state["s"], state["r"]
        best = F.array_min(r)
        p = F.array_position(r, best).cast("int")
        n = F.size(s)
        joined = F.concat(F.element_at(s, p), F.element_at(s, p + 1))
        before = F.when(p > 1, F.array(pair_rank(F.element_at(s, p - 1), joined))).otherwise(F.array().cast("array<int>"))
        after = F.when(p + 1 < n, F.array(pair_rank(joined, F.element_at(s, p + 2)))).otherwise(F.array().cast("array<int>"))
        merged = F.struct(
            F.concat(F.slice(s, 1, p - 1), F.array(joined), F.slice(s, p + 2, n)).alias("s"),
            F.concat(F.slice(r, 1, F.greatest(p - 2, F.lit(0))), before, after, F.slice(r, p + 2, n)).alias("r"),
        )
        return F.when(best.isNull(), state).otherwise(merged)

    return F.aggregate(F.sequence(F.lit(2), F.size(chars)), F.struct(chars.alias("s"), ranks.alias("r")), merge, lambda st: st["s"])


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap: for long words."""
    n = len(word)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if i >= 0 and j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or nxt[i] >= n or end[nxt[i]] != stop:
            continue
        j = nxt[i]
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


def long_word_ids(ranks: Broadcast):
    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda w: None if w is None else merge_bytes(w.encode("latin-1"), ranks.value))

    return encode


def word_ids(distinct: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, word_ids) of (word): one row for each distinct word."""
    ranks = load_ranks(vocabulary)
    literal, buckets = literal_map({k.decode("latin-1"): v for k, v in ranks.items()}, "int")

    def code(word: Column, held: Column) -> Column:
        whole = look_up((held, buckets), word)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(fold_merges(word, (held, buckets)), lambda s: look_up((held, buckets), s)))

    held = distinct.withColumn("__b", as_bytes(F.col("word")))
    # A lambda binds the literal, so that the plan holds it once.
    short = held.where(F.length("__b") <= LONG_WORD).select("word", F.transform(F.array(literal), lambda m: code(F.col("__b"), m))[0].alias("word_ids"))
    long = held.where(F.length("__b") > LONG_WORD).select("word", long_word_ids(distinct.sparkSession.sparkContext.broadcast(ranks))(F.col("__b")).alias("word_ids"))
    return short.unionByName(long)


def knotted(text: Column) -> Column:
    """Whether two spaces meet further white space."""
    return text.rlike(f"  {_S}|{_S}  ")


def chunk_ids(docs: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(chunk, n, ids): the ids of every distinct chunk of the texts, and how often it occurs.

    Texts are cut before single spaces, where no word of the pattern crosses; knotted texts into their words.
    """
    some = docs.where(F.col(text) != "")
    cut_up = some.where(~knotted(F.col(text))).select(F.posexplode(F.split(text, " ", -1)).alias("i", "p")).select(F.when(F.col("i") == 0, F.col("p")).otherwise(F.concat(F.lit(" "), F.col("p"))).alias("chunk"))
    each = cut_up.unionByName(some.where(knotted(F.col(text))).select(F.explode(words(F.col(text))).alias("chunk")))
    counted = cut(each.groupBy("chunk").agg(F.count("*").alias("n")))
    parts = counted.select("chunk", "n", F.posexplode_outer(words(F.col("chunk"))).alias("i", "word"))
    coded = word_ids(parts.where("word is not null").select("word").distinct(), vocabulary)
    return parts.join(coded, "word", "left").groupBy("chunk").agg(F.max("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "word_ids"))), lambda x: F.coalesce(x["word_ids"], F.array().cast("array<int>")))).alias("ids"))


def look_up_chunks(hot: Broadcast, key_fields: list[str]):
    """A function over Arrow batches (keys, text, pieces) that puts the ids of broadcast chunks in their places: segs are
    the ids between holes, holes the chunks that are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, bytes] = {}
        later: dict[str, bytes] = {}
        for c, x in zip(*pickle.loads(hot.value)):
            if c[:1] == " ":
                later[c[1:]] = x
            else:
                first[c] = x
        for batch in batches:
            segs: list[bytes] = []
            counts, holes = [0], []
            for text, pieces in zip(batch.column("__text").to_pylist(), batch.column("__pieces").to_pylist()):
                if pieces is None and not text:
                    segs.append(b"")
                    holes.append([])
                else:
                    if pieces is None:
                        a, *rest = text.split(" ")
                        each = [first.get(a), *map(later.get, rest)]
                    else:
                        each = [later.get(w[1:]) if w[0] == " " else first.get(w) for w in pieces]
                    if None in each:
                        names = [a, *(" " + w for w in rest)] if pieces is None else pieces
                        own, start = [], 0
                        for i, x in enumerate(each):
                            if x is None:
                                segs.append(b"".join(each[start:i]))
                                own.append(names[i])
                                start = i + 1
                        segs.append(b"".join(each[start:]))
                        holes.append(own)
                    else:
                        segs.append(b"".join(each))
                        holes.append([])
                counts.append(len(segs))
            ends = np.cumsum([0] + [len(r) // 4 for r in segs], dtype="int64").astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(segs), dtype="<i4")))
            out = [batch.column(k) for k in key_fields] + [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), ids), pa.array(holes, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=[*key_fields, "__segs", "__holes"])

    return run


def encode(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, hot_chunks: int = HOT_CHUNKS, out: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., out): the ids of every text. Columns besides key and keep are dropped."""
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.maxPlanStringLength", "0") or 0) > 1_000_000:
        spark.conf.set("spark.sql.maxPlanStringLength", "100000")  # the literal is not worth printing
    coded = cut(chunk_ids(docs, text, vocabulary))
    # The most frequent chunks, so that what reaches the driver and the workers has a fixed bound.
    hot = coded.orderBy(F.desc("n"), "chunk").limit(hot_chunks).select("chunk", "n", "ids").toArrow()
    held = spark.sparkContext.broadcast(pickle.dumps((hot.column("chunk").to_pylist(), [np.asarray(x, dtype="<i4").tobytes() for x in hot.column("ids").to_pylist()])))
    keys = [key, *keep]
    knot = knotted(F.col(text))
    asked = docs.select(*keys, F.when(~knot, F.col(text)).alias("__text"), F.when(knot, words(F.col(text))).alias("__pieces"))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    looked = asked.mapInArrow(look_up_chunks(held, keys), f"{schema}, __segs array<array<int>>, __holes array<string>")
    if hot.num_rows < hot_chunks:
        return looked.select(*keys, F.get("__segs", F.lit(0)).alias(out))
    least, last = hot.column("n")[-1].as_py(), hot.column("chunk")[-1].as_py()
    rest = coded.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("chunk") > last))).select("chunk", "ids")
    numbered = cut(looked.withColumn("__row", F.monotonically_increasing_id()))
    asking = numbered.where(F.size("__holes") > 0)
    filled = asking.select("__row", F.posexplode("__holes").alias("at", "chunk")).join(rest, "chunk").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("f"))
    both = F.zip_with("__segs", F.transform("f", lambda x: x["ids"]), lambda s, f: F.concat(s, F.coalesce(f, F.array().cast("array<int>"))))
    done = asking.join(filled, "__row").select(*keys, F.flatten(both).alias(out))
    return numbered.where(F.size("__holes") == 0).select(*keys, F.get("__segs", F.lit(0)).alias(out)).unionByName(done)


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of a list of ids: the pieces' bytes in a row, read as UTF-8."""
    ranks = load_ranks(vocabulary)
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k.decode("latin-1")
    held = F.from_json(F.lit(json.dumps(pieces, ensure_ascii=False)), "array<string>")
    return F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.get(held, i)), ""), "ISO-8859-1"), "UTF-8")
