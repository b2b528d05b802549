"""Exact top-k by inner product over a whole corpus of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell import rules
from tracewell.functions.vectors import EmbedderFactory, embed
from tracewell.operators.sizes import landed

MAX_QUERY_BYTES = 32 * 1024 * 1024  # of query vectors sent to every task
TILE_ROWS = 50_000  # corpus rows, and queries, per tile beyond that
BLOCK_QUERIES = 256  # queries scored at once, so that scores stay a few MB
BROADCAST_HITS = 1_000_000  # hit rows (no vectors) joined back by broadcast
SCORE_DECIMALS = 9  # scores equal to this many places are ties, decided by id


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int | None = None) -> np.ndarray:
    """A list column as a (rows, dims) double array; vectors of another length raise."""
    if not len(column):
        return np.zeros((0, dims or 0))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    dims = int(sizes[0]) if dims is None else dims
    if (sizes != dims).any():
        raise ValueError(f"a vector has {sizes[sizes != dims][0]} numbers, not {dims}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), dims)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An id column as an array that numpy can sort."""
    ids = np.asarray(column)
    return ids.astype(str) if ids.dtype == object else ids


class _Best:
    """The k best (score, id) per query seen so far by one task."""

    def __init__(self, query_ids: np.ndarray, vectors: np.ndarray, k: int, skip_self: bool):
        self.query_ids, self.vectors, self.k, self.skip_self = query_ids, vectors, k, skip_self
        self.kept: list[tuple | None] = [None] * -(-len(query_ids) // BLOCK_QUERIES)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for block in range(len(self.kept)):
            span = slice(block * BLOCK_QUERIES, (block + 1) * BLOCK_QUERIES)
            with np.errstate(invalid="ignore", over="ignore"):
                scores = np.round(vectors @ self.vectors[span].T, SCORE_DECIMALS)
            # a score that is no number is no hit, and takes the place of none
            scores[~np.isfinite(scores)] = -np.inf
            if self.skip_self:
                scores[ids[:, None] == self.query_ids[span][None, :]] = -np.inf
            floor = np.full(scores.shape[1], -np.inf)
            if len(ids) > self.k:
                floor = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
            row, query = np.nonzero((scores >= floor) & (scores > -np.inf))
            found = (query, scores[row, query], ids[row])
            if self.kept[block] is not None:
                found = tuple(np.concatenate(pair) for pair in zip(self.kept[block], found))
            self.kept[block] = self._cut(*found)

    def _cut(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple:
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        start = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - start < self.k
        return query[keep], score[keep], ids[keep]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for block, kept in enumerate(self.kept):
            if kept is not None and len(kept[0]):
                query, score, ids = kept
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(self.query_ids[block * BLOCK_QUERIES + query]),
                        pa.array(ids),
                        pa.array(score),
                    ],
                    names=["query_id", "id", "score"],
                )


def _hits_schema(corpus: DataFrame, queries: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    query_kind = queries.schema["query_id"].dataType.simpleString()
    return f"query_id {query_kind}, id {kinds['id']}, score double"


def _by_broadcast(corpus, queries, table: pa.Table, k: int, skip_self: bool) -> DataFrame:
    query_ids = _ids(table["query_id"])
    vectors = _matrix(table["embedding"])
    sent = corpus.sparkSession.sparkContext.broadcast((query_ids, vectors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*sent.value, k, skip_self)
        for batch in batches:
            if batch.num_rows:
                best.add(_ids(batch.column("id")), _matrix(batch.column("embedding"), sent.value[1].shape[1] or None))
        yield from best.batches()

    return corpus.mapInArrow(score, _hits_schema(corpus, queries))


def _by_tiles(
    corpus: DataFrame, queries: DataFrame, k: int, skip_self: bool, tile_rows: int
) -> DataFrame:
    pieces = -(-corpus.count() // tile_rows) or 1
    blocks = -(-queries.count() // tile_rows) or 1

    def spread(rows: DataFrame, key: str, own: str, parts: int, other: str, copies: int):
        mine = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        return rows.select(key, "embedding", mine.alias(own), every.alias(other))

    left = spread(corpus, "id", "piece", pieces, "block", blocks)
    right = spread(queries, "query_id", "block", blocks, "piece", pieces)
    schema = _hits_schema(corpus, queries)

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = pa.schema(
            [
                ("query_id", asked.schema.field("query_id").type),
                ("id", rows.schema.field("id").type),
                ("score", pa.float64()),
            ]
        )
        if not rows.num_rows or not asked.num_rows:
            return kinds.empty_table()
        best = _Best(_ids(asked["query_id"]), _matrix(asked["embedding"]), k, skip_self)
        dims = best.vectors.shape[1]
        for batch in rows.to_batches(max_chunksize=10_000):
            best.add(_ids(batch.column("id")), _matrix(batch.column("embedding"), dims))
        found = list(best.batches())
        return pa.Table.from_batches(found) if found else kinds.empty_table()

    return (
        left.groupBy("piece", "block")
        .cogroup(right.groupBy("piece", "block"))
        .applyInArrow(score, schema)
    )


def vector_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = rules.TOP_K,
    skip_self: bool = False,
    max_query_bytes: int = MAX_QUERY_BYTES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The k best corpus rows per query: (query_id, rank, id, score).

    ``corpus`` is (id, embedding), ``queries`` (query_id, embedding). Every
    vector is scored. Each task keeps k per query, so what is shuffled is
    k x queries x tasks and not one score per pair.

    The queries are sent to all tasks while they fit ``max_query_bytes``. More
    than that are cut into blocks, as is the corpus, and each pair of blocks is
    one group of bounded size. Starts a job to measure the queries. A corpus
    smaller than k gives fewer rows.
    """
    corpus = corpus.select("id", "embedding").where(F.col("embedding").isNotNull())
    queries = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    # written once: a model behind the queries runs once, whatever is asked of them here
    queries = landed(queries, "query-vectors")
    first = queries.select(F.size("embedding").alias("dims")).head()
    dims = first.dims if first else 1
    fit = max(1, max_query_bytes // (8 * max(dims, 1)))
    table = queries.limit(fit + 1).toArrow()
    if table.num_rows <= fit:
        partial = _by_broadcast(corpus, queries, table, k, skip_self)
    else:
        partial = _by_tiles(corpus, queries, k, skip_self, tile_rows)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def search(
    knowledge_base: DataFrame,
    questions: DataFrame,
    factory: EmbedderFactory,
    k: int = rules.TOP_K,
) -> DataFrame:
    """Best chunks per question: (query_id, rank, score, title, url, text).

    ``questions`` is (query_id, text). Vectors are ranked without their texts;
    the texts of the hits are fetched at the end.
    """
    queries = questions.select("query_id", embed(F.col("text"), factory).alias("embedding"))
    corpus = knowledge_base.select(F.col("chunk_id").alias("id"), "embedding")
    hits = vector_topk(corpus, queries, k).withColumnRenamed("id", "chunk_id")
    if questions.limit(BROADCAST_HITS // k + 1).count() <= BROADCAST_HITS // k:
        hits = F.broadcast(hits)
    texts = knowledge_base.select("chunk_id", "title", "url", "text")
    return texts.join(hits, "chunk_id").select("query_id", "rank", "score", "title", "url", "text")
