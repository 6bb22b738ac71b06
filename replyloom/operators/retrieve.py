"""Similar resolved cases: exact and hashed nearest neighbours, re-ranking, grounding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from replyloom import constants as K
from replyloom.functions.prompts import example_line
from replyloom.functions.text import _col
from replyloom.operators.keys import first_by_key, lookup_join, top_per_key
from replyloom.operators.meeting import (_ARROW_HITS, _SCALE, LEAST_ROWS, QUERY_ROWS, READ_ROWS,
                                         Best, Read, _matrix, meet_stored, write_stored)
from replyloom.schemas import HITS
from replyloom.session import materialise, ship_package

# Query sets up to this many rows travel to the corpus; larger ones meet it block by block.
BROADCAST_QUERIES = 4096
# Stored rows that meet a block of queries at a time.
BLOCK_ROWS = 16_384
# Elements of one similarity matrix held at a time inside a task.
_MATRIX_ELEMENTS = 4_000_000

# --- work inside one task: dense similarities between two bounded blocks ---------------

def _block_hits(queries: pa.Table, corpus: pa.Table, k: int) -> pa.Table:
    """The ``k`` best corpus rows of this block for each query, in no particular order."""
    if queries.num_rows == 0 or corpus.num_rows == 0:
        return _ARROW_HITS.empty_table()
    corpus = corpus.sort_by("pair_id")
    ids = corpus.column("pair_id").combine_chunks()
    c, q = _matrix(corpus.column("embedding")), _matrix(queries.column("embedding"))
    n, take = len(ids), min(k, corpus.num_rows)
    # First and last position of each query's own id, when it occurs in this block.
    own = queries.column("exclude_id").combine_chunks()
    first = pc.index_in(own, value_set=ids)
    hidden = np.flatnonzero(first.is_valid().to_numpy(zero_copy_only=False))
    runs = pc.value_counts(ids)
    length = dict(zip(runs.field("values").to_pylist(), runs.field("counts").to_pylist())) \
        if len(hidden) else {}
    never = np.iinfo(np.int64).min
    out_q, out_c, out_s = [], [], []
    step = max(1, _MATRIX_ELEMENTS // n)
    for lo in range(0, len(q), step):
        part = q[lo:lo + step]
        score = np.rint(part @ c.T * _SCALE).astype(np.int64)
        # One sortable number per cell: similarity first, then the smaller id.
        key = score * n + np.arange(n - 1, -1, -1)
        for i in hidden[(hidden >= lo) & (hidden < lo + step)]:
            at = first[i].as_py()
            key[i - lo, at:at + length[own[i].as_py()]] = never
        cols = (np.argpartition(key, n - take, axis=1)[:, n - take:] if take < n
                else np.tile(np.arange(n), (len(part), 1)))
        rows = np.repeat(np.arange(len(part)), take)
        cols = cols.ravel()
        kept = key[rows, cols] != never
        rows, cols = rows[kept], cols[kept]
        out_q.append(rows + lo)
        out_c.append(cols)
        out_s.append(score[rows, cols] / _SCALE)
    return pa.Table.from_arrays(
        [queries.column("query_id").take(pa.array(np.concatenate(out_q))),
         ids.take(pa.array(np.concatenate(out_c))),
         pa.array(np.concatenate(out_s))],
        schema=_ARROW_HITS)


# --- exact search --------------------------------------------------------------------

def _query_side(queries: DataFrame) -> DataFrame:
    exclude = F.col("exclude_id") if "exclude_id" in queries.columns else F.lit(None)
    return queries.select(F.col("query_id").cast("string"), exclude.cast("string").alias("exclude_id"),
                          "embedding").where(F.col("embedding").isNotNull())


def _corpus_side(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("pair_id").cast("string"), "embedding").where(
        F.col("embedding").isNotNull())


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_per_key(hits, ["query_id"], [F.col("similarity").desc(), F.col("pair_id")], k, "rank")


def _knn_broadcast(queries: pa.Table, corpus: DataFrame, k: int) -> DataFrame:
    """Send the bounded query block to every corpus partition; nothing but hits is shuffled."""
    ship_package(corpus.sparkSession)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, queries.schema) as writer:
        writer.write_table(queries)
    shared = corpus.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]):
        best = Best(pa.ipc.open_stream(shared.value).read_all(), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(lo, READ_ROWS)
                best.add(part.column(0), _matrix(part.column(1)))
        yield from best.hits().combine_chunks().to_batches()

    return _ranked(_corpus_side(corpus).mapInArrow(run, HITS), k)


def _meet(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Bring equal-keyed blocks of both sides together and keep each query's best rows."""
    ship_package(queries.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_hits(left, right, k)

    return queries.groupBy(*keys).cogroup(corpus.groupBy(*keys)).applyInArrow(run, HITS)


def _each_block(n: Column) -> Column:
    """One output row per block number 0..n-1."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))


def _size_and_copies(corpus: DataFrame) -> tuple[int, bool]:
    """Row count, and whether any id occurs twice; reads the id column only."""
    size = corpus.groupBy("pair_id").count().agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.max("count").alias("copies")).first()
    return size["n"], (size["copies"] or 0) > 1


def _knn_blocks(queries: DataFrame, corpus: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Bounded blocks of queries meet the corpus, which is written once and read by every task in
    batches of at most ``block_rows``. Copies of an id are rows like others."""
    files = write_stored(corpus)
    n_corpus = corpus.sparkSession.read.schema(corpus.schema).parquet(*files).count() if files else 0

    def work(block: pa.Table, read: Read) -> pa.Table:
        best = Best(block, k)
        for batch in read(files):
            best.add(batch.column(0), _matrix(batch.column(1)))
        return best.hits()

    return _ranked(meet_stored(queries, n_corpus, work, block_rows), k)


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = K.TOP_K, *,
              broadcast_rows: int = BROADCAST_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` corpus rows most similar to each query, never the query's own pair.

    ``queries``: query_id (unique), embedding and, optionally, exclude_id (null: exclude nothing).
    ``corpus``: pair_id and embedding. Vectors have unit length, so the dot product is the cosine.
    Returns query_id, pair_id, similarity and rank; ties go to the smaller id. No pair of rows is
    ever emitted, only the best of each block.
    """
    q = _query_side(queries)
    head = q.limit(broadcast_rows + 1).toArrow()
    if head.num_rows <= broadcast_rows:
        return _knn_broadcast(head, corpus, k)
    return knn_blocked(queries, corpus, k, block_rows=block_rows)


def knn_blocked(queries: DataFrame, corpus: DataFrame, k: int = K.TOP_K, *,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The result of :func:`knn_exact` for query sets of any size."""
    return _knn_blocks(_query_side(queries), _corpus_side(corpus), k, block_rows)


# --- hashed search -------------------------------------------------------------------

#: Corpus rows that probes are measured on and queries that they are measured for; the only rows
#: of the hashed search that reach the driver.
LSH_SAMPLE_ROWS, LSH_TRIAL_QUERIES = 20_000, 400
#: Share of the true neighbours that the hashed search has to find on the sample.
LSH_RECALL = 0.97
#: More bits a table are not chosen; larger buckets are searched in blocks.
LSH_BITS = 12
# Buckets that the queries of one task are marked for.
_VISITED = 16_000_000


def _signs(vectors: np.ndarray, planes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections by row, table and bit, and the bucket number in each table."""
    side = (vectors @ planes).reshape(len(vectors), -1, bits)
    return side, (side > 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _flips(bits: int) -> np.ndarray:
    """One row for each set of bits that may be flipped."""
    return np.arange(1 << bits)[:, None] >> np.arange(bits) & 1


def _nearest_buckets(side: np.ndarray, own: np.ndarray, bits: int) -> np.ndarray:
    """All buckets of one table for each query, those whose flipped signs were closest first."""
    cost = side ** 2 @ _flips(bits).T
    return own[:, None] ^ np.argsort(cost, axis=1, kind="stable")


def measure_lsh(queries: pa.Table, sample: pa.Table, planes: np.ndarray, bits: int, k: int,
                recall: float) -> tuple[int, int]:
    """Tables and buckets per table that find ``recall`` of the true ``k`` neighbours in the sample
    with the fewest buckets in all. All buckets of one table find everything."""
    tables, everything = planes.shape[1] // bits, 1 << bits
    if not queries.num_rows or not sample.num_rows:
        return 1, everything
    q, c = _matrix(queries.column("embedding")), _matrix(sample.column("embedding"))
    ids = np.array(sample.column("pair_id").to_pylist(), object)
    c_bucket = _signs(c, planes, bits)[1]
    q_side, q_bucket = _signs(q, planes, bits)
    take = min(k, len(c))
    places = []  # of every true neighbour's bucket in its query's order, by table
    for i, exclude in enumerate(queries.column("exclude_id").to_pylist()):
        score = q[i] @ c.T
        score[ids == exclude] = -np.inf
        best = np.argsort(-score, kind="stable")[:take]
        best = best[np.isfinite(score[best])]
        place = np.empty((len(best), tables), np.int64)
        for t in range(tables):
            order = _nearest_buckets(q_side[i:i + 1, t], q_bucket[i:i + 1, t], bits)[0]
            place[:, t] = np.argsort(order)[c_bucket[best, t]]
        places.append(place)
    found = np.minimum.accumulate(np.concatenate(places), axis=1)
    if not len(found):
        return 1, everything
    choices = []
    for t in range(tables):
        share = np.cumsum(np.bincount(found[:, t], minlength=everything)) / len(found)
        probes = int(np.searchsorted(share, min(recall, share[-1])) + 1)
        choices.append(((t + 1) * probes, t + 1, probes))
    return min(choices)[1:]


def _with_buckets(df: DataFrame, planes: np.ndarray, bits: int, probes: int = 1) -> DataFrame:
    """One row per (row, table, probed bucket): the signs of ``bits`` random projections as a
    bucket number, and the buckets whose signs differ where the projections are smallest."""
    ship_package(df.sparkSession)
    names = df.columns
    schema = T.StructType(df.schema.fields + [T.StructField("buckets", T.ArrayType(T.LongType()))])
    tables = planes.shape[1] // bits
    step = max(1, _MATRIX_ELEMENTS >> bits)

    def run(batches: Iterator[pa.RecordBatch]):
        offset = np.arange(tables, dtype=np.int64) << bits
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                side, number = _signs(_matrix(batch.column("embedding")), planes, bits)
                if probes > 1:
                    number = np.stack([_nearest_buckets(side[:, t], number[:, t], bits)[:, :probes]
                                       + offset[t] for t in range(tables)], axis=1)
                else:
                    number = (number + offset)[:, :, None]
                number = number.reshape(batch.num_rows, -1)
                ends = pa.array(np.arange(0, number.size + 1, number.shape[1], dtype=np.int32))
                buckets = pa.ListArray.from_arrays(ends, pa.array(number.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, buckets], [*names, "buckets"])

    return df.mapInArrow(run, schema).select(*names, F.explode("buckets").alias("bucket"))


def knn_lsh(queries: DataFrame, corpus: DataFrame, k: int = K.TOP_K, *, tables: int = 8,
            bits: int | None = None, seed: int = 42, block_rows: int = BLOCK_ROWS,
            complete: bool = True, recall: float = LSH_RECALL) -> DataFrame:
    """Approximate :func:`knn_exact`: only rows that share a hash bucket are compared, with their
    exact similarity. Finds each pair id once.

    By default buckets get about 256 rows, and how many of the ``tables`` are used and how many
    neighbouring buckets a query probes in each is measured: the fewest that find ``recall`` of the
    true neighbours in a sample of the corpus, for a sample of the queries. Where that is as many
    buckets as a table has, the exact search is run. With ``bits`` given, only a query's own bucket
    is probed in every table and recall falls as ``bits`` grow against ``tables``.

    Rows are stored in the order of their buckets; which buckets a query probes is found in the task
    that holds it, so that no row is made for a probe. ``complete`` answers queries with fewer than ``k`` hits by the exact search.
    """
    q, c = _query_side(queries), _corpus_side(corpus)
    probe = c.select(F.size("embedding").alias("dims")).first()
    if probe is None:
        return _ranked(q.sparkSession.createDataFrame([], HITS), k)
    n_corpus, folded = _size_and_copies(c)
    if folded:
        c = c.dropDuplicates(["pair_id", "embedding"])
    measured = bits is None
    if measured:
        bits = min(LSH_BITS, max(1, math.ceil(math.log2(max(2, n_corpus / 256)))))
    planes = np.random.default_rng(seed).standard_normal((probe["dims"], tables * bits))
    probes = 1
    if measured:
        trial = q.orderBy(F.xxhash64("query_id")).limit(LSH_TRIAL_QUERIES).toArrow()
        sample = c.orderBy(F.xxhash64("pair_id")).limit(LSH_SAMPLE_ROWS).toArrow()
        used, probes = measure_lsh(trial, sample, planes, bits, k, recall)
        if used * probes >= 1 << bits and not folded:
            return knn_exact(queries, c, k, block_rows=block_rows)
        planes = planes[:, :used * bits]
    from replyloom.operators.cells import StoredCells, visit

    rows = _with_buckets(c, planes, bits).select(
        "pair_id", "embedding", F.col("bucket").cast("int").alias("cell"))
    files = write_stored(rows.repartitionByRange("cell", F.xxhash64("pair_id")).sortWithinPartitions("cell"))
    tables = planes.shape[1] // bits

    def probed(vectors: np.ndarray, _: None) -> np.ndarray:
        side, number = _signs(vectors, planes, bits)
        visited = np.zeros((len(vectors), tables << bits), bool)
        for t in range(tables):
            near = (_nearest_buckets(side[:, t], number[:, t], bits)[:, :probes] if probes > 1
                    else number[:, t:t + 1])
            np.put_along_axis(visited, near + (t << bits), True, axis=1)
        return visited

    hits = visit(q, StoredCells(files, n_corpus * tables), probed, k, block_rows,
                 max(LEAST_ROWS, min(QUERY_ROWS, _VISITED // (tables << bits))), unique=tables)
    hits = hits.groupBy("query_id", "pair_id").agg(F.max("similarity").alias("similarity"))
    found = _ranked(hits, k)
    if not complete:
        return found
    found = materialise(found)
    full = found.where(F.col("rank") == k).select("query_id")
    rest = q.join(full, "query_id", "left_anti")
    return (found.join(full, "query_id", "left_semi")
            .unionByName(knn_exact(rest, corpus, k, block_rows=block_rows)))


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search also found."""
    both = exact.select("query_id", "pair_id").distinct().join(
        found.select("query_id", "pair_id", F.lit(1).alias("hit")).distinct(),
        ["query_id", "pair_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


# --- second stage and grounding --------------------------------------------------------

def word_set(c: Column | str) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}_]+"), 0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Word overlap of two texts; 0 when neither has a word."""
    x, y = word_set(a), word_set(b)
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def rerank(candidates: DataFrame, score: Column | None = None,
           top_k: int = K.RERANK_TOP_K) -> DataFrame:
    """Order each query's candidates anew by ``score`` (word overlap by default) and cut.

    Equal scores keep the first-stage order. A model's score can be added as a column with
    :func:`replyloom.operators.scoring.score_batches` and passed here.
    """
    score = jaccard("message", "customer_text") if score is None else score
    scored = candidates.withColumnRenamed("rank", "first_rank").withColumn("rerank_score", score)
    return top_per_key(scored, ["query_id"],
                       [F.col("rerank_score").desc_nulls_last(), F.col("first_rank")], top_k, "rank")


def with_corpus_text(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add both texts of every hit. Call with materialised hits: they are read twice."""
    texts = corpus.select(F.col("pair_id").alias("hit_id"), "customer_text", "brand_reply")
    ids = hits.select(F.col("pair_id").alias("wanted_id")).distinct()
    texts = texts.join(ids, F.col("hit_id") == F.col("wanted_id"), "left_semi")
    texts = first_by_key(texts, ["hit_id"], ["customer_text", "brand_reply"])
    return lookup_join(hits, texts, "pair_id", "hit_id").drop("hit_id")


def retrieve(queries: DataFrame, corpus: DataFrame, mode: str = K.METHOD_TWO_STAGE, *,
             k: int = K.TOP_K, first_stage: int = K.FIRST_STAGE_K, score: Column | None = None,
             search=knn_exact, **search_options) -> DataFrame:
    """The cases each message is grounded on, one row per (query_id, rank).

    ``queries``: query_id, message, embedding and optionally exclude_id. Two stages fetch
    ``first_stage`` cases and re-rank them; one stage takes the ``k`` nearest.
    """
    if mode not in (K.METHOD_TWO_STAGE, K.METHOD_ONE_STAGE):
        raise ValueError(f"unknown retrieval mode {mode!r}")
    two_stage = mode == K.METHOD_TWO_STAGE
    hits = materialise(search(queries, corpus, first_stage if two_stage else k, **search_options))
    cases = with_corpus_text(hits, corpus)
    if not two_stage:
        return cases
    messages = queries.select(F.col("query_id").cast("string").alias("message_key"), "message")
    cases = lookup_join(cases, messages, "query_id", "message_key").drop("message_key")
    return rerank(cases, score, k).drop("first_rank", "message")


def grounding(cases: DataFrame) -> DataFrame:
    """One row per query with its ranked ``cases`` (at most ``k`` of them)."""
    entry = F.struct("rank", "pair_id", "similarity", "brand_reply",
                     example_line("customer_text", "brand_reply").alias("line"))
    return cases.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("cases"))
