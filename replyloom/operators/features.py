"""Text features and models: TF-IDF, logistic regression, encoder, k-means of several starts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, HashingTF, IDF,
                                IDFModel, Normalizer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F, types as T
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from replyloom import constants as K
from replyloom.functions.text import _col
from replyloom.operators.scoring import Loader, score_batches
from replyloom.schemas import struct
from replyloom.session import materialise, ship_package

_TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(c: Column | str) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(_TOKEN), 0)


def ngrams(words: Column, sizes: Sequence[int] = (1, 2)) -> Column:
    """All n-grams of the given sizes, as one array, built by pairing shifted word arrays."""
    def of(n: int) -> Column:
        if n == 1:
            return words
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        out = F.slice(words, F.lit(1), count)
        for shift in range(1, n):
            out = F.zip_with(out, F.slice(words, F.lit(shift + 1), count),
                             lambda a, b: F.concat(a, F.lit(" "), b))
        return out
    parts = [of(n) for n in sizes]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _with_terms(df: DataFrame, text: str, sizes: Sequence[int]) -> DataFrame:
    return df.withColumn("__words", tokens(text)).withColumn("terms", ngrams(F.col("__words"), sizes)
                                                             ).drop("__words")


#: Words whose terms are counted at a time inside a task, and what such a count holds.
_COUNTED_WORDS = 1_000_000
_TERM_COUNTS = struct(term=T.StringType(), n_total=T.LongType(), n_docs=T.LongType())


def _term_counts(lists: pa.ListArray, sizes: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """How often each term of some documents occurs, and in how many of them, from their words.

    Words are numbered, and a longer term is the number of the term before its last word and that
    word's number; texts are made for distinct terms only.
    """
    coded = lists.flatten().dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    row -= row[0] if len(row) else 0
    n_rows = int(row[-1]) + 1 if len(row) else 1
    words, code, whole = coded.dictionary, word, np.arange(len(row))
    texts, n_words = words, max(1, len(words))
    for size in range(1, max(sizes) + 1):
        key = code
        if size > 1:
            # The terms that start at each place and end in the same document.
            whole = whole[:np.searchsorted(whole, len(row) - size + 1)]
            whole = whole[row[whole] == row[whole + size - 1]]
            key = code[whole] * n_words + word[whole + size - 1]
        # Sorted with their documents, the first of equal neighbours counts the document.
        both = np.sort(key * n_rows + row[whole])
        term = both // n_rows
        opens = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(both) else np.zeros(0, int)
        names = term[opens]
        if size > 1:
            texts = pc.binary_join_element_wise(texts.take(pa.array(names // n_words)),
                                                words.take(pa.array(names % n_words)), " ")
            if size < max(sizes):
                code = np.zeros(len(row), np.int64)
                code[whole] = np.searchsorted(names, key)
        if size in sizes and len(both):
            once = np.r_[True, both[1:] != both[:-1]].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [texts, pa.array(np.diff(np.r_[opens, len(both)])),
                 pa.array(np.add.reduceat(once, opens))], names=_TERM_COUNTS.names)


def vocabulary(df: DataFrame, text: str = "text", size: int = K.TFIDF_VOCABULARY,
               sizes: Sequence[int] = (1, 2)) -> DataFrame:
    """The ``size`` most frequent terms with their idf, ``ln((1+n)/(1+df)) + 1``; ties by term.

    One pass: a task adds up the terms of many documents before anything is shuffled.
    """
    ship_package(df.sparkSession)
    sizes = tuple(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(
                zero_copy_only=False).astype(np.int64))]
            lo = 0
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _COUNTED_WORDS, "right")) - 1)
                yield from _term_counts(lists.slice(lo, hi - lo), sizes)
                lo = hi

    top = (df.select(tokens(text).alias("words")).mapInArrow(run, _TERM_COUNTS).groupBy("term")
           .agg(F.sum("n_total").alias("n_total"), F.sum("n_docs").alias("n_docs"))
           .orderBy(F.col("n_total").desc(), "term").limit(size))
    n_docs = df.count()
    return top.withColumn("idf", F.log(F.lit(1.0 + n_docs) / (F.col("n_docs") + 1)) + 1)


def tfidf(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
          size: int = K.TFIDF_VOCABULARY, sizes: Sequence[int] = (1, 2),
          vocab: DataFrame | None = None) -> DataFrame:
    """Unit-length TF-IDF rows in long form: (doc_id, term, weight), one set for each row of ``df``.

    A document is one row, so its terms are counted and its norm taken inside the row and nothing
    is shuffled. The vocabulary has at most ``size`` rows and travels to the tasks.
    """
    if vocab is None:
        vocab = materialise(vocabulary(df, text, size, sizes))
    known = vocab.select("term", "idf").toArrow()
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(
        (known.column("term").combine_chunks(), known.column("idf").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = shared.value
        for batch in batches:
            lists = batch.column(1)
            row = pc.list_parent_indices(lists).to_numpy()
            place = pc.index_in(lists.flatten(), value_set=terms)
            found = place.is_valid().to_numpy(zero_copy_only=False)
            place = place.fill_null(0).to_numpy()[found].astype(np.int64)
            pair, tf = np.unique(row[found] * len(terms) + place, return_counts=True)
            if not len(pair):
                continue
            row, place = np.divmod(pair, len(terms))
            w = tf * idf[place]
            norm = np.sqrt(np.bincount(row, w * w, batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), terms.take(pa.array(place)),
                 pa.array(w / norm[row])], names=[doc_id, "term", "weight"])

    return _with_terms(df.select(doc_id, text), text, sizes).select(doc_id, "terms").mapInArrow(
        run, T.StructType([df.schema[doc_id], *struct(term=T.StringType(), weight=T.DoubleType()).fields]))


@dataclass
class TextClassifier:
    """TF-IDF with class-balanced multinomial logistic regression."""

    size: int = K.TFIDF_VOCABULARY
    sizes: tuple[int, ...] = (1, 2)
    max_iter: int = 1000
    labels: list[str] = field(default_factory=list)
    _terms: CountVectorizerModel | None = None
    _idf: ElementwiseProduct | None = None
    _model: LogisticRegressionModel | None = None

    def _features(self, df: DataFrame, text: str) -> DataFrame:
        out = self._terms.transform(_with_terms(df, text, self.sizes))
        out = self._idf.transform(out)
        return Normalizer(inputCol="__weighted", outputCol="features").transform(out).drop(
            "terms", "__counts", "__weighted")

    def fit(self, df: DataFrame, text: str = "customer_text",
            label: str = "gold_intent") -> "TextClassifier":
        """Learn vocabulary, idf and coefficients from the rows of ``df`` that have a label."""
        df = df.where(F.col(label).isNotNull())
        vocab = vocabulary(df, text, self.size, self.sizes).collect()   # at most ``size`` rows
        self._terms = CountVectorizerModel.from_vocabulary(
            [r["term"] for r in vocab], inputCol="terms", outputCol="__counts")
        self._idf = ElementwiseProduct(
            scalingVec=Vectors.dense([r["idf"] for r in vocab]), inputCol="__counts",
            outputCol="__weighted")
        # One coefficient row per label is kept anyway, so the label list is small.
        counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
        self.labels = sorted(counts)
        total = sum(counts.values())
        index = F.create_map(*[x for i, l in enumerate(self.labels)
                               for x in (F.lit(l), F.lit(float(i)))])
        weight = F.create_map(*[x for l, n in counts.items()
                                for x in (F.lit(l), F.lit(total / (len(counts) * n)))])
        rows = self._features(df, text).select(
            "features", index[F.col(label)].alias("label"), weight[F.col(label)].alias("weight"))
        # The penalty is per unit of weight here and per data set in the usual C=1 form; the
        # balanced weights sum to the row count.
        self._model = LogisticRegression(
            maxIter=self.max_iter, regParam=1.0 / total, elasticNetParam=0.0,
            standardization=False, weightCol="weight", family="multinomial").fit(rows)
        return self

    def predict(self, df: DataFrame, text: str = "customer_text",
                name: str = "predicted") -> DataFrame:
        if self._model is None:
            raise RuntimeError("call fit() before predict()")
        out = self._model.transform(self._features(df, text))
        names = F.array(*[F.lit(l) for l in self.labels])
        return out.withColumn(name, F.get(names, F.col("prediction").cast("int"))).drop(
            "features", "rawPrediction", "probability", "prediction")


@dataclass
class HashedEncoder:
    """Built-in text encoder: hashed word counts, idf weights, unit length.

    Fit it on the corpus texts; use the same encoder for corpus and queries.
    """

    dims: int = 256
    _idf: IDFModel | None = None

    def _counts(self, df: DataFrame, text: str) -> DataFrame:
        hashed = HashingTF(numFeatures=self.dims, inputCol="__words", outputCol="__counts")
        return hashed.transform(df.withColumn("__words", F.coalesce(
            tokens(text), F.array().cast("array<string>"))))

    def fit(self, df: DataFrame, text: str = "customer_text") -> "HashedEncoder":
        self._idf = IDF(inputCol="__counts", outputCol="__weighted").fit(self._counts(df, text))
        return self

    def embed(self, df: DataFrame, text: str = "customer_text",
              name: str = "embedding") -> DataFrame:
        if self._idf is None:
            raise RuntimeError("call fit() before embed()")
        out = self._idf.transform(self._counts(df, text))
        out = Normalizer(inputCol="__weighted", outputCol="__unit").transform(out)
        return out.withColumn(name, vector_to_array("__unit").cast("array<float>")).drop(
            "__words", "__counts", "__weighted", "__unit")


def embed(df: DataFrame, load: Loader, text: str = "customer_text",
          name: str = "embedding") -> DataFrame:
    """Unit-length vectors from a caller's encoder.

    The loader returns a function from a frame with the text column to a frame with the column
    ``vector``. Use two loaders when queries and documents are encoded differently.
    """
    out = score_batches(df, load, [text], struct(vector=T.ArrayType(T.DoubleType())))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("vector", lambda x: F.try_divide(x, F.col("__norm")))
    return (out.withColumn("__norm", norm).withColumn(name, unit.cast("array<float>"))
            .drop("vector", "__norm"))


def encoder(encode: Callable[[list[str]], list], text: str = "customer_text") -> Loader:
    """Wrap a plain ``list of texts -> list of vectors`` function as a loader."""
    def load():
        return lambda rows: pd.DataFrame({"vector": list(encode(list(rows[text])))})
    return load


@dataclass(frozen=True)
class Clustering:
    """The best start's centres, the cost of every start, and whether its centres had come to rest."""

    centres: np.ndarray
    costs: tuple[float, ...]
    settled: bool


def _seeded(vectors: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres among the sampled vectors."""
    centres = [vectors[rng.integers(len(vectors))]]
    far = ((vectors - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = far.sum()
        at = rng.choice(len(vectors), p=far / total) if total else rng.integers(len(vectors))
        centres.append(vectors[at])
        far = np.minimum(far, ((vectors - vectors[at]) ** 2).sum(axis=1))
    return np.array(centres)


def _nearest_centres(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of every row, the smaller of equal ones, and squared distance."""
    far = ((centres * centres).sum(axis=1) - 2 * vectors @ centres.T)
    near = np.argmin(far, axis=1)
    left = vectors - centres[near]
    return near, (left * left).sum(axis=1)


def _centre_sums(batches: Iterator[pa.RecordBatch],
                 centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of every cluster of every start, one row per cluster and dimension; the
    last two places are the rows' number and cost."""
    sums = {s: np.zeros((len(c), c.shape[1] + 2)) for s, c in centres.items()}
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = vector_matrix(batch.column(0))
        for start, own in centres.items():
            near, cost = _nearest_centres(vectors, own)
            np.add.at(sums[start], near, np.column_stack([vectors, np.ones(len(near)), cost]))
    for start, table in sums.items():
        cluster, place = np.indices(table.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(table.size, start, np.int32)), pa.array(cluster.ravel().astype(np.int32)),
             pa.array(place.ravel().astype(np.int32)), pa.array(table.ravel())],
            names=["start", "cluster", "place", "value"])


def kmeans_cluster(df: DataFrame, k: int, vector: str = "embedding", name: str = "cluster",
                   starts: int = 10, seed: int = 42, rounds: int = 50,
                   sample_rows: int = 20_000) -> tuple[DataFrame, Clustering]:
    """Cluster number per row from the best of ``starts`` seeded runs (lowest cost).

    All starts advance together: one pass over the rows and one aggregate a round move the centres
    of every start that has not come to rest. Seeds are k-means++ centres of a sample of
    ``sample_rows`` rows; what reaches the driver each round is one number per start, cluster and
    dimension. A cluster that loses its rows keeps its centre. Rows without a vector get no cluster.
    """
    ship_package(df.sparkSession)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    sample = rows.select("v", F.xxhash64("v", F.lit(seed)).alias("h")).orderBy("h").limit(
        sample_rows).toPandas()
    if not len(sample):
        return (df.withColumn(name, F.lit(None).cast("int")),
                Clustering(np.zeros((0, 0)), (0.0,) * starts, True))
    vectors = np.array(sample["v"].tolist())
    rng = np.random.default_rng(seed)
    centres = {s: _seeded(vectors, k, rng) for s in range(starts)}
    moving, costs = set(centres), {}
    for turn in range(rounds + 1):
        asked = {s: centres[s] for s in moving}
        found = rows.mapInArrow(
            lambda it, asked=asked: _centre_sums(it, asked),
            "start int, cluster int, place int, value double"
        ).groupBy("start", "cluster", "place").agg(F.sum("value").alias("value")).toPandas()
        for s in list(moving):
            mine = found[found["start"] == s]
            table = np.zeros((k, vectors.shape[1] + 2))
            table[mine["cluster"], mine["place"]] = mine["value"]
            costs[s] = float(table[:, -1].sum())
            counts = table[:, -2:-1]
            new = np.where(counts > 0, table[:, :-2] / np.maximum(counts, 1), centres[s])
            if np.abs(new - centres[s]).max() < 1e-9:
                moving.discard(s)
            elif turn < rounds:  # costs stay those of the centres that are kept
                centres[s] = new
        if not moving:
            break
    best = min(costs, key=lambda s: (costs[s], s))
    fit = Clustering(centres[best], tuple(costs[s] for s in range(starts)), best not in moving)
    return _placed(df, vector, name, fit.centres), fit


def _placed(df: DataFrame, vector: str, name: str, centres: np.ndarray) -> DataFrame:
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            near = np.zeros(batch.num_rows, np.int32)
            if len(known):
                near[known] = _nearest_centres(vector_matrix(column.take(pa.array(known))), centres)[0]
            mask = np.ones(batch.num_rows, bool)
            mask[known] = False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, mask=mask)], [*names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())]))


def vector_matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one list column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
