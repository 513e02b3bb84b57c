"""Toxicity: subword embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.llm.common import shared_dir, slices
from lexiphyte.llm.subwords import row_sums, word_grams

#: Labelled rows that the classifier is fitted on at most, taken in the order of a hash of their ids.
TRAIN_DOCS = 12_000
GRAMS, BUCKETS, WIDTH, STEPS, BATCH = (3, 4, 5, 6), 1 << 18, 4, 750, 128
#: Factor on the averaged vector, as a few toxic words among hundreds must move the softmax.
SCALE = 200.0


class SubwordSoftmax:
    """Mean over words of the mean vector of their n-grams, then a softmax over two classes."""

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 7) -> SubwordSoftmax:
        # Distinct words of all documents with their buckets, and each document's words with their shares of it.
        ids: dict[int, int] = {}
        flat, sizes = array("i"), array("i")
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        shared = np.zeros(BUCKETS, np.int32)
        for at in range(0, len(texts), 128):
            w = word_grams(pa.array(texts[at : at + 128], pa.large_string()), GRAMS, True)
            bucket = (w.gram & np.uint64(BUCKETS - 1)).astype(np.int32)
            whole = w.gram[w.gram_end[1:] - 1] if len(w.letters) else np.zeros(0, np.uint64)  # a word's last hash is its own
            place = np.empty(len(whole), np.int32)
            for k, h in enumerate(whole.tolist()):
                i = ids.get(h)
                if i is None:
                    i = ids[h] = len(sizes)
                    own = bucket[w.gram_end[k] : w.gram_end[k + 1]]
                    flat.frombytes(own.tobytes())
                    sizes.append(len(own))
                place[k] = i
            for k in range(len(w.row) - 1):
                seen, times = np.unique(w.of[w.row[k] : w.row[k + 1]], return_counts=True)
                rows.append((place[seen], (times / max(1, times.sum())).astype(np.float32)))
            docs_of = np.bincount(np.concatenate([np.unique(w.of[a:b]) for a, b in zip(w.row[:-1], w.row[1:], strict=True)]), minlength=len(whole)) if len(whole) else np.zeros(0, np.int64)
            np.add.at(shared, bucket, np.repeat(docs_of, np.diff(w.gram_end)).astype(np.int32))
        del ids
        size = np.array(sizes, np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))
        names = np.flatnonzero(shared >= 3)  # rarer n-grams say nothing of other documents
        # Rare buckets share one more vector that stays zero.
        column = np.full(BUCKETS, len(names), np.int32)
        column[names] = np.arange(len(names))
        cols = column[np.frombuffer(flat, np.int32)] if flat else np.zeros(0, np.int32)
        del flat

        rng = np.random.default_rng(seed)
        vec = rng.normal(0, 0.1, (len(names) + 1, WIDTH)).astype(np.float32)
        vec[-1] = 0
        out = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
        bias = np.log(np.array([(labels == k).mean() + 1e-3 for k in (0, 1)], np.float32))
        g_vec, g_out, g_bias = np.full(vec.shape, 1e-4, np.float32), np.full(out.shape, 1e-2, np.float32), np.full(2, 1e-2, np.float32)
        epochs = -(-STEPS * BATCH // max(1, len(texts)))  # as many steps for few documents as for many
        for epoch in range(epochs):
            rate = 0.25 * (1 - epoch / epochs) + 0.01
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                doc_end = np.concatenate(([0], np.cumsum([len(rows[k][0]) for k in own])))
                used, of = np.unique(np.concatenate([rows[k][0] for k in own]), return_inverse=True)
                x = np.concatenate([rows[k][1] for k in own]) * np.float32(SCALE)
                n = size[used]
                stop = np.cumsum(n)
                col = cols[np.arange(n.sum()) + np.repeat(ends[used] - stop + n, n)]
                word = (row_sums(vec[col], np.concatenate(([0], stop))) / np.maximum(n, 1)[:, None]).astype(np.float32)
                mean = row_sums(word[of] * x[:, None], doc_end).astype(np.float32)
                z = mean @ out + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), labels[own]] -= 1
                p /= len(own)
                d_mean, d_out, d_bias = p @ out.T, mean.T @ p + 1e-5 * out, p.sum(0)
                flow = np.repeat(d_mean, np.diff(doc_end), 0) * x[:, None]
                d_word = np.stack([np.bincount(of, flow[:, j], len(used)) for j in range(WIDTH)], 1) / np.maximum(n, 1)[:, None]
                d_vec = np.stack([np.bincount(col, np.repeat(d_word[:, j], n), len(vec)) for j in range(WIDTH)], 1).astype(np.float32)
                d_vec[-1] = 0
                for param, grad, total in ((vec, d_vec, g_vec), (out, d_out, g_out), (bias, d_bias, g_bias)):
                    total += grad * grad
                    param -= rate * grad / np.sqrt(total)
        #: All layers after the embedding are linear, so a bucket's share of the margin is one number.
        self.margin = np.zeros(BUCKETS, np.float32)
        self.margin[names] = SCALE * (vec[:-1] @ (out[:, 1] - out[:, 0]))
        self.bias = float(bias[1] - bias[0])
        return self

    def score(self, text) -> np.ndarray:
        """The probability of class 1 for each text of a column."""
        w = word_grams(text, GRAMS, True)
        per_word = row_sums(self.margin[(w.gram & np.uint64(BUCKETS - 1)).astype(np.int64)], w.gram_end) / np.maximum(np.diff(w.gram_end), 1)
        z = row_sums(per_word[w.of], w.row) / np.maximum(np.diff(w.row), 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def held_out(column: str) -> F.Column:
    """Whether an id belongs to the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> SubwordSoftmax:
    """A model from at most TRAIN_DOCS labelled documents outside the held-out fold; of repeated labels the larger holds.

    Without any labelled document, or with one class only, the model gives its prior to every text.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(some), "id")
    # Bounded by TRAIN_DOCS ids; the limit holds again for ids that several documents have. One task trains on them, so
    # that the driver holds no more than the finished model.
    made = texts.select("id", "text", "y").limit(2 * TRAIN_DOCS).mapInArrow(_train, "margin binary, bias double").collect()
    model = SubwordSoftmax()
    if made:
        model.margin, model.bias = np.frombuffer(made[0]["margin"], np.float32), made[0]["bias"]
        return model
    return model.fit([""], np.zeros(1, np.int64))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("text", "ascending")])
        texts, y = rows.column("text").to_pylist(), np.minimum(np.array(rows.column("y").to_pylist(), np.int64), 1)
        del rows, held
        model = SubwordSoftmax().fit(texts, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.margin.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["margin", "bias"])


def _score(model, names: list[str], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                columns = [part.column(n) if n != "score" else pa.array(model.value.score(part.column(text))) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """``id_col, held_out, score`` and ``predicted`` for every whole text, from its words alone.

    Empty and null texts score the prior; repeated rows are scored one by one; null ids aren't held out; an empty table
    gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **columns))  # BUCKETS floats
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    scored = source.mapInArrow(_score(model, ["id", "score"], "text"), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below ``least``, with their columns, in one pass and without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(model.value.score(part.column(text_col)) < least))

    return docs.select(names).mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
