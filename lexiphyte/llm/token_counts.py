"""Token counts without ids: pieces are counted once per distinct pre-token and joined to document frequencies."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.llm.common import frequent, shared_dir, small_batches, stored, tidy

#: Most pre-tokens, and bytes in each, of the frequent ones that all tasks hold (under 7 MB of text).
HEAD_ROWS, HEAD_BYTES = 100_000, 64
#: Distinct pre-tokens that a task gathers before it passes them on.
HELD = 150_000

_SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
# In this range Unicode's versions agree on letters, numbers and white space, so texts within it need no library.
_BEYOND = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0 "
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def splitter(path: str) -> Callable[[str], tuple[list[str], int]]:
    """A function from text to its pre-tokens, as the vocabulary's own pipeline cuts them, and its special tokens."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    import json

    spec = json.load(open(path, encoding="utf-8"))
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    normal = Tokenizer.from_file(path).normalizer

    def plain(s: str) -> list[str]:
        if _BEYOND.search(s):
            return [x for x, _ in cut.pre_tokenize_str(normal.normalize_str(s))]
        return _PIECE.findall((s if s.isascii() else unicodedata.normalize("NFC", s)).lower())

    def split(text: str) -> tuple[list[str], int]:
        if "<|" not in text:
            return plain(text), 0
        parts = _SPECIAL.split(text)
        return [x for s in parts[::2] for x in plain(s)], len(parts) // 2

    return split


def _frequencies(path: str, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = splitter(path), Counter()
        for batch in batches:
            for x in batch.column(text):
                held.update(split(x.as_py() or "")[0])
                if len(held) > HELD:
                    yield _rows(piece=pa.array(held.keys(), pa.string()), n=pa.array(held.values(), pa.int64()))
                    held = Counter()
        yield _rows(piece=pa.array(held.keys(), pa.string()), n=pa.array(held.values(), pa.int64()))

    return run


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _pieces(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to each pre-token the number of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True  # inside a pre-token their strings are ordinary text
        for batch in batches:
            names = batch.column("piece").to_pylist()
            sizes = []
            for at in range(0, len(names), 5_000):
                sizes += [len(e.ids) for e in model.encode_batch_fast(names[at : at + 5_000], add_special_tokens=False)]
            yield _rows(piece=batch.column("piece"), n=batch.column("n"), k=pa.array(sizes, pa.int32()))

    return run


def _document_rows(path: str, ident: str, text: str, id_type: pa.DataType, head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document a row with the tokens of its frequent pre-tokens and, for each rare one, a row with its frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(path), head.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                own = batch.slice(part, 256)
                uids, piece, freq, at, sizes = [], [], [], [], []
                for k, x in enumerate(own.column(text).to_pylist()):
                    x = x or ""
                    names, n = split(x)
                    uid += 1
                    for name, times in Counter(names).items():
                        one = known.get(name)
                        if one is None:
                            uids.append(uid), piece.append(name), freq.append(times), at.append(None), sizes.append(None)
                        else:
                            n += one * times
                    # A document's own row takes part in the join under a key that no pre-token has: it has a space.
                    uids.append(uid), piece.append(f" {uid}"), freq.append(n), at.append(k), sizes.append(len(x.encode()))
                yield _rows(uid=pa.array(uids, pa.int64()), id=own.column(ident).take(pa.array(at, pa.int32())).cast(id_type), n_bytes=pa.array(sizes, pa.int64()), piece=pa.array(piece, pa.string()), freq=pa.array(freq, pa.int64()))

    return run


def vocabulary(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every distinct pre-token of the corpus: ``piece``, its occurrences ``n`` and its tokens ``k``."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(_frequencies(path, "text")), "piece string, n long")
    return counts.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(tidy(_pieces(path)), "piece string, n long, k int")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each document under a ``tokenizers`` vocabulary, counted without making ids.

    Pass one counts the corpus's pre-tokens, partly in each task and wholly after a shuffle, and asks the library once
    for the number of tokens of each distinct one. Pass two splits the documents again. The most frequent pre-tokens
    (at most HEAD_ROWS, none over HEAD_BYTES long, so a proven bound) are held by every task and summed on the spot:
    that takes the hot keys out of the join. All the others are joined by value and summed per document.

    Returns ``id_col, n_bytes, n_tokens, over_limit``, one row per input row, also for repeated rows and null ids. Null
    text counts as empty: no bytes, no tokens. Special strings inside texts are one token each, the library's default.
    An empty table gives an empty result; further columns are ignored. The counts are made at once and stored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    with small_batches(spark):
        words = stored(vocabulary(docs, path, text_col), "token-vocabulary")
    often = frequent(words, "piece", HEAD_ROWS, HEAD_BYTES)
    head = words.where(often).select("piece", "k").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(head.column(0).to_pylist(), head.column(1).to_pylist(), strict=True)))
    rare = words.where(~often).select("piece", "k")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    rows = source.mapInArrow(tidy(_document_rows(path, "id", "text", to_arrow_type(id_type), known)), f"uid long, id {id_type.simpleString()}, n_bytes long, piece string, freq long")
    own = F.col("n_bytes").isNotNull()
    counted = (
        rows.join(rare, "piece", "left")
        .groupBy("uid")
        .agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(F.when(own, F.col("freq")).otherwise(F.col("freq") * F.col("k"))).cast("long").alias("n_tokens"))
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
    with small_batches(spark):
        return stored(counted, "token-counts")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict[str, str] = {}
