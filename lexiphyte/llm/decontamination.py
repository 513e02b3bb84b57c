"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.llm.common import buffers, lists, shared_dir, slices, small_batches, stored, tidy, words

#: Words of a window, and items from which a document counts as contaminated.
WINDOW, ITEMS = 8, 2
#: Test words that tasks hold at a time (8 bytes each); a larger benchmark is searched in parts of this size.
PART_WORDS = 1_000_000

INDEX = "seg long, doc array<long>, n_words array<int>, term array<int>, ends array<int>, pos array<int>"
FOUND = "seg long, ord int, doc_id long, n_words long, hits array<struct<start:int,stop:int>>, item_ids array<string>"


def _rows(names: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names.split())


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, ends = words(*buffers(part.column("text")), "alnum")
            yield _rows("item words", part.column("item"), lists(h.view(np.int64), ends, pa.int64()))


class Windows:
    """The distinct windows of some items: their vocabulary, term places and the items that hold them."""

    def __init__(self, items: list[tuple[str, np.ndarray]], size: int) -> None:
        found: dict[bytes, set[str]] = {}
        for item, h in items:
            n = min(size, len(h))
            for at in range(len(h) - n + 1 if n else 0):
                found.setdefault(h[at : at + n].tobytes(), set()).add(item)
        keys = sorted(found)
        self.items = sorted({x for s in found.values() for x in s})
        place = {x: k for k, x in enumerate(self.items)}
        self.length = np.array([len(k) // 8 for k in keys], np.int32)
        self.terms = np.unique(np.frombuffer(b"".join(keys), np.uint64)) if keys else np.zeros(0, np.uint64)
        self.grid = np.full((len(keys), size), -1, np.int32)
        for k, key in enumerate(keys):
            self.grid[k, : self.length[k]] = np.searchsorted(self.terms, np.frombuffer(key, np.uint64))
        self.owners = [np.array(sorted(place[x] for x in found[k]), np.int32) for k in keys]

    def by_rarity(self, count: np.ndarray) -> None:
        """Order each window's terms by their corpus counts, rarest first."""
        n = np.where(self.grid >= 0, count[self.grid], np.iinfo(np.int64).max)
        self.places = np.argsort(n, axis=1, kind="stable").astype(np.int32)


def _index(terms) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each segment of documents: the ascending positions of every test term in it.

    Positions count words through the segment; those of document d start at the sum of n_words before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seg = terms.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                h, ends = words(*buffers(part.column("text")), "alnum")
                term = np.searchsorted(vocabulary, h)
                pos = np.flatnonzero(vocabulary[np.minimum(term, len(vocabulary) - 1)] == h) if len(vocabulary) else np.zeros(0, np.int64)
                term = term[pos].astype(np.int32)
                pos = pos[np.argsort(term, kind="stable")]
                names, counts = np.unique(term, return_counts=True)
                one = lambda x, kind: lists(x, np.array([0, len(x)]), kind)
                doc = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id").cast(pa.int64()))
                yield _rows("seg doc n_words term ends pos", pa.array([seg], pa.int64()), doc, one(np.diff(ends), pa.int32()), one(names, pa.int32()), one(np.cumsum(counts), pa.int32()), one(pos, pa.int32()))
                seg += 1

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in batches:
        for term, ends in zip(batch.column("term"), batch.column("ends"), strict=True):
            for t, n in zip(term.values.to_numpy(), np.diff(ends.values.to_numpy(), prepend=0), strict=True):
                total[int(t)] = total.get(int(t), 0) + int(n)
    yield _rows("term n", pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64()))


def matches(w: Windows, docs: int, n_words: np.ndarray, term: np.ndarray, ends: np.ndarray, pos: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
    """Windows found in a segment: (window, document, first word, end) arrays.

    Starts from the postings of each window's rarest term, shifted to the window's start, and keeps a start only while
    each further term, rarest first, has a posting within ``slop`` words of its place in the same document.
    """
    starts = np.concatenate(([0], np.cumsum(n_words)))
    lower, upper = np.zeros(len(w.terms) + 1, np.int64), np.zeros(len(w.terms) + 1, np.int64)
    lower[term], upper[term] = np.concatenate(([0], ends[:-1])), ends
    key = np.repeat(term.astype(np.int64), np.diff(ends, prepend=0)) << 32 | pos
    row = np.arange(len(w.grid))
    anchor = w.places[:, 0] if len(row) else np.zeros(0, np.int32)
    first = w.grid[row, anchor]
    n = upper[first] - lower[first]
    win = np.repeat(row, n)
    at = pos[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lower[first], n)].astype(np.int64)
    doc = np.searchsorted(starts, at, "right") - 1
    low, high, start = at.copy(), at + 1, at - anchor[win]
    keep = (start >= starts[doc] - slop) & (start + w.length[win] <= starts[doc + 1] + slop)
    for j in range(1, w.grid.shape[1]):
        win, doc, low, high, start = (x[keep] for x in (win, doc, low, high, start))
        place = w.places[win, j]
        t = w.grid[win, place].astype(np.int64)
        want = start + place
        # The postings next to the wanted place, before and after it.
        k = np.searchsorted(key, t << 32 | np.maximum(want, 0))
        best = np.full(len(win), -1, np.int64)
        for c in (k - 1, k):
            inside = (c >= 0) & (c < len(key))
            v = key[np.where(inside, c, 0)] if len(key) else np.zeros(len(win), np.int64)
            p = v & 0xFFFFFFFF
            good = inside & (v >> 32 == t) & (p >= starts[doc]) & (p < starts[doc + 1]) & (abs(p - want) <= slop)
            better = good & ((best < 0) | (abs(p - want) < abs(best - want)))
            best = np.where(better, p, best)
        unused = t < 0
        keep = unused | (best >= 0)
        low = np.where(unused | (best < 0), low, np.minimum(low, best))
        high = np.where(unused | (best < 0), high, np.maximum(high, best + 1))
    return win[keep], doc[keep], low[keep] - starts[doc[keep]], high[keep] - starts[doc[keep]]


def _search(windows, slop: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = windows.value
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name, k=k: batch.column(name)[k].values  # noqa: B023
                ids, n_words = get("doc"), get("n_words").to_numpy()
                flat = (get(x).to_numpy() for x in ("term", "ends", "pos"))
                win, doc, low, high = matches(w, len(ids), n_words, *flat, slop)
                spans = np.unique(np.stack((doc, low, high), 1), axis=0)
                pairs = sorted({(d, i) for d, v in set(zip(doc.tolist(), win.tolist(), strict=True)) for i in w.owners[v].tolist()})
                span_ends = np.searchsorted(spans[:, 0], np.arange(len(ids) + 1)).astype(np.int32)
                item_ends = np.searchsorted(np.array([d for d, _ in pairs], np.int64), np.arange(len(ids) + 1)).astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(spans[:, 1], pa.int32()), pa.array(spans[:, 2], pa.int32())], ["start", "stop"])
                yield _rows(
                    "seg ord doc_id n_words hits item_ids",
                    pa.array(np.full(len(ids), batch.column("seg")[k].as_py(), np.int64)),
                    pa.array(np.arange(len(ids), dtype=np.int32)),
                    ids,
                    pa.array(n_words.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(span_ends), hits),
                    pa.ListArray.from_arrays(pa.array(item_ends), pa.array([w.items[i] for _, i in pairs], pa.string())),
                )

    return run


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark passages in documents: exact phrases, or with ``slop`` words of play for each term (proximity).

    Texts are lower-cased in A-Z and cut to words of ASCII letters, digits and all characters beyond ASCII. A window is
    ``window`` consecutive words of an item, or a whole shorter one. The postings of all test terms are stored as a
    table of index segments in the shared folder, with the terms' corpus counts read from it; the search then starts
    from each window's rarest term and intersects the offset-adjusted lists of the others.

    The windows travel to the tasks by broadcast in parts of at most PART_WORDS words, each searched in turn, so a
    large benchmark costs time and not memory (a single item above that size makes a part of its own).

    Returns a row per document: ``doc_id`` (long), ``n_words``, ``hits`` (distinct word ranges, end exclusive) and
    ``item_ids`` (distinct items as strings, sorted). Null texts have no words; null item ids are ignored; repeated
    rows are searched one by one; empty tables give no hits or no rows.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    listed = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    test = stored(listed.mapInArrow(_item_words, "item string, words array<long>"), "test-words")
    size = test.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * size // PART_WORDS)) if size > PART_WORDS else 1
    found = []
    for part in range(parts):
        own = test if parts == 1 else test.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        got = own.toArrow()
        w = Windows([(a, np.array(b, np.int64).view(np.uint64)) for a, b in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)], window)
        with small_batches(spark):
            index = stored(source.mapInArrow(tidy(_index(spark.sparkContext.broadcast(w.terms))), INDEX), "postings")
        count = np.zeros(len(w.terms), np.int64)
        for t, n in index.select("term", "ends").mapInArrow(_counts, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
            count[t] = n  # one row for each test term
        w.by_rarity(count)
        found.append(index.mapInArrow(_search(spark.sparkContext.broadcast(w), slop), FOUND))
    if parts == 1:
        return found[0].drop("seg", "ord")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.groupBy("seg", "ord").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.sort_array(F.flatten(F.collect_list("item_ids"))).alias("item_ids")
    ).drop("seg", "ord")


def contamination(docs: DataFrame, items: DataFrame, least_items: int = ITEMS, **options) -> DataFrame:
    """``find_items`` with the counts: words hit, items found, a digest of their ids, and the verdict."""
    found = find_items(docs, items, **options)
    covered = F.aggregate(
        F.sort_array("hits"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["upto"], x["stop"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["upto"], x["start"]))).alias("n")),
    )["n"]
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("item_ids"), ","), 256).alias("items_sha256"),
        (F.size("item_ids") >= least_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, least_items: int = 1, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents less those with windows of ``least_items`` items or more; rows of null id are left."""
    bad = contamination(docs, items, least_items, id_col=id_col, **options).where("contaminated AND doc_id IS NOT NULL")
    gone = stored(bad.select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    few = gone.count() <= 2_000_000  # ids under 40 MB in all travel to the texts, else both sides are shuffled
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
spot AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT spot.doc_id, spot.i, spot.k, win.item_id FROM spot JOIN win ON spot.k = win.k AND spot.phrase = win.phrase),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE_SQL = {"op1_decontamination": SQL}
