"""Near-duplicate groups: MinHash signatures, an inverted join on their coordinates, links confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.llm.common import buffers, discard, lists, mixed, shared_dir, slices, stored, words

#: Words of a shingle and the least similarity of linked documents, in hundredths.
SHINGLE, SIMILARITY = 5, 85
#: Coordinates of a signature, and the chance that a pair of just the least similarity may have to share too few of them.
COORDINATES, MISSED = 64, 3e-10
#: Rows of ids that are sent to all tasks at most, and the share of all rows from which a class is one of few large ones.
SENT, LARGE_CLASS = 1_000_000, 1000
#: Members from which a posting list is compared in blocks of BLOCK inside tasks instead of as rows.
LARGE, BLOCK = 48, 512

_STEPS = np.random.default_rng(1997).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def matches(similarity: int) -> int:
    """Coordinates that a candidate pair has in common at least: the most that a pair of ``similarity`` has fewer of with
    probability MISSED at most (binomial tail), so that the threshold costs no link in practice; 34 at 85, 29 at 80. One
    at least: from 0.28 downwards a pair without any common coordinate is likelier than MISSED.
    """
    s, below = similarity / 100, 0.0
    for k in range(COORDINATES):
        below += math.comb(COORDINATES, k) * s**k * (1 - s) ** (COORDINATES - k)
        if below > MISSED:
            return max(1, k)
    return COORDINATES


def shingle_sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles' hashes, row by row, with each row's end; fewer words than ``size`` make one shingle."""
    h, ends = words(*buffers(part.column("text")), "solid")
    n = np.diff(ends)
    per = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    upto = np.concatenate(([0], np.cumsum(per)))
    at = np.arange(upto[-1]) + np.repeat(ends[:-1] - upto[:-1], per)
    left = np.repeat(n, per)
    out = np.zeros(len(at), np.uint64)
    # Random odd factors: with regular ones, words in another order could give the same sum.
    for j, factor in enumerate(np.random.default_rng(1854).integers(1, 1 << 63, size, dtype=np.uint64) << np.uint64(1) | np.uint64(1)):
        inside = left > j
        out += np.where(inside, h[np.where(inside, at + j, 0)] if len(h) else 0, np.uint64(0x5851F42D4C957F2D)) * factor
    return mixed(out), upto


def set_class(s: np.ndarray) -> int:
    """A 64-bit hash of a set given as its distinct members."""
    return int(mixed(np.array([mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def _sign(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document its set's size, a 64-bit class of the set, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                h, ends = shingle_sets(part, size)
                full = np.flatnonzero(np.diff(ends))
                count, cls = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for k in full:
                    s = np.unique(h[ends[k] : ends[k + 1]])
                    count[k], cls[k] = len(s), set_class(s)
                sig = np.empty((len(full), COORDINATES), np.int32)
                if len(full):
                    for j, step in enumerate(_STEPS):
                        sig[:, j] = (mixed(np.minimum.reduceat(h * step, ends[full])) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                stops = np.concatenate(([0], np.cumsum(np.diff(ends) > 0))) * COORDINATES
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("t"), pa.array(count), pa.array(cls, mask=count == 0), lists(sig.ravel(), stops, pa.int32())], ["id", "t", "n", "c", "sig"]
                )

    return run


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The full set of each text and its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                h, ends = shingle_sets(part, size)
                found = [np.unique(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                stops = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                yield pa.RecordBatch.from_arrays([pa.array([set_class(x) for x in found], pa.int64()), lists(np.concatenate(found).view(np.int64), stops, pa.int64())], ["c", "s"])

    return run


def _block_links(similarity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between the two sides of a block pair of one posting list: a spanning set of them, exactly confirmed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("c")
        sets = [np.asarray(s, np.int64) for s in rows["s"]]
        c, comp = rows["c"].to_numpy(), rows["comp"].to_numpy()
        n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        names, of, times = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        shared = times > 1  # a shingle of one document adds to no intersection
        column = np.cumsum(shared) - 1
        use = shared[of]
        row, col = row[use], column[of[use]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        inter = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(col, [at, at + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[a:b], col[a:b] - at] = 1
            inter += m @ m.T
        near = 100 * inter >= similarity * (n[:, None] + n[None, :] - inter)
        near &= comp[:, None] != comp[None, :]
        root = {x: x for x in set(comp.tolist())}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
            p, q = find(comp[i]), find(comp[j])
            if p != q:
                root[p] = q
                out.append((c[i], c[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of the links; root is the component's least node. Alternates large and small stars.

    Each round is written to the shared folder, so lineage stays short, and halves the distance to the root at least,
    so rounds grow with the logarithm of the longest chain. Nothing comes to the driver but counts.
    """
    spark = links.sparkSession
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: greater neighbours of u go to the least of u and its neighbours.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its lesser neighbours go to the least of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old, edges = edges, stored(small, "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def grouped(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, t, n, component`` of every row (``t``: a hash of its text), as ``near_duplicates`` describes them."""
    spark = docs.sparkSession
    shared_dir(spark)
    least_common = matches(similarity)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    signed = stored(source.mapInArrow(_sign(size), "id long, t long, n long, c long, sig array<int>"), "signatures")
    classes = stored(signed.where("n > 0").groupBy("c").agg(F.min("id").alias("first"), F.min("t").alias("t"), F.count("*").alias("rows"), F.first("sig").alias("sig")), "classes")

    posted = classes.select("c", F.posexplode("sig").alias("j", "v")).select("c", (F.col("v").cast("long") * COORDINATES + F.col("j")).alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    live = posted.join(often, "key").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("p")).where(F.size("p") >= least_common)
    prefix = stored(live.select("c", F.explode(F.slice("p", F.lit(1), F.size("p") - (least_common - 1))).alias("p")).select("c", "p.key", "p.f"), "prefixes")

    # The full sets of the classes that may have partners, from one text each. Texts are found by their hashes; another
    # text of the same hash would add the set of another class.
    sigs = stored(classes.join(prefix.select("c").distinct(), "c", "left_semi").select("c", "t", "sig"), "wanted-signatures")
    some = sigs.select("t").distinct()
    few = sigs.count() <= SENT  # some 16 MB; beyond, texts are shuffled to the hashes instead
    texts = source.join(F.broadcast(some) if few else some, "t", "left_semi").select("text")
    sets = stored(texts.mapInArrow(_sets(size), "c long, s array<long>").dropDuplicates(["c"]), "sets")
    sigs = sigs.select("c", "sig")

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        pairs = pairs.join(sigs.select(F.col("c").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("c").alias("b"), F.col("sig").alias("y")), "b")
        same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, t: s + t)
        pairs = stored(pairs.where(same >= least_common).select("a", "b"), f"{label}-pairs")
        both = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return stored(both.where(100 * common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), f"{label}-links")

    hub = prefix.groupBy("key").agg(F.min("c").alias("a"), F.count("*").alias("k"), F.max("f").alias("f")).where("k > 1")
    links = confirmed(_dealt(prefix, hub).where("c <> a").select("a", F.col("c").alias("b")).distinct(), "hub")
    labels = components(links).withColumnRenamed("node", "c").withColumnRenamed("root", "comp")
    posted = prefix.join(labels, "c", "left").select("key", "f", "c", F.coalesce("comp", "c").alias("comp"))
    mixed_lists = posted.groupBy("key").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("f").alias("f")).where("lo <> hi").select("key", "k", "f")
    posted = stored(_dealt(posted, mixed_lists).select("key", "f", "c", "comp", "k"), "mixed-lists")

    short = posted.where(F.col("k") <= LARGE).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("c", "comp"))).alias("m"))  # at most LARGE members
    pairs = short.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.filter("m", lambda y: (y["c"] > x["c"]) & (y["comp"] != x["comp"])), lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b")))))).alias("p"))
    across = confirmed(pairs.select("p.a", "p.b").distinct(), "across")

    long = stored(_block_rows(posted.where(F.col("k") > LARGE)), "long-lists")
    blocks = long.join(sets, "c").groupBy("key", "u", "v").applyInPandas(_block_links(similarity), "a long, b long")
    links = links.union(across).union(stored(blocks, "block-links"))

    found = components(links)
    least = found.join(classes.select(F.col("c").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("component"))
    to = found.join(least, "root").select(F.col("node").alias("c"), "component")
    to = classes.select("c", "first", "rows").join(to, "c", "left").select("c", "rows", F.coalesce("component", "first").alias("component"))
    # Classes of more than a thousandth of all rows (under a thousand) come to the rows; other rows go to their classes,
    # and those without one join under keys of their own, so that no key has many rows.
    large = classes.agg(F.sum("rows")).first()[0] or 0
    hot = to.where(F.col("rows") * LARGE_CLASS > large).select("c", F.struct("component").alias("hot"))
    rows = signed.select("id", "t", "n", "c").join(F.broadcast(hot), "c", "left")
    key = F.when(F.col("hot").isNull(), F.col("c"))
    rows = rows.withColumn("c", F.coalesce(key, F.xxhash64("id", "t", F.monotonically_increasing_id())))
    cold = to.where(F.col("rows") * LARGE_CLASS <= large).select("c", "component")
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("hot").isNotNull(), F.col("hot.component")).otherwise(F.col("component"))
    return rows.join(cold, "c", "left").select("id", "t", "n", component.alias("component"))


def _dealt(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Members of posting lists joined to what holds for their lists, by ``key`` and a part of it.

    ``f``, of members and lists alike, says how long a list may be; one of more than BLOCK is met in so many parts.
    """
    parts = F.ceil(F.col("f") / BLOCK)
    return members.withColumn("part", F.pmod(F.xxhash64("c"), parts)).join(lists.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("f"), ["key", "part"]).drop("part")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by ``100 * |A & B| >= similarity * |A | B|`` on their sets of word shingles.

    1. Every text is lower-cased in A-Z and cut at ASCII white space; its set holds the hashes of its distinct
       shingles (fewer words: one). Documents of equal sets form a class, and only classes go on.
    2. Each class is posted under its signature's coordinate-value pairs. Pairs that one class has are no postings;
       a class with fewer than ``matches`` others can't have a partner. By the prefix rule the rarest coordinates but
       ``matches`` - 1 suffice to meet every partner, so the lists of common passages are skipped, not merged.
    3. In each list all members meet the list's hub; pairs with ``matches`` common coordinates are confirmed on the full
       sets, and connected members become one component. Then the pairs across components follow: of short lists as
       rows, of long ones by blocks inside tasks, where sparse products give all intersections and only spanning links
       leave. Pairs inside a component can add nothing and are skipped, so a group of n near copies costs about n.

    Returns, one row per document: ``id_col`` (long), ``n_shingles``, ``component_id`` (the least id that links reach)
    and ``kept`` (the id is the component's). A null text or one without words links with nothing and is kept. Rows of
    equal id and set are all kept; one id with two texts is two documents; null ids are never the least of a group with
    others, and then not kept. An empty table gives no rows; other columns are ignored. A long text costs its task 24 bytes
    a word.
    """
    found = grouped(docs, size, similarity, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _block_rows(posted: DataFrame) -> DataFrame:
    """The members of long lists dealt to block pairs (key, u, v).

    A list's most frequent component is linked in itself, so its members only meet the others, and the others each
    other: the rows grow with the members outside it, not with the list's square.
    """
    sizes = posted.groupBy("key", "comp").agg(F.count("*").alias("m"), F.max("f").alias("f"))
    top = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("t"), F.sum("m").alias("k"), F.max("f").alias("f")).select("key", "f", F.col("t.comp").alias("main"), F.col("t.m").alias("m"), (F.col("k") - F.col("t.m")).alias("r"))
    others, mains = F.ceil(F.col("r") / BLOCK).cast("int"), F.ceil(F.col("m") / BLOCK).cast("int")
    rows = _dealt(posted, top).select("key", "c", "comp", (F.col("comp") == F.col("main")).alias("inner"), others.alias("no"), mains.alias("nm"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), F.when(F.col("inner"), F.col("nm")).otherwise(F.col("no"))).cast("int"))
    # Blocks of the others are 0 to no - 1, those of the main component -1 to -nm.
    with_others = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda x: F.struct(F.when(F.col("inner"), -1 - F.col("own")).otherwise(F.least("own", x)).alias("u"), F.when(F.col("inner"), x).otherwise(F.greatest("own", x)).alias("v")))
    with_main = F.transform(F.sequence(F.lit(1), F.col("nm")), lambda x: F.struct((-x).alias("u"), F.col("own").alias("v")))
    dealt = rows.select("key", "c", "comp", F.explode(F.when(F.col("inner"), with_others).otherwise(F.concat(with_others, with_main))).alias("w"))
    return dealt.select("key", "c", "comp", F.col("w.u").alias("u"), F.col("w.v").alias("v"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents less those that another of their group stands for, with their columns.

    Of a group the rows of the least id stay. A row of null id goes only where its group has an id. What goes is told by
    id and text, so rows that share an id with a dropped one but not its text stay.
    """
    found = grouped(docs, id_col=id_col, text_col=text_col, **options)
    gone = stored(found.where(~F.col("id").eqNullSafe(F.col("component"))).select("id", "t").distinct(), "dropped")
    few = gone.count() <= SENT  # some 32 MB travel to the texts, else both sides are shuffled
    gone = F.broadcast(gone) if few else gone
    return docs.join(gone, (F.xxhash64(docs[text_col]) == gone["t"]) & docs[id_col].cast("long").eqNullSafe(gone["id"]), "left_anti").select(docs.columns)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_W} AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""

QUERIES = {"op8_near_duplicates": op8_near_duplicates}
ORACLE_SQL = {"op8_near_duplicates": SQL}
