"""Queries that no key settles, against the references of their genus, by edit distance: block by block, distributed."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiphyte.plans import distance
from lexiphyte.plans.distance import pairs_within

# Sent along with the plan: executors needn't have this package.
for module in (distance, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)

#: Queries of a genus beyond which it is cut into blocks, each of which meets all of the genus's references.
BLOCK = 4_096
#: Parts over which rows go that meet nothing.
SPREAD = 1_024
#: Rows of a batch of pairs.
BATCH = 20_000


def with_near(state: DataFrame, targets: DataFrame, sizes: DataFrame, max_dist: float, of_query: list[str], of_ref: list[str]) -> DataFrame:
    """``of_query, of_ref, match_type``: for each row of ``state`` the references of its genus within ``max_dist``, or the
    row as it is, if there are none.

    ``state`` has ``_genus`` (null: meets nothing), ``_id``, ``_key``, ``_hash`` and all output columns; ``targets`` has
    ``_genus, _id, _key`` and ``of_ref``; ``sizes`` has ``_genus`` and how many queries it has at most, ``count``. The
    number of pairs is what it is; what a task holds is a block of queries and a batch of references.
    """
    shown = [*of_query, *of_ref, "match_type"]
    # No more rows than there are queries by BLOCK.
    cut = F.broadcast(sizes.where(F.col("count") > BLOCK).select("_genus", F.ceil(F.col("count") / BLOCK).cast("int").alias("_blocks")))
    blocks = F.coalesce("_blocks", F.when(F.col("_genus").isNull(), SPREAD).otherwise(1))
    left = state.join(cut, "_genus", "left").select("_genus", F.pmod("_hash", blocks).cast("int").alias("_block"), F.lit(False).alias("_ref"), "_id", "_key", *shown)
    right = targets.join(cut, "_genus", "left").select("_genus", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"), F.lit(True).alias("_ref"), "_id", "_key", *of_ref)
    # Of a fixed number, as partitions that adaptive execution makes are of equal bytes, and the work is not in the bytes.
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.unionByName(right, allowMissingColumns=True).repartition(parts, "_genus", "_block").sortWithinPartitions("_genus", "_block", "_ref")
    return rows.mapInArrow(_search(max_dist, of_query, of_ref), left.select(shown).schema)


class _Block:
    """The queries of one block, and which of them have met something."""

    def __init__(self, shown: list[str], of_ref: set[str], max_dist: float):
        self.shown, self.of_ref, self.max_dist, self.parts, self.table = shown, of_ref, max_dist, [], None

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def meet(self, refs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.table is None:
            table = pa.Table.from_batches(self.parts).combine_chunks()
            self.table, self.parts = {c: table.column(c).chunk(0) for c in table.column_names}, []
            self.keys, self.known = self.table["_key"].to_pylist(), self.table["_id"].unique()
            self.ids = _places(self.table["_id"], self.known, -1)
            self.met = np.zeros(len(self.keys), bool)
        ids = _places(refs.column("_id"), self.known, -2)
        usable = refs.column("_id").is_valid().to_numpy(zero_copy_only=False)
        qs, rs, held = [], [], 0
        for q, r in pairs_within(self.keys, refs.column("_key").to_pylist(), self.max_dist):
            other = (self.ids[q] != ids[r]) & (self.ids[q] >= 0) & usable[r]
            q, r = q[other], r[other]
            self.met[q] = True
            qs.append(q)
            rs.append(r)
            held += len(q)
            if held >= BATCH:
                yield from self.pairs(np.concatenate(qs), np.concatenate(rs), refs)
                qs, rs, held = [], [], 0
        if held:
            yield from self.pairs(np.concatenate(qs), np.concatenate(rs), refs)

    def pairs(self, q: np.ndarray, r: np.ndarray, refs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(q), BATCH):
            qk, rk = pa.array(q[k : k + BATCH]), pa.array(r[k : k + BATCH])
            made = [pa.repeat("auto_fuzzy", len(qk)) if c == "match_type" else refs.column(c).take(rk) if c in self.of_ref else self.table[c].take(qk) for c in self.shown]
            yield pa.RecordBatch.from_arrays(made, names=self.shown)

    def rest(self) -> Iterator[pa.RecordBatch]:
        """The queries that have met nothing."""
        if self.table is None:
            yield from (rows.select(self.shown) for rows in self.parts)
        elif not self.met.all():
            left = pa.array(np.nonzero(~self.met)[0])
            yield pa.RecordBatch.from_arrays([self.table[c].take(left) for c in self.shown], names=self.shown)


def _places(ids: pa.Array, known: pa.Array, absent: int) -> np.ndarray:
    """The ids' places among the known ones; null ids and others are ``absent``."""
    found = pc.if_else(ids.is_valid(), pc.index_in(ids, value_set=known), None)
    return pc.fill_null(found, absent).to_numpy(zero_copy_only=False)


def _search(max_dist: float, of_query: list[str], of_ref: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shown = [*of_query, *of_ref, "match_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            genus, number, ref = batch.column("_genus"), batch.column("_block"), batch.column("_ref")
            code = pc.fill_null(genus.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            marks = np.stack([code, number.to_numpy(), ref.to_numpy(zero_copy_only=False)])
            starts = [0, *(np.nonzero((marks[:, 1:] != marks[:, :-1]).any(0))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                rows, at = batch.slice(a, b - a), (genus[a].as_py(), number[a].as_py())
                if at[0] is None:
                    yield rows.select(shown)
                    continue
                if at != here:
                    if block:
                        yield from block.rest()
                    here, block = at, None
                if not ref[a].as_py():
                    block = block or _Block(shown, set(of_ref), max_dist)
                    block.add(rows)
                elif block:
                    yield from block.meet(rows)
        if block:
            yield from block.rest()

    return run
