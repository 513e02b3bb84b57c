"""Byte-level BPE by corpus-level merge replay, and decoding.

The corpus's distinct pre-tokens are counted once. Those that make up most of its occurrences are encoded together, all
merges in rank order over one inverted index, and every task holds their ids; the same replay, over what is left in a
block of documents, encodes the rare ones where they stand.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.llm.common import discard, frequent, lists, shared_dir, slices, small_batches, stored, tidy

#: Most pre-tokens, and bytes in each, of the frequent ones whose ids all tasks hold (13 MB of text at most).
HEAD_WORDS, HEAD_BYTES = 200_000, 64
#: Distinct pre-tokens that a task gathers before it passes their counts on, and rare ones whose ids it holds before it
#: drops them.
HELD, LEARNED = 150_000, 100_000
#: Bytes of text that are cut to words at a time.
BLOCK_BYTES = 4 << 20
#: Bytes from which a batch of decoded texts is passed on.
DECODED_BYTES = 16 << 20
#: Places from which numpy merges them together.
FEW = 24


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (their id) from a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes many words at once: every merge, in order of rank, at all the places where its pair stands."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary needs a token for each byte")
        # All pairs of tokens that make a token, for looking many of them up at once.
        made = [(a << 32 | b, r) for w, r in ranks.items() for k in range(1, len(w)) if (a := ranks.get(w[:k])) is not None and (b := ranks.get(w[k:])) is not None]
        self.codes, self.made = np.array(sorted(made) or [(-1, -1)], np.int64).T.copy()

    @staticmethod
    @functools.lru_cache(maxsize=1)
    def of(path: str) -> MergeReplay:
        return MergeReplay(load_ranks(path))

    def paired(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where they make no token."""
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.made[at], -1).astype(np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and where each word's end; a word that is itself a token has that id alone."""
        own = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        size = np.where(own >= 0, 1, np.array([len(w) for w in words], np.int64))
        stop = np.cumsum(size)
        start = stop - size
        n = int(stop[-1]) if len(words) else 0
        # The same memory twice: numpy takes many places at a time, plain arrays few.
        ids, after, before, pair = (array("i", bytes(4 * n)) for _ in range(4))
        ids_np, after_np, before_np, pair_np = (np.frombuffer(x, np.int32) for x in (ids, after, before, pair))
        whole = np.repeat(own >= 0, size)
        ids_np[whole] = own[own >= 0]
        ids_np[~whole] = self.single[np.frombuffer(b"".join([w for w, r in zip(words, own.tolist(), strict=True) if r < 0]), np.uint8)]
        after_np[:], before_np[:] = np.arange(1, n + 1), np.arange(-1, n - 1)
        after_np[stop[size > 0] - 1] = -1
        before_np[start[size > 0]] = -1
        pair_np[:] = -1
        at = np.flatnonzero(after_np >= 0)
        pair_np[at] = self.paired(ids_np[at], ids_np[at + 1])

        # The inverted index: rank of a pair -> places of its left token, in runs and one by one.
        runs: dict[int, list[np.ndarray]] = {}
        few: dict[int, list[int]] = {}
        heap: list[int] = []

        def post(places: np.ndarray, r: np.ndarray) -> None:
            order = np.argsort(r, kind="stable")
            places, r = places[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for x, rank in zip(np.split(places, cuts), r[np.concatenate(([0], cuts))].tolist(), strict=True):
                if rank not in runs and rank not in few:
                    heapq.heappush(heap, rank)
                if len(x) < FEW:
                    few.setdefault(rank, []).extend(x.tolist())
                else:
                    runs.setdefault(rank, []).append(x)

        at = at[pair_np[at] >= 0]
        if len(at):
            post(at, pair_np[at])
        early: set[int] = set()  # places in words that have a merge of a lower rank than one that came before
        ranks, tokens = self.ranks, self.tokens
        while heap:
            now = heapq.heappop(heap)
            many, places = runs.pop(now, []), few.pop(now, [])
            if not many and len(places) < FEW:
                token = tokens[now]
                for i in sorted(places):
                    if pair[i] != now:
                        continue  # a neighbour has been merged since
                    j = after[i]
                    k, h = after[j], before[i]
                    ids[i], ids[j], after[i], pair[i], pair[j] = now, -1, k, -1, -1
                    if k >= 0:
                        before[k] = i
                        new = pair[i] = ranks.get(token + tokens[ids[k]], -1)
                        if new >= 0:
                            if new < now:
                                early.add(i)
                            elif new in few:
                                few[new].append(i)
                            else:
                                if new not in runs:
                                    heapq.heappush(heap, new)
                                few[new] = [i]
                    if h >= 0:
                        new = pair[h] = ranks.get(tokens[ids[h]] + token, -1)
                        if new >= 0:
                            if new < now:
                                early.add(h)
                            elif new in few:
                                few[new].append(h)
                            else:
                                if new not in runs:
                                    heapq.heappush(heap, new)
                                few[new] = [h]
                continue
            p = np.unique(np.concatenate([*many, np.array(places, np.int64)])) if places or len(many) > 1 else many[0]
            p = p[pair_np[p] == now]
            j = after_np[p]
            beside = p[1:] == j[:-1]
            if beside.any():  # of places in a row every other one is merged, the leftmost first
                first = np.flatnonzero(np.concatenate(([True], ~beside)))
                odd = (np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))) & 1
                p, j = p[odd == 0], j[odd == 0]
            k = after_np[j]
            ids_np[p], ids_np[j], after_np[p], pair_np[p], pair_np[j] = now, -1, k, -1, -1
            right = p[k >= 0]
            before_np[k[k >= 0]] = right
            left = before_np[p]
            for at in (right, left[left >= 0]):
                if len(at):
                    r = pair_np[at] = self.paired(ids_np[at], ids_np[after_np[at]])
                    if (low := (r >= 0) & (r < now)).any():
                        early.update(at[low].tolist())
                    if (r > now).any():
                        post(at[r > now], r[r > now])
        for w in {int(x) for x in np.searchsorted(stop, sorted(early), "right")}:
            alone = self.alone(words[w])
            ids_np[start[w] : stop[w]] = -1
            ids_np[start[w] : start[w] + len(alone)] = alone
        upto = np.concatenate(([0], np.cumsum(ids_np >= 0)))
        return ids_np[ids_np >= 0], upto[stop]

    def alone(self, word: bytes) -> list[int]:
        """The ids of one word, always by its lowest rank, leftmost among equals."""
        ids, after, before = self.single[np.frombuffer(word, np.uint8)].tolist(), [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        rank = lambda i: self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[after[i]]], -1) if i >= 0 and ids[i] >= 0 and after[i] >= 0 else -1
        heap = [(r, i) for i in range(len(word)) if (r := rank(i)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (i, before[i]):
                if (new := rank(x)) >= 0:
                    heapq.heappush(heap, (new, x))
        return [x for x in ids if x >= 0]


@functools.lru_cache(maxsize=1)
def cutter(pattern: str) -> Callable[[str], list[str]]:
    """A function from text to its pre-tokens under a pattern of the ``regex`` library.

    With public_tokenizers.PATTERN, texts within the Basic Multilingual Plane are cut by ``re``, which takes less than half
    the time; its classes list what ``regex`` itself finds in that plane.
    """
    import regex

    slow = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return slow
    plane = "".join(map(chr, range(0x10000)))
    letter, number, space = ("".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in regex.findall(f"{kind}+", plane)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    listed = pattern
    for kind, members in ((r"[^\s\p{L}\p{N}]", f"^{space}{letter}{number}"), (r"\S", f"^{space}"), (r"\s", space), (r"\p{L}", letter), (r"\p{N}", number)):
        listed = listed.replace(kind, f"[{members}]")
    fast = re.compile(listed).findall
    # A character beyond the plane takes two units of UTF-16.
    return lambda x: fast(x) if x.isascii() or len(x.encode("utf-16-le", "surrogatepass")) == 2 * len(x) else slow(x)


def _counts(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = cutter(pattern), Counter()
        for batch in batches:
            for x in batch.column(0):
                held.update(cut(x.as_py() or ""))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return run


def pre_tokens(docs: DataFrame, pattern: str = public_tokenizers.PATTERN, text_col: str = "text") -> DataFrame:
    """``word, n``: every distinct pre-token of the corpus and its occurrences. Null and empty texts have none."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(_counts(pattern)), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def replayed(words: DataFrame, path: str) -> DataFrame:
    """``word, ids`` of distinct pre-tokens, the merges replayed over each batch of them as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay.of(path)
        for batch in batches:
            ids, ends = replay.encode([x.encode() for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(ids, np.concatenate(([0], ends)), pa.int32())], ["word", "ids"])

    return words.select("word").mapInArrow(tidy(run), "word string, ids array<int>")


def corpus_lexicon(docs: DataFrame, path: str, pattern: str, text_col: str):
    """The ids of the frequent pre-tokens of the corpus, as a broadcast of (words, ids, ends); its size is bounded."""
    with small_batches(docs.sparkSession):
        words = stored(pre_tokens(docs, pattern, text_col), "pre-tokens")
    head = replayed(words.where(frequent(words, "word", HEAD_WORDS, HEAD_BYTES)), path).toArrow()
    discard(words)
    ids = head.column(1).combine_chunks()
    ends = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return docs.sparkSession.sparkContext.broadcast((head.column(0).to_pylist(), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), ends))


class Lexicon:
    """Ids of words by their places: those of the corpus's lexicon, then those that a task has learned since."""

    def __init__(self, path: str, words: list[str], flat: np.ndarray, ends: np.ndarray) -> None:
        self.replay = MergeReplay.of(path)
        self.number = [b"%d" % k for k in range(max(self.replay.tokens) + 1)]
        self.place = {w: k for k, w in enumerate(words)}
        self.flat, self.ends = array("i", flat.tobytes()), array("q", ends.tobytes())
        self.spelled: list[bytes] = []  # decimal ids of each word, joined by commas
        self.decoded: list[bytes] = []
        self.known = len(words)
        self._spell(0)

    def _spell(self, at: int) -> None:
        number, tokens = self.number, self.replay.tokens
        for a, b in zip(self.ends[at:-1], self.ends[at + 1 :], strict=True):
            own = self.flat[a:b]
            self.spelled.append(b",".join([number[k] for k in own]))
            self.decoded.append(b"".join([tokens[k] for k in own]))

    def learn(self, words: set[str]) -> None:
        """Ids of new words. When more than LEARNED are there beyond the corpus's, those of earlier blocks go first."""
        if len(self.place) - self.known > LEARNED:
            for word in list(self.place)[self.known :]:
                del self.place[word]
            del self.ends[self.known + 1 :], self.spelled[self.known :], self.decoded[self.known :]
            del self.flat[self.ends[-1] :]
        new, at, base = [w for w in words if w not in self.place], len(self.place), len(self.flat)
        ids, ends = self.replay.encode([w.encode() for w in new])
        self.place.update(zip(new, range(at, at + len(new)), strict=True))
        self.flat.frombytes(ids.tobytes())
        self.ends.extend((ends + base).tolist())
        self._spell(at)


def _blocks(path: str, pattern: str, head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, Lexicon, list[list[int]]]]]:
    """Runs of rows, and the places of each row's words in the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Lexicon, list[list[int]]]]:
        cut, known = cutter(pattern), Lexicon(path, *head.value)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                docs = [cut(x) if x else [] for x in part.column("text").to_pylist()]
                known.learn(set().union(*docs))
                place = known.place.__getitem__
                yield part, known, [list(map(place, words)) for words in docs]

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for each whole text.

    1. Every task counts its pre-tokens; the counts meet in one shuffle.
    2. The merges are replayed over the frequent ones (HEAD_WORDS at most, none over HEAD_BYTES): an inverted index from
       token pairs to their places in those words yields the merges in rank order, each at all its places, and only
       their neighbours are touched. All tasks get the ids.
    3. The texts are cut once more. Words beyond the lexicon are replayed in the same way, those of a block together;
       most of them stand but once in the corpus, and joining each to its text would shuffle more than it saves.

    Null and empty texts have no ids; repeated rows and null ids are kept; empty tables give no rows; other columns are
    ignored. A very long text is taken whole: a task holds its words and ids at once.
    """
    shared_dir(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = _blocks(path, pattern, corpus_lexicon(source, path, pattern, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, known, rows in blocks(batches):
            table, to = np.array(known.flat, np.int32), np.array(known.ends, np.int64)
            counts = np.array([len(r) for r in rows], np.int64)
            seq = np.fromiter((k for r in rows for k in r), np.int64, int(counts.sum()))
            size = to[seq + 1] - to[seq]
            upto = np.cumsum(size)
            ids = table[np.arange(upto[-1] if len(upto) else 0) + np.repeat(to[seq] - upto + size, size)]
            stops = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(counts)))]
            yield pa.RecordBatch.from_arrays([part.column("id"), lists(ids, stops, pa.int32())], ["id", "ids"])

    return source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def _decode(path: str, ids: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = MergeReplay.of(path).tokens
        token = [by_id.get(k, b"") for k in range(max(by_id) + 1)].__getitem__
        for batch in batches:
            done, size, at = [], 0, 0
            for k, row in enumerate(batch.column(ids)):
                done.append(b"".join(map(token, row.as_py() or ())))
                size += len(done[-1])
                if size > DECODED_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(at, len(done))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.binary())], [*part.schema.names, "decoded"])
                    done, size, at = [], 0, k + 1

    return run


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The table with ``decoded``, the bytes of each list of ids; a null or empty list has none."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(tidy(_decode(path, ids_col)), f"{kinds}, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every document in one pass: ``id_col``, ``n_tokens`` and ``ids_sha256, decoded_sha256``, digests
    of its decimal ids, joined by commas, and of the bytes that they decode to.

    The ids are those of ``encode_documents``. Decoding a text is decoding its words' ids one after another, so each
    distinct word is decoded once and neither ids nor bytes leave the task. Null and empty texts have no tokens and the
    digests of nothing; repeated rows and null ids are kept; empty tables give no rows; other columns are ignored. The digests are
    made at once and stored.
    """
    shared_dir(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = _blocks(path, pattern, corpus_lexicon(source, path, pattern, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, known, rows in blocks(batches):
            spelled, decoded = known.spelled.__getitem__, known.decoded.__getitem__
            counts, ids, texts = [], [], []
            for row in rows:
                own = b",".join(map(spelled, row))
                counts.append(own.count(b",") + 1 if own else 0)
                ids.append(hashlib.sha256(own).hexdigest())
                texts.append(hashlib.sha256(b"".join(map(decoded, row))).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    digests = source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
    with small_batches(docs.sparkSession):
        return stored(digests, "token-digests")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLE_SQL: dict[str, str] = {}
