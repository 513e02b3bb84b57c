"""Language spans: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.llm.common import shared_dir, slices
from lexiphyte.llm.subwords import row_sums, word_grams
from lexiphyte.llm.toxicity import held_out

#: Documents of each language that profiles are counted on at most, in the order of a hash of their ids.
TRAIN_DOCS = 1_500
GRAMS, BUCKETS = (1, 2, 3, 4, 5), 1 << 17
#: Bounds of a word's evidence and the price of a change of language, in natural logs.
CLIP, SWITCH = 6.0, 12.0

#: First letters of scripts: code point ranges and their names.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3FFFF),
)
_LOW = np.array(sorted(a for _, a, _ in SCRIPTS))
_RANGES = sorted((a, b, s) for s, a, b in SCRIPTS)


def script_of(ch: str) -> str:
    k = int(np.searchsorted(_LOW, ord(ch), "right")) - 1
    return _RANGES[k][2] if k >= 0 and ord(ch) <= _RANGES[k][1] else "other"


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


class LanguageModel:
    """Character n-gram profiles of each language and the scripts that it is written in."""

    def fit(self, texts: dict[str, list[str]]) -> LanguageModel:
        self.langs = sorted(texts)
        counts = np.zeros((BUCKETS, len(self.langs)), np.float64)
        self.scripts: list[set[str]] = []
        for j, lang in enumerate(self.langs):
            seen: dict[str, int] = {}
            for at in range(0, len(texts[lang]), 64):
                part = texts[lang][at : at + 64]
                w = word_grams(pa.array(part, pa.large_string()), GRAMS, True)
                times = np.bincount(w.of, minlength=len(w.letters))
                per = np.repeat(times, np.diff(w.gram_end))
                counts[:, j] += np.bincount((w.gram & np.uint64(BUCKETS - 1)).astype(np.int64), per, BUCKETS)
                for x in part:
                    for c in set(x):
                        if c.isalpha():
                            s = script_of(c)
                            seen[s] = seen.get(s, 0) + 1
            self.scripts.append({s for s, n in seen.items() if n * 100 >= sum(seen.values())})
        total = counts.sum(0)
        smooth = 0.5
        self.table = np.log((counts + smooth) / (total + smooth * BUCKETS)).astype(np.float32) if len(self.langs) else np.zeros((BUCKETS, 0), np.float32)
        return self

    def word_scores(self, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Evidence of every word for every language, word lengths, and each row's first word."""
        w = word_grams(text, GRAMS, True)
        per = row_sums(self.table[(w.gram & np.uint64(BUCKETS - 1)).astype(np.int64)], w.gram_end)
        # Neighbouring n-grams tell much the same, so a word counts as some of them and not as all.
        per /= np.sqrt(np.maximum(np.diff(w.gram_end), 1))[:, None]
        per -= per.max(1, keepdims=True, initial=-1e9)
        per = np.maximum(per, -CLIP)
        return per[w.of].astype(np.float32), w.letters[w.of], w.row

    def narrowed(self, text: str) -> np.ndarray:
        """Which languages are written in a script that the text has letters in; all, where there is none."""
        found = {script_of(c) for c in set(text) if c.isalpha()}
        keep = np.array([bool(s & found) for s in self.scripts], bool)
        return keep if keep.any() else np.ones(len(self.langs), bool)

    def paths(self, scores: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best sequence of languages of each row's words."""
        n, langs = scores.shape
        out = np.zeros(n, np.int8)
        total = row_sums(scores.astype(np.float64), row)
        best = total.argmax(1) if langs else np.zeros(len(total), np.int64)
        size = np.diff(row)
        out[:] = np.repeat(best, size)
        # Staying with a row's best language is optimal unless, over some run of words, the others gain more than the
        # price of one change. The gain over the best run is a running sum less its least value so far.
        one = np.repeat(best, size)
        own = scores[np.arange(n), one] if n else np.zeros(0)
        rest = scores.copy()
        rest[np.arange(n), one] = -np.inf
        gain = (rest.max(1) - own).astype(np.float64) if langs > 1 else np.full(n, -1.0)
        gain = np.where(np.isfinite(gain), gain, -CLIP)
        run = np.cumsum(gain)
        base = np.concatenate(([0.0], run))[row[:-1]]
        run -= np.repeat(base, size)
        drop = 4.0 * CLIP * (size.max(initial=0) + 1)
        level = -drop * np.repeat(np.arange(len(size)), size)
        before = np.minimum(np.concatenate(([0.0], run[:-1])), 1e300)
        firsts = row[:-1][size > 0]
        before[firsts] = 0.0
        least = np.minimum.accumulate(before + level) - level
        most = np.full(len(size), -np.inf)
        if n:
            most[size > 0] = np.maximum.reduceat(run - least, firsts)
        open_rows = np.flatnonzero(most > SWITCH)
        if len(open_rows):
            self._viterbi(scores, row, open_rows[np.argsort(-size[open_rows], kind="stable")], out)
        return out

    def _viterbi(self, scores: np.ndarray, row: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        """All given rows (longest first) at once, a word of each at every step."""
        start, size = row[rows], np.diff(row)[rows]
        langs = scores.shape[1]
        back = np.zeros((int(size.sum()), langs), np.int8)
        at = np.concatenate(([0], np.cumsum(size)))[:-1]
        value = scores[start].copy()
        same = np.arange(langs, dtype=np.int8)[None, :]
        for t in range(1, int(size[0])):
            k = int(np.searchsorted(-size, -t, "left"))
            v = value[:k]
            top = v.argmax(1)
            switch = v[np.arange(k), top][:, None] - SWITCH
            move = switch > v
            back[at[:k] + t] = np.where(move, top[:, None], same)
            value[:k] = np.where(move, switch, v) + scores[start[:k] + t]
        state = value.argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            k = int(np.searchsorted(-size, -t, "left"))
            out[start[:k] + t] = state[:k]
            if t:
                state[:k] = back[at[:k] + t, state[:k]]

    def label(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Each row's language and its share of letters; and the labels of all words with each row's first word."""
        values = text.to_pylist()
        scores, letters, row = self.word_scores(text)
        plain = pc.fill_null(pc.string_is_ascii(text), True).to_pylist()
        latin = np.array(["latin" in s for s in self.scripts], bool)
        for k in range(len(row) - 1):
            # Where all languages are written in Latin letters, a text of these alone narrows nothing.
            if not values[k] or latin.all() and (plain[k] or max(values[k]) <= "ɏ"):
                continue
            keep = self.narrowed(values[k])
            if not keep.all():
                scores[row[k] : row[k + 1], ~keep] = -2 * CLIP
        path = self.paths(scores, row)
        mass = np.stack([row_sums((letters * (path == j)).astype(np.float64), row) for j in range(len(self.langs))], 1)
        top = mass.argmax(1)
        share = mass[np.arange(len(top)), top] / np.maximum(mass.sum(1), 1)
        ascii_letter = np.diff(row) > 0
        langs, out = [], np.zeros(len(top))
        for k, x in enumerate(values):
            if x is None or not (ascii_letter[k] and (plain[k] or has_letter(x))):
                langs.append("und")
            else:
                langs.append(self.langs[top[k]])
                out[k] = share[k]
        return langs, out, path, row


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Profiles from at most TRAIN_DOCS documents of each language outside the held-out fold."""
    from pyspark.sql import Window

    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    # The smallest hashes of each language are found by a partial top-k in every task: no language meets in one task whole.
    ids = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    part = ids.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= TRAIN_DOCS // 64 + 1).select("id", "lang")
    rows = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(part.select("id").distinct()), "id").select("lang", "text").toArrow()
    texts: dict[str, list[str]] = {}
    for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    return LanguageModel().fit(texts)


def _label(model, names: list[str], spans: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                if m.langs:
                    langs, share, path, row = m.label(part.column("text"))
                else:
                    langs, share, path, row = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(0, np.int8), np.zeros(part.num_rows + 1, np.int64)
                columns = [part.column("id"), pa.array(langs, pa.string()), pa.array(share)]
                if spans:
                    columns.append(pa.array([_runs(path[row[k] : row[k + 1]], m.langs) for k in range(part.num_rows)], pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _runs(path: np.ndarray, langs: list[str]) -> list[dict]:
    if not len(path):
        return []
    cut = np.flatnonzero(np.diff(path)) + 1
    starts = np.concatenate(([0], cut))
    return [{"lang": langs[path[a]], "first": int(a), "words": int(b - a)} for a, b in zip(starts, np.append(cut, len(path)), strict=True)]


def identify_languages(docs: DataFrame, model: LanguageModel | None = None, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every whole text and, with ``spans``, its runs of words by language.

    Words are runs of letters; each has a score for every candidate language from its character n-grams. Languages
    without a script of the text's letters are no candidates. Viterbi labels the words, paying SWITCH for each change.
    The document's language has most bytes of labelled words, and the score is its share of them. Null texts and those
    without a letter give ``und`` and 0; so do all where nothing is known to learn from. Repeated rows are labelled one
    by one; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    held = spark.sparkContext.broadcast(model or fit(docs, id_col, text_col))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    extra = ", spans array<struct<lang:string,first:int,words:int>>" if spans else ""
    names = ["id", "lang_pred", "score"] + (["spans"] if spans else [])
    found = source.mapInArrow(_label(held, names, spans), f"id {kind}, lang_pred string, score double{extra}")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), *names[1:])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_language_id": op7_language_id}
ORACLE_SQL: dict[str, str] = {}
