"""Secret scans through nested encodings: a worklist of decoded layers, each scanned and mapped back to the text."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.llm.common import slices

KINDS = ("assign", "access", "hex")
#: Bytes that one compressed blob may unfold to; a larger one is taken for an attack on the scan and left folded.
UNFOLD_BYTES = 32 << 20

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+")
#: A run, with the lines that follow where they hold nothing else: blobs are often wrapped.
_BASE64 = re.compile(r"""[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]++(?=[\x20\t]*(?:[\r\n"'=,;)}\]<]|\Z)))*={0,2}""")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Text in decoded bytes; less than 12 characters hold neither a secret nor a further blob.
_TEXT = re.compile(rb"(?:[\t\n\r\x20-\x7E]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}){12,}+")
_MAGIC = re.compile(rb"\x1F\x8B\x08|\x78[\x01\x5E\x9C\xDA]|BZh[1-9]|\xFD7zXZ\x00")
_WORDS = ("passw", "secret", "token", "api")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def scan(text: str) -> list[Span]:
    """The secrets in one layer as (start, kind, end), code points, end exclusive; per kind leftmost, not overlapping."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def _unescaped(run: str) -> list[tuple[str, int, int]]:
    """The pieces of a run of escapes that decode, each with its place in the run; what is no text between them stays."""
    if run[1] == "u":
        plain = bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass")
        sizes = [12 if c > "\uffff" else 6 for c in plain]
    else:
        width = 3 if run[0] == "%" else 4
        plain = bytes.fromhex(run.replace("%" if width == 3 else "\\x", "")).decode(errors="surrogateescape")
        sizes = [width if "\ud800" <= c <= "\udfff" else width * len(c.encode()) for c in plain]
    out, ends = [], [0, *accumulate(sizes)]
    for m in re.finditer("[^\ud800-\udfff]+", plain):
        out.append((m[0], ends[m.start()], ends[m.end()]))
    return out


def _unfolded(raw: bytes) -> tuple[bytes, int] | None:
    """Decompressed bytes and how many they were made of, the same bytes where they aren't compressed, None where that
    fails or passes the bound."""
    try:
        if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0:
            d = zlib.decompressobj(47)
            out = d.decompress(raw, UNFOLD_BYTES)
            return (out, len(raw) - len(d.unused_data)) if d.eof else None
        if raw[:3] == b"BZh" or raw[:6] == b"\xfd7zXZ\x00":
            d = bz2.BZ2Decompressor() if raw[:1] == b"B" else lzma.LZMADecompressor(memlimit=256 << 20)
            out = d.decompress(raw, UNFOLD_BYTES)
            return (out, len(raw) - len(d.unused_data)) if d.eof else None
    except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
        return None
    return raw, len(raw)


def _unbased(run: str) -> str | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return None
    # Bytes that can start neither text nor a compressed stream end most attempts here.
    if raw[0] != 0x1F and raw[0] < 9 or 0x80 <= raw[0] < 0xC2 or raw[0] > 0xF4 and raw[0] != 0xFD:
        return None
    found = _unfolded(raw)
    return _plain(found[0]) if found else None


def _plain(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and (text.isprintable() or not set(text) & _CONTROL) else None


_CONTROL = {chr(k) for k in (*range(9), 11, 12, *range(14, 32), 127)}


def _inside(run: str, heads: list[int]) -> list[tuple[str, int, int]]:
    """Texts and compressed streams anywhere in a run that is no blob as a whole, with the characters they come from.

    Each of the four alignments is decoded once. A piece starts at one of ``heads`` (after a separator or line end), or
    wherever text starts; the latter is left out where it only adds up to three bytes and no other secret to the former.
    """
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    out = []
    for k in range(4):
        body = plain[k:]
        if len(body) % 4 == 1:
            body = body[:-1]
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
        place = lambda a, b, k=k, n=len(raw): (k + a * 8 // 6, len(run) if b == n else k + -(-b * 8 // 6))
        upto = 0
        for m in _MAGIC.finditer(raw):
            if m.start() >= upto and (found := _unfolded(raw[m.start() :])):
                upto = m.start() + found[1]
                if (new := _plain(found[0])) is not None:
                    out.append((new, *place(m.start(), upto)))
        starts = [(p - k) // 4 * 3 for p in heads if p >= k and p % 4 == k]
        at = 0
        for m in _TEXT.finditer(raw):
            a, b = m.span()
            while at < len(starts) and starts[at] < a:
                at += 1
            whole = raw[a:b].decode()
            # A head may lie inside a character; then it is none of text.
            if at < len(starts) and starts[at] < b and (own := _TEXT.match(raw, starts[at])) and own.end() == b:
                text = own[0].decode()
                out.append((text, *place(starts[at], b)))
                cut = len(whole) - len(text)
                if starts[at] - a <= 3 and [(x - cut, y, z - cut) for x, y, z in scan(whole)] == scan(text):
                    continue
            out.append((whole, *place(a, b)))
    return out


def _blobs(layer: str) -> Iterator[tuple[str, int, int]]:
    """The texts of the base64 blobs in a layer, each with the blob's span, over line ends where it is wrapped."""
    for m in _BASE64.finditer(layer):
        lines = [x.span() for x in _LINE.finditer(layer, *m.span())]
        run = "".join(layer[a:b] for a, b in lines)
        new = _unbased(run)
        if new is not None:
            yield new, *m.span()
            continue
        heads, n, done = [], 0, []
        for a, b in lines:
            heads.append(n)
            n += b - a
            if len(lines) > 1 and b - a >= 16 and (new := _unbased(layer[a:b])) is not None:
                done.append((a, b))
                yield new, a, b
        at = [p for a, b in lines for p in range(a, b)]
        heads = sorted({*heads, *(x.end() for x in re.finditer("[/_-]", run))})
        for new, a, b in _inside(run, heads):
            a, b = at[a], at[b - 1] + 1
            if not any(x <= a and b <= y for x, y in done):
                yield new, a, b


def layers(text: str) -> Iterator[tuple[str, Callable[[int, int], tuple[int, int]], int]]:
    """The text and all that its encoded parts unfold to, each once, with a map from its spans to those of the text.

    Escapes (URL, Unicode) are replaced in place, so their layer maps character by character; base64 and compressed
    blobs map to the span of the blob. A layer that came up before, from whatever path, isn't taken again.
    """
    work: list[tuple[str, Callable[[int, int], tuple[int, int]], int]] = [(text, lambda a, b: (a, b), 0)]
    seen: set[tuple[bytes, tuple[int, int]]] = set()
    while work:
        layer, back, depth = work.pop()
        # A text that occurs at two places of the document is two layers; at one place it is a cycle.
        key = (hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest(), back(0, len(layer))) if depth else (b"", (0, 0))
        if key in seen:
            continue
        seen.add(key)
        yield layer, back, depth
        if "%" in layer or "\\" in layer:
            if _ESCAPED.search(layer):
                parts, starts, stops, at = [], [], [], 0
                for m in _ESCAPED.finditer(layer):
                    for plain, a, b in _unescaped(m[0]):
                        a, b = m.start() + a, m.start() + b
                        parts += layer[at:a], plain
                        starts += [*range(at, a), *[a] * len(plain)]
                        stops += [*range(at + 1, a + 1), *[b] * len(plain)]
                        at = b
                parts.append(layer[at:])
                starts += range(at, len(layer))
                stops += range(at + 1, len(layer) + 1)
                new = "".join(parts)
                if new != layer and new:
                    work.append((new, lambda a, b, s=starts, e=stops, back=back: back(s[a], e[max(a, b - 1)]), depth + 1))
        for new, *span in _blobs(layer):
            if new != layer:
                work.append((new, lambda a, b, m=span, back=back: back(*m), depth + 1))


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the text itself, and those with all that nested layers hold; each sorted, without repeats."""
    base: list[Span] = []
    every: set[Span] = set()
    for layer, back, depth in layers(text):
        found = scan(layer)
        if not depth:
            base = sorted(found)
            every.update(base)
        else:
            for a, kind, b in found:
                s, e = back(a, b)
                every.add((s, kind, e))
    return base, sorted(every)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by ``[secret]``."""
    out, at, upto = [], 0, -1
    for a, _, b in spans:
        if a >= upto:
            out += [text[at:a], "[secret]"]
        upto = max(upto, b)
        at = upto
    return "".join([*out, text[at:]])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            counts: tuple[list[int], ...] = ([], [], [])
            digests, spans = [], []
            for text in part.column("text").to_pylist():
                base, every = find_secrets(text or "")
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every document, in its text and in the layers nested in it.

    Kinds: ``assign`` (a secret's name, ``:`` or ``=`` and a value of 6 or more characters), ``access`` (an access key
    of 20 or more), ``hex`` (24 or more hexadecimal digits). Returns, one row per input row, ``id_col``, the counts
    ``n_assign, n_access, n_hex`` and the digest ``base_sha256`` of the spans in the text itself, and ``spans`` with all
    spans. Null text counts as empty and has none; empty tables give no rows; further columns are ignored. Rows are
    handled one by one in whatever task they are, so there is no shuffle and nothing to skew.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_report, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with all secrets, nested ones included, replaced by ``[secret]`` and ``chars_col`` brought up to date.

    Null texts stay null. A row without secrets stays as it is.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                old = part.column(text_col).to_pylist()
                new = [x if x is None or not (s := find_secrets(x)[1]) else redacted(x, s) for x in old]
                columns = [part.column(n) for n in names]
                columns[names.index(text_col)] = pa.array(new, part.column(text_col).type)
                if chars_col in names:
                    own = part.column(chars_col).to_pylist()
                    columns[names.index(chars_col)] = pa.array([n if a is b or a == b else len(b) for a, b, n in zip(old, new, own, strict=True)], part.column(chars_col).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_secret_scans": op5_secret_scans}
ORACLE_SQL: dict[str, str] = {}
