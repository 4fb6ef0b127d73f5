"""Secret scans: base patterns of the contract, and a token-efficiency test for other random strings.

Method. A run of identifier characters that a byte-pair vocabulary cannot pack into long tokens is
random: its characters per token stay low, where words, names and paths reach high ratios. In a run that
is not random as a whole the stretches between words and the parts between separators are tested too. Known
digests (hexadecimal strings of the usual lengths), UUIDs and identifiers made of words of the vocabulary are excluded.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, kept, lean, per_text, read_table
from .textvec import byte_class

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A run of this many characters with fewer characters per token than RATIO is taken as random.
MIN_LENGTH = 16
RATIO = 2.0
#: Parts with so many characters per token or more are words.
WORD_RATIO = 3.0

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more: where a shorter run fails, none of its parts passes
RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")
KINDS = ("assign", "access", "hex", "random")
#: Lengths in hexadecimal digits of md5, sha1, sha224, sha256, sha384 and sha512.
DIGESTS = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_UUID_PART = re.compile(rf"(?<![0-9A-Za-z]){_UUID.pattern}(?![0-9A-Za-z])")
_BETWEEN = re.compile(r"[A-Za-z0-9]+")
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

_encoding = kept("secrets")


def vocabulary(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once in each worker."""
    if path not in _encoding:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _encoding[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoding[path]


def known(run: str) -> bool:
    """Known digests, UUIDs and plain numbers."""
    return bool(len(run) in DIGESTS and _HEX_ONLY.fullmatch(run) or _UUID.fullmatch(run)) or not any(c.isalpha() for c in run)


def packed(part: str, path: str) -> bool:
    """Whether the vocabulary knows a part as words."""
    return len(part) >= WORD_RATIO * len(vocabulary(path).encode_ordinary(part))


def excluded(run: str, path: str) -> bool:
    """What is known, and identifiers: stretches of four letters or more that the vocabulary knows as words make up most of them."""
    return known(run) or sum(len(p) for p in _PARTS.findall(run) if p.isalpha() and len(p) > 3 and packed(p, path)) > 0.6 * len(run)


def random_runs(text: str, path: str, ratio: float) -> list[tuple[int, int]]:
    """Random runs; of others the random stretches between words, or else the random parts between separators."""

    def test(lo, hi):
        run = text[lo:hi]
        return hi - lo >= MIN_LENGTH and len(run) < ratio * len(vocabulary(path).encode_ordinary(run)) and not excluded(run, path)

    found = []
    for m in RUN.finditer(text):
        run = m[0].strip(".=-/_+")
        if len(run) < MIN_LENGTH or known(run):
            continue
        start = m.start() + m[0].index(run)
        if test(start, start + len(run)):
            found.append((start, start + len(run)))
            continue
        stretches: list[list[tuple[int, int]]] = [[]]
        for p in _BETWEEN.finditer(_UUID_PART.sub(lambda u: "/" * len(u[0]), run)):
            if packed(p[0], path) or known(p[0]) and len(p[0]) >= MIN_LENGTH:
                stretches.append([])
            else:
                stretches[-1].append((start + p.start(), start + p.end()))
        for parts in filter(None, stretches):
            whole = (parts[0][0], parts[-1][1])
            found += [whole] if test(*whole) else [p for p in parts if test(*p)]
    return found


def find_secrets(text: str, suspicious: bool, path: str = VOCABULARY, ratio: float = RATIO) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and the method's own as (start, kind, end); ``suspicious`` says whether a long run may stand in the text."""
    base = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if not suspicious:
        return base, []
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken = [(s, e) for s, _, e in base]
    own = [(s, 3, e) for s, e in random_runs(text, path, ratio) if not any(s < b and a < e for a, b in taken)]
    return base, own


_RUN_BYTES = byte_class(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"))


def suspicious_texts(texts: list[str]) -> np.ndarray:
    """Which texts hold a run of MIN_LENGTH identifier characters."""
    joined = "\n".join(texts).encode()
    data = np.frombuffer(joined, np.uint8)
    out = np.zeros(len(texts), bool)
    if not len(data):
        return out
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _RUN_BYTES[data]
    start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    start = start[end - start >= MIN_LENGTH]
    bounds = np.cumsum([0] + [len(t.encode()) + 1 for t in texts])
    out[np.searchsorted(bounds, start, "right") - 1] = True
    return out


def spans_text(spans: list[tuple[int, int, int]], kinds) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(path: str, ratio: float):
    def rows(texts):
        import hashlib

        for text, sus in zip(texts, suspicious_texts(texts), strict=True):
            base, own = find_secrets(text, bool(sus), path, ratio)
            n = [sum(k == j for _, k, _ in base) for j in range(3)]
            yield (*n, hashlib.sha256(spans_text(base, KINDS).encode()).hexdigest(), spans_text(base + own, KINDS), len(own))

    return rows


def secret_scan(docs: DataFrame, path: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """``doc_id``, counts of base secrets, the digest of base spans and all spans, for each row of ``docs(doc_id, text)``.

    ``spans`` lists kind:start:end in code points, by start and then kind; the method's kind is
    ``random``. Null and empty texts have no spans. Texts are scanned whole, however long; repeated rows
    give equal rows; an empty table gives an empty one; other columns are not looked at. A row is scanned
    where it lies, so nothing is shuffled. ``path`` is the vocabulary file on every executor.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_text(docs, ["doc_id"], "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long", _scan(path, ratio), operator="secrets")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every secret in a text becomes ``[SECRET]``, and n_chars follows; no document is dropped.

    Overlapping spans are replaced together. Null texts stay null. Texts are worked on a megabyte at a time.
    """
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi in by_bytes(batch.column(at), 1 << 20):
                part = batch.slice(lo, hi - lo)
                cols = part.columns
                cols[at] = pa.array(_redacted(part.column(at).to_pylist()), part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    plain = docs.withColumn("text", F.col("text").cast("string"))
    shown = plain.mapInArrow(lean(run, "secrets"), plain.schema)
    return shown.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else shown


def _redacted(texts: list[str | None]) -> list[str | None]:
    whole = [t or "" for t in texts]
    out: list[str | None] = []
    for given, text, sus in zip(texts, whole, suspicious_texts(whole), strict=True):
        base, own = find_secrets(text, bool(sus))
        pieces, done = [], 0
        for s, _, e in sorted(base + own):
            if s >= done:
                pieces += [text[done:s], "[SECRET]"]
            done = max(done, e)
        out.append(None if given is None else "".join([*pieces, text[done:]]))
    return out
