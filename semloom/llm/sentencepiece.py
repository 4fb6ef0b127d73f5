"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

Method. An Aho-Corasick automaton over all pieces reads a text once. At each position the output links
name the pieces that end there, and each of them relaxes the best score of that position from the best
score where it starts; the path back from the end is the encoding. Characters that no piece covers are
spelled in byte pieces, or become the unknown piece where a model has none.

Two kinds of model. A unigram model's scores are log-probabilities, and every path may be relaxed. A BPE
model's scores are merge ranks, whose sum means nothing: its encoding is the one path in which no pair of
neighbours would have been merged otherwise. So for a BPE model a piece relaxes a position only from a
predecessor it can stand beside, which gives exactly what merging by rank gives.

Scale. No piece crosses from a letter to a space mark, so a text falls apart at its spaces (checked for
each model), and a worker encodes each different word once, in a table of bounded size. Rows are encoded
where they lie; the model file is read by path on every executor.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, lean, read_table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_CACHE_WORDS, _CACHE_PAIRS = 200_000, 600_000


class _Known(dict):
    """Encodings of stretches as packed 32-bit numbers, made when first asked for.

    Two generations of bounded size: when the young one is full it becomes the old one, from which
    stretches in use come back, so that rare ones go and frequent ones stay.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        packed = self.old.get(part)
        if packed is None:
            packed = np.array(self.codec._viterbi(part), np.int32).tobytes()
        if len(part) <= 64:
            if len(self) >= _CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[part] = packed
        return packed


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, proto: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        self.merges = model.trainer_spec.model_type == 2
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with the identity normalization, which decode to the very text, are taken")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.usable = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER)}
        self.all_usable = dict(self.usable)
        if self.merges:  # pieces that merging never leaves whole take no part
            self.spines = {}
            for p in list(self.usable):
                if not self._grow(p):
                    del self.usable[p]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.usable.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.floor = min((self.scores[i] for i in self.usable.values()), default=0.0) - _UNKNOWN_PENALTY
        self.parts = re.compile(self._boundaries())
        self.known = _Known(self)
        self.fits: dict[int, bool] = {}
        self.spelled: list[bytes] = []

    def _boundaries(self) -> str:
        """A pattern of the stretches of a text that no piece crosses: words, or marks, with the spaces before them."""
        inner = {a + b for p in self.usable for a, b in zip(p, p[1:])}
        if any(a != SPACE and b == SPACE for a, b in inner):
            return "(?s).+"
        mixed = [(a, b) for a, b in inner if SPACE not in (a, b) and a.isalnum() != b.isalnum()]
        odd = {c for pair in mixed for c in pair if c.isalnum()}  # such as a raised 2 before a full stop: marks as well
        letter = lambda c: c.isalnum() and c not in odd
        if any(SPACE not in (a, b) and letter(a) != letter(b) for a, b in inner):
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        other = "".join(map(re.escape, sorted(odd)))
        return rf"{SPACE}*[^\W_{other}]+|{SPACE}*(?:[^\w{SPACE}]|[_{other}])+|{SPACE}+"

    def _grow(self, piece: str) -> bool:
        """Merge a piece's characters by rank; keep what stands at its left and right end, and until which rank."""
        parts, left, right = list(piece), [], []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.all_usable.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return False
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        never = float("-inf")
        self.spines[piece] = ([*left, (piece, never)], [*right, (piece, never)])
        return True

    def _stands(self, a: str, b: str) -> bool:
        """Whether merging leaves the pieces a, b as they are: no merge across comes before those on either side of it."""
        right, left, i, j = self.spines[a][1], self.spines[b][0], 0, 0
        while True:
            (x, until_x), (y, until_y) = right[i], left[j]
            k = self.all_usable.get(x + y)
            # of equal ranks the leftmost merges first: one inside a goes before, one inside b after
            if k is not None and self.scores[k] > until_x and self.scores[k] >= until_y:
                return False
            if i == len(right) - 1 and j == len(left) - 1:
                return True
            if until_x >= until_y:
                i += 1
            else:
                j += 1

    def _only_path(self, part: str) -> list[int] | None:
        """Of a BPE model: the first piece that can stand at a position is the only one; None if a character has no piece."""
        n = len(part)
        last_piece, begins = [-1] * (n + 1), [0] * (n + 1)
        fits, known = self.fits, self.fits.get
        for last, (size, i) in self.automaton.iter(part):
            end = last + 1
            if last_piece[end] >= 0:
                continue
            start = last + 1 - size
            if start:
                left = last_piece[start]
                if left < 0:
                    return None
                ok = known(left << 20 | i)
                if ok is None:
                    if len(fits) >= _CACHE_PAIRS:
                        fits.clear()
                    ok = fits[left << 20 | i] = self._stands(self.pieces[left], self.pieces[i])
                if not ok:
                    continue
            last_piece[end], begins[end] = i, start
        ids, end = [], n
        while end:
            if last_piece[end] < 0:
                return None
            ids.append(last_piece[end])
            end = begins[end]
        ids.reverse()
        return ids

    def _viterbi(self, part: str) -> list[int]:
        if self.merges and (ids := self._only_path(part)) is not None:
            return ids
        n = len(part)
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # start and piece of the best last step; -1: no piece
        scores, fits, merges = self.scores, self.fits, self.merges
        steps = self.automaton.iter(part)  # all pieces that end at a position, by the output links
        bare = [k for k, c in enumerate(part) if c not in self.usable]
        if bare:  # characters without a piece of their own take a step at a price
            steps = sorted([*((last, found) for last, found in steps), *((k, (1, -1)) for k in bare)], key=lambda x: x[0])
        for last, (size, i) in steps:
            end = last + 1
            start = end - size
            if best[start] is None:
                continue
            if merges and i >= 0 and start and (left := back[start][1]) >= 0:
                ok = fits.get(left << 20 | i)
                if ok is None:
                    if len(fits) >= _CACHE_PAIRS:
                        fits.clear()
                    ok = fits[left << 20 | i] = self._stands(self.pieces[left], self.pieces[i])
                if not ok:
                    continue
            score = best[start] + (scores[i] if i >= 0 else self.floor)
            if best[end] is None or score > best[end]:
                best[end], back[end] = score, (start, i)
        if best[n] is None:
            raise ValueError("no path: the model lacks a character that its pieces hold")
        path, end = [], n
        while end:
            start, i = back[end]
            path.append((start, end, i))
            end = start
        ids: list[int] = []
        for start, end, i in reversed(path):
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in part[start:end].encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def stretches(self, text: str) -> list[str]:
        return self.parts.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        known = self.known
        return np.frombuffer(b"".join([known[p] for p in self.stretches(text)]), np.int32).tolist()

    def decode_packed(self, packed: bytes) -> str:
        return self.decode(np.frombuffer(packed, np.int32).tolist())

    def decode(self, ids: list[int]) -> str:
        if not self.spelled:
            for p, t in zip(self.pieces, self.types, strict=True):
                self.spelled.append(bytes([int(p[3:5], 16)]) if t == _BYTE else b" \xe2\x81\x87 " if t == _UNKNOWN else b"" if t == _CONTROL else p.replace(SPACE, " ").encode())
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_codecs: dict[str, Codec] = kept("sentencepiece")


def codec(path: str = MODEL) -> Codec:
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(f.read())
    return _codecs[path]


def _encode_batches(path: str):
    def run(batches):
        import pyarrow as pa

        from .common import by_bytes

        c = codec(path)
        known = c.known
        for batch in batches:
            for lo, hi in by_bytes(batch.column(1), 1 << 20):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                packed = [b"".join([known[p] for p in c.stretches(t)]) for t in texts]
                sizes = np.array([len(b) // 4 for b in packed], np.int64)
                values = np.frombuffer(b"".join(packed), np.int32)
                back = [c.decode_packed(b) == t for b, t in zip(packed, texts, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes), ids, pa.array(back)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return run


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` for each row of ``docs(doc_id, text)``.

    ``ids`` are the pieces of the whole text, ``round_trip`` says whether decoding gives it back. A text
    that holds the space mark itself (U+2581) decodes to spaces, so its round trip is false, as with the
    format's own library. Null and empty texts have no pieces. Repeated rows give equal rows; a null
    doc_id is kept; an empty table gives an empty one; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(_encode_batches(path), "sentencepiece"), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; null ids give a null text."""
    import pandas as pd

    @F.pandas_udf("string")
    def back(column):
        c = codec(path)
        return pd.Series([None if x is None else c.decode(list(x)) for x in column], dtype=object)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), back(F.col("ids").cast("array<int>")).alias("text"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of every document, a row for each row that came."""
    return encode(docs)
