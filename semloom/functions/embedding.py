"""A local text embedding: a bag of words hashed into buckets, so that retrieval by vectors runs without a network."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, tokens

BUCKETS = 64


def bucket(word: Column) -> Column:
    """The first byte of a word's md5, modulo the number of buckets."""
    return F.conv(F.substring(F.md5(word), 1, 2), 16, 10).cast("int") % BUCKETS


def hashed_embedding(text: Column) -> Column:
    """Word counts per bucket, as array<double>."""
    # sorted, with each bucket once more: a bucket's words then lie between its first place and that of the next
    at = F.sort_array(F.concat(F.transform(tokens(text), bucket), F.sequence(F.lit(0), F.lit(BUCKETS))))
    return bound(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: (F.array_position(a, b + 1) - F.array_position(a, b) - 1).cast("double")))


def query_embedding(query: str) -> list[float]:
    import hashlib
    import re

    out = [0.0] * BUCKETS
    for w in re.findall("[a-z0-9]+", query.lower()):
        out[int(hashlib.md5(w.encode()).hexdigest()[:2], 16) % BUCKETS] += 1.0
    return out


def hashed_cosine(text: Column, query: str) -> Column:
    from .text import cosine

    return cosine(hashed_embedding(text), F.array(*[F.lit(x) for x in query_embedding(query)]))
