"""Text functions as Column expressions; they stay in the JVM and in whole-stage code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORDS = "([a-z0-9]+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: Catalyst repeats an expression wherever it stands, in a lambda for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of a-z and 0-9, in order; null gives null."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(_WORDS), F.lit(1))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def normalize_phrase(text: Column | str) -> Column:
    return F.array_join(tokens(text), " ")


def row_text(*columns: Column | str) -> Column:
    """Cells joined by a space in column order, nulls left out."""
    return F.concat_ws(" ", *[_c(c).cast("string") for c in columns])


def padded_text(*columns: Column | str) -> Column:
    return F.concat(F.lit(" "), normalize_phrase(row_text(*columns)), F.lit(" "))


def phrases_found(padded: Column | str, phrases: Sequence[str]) -> Column:
    """Which phrases stand in a padded text as whole words, each at most once, in the given order."""
    import re

    needles = [(p, " ".join(re.findall("[a-z0-9]+", p.lower()))) for p in phrases]
    hits = [F.when(F.contains(_c(padded), F.lit(f" {n} ")), F.lit(p)) for p, n in needles if n]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Jaccard similarity of two token sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def span_jaccard(gold: Column, quote: Column | str) -> Column:
    """Similarity of a quote with all gold spans taken together."""
    return jaccard(token_set(F.array_join(gold, " ")), token_set(quote))


def best_span_jaccard(gold: Column, quote: Column | str) -> Column:
    """Similarity of a quote with the closest gold span; 0 without any."""
    q = token_set(quote)
    return F.coalesce(F.array_max(F.transform(gold, lambda s: jaccard(token_set(s), q))), F.lit(0.0))


def quote_score(gold: Column, quote: Column | str, share: float = 0.9, least_words: int = 5, most_words: int = 60) -> Column:
    """1 if a quote of at most ``most_words`` words holds ``share`` of the words of a gold span of ``least_words`` or more, else its best similarity."""
    quote = _c(quote)
    q = token_set(quote)
    short = (F.size(q) > 0) & (F.size(F.filter(F.split(quote, r"\s+"), lambda w: w != "")) <= most_words)

    def holds(span: Column) -> Column:
        g = token_set(span)
        return (F.size(g) >= least_words) & (F.size(F.array_intersect(q, g)) / F.size(g) >= share)

    return F.when(short & F.exists(gold, holds), F.lit(1.0)).otherwise(best_span_jaccard(gold, quote))


def number_items(items: Column | str) -> Column:
    """``1. a`` and so on, a line per item."""
    return F.array_join(F.transform(_c(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x.cast("string"))), "\n")


def normalize_id(value: Column | str) -> Column:
    """Ids as strings, whole numbers without a fraction."""
    value = _c(value)
    number = value.cast("string").try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15) & F.rlike(value.cast("string"), F.lit(r"^[+-]?[0-9]+\.0*$|^[+-]?[0-9.]+[eE][+-]?[0-9]+$"))
    return F.when(whole, number.cast("long").cast("string")).otherwise(value.cast("string"))


def column_fingerprint(names: Sequence[str]) -> str:
    import hashlib

    return hashlib.sha256("\x1f".join(names).encode()).hexdigest()[:12]


def truncate_middle(text: Column | str, allowance: int) -> Column:
    """Two thirds of the allowance from the head and one from the tail, with a mark of what is left out."""
    text = _c(text)
    if allowance <= 0:
        return text
    mark = 40
    if allowance <= mark:
        return F.when(F.length(text) <= allowance, text).otherwise(F.substring(text, 1, allowance))
    head = (allowance - mark) * 2 // 3
    tail = allowance - mark - head
    left_out = F.format_number(F.length(text) - head - tail, 0)
    cut = F.concat(F.substring(text, 1, head), F.lit(" …["), left_out, F.lit(" chars omitted]… "), F.right(text, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(text) <= allowance, text).otherwise(cut)


def truncate_content(text: str, most: int) -> str:
    """Half from the head and half from the tail of a long output, with a mark between."""
    if len(text) <= most:
        return text
    half = most // 2
    return f"{text[:half]}\n... {len(text) - 2 * half} characters left out ...\n{text[len(text) - half :]}"


def text_columns(df: DataFrame, id_col: str) -> list[str]:
    """Columns that are no numbers, booleans or the id."""
    return [f.name for f in df.schema.fields if f.name != id_col and not isinstance(f.dataType, T.NumericType | T.BooleanType)]


def keys_by_items(df: DataFrame, key: str, items: str) -> DataFrame:
    """``item`` -> sorted distinct keys of the rows that list it: an inverted index, not a map in one row."""
    pairs = df.select(F.col(key).alias("key"), F.explode(items).alias("item"))
    return pairs.groupBy("item").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def chunks(text: Column | str, size: Column | int) -> Column:
    """Contiguous pieces of ``size`` code points; the last one may be shorter; an empty text has one empty piece."""
    text, size = _c(text), F.lit(size) if isinstance(size, int) else size
    count = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.when(text.isNotNull(), F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(text, i * size + 1, size)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors in doubles; 0 for a missing, zero or non-finite one."""
    x, y = _c(a).cast("array<double>"), _c(b).cast("array<double>")

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    value = bound(x, lambda u: bound(y, lambda v: F.try_divide(dot(u, v), F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)))))
    return bound(value, lambda s: F.when(F.isnan(s) | (F.abs(s) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(s, F.lit(0.0))))


def normalize_citations(text: Column | str) -> Column:
    """Sorted distinct numbers cited in brackets, ranges of at most 100 spelled out: ``[Article 3-5; 8]`` cites 3, 4, 5 and 8."""
    groups = F.regexp_extract_all(_c(text), F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    ranges = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(\d+(?:\s*-\s*\d+)?)"), F.lit(1))))

    def spelled(r: Column) -> Column:
        parts = F.transform(F.split(r, r"\s*-\s*"), lambda p: p.cast("long"))
        a, b = F.element_at(parts, 1), F.element_at(parts, -1)
        return F.when((b >= a) & (b - a <= 100), F.sequence(a, F.greatest(a, F.least(b, a + 100)))).otherwise(F.array(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, spelled))))


def insight_bullets(text: Column | str, least_words: int = 5) -> Column:
    """Lines that say something besides citations, without their bullet marks."""
    lines = F.transform(F.split(_c(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s+", "")))
    return F.filter(lines, lambda x: F.regexp_count(F.regexp_replace(x, r"\[[^\[\]]*\]", ""), F.lit(r"[A-Za-z0-9]+")) >= least_words)
