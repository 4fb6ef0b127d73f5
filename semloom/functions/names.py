"""Keys under which names, categories and contracts compare equal, as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal forms and corporate words that end a name, written as they stand once punctuation is gone.
LEGAL_FORMS = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "companies", "ltd", "limited", "plc", "llc", "llp", "lp", "l p", "sa", "s a", "spa", "s p a",
    "sarl", "sas", "ag", "se", "nv", "n v", "bv", "b v", "ab", "ab publ", "publ", "as", "a s", "asa", "oyj", "oy", "kgaa", "se co kgaa", "gmbh", "holdings", "holding",
    "group", "groupe", "gruppo", "berhad", "bhd", "pjsc", "jsc", "tbk", "pt", "pte", "pty", "pty ltd", "public company limited", "co ltd", "kk", "k k", "srl", "s r l",
    "sab de cv", "de cv", "nl", "the", "and co", "and company",
)
_FORMS = "|".join(sorted(map(re.escape, LEGAL_FORMS), key=len, reverse=True)).replace(r"\ ", " ")


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Character references decoded, compatibility forms taken apart, and all beyond ASCII dropped: the one step the JVM has no function for."""
    import html
    import unicodedata

    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", html.unescape(x)).encode("ascii", "ignore").decode())


def folded_name(folded: Column) -> Column:
    """A name in ASCII as lower-case words without a leading article and without its legal form."""
    low = F.replace(F.regexp_replace(F.lower(folded), "['’]", ""), F.lit("&"), F.lit(" and "))
    words = F.regexp_replace(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), r"^(the|pt)\s+", "")
    bare = F.trim(F.regexp_replace(words, rf"(\s+({_FORMS}))+$", ""))
    return F.when(bare != "", bare).otherwise(words)


def normalize_name(name: Column) -> Column:
    return folded_name(ascii_fold(F.coalesce(name.cast("string"), F.lit(""))))


def name_matches(name: Column, aliases: Column) -> Column:
    """Whether a name, or a part of it in or beside parentheses, equals an accepted one once both are normalized."""
    text = ascii_fold(F.coalesce(name.cast("string"), F.lit("")))
    accepted = F.split(ascii_fold(F.coalesce(F.array_join(aliases, "\x1f"), F.lit(""))), "\x1f")
    parts = F.filter(F.transform(F.concat(F.array(text), F.split(text, "[()]")), folded_name), lambda x: x != "")
    return F.coalesce(F.arrays_overlap(parts, F.filter(F.transform(accepted, folded_name), lambda x: x != "")), F.lit(False))


def category_key(name: Column) -> Column:
    """``Unlimited/All-You-Can-Eat License`` as ``unlimited_all_you_can_eat_license``."""
    return F.regexp_replace(F.lower(F.trim(name)), "[ /-]", "_")


def contract_key(name: Column) -> Column:
    """Letters and digits of a file name without its ending, in upper case."""
    return F.regexp_replace(F.upper(F.regexp_replace(F.trim(name), r"(?i)\.(pdf|txt)'?\s*$", "")), "[^A-Z0-9]", "")


def clean_text(value: Column) -> Column:
    """Letters, digits and white space; null gives an empty string."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[^a-zA-Z0-9\s]", ""))


def composite_id(**parts: Column) -> Column:
    """Several values as one id: compact JSON with the keys in the given order."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def pair_id(a: Column, b: Column) -> Column:
    return F.concat_ws("-", a.cast("string"), b.cast("string"))
