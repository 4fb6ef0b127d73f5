"""Answers about contracts as typed values: renewals, notice periods, governing law, parties, term lengths."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durations import _NUMBERS

#: What stands for a blacked-out value, and for a place that is none.
REDACTED, NON_PLACE = "redacted", "not a place"
_UNITS = "day|week|month|year"
_DATE = r"^[0-9?]{1,2}/[0-9?]{1,2}/[0-9?]{2,4}$"


def _normal(text: Column) -> Column:
    low = F.regexp_replace(F.lower(text), r"\b[a-z]+ \((\d+)\)", "$1")
    low = F.regexp_replace(F.regexp_replace(low, "[()]", ""), r"\bsuc+e?s+i[vn]e\b", "successive")
    for value, word in enumerate(_NUMBERS, 1):
        low = F.regexp_replace(low, rf"\b{word}\b", str(value))
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def listed(raw: Column) -> Column:
    """The items of an answer: parted by ``;`` or ``,``, and by ``/`` where they are no dates."""
    items = F.transform(F.split(F.coalesce(raw, F.lit("")), "[;,]"), lambda x: F.trim(x))
    parts = F.flatten(F.transform(items, lambda x: F.when(F.rlike(x, F.lit(_DATE)), F.array(x)).otherwise(F.transform(F.split(x, "/"), lambda y: F.trim(y)))))
    return F.filter(parts, lambda x: x != "")


def _duration(text: Column) -> tuple[Column, Column]:
    pattern = rf"(\d+(?:\.\d+)?)[ -]?({_UNITS})s?\b"
    return F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2)


def parse_renewals(raw: Column) -> Column:
    """``successive 1 year; 2 6-month; perpetual`` as structs (renewals, length, unit, note).

    ``renewals`` is a number, or ``unlimited`` for successive terms; a word without a length, a redaction or a
    date goes to ``note``.
    """

    def one(item: Column) -> Column:
        text = _normal(item)
        length, unit = _duration(text)
        count = F.regexp_extract(text, rf"^(\d+)\s+(?:successive\s+)?(?:additional\s+)?(?:terms? of |periods? of )?\d+(?:\.\d+)?[ -]?(?:{_UNITS})", 1)
        renewals = F.when(count != "", count).when(F.contains(text, F.lit("successive")), "unlimited").otherwise("1")
        blank = F.rlike(text, F.lit(r"^[\[\]* ]*$"))
        return F.struct(F.when(length.isNotNull(), renewals).alias("renewals"), length.alias("length"), F.when(length.isNotNull(), F.concat(unit, F.lit("s"))).alias("unit"), F.when(length.isNull(), F.when(blank, F.lit(REDACTED)).otherwise(text)).alias("note"))

    return F.transform(listed(raw), one)


def parse_notice(raw: Column) -> Column:
    """Notice periods as structs (length, unit, note)."""

    def one(item: Column) -> Column:
        text = _normal(item)
        length, unit = _duration(text)
        blank = F.rlike(text, F.lit(r"^[\[\]* ]*$"))
        return F.struct(length.alias("length"), F.when(length.isNotNull(), F.concat(unit, F.lit("s"))).alias("unit"), F.when(length.isNull(), F.when(blank, F.lit(REDACTED)).otherwise(text)).alias("note"))

    return F.transform(listed(raw), one)


def parse_governing_law(raw: Column, states: Sequence[str], countries: Sequence[str], other: Sequence[str] = ()) -> Column:
    """The most specific places an answer names, each once, in order; what is no known place becomes NON_PLACE.

    A country after a place within it is left out (``Ontario, Canada``); after a state it stands. Place names are parameters.
    """
    known = lambda x, names: x.isin(list(names)) if names else F.lit(False)

    def one(item: Column) -> Column:
        bare = lambda x: F.trim(F.regexp_replace(F.trim(x), r"(?i)^(?:the\s+)?(?:(?:federal\s+)?republic|people's republic|state|commonwealth|province|kingdom|laws?)\s+of\s+(?:the\s+)?", ""))
        pieces = F.filter(F.transform(F.split(item, r",|\band\b"), bare), lambda x: x != "")
        last = F.try_element_at(pieces, F.lit(-1))
        inner = (F.size(pieces) > 1) & known(last, countries) & ~F.forall(pieces, lambda x: known(x, states))
        kept = F.when(inner, F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(pieces)
        places = F.transform(kept, lambda x: F.when(known(x, [*states, *countries, *other]), x).otherwise(F.lit(NON_PLACE)))
        return F.when(F.rlike(item, F.lit(r"^[\[\]* ]*$")), F.array(F.lit(REDACTED))).otherwise(places)

    items = F.filter(F.split(F.coalesce(raw, F.lit("")), ";"), lambda x: F.length(x) > 0)
    return F.array_distinct(F.flatten(F.transform(items, one)))


def repaired(word: str, known: Sequence[str], least: float = 0.8) -> str:
    """A word as a text spells it, if the text has one that is nearly the same."""
    import difflib

    if word in known or len(word) < 4:
        return word
    near = difflib.get_close_matches(word, known, 1, least)
    return near[0] if near else word


def _parties(raw: str | None, spans: Sequence[str] | None) -> dict:
    words = sorted({w.strip(",.;:()\"“”'") for s in spans or () for w in s.split()} - {""})
    names: list[str] = []
    for entry in (raw or "").split(";"):
        aliases = re.findall(r"[\"“]([^\"“”]+)[\"”]", entry)
        bare = re.sub(r"\([^()]*[\"“”][^()]*\)|[\"“][^\"“”]+[\"”]", " ", entry)
        bare = " ".join(bare.split()).strip(" ,;")
        generic = [bool(re.fullmatch(r"(the |a )?part(y|ies)", a.strip(" ,.").lower())) for a in aliases]
        if not set(bare.lower().split()) - {"and", "or", "together", "with", "the"} or aliases and all(generic):
            continue  # an entry for all parties together
        names.append(" ".join(repaired(w, words) for w in bare.split()))
    names = list(dict.fromkeys(names))
    return {"number_parties": len(names), "parties": names}


@F.pandas_udf(T.StructType([T.StructField("number_parties", T.IntegerType()), T.StructField("parties", T.ArrayType(T.StringType()))]))
def parse_parties(raw: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """The parties an answer lists, without aliases and collective entries, words spelled as in the contract's own spans."""
    return pd.DataFrame([_parties(r, s) for r, s in zip(raw, spans, strict=True)], columns=["number_parties", "parties"])


def latest_year(dates: Column) -> Column:
    """The latest year of structs (month, day, year) that leave none of its digits blank."""
    return F.array_max(F.transform(F.filter(dates, lambda d: ~F.contains(d["year"], F.lit("?"))), lambda d: d["year"].try_cast("int")))


def term_between(start: Column, end: Column) -> Column:
    """Whole months from one date to another as struct(length, unit), years where they divide; null where digits are missing or the order is wrong."""
    whole = ~(F.contains(F.concat(start["month"], start["year"], end["month"], end["year"]), F.lit("?")))
    number = lambda d, part: d[part].try_cast("int")
    months = (number(end, "year") - number(start, "year")) * 12 + number(end, "month") - number(start, "month")
    years = months % 12 == 0
    made = F.struct(F.when(years, (months / 12).cast("int")).otherwise(months).alias("length"), F.when(years, "years").otherwise("months").alias("unit"))
    return F.when(whole & (months > 0) & (months <= 600), made)


_NUMBER = rf"(?:\(?(\d+)\)?|({'|'.join(_NUMBERS)}))(?:\s*\((\d+)\))?"
_TERM = rf"(?i)\b(?:term|period|continue|effective|expire)\b[^.]{{0,70}}?\b{_NUMBER}\s*-?\s*(?:calendar|consecutive|full|successive|contract|additional|initial)?\s*({_UNITS})s?\b"
_NOTICE = rf"(?i){_NUMBER}\s*-?\s*(?:calendar|consecutive|full)?\s*({_UNITS})s?[^.]{{0,25}}(?:prior|before|notice|advance)"


def term_in_spans(spans: Column) -> Column:
    """The first term length that a contract's sentences state as struct(length, unit), lengths of notice periods passed over."""
    text = F.regexp_replace(F.array_join(spans, " "), r"\s+", " ")
    numbers = {word: str(k) for k, word in enumerate(_NUMBERS, 1)}
    word_value = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])

    def found(pattern: str) -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2, 3, 4)]
        value = lambda z: F.coalesce(F.nullif(z["2"], F.lit("")), F.nullif(z["0"], F.lit("")), word_value[F.lower(z["1"])])
        return F.transform(F.arrays_zip(*[p.alias(str(i)) for i, p in enumerate(parts)]), lambda z: F.struct(value(z).cast("int").alias("length"), F.concat(F.lower(z["3"]), F.lit("s")).alias("unit")))

    notices = found(_NOTICE)
    return F.try_element_at(F.filter(found(_TERM), lambda x: x["length"].isNotNull() & ~F.array_contains(notices, x)), F.lit(1))
