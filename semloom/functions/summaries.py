"""Summaries as bullets, and their citations in one form."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_IN_RANGE = 100
# How bullets and citations are written, on which scores depend.
_MARK = r"[-•*–]\s|\d{1,2}[.)]\s+[A-Z\"“]"
_INLINE = re.compile(rf"(?<=[.\]])\s+(?={_MARK})")
_LABEL = re.compile(r"(?i)\b(?:articles?|conversations?|documents?|docs?|idx|ids?)\b\s*[:=#]?|#")
_SPAN = r"\d+(?:\s*[-–]\s*\d+)?"
_BODY = re.compile(rf"{_SPAN}(?:\s*[,;\s]\s*{_SPAN})*")


def cell_texts(cell: str | None) -> list[str]:
    """The texts of one output cell: items of a JSON or Python list, or the cell with its line breaks put back."""
    text = (cell or "").strip()
    if text[:1] == "[" and text[-1:] == "]":
        for read in (json.loads, ast.literal_eval):
            try:
                items = read(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
            if isinstance(items, list) and all(isinstance(x, str) for x in items):
                return items
    text = cell or ""
    if "\n" not in text:
        text = text.replace("\\n", "\n") if "\\n" in text else _INLINE.sub("\n", text)
    return [text]


def bullets_of(cell: str | None) -> list[str]:
    return [line for text in cell_texts(cell) for x in text.split("\n") if (line := x.strip())]


def rewrite_citations(bullet: str) -> tuple[str, int]:
    """A bullet with labels, ranges and other separators of its citations turned into ``[a, b]``, and how many were; other brackets stay."""
    changed = 0

    def fixed(m: re.Match) -> str:
        nonlocal changed
        inside = m[1]
        plain = re.fullmatch(r"\d+(?:\s*,\s*\d+)*,?\s*", inside.strip())
        body = _LABEL.sub(" ", inside).strip()
        if plain or not _BODY.fullmatch(body):
            return m[0]
        changed += 1
        numbers: list[int] = []
        for span in re.findall(_SPAN, body):
            first, last = (int(x) for x in (re.split(r"\s*[-–]\s*", span) * 2)[:2])
            numbers += range(first, last + 1) if 0 <= last - first <= MOST_IN_RANGE else (first, last)
        return f"[{', '.join(map(str, numbers))}]"

    return re.sub(r"\[([^\[\]]{1,200})\]", fixed, bullet), changed


@F.pandas_udf(T.ArrayType(T.StringType()))
def summary_bullets(cell: pd.Series) -> pd.Series:
    """The bullets of a summary cell, a line each, in order."""
    return cell.map(bullets_of)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("rewritten", T.IntegerType())]))
def rewritten_citations(bullet: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, 0) if b is None else rewrite_citations(b) for b in bullet], columns=["text", "rewritten"])


def cited_documents(bullet: Column) -> Column:
    """The numbers a bullet cites in ``[a, b]`` form, each once."""
    groups = F.regexp_extract_all(bullet, F.lit(r"\[([\d, ]+)\]"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1)))), lambda x: x.cast("long")))


def with_example(text: str, insight: str, anchor: str = "\nCareful:\n") -> str:
    """A prompt with one gold insight quoted before its list of cautions; a prompt without exactly one such place is refused."""
    if text.count(anchor) != 1:
        raise ValueError(f"the prompt needs {anchor.strip()!r} on a line of its own once, not {text.count(anchor)} times")
    said = insight.rstrip()
    said += "" if said[-1:] in (".", "!", "?") else "."
    before, after = text.split(anchor)
    return f'{before}\nAn insight to be included is "{said}" Return it and all others on the topic; they are about other aspects of it.{anchor}{after}'
