"""Operators that ask a model, over a provider's answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact
from .provider import Provider, Task
from .retrieval import retrieve

_ANSWER, _SKIP = "__answer", "__skip"


def _asked(df: DataFrame, provider: Provider, task: Task, skip_if: Any, watch: Watch) -> tuple[DataFrame, Column]:
    """Rows with answers, and which of them were skipped. Every row is read once; a skipped one is never put to the model."""
    if skip_if is None:
        return watch(provider.answer(df, task, _ANSWER), F.lit(False)), F.lit(False)
    marked = df.withColumn(_SKIP, exact.tested(df, skip_if))
    marked = marked.filter(F.col(f"{_SKIP}.error").isNull())  # a skip rule that raises drops its row
    skipped = F.col(f"{_SKIP}.ok")
    return watch(provider.answer(marked, task, _ANSWER, ~skipped), skipped), skipped


Watch = Callable[[DataFrame, Column], DataFrame]


def unwatched(df: DataFrame, skipped: Column) -> DataFrame:
    return df


def sem_filter(df: DataFrame, provider: Provider, task: Task, skip_if: Any = None, watch: Watch = unwatched) -> DataFrame:
    asked, skipped = _asked(df, provider, task, skip_if, watch)
    passed = F.col(f"{_ANSWER}.value.passed")  # bare, as a filter drops nulls too: so the keys in a verdict by rules become those of a join below
    return asked.filter(passed if skip_if is None else skipped | passed).drop(_ANSWER, _SKIP)


def sem_map(df: DataFrame, provider: Provider, task: Task, skip_if: Any = None, watch: Watch = unwatched) -> DataFrame:
    asked, _ = _asked(df, provider, task, skip_if, watch)
    return asked.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{_ANSWER}.value.`{n}`").alias(n) for n, _, _ in task.outputs])


#: Pairs that a sem_join without a blocking condition asks about at most, unless told otherwise.
MOST_PAIRS = 1_000_000


def sem_join(left: DataFrame, right: DataFrame, provider: Provider, task: Task, blocking: Column | str | None = None, most_pairs: int | None = MOST_PAIRS, watch: Watch = unwatched) -> DataFrame:
    """A verdict on every pair that ``blocking`` leaves. ``most_pairs`` refuses a larger product before any call; None allows all."""
    if blocking is None and most_pairs is not None and (pairs := left.count() * right.count()) > most_pairs:
        raise ValueError(f"sem_join would ask about {pairs} pairs; give a blocking condition or allow more")
    pairs = exact.join_rows(left, right, F.lit(True) if blocking is None else blocking)
    return sem_filter(pairs, provider, task, watch=watch)


#: Rows that a sem_agg without keys takes into its one prompt at most.
MOST_ITEMS = 1_000_000


def group_key(df: DataFrame, key: str) -> Column:
    """Lists compare as sorted."""
    return F.array_sort(F.col(key)) if dict(df.dtypes)[key].startswith("array") else F.col(key)


def sem_agg(df: DataFrame, provider: Provider, task: Task, group_by: Sequence[str] = (), one_to_many: bool = False, keep_inputs: bool = False, watch: Watch = unwatched) -> DataFrame:
    """One call a group over the sorted list of its inputs, each a struct of what the task depends on.

    ``one_to_many`` spreads list answers over rows, the shorter ones padded with nulls, one row at least;
    ``keep_inputs`` puts the answer beside every row of its group.
    """
    if not group_by and (n := df.count()) > MOST_ITEMS:
        raise ValueError(f"sem_agg would put {n} rows into one prompt; group them, and the groups' answers after that")
    inputs = list(task.depends_on) or [c for c in df.columns if c not in group_by]
    keys = {f"__k{i}": group_key(df, k) for i, k in enumerate(group_by)}
    keyed = df.withColumns(keys) if keys else df
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in inputs])))
    aggs = [rows.alias("items"), *[F.min(F.col(f"`{k}`")).alias(k) for k in group_by]]
    grouped = keyed.groupBy(*keys).agg(*aggs) if keys else keyed.agg(*aggs).filter("size(items) > 0")
    items_task = Task(task.kind, task.instruction, task.outputs, ("items",), task.model)
    asked = watch(provider.answer(grouped, items_task, _ANSWER), F.lit(False)).filter(f"{_ANSWER}.error is null")
    names = [n for n, _, _ in task.outputs]
    if one_to_many:
        lists = [F.col(f"{_ANSWER}.value.`{n}`") for n in names]
        kinds = [t.startswith("list") for _, t, _ in task.outputs]
        named = asked.withColumns({f"__o{i}": x if is_list else F.array(x) for i, (x, is_list) in enumerate(zip(lists, kinds, strict=True))})
        spread = named.withColumn("__z", F.explode_outer(F.arrays_zip(*[f"__o{i}" for i in range(len(names))])))
        out = spread.select(*keys, *group_by, *[F.col(f"__z.__o{i}").alias(n) for i, n in enumerate(names)])
    else:
        out = asked.select(*keys, *group_by, *[F.col(f"{_ANSWER}.value.`{n}`").alias(n) for n in names])
    if not keep_inputs:
        return out.select(*group_by, *names)
    side = out.select(*[F.col(k).alias(f"{k}_g") for k in keys], *names)
    if not keys:
        return df.crossJoin(side)
    same = None
    for k in keys:
        each = keyed[k].eqNullSafe(side[f"{k}_g"])
        same = each if same is None else same & each
    return keyed.join(side, same).select(*[F.col(f"`{c}`") for c in df.columns], *names)


def _retrieved(df: DataFrame, a: dict, score: Callable[[Column], Column] | None) -> DataFrame:
    """The model's view of the rows: eligible texts cut down to their best chunks, beside the whole rows."""
    kinds = dict(df.dtypes)
    whole = df.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    texts = [c for c in a["depends_on"] if kinds[c] in ("string", "array<string>")]
    return retrieve(whole, texts, a["query"], a["chunk_size"], a["top"], a["threshold"], score, a.get("capture"))


def _scorer(a: dict) -> Callable[[Column], Column] | None:
    if a["method"] == "bm25":
        return None
    from ..functions.embedding import hashed_cosine

    return lambda piece: hashed_cosine(piece, a["query"])


def rag_filter(df: DataFrame, provider: Provider, task: Task, a: dict, watch: Watch = unwatched) -> DataFrame:
    view = _retrieved(df, a, _scorer(a))
    return sem_filter(view, provider, task, a.get("skip_if"), watch).select("__row.*", *filter(None, [a.get("capture")]))


def rag_map(df: DataFrame, provider: Provider, task: Task, a: dict, watch: Watch = unwatched) -> DataFrame:
    names = [n for n, _, _ in task.outputs]
    return sem_map(_retrieved(df, a, _scorer(a)), provider, task, a.get("skip_if"), watch).select("__row.*", *names, *filter(None, [a.get("capture")]))
