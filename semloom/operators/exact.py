"""Exact operators: expressions first, callables on rows where an expression cannot say it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .provider import KINDS


def condition(predicate: Column | str) -> Column:
    return F.expr(predicate) if isinstance(predicate, str) else predicate


def reads(call: Callable, columns: Sequence[str]) -> list[str]:
    """The columns a callable can read: those whose names its code spells, or all if it takes the row as a whole.

    A callable that hands its row on, loops over it or makes up names may read any.
    """
    code = getattr(call, "__code__", None)
    if code is None or code.co_freevars or code.co_argcount != 1:
        return list(columns)
    import dis

    row, steps = code.co_varnames[0], [i for i in dis.get_instructions(code) if i.opname not in ("CACHE", "RESUME", "NOT_TAKEN", "COPY_FREE_VARS")]
    names = []
    for this, following, then in zip(steps, [*steps[1:], None], [*steps[2:], None, None]):
        if row not in (this.argval if isinstance(this.argval, tuple) else (this.argval,)) or not this.opname.startswith("LOAD_FAST"):
            if any(getattr(c, "co_code", None) for c in (this.argval,)):
                return list(columns)  # an inner function may read the row
            continue
        spelled = this.opname in ("LOAD_FAST", "LOAD_FAST_BORROW") and following and following.opname == "LOAD_CONST" and then and (then.opname == "BINARY_SUBSCR" or then.opname == "BINARY_OP" and then.argrepr == "[]")
        if not spelled or following.argval not in columns:
            return list(columns)
        names.append(following.argval)
    return list(dict.fromkeys(names)) or list(columns)


def tested(df: DataFrame, predicate: Column | str | Callable[[dict], Any]) -> Column:
    """A predicate as struct(ok, error): SQL nulls are false; a callable runs on the columns it names in Arrow batches."""
    if not callable(predicate) or isinstance(predicate, Column):
        return F.struct(F.coalesce(condition(predicate), F.lit(False)).alias("ok"), F.lit(None).cast("string").alias("error"))
    names = reads(predicate, df.columns)

    def run(*values):
        try:
            return bool(predicate(dict(zip(names, values, strict=True)))), None
        except Exception as e:  # noqa: BLE001  the row is dropped and its error kept
            return False, f"{type(e).__name__}: {e}"[:300]

    return F.udf(run, "struct<ok: boolean, error: string>", useArrow=True)(*[F.col(f"`{c}`") for c in names])


Watch = Callable[[DataFrame, Column, Column], DataFrame]


def filter_rows(df: DataFrame, predicate: Column | str | Callable[[dict], Any], watch: Watch | None = None) -> DataFrame:
    """Rows for which a predicate holds; ``watch`` sees all rows, which of them pass and their errors."""
    if callable(predicate) and not isinstance(predicate, Column):
        name = _free(df, "__t")
        marked = df.withColumn(name, tested(df, predicate))
        if watch:
            marked = watch(marked, F.col(f"{name}.ok"), F.col(f"{name}.error"))
        return marked.filter(F.col(f"{name}.ok")).drop(name)
    if watch:
        df = watch(df, F.coalesce(condition(predicate), F.lit(False)), F.lit(None).cast("string"))
    return df.filter(condition(predicate))


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def map_rows(df: DataFrame, columns: dict[str, Column | str] | Callable[[dict], dict], cols: Sequence[dict[str, str]] = (), watch: Watch | None = None) -> DataFrame:
    if isinstance(columns, dict):
        if watch:
            df = watch(df, F.lit(True), F.lit(None).cast("string"))
        return df.withColumns({n: condition(e) for n, e in columns.items()})
    names, made = reads(columns, df.columns), [(c["name"], KINDS[c.get("type", "str")]) for c in cols]

    def run(*values):
        try:
            got = columns(dict(zip(names, values, strict=True)))
            return {"error": None, "value": {n: got.get(n) for n, _ in made}}
        except Exception as e:  # noqa: BLE001  the row is dropped and its error kept
            return {"error": f"{type(e).__name__}: {e}"[:300], "value": None}

    kind = f"struct<error: string, value: struct<{', '.join(f'`{n}`: {t}' for n, t in made)}>>"
    name = _free(df, "__m")
    out = df.withColumn(name, F.udf(run, kind, useArrow=True).asNondeterministic()(*[F.col(f"`{c}`") for c in names]))
    if watch:
        out = watch(out, F.col(f"{name}.error").isNull(), F.col(f"{name}.error"))
    return out.filter(F.col(f"{name}.error").isNull()).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{name}.value.`{n}`").alias(n) for n, _ in made])


def joined_names(left: Sequence[str], right: Sequence[str]) -> dict[str, str]:
    """Names of the right side's columns in a join's output."""
    taken, out = set(left), {}
    for name in right:
        new = name
        while new in taken:
            new += "_right"
        taken.add(new)
        out[name] = new
    return out


def join_rows(left: DataFrame, right: DataFrame, on: Column | str | Callable[[dict, dict], Any]) -> DataFrame:
    renamed = joined_names(left.columns, right.columns)
    other = right.select(*[F.col(f"`{a}`").alias(b) for a, b in renamed.items()])
    if not callable(on) or isinstance(on, Column):
        return left.join(other, condition(on), "inner")
    lefts, rights = left.columns, list(renamed)

    def run(*values):
        return bool(on(dict(zip(lefts, values, strict=False)), dict(zip(rights, values[len(lefts) :], strict=True))))

    return left.crossJoin(other).filter(F.udf(run, "boolean", useArrow=True)(*[F.col(f"`{c}`") for c in [*lefts, *renamed.values()]]))


_FUNCS: dict[str, Callable[[Column], Column]] = {
    "count": lambda c: F.count(F.lit(1)),
    "sum": F.sum,
    "average": F.avg,
    "min": F.min,
    "max": F.max,
    "list": lambda c: F.array_sort(F.collect_list(c)),  # in order of value, as rows have none
    "set": lambda c: F.array_sort(F.collect_set(c)),
}


def aggregate_names(funcs: Sequence[str], fields: Sequence[str]) -> list[str]:
    if len(funcs) != len(fields):
        raise ValueError("groupby: as many functions as fields")
    if unknown := [f for f in funcs if f not in _FUNCS]:
        raise ValueError(f"groupby: unknown functions {unknown}")
    return [f"{f}({c})" for f, c in zip(funcs, fields, strict=True)]


def group_rows(df: DataFrame, fields: Sequence[str], funcs: Sequence[str], agg_fields: Sequence[str]) -> DataFrame:
    """Grouped aggregates; without keys an empty table gives no row."""
    aggs = [_FUNCS[f](F.col(f"`{c}`")).alias(n) for f, c, n in zip(funcs, agg_fields, aggregate_names(funcs, agg_fields), strict=True)]
    if fields:
        return df.groupBy(*[F.col(f"`{c}`") for c in fields]).agg(*aggs) if aggs else df.select(*fields).distinct()
    return df.agg(*aggs, F.count(F.lit(1)).alias("__n")).filter("__n > 0").drop("__n")


def row_filter(df: DataFrame, text: str | None) -> tuple[DataFrame, str | None]:
    """Rows of an SQL predicate given as text; one that does not compile is left out and reported, as is none at all."""
    if text is None or text.strip().lower() in ("", "none"):
        return df, None
    try:
        kept = df.filter(F.coalesce(F.expr(text).cast("boolean"), F.lit(False)))
        kept.schema  # noqa: B018  analysis happens here
        return kept, None
    except Exception as e:  # noqa: BLE001
        return df, f"filter ignored: {str(e).splitlines()[0]}"


def first_by_id(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """One row per id, the first by ``order``."""
    picked = df.groupBy(id_col).agg(F.min_by(F.struct("*"), order).alias("__row"))
    return picked.select("__row.*")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)
