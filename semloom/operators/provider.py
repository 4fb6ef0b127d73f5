"""The model boundary: what answers the prompts of semantic operators.

A provider turns rows into answers. ``RuleProvider`` is a stand-in for a language model: it answers with
registered Column expressions, so a plan's dataflow can be checked against SQL. ``CallProvider`` calls a
function on batches of prompts inside the executors, as an HTTP client of a live model would be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import read_answer, type_label, verdict

KINDS = {"str": "string", "int": "long", "float": "double", "bool": "boolean", "list[str]": "array<string>", "list[int]": "array<long>"}


@dataclass(frozen=True)
class Task:
    """What is asked of a model about each row (or group) of a table."""

    kind: str  # filter, map, join or agg
    instruction: str
    outputs: tuple[tuple[str, str, str], ...] = ()  # name, type, description
    depends_on: tuple[str, ...] = ()
    model: str = "rules"
    options: Mapping[str, str] = field(default_factory=dict)

    def answer_type(self) -> str:
        fields = [f"`{n}`: {KINDS[t]}" for n, t, _ in self.outputs] or ["passed: boolean"]
        return f"struct<value: struct<{', '.join(fields)}>, error: string, tokens_in: bigint, tokens_out: bigint>"


class Provider(Protocol):
    #: Whether answers cost something or may differ when asked again: then no plan step is run twice.
    costly: bool

    def answer(self, df: DataFrame, task: Task, out: str, ask: Column | None = None) -> DataFrame:
        """``df`` with a column ``out`` of ``task.answer_type()``; rows for which ``ask`` is not true get null fields unasked."""


#: Prompts of models that reason are sent with this effort unless the task or the provider says otherwise.
DEFAULT_EFFORT = "low"


def fill(text: str, placeholders: Mapping[str, object]) -> str:
    """Every placeholder in a prompt replaced by its value, longer ones first."""
    for name in sorted(placeholders, key=len, reverse=True):
        text = text.replace(name, str(placeholders[name]))
    return text


def prompt(task: Task, placeholders: Mapping[str, object] | None = None) -> Column:
    """The prompt as text: the instruction, the wanted fields and the row's inputs; placeholders are filled in the first two."""
    wanted = "".join(f"\n{n}{type_label(t)}: {d}" for n, t, d in task.outputs)
    parts = [F.lit(fill(f"{task.instruction}{wanted}", placeholders or {}))]
    parts += [F.concat(F.lit(f"\n{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in task.depends_on]
    return F.concat(*parts)


class RuleProvider:
    """Deterministic answers: an expression per condition, and per description of a wanted column.

    Rules take a function from column name to Column, so that a rule reads only what the task depends on.
    A null answer of a filter is one that could not be read.
    """

    costly = False

    def __init__(self, rules: Mapping[str, Callable[[Callable[[str], Column]], Column]]):
        self.rules = dict(rules)

    def answer(self, df: DataFrame, task: Task, out: str, ask: Column | None = None) -> DataFrame:
        def read(name: str) -> Column:
            if task.depends_on and name not in task.depends_on:
                raise ValueError(f"the rule reads {name}, which the task does not depend on")
            return F.col(name)

        if task.outputs:
            value = F.struct(*[self.rules[d](read).cast(KINDS[t]).alias(n) for n, t, d in task.outputs])
            error = F.lit(None).cast("string")
        else:
            passed = self.rules[task.instruction](read).cast("boolean")
            value, error = F.struct(passed.alias("passed")), F.when(passed.isNull(), F.lit("no verdict"))
        chars = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in task.depends_on), F.lit(len(task.instruction)))
        answered = F.struct(value.alias("value"), error.alias("error"), F.ceil(chars / 4).cast("long").alias("tokens_in"), F.lit(4 * max(1, len(task.outputs))).cast("long").alias("tokens_out"))
        return df.withColumn(out, answered if ask is None else F.when(ask, answered))


class CallProvider:
    """Answers from ``call(prompts) -> [(text, tokens_in, tokens_out)]`` on batches inside the executors.

    The stage is marked as not deterministic, so Spark never duplicates it in a plan; the plan's lowering keeps
    its result where it is read twice. A raised error becomes the row's error, not the job's. A call that
    takes ``options`` also gets the model, its reasoning effort (for models named in ``reasoning``) and, if
    the task depends on image columns, the bytes of each prompt's images.
    """

    costly = True

    def __init__(self, call: Callable[..., Sequence[tuple[str, int, int]]], batch: int = 64, placeholders: Mapping[str, object] | None = None, reasoning: Sequence[str] = (), effort: str | None = None):
        self.call, self.batch, self.placeholders, self.reasoning, self.effort = call, batch, dict(placeholders or {}), tuple(reasoning), effort

    def options(self, task: Task) -> dict[str, object]:
        """What a call is told besides its prompts."""
        held: dict[str, object] = {"model": task.model}
        if task.model in self.reasoning:
            held["effort"] = task.options.get("effort") or self.effort or DEFAULT_EFFORT
        return held

    def answer(self, df: DataFrame, task: Task, out: str, ask: Column | None = None) -> DataFrame:
        import inspect

        import pandas as pd

        size, options = self.batch, self.options(task)
        takes_options = "options" in inspect.signature(self.call).parameters
        pictures = [c for c in task.depends_on if df.schema[c].metadata.get("modality") == "image" and df.schema[c].dataType.simpleString() == "binary"]
        function = self.call

        def call(prompts: Sequence[str], images: Sequence[Sequence[bytes]]) -> Sequence[tuple[str, int, int]]:
            return function(prompts, options=options | ({"images": list(images)} if pictures else {})) if takes_options else function(prompts)

        columns = {n: t for n, t, _ in task.outputs}

        def asked(prompts: Sequence[str], images: Sequence[Sequence[bytes]]) -> list[tuple]:
            try:
                answers = list(call(prompts, images))
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            except Exception as e:  # noqa: BLE001  a failed request is a result of this row
                return [(None, f"{type(e).__name__}: {e}"[:300], 0, 0)] * len(prompts)
            rows = []
            for text, tokens_in, tokens_out in answers:
                value = read_answer(text, columns) if columns else {"passed": v} if (v := verdict(text)) is not None else None
                rows.append((value, None if value is not None else f"unreadable answer: {text!r}"[:300], tokens_in, tokens_out))
            return rows

        def run(batches: Iterator) -> Iterator[pd.DataFrame]:
            for batch in batches:  # a lone column comes by itself
                prompts, *images = batch if isinstance(batch, tuple) else (batch,)
                wanted = [i for i, p in enumerate(prompts) if p is not None]
                rows: list[tuple] = [(None, None, None, None)] * len(prompts)
                for k in range(0, len(wanted), size):
                    part = wanted[k : k + size]
                    for i, row in zip(part, asked([prompts.iloc[i] for i in part], [[c.iloc[i] for c in images if c.iloc[i] is not None] for i in part]), strict=True):
                        rows[i] = row
                empty = dict.fromkeys(columns or ["passed"])
                yield pd.DataFrame({"value": [v or empty for v, *_ in rows], "error": [e for _, e, *_ in rows], "tokens_in": [i for *_, i, _ in rows], "tokens_out": [o for *_, o in rows]})

        udf = F.pandas_udf(run, task.answer_type(), functionType=F.PandasUDFType.SCALAR_ITER).asNondeterministic()
        words = Task(task.kind, task.instruction, task.outputs, tuple(c for c in task.depends_on if c not in pictures))
        text = prompt(words, self.placeholders)
        return df.withColumn(out, udf(text if ask is None else F.when(ask, text), *[F.col(f"`{c}`") for c in pictures]))
