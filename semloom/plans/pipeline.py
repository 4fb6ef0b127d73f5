"""The plan builder: an immutable chain of logical operators, checked as it grows and lowered to DataFrames.

Thirteen operators: ``filter, map, project, add_col_suffix, join, groupby, limit`` are exact and lower to
Column expressions that Catalyst can push, prune and reorder; ``sem_filter, sem_map, sem_join, sem_agg,
rag_filter, rag_map`` ask a model through a provider. (``sort``, ``union`` and ``distinct`` are extensions.)
Every builder returns a new plan, so a plan can feed any number of others.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import exact, semantic
from ..operators.kept import keep
from ..operators.provider import KINDS, Provider, Task
from ..operators.record import Record

Predicate = Column | str | Callable[[dict], Any]
ColumnDefs = Sequence[dict[str, str]]


@dataclass(frozen=True)
class Node:
    """A logical operator; ``inputs`` are plans it reads besides the chain before it."""

    kind: str
    attributes: dict[str, Any] = field(default_factory=dict)
    inputs: tuple[Pipeline, ...] = ()

    @property
    def semantic(self) -> bool:
        return self.kind.startswith(("sem_", "rag_"))

    def fingerprint(self) -> str:
        shown = {k: _shown(v) for k, v in self.attributes.items()}
        return hashlib.sha256(json.dumps([self.kind, shown], sort_keys=True).encode()).hexdigest()[:10]


def _shown(value: Any) -> Any:
    if isinstance(value, str | int | float | bool) or value is None:
        return value
    if isinstance(value, Column):
        return str(value)
    if isinstance(value, dict):
        return {str(k): _shown(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_shown(v) for v in value]
    code = getattr(value, "__code__", None)
    if code is None:
        return str(value)
    inner = [_shown_code(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts]
    closed = [_shown(cell.cell_contents) for cell in value.__closure__ or ()]
    return [code.co_code.hex(), inner, list(code.co_names), closed, _shown(value.__defaults__ or ())]


def _shown_code(code: Any) -> Any:
    return [code.co_code.hex(), [_shown_code(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts], list(code.co_names)]


@dataclass(frozen=True)
class Pipeline:
    """A plan over one source table; see the module's docstring."""

    name: str
    source: DataFrame
    nodes: tuple[Node, ...] = ()
    columns: tuple[str, ...] = ()
    #: columns copied onto every row by a one-row join or a sem_agg that keeps its inputs, and whether the plan has one row
    repeated: frozenset[str] = frozenset()
    one_row: bool = False

    @staticmethod
    def of(source: DataFrame, name: str = "plan") -> Pipeline:
        return Pipeline(name, source, (), tuple(source.columns))

    def _with(self, node: Node, columns: Sequence[str] | None = None, **state) -> Pipeline:
        return replace(self, nodes=(*self.nodes, node), columns=tuple(self.columns if columns is None else columns), **state)

    def _known(self, names: Sequence[str], what: str) -> None:
        if missing := [c for c in names if c not in self.columns]:
            raise ValueError(f"{what}: no such columns: {missing}; there are {list(self.columns)}")

    def _new(self, names: Sequence[str]) -> None:
        if taken := [c for i, c in enumerate(names) if c in self.columns or c in names[:i]]:
            raise ValueError(f"new columns must be new: {taken}")

    # exact operators

    def project(self, cols: Sequence[str]) -> Pipeline:
        self._known(cols, "project")
        return self._with(Node("project", {"cols": list(cols)}), cols, repeated=self.repeated & set(cols))

    def filter(self, predicate: Predicate) -> Pipeline:
        """Rows for which the predicate is true. A callable that raises drops its row."""
        return self._with(Node("filter", {"predicate": predicate}))

    def map(self, columns: dict[str, Column | str] | Callable[[dict], dict], cols: ColumnDefs = ()) -> Pipeline:
        """New columns by expressions, or by a callable on rows with declared ``cols``; a callable that raises drops its row."""
        names = list(columns) if isinstance(columns, dict) else [c["name"] for c in cols]
        self._new(names)
        return self._with(Node("map", {"columns": columns, "cols": [dict(c) for c in cols]}), [*self.columns, *names])

    def add_col_suffix(self, suffix: str) -> Pipeline:
        return self._with(Node("add_col_suffix", {"suffix": suffix}), [c + suffix for c in self.columns], repeated=frozenset(c + suffix for c in self.repeated))

    def join(self, other: Pipeline, on: Predicate | Callable[[dict, dict], Any], depends_on: Sequence[str] = ()) -> Pipeline:
        """Inner join by a condition over both sides: a Column or SQL string over output names, or a callable of two rows.

        Columns of the right side whose names are taken get ``_right`` until they are free. A condition that
        holds an equality becomes a hash or merge join; a callable that raises fails the run.
        """
        renamed = exact.joined_names(self.columns, other.columns)
        out = [*self.columns, *renamed.values()]
        if missing := [c for c in depends_on if c not in out]:
            raise ValueError(f"join: no such columns: {missing}")
        repeated = set(self.repeated) | {renamed[c] for c in other.repeated}
        if other.one_row:
            repeated |= set(renamed.values())
        if self.one_row:
            repeated |= set(self.columns)
        return self._with(Node("join", {"on": on, "depends_on": list(depends_on)}, (other,)), out, repeated=frozenset(repeated), one_row=False)

    def groupby(self, fields: Sequence[str], funcs: Sequence[str], agg_fields: Sequence[str]) -> Pipeline:
        """Parallel lists: column ``func(field)`` each, of count, sum, average, min, max, list and set."""
        self._known([*fields, *agg_fields], "groupby")
        names = exact.aggregate_names(funcs, agg_fields)
        return self._with(Node("groupby", {"fields": list(fields), "funcs": list(funcs), "agg_fields": list(agg_fields)}), [*fields, *names], repeated=frozenset(), one_row=not fields)

    def limit(self, n: int, order_by: Sequence[Column | str] = ()) -> Pipeline:
        return self._with(Node("limit", {"n": n, "order_by": list(order_by)}))

    # model operators

    def sem_filter(self, condition: str, model: str = "rules", depends_on: Sequence[str] = (), skip_if: Predicate | None = None) -> Pipeline:
        """Rows of which the model says TRUE; rows of ``skip_if`` pass unasked; an unreadable answer fails the filter."""
        self._known(depends_on, "sem_filter")
        return self._with(Node("sem_filter", {"condition": condition, "model": model, "depends_on": list(depends_on), "skip_if": skip_if}))

    def sem_map(self, cols: ColumnDefs, model: str = "rules", depends_on: Sequence[str] = (), skip_if: Predicate | None = None) -> Pipeline:
        """New columns from one model call a row; null where the call failed or ``skip_if`` holds."""
        self._known(depends_on, "sem_map")
        names = [c["name"] for c in cols]
        self._new(names)
        return self._with(Node("sem_map", {"cols": [dict(c) for c in cols], "model": model, "depends_on": list(depends_on), "skip_if": skip_if}), [*self.columns, *names])

    def sem_join(self, other: Pipeline, condition: str, model: str = "rules", depends_on: Sequence[str] = (), blocking: Column | str | None = None, most_pairs: int | None = semantic.MOST_PAIRS) -> Pipeline:
        """A model verdict on every pair; ``blocking`` narrows the pairs by an exact condition first."""
        renamed = exact.joined_names(self.columns, other.columns)
        out = [*self.columns, *renamed.values()]
        if missing := [c for c in depends_on if c not in out]:
            raise ValueError(f"sem_join: no such columns: {missing}")
        attributes = {"condition": condition, "model": model, "depends_on": list(depends_on), "blocking": blocking, "most_pairs": most_pairs}
        return self._with(Node("sem_join", attributes, (other,)), out, one_row=False)

    def sem_agg(self, cols: ColumnDefs, instruction: str, model: str = "rules", group_by: Sequence[str] = (), depends_on: Sequence[str] = (), one_to_many: bool = False, keep_inputs: bool = False) -> Pipeline:
        """One model call a group. List keys compare as sorted; a group whose answer cannot be read is dropped."""
        self._known([*group_by, *depends_on], "sem_agg")
        if copied := [c for c in depends_on if c in self.repeated]:
            raise ValueError(f"sem_agg reads columns that repeat one value on every row: {copied}")
        names = [c["name"] for c in cols]
        self._new(names if keep_inputs else [n for n in names if n in group_by])
        out = [*self.columns, *names] if keep_inputs else [*group_by, *names]
        attributes = {"cols": [dict(c) for c in cols], "instruction": instruction, "model": model, "group_by": list(group_by), "depends_on": list(depends_on), "one_to_many": one_to_many, "keep_inputs": keep_inputs}
        repeated = frozenset(self.repeated | set(names)) if keep_inputs else frozenset()
        return self._with(Node("sem_agg", attributes), out, repeated=repeated, one_row=not keep_inputs and not group_by and not one_to_many)

    def _rag(self, kind: str, attributes: dict, names: Sequence[str] = ()) -> Pipeline:
        if (attributes["top"] is None) == (attributes["threshold"] is None):
            raise ValueError("exactly one of top and threshold")
        if attributes["method"] not in ("embedding", "bm25"):
            raise ValueError("similarity is by embedding or bm25")
        self._known([*attributes["depends_on"], attributes["id_col"]], kind)
        names = [*names, *filter(None, [attributes.get("capture")])]
        self._new(names)
        return self._with(Node(kind, attributes), [*self.columns, *names])

    def rag_filter(self, condition: str, query: str, id_col: str, depends_on: Sequence[str], model: str = "rules", chunk_size: int | str = 20000, top: int | None = None, threshold: float | None = None, method: str = "bm25", skip_if: Predicate | None = None, capture: str | None = None) -> Pipeline:
        """``sem_filter`` on texts cut down to the chunks that fit the query; the rows keep their whole texts."""
        return self._rag("rag_filter", {"condition": condition, "query": query, "id_col": id_col, "depends_on": list(depends_on), "model": model, "chunk_size": chunk_size, "top": top, "threshold": threshold, "method": method, "skip_if": skip_if, "capture": capture})

    def rag_map(self, cols: ColumnDefs, query: str, id_col: str, depends_on: Sequence[str], model: str = "rules", chunk_size: int | str = 20000, top: int | None = None, threshold: float | None = None, method: str = "bm25", skip_if: Predicate | None = None, capture: str | None = None) -> Pipeline:
        """``sem_map`` on texts cut down to the chunks that fit the query; the rows keep their whole texts."""
        return self._rag("rag_map", {"cols": [dict(c) for c in cols], "query": query, "id_col": id_col, "depends_on": list(depends_on), "model": model, "chunk_size": chunk_size, "top": top, "threshold": threshold, "method": method, "skip_if": skip_if, "capture": capture}, [c["name"] for c in cols])

    # extensions

    def sort(self, *order: Column | str) -> Pipeline:
        return self._with(Node("sort", {"order": list(order)}))

    def union(self, other: Pipeline) -> Pipeline:
        if set(other.columns) != set(self.columns):
            raise ValueError("union: the plans differ in columns")
        return self._with(Node("union", {}, (other,)), one_row=False)

    def distinct(self) -> Pipeline:
        return self._with(Node("distinct"))

    # inspection and execution

    def steps(self) -> list[tuple[str, Node]]:
        """(name, operator) from the source on, branches before their join."""
        out: list[tuple[str, Node]] = []
        for node in self.nodes:
            for other in node.inputs:
                out += other.steps()
            out.append((f"{self.name}_op{len(out)}_{node.kind}", node))
        return out

    def explain(self) -> str:
        lines = [f"{self.name}: source({', '.join(self.source.columns)})"]
        for name, node in self.steps():
            shown = ", ".join(f"{k}={_shown(v)!r}"[:80] for k, v in node.attributes.items() if v not in (None, [], ()))
            lines.append(f"  {name} [{node.fingerprint()}] {shown}")
        return "\n".join(lines)

    def fingerprints(self) -> tuple[str, ...]:
        """What the plan does, step by step, its branches included."""
        return tuple(node.fingerprint() + "".join(f"<{id(o.source)}:{','.join(o.fingerprints())}>" for o in node.inputs) for node in self.nodes)

    def lower(self, provider: Provider | None = None, ignore_limits: bool = False, optimize: bool = True, record: Record | None = None) -> DataFrame:
        """The plan as a DataFrame. ``ignore_limits`` is for runs on a subset; ``record`` notes what each operator does when it runs.

        A step that asks a costly model and is read twice, as the two sides of a self-join or the rows beside
        a group's answer are, runs once: its rows are written to the shared folder and read from there.
        """
        return _Lowering(self, provider, ignore_limits, optimize, record).run()


class _Lowering:
    """One lowering of a plan; holds the steps whose rows are kept."""

    def __init__(self, plan: Pipeline, provider: Provider | None, ignore_limits: bool, optimize: bool, record: Record | None):
        from .rules import rewrite

        self.rewrite = rewrite if optimize else lambda p: p
        self.plan, self.provider, self.ignore_limits, self.record = plan, provider, ignore_limits, record
        self.costly = provider is not None and getattr(provider, "costly", True)
        self.held: dict[tuple, DataFrame] = {}
        self.reads: Counter[tuple] = Counter()
        if self.costly:
            self._count(self.rewrite(plan))

    def _count(self, plan: Pipeline) -> None:
        """How often the rows after each step are read: by its next step, and by every branch that goes through it."""
        steps = plan.fingerprints()
        for k, node in enumerate(plan.nodes):
            self.reads[(id(plan.source), steps[: k + 1])] += 1
            for other in node.inputs:
                self._count(self.rewrite(other))

    def run(self) -> DataFrame:
        df = self._lower(self.plan)
        df = df.select(*[F.col(f"`{c}`") for c in self.plan.columns])
        first = next((n.attributes["n"] for n in self.plan.nodes if n.kind == "limit"), None)
        # the first limit also ends the run: whatever later operators multiply, no more rows come out
        multiplies = any(n.kind in ("join", "sem_join", "sem_agg", "union") for n in self.plan.nodes)
        return df.limit(first) if first is not None and multiplies and not self.ignore_limits else df

    def _lower(self, plan: Pipeline) -> DataFrame:
        wanted = plan.columns
        plan = self.rewrite(plan)
        df, steps, asked = plan.source, plan.fingerprints(), False
        done = next((k for k in range(len(steps), 0, -1) if (id(plan.source), steps[:k]) in self.held), 0)
        if done:
            df = self.held[(id(plan.source), steps[:done])]
        for k, node in enumerate(plan.nodes):
            asked = asked or node.semantic or any(n.semantic for o in node.inputs for _, n in o.steps())
            if k < done:
                continue
            key = (id(plan.source), steps[: k + 1])
            if node.kind == "sem_agg" and (node.attributes["keep_inputs"] or not node.attributes["group_by"]) and self.costly and any(n.semantic for n in plan.nodes[:k]):
                df = keep(df)  # its rows are counted first, or read beside the groups' answers
            df = self._step(df, node, f"{plan.name}_op{k}_{node.kind}")
            # of a shared beginning only its last step, after which the readers part, is kept
            further = (id(plan.source), steps[: k + 2])
            if self.costly and asked and self.reads[key] > 1 and (k + 1 == len(plan.nodes) or self.reads[further] < self.reads[key]):
                df = self.held[key] = keep(df)
        return df.select(*[F.col(f"`{c}`") for c in wanted])

    def _branch(self, node: Node) -> DataFrame:
        return self._lower(node.inputs[0])

    def _step(self, df: DataFrame, node: Node, name: str) -> DataFrame:
        a, provider = node.attributes, self.provider
        if node.semantic and provider is None:
            raise ValueError(f"{node.kind} needs a provider")
        task = lambda kind, text, outputs=(): Task(kind, text, tuple(outputs), tuple(a.get("depends_on", ())), a.get("model", "rules"))
        watch = self.record.of_rows(name, node) if self.record else None
        watch_answers = self.record.of_answers(name, node) if self.record else semantic.unwatched
        match node.kind:
            case "project":
                return df.select(*[F.col(f"`{c}`") for c in a["cols"]])
            case "filter":
                return exact.filter_rows(df, a["predicate"], watch)
            case "map":
                return exact.map_rows(df, a["columns"], a["cols"], watch)
            case "add_col_suffix":
                return df.withColumnsRenamed({c: c + a["suffix"] for c in df.columns})
            case "join":
                return exact.join_rows(df, self._branch(node), a["on"])
            case "groupby":
                return exact.group_rows(df, a["fields"], a["funcs"], a["agg_fields"])
            case "limit":
                return df if self.ignore_limits else (df.orderBy(*a["order_by"]) if a["order_by"] else df).limit(a["n"])
            case "sort":
                return df.orderBy(*a["order"])
            case "union":
                return df.unionByName(self._branch(node))
            case "distinct":
                return df.distinct()
            case "sem_filter":
                return semantic.sem_filter(df, provider, task("filter", a["condition"]), a["skip_if"], watch_answers)
            case "sem_map":
                return semantic.sem_map(df, provider, task("map", "", output_defs(a["cols"])), a["skip_if"], watch_answers)
            case "sem_join":
                left, right = df, self._branch(node)
                if self.costly and a["blocking"] is None and a["most_pairs"] is not None:  # their rows are counted first
                    left, right = keep(left), keep(right)
                return semantic.sem_join(left, right, provider, task("join", a["condition"]), a["blocking"], a["most_pairs"], watch_answers)
            case "sem_agg":
                return semantic.sem_agg(df, provider, task("agg", a["instruction"], output_defs(a["cols"])), a["group_by"], a["one_to_many"], a["keep_inputs"], watch_answers)
            case "rag_filter":
                return semantic.rag_filter(df, provider, task("filter", a["condition"]), a, watch_answers)
            case "rag_map":
                return semantic.rag_map(df, provider, task("map", "", output_defs(a["cols"])), a, watch_answers)
        raise ValueError(f"unknown operator {node.kind}")


def output_defs(cols: ColumnDefs) -> tuple[tuple[str, str, str], ...]:
    for c in cols:
        if c.get("type", "str") not in KINDS:
            raise ValueError(f"column {c['name']}: unknown type {c['type']}")
    return tuple((c["name"], c.get("type", "str"), c.get("description", c["name"])) for c in cols)


def column_metadata(df: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """Attach descriptions to columns, as schema metadata that travels with the plan."""
    for name, text in descriptions.items():
        df = df.withMetadata(name, {"description": text})
    return df


def describe_schema(df: DataFrame) -> list[tuple[str, str, str]]:
    return [(f.name, f.dataType.simpleString(), f.metadata.get("description", "")) for f in df.schema.fields if isinstance(f, T.StructField)]
