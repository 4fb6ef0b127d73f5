"""Small subsets of a table for comparing plans: random, ranked, stratified, gradient and deliberated draws.

A draw follows a spec or a list of strata. Modes: ``random`` draws uniformly; ``baseline`` takes the top of one
default ranking; ``one-shot`` follows given strata once; ``one-shot-gradient`` takes bands of each ranking;
``agentic`` shows each draw's report to a decision function, which accepts it or names other strata, for a
few rounds. Decisions and reports are small; rows stay in Spark until at most k of them are chosen.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.budgets import cell_budgets, repair_allocations
from ..functions.text import normalize_id, row_text, text_columns
from . import ranking
from .exact import row_filter

MODES = ("baseline", "one-shot", "agentic", "random", "one-shot-gradient")
BASE_SEED, MOST_PHRASES, MOST_ROUNDS = 42, 12, 3
#: Characters of a report's rows and of one of its cells.
REPORT_CHARS, CELL_CHARS = 20_000, 2_400
EXPLORATION_CHARS = 6_000
#: Component columns of the scores frame.
COMPONENTS = ("bm25", "bm25_norm", "hits", "matched", "dense", "dense_norm", "sparse", "score")


@dataclass(frozen=True)
class Spec:
    """How rows are scored: words for BM25, whole phrases, a query vector, and which rows are in the pool."""

    bm25_query: str = ""
    keyphrases: tuple[str, ...] = ()
    query_vector: tuple[float, ...] = ()
    text_cols: tuple[str, ...] | None = None  # None: all texts; (): none
    vector_cols: tuple[str, ...] = ()
    filter: str | None = None
    alpha: float = 0.5
    m: int = 0
    label: str = ""

    @property
    def configured(self) -> tuple[str, ...]:
        """The scorers that the spec asks for."""
        asked = {"bm25": bool(self.bm25_query) and self.text_cols != (), "keyphrases": bool(self.keyphrases) and self.text_cols != (), "dense": bool(self.query_vector and self.vector_cols)}
        return tuple(k for k, v in asked.items() if v)


@dataclass
class Ledger:
    """Cost and time of a draw: what was paid now, what earlier draws had paid for, summed and by the clock."""

    paid: dict[str, float] = field(default_factory=dict)
    sunk: dict[str, float] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    began: float = field(default_factory=time.time)

    def pay(self, what: str, dollars: float, seconds: float = 0.0, sunk: bool = False) -> None:
        held = self.sunk if sunk else self.paid
        held[what] = held.get(what, 0.0) + dollars
        if not sunk:
            self.seconds[what] = self.seconds.get(what, 0.0) + seconds

    def summary(self) -> dict[str, float]:
        paid, sunk = sum(self.paid.values()), sum(self.sunk.values())
        return {"cost_usd": paid, "sunk_usd": sunk, "cost_with_sunk_usd": paid + sunk, "summed_s": sum(self.seconds.values()), "wall_s": time.time() - self.began}


@dataclass
class Record:
    """What a draw did: the seed, the rounds, why it stopped, what was repaired, what it cost and how long it took."""

    mode: str
    seed: int
    stop_reason: str = "accepted"
    rounds: int = 1
    warnings: list[str] = field(default_factory=list)
    strata: list[dict[str, Any]] = field(default_factory=list)
    ledger: Ledger = field(default_factory=Ledger)


def seed_of(subset_id: int) -> int:
    return BASE_SEED + subset_id - 1


def default_spec(query: str) -> Spec:
    """The query's own words over all texts, nothing else."""
    return Spec(bm25_query=query)


def resolve_columns(asked: Any, known: Sequence[str], what: str, record: Record) -> tuple[str, ...]:
    """Columns from a spec: none or ``all`` means all, a string one, a list those that exist."""
    if asked is None or asked == "all":
        return tuple(known)
    names = (asked,) if isinstance(asked, str) else tuple(asked)
    if lost := [c for c in names if c not in known]:
        record.warnings.append(f"unknown columns dropped from {what}: {lost}")
    return tuple(dict.fromkeys(c for c in names if c in known))


def validate(spec: Spec, df: DataFrame, id_col: str, record: Record, pinned: tuple[str, ...] | None = None) -> Spec:
    """Repair rather than reject: unknown columns go, alpha is clamped, phrases are capped; an explicit () stays off.

    ``pinned`` are the vector columns of the first round, to which later rounds are held.
    """
    kinds = dict(df.dtypes)
    texts = [c for c in text_columns(df, id_col) if not kinds[c].startswith("array")]
    spec = replace(spec, text_cols=resolve_columns(spec.text_cols, texts, "text_cols", record))
    spec = replace(spec, vector_cols=resolve_columns(spec.vector_cols, [c for c in df.columns if kinds[c].startswith("array")], "vector_cols", record))
    if pinned is not None and spec.vector_cols != pinned:
        record.warnings.append(f"vector columns stay those of the first round: {list(pinned)}")
        spec = replace(spec, vector_cols=pinned)
    if not 0 <= spec.alpha <= 1:
        record.warnings.append(f"alpha {spec.alpha} clamped")
        spec = replace(spec, alpha=min(1.0, max(0.0, spec.alpha)))
    if len(spec.keyphrases) > MOST_PHRASES:
        record.warnings.append(f"only the first {MOST_PHRASES} keyphrases count")
        spec = replace(spec, keyphrases=spec.keyphrases[:MOST_PHRASES])
    return spec


def validate_plan(plan: Spec | Mapping | Sequence, df: DataFrame, id_col: str, k: int, record: Record, pinned: tuple[str, ...] | None = None) -> list[Spec]:
    """The strata of a plan, checked and with allocations that sum to k: one spec is one stratum; those without any scorer go; none: a uniform draw."""
    given = [plan] if isinstance(plan, Spec | Mapping) else list(plan)
    if len(given) == 1 and isinstance(given[0], Mapping) and "strata" in given[0]:
        given = list(given[0]["strata"])
    specs = []
    for n, item in enumerate(given, 1):
        if isinstance(item, Mapping):
            known = {f: tuple(v) if isinstance(v, list) else v for f, v in item.items() if f in Spec.__dataclass_fields__}
            if unknown := sorted(set(item) - set(known) - {"rationale"}):
                record.warnings.append(f"stratum {n}: unknown settings {unknown}")
            item = Spec(**known)
        spec = validate(replace(item, label=item.label or f"stratum {n}"), df, id_col, record, pinned)
        if not spec.configured:
            record.warnings.append(f"{spec.label} has no scorer and is dropped")
            continue
        specs.append(spec)
    shares = repair_allocations([max(0, s.m) for s in specs], k)
    return [replace(s, m=m) for s, m in zip(specs, shares, strict=False)]


def pool(df: DataFrame, id_col: str, order: Sequence = ()) -> DataFrame:
    """The table with ids as strings and one row an id, the first by ``order``, or else by all of its columns.

    Rows of a distributed table have no order of their own, so without one the least row stands first.
    """
    kinds = dict(df.dtypes)
    place, number = ranking.fresh(df.columns, "__id"), ranking.fresh(df.columns, "__n")
    keyed = df.withColumn(place, normalize_id(id_col))
    by = list(order) or [F.col(f"`{c}`") for c in df.columns if not kinds[c].startswith("map")]
    first = F.row_number().over(Window.partitionBy(place).orderBy(*by))
    return keyed.filter(F.col(place).isNotNull()).withColumn(number, first).filter(F.col(number) == 1).withColumn(id_col, F.col(place)).drop(place, number)


def score(df: DataFrame, id_col: str, spec: Spec, record: Record) -> DataFrame:
    """The pool's rows with ``bm25, hits, matched, dense, bm25_norm, sparse, dense_norm, score``."""
    rows, problem = row_filter(df, spec.filter)
    if problem:
        record.warnings.append(problem)
    texts = spec.text_cols or ()
    scored = ranking.bm25(rows, row_text(*texts), spec.bm25_query) if "bm25" in spec.configured else rows.withColumn("bm25", F.lit(0.0))
    scored = ranking.keyphrases(scored, texts, spec.keyphrases if texts else ())
    scored = ranking.dense(scored, spec.vector_cols, spec.query_vector) if "dense" in spec.configured else scored.withColumn("dense", F.lit(0.0))
    return ranking.combine(scored, spec.alpha)


def live_scorers(scored: DataFrame) -> tuple[str, ...]:
    """The scorers that tell rows apart in a scored pool, whatever was configured."""
    ends = scored.agg(*[f(c).alias(f"{n}_{c}") for c in ("bm25", "hits", "dense") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    names = {"bm25": "bm25", "hits": "keyphrases", "dense": "dense"}
    return tuple(names[c] for c in names if ends[f"lo_{c}"] is not None and ends[f"hi_{c}"] > ends[f"lo_{c}"])


def scores_frame(scored: DataFrame, id_col: str, spec: Spec, chosen: Sequence[str], round_: int, stratum: int, mode: str, bands: Mapping[str, str] | None = None) -> DataFrame:
    """A row for each scored row: its place, every component, and whether and why it was chosen, as the sinks store it."""
    rows = ranking.ranked(scored, id_col)
    band = F.create_map(*[F.lit(x) for pair in (bands or {}).items() for x in pair])[F.col(id_col)] if bands else F.lit(None).cast("string")
    about = {"round": F.lit(round_), "stratum": F.lit(stratum), "stratum_label": F.lit(spec.label), "stratum_m": F.lit(spec.m), "mode": F.lit(mode), "alpha": F.lit(spec.alpha), "filter": F.lit(spec.filter), "bm25_query": F.lit(spec.bm25_query), "keyphrases": F.lit(", ".join(spec.keyphrases)), "text_columns": F.lit(", ".join(spec.text_cols or ())), "dense_columns": F.lit(", ".join(spec.vector_cols))}
    return rows.select(*[v.alias(k) for k, v in about.items()], F.col(id_col), "rank", *COMPONENTS, F.col(id_col).isin(list(chosen)).alias("selected"), band.alias("band"))


def report(rows: DataFrame, scored: DataFrame, id_col: str, spec: Spec, chosen: Sequence[str], live: Sequence[str]) -> str:
    """What a decision function reads about a draw: how scores are spread, what did not work, and the chosen rows cut to a budget of characters."""
    spread = ", ".join(f"p{r.p} {r.value:.3f}" for r in ranking.percentiles(scored, "score").collect() if r.value is not None)
    lines = [f"## {spec.label}: {len(chosen)} rows", f"score: {spread}"]
    lines += [f"{r['name']}: {r['least']} to {r['most']}" for r in ranking.ranges(scored, ["bm25", "hits", "dense"]).collect()]
    if spec.keyphrases:
        lines.append("hits: " + ", ".join(f"{r.value}: {r.n} rows" for r in sorted(ranking.histogram(scored, "hits").collect())))
        if unused := ranking.zero_hits(scored, spec.keyphrases):
            lines.append(f"phrases that no row holds: {unused}")
    if spec.bm25_query and (dead := [r.term for r in ranking.dead_terms(scored, row_text(*(spec.text_cols or ())), spec.bm25_query).orderBy("position").collect()]):
        lines.append(f"words that no row holds: {dead}")
    if idle := [s for s in spec.configured if s not in live]:
        lines.append(f"scorers that tell no rows apart: {idle}")
    columns = [c for c in rows.columns if c != id_col]
    cut = rows.filter(F.col(id_col).isin(list(chosen))).select(id_col, *[F.substring(F.col(f"`{c}`").cast("string"), 1, CELL_CHARS).alias(c) for c in columns])
    held = {r[id_col]: r.asDict() for r in cut.collect()}
    cells = [(i, c, held[i][c] or "") for i in chosen if i in held for c in columns]
    for (i, c, text), allowed in zip(cells, cell_budgets([len(t) for _, _, t in cells], REPORT_CHARS, CELL_CHARS), strict=True):
        lines.append(f"[{i}] {c}: {text[:allowed]}{'…' if len(text) > allowed else ''}")
    return "\n".join(lines)


def explore(df: DataFrame, sql: str, name: str = "rows", most: int = EXPLORATION_CHARS) -> str:
    """The result of one SQL query over the pool as text, cut to a length; an error is text as well."""
    view = f"explored_{id(df)}"
    try:
        df.createOrReplaceTempView(view)
        found = df.sparkSession.sql(sql.replace(f"{{{name}}}", view)).limit(200)
        return "\n".join(str(r.asDict()) for r in found.collect())[:most]
    except Exception as e:  # noqa: BLE001  whoever asked reads the error
        return f"error: {str(e).splitlines()[0]}"[:most]
    finally:
        df.sparkSession.catalog.dropTempView(view)


def describe_images(images: DataFrame, id_col: str, path_col: str, describe: Callable[[Sequence[tuple[str, str]]], Sequence[str]], most: int = 5) -> dict[str, str]:
    """Descriptions of a few images from one call: its lines are given to the ids they begin with, or else in order."""
    asked = [(str(r[0]), r[1]) for r in images.select(id_col, path_col).orderBy(id_col).limit(most).collect()]
    lines = [x.strip() for x in describe(asked) if x.strip()] if asked else []
    named = {i: line[len(i) :].lstrip(" :.-") for i, _ in asked for line in lines if line.startswith(i) and not line[len(i) :][:1].isalnum()}
    return named if named else dict(zip((i for i, _ in asked), lines, strict=False))


@dataclass(frozen=True)
class Decision:
    """What a decision function says of a draw: that it stands, or the plan of another one. A plan of None could not be read."""

    accept: bool
    plan: Any = None


def draw(
    df: DataFrame, id_col: str, k: int, mode: str = "baseline", strata: Spec | Mapping | Sequence = (), subset_id: int = 1, preselected: Sequence[str] = (), query: str = "",
    decide: Callable[[str, int], Decision] | None = None, keep_scores: Callable[[DataFrame], None] | None = None,
) -> tuple[DataFrame, Record]:
    """``(_pos, id)`` of k rows and the record of the draw.

    Preselected ids come first. Each stratum then takes its m rows from what earlier ones left, from the
    top of its ranking or in gradient bands; rows still missing are drawn at random, first from outside
    every stratum's filter. ``agentic`` needs ``decide(report, round)``. ``keep_scores`` gets the scores frame of
    every round and stratum.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "agentic" and decide is None:
        raise ValueError("an agentic draw needs a decision function")
    record = Record(mode, seed_of(subset_id))
    rows = pool(df, id_col).persist()
    first = _preselected(rows, id_col, preselected, k, record)
    if len(first) == k and preselected:
        record.stop_reason = "preselected_full"
        chosen = first
    elif mode == "random":
        record.stop_reason = "random_no_target"
        chosen = _filled(rows, id_col, k, record, first, [])
    else:
        given = strata if mode != "baseline" or strata else default_spec(query) if query else ()
        chosen = _rounds(rows, id_col, k, given, record, first, decide if mode == "agentic" else None, keep_scores)
    rows.unpersist()
    return df.sparkSession.createDataFrame(list(enumerate(chosen)), f"_pos int, `{id_col}` string"), record


def _preselected(rows: DataFrame, id_col: str, asked: Sequence, k: int, record: Record) -> list[str]:
    names = [str(x) for x in dict.fromkeys(asked)]
    if not names:
        return []
    there = {r[0] for r in rows.filter(F.col(id_col).isin(names)).select(id_col).collect()}
    record.warnings += [f"unknown preselected id {x}" for x in names if x not in there]
    return [x for x in names if x in there][:k]


def _rounds(rows: DataFrame, id_col: str, k: int, plan: Any, record: Record, first: list[str], decide: Callable[[str, int], Decision] | None, keep_scores) -> list[str]:
    """Draws until a decision accepts one, or rounds run out; the last draw stands."""
    pinned = None
    for round_ in range(1, MOST_ROUNDS + 1):
        record.rounds = round_
        specs = validate_plan(plan, rows, id_col, k - len(first), record, pinned)
        if pinned is None and specs:
            pinned = specs[0].vector_cols
        if not specs:
            record.warnings.append("no stratum has a scorer: rows are drawn uniformly")
        chosen, reports = _strata(rows, id_col, specs, record, first, round_, keep_scores, decide is not None)
        chosen = _filled(rows, id_col, k, record, chosen, specs)
        if decide is None:
            return chosen
        began = time.time()
        decision = decide("\n\n".join(reports), round_)
        record.ledger.pay("decisions", 0.0, time.time() - began)
        if decision.accept:
            record.stop_reason = "accepted"
            return chosen
        if decision.plan is None:
            record.stop_reason = "parse_failed"
            return chosen
        plan = decision.plan
    record.stop_reason = "max_rounds"
    return chosen


def _strata(rows: DataFrame, id_col: str, specs: Sequence[Spec], record: Record, first: list[str], round_: int, keep_scores, reported: bool) -> tuple[list[str], list[str]]:
    chosen, reports = list(first), []
    for number, spec in enumerate(specs, 1):
        scored = score(rows, id_col, spec, record)
        if reported or keep_scores:
            scored = scored.persist()
        bands: dict[str, str] = {}
        if record.mode == "one-shot-gradient":
            left = scored.filter(~F.col(id_col).isin(chosen)) if chosen else scored
            took = ranking.gradient_subset(left, id_col, spec.m, record.seed).select(id_col, "band").collect()
            bands = {r[0]: r[1] for r in took}
        else:
            left = scored.filter(~F.col(id_col).isin(chosen)) if chosen else scored
            took = ranking.top_k(left, spec.m, [F.desc("score"), F.col(id_col)]).select(id_col).collect()
        mine = [r[0] for r in took]
        chosen += mine
        live = live_scorers(scored) if reported else ()
        record.strata.append({"round": round_, "stratum": number, **asdict(spec), "configured": spec.configured, "live": live, "chosen": mine})
        if reported:
            reports.append(report(rows, scored, id_col, spec, mine, live))
        if keep_scores:
            keep_scores(scores_frame(scored, id_col, spec, mine, round_, number, record.mode, bands))
        if reported or keep_scores:
            scored.unpersist()
    return chosen, reports


def _filled(rows: DataFrame, id_col: str, k: int, record: Record, chosen: list[str], specs: Sequence[Spec]) -> list[str]:
    """Up to k rows: seeded ones from outside every stratum's filter, then any others."""
    filters = [s.filter for s in specs]
    if len(chosen) < k and specs and all(f and f.strip().lower() != "none" for f in filters):
        outside = rows
        for text in filters:
            kept, problem = row_filter(rows, text)
            if problem is None:
                outside = outside.filter(~F.coalesce(F.expr(text).cast("boolean"), F.lit(False)))
        chosen = chosen + _random(outside, id_col, k - len(chosen), record.seed, chosen)
    if len(chosen) < k:
        chosen = chosen + _random(rows, id_col, k - len(chosen), record.seed, chosen)
    return chosen


def _random(rows: DataFrame, id_col: str, n: int, seed: int, taken: Sequence[str]) -> list[str]:
    left = rows.filter(~F.col(id_col).isin(list(taken))) if taken else rows
    return [r[0] for r in ranking.random_rows(left, id_col, n, seed).select(id_col).collect()]
