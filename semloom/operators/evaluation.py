"""Scores of a plan's output against ground truth."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import judge_verdict
from ..functions.names import category_key, clean_text
from ..functions.text import jaccard, normalize_id, quote_score, span_jaccard


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def set_f1(returned: DataFrame, wanted: DataFrame, population: DataFrame, id_col: str, proof: Column | None = None) -> DataFrame:
    """One row ``tp, fp, fn, tn, precision, recall, f1`` over the judgeable population.

    With ``proof``, a condition on columns of ``returned`` or ``wanted``, a wanted row counts as found only
    where it holds; one that fails costs recall alone. Recall is null where nothing is wanted.
    """
    got = returned.dropDuplicates([id_col]).withColumn("__r", F.lit(True))
    want = wanted.dropDuplicates([id_col]).withColumn("__w", F.lit(True))
    rows = population.select(id_col).distinct().join(got, id_col, "left").join(want, id_col, "left")
    r, w = F.coalesce("__r", F.lit(False)), F.coalesce("__w", F.lit(False))
    ok = r & w & (F.lit(True) if proof is None else F.coalesce(proof, F.lit(False)))
    counts = rows.agg(F.count_if(ok).alias("tp"), F.count_if(r & ~w).alias("fp"), F.count_if(w & ~ok).alias("fn"), F.count_if(~r & ~w).alias("tn"), F.count_if(w).alias("__n"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    recall = F.when(F.col("__n") > 0, F.col("tp") / F.col("__n"))
    scored = counts.withColumn("precision", precision).withColumn("recall", recall)
    return scored.withColumn("f1", F.when(F.col("tp") > 0, _f1(F.col("precision"), F.col("recall"))).otherwise(F.lit(0.0))).drop("__n")


def set_f1_quote(returned: DataFrame, gold: DataFrame, population: DataFrame, id_col: str, quote: str, spans: str, gate: float = 0.5) -> DataFrame:
    """``set_f1`` where a wanted row counts as found only if its quote scores above the gate against the gold spans."""
    return set_f1(returned, gold, population, id_col, quote_score(F.col(spans), quote) > gate)


def set_f1_reason(returned: DataFrame, gold: DataFrame, population: DataFrame, id_col: str, reason: str, spans: str, gate: float = 0.5) -> DataFrame:
    """``set_f1`` where a wanted row counts as found only if its reason is more similar to the gold spans than the gate."""
    return set_f1(returned, gold, population, id_col, span_jaccard(F.col(spans), reason) > gate)


def wide_to_long(df: DataFrame, id_col: str, categories: list[str]) -> DataFrame:
    """``id, category, text`` from one column a category, whatever its spelling; texts are cleaned, those of one id and category joined, empty ones left out."""
    columns = {re.sub("[ /-]", "_", c.strip().lower()): c for c in df.columns}
    held = {c: columns[c] for c in categories if c in columns}
    if not held:
        raise ValueError("no column of any category")
    cells = df.filter(F.col(id_col).isNotNull()).select(normalize_id(id_col).alias(id_col), F.monotonically_increasing_id().alias("__at"), F.inline(F.array(*[F.struct(F.lit(k).alias("category"), clean_text(F.col(f"`{c}`")).alias("text")) for k, c in held.items()])))
    return _joined_texts(cells, id_col)


def nested_to_long(df: DataFrame, id_col: str, clauses: str, kind: str = "clause_type", text: str = "text_span", categories: list[str] | None = None) -> DataFrame:
    """``id, category, text`` from a list of structs in each row."""
    items = df.filter(F.col(id_col).isNotNull()).select(normalize_id(id_col).alias(id_col), F.posexplode(clauses).alias("__at", "__c"))
    cells = items.select(id_col, F.col("__at").cast("long").alias("__at"), category_key(F.col(f"__c.{kind}")).alias("category"), clean_text(F.col(f"__c.{text}")).alias("text"))
    return _joined_texts(cells if categories is None else cells.filter(F.col("category").isin(categories)), id_col)


def _joined_texts(cells: DataFrame, id_col: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("__at", "text")))
    return cells.filter("text <> ''").groupBy(id_col, "category").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def extraction_cells(predicted: DataFrame, gold: DataFrame, population: DataFrame, id_col: str, categories: list[str]) -> DataFrame:
    """``id, category, gold, got`` for every id of the population and every category, empty where there is no text."""
    names = F.explode(F.array(*[F.lit(c) for c in categories])).alias("category")
    cells = population.select(id_col).distinct().select(id_col, names)
    both = cells.join(gold.select(id_col, "category", F.col("text").alias("gold")), [id_col, "category"], "left")
    both = both.join(predicted.select(id_col, "category", F.col("text").alias("got")), [id_col, "category"], "left")
    return both.select(id_col, "category", F.coalesce("gold", F.lit("")).alias("gold"), F.coalesce("got", F.lit("")).alias("got"))


def macro_means(scored: DataFrame) -> DataFrame:
    """One row of means over categories, those without a figure passed over, and the share of those without recall."""
    return scored.agg(F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"), F.avg("f1").alias("avg_f1"), F.avg(F.col("recall").isNull().cast("double")).alias("nan_fraction"))


def macro_f1(cells: DataFrame, category: str, gold: str, predicted: str, gate: float = 0.15) -> DataFrame:
    """Per category ``tp, fp, fn, tn, precision, recall, f1`` of extracted texts: a hit is similar enough to the gold text.

    An answer that is not similar enough is a false positive only. F1 is null where no category member is wanted,
    so a mean over categories passes it over.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    g, p = F.coalesce(gold, F.lit("")) != "", F.coalesce(predicted, F.lit("")) != ""
    hit = g & p & (jaccard(words(F.col(gold)), words(F.col(predicted)), 0.0) > gate)
    counts = cells.groupBy(category).agg(F.count_if(hit).alias("tp"), F.count_if(p & ~hit).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    scored = counts.withColumn("precision", precision).withColumn("recall", recall)
    return scored.withColumn("f1", F.when(F.col("recall").isNotNull(), _f1(F.col("precision"), F.col("recall"))))


def adjusted_rand_index(pairs: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row ``ari`` from the contingency table of two labellings; 1 where both are trivial alike."""
    two = lambda n: n * (n - 1) / 2.0
    cells = pairs.groupBy(predicted, gold).agg(F.count(F.lit(1)).cast("double").alias("n"))
    a = cells.agg(F.sum(two(F.col("n"))).alias("a"), F.sum("n").alias("n"))
    b = cells.groupBy(predicted).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias("b"))
    c = cells.groupBy(gold).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias("c"))
    expected = F.col("b") * F.col("c") / two(F.col("n"))
    spread = (F.col("b") + F.col("c")) / 2 - expected
    return a.crossJoin(b).crossJoin(c).select(F.when(spread == 0, F.lit(1.0)).otherwise((F.col("a") - expected) / spread).alias("ari"))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks from 1 with ties at their mean, from counts per distinct value; null values have none.

    Values are ranged over tasks. Each task counts up its own range, and the ranges' sums, one number a task,
    say what comes before: no task sees all values.
    """
    from .kept import keep

    part, n = "__part", "__n"
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias(n))
    ranged = keep(counts.repartitionByRange(value).withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(part).agg(F.sum(n).alias("__sum"))
    order = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offsets = sums.select(part, F.coalesce(F.sum("__sum").over(order), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.join(offsets, part).select(value, (F.col("__before") + inside + (F.col(n) + 1) / 2.0).alias(out))
    return df.join(ranks, value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``spearman`` over the rows in which both values are present."""
    pairs = df.select(F.col(x).alias("__x"), F.col(y).alias("__y")).filter("__x is not null and __y is not null")
    return average_rank(average_rank(pairs, "__x", "__rx"), "__y", "__ry").agg(F.corr("__rx", "__ry").alias("spearman"))


def relative_error_score(got: Column, wanted: Column) -> Column:
    """``1 / (1 + relative error)``; where nothing is wanted, 1 for nothing and 0 for anything else."""
    exact = F.when(got == wanted, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(wanted == 0, exact).otherwise(1 / (1 + F.try_divide(F.abs(got - wanted), F.abs(wanted))))


def citation_scores(judged: DataFrame, cited: str, reference: str, coverage: str) -> DataFrame:
    """``citation_f1`` and ``joint`` = coverage times citation F1 for each judged insight; 0 where it is not covered."""
    common = F.size(F.array_intersect(cited, reference))
    p = F.when(F.size(cited) > 0, common / F.size(cited)).otherwise(F.lit(0.0))
    r = F.when(F.size(reference) > 0, common / F.size(reference)).otherwise(F.lit(0.0))
    return judged.withColumn("citation_f1", _f1(p, r)).withColumn("joint", F.col(coverage) * F.col("citation_f1"))


def insights_present(insights: DataFrame, population: DataFrame, docs: str, doc_id: str) -> DataFrame:
    """``insights`` with ``ref``: those of its documents that are in the population; insights without any are left out."""
    pairs = insights.select("insight_id", F.explode(docs).alias(doc_id)).distinct()
    ref = pairs.join(population.select(doc_id).distinct(), doc_id).groupBy("insight_id").agg(F.array_sort(F.collect_set(doc_id)).alias("ref"))
    return insights.join(ref, "insight_id")


def prompt_fill(insights: DataFrame, population: DataFrame, docs: str, doc_id: str) -> dict[str, str]:
    """What stands for ``[N_insights]`` in a prompt over this population."""
    return {"[N_insights]": str(insights_present(insights, population, docs, doc_id).count())}


def summary_scores(present: DataFrame, bullets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per insight ``coverage, citation_precision, citation_recall, citation_f1, joint``.

    ``present(insight_id, ref)``; ``bullets(bullet_id, cited)``; ``verdicts(insight_id, coverage, bullet_id)``. An
    insight without a verdict, or covered by no usable bullet, cites nothing; only covered ones have citation figures.
    """
    rows = present.select("insight_id", "ref").join(verdicts, "insight_id", "left").join(bullets, "bullet_id", "left")
    cited = F.coalesce("cited", F.array().cast("array<long>"))
    common = F.size(F.array_intersect(cited, F.col("ref").cast("array<long>")))
    covered = F.coalesce("coverage", F.lit(0.0)) > 0
    p, r = F.coalesce(F.try_divide(common, F.size(cited)), F.lit(0.0)), common / F.size("ref")
    scored = rows.select("insight_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.when(covered, p).alias("citation_precision"), F.when(covered, r).alias("citation_recall"))
    f1 = F.when(covered, _f1(F.col("citation_precision"), F.col("citation_recall")))
    return scored.withColumn("citation_f1", f1).withColumn("joint", F.coalesce(F.col("coverage") * F.col("citation_f1"), F.lit(0.0)))


def summary_means(scores: DataFrame) -> DataFrame:
    """One row: mean joint score and coverage over all insights, citation figures over covered ones; null without insights."""
    means = [F.avg(c).alias(n) for c, n in (("joint", "score"), ("coverage", "coverage"), ("citation_precision", "citation_precision"), ("citation_recall", "citation_recall"), ("citation_f1", "citation_f1"))]
    counts = [F.count(F.lit(1)).alias("n_insights"), F.count_if(F.col("coverage") == 1).alias("fully_covered"), F.count_if((F.col("coverage") > 0) & (F.col("coverage") < 1)).alias("partially_covered")]
    return scores.agg(*means, *counts)


def judged(insights: DataFrame, bullets: list[str], call: Callable[[str], str], attempts: int = 3, instruction: str = "") -> DataFrame:
    """``insight_id, coverage, bullet_id, invalid, error`` of ``insights(insight_id, insight)``: a judge is asked about each, a few times until its reply can be read.

    A covered verdict that names no bullet is invalid and cites nothing. The stage is not deterministic: keep its result before reading it twice.
    """
    import pandas as pd

    listed = "\n".join(f"{k}. {b}" for k, b in enumerate(bullets, 1))

    def one(insight: str | None) -> tuple:
        error = None
        for _ in range(attempts):
            try:
                reply = call(f"{instruction}\nInsight: {insight}\nBullets:\n{listed}")
            except Exception as e:  # noqa: BLE001  a failed request is this insight's error
                error = f"{type(e).__name__}: {e}"[:300]
                continue
            coverage, bullet = judge_verdict(reply, len(bullets))
            if coverage is not None:
                return coverage, bullet if coverage else None, bool(coverage and bullet is None), None
            error = f"unreadable verdict: {reply!r}"[:300]
        return None, None, False, error

    def ask(column):
        return pd.DataFrame([one(x) for x in column], columns=["coverage", "bullet_id", "invalid", "error"]).astype({"bullet_id": "Int32"})

    stage = F.pandas_udf(ask, "coverage double, bullet_id int, invalid boolean, error string").asNondeterministic()
    return insights.select("insight_id", stage(F.col("insight")).alias("v")).select("insight_id", "v.*")


@dataclass(frozen=True)
class Clause:
    """A condition on the parsed answers about one category of a contract."""

    label: str
    category: str
    holds: Callable[[Column], Column]


def more_than(category: str, n: int) -> Clause:
    return Clause(f"more than {n}", category, lambda answer: F.coalesce(F.get_json_object(answer, "$.number_parties").cast("int"), F.lit(0)) > n)


def names_place(category: str, place: str) -> Clause:
    return Clause(f"names {place}", category, lambda answer: F.array_contains(F.from_json(answer, "array<string>"), place))


def has_clause(category: str) -> Clause:
    return Clause("has the clause", category, lambda answer: answer == "Yes")


def states_something(category: str) -> Clause:
    return Clause("states something", category, lambda answer: F.coalesce(F.json_array_length(answer), F.lit(0)) > 0)


def renews_without_limit(category: str) -> Clause:
    return Clause("renews without limit", category, lambda answer: F.exists(F.from_json(answer, "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.renewals") == "unlimited", F.lit(False))))


def after_year(category: str, year: int) -> Clause:
    def holds(answer: Column) -> Column:
        years = F.transform(F.from_json(answer, "array<string>"), lambda x: F.get_json_object(x, "$.year").try_cast("int"))
        return F.coalesce(F.array_max(years), F.lit(0)) > year

    return Clause(f"after {year}", category, holds)


def at_least_days(category: str, n: int) -> Clause:
    def holds(answer: Column) -> Column:
        scale = F.create_map(*[F.lit(x) for unit, days in (("days", 1), ("weeks", 7), ("months", 30), ("years", 365)) for x in (unit, days)])
        return F.exists(F.from_json(answer, "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.length").try_cast("double") * scale[F.get_json_object(x, "$.unit")], F.lit(0.0)) >= n)

    return Clause(f"{n} days or more", category, holds)


def gradable(truth: DataFrame, clauses: Sequence[Clause], unusable: str = "unusable") -> DataFrame:
    """Rows whose map (as JSON) of unusable categories names none that the clauses read."""
    reads = F.array(*[F.lit(c) for c in dict.fromkeys(c.category for c in clauses)])
    marked = F.coalesce(F.json_object_keys(unusable), F.array().cast("array<string>"))
    return truth.filter(~F.arrays_overlap(marked, reads))


def wanted_rows(truth: DataFrame, clauses: Sequence[Clause], answer: str = "{} Answer") -> DataFrame:
    """Rows for which every clause holds; an answer that is missing or cannot be read fails its clause."""
    for clause in clauses:
        truth = truth.filter(F.coalesce(clause.holds(F.col(f"`{answer.format(clause.category)}`")), F.lit(False)))
    return truth


def normalized(df: DataFrame, ids: Sequence[str], renamed: dict[str, str] | None = None, out: str | None = None) -> DataFrame:
    """A plan's output in the shape its scorer reads: ids as strings, columns renamed, several ids as one ``a-b`` if ``out`` names it."""
    df = df.withColumnsRenamed(renamed or {}).withColumns({i: normalize_id(i) for i in ids})
    return df.withColumn(out, F.concat_ws("-", *ids)) if out else df


def consistency_issues(truth: DataFrame, name: str, category: str, answers: str, spans: str) -> DataFrame:
    """``name, category, issue, detail``: several answers where one is due, answers without a span, spans without an answer."""
    n, m = F.coalesce(F.size(answers), F.lit(0)), F.coalesce(F.size(spans), F.lit(0))
    kinds = F.array_compact(F.array(F.when(n > 1, F.lit("multi_value")), F.when((n > 0) & (m == 0), F.lit("answer_without_span")), F.when((n == 0) & (m > 0), F.lit("span_without_answer"))))
    return truth.select(F.col(name).alias("name"), F.lit(category).alias("category"), F.explode(kinds).alias("issue"), F.to_json(F.col(answers)).alias("detail"))


def gold_ids(truth: DataFrame, clauses: Sequence[Clause], columns: Sequence[str]) -> DataFrame:
    """The gold table of a query: gradable rows for which its clauses hold."""
    return wanted_rows(gradable(truth, clauses), clauses).select(*columns)


def symmetric_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair both ways, pairs of one with itself left out, each once."""
    swapped = pairs.select(F.col(b).alias(a), F.col(a).alias(b))
    return pairs.select(a, b).unionByName(swapped).filter(F.col(a) != F.col(b)).distinct()
