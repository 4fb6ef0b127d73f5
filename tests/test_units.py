"""Parsers, allocations, plan rules and parity cases."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semloom.functions import answers, budgets, text
from semloom.operators import evaluation, exact, metrics, ranking, retrieval, sampling
from semloom.operators.provider import CallProvider, RuleProvider
from semloom.operators.record import Record
from semloom.plans.pipeline import Pipeline
from semloom.plans.rules import rewrite
from semloom.plans.search import Registry, search
from semloom.sources import sinks, tables


@given(st.lists(st.integers(0, 50), max_size=8), st.integers(1, 60))
def test_allocations_sum_to_k(wanted, k):
    out = budgets.repair_allocations(wanted, k)
    assert not wanted and out == [] or sum(out) == k


@given(st.integers(0, 100))
def test_bands(m):
    assert sum(n for _, n, _ in budgets.gradient_bands(m)) == m


@given(st.lists(st.integers(0, 500), max_size=10), st.integers(0, 2000))
def test_fair_shares(lengths, budget):
    out = budgets.fair_shares(lengths, budget)
    assert sum(out) <= budget and all(s <= n for s, n in zip(out, lengths))
    assert sum(lengths) > budget or out == lengths


def test_answers():
    assert answers.coerce_list("[1, 4]", True) == [1, 4] == answers.coerce_list("1, 4", True)
    assert answers.coerce_list("none") == [] and answers.coerce_str({"a": [1, True]}) == "a: 1\ntrue"
    assert answers.read_object('so {"a": "}", "b": 1,} x') == {"a": "}", "b": 1}
    assert answers.read_answer("ANSWER: yes\n---", {"x": "str"}) == {"x": "yes"}
    assert answers.read_answer('{"x": "3.0"}', {"x": "int", "y": "bool"}) == {"x": 3, "y": None}
    assert answers.verdict("not FALSE but TRUE") is True and answers.verdict("?") is None
    assert answers.coerce("see article 4 please", "list[int]") is None and answers.coerce_list("-1; 2", True) == [-1, 2]
    assert answers.read_object('{"a": "one", "two", "b": "x\ny"}') == {"a": "one\ntwo", "b": "x\ny"} and answers.type_label("int") == " (int)"
    assert answers.judge_verdict('{"coverage": "NO COVERAGE"}', 3) == (0.0, None) and answers.judge_verdict("?", 3) == (None, None)
    assert budgets.cell_budgets([10, 55, 1000], 150, 2400) == [10, 55, 70] and text.truncate_content("a" * 10, 4).startswith("aa\n")
    assert answers.parse_step("a\n```python\nx\n```\n```json\n{}\n```") == ("python", "x\n")


def test_plan_checks(spark):
    p = Pipeline.of(spark.range(3).withColumn("v", F.lit("a")))
    for bad in (lambda: p.map({"v": "1"}), lambda: p.project(["x"]), lambda: p.groupby(["id"], ["median"], ["v"]), lambda: p.sem_agg([{"name": "s"}], "x", group_by=["x"])):
        with pytest.raises(ValueError):
            bad()
    one = p.groupby([], ["count"], ["id"])
    with pytest.raises(ValueError):
        p.join(one, "true").sem_agg([{"name": "s"}], "x", depends_on=["count(id)"])
    assert p.join(p, "id = id_right").columns == ("id", "v", "id_right", "v_right")
    assert p.columns == ("id", "v") and not p.nodes


def test_first_limit_ends_the_run(spark):
    p = Pipeline.of(spark.range(5))
    plan = p.limit(2).join(p, "true")
    assert plan.lower().count() == 2 and plan.lower(ignore_limits=True).count() == 25


def test_errors_drop_rows_but_abort_joins(spark):
    p = Pipeline.of(spark.createDataFrame([(1,), (0,), (None,)], "x int"))
    assert p.filter(lambda r: 1 / r["x"] > 0).lower().count() == 1
    assert p.map(lambda r: {"y": 1 // r["x"]}, [{"name": "y", "type": "int"}]).lower().count() == 1
    with pytest.raises(Exception, match="ZeroDivision|TypeError"):
        p.join(p, lambda l, r: 1 / l["x"] > 0).lower().collect()


def test_exact_filter_moves_below_the_model(spark):
    p = Pipeline.of(spark.range(4).withColumn("v", F.lit("a")))
    plan = p.sem_map([{"name": "m"}], depends_on=["v"]).sem_map([{"name": "n"}], depends_on=["v"]).filter("id > 1")
    assert [n.kind for n in rewrite(plan).nodes] == ["filter", "sem_map"]
    rules = RuleProvider({"m": lambda c: F.upper(c("v")), "n": lambda c: c("v")})
    assert plan.lower(rules).count() == 2 == plan.lower(rules, optimize=False).count()


def test_call_provider(spark):
    def call(prompts):
        return [("TRUE" if "yes" in p else "FALSE" if "no" in p else "?", 1, 1) for p in prompts]

    p = Pipeline.of(spark.createDataFrame([("yes",), ("no",), ("huh",), (None,)], "v string"))
    assert [r.v for r in p.sem_filter("Well?", depends_on=["v"]).lower(CallProvider(call)).collect()] == ["yes"]

    def fail(prompts):
        raise OSError("down")

    made = p.sem_map([{"name": "n", "type": "int"}], depends_on=["v"]).lower(CallProvider(fail)).collect()
    assert len(made) == 4 and {r.n for r in made} == {None}


def test_sem_agg_list_keys_and_ragged_lists(spark):
    df = spark.createDataFrame([([1, 2], "a"), ([2, 1], "b"), ([3], "c")], "k array<int>, v string")
    rules = RuleProvider({"all": lambda c: F.transform(c("items"), lambda x: x["v"]), "one": lambda c: F.lit("x")})
    cols = [{"name": "l", "type": "list[str]", "description": "all"}, {"name": "s", "type": "str", "description": "one"}]
    out = Pipeline.of(df).sem_agg(cols, "x", group_by=["k"], depends_on=["v"], one_to_many=True).lower(rules).collect()
    assert sorted((r.l, r.s) for r in out) == sorted([("a", "x"), ("b", None), ("c", "x")], key=str) or len(out) == 3
    kept = Pipeline.of(df).sem_agg(cols[1:], "x", group_by=["k"], depends_on=["v"], keep_inputs=True).lower(rules)
    assert kept.count() == 3


def test_chunks_and_sizes(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "abcdefg"), (3, "ab"), (4, None)], "i int, t string")
    out = {r.i: r.c for r in df.select("i", text.chunks("t", 3).alias("c")).collect()}
    assert out == {1: ["abc", "def"], 2: ["abc", "def", "g"], 3: ["ab"], 4: None}
    with pytest.raises(ValueError):
        retrieval.chunk_size("__import__('os')", F.lit(1))
    scored = retrieval.score_chunks(df, "i", "t", "abc", 6)
    assert {r.i for r in scored.collect()} == {1, 2}  # equal length is cut, shorter is not


def test_text_edges(spark):
    df = spark.createDataFrame([("10110.0",), ("7",), ("a.0",), (None,)], "x string")
    assert [r[0] for r in df.select(text.normalize_id("x")).collect()] == ["10110", "7", "a.0", None]
    row = spark.range(1).select(
        text.span_jaccard(F.array().cast("array<string>"), F.lit("")).alias("a"), text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"), 0.0).alias("b"),
        text.normalize_citations(F.lit("x [Article 3-5; 8] [doctor]")).alias("c"), text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("d"), text.insight_bullets(F.lit("- one two three four five [1]\n- [2] no")).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (1.0, 0.0, [3, 4, 5, 8], 0.0, ["one two three four five [1]"])


def test_flat_scores_and_bands(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(9)], "i int, score double")
    for seed in range(1, 8):  # one flat run: every band draws from it, whatever rows the earlier ones took
        out = ranking.gradient_subset(df, "i", 6, seed).collect()
        assert len({r.i for r in out}) == 6 and sorted(r.band for r in out) == ["middle"] * 2 + ["negative"] + ["top"] * 3
    slope = ranking.ranked(spark.createDataFrame([(i, 1 - i / 100) for i in range(100)], "i int, score double"), "i")
    assert [r.i for r in ranking.select_band(slope, "i", 3, 0.5, 1, taken=[50]).collect()] == [51, 52, 53]
    flat = ranking.combine(df.select("i", F.lit(2.0).alias("bm25"), F.lit(0).alias("hits"), F.lit(0.3).alias("dense"))).agg(F.max("score")).first()[0]
    assert flat == 0.0


def test_combine_scales_sums(spark):
    rows = [(1, 0.0, 2, 0.5), (2, 4.0, 0, 0.1), (3, 2.0, 1, 0.9), (4, 1.0, 0, None)]
    out = {r.i: r for r in ranking.combine(spark.createDataFrame(rows, "i int, bm25 double, hits int, dense double"), 0.25).collect()}
    assert [round(out[i].sparse, 6) for i in range(1, 5)] == [1.0, round(0.75 / 1.75, 6), round(1.25 / 1.75, 6), 0.0]
    assert out[3].score == pytest.approx(0.25 * 1.25 / 1.75 + 0.75) and out[4].score is None


def slow_bm25(texts, query):
    import math
    import re

    words = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    n, avg = len(words), sum(map(len, words)) / len(words)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t in {x for w in words for x in w} for d in [sum(t in w for w in words)]}
    mean = sum(raw.values()) / len(raw)
    idf = lambda t: 0.25 * mean if raw[t] < 0 else raw[t]
    return [sum(idf(t) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in query.split() if t in raw) for w in words]


def test_bm25_takes_each_row_for_itself(spark):
    texts = ["the cat the dog", "the bird", None, "cat cat bird the", "", "dog"]
    ids = [1, 1, None, 2, 3, 3]
    df = spark.createDataFrame(list(zip(ids, texts)), "id int, t string").withColumn("bm25", F.lit("clash"))
    for query in ("cat the", "the the dog", "absent", ""):
        got = sorted(round(r.bm25, 9) for r in ranking.bm25(df, "t", query).collect())
        assert got == sorted(round(x, 9) for x in (slow_bm25(texts, query) if query else [0.0] * 6))
    assert ranking.piece_scores(["the cat", "the", "the dog the"], ["the", "cat"]) == pytest.approx(slow_bm25(["the cat", "the", "the dog the"], "the cat"))


def test_retrieval_keeps_rows_apart(spark):
    df = spark.createDataFrame([(1, "cat " * 10 + "dog " * 10), (1, "dog " * 30 + "bird " * 8), (None, "cat " * 30), (2, None)], "id int, t string")
    out = retrieval.retrieve(df, ["t"], "bird", 40, top=1, capture="seen").collect()
    assert [r.t and r.t.splitlines()[1][:4] for r in out] == ["cat ", "bird", "cat ", None]
    assert out[1].seen["t"] == out[1].t and out[1].t.startswith("[Chunk rank 1/1, BM25 ")


def counting(tmp_path):
    """A call whose prompts are noted in a file, as executors are other processes."""
    log = str(tmp_path / "calls")

    def call(prompts):
        with open(log, "a") as f:
            f.write("".join("x\n" for _ in prompts))
        return [("TRUE" if "a" in p.splitlines()[-1] else '{"m": "b"}', 1, 2) for p in prompts]

    def calls():
        import os

        return sum(1 for _ in open(log)) if os.path.exists(log) else 0

    return CallProvider(call), calls


def test_a_costly_step_runs_once(spark, tmp_path):
    provider, calls = counting(tmp_path)
    p = Pipeline.of(spark.createDataFrame([(i, "x") for i in range(10)], "id int, v string")).sem_map([{"name": "m"}], depends_on=["v"])
    assert p.join(p, "id = id_right and m = m_right").lower(provider).count() == 10 and calls() == 10
    two = p.filter("id < 9").sem_map([{"name": "n", "description": "n"}], depends_on=["m"], skip_if="id >= 5")
    out = two.lower(provider, optimize=False).collect()
    assert len(out) == 9 and calls() == 10 + 10 + 5
    beside = p.sem_agg([{"name": "m2", "description": "m"}], "x", group_by=["v"], depends_on=["m"], keep_inputs=True)
    assert beside.lower(provider).count() == 10 and calls() == 25 + 10 + 1


def test_records_of_a_run(spark):
    p = Pipeline.of(spark.range(20))

    def odd(row):
        if row["id"] % 4 == 0:
            raise ValueError("four")
        return row["id"] % 2

    plan = p.filter(odd).sem_filter("big", depends_on=["id"], skip_if="id = 1")
    record = Record({"rules": metrics.Price(1.0, 1.0)})
    rules = RuleProvider({"big": lambda c: F.when(c("id") != 3, c("id") > 9)})
    assert plan.lower(rules, record=record).count() == 6
    first, second = record.rows()
    assert (first["op_type"], first["num_records"], first["num_passed"], first["num_errors"]) == ("filter", 20, 10, 5)
    assert (second["num_records"], second["num_passed"], second["num_errors"]) == (10, 6, 1) and second["cost_usd"] > 0
    assert [r.error for r in record.errors(spark).collect()] == ["5x ValueError: four", "1x no verdict"]


def test_callables_get_the_columns_they_name():
    columns = ["a", "b", "c"]
    other = {"a": 1}
    assert exact.reads(lambda r: r["a"] > 1 and r["b"], columns) == ["a", "b"]
    for whole in (lambda r: r.get("a"), lambda r: dict(r), lambda r: [r[x] for x in ("a", "b")], lambda r: r["zz"], lambda r: other["a"], lambda r: 1, lambda r: [k for k in columns if r["a"]]):
        assert exact.reads(whole, columns) == columns


def test_names_of_columns_compare_as_the_session_does(spark):
    rules = RuleProvider({"cls": lambda c: F.upper(c("v"))})
    plan = Pipeline.of(spark.createDataFrame([("a",), ("b",)], "v string")).sem_map([{"name": "cls"}], depends_on=["v"]).filter("CLS = 'A'")
    assert plan.lower(rules).count() == 1


def test_fingerprints_tell_closures_apart(spark):
    p = Pipeline.of(spark.range(3))
    over = lambda n: (lambda r: r["id"] > n)
    ids = {p.filter(over(n)).nodes[0].fingerprint() for n in (1, 2)} | {p.filter(lambda r: any(r["id"] > n for n in (k,))).nodes[0].fingerprint() for k in (1, 2)}
    assert len(ids) == 4 and p.filter(over(1)).nodes[0].fingerprint() == p.filter(over(1)).nodes[0].fingerprint()


def test_a_product_of_pairs_is_refused(spark):
    p = Pipeline.of(spark.range(2000))
    with pytest.raises(ValueError, match="4000000 pairs"):
        p.sem_join(p, "x", depends_on=["id"]).lower(RuleProvider({"x": lambda c: F.lit(True)}))


def test_one_prompt_takes_so_many_rows(spark):
    p = Pipeline.of(spark.range(1_000_001)).sem_agg([{"name": "s", "description": "x"}], "x", depends_on=["id"])
    with pytest.raises(ValueError, match="one prompt"):
        p.lower(RuleProvider({"x": lambda c: F.lit("x")}))


def test_prompts(spark):
    seen = []

    def call(prompts, options):
        return [(f"TRUE {options['model']} {options.get('effort')} {len(options.get('images', [[]])[0])} {'7' in p}", 0, 0) for p in prompts]

    provider = CallProvider(call, placeholders={"[N]": 7}, reasoning=["deep"])
    from semloom.operators.provider import Task, fill

    assert provider.options(Task("filter", "x", model="deep")) == {"model": "deep", "effort": "low"} and provider.options(Task("filter", "x", model="fast")) == {"model": "fast"}
    assert fill("[N] of [N_insights]", {"[N]": 1, "[N_insights]": 2}) == "1 of 2" and seen == []
    df = spark.createDataFrame([(1, bytearray(b"png")), (2, None)], "id int, image binary").withMetadata("image", {"modality": "image"})
    assert Pipeline.of(df).sem_filter("[N] things?", "deep", depends_on=["id", "image"]).lower(provider).count() == 2


def test_plans_as_json(spark):
    from semloom.plans import ir

    sources = {"r": spark.range(6), "s": spark.range(3).withColumn("v", F.lit("a"))}
    right = Pipeline.of(sources["s"], "right").filter("id > 0")
    plan = Pipeline.of(sources["r"], "left").map({"x": "id * 2"}).join(right, "id = id_right").groupby(["v"], ["sum"], ["x"]).sort("v").limit(3)
    text = ir.to_json(plan, sources)
    again = ir.from_json(text, sources)
    assert ir.to_json(again, sources) == text and again.lower().collect() == plan.lower().collect() == [("a", 6)]
    with pytest.raises(ValueError):
        ir.to_json(Pipeline.of(sources["r"]).filter(lambda r: True), sources)
    with pytest.raises(ValueError):
        ir.from_json(text.replace('"op": "limit"', '"op": "drop"'), sources)


def test_session(tmp_path, spark):
    from semloom.plans import session
    from semloom.sources import config

    assert session.trim_history(["task", "a" * 6, "b" * 5, "c" * 4], 14) == ["task", "b" * 5, "c" * 4] and session.trim_history([]) == []
    assert session.trim_blocks(["a" * 9, "b" * 3], 5) == ["bbb"] and session.trim_blocks(["a" * 9], 5) == ["a" * 9]
    record = session.final_record("q", "p", [{"quality": 1.0}, {"quality": 0.0}])
    assert record["figures"]["quality"]["mean"] == 0.5 and list(record["run1"]) == ["quality"] and "$0.5000" in session.footer(0.5, 1, 2, 3)
    router, own = session.Route("r", False, frozenset({"effort"})), session.Route("o", True, frozenset({"temperature"}))
    assert session.request("own-1", {"temperature": 0, "effort": "low"}, {"own": own}, router) == {"model": "own-1", "endpoint": "o", "temperature": 0}
    assert session.request("else", {"temperature": 0}, {"own": own}, router) == {"model": "else", "endpoint": "r"}
    models = session.Models()
    models.register("m", metrics.Price(1.0, 2.0))
    calls = spark.createDataFrame([("m", 1_000_000, 0, 0), ("x", 1, 1, 0)], "model string, prompt_tokens long, completion_tokens long, cached_tokens long")
    assert {r.model: r.cost for r in models.repriced(calls).collect()} == {"m": 1.0, "x": None}
    assert session.Models.plain([{"role": "u", "content": [{"text": "a", "cache_control": 1}], "cache_control": 2}]) == [{"role": "u", "content": [{"text": "a"}]}]
    plan = Pipeline.of(spark.range(9), "p").filter("id > 1").map({"x": "id + 1"}).project(["x"])
    samples = session.plan_samples(plan)
    assert [s["op"] for s in samples] == ["p_op0_filter", "p_op1_map", "p_op2_project"] and samples[0]["passed"] == [False, False, True, True, True] and samples[2]["out"][0] == {"x": "3"}
    session.run_log(tmp_path, "r1").error("broken")
    assert "broken" in (tmp_path / "r1.log").read_text()
    (tmp_path / "c.toml").write_text('a = 1\n[columns.img]\nmodality = "image"\n[columns.t]\n')
    held = config.load(tmp_path / "c.toml")
    assert config.modalities(held) == {"img": "image", "t": "text"} and config.merged(held, {"columns": {"t": {"modality": "x"}}})["columns"]["img"] == {"modality": "image"}
    assert metrics.long_prompt_tier([metrics.Price(1, 1), metrics.Price(1, 1, tier=9), metrics.Price(1, 1, tier=5)]) == 5 and metrics.attributed(1.0, ["a", "b", "a"]) == {"a": 0.5, "b": 0.5} and metrics.scaled_tokens(10, 4, 9) == 23


def test_judge(spark):
    def call(prompt):
        if "raise" in prompt.split("Bullets")[0]:
            raise OSError("down")
        return '{"coverage": "Fully covered", "bullet_id": "2"}' if "good" in prompt.split("Bullets")[0] else '```json\n{"coverage": "partial", "bullet_id": 9}\n```' if "half" in prompt.split("Bullets")[0] else "?"

    insights = spark.createDataFrame([(1, "good"), (2, "half"), (3, "raise"), (4, "other")], "insight_id int, insight string")
    out = {r.insight_id: r for r in evaluation.judged(insights, ["a", "b"], call).collect()}
    assert (out[1].coverage, out[1].bullet_id, out[1].invalid) == (1.0, 2, False) and (out[2].coverage, out[2].bullet_id, out[2].invalid) == (0.5, None, True)
    assert out[3].error.startswith("OSError") and out[4].error.startswith("unreadable")


def test_summaries():
    from semloom.functions import summaries

    assert summaries.rewrite_citations("x [Article 3-5; 8] [doctor] [1, 2] [idx: 4]") == ("x [3, 4, 5, 8] [doctor] [1, 2] [4]", 2)
    assert summaries.rewrite_citations("[1-500]")[0] == "[1, 500]"
    assert summaries.bullets_of("One [1]. - Two [2]. - Three") == ["One [1].", "- Two [2].", "- Three"]
    assert summaries.bullets_of('["a", "b\\nc"]') == ["a", "b", "c"] and summaries.bullets_of("a\\nb") == ["a", "b"] and summaries.bullets_of(None) == []
    assert '"It is so." Return' in summaries.with_example("Do.\nCareful:\nx", "It is so")
    with pytest.raises(ValueError):
        summaries.with_example("Do.", "x")


def test_contracts(spark):
    from semloom.functions import contracts as C

    cells = spark.createDataFrame([("successive 1 year; 2 6-month, perpetual; [ ]", "(6) months / thirty (30) days; 1/1/20")], "r string, n string")
    row = cells.select(C.parse_renewals(F.col("r")).alias("r"), C.parse_notice(F.col("n")).alias("n"), C.listed(F.lit("1/2/2020; 3 days/4 weeks")).alias("l")).first()
    assert [tuple(x) for x in row.r] == [("unlimited", 1.0, "years", None), ("2", 6.0, "months", None), (None, None, None, "perpetual"), (None, None, None, "redacted")]
    assert [(x.length, x.unit) for x in row.n][:2] == [(6.0, "months"), (30.0, "days")] and row.l == ["1/2/2020", "3 days", "4 weeks"]
    date = lambda m, y: F.struct(F.lit(m).alias("month"), F.lit("1").alias("day"), F.lit(y).alias("year"))
    row = spark.range(1).select(C.term_between(date("01", "2019"), date("07", "2020")).alias("a"), C.term_between(date("01", "2019"), date("01", "2021")).alias("b"), C.term_between(date("01", "20??"), date("01", "2021")).alias("c"), C.latest_year(F.array(date("1", "19??"), date("1", "1999"))).alias("d")).first()
    assert (tuple(row.a), tuple(row.b), row.c, row.d) == ((18, "months"), (2, "years"), None, 1999)


def test_sampling(spark):
    df = spark.createDataFrame([(i, f"word{i % 3} text") for i in range(30)] + [(7, "a repeated id")], "id int, body string")
    spec = sampling.Spec(bm25_query="word1", m=5, filter="id < 20", text_cols=("body", "nope"))
    rows, record = sampling.draw(df, "id", 8, "one-shot", [spec], preselected=["3", "99"])
    ids = [r.id for r in rows.orderBy("_pos").collect()]
    assert len(set(ids)) == 8 and ids[0] == "3" and any("99" in w for w in record.warnings) and any("nope" in w for w in record.warnings)
    again, _ = sampling.draw(df, "id", 8, "one-shot", [spec], preselected=["3", "99"])
    assert ids == [r.id for r in again.orderBy("_pos").collect()]
    assert sampling.draw(df, "id", 50, "random")[0].count() == 30
    full, record = sampling.draw(df, "id", 1, preselected=["3"])
    assert record.stop_reason == "preselected_full" and full.count() == 1
    assert sampling.pool(df, "id").filter("id = '7'").first().body == "a repeated id"  # the least of an id's rows


def test_plans_of_strata_are_repaired(spark):
    df = spark.createDataFrame([(1, "a", [1.0])], "id int, t string, v array<double>")
    record = sampling.Record("one-shot", 1)
    plan = {"strata": [{"bm25_query": "a", "m": 3, "label": "A"}, {"m": 5}, {"keyphrases": ["x"] * 20, "alpha": 7, "m": 1, "odd": 1}, {"bm25_query": "a", "text_cols": []}]}
    specs = sampling.validate_plan(plan, df, "id", 8, record)
    assert [s.label for s in specs] == ["A", "stratum 3"] and sum(s.m for s in specs) == 8 and specs[1].alpha == 1.0 and len(specs[1].keyphrases) == 12
    assert sum("no scorer" in w for w in record.warnings) == 2 and sampling.validate_plan([], df, "id", 8, record) == []
    pinned = sampling.validate(sampling.Spec(query_vector=(1.0,), vector_cols=("v",)), df, "id", record, pinned=())
    assert pinned.vector_cols == ()


def test_deliberated_draws(spark):
    df = spark.createDataFrame([(i, f"word{i % 3} text") for i in range(30)], "id int, body string")
    with pytest.raises(ValueError):
        sampling.draw(df, "id", 5, "agentic")
    seen, kept = [], []

    def decide(report, round_):
        seen.append(report)
        return sampling.Decision(round_ == 2, {"bm25_query": "word2 missing", "keyphrases": ["text", "no such"], "m": 5})

    rows, record = sampling.draw(df, "id", 5, "agentic", sampling.Spec(bm25_query="word1", m=5), decide=decide, keep_scores=kept.append)
    assert (record.stop_reason, record.rounds, len(seen)) == ("accepted", 2, 2) and "['missing']" in seen[1] and "['no such']" in seen[1]
    assert {int(r.id) % 3 for r in rows.collect()} == {2} and record.strata[1]["live"] == ("bm25",) and "decisions" in record.ledger.seconds
    assert kept[1].filter("selected").count() == 5 and kept[1].count() == 30 and set(sampling.COMPONENTS) <= set(kept[1].columns)
    assert sampling.draw(df, "id", 5, "agentic", sampling.Spec(bm25_query="word1"), decide=lambda r, n: sampling.Decision(False))[1].stop_reason == "parse_failed"
    assert sampling.draw(df, "id", 5, "agentic", sampling.Spec(bm25_query="word1"), decide=lambda r, n: sampling.Decision(False, sampling.Spec(bm25_query="word1")))[1].stop_reason == "max_rounds"
    assert "error" in sampling.explore(df, "select nope from {rows}") and sampling.explore(df, "select count(*) as n from {rows}") == "{'n': 30}"
    lines = sampling.describe_images(df.select("id", F.lit("p").alias("path")), "id", "path", lambda asked: [f"{i}: a picture" for i, _ in asked])
    assert len(lines) == 5 and set(lines.values()) == {"a picture"}


def test_scores_of_nothing(spark):
    ids = spark.createDataFrame([(1,), (2,)], "i int")
    none = ids.filter("false")
    row = evaluation.set_f1(none, none, ids, "i").first()
    assert (row.tp, row.tn, row.recall, row.f1) == (0, 2, None, 0.0)


def test_price_tier(spark):
    price = metrics.Price(1.0, 2.0, tier=100, long_read=10.0, long_write=20.0)
    out = spark.createDataFrame([(100,), (101,)], "n int").select(metrics.token_cost(price, F.col("n"), F.lit(1))).collect()
    assert [round(r[0] * 1e6) for r in out] == [102, 1030]
    prices = spark.createDataFrame([("m", 0, 1.0, 0.0, 2.0), ("m", 100, 10.0, 0.0, 20.0)], "model string, tier int, read double, cached double, write double")
    calls = spark.createDataFrame([("m", 100, 0, 1), ("m", 101, 0, 1)], "model string, prompt_tokens int, cached_tokens int, completion_tokens int")
    assert sorted(round(r.cost * 1e6) for r in metrics.token_cost_joined(calls, prices).collect()) == [102, 1030]


def test_search(spark):
    p = Pipeline.of(spark.range(10), "cheap")
    plans = [p.filter("id > 5"), Pipeline.of(spark.range(10), "dear").filter("id > 1")]
    found = search(Registry(), plans, RuleProvider({}), lambda df: df.count() / 10, lambda plan: float(plan.name == "dear"))
    assert found == ["dear", "cheap"]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("10.0", "a\nb"), ("11", None)], "id string, t string")
    ids = spark.createDataFrame([(0, "11"), (1, "10")], "_pos int, id string")
    assert [r.id for r in tables.subset(df, ids, "id").collect()] == ["11", "10.0"]
    with pytest.raises(ValueError):
        tables.subset(df, spark.createDataFrame([(0, "12")], "_pos int, id string"), "id")
    sinks.write_results(df, str(tmp_path / "r"))
    assert tables.csv(spark, str(tmp_path / "r"), "id string, t string").filter("t = 'a\nb'").count() == 1
    assert sinks.upsert_record(tmp_path / "x.json", "q", "m", {"a": 1})["q"]["m"] == {"a": 1}
    sinks.merge_config(tmp_path / "c.json", "1", {"seed": 1, "model": None})
    with pytest.raises(ValueError):
        sinks.merge_config(tmp_path / "c.json", "1", {"seed": 2})
    cache = sinks.VectorCache(spark, str(tmp_path / "v"))
    calls = []

    def embed(rows):
        calls.append(rows.count())
        return rows.select("id", F.array(F.lit(1.0)).alias("vec"))

    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    assert cache.ensure(rows, "m", "f", embed).count() == 2 and cache.ensure(rows, "m", "f", embed).count() == 2 and calls == [2] and cache.account == {"asked": 0, "reused": 2}
    lost = cache.ensure(rows, "m", "g", lambda r: embed(r).filter("id = 'a'"), dims=2).collect()
    assert {r.id: list(r.vec) for r in lost} == {"a": [1.0], "b": [0.0, 0.0]}
    sinks.write_json(tmp_path / "old.json", {"q": {"mode": "random", "sampled_ids": [1]}, "p": {"sampled_ids": [2]}})
    merged = sinks.upsert_record(tmp_path / "old.json", "q", "one-shot", {"sampled_ids": [3]})
    assert set(merged["q"]) == {"random", "one-shot"} and merged["p"] == {"sampled_ids": [2]}
    sinks.write_subset(spark.createDataFrame([("x", 1), ("y", 0)], "id string, _pos int"), "id", str(tmp_path / "s"))
    assert [r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == ["y", "x"]
    sinks.write_scores(df, str(tmp_path / "sc"))
    assert spark.read.parquet(str(tmp_path / "sc")).count() == 2
    assert len(sinks.write_artifacts(tmp_path / "art", df, df, {"a": 1}, [])) == 4


def test_stream(spark, tmp_path):
    from semloom.streaming.lowering import lower_stream, stream, windowed

    spark.range(20).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("k")).write.parquet(str(tmp_path / "in"))
    source = stream(spark, str(tmp_path / "in"), "id long, ts timestamp, k long", 10)
    plan = lower_stream(Pipeline.of(source).filter("id > 3").map({"x": "id * 2"}))
    q = windowed(plan, "ts", "10 minutes", "1 minute", ["k"], ["count", "sum"], ["id", "x"]).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(`count(id)`) from w").first()[0] == 16
    with pytest.raises(ValueError):
        lower_stream(Pipeline.of(source).limit(3))


def test_row_filter(spark):
    df = spark.range(3)
    kept, problem = exact.row_filter(df, "nope > 1")
    assert kept.count() == 3 and problem
    assert exact.row_filter(df, " None ")[1] is None and exact.row_filter(df, "id > 1")[0].count() == 1


def test_wordless_texts_have_no_first_word(spark, tmp_path):
    from semloom.plans import catalog

    rows = [(1, "One two", "en"), (2, "", "en"), (3, "Äöü — !", "de"), (4, None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["sem_map"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, 2, "one"), (2, 0, None), (3, 0, None), (4, None, None)]


def test_sem_join_by_rules_is_a_join_by_their_keys(spark):
    from semloom.plans import catalog

    plan = catalog.queries()["sem_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    keys = next(x for x in plan.splitlines() if "Join" in x).partition("[")[2].partition("]")[0]
    assert all(c in keys for c in ("p_brand", "p_type", "p_size"))
    left = spark.createDataFrame([(1, 2), (2, None), (3, 3)], "a int, v int")
    p = Pipeline.of(left)
    same = p.sem_join(p, "same", depends_on=["v", "v_right"]).project(["a", "a_right"]).lower(RuleProvider({"same": lambda c: c("v") == c("v_right")}))
    assert sorted(map(tuple, same.collect())) == [(1, 1), (3, 3)]
    kept = p.sem_filter("two", depends_on=["v"], skip_if="a = 3").lower(RuleProvider({"two": lambda c: c("v") == 2}))
    assert sorted(r.a for r in kept.collect()) == [1, 3]


def test_an_embedding_is_computed_once(spark):
    from semloom.functions.embedding import hashed_cosine, hashed_embedding, query_embedding

    texts = ["the license of the apache", "", "Äöü", None, "a b c " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one = df.select(hashed_cosine(F.col("t"), "the apache").alias("s"))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.e for r in df.select(hashed_embedding(F.col("t")).alias("e")).collect()] == [[None] * 64 if t is None else query_embedding(t) for t in texts]
    assert one.collect()[3].s == 0.0


def test_chunks_are_ranked_by_rounded_scores(spark):
    from semloom.operators import retrieval

    score = lambda p: F.when(p == "aaaa", 0.1234561).when(p == "bbbb", 0.1234564).otherwise(0.00015)
    cut = lambda text, top: retrieval.retrieve(spark.createDataFrame([(text,)], "t string"), ["t"], "q", 4, top=top, score=score).first().t
    assert cut("aaaabbbb", 1) == "[Chunk rank 1/1, similarity 0.1235]\naaaa"  # a tie: the first chunk
    assert cut("cccc", 1) == "[Chunk rank 1/1, similarity 0.0001]\ncccc"  # 0.00015 is less than it looks
