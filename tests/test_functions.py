"""Hand-computed cases."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions import parsing as px
from gristmill.functions import stats
from gristmill.functions import text as tx
from gristmill.operators import answers, generation, graph, judge, retrieval, sampling
from gristmill.sources import records


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def ratings(spark, rows):
    return spark.createDataFrame([(i, r, v) for i, r, v in rows], "item_id long, rater_id string, label int")


def test_wilson(spark):
    w = lambda k, n: one(spark, stats.wilson(F.lit(k), F.lit(n)))
    assert tuple(w(0, 0)) == (0, 0) and w(5, 5)["hi"] == 1 and w(0, 5)["lo"] == 0
    assert w(5, 10)["lo"] == pytest.approx(0.2366, abs=1e-4) and w(5, 10)["hi"] == pytest.approx(0.7634, abs=1e-4)
    with pytest.raises(Exception, match="between 0 and n"):
        w(6, 5)


def test_kappa(spark):
    rows = [(i, r, v) for r, vs in (("a", [1, 2, 3, 3]), ("b", [1, 2, 3, 2])) for i, v in enumerate(vs)]
    assert stats.kappa(ratings(spark, rows), "a", "b", (1, 3)).first()["coefficient"] == pytest.approx(0.8)
    same = [(i, r, 2) for r in "ab" for i in range(3)]
    assert stats.kappa(ratings(spark, same), "a", "b").first()["coefficient"] is None


def test_alpha_and_ac2(spark):
    rows = [(0, "a", 1), (0, "b", 1), (1, "a", 1), (1, "b", 2)]
    assert stats.alpha(ratings(spark, rows), "nominal", (1, 2)).first()["coefficient"] == pytest.approx(0.0)
    same = ratings(spark, [(i, r, 4) for r in "ab" for i in range(3)])
    assert stats.alpha(same).first()["coefficient"] is None and stats.ac2(same).first()["coefficient"] is None
    with pytest.raises(Exception, match="between 1 and 5"):
        stats.alpha(ratings(spark, [(0, "a", 9), (0, "b", 1)])).collect()


def test_percentile(spark):
    assert stats.percentile_of([1, 2, 4], 2.5) == pytest.approx(1.05) and stats.percentile_of([1, 2, 4], 97.5) == pytest.approx(3.9)


def test_bootstrap(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(10)] + [("h", 1.0)], "g string, v double")
    got = {r["g"]: (r["lo"], r["hi"]) for r in stats.bootstrap(df, ["g"], "v", lambda xs: sum(xs) / len(xs), 50, 3).collect()}
    draw, out = random.Random(3), []
    for _ in range(50):
        out.append(sum(float(draw.randrange(10)) for _ in range(10)) / 10)
    out.sort()
    assert got["g"] == pytest.approx((stats.percentile_of(out, 2.5), stats.percentile_of(out, 97.5))) and got["h"] == (None, None)


def test_density(spark):
    d = lambda n, ms: one(spark, tx.content_density(F.lit(n), F.lit(ms).cast("long")))
    assert [d(15, 60000), d(300, 60000), d(450, 60000), d(5, None), d(5, 0)] == pytest.approx([0.5, 1.0, 0.5, 0.5, 0.3])


def test_repetition(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, " ".join(["x"] * 30)), (3, "one two three four five six seven eight"), (4, "")], "id long, t string")
    got = {r["id"]: r["repetition"] for r in judge.repetition(df, "id", "t").collect()}
    assert got == pytest.approx({1: 0.7, 2: 0.0, 3: 1.0, 4: 0.7})


def test_segments(spark):
    s = lambda starts: one(spark, tx.segment_quality(F.array(*(F.struct(F.lit("t").alias("text"), F.lit(float(x)).alias("start")) for x in starts))))
    assert s(range(6)) == pytest.approx(0.5) and s(range(5)) == pytest.approx(1.0)


def test_script(spark):
    m = lambda t, lang="pt": one(spark, tx.script_match(F.lit(t), F.lit(lang)))
    assert [m("ola mundo"), m("12 34"), m("漢字漢字"), m("abcабв"), m("漢字", "zh")] == [1.0, 0.5, 0.0, 0.2, 1.0]


def test_estimate(spark):
    assert [one(spark, tx.estimate_tokens(F.lit(t))) for t in ("", "ab", "abcdefg")] == [0, 1, 2]


def test_pack(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([4, 4, 4, 1])], "g long, i int, c int")
    assert [r["i"] for r in sampling.packed(df, "g", "i", "c", 9, 10).orderBy("i").collect()] == [0, 1]


def test_label(spark):
    f = lambda a, b, s: one(spark, answers.confusion_label(F.lit(a), F.lit(b), F.lit(s).cast("double")))
    assert [f(True, True, 0.7), f(True, True, None), f(False, True, 0.7), f(True, False, 0.7), f(False, False, 0.1)] == ["FA", "unknown", "TA", "TC", "FC"]


def test_model_output(spark):
    said = '<think> one </think><think>two</think> ```json\n{"rating": "0.5", "reason": "ok"}\n```'
    assert one(spark, px.thinking(F.lit(said))) == "one\ntwo" and one(spark, px.thinking(F.lit("x"))) is None
    assert tuple(one(spark, px.model_json(F.lit(said)))) == (0.5, "ok")
    assert [one(spark, px.clamp_ordinal(F.lit(v))) for v in ("9", "2", "2.5", "x")] == [5, 2, 3, 3]


@given(st.text(alphabet=" \nab.", max_size=200), st.integers(1, 30))
def test_chunks_cover(text, size):
    spans = retrieval.split_at(text, size)
    assert "".join(text[a:b] for a, b in spans) == text and all(b - a <= size for a, b in spans)


def test_lenient_json():
    found, bad = records.lenient('{"a": 1}\n{broken\n{"b":\n 2}\n[{"c": 3}, 4]')
    assert found == [{"a": 1}, {"b": 2}, {"c": 3}] and bad == 1


def test_stage_guard():
    with pytest.raises(ValueError):
        judge.Stage("s", "filter", [judge.Criterion("c", None)])


def test_khop_and_pagerank(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query int, node_id string, weight double")
    assert {(r["node_id"], r["d"]) for r in graph.khop(seeds, e, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    got = {r["node_id"]: r["rank"] for r in graph.pagerank(seeds, e, rounds=15).collect()}
    near = {"a": "b", "b": "ac", "c": "bd", "d": "c"}
    rank = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}
    for _ in range(15):
        rank = {n: (0.15 if n == "a" else 0) + 0.85 * sum(rank[m] / len(near[m]) for m in near[n]) for n in near}
    assert got == pytest.approx({k: v for k, v in rank.items() if v or k in got})


def test_seeds_come_from_the_first_path_with_any(spark):
    seeds = lambda *rows: spark.createDataFrame(rows, "query int, node_id string, weight double")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query int")
    got, how = graph.grounded(asked, (("edge_filter", seeds((1, "a", 1.0), (2, "a", 0.0))), ("node_fallback", seeds((1, "b", 1.0), (2, "b", 2.0), (3, "c", 0.0)))))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 1.0), (2, "b", 2.0)]
    assert {tuple(r) for r in how.collect()} == {(1, "edge_filter"), (2, "node_fallback"), (3, "ungrounded"), (4, "ungrounded")}
    held = graph.attributed(spark.createDataFrame([("x", "f1,concept_file,f1, f2"), ("y", "concept_file"), ("z", None)], "node_id string, file_id string"))
    assert {tuple(r) for r in held.collect()} == {("x", "f1"), ("x", "f2")}


def test_a_failing_arm_leaves_the_others(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query int, text string")
    one = lambda q, k: q.filter("query <> 2").selectExpr("query", "array(named_struct('rank', 0, 'chunk_id', 'x', 'score', 1D)) AS passages")
    bad = lambda q, k: q.selectExpr("query", "raise_error('down') AS passages")
    done = spark.createDataFrame([(3, "good")], "query int, arm string")
    rows = retrieval.retrieved(asked, {"bad": bad, "good": one}, 5, done).collect()
    assert {(r["query"], r["arm"], None if r["passages"] is None else len(r["passages"])) for r in rows} == {(1, "bad", None), (2, "bad", None), (3, "bad", None), (1, "good", 1), (2, "good", 0)}
    assert all((r["error"] is not None) == (r["arm"] == "bad") and r["elapsed_s"] >= 0 for r in rows)
    for arms, k in (({}, 5), ({"good": one}, 0)):
        with pytest.raises(ValueError):
            retrieval.retrieved(asked, arms, k)


def test_fallback(spark):
    q = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, t string")
    got = {r["id"]: (r["answer"], r["attempts"], r["abstained"]) for r in generation.answered(q, "id", lambda t, heat: "yes" if t == "good" and heat > 0.05 else None, "t").collect()}
    assert got == {1: ("yes", 2, False), 2: (None, 3, True)}


def test_files(spark, tmp_path):
    import zipfile

    run = tmp_path / "r1"
    run.mkdir()
    (run / "a.json").write_text('{"id": "r1"}')
    assert records.replicate(tmp_path, "r1", "r2") == 1 and (tmp_path / "r2/a.json").read_text() == '{"id": "r2"}'
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("../out.json", "{}")
    with pytest.raises(ValueError):
        records.import_zip(tmp_path / "z.zip", tmp_path / "in")
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec/x.json").write_text('{"file_id": "f",\n "text": "t"}')
    (tmp_path / "rec/y.json").write_text("{oops")
    got = {r["file_name"]: (r["file_id"], r["bad"] is None) for r in records.json_records(spark, str(tmp_path / "rec")).collect()}
    assert got == {"x.json": ("f", True), "y.json": (None, False)}


def test_resume(spark, tmp_path):
    from gristmill.streaming.resume import process_new

    args = (spark, str(tmp_path / "in"), "id long, v string", "*.parquet", str(tmp_path / "state"), "id", lambda r: r.select("id", F.upper("v").alias("v")), F.col("v") == "bad")
    spark.createDataFrame([(1, "a"), (2, "bad")], "id long, v string").write.parquet(str(tmp_path / "in"))
    process_new(*args)
    spark.createDataFrame([(1, "again"), (3, "c"), (3, "c")], "id long, v string").write.mode("append").parquet(str(tmp_path / "in"))
    done, failed = process_new(*args)
    assert sorted(tuple(r) for r in done.collect()) == [(1, "A"), (3, "C")] and [r["id"] for r in failed.collect()] == [2]


def test_walks_stop_early_with_the_same_rows(spark):
    import random

    draw = random.Random(5)
    names = [f"v{i}" for i in range(60)]
    arcs = sorted({(a, b) for a, b in ((draw.choice(names), draw.choice(names)) for _ in range(90)) if a != b})
    e = spark.createDataFrame([(a, b, "r") for a, b in arcs], "src string, dst string, relation string")
    kind = {v: ("entity", "event", "concept")[i % 3] for i, v in enumerate(names)}
    n = spark.createDataFrame([(v, v.upper(), kind[v], i % 9) for i, v in enumerate(names)], "node_id string, label string, type string, file_id int")
    start = {q: draw.sample(names, q) for q in (1, 2, 8)} | {9: ["nowhere"]}
    seeds = spark.createDataFrame([(q, v) for q, vs in start.items() for v in vs], "query int, node_id string")
    passages, triples = set(), set()
    for q, vs in start.items():
        d = dict.fromkeys(vs, 0)
        for hop in (1, 2):
            for a, b in arcs:
                for x, y in ((a, b), (b, a)):
                    if d.get(x) == hop - 1 and y not in d:
                        d[y] = hop
        files = {}
        for v, far in d.items():
            if v in kind:
                f = str(names.index(v) % 9)
                files[f] = min(files.get(f, 9), far)
        passages |= {(q, f, i) for i, (f, _) in enumerate(sorted(files.items(), key=lambda x: (x[1], x[0]))[:4])}
        found = [(d[a] + d[b], f"[{kind[a]}] {a.upper()} --[r]--> [{kind[b]}] {b.upper()}") for a, b in arcs if a in d and b in d and "concept" not in (kind[a], kind[b])]
        triples |= {(q, t, i) for i, (_, t) in enumerate(sorted(found)[:4])}
    assert {(r["query"], r["file_id"], r["rank"]) for r in graph.passages_near(seeds, n, e, 2, 4).collect()} == passages
    assert {(r["query"], r["triple"], r["rank"]) for r in graph.triples_near(seeds, n, e, 2, 4).collect()} == triples
    assert len(triples) > 4


def test_pagerank_keeps_blocks_and_lone_seeds_apart(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    queries = range(2 * graph.ABREAST + 3)
    rows = [(q, "a", 1.0 + q) for q in queries] + [(q, "alone", 2.0) for q in queries if q % 2]
    got = {(r["query"], r["node_id"]): r["rank"] for r in graph.pagerank(spark.createDataFrame(rows, "query int, node_id string, weight double"), e, rounds=6).collect()}
    near = {"a": "b", "b": "ac", "c": "b", "alone": ""}
    for q in queries:
        seeds = {n: w for i, n, w in rows if i == q}
        start = {n: seeds.get(n, 0.0) / sum(seeds.values()) for n in near}
        rank = start
        for _ in range(6):
            moved = {n: sum(0.85 * rank[m] / len(near[m]) for m in near[n]) for n in near}
            rank = {n: moved[n] + start[n] * (1 - sum(moved.values())) for n in near}
        assert {n: got.get((q, n), 0.0) for n in near} == pytest.approx(rank)
