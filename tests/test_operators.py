"""Operators over small frames: usage, experiments, lookups, sources, sinks, streams."""

import json

from pyspark.sql import functions as F

from lexloom.functions import formatting
from lexloom.operators import experiments, lookup, repair, state, usage
from lexloom.sources import readers, sinks
from lexloom.streaming import flows, modes


def test_transcripts_skip_what_is_not_a_record(spark, tmp_path):
    line = lambda o: json.dumps(o)
    use = lambda out, cache, model=None: {"type": "assistant", "message": {"model": model, "usage": {"output_tokens": out, "cache_read_input_tokens": cache}}}
    (tmp_path / "s1.jsonl").write_text("\n".join([line(use(100, 200, "")), line({"type": "user"}), "bad{", "", "[1, 2]", "null", line(use(50, 50, "claude-sonnet-4-x")), line({"type": "assistant", "message": {"usage": {}}}), line({"type": "assistant", "message": {}})]))
    (tmp_path / "s2.jsonl").write_text(line({"type": "user"}) + "\n")
    rows = readers.transcripts(spark, str(tmp_path))
    out = usage.session_rollup(rows).collect()
    assert sorted((r["session_id"], r["output_tokens"], r["cache_read_tokens"], r["turns"], r["model"]) for r in out) == [("s1", 150, 250, 3, "claude-sonnet-4-x"), ("s2", 0, 0, 0, None)]


def test_large_files_are_read_in_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\r\n".join(f"line {i}" if i % 10 else "\t" for i in range(5000)))
    (tmp_path / "small.txt").write_text("x\n\ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        rows = df.orderBy("path", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in rows if r["path"].endswith("big.txt")] == [f"line {i}" for i in range(5000) if i % 10]
    assert [r["value"] for r in rows if r["path"].endswith("small.txt")] == ["x", "y"]


def test_documents_with_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"one\r\ntw\xff\xfeo \xe2\x82 three \xc3\xa9\r")
    (tmp_path / "b.md").write_text("fine \ufffd")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["n_bytes"]) for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("one\ntwo  three é\n", 23), "b.md": ("fine \ufffd", 8)}


def test_other_readers(spark, tmp_path):
    (tmp_path / "snap.json").write_text('{"metadata":{"model":"m","n_prompts":1},\n"prompts":["p"],"arms":{"z":["1"],"a":["2"]}}')
    snap = readers.snapshot(spark, str(tmp_path / "snap.json"))
    assert [(r["arm"], r["arm_pos"], r["output"]) for r in experiments.from_snapshot(snap).orderBy("arm_pos").collect()] == [("z", 0, "1"), ("a", 1, "2")]
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "en.txt").write_text("  one \n\n\ttwo\n")
    assert [tuple(r) for r in readers.prompt_lines(spark, str(tmp_path / "prompts")).orderBy("pos").collect()] == [("one", 1), ("two", 2)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "h.jsonl").write_text('{"ts":1,"session_id":"a","output_tokens":5}\nbad\n[1]\n{"ts":2,"session_id":"a","output_tokens":6}\n')
    assert [r["output_tokens"] for r in usage.latest_per_session(readers.history(spark, str(tmp_path / "log"))).collect()] == [6]
    files = spark.createDataFrame([("/r/a",), ("/r/a/b/c",), ("/r",)], "dir string")
    assert sorted(r["dir"] for r in readers.within(files, "/r/", 1).collect()) == ["/r", "/r/a"]
    (tmp_path / "stdin").mkdir()
    (tmp_path / "stdin" / "one").write_text('{\n  "prompt": "/terse",\n "other": 1}\n')
    (tmp_path / "stdin" / "two").write_text("no object")
    stream = readers.stream_objects(spark, str(tmp_path / "stdin"), "prompt string")
    assert [tuple(r) for r in modes.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c")).collect()] == [("/terse",)]
    texts = spark.createDataFrame([("{ // c\n \"a\": 1}",), ("nope",)], "value string")
    assert [r["settings"] is not None for r in readers.settings(texts).collect()] == [True, False]


def test_results_and_findings(spark, tmp_path):
    one = lambda **x: spark.createDataFrame([tuple(x.values())], list(x))
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id int, category string")
    path = sinks.write_result(one(model="m", trials=3), one(avg=5), rows, rows, str(tmp_path), 1000)
    assert path.endswith("benchmark_19700101_000001")
    got = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    assert got == {"metadata": {"model": "m", "trials": 3}, "summary": {"avg": 5}, "rows": [{"id": 1, "category": "a"}, {"id": 2, "category": "b"}], "raw": [{"id": 1, "category": "a"}, {"id": 2, "category": "b"}]}
    lines = spark.createDataFrame([("b.py:9: ! bug: x is y. do z.",), ("a.py:30: ! nit: p. q.",), ("none",), ("a.py:4: ! risk: r. s.",)], "value string")
    assert [(r["path"], r["line"]) for r in lookup.findings(lines).collect()] == [("a.py", 4), ("a.py", 30), ("b.py", 9)]
    files = spark.createDataFrame([(d, n, s) for d in "xyz" for n, s in (("a.original.md", 9), ("a.md", 3))], "dir string, name string, size long")
    assert sorted((r["dir"], r["place"]) for r in usage.pairs_of(files, ["z", "x", "z"]).collect()) == [("x", 2), ("z", 1)]
    calls = []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise ConnectionError
        return text.upper()

    import pandas as pd

    assert repair.rewriter(flaky, delay=0.0).func(pd.Series(["a", None])).tolist() == ["A", None] and len(calls) == 3
    prompt = spark.range(1).select(repair.fix_prompt(F.lit("o"), F.lit("c"), F.array(F.lit("e1"), F.lit("e2"))), repair.arm_prompt(F.lit("p"), F.lit("s"))).first()
    assert "- e1\n- e2" in prompt[0] and prompt[1] == "p\n\ns"


def test_a_session_in_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(state, "STRETCH", 5)
    prompts = {3: "/terse ultra", 17: "stop terse", 18: "hi", 31: "/terse", 44: "/terse-commit"}
    data = [(s, i, "message", prompts.get(i)) for s in ("a", None) for i in range(60)]
    df = spark.createDataFrame(data, "session_id string, seq long, event_type string, prompt string").repartition(3)
    now = None
    want = {}
    for i in range(60):
        now = {3: "ultra", 17: None, 31: "full", 44: "commit"}.get(i, now)
        want[i] = now
    got = state.modes(df).collect()
    assert len(got) == 120 and all(r["active_mode"] == want[r["seq"]] for r in got)


def test_savings_and_prices(spark):
    df = spark.createDataFrame([(350, "full", "claude-sonnet-4-20250514"), (350, "ultra", "claude-sonnet-4-1"), (350, "full", "other"), (350, "full", None)], "t long, mode string, model string")
    saved, dollars = usage.savings(F.col("t"), F.col("mode"), F.col("model"))
    assert [tuple(r) for r in df.select(saved, F.round(dollars, 6)).collect()] == [(650, 0.00975), (0, 0.0), (650, 0.0), (650, 0.0)]
    models = {"claude-opus-4-1-x": 75.0, "claude-opus-4-5": 25.0, "claude-opus-4-20250514": 75.0, "claude-3-5-haiku-x": 4.0, "gpt": None}
    prices = spark.createDataFrame([(i, *p) for i, p in enumerate(usage.PRICES)], "rank int, prefix string, usd_per_million double")
    rows = spark.createDataFrame([(m,) for m in models], "model string").withColumn("direct", usage.price_of(F.col("model")))
    got = usage.price_join(rows, prices).collect()
    assert {r["model"]: r["direct"] for r in got} == models == {r["model"]: r["usd_per_million"] for r in got}


HISTORY = "ts long, session_id string, mode string, model string, output_tokens long, est_saved_tokens long, est_saved_usd double, line_no int"


def test_latest_rows_and_totals(spark):
    now = 1_000_000_000
    data = [(1000, "a", None, None, 10, 185, 0.0028, 0), (2000, "b", None, None, 10, 92, 0.0014, 1), (3000, "b", None, None, 10, 371, 0.0056, 2), (3000, "b", None, None, 10, 371, 0.0056, 3)]
    df = spark.createDataFrame(data, HISTORY)
    t = usage.totals(usage.latest_per_session(df)).first()
    assert (t.sessions, t.est_saved_tokens, round(t.est_saved_usd, 4)) == (2, 556, 0.0084)
    assert {r["session_key"]: r["line_no"] for r in usage.latest_per_session(df).collect()} == {"a": 0, "b": 3}
    odd = spark.createDataFrame([(None, None, None, None, 1, 1, 0.0, 0), (None, "", None, None, 2, 2, 0.0, 1)], HISTORY)
    assert [r["output_tokens"] for r in usage.latest_per_session(odd).collect()] == [2]
    assert usage.in_window(df, now, 0).count() == 4 and usage.in_window(df, now, 1).count() == 0
    empty = usage.totals(usage.latest_per_session(df.limit(0)))
    assert tuple(empty.first()) == (0, 0, 0, 0.0)
    report = empty.select(formatting.lifetime_report(F.col("sessions"), F.col("output_tokens"), F.col("est_saved_tokens"), F.col("est_saved_usd"), F.lit(None).cast("string"))).first()[0]
    assert "No sessions logged yet" in report


def test_pairs(spark):
    files = spark.createDataFrame([("d", "x.original.md", 800), ("d", "x.md", 200), ("d", "y.original.md", 10), ("d", "y.md", 20), ("e", "x.md", 1), ("d", "z.original.md", 5)], "dir string, name string, size long")
    assert tuple(usage.pair_summary(usage.pairs(files)).first()) == (1, 800, 200, 150)
    assert usage.pairs(files, shrunk_only=False).count() == 2
    assert usage.pair_summary(usage.pairs(files.limit(0))).first()["tokens_saved"] is None


def test_experiments(spark):
    snap = spark.createDataFrame([(["p1", "p2", "p3"], {"terse": ["a b", "c d", "e"], "x": ["a", ""]})], "prompts array<string>, arms map<string,array<string>>")
    long = experiments.from_snapshot(snap)
    assert long.count() == 5
    one = experiments.distribution(spark.createDataFrame([("x", 0.5)], "arm string, v double"), ["arm"], "v").first()
    assert (one.median, one.stdev) == (0.5, 0.0)
    trials = spark.createDataFrame([(1, "n", t) for t in (1180, 1180, 1181)] + [(1, "s", t) for t in (159, 158, 160)] + [(2, "n", 387), (2, "s", 301)], "id int, arm string, tokens long")
    m = experiments.trial_medians(trials, ("n", "s"))
    assert {r["id"]: (r["normal_median"], r["short_median"], r["savings_pct"]) for r in m.collect()} == {1: (1180, 159, 87), 2: (387, 301, 22)}
    s = experiments.benchmark_summary(m).first()
    assert (s.avg_savings, s.min_savings, s.max_savings, s.avg_normal) == (54, 22, 87, 784)
    cells = experiments.combine(spark.range(3).toDF("p"), spark.createDataFrame([("a", 0), ("b", 1)], "arm string, arm_pos int"), trials=2)
    assert cells.count() == 12


def test_lookups(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/x",)], "cwd string")
    configs = spark.createDataFrame([("/a", ".terse.json", "far"), ("/a/b", ".terse.json", "second"), ("/a/b", ".terse/config.json", "first"), ("", ".terse.json", "root")], "dir string, file string, value string")
    assert {r["cwd"]: r["value"] for r in lookup.nearest(paths, configs).collect()} == {"/a/b/c": "first", "/x": "root"}
    lines = spark.createDataFrame([("a" * 64 + "  f", 0), ("B" * 64 + " *dir/f", 1), ("# no", 2)], "value string, line_no int")
    assert [tuple(r) for r in lookup.manifest(lines).collect()] == [("f", "b" * 64)]
    rules = spark.createDataFrame([(0, "p", "command:a||dir:~/b", False), (1, "q", "command:c", False), (2, "r", "dir:$HOME/b", True)], "ord int, id string, detect string, soft boolean")
    facts = spark.createDataFrame([("dir", "$HOME/b")], "kind string, value string")
    assert [r["id"] for r in lookup.detected(rules, facts).collect()] == ["p"]
    assert sorted(r["id"] for r in lookup.detected(rules, facts, ("q", "r")).collect()) == ["q", "r"]


def test_upsert_choice_and_descriptions(spark):
    old, new = spark.createDataFrame([(1, "a")], "ord int, id string"), spark.createDataFrame([(5, "a"), (2, "b"), (2, "b")], "ord int, id string")
    assert sorted(tuple(r) for r in lookup.upsert(old, new, "id").collect()) == [(1, "a"), (2, "b")]
    listed = spark.createDataFrame([(i, c) for i, c in enumerate("xyz")], "ord int, id string")
    assert sorted(r["id"] for r in lookup.selected(listed, "1, 3").collect()) == ["x", "z"] and lookup.selected(listed, "").count() == 0
    texts = spark.createDataFrame([("---\ndescription: |\n  a <b>\n---",), ("---\ndescription: fine\n---",), (None,)], "text string")
    assert [tuple(r)[1:] for r in lookup.with_description(texts).collect()] == [("a <b>", False), ("fine", True), (None, None)]
    shown = spark.range(1).select(formatting.utc_iso(F.lit(1000)), formatting.utc_stamp(F.lit(1000)), formatting.shell_quoted(F.lit("it's"))).first()
    assert tuple(shown) == ("1970-01-01T00:00:01.000Z", "19700101_000001", "'it'\\''s'")


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.env").write_text("# c\nA=1\nB=x=y\nbad\n")
    pairs = readers.dotenv(readers.lines(spark, str(tmp_path / "in")), spark.createDataFrame([("A",)], "key string"))
    assert [tuple(r) for r in pairs.collect()] == [("B", "x=y")]
    for n in ("s/one", "s/two"):
        (tmp_path / n).mkdir(parents=True)
    (tmp_path / "s/one/SKILL.md").write_text("x")
    (tmp_path / "s/two/other.md").write_text("yy")
    files = readers.listing(spark, str(tmp_path / "s"))
    assert [r["skill"] for r in readers.skills(files).collect()] == ["one"]
    assert readers.newest(files).count() == 1
    docs = spark.createDataFrame([("p", "text")], "path string, text string")
    backup, target = str(tmp_path / "backup"), str(tmp_path / "target")
    assert sinks.publish(docs, docs.withColumn("text", F.lit("t")), backup, target) == 1
    assert spark.read.parquet(target).first()["text"] == "t" and spark.read.parquet(backup).first()["text"] == "text"
    try:
        sinks.publish(docs, docs, backup, target)
        raise AssertionError("a second backup must fail")
    except Exception as e:
        assert "already exists" in str(e).lower()
    sinks.write_json(docs, str(tmp_path / "json"))
    totals = spark.createDataFrame([(1500,), (0,)], "est_saved_tokens long")
    assert [r[0] for r in sinks.summary_suffix(totals).collect()] == ["▼ 1.5k", ""]


def test_repair_loop(spark):
    pairs = spark.createDataFrame([(1, "the `a` item", "`a` item"), (2, "the `a` item", "item"), (3, "# H\nthe x.y/a", "x")], "id int, original string, compressed string")
    out = {r["id"]: (r["outcome"], r["text"]) for r in repair.repaired(pairs).collect()}
    assert out[1] == ("accepted", "`a` item") and out[2] == ("repaired", "`a` item")
    shout = repair.rewriter(lambda t: t.upper())
    assert [r[0] for r in pairs.orderBy("id").select(shout("compressed")).collect()][1] == "ITEM"


def test_repair_loop_finds_each_fact_once(spark):
    """Three texts of a row, and so three times each fact; only failed rows are repaired, also by a function in Python."""
    from lexloom.functions import markdown

    rows = [(1, "the `a` item", "`a` item"), (2, "the `a` item", "item"), (3, "# H\nthe https://x.y/a", "x"), (4, None, "x"), (5, "x", None), (6, "```\na\n```\nthe `b`", "`b`")]
    pairs = spark.createDataFrame(rows, "id int, original string, compressed string")
    plan = repair.repaired(pairs).groupBy("outcome").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(markdown.FENCED[0]) == plan.count(f"{markdown.URL}, 0)") == 3 and plan.count(markdown.HEADING) == 6 and "Filter" not in plan
    seen = lambda t: t.replace("the ", "") if t != "x" else 1 / 0
    got = {r["id"]: (r["outcome"], r["text"]) for r in repair.repaired(pairs, repair.rewriter(seen)).collect()}
    assert got == {1: ("accepted", "`a` item"), 2: ("repaired", "`a` item"), 3: ("repaired", "# H\nhttps://x.y/a"), 4: ("accepted", "x"), 5: ("accepted", None), 6: ("repaired", "```\na\n```\n`b`")}
    lost = {r["id"]: (r["outcome"], r["text"]) for r in repair.repaired(pairs, lambda c: F.lit("x")).collect()}
    assert lost == got | {i: ("restored", rows[i - 1][1]) for i in (2, 3, 6)}


MESSAGES = [("s", 0, "session.created", None), ("s", 1, "message", "/terse ultra"), ("s", 2, "message", "hello"), ("s", 3, "session.idle", None), ("s", 4, "message", "/terse-commit"), ("s", 5, "message", "stop terse"), ("s", 6, "message", "hi"), ("t", 0, "message", "x"), ("t", 1, "message", "/terse lite")]


def test_modes_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(MESSAGES, "session_id string, seq long, event_type string, prompt string")
    batch = {(r["session_id"], r["seq"]): (r["active_mode"], bool(r["emits"])) for r in state.modes(df).collect()}
    assert batch["s", 0] == ("full", False) and batch["s", 2] == ("ultra", True) and batch["s", 4] == ("commit", False) and batch["s", 6] == (None, False)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = modes.run_available(modes.mode_stream(events), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r["session_id"], r["seq"]): (r["active_mode"], r["emits"]) for r in out.collect()} == batch


def test_stream_rewrite_and_rollup(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a").write_text('plain the line\n\n{"result":{"tools":[{"name":"n","description":"The item"}]}}\n')
    stream = flows.rewrite_lines(readers.stream_lines(spark, str(tmp_path / "lines")))
    out = modes.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c1"))
    assert sorted(r[0] for r in out.collect()) == ["plain the line", '{"result":{"tools":[{"name":"n","description":"item"}]}}']
    df = spark.createDataFrame([(1, "a", None, None, 5, 7, 0.1, 0), (2, "a", None, None, 6, 9, 0.2, 1)], HISTORY)
    df.write.parquet(str(tmp_path / "h"))
    flows.rollup(spark.readStream.schema(df.schema).parquet(str(tmp_path / "h")), *(str(tmp_path / x) for x in ("hist", "latest", "sum", "c2"))).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sum")).first()["est_saved_tokens"] == 9


def test_replayed_batches_count_once(spark, tmp_path):
    history, latest, summary = (str(tmp_path / x) for x in ("hist", "latest", "sum"))
    batch = lambda *x: spark.createDataFrame([(t, s, None, None, 5, n, 0.1, i) for i, (t, s, n) in enumerate(x)], HISTORY)
    for number, rows in ((0, batch((1, "a", 7), (1, "b", 1))), (1, batch((3, "a", 20))), (1, batch((3, "a", 20))), (2, batch((2, "a", 99), (1, "c", 5))), (2, batch((2, "a", 99), (1, "c", 5)))):
        flows.merge_batch(rows, number, history, latest, summary)
    assert spark.read.parquet(history).count() == 5
    assert tuple(spark.read.parquet(summary).first())[:3] == (3, 15, 26)


def test_windows_over_a_stream(spark, tmp_path):
    times = ["2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-01 01:05:00", "2024-01-01 05:00:00"]
    df = spark.createDataFrame([(t, "x") for t in times], "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    late = spark.createDataFrame([("2024-01-01 00:20:00", "x"), ("2024-01-01 09:00:00", "x")], "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type")
    windows = modes.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "one")))
    checkpoint, out = str(tmp_path / "c"), str(tmp_path / "out")
    modes.run_available(windows, out, checkpoint)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "one"))
    got = modes.run_available(modes.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "one"))), out, checkpoint)
    assert sorted((r["window"]["start"].hour, r["n"]) for r in got.collect()) == [(0, 2), (1, 1), (5, 1)]
