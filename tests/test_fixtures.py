"""Hand-made edge rows (FIXTURES.md section 4), asserted exactly."""

import datetime as dt

from pyspark.sql import functions as F

from strata.functions.lines import lines_l1, lines_l2, lines_l3, normalize_text
from strata.operators import cache as K
from strata.operators import blocks as B
from strata.operators import blocks as B
from strata.operators import chunking as C
from strata.operators import consensus as A
from strata.operators import diffs as D
from strata.operators import langs as L
from strata.operators import scoring as G
from strata.operators import verdicts as V


def test_lang_by_extension(spark):
    names = ["a.PY", "x.h", "y.tar.c", ".py", "noext", "z.tsx", "dir.d/file", "q.py"]
    df = spark.createDataFrame([(n,) for n in names], "file_path string")
    got = dict(df.select("file_path", L.lang_of_path("file_path").alias("l")).collect())
    assert got == {"a.PY": "unknown", "x.h": "c", "y.tar.c": "c", ".py": "unknown", "noext": "unknown",
                   "z.tsx": "typescript", "dir.d/file": "unknown", "q.py": "python"}
    kept = {r.file_path for r in L.with_lang(df).collect()}
    assert kept == {"x.h", "y.tar.c", "z.tsx", "q.py"}


def test_ruleset_for_language(spark):
    df = spark.createDataFrame([("Python",), ("cobol",), ("BASH",)], "lang string")
    got = [r[0] for r in df.select(L.ruleset_for("lang")).collect()]
    assert got == ["python", "auto", "shell"]


def test_line_models(spark):
    df = spark.createDataFrame([("a\nb\n",), ("",), ("x\r\ny\x0bz",)], "t string")
    r = df.select(lines_l1("t").alias("l1"), lines_l2("t").alias("l2"), lines_l3("t").alias("l3")).collect()
    assert r[0].l1 == ["a", "b"] and r[0].l2 == ["a", "b", ""] and r[0].l3 == ["a\n", "b\n"]
    assert r[1].l1 == [] and r[1].l2 == [""] and r[1].l3 == []
    assert r[2].l1 == "x\r\ny\x0bz".splitlines()


def _chunks(spark, text, threshold):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    out = C.with_fallback_chunks(df, "text", F.lit(threshold)).select(F.explode("chunks").alias("c"))
    return [(r.c.start_line, r.c.end_line, r.c.start_ord, r.c.end_ord) for r in out.collect()]


def test_fallback_fold(spark):
    text = "def f(x):\n    if x:\n        y()\n\n    z()\nreturn"
    assert _chunks(spark, text, 40) == [(1, 5, 1, 4), (6, 6, 5, 5)]
    indents = [8, 4, 0, 0, 4, 2, 1, 0]
    text2 = "\n".join(" " * i + "x" for i in indents)
    # flush after 0-based positions 1, 4, 6; the last line is the final chunk
    assert [(c[2], c[3]) for c in _chunks(spark, text2, 3)] == [(1, 2), (3, 5), (6, 7), (8, 8)]
    assert _chunks(spark, "", 50) == [] and _chunks(spark, "  \n\t\n", 50) == []


def test_fixed_windows(spark):
    text = "\n".join(f"l{i}" for i in range(45)) + "\n"
    df = C.with_fixed_line_chunks(spark.createDataFrame([(text,)], "text string"), "text")
    cs = df.select(F.explode("chunks").alias("c")).collect()
    assert [c.c.end_line - c.c.start_line + 1 for c in cs] == [20, 20, 5]
    assert "".join(c.c.text for c in cs) == text


def test_drop_contained(spark):
    rows = [(1, 10, 1), (2, 5, 2), (10, 12, 3), (11, 20, 4), (11, 15, 5)]
    df = spark.createDataFrame([(0, s, e, i) for s, e, i in rows], "g int, s int, e int, i int")
    for bucket in (F.lit(0), F.floor(F.col("s") / 5)):  # one bucket, and a carry across buckets
        kept = sorted((r.s, r.e) for r in C.drop_contained(df, ["g"], "s", "e", "i", bucket).collect())
        assert kept == [(1, 10), (10, 12), (11, 20)]


def test_drop_trivial(spark):
    rows = [("variable_declarator", None, "a = 1", 1, 1), ("variable_declarator", None, "b" * 30, 2, 2),
            ("variable_declarator", None, "a = [\n 1]", 3, 4), ("lexical_declaration", None, "let a = 1;", 5, 5),
            ("function_definition", "class_definition", "def f():\n  x", 6, 7)]
    df = spark.createDataFrame(rows, "kind string, parent_kind string, text string, start_line int, end_line int")
    kept = sorted(r.start_line for r in C.drop_trivial(df).collect())
    assert kept == [2, 3, 5]


def test_merge_adjacent_gaps(spark):
    df = spark.createDataFrame([(["g", "g", "g", "g", "code", "g"],)], "ls array<string>")
    out = C.with_merged_gaps(df, F.col("ls"), lambda l: l == "g").select(F.explode("merged").alias("m"))
    assert [(r.m.start_line, r.m.end_line) for r in out.collect()] == [(1, 4), (5, 5), (6, 6)]


def _pack(spark, lengths, max_chars):
    pieces = [{"ord": i, "text": "x" * n} for i, n in enumerate(lengths)]
    df = spark.createDataFrame([(pieces,)], "pieces array<struct<ord:bigint,text:string>>")
    out = C.with_packed(df, "pieces", max_chars=max_chars).select(F.explode("batches").alias("b"))
    return [(r.b.first_ord, r.b.last_ord, len(r.b.text)) for r in out.collect()]


def test_packing(spark):
    assert _pack(spark, [5, 5, 5], 20) == [(0, 1, 19), (2, 2, 5)]
    assert _pack(spark, [30, 1], 20) == [(0, 0, 30), (1, 1, 1)]
    assert _pack(spark, [12], 20) == [(0, 0, 12)]


def test_cache_ttl_boundary(spark):
    as_of = dt.datetime(2024, 1, 2, 0, 0, 0)
    cache = spark.createDataFrame([(1, as_of - dt.timedelta(hours=24), 1.0),
                                   (2, as_of - dt.timedelta(hours=23, minutes=59, seconds=59), 2.0)],
                                  "k int, ts timestamp_ntz, value double")
    req = spark.createDataFrame([(1,), (2,)], "k int")
    lit = F.lit(as_of).cast("timestamp_ntz")
    assert [r.k for r in K.cache_hits(req, cache, ["k"], lit).collect()] == [2]
    assert [r.k for r in K.cache_misses(req, cache, ["k"], lit).collect()] == [1]


def test_cache_evict_ties(spark):
    t = dt.datetime(2024, 1, 1)
    cache = spark.createDataFrame([(k, t) for k in ["d", "b", "a", "c"]], "k string, ts timestamp_ntz")
    assert [r.k for r in K.cache_evict(cache, ["k"], 3).collect()] == ["a", "b", "c"]


def _hours_events(spark):
    base = dt.datetime(2024, 1, 1)
    hours = [0, 10, 23, 24, 30, 47, 48]
    return spark.createDataFrame([(1, "x", i, base + dt.timedelta(hours=h)) for i, h in enumerate(hours)],
                                 "user_id long, event_type string, event_id long, ts timestamp_ntz")


def test_ttl_dedupe_batch(spark):
    kept = K.ttl_dedupe(_hours_events(spark), ["user_id", "event_type"], "ts", "event_id")
    assert sorted(r.ts.hour + 24 * (r.ts.day - 1) for r in kept.collect()) == [0, 24, 48]


def test_upsert_last_write_wins(spark):
    t = dt.datetime(2024, 1, 1)
    w = spark.createDataFrame([("a", t, 1, 1.0), ("a", t, 2, 2.0), ("a", t - dt.timedelta(1), 3, 3.0)],
                              "k string, ts timestamp_ntz, id int, value double")
    assert [r.value for r in K.cache_upsert(w, ["k"], "ts", "value", "id").collect()] == [2.0]


VERDICT = ('{"language": "c", "is_vulnerability": true, "vulnerabilityType": "t", "cwe": "CWE-1", '
           '"vulnerabilityLines": [], "riskLevel": "High", "explanation": "e", "fixCode": "f"}')


def test_verdict_strict_parse(spark):
    raws = [f"x {VERDICT} y", VERDICT[:-1], f"{VERDICT} {VERDICT}", f"{VERDICT},{VERDICT}", "no json"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r.ok for r in V.with_parsed(df, "raw").select((F.col("verdict").isNotNull()).alias("ok")).collect()]
    assert got == [True, False, False, False, False]


def test_clip_and_guard(spark):
    df = spark.createDataFrame([("a\nb\nc", [(0, "x"), (1, "a"), (3, "c"), (4, "y")], "p\nq")],
                               "code string, lines array<struct<lineNum:int,lineCode:string>>, fix string")
    r = df.select(V.clip_lines("lines", "code").alias("k"), V.guard_fix("fix", "code").alias("g")).first()
    assert [l.lineNum for l in r.k] == [1, 3] and all(l.line_matches for l in r.k)
    assert r.g == "a\nb\nc"


def test_risk_normalisation(spark):
    cases = [("High", False, 7.0), ("HIGH", False, 7.0), ("none", False, 0.0), ("N/A", False, 0.0),
             ("5", False, 5.0), ("10", False, 10.0), ("11", False, None), ("7.5", False, None),
             ("-1", False, None), ("Severe", False, None), ("", False, None),
             ("7.5", True, 7.5), ("-0.1", True, None), ("10", True, 10.0), (None, False, None)]
    df = spark.createDataFrame([(r, n) for r, n, _ in cases], "raw string, num boolean")
    got = [r.s.risk_score for r in df.select(V.normalize_risk(F.col("raw"), F.col("num")).alias("s")).collect()]
    assert got == [c[2] for c in cases]


def test_validation_reasons(spark):
    import json
    full = json.loads(VERDICT)
    raws = []
    for f in V.REQUIRED:
        d = dict(full)
        d.pop(f)
        raws.append(json.dumps(d))
    df = V.with_parsed(spark.createDataFrame([(r,) for r in raws], "raw string"), "raw")
    reasons = [r.v.reason for r in df.select(V.validate().alias("v")).collect()]
    assert reasons == [f"missing:{f}" for f in V.REQUIRED]


def test_validation_types(spark):
    import json
    full = json.loads(VERDICT)
    line = {"lineNum": 1, "lineCode": "x"}
    cases = [("language", 5), ("is_vulnerability", "true"), ("is_vulnerability", 1), ("vulnerabilityType", ["x"]), ("cwe", 79), ("vulnerabilityLines", "none"),
             ("vulnerabilityLines", [line, {"lineNum": "1", "lineCode": "x"}]), ("vulnerabilityLines", [{"lineNum": 1.5, "lineCode": "x"}]),
             ("vulnerabilityLines", [{"lineNum": 1}]), ("vulnerabilityLines", [line, None]), ("vulnerabilityLines", [3]), ("riskLevel", True),
             ("riskLevel", {"score": 3}), ("explanation", {}), ("fixCode", 0)]
    good = [("vulnerabilityLines", []), ("vulnerabilityLines", [line, {**line, "note": None}]), ("riskLevel", 7), ("riskLevel", 7.5)]
    raws = [json.dumps({**full, f: x}) for f, x in cases + good] + [json.dumps({**full, "cwe": None})]
    df = V.with_parsed(spark.createDataFrame([(r,) for r in raws], "raw string"), "raw")
    reasons = [r.v.reason for r in df.select(V.validate().alias("v")).collect()]
    assert reasons == [f"bad_type:{f}" for f, _ in cases] + [None] * len(good) + ["missing:cwe"]


def _verdict_fns():
    """Functions of a test, which workers get by value."""
    def failing_fn(batches):
        for pdf in batches:
            if pdf["code"].str.contains("BOOM").any():
                raise ValueError("no answer today")
            out = pdf[~pdf["code"].str.contains("SILENT")]
            yield out.assign(language=out["lang"], is_vulnerability=True, cwe="CWE-1", n_lines=3, severity="low", explanation="said",
                             lines=[[1, 2, 99]] * len(out), fix="one line")[["work_key", "language", "is_vulnerability", "cwe", "n_lines", "severity", "explanation", "lines", "fix"]]

    def always_failing_fn(batches):
        raise RuntimeError("service is down")
    return failing_fn, always_failing_fn


def test_failed_calls_become_records(spark):
    from strata.operators.sinks import result_envelope
    from strata.plans.pipeline import scan_source
    failing_fn, always_failing_fn = _verdict_fns()
    code = {1: "# first\ndef f():\n    return 1", 2: "def g():\n    return 'BOOM'", 3: "def h():\n    return 'SILENT'", 4: "def g():\n    return 'BOOM'"}
    files = spark.createDataFrame([(i, "python", c) for i, c in code.items()], "file_id int, lang string, code string")
    rows = {r.file_id: r for r in scan_source(files, verdict_fn=failing_fn).collect()}
    assert len(rows) == 4 and not rows[1].failed and rows[1].is_vulnerability and rows[1].code == "def f():\n    return 1"
    assert [tuple(x) for x in rows[1].vulnerable_lines] == [(2, "def f():"), (3, "return 1")]  # lines of the file; line 99 is none of the chunk's
    assert rows[1].fix_code == rows[1].code and rows[1].error is None  # a fix of another length is no fix
    assert rows[2].error == rows[4].error == "ValueError: no answer today" and rows[3].error == "no answer"
    for i in (2, 3, 4):
        r = rows[i]
        assert (r.failed, r.is_vulnerability, r.cwe, r.n_flagged, r.vulnerable_lines, r.explanation, r.fix_code) == (True, False, "", 0, [], "Analysis failed", code[i])
    down = scan_source(files, verdict_fn=always_failing_fn)
    e = result_envelope(down, "lang", "failed", "is_vulnerability").first()
    assert (e.status, e.n_results, e.n_rejects, e.error) == ("FAILURE", 4, 4, "4 result(s) failed")


def test_cached_verdicts_are_not_called(spark):
    failing_fn, always_failing_fn = _verdict_fns()
    req = spark.createDataFrame([(i, "python", f"k{i % 3}", "[]", "x") for i in range(6)], "id int, lang string, work_key string, findings_json string, code string")
    cache = V.run_verdicts(req.where("work_key = 'k1'")).drop("code").withColumn("explanation", F.lit("cached"))
    stale = V.run_verdicts(req.where("work_key = 'k2'"), always_failing_fn).drop("code")  # a failure isn't an answer
    got = V.scan_verdicts(req, ["id"], failing_fn, cache=cache.unionByName(stale).unionByName(cache))
    assert {r.id: r.explanation for r in got.collect()} == {0: "said", 1: "cached", 2: "said", 3: "said", 4: "cached", 5: "said"}


def _votes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)],
                                 "g int, o int, flag boolean, cwe string, risk double, fix string")


def test_consensus_votes(spark):
    rows = [(True, "CWE-89", 7.0, "x"), (True, "CWE-79", 4.0, "y"), (True, "CWE-79", 9.0, ""),
            (False, "CWE-89", None, "")]
    r = A.consensus(_votes(spark, rows), ["g"], [F.col("o")]).first()
    assert (r.is_vulnerability, r.cwe, r.risk_level, r.fix_code, r.confidence) == (True, "CWE-89", 7.0, "", 0.5)
    ten = [(i < 7, None, 0.0, "") for i in range(10)]
    assert A.consensus(_votes(spark, ten), ["g"], [F.col("o")]).first().is_vulnerability is True
    six = [(i < 6, "", 0.0, "") for i in range(10)]
    r6 = A.consensus(_votes(spark, six), ["g"], [F.col("o")]).first()
    assert r6.is_vulnerability is False and r6.cwe is None


def test_severity_buckets(spark):
    vals = [3.9, 3.95, 4.0, 6.95, 8.9, 9.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "r double")
    got = [r[0] for r in df.select(A.severity_bucket("r")).collect()]
    assert got == ["low", None, "medium", None, "high", "critical", "critical"]


def test_fix_scoring(spark):
    cases = [("CWE-89", "SQL Injection", "cur.execute(q)", 'cur.execute("a=%s", (u,))', 1.0, True),
             ("CWE-78", "OS Command Injection", "os.system(c)", "subprocess.run([c], shell=False)", 1.0, True),
             ("CWE-79", "XSS", "e.innerHTML = u", "e.append(DOMPurify.sanitize(u))", 1.0, True),
             ("CWE-20", "Improper Input Validation", "x", "y", 0.533333, False),
             ("CWE-787", "other", "x", "y", 0.2, False),
             ("CWE-369", "Divide By Zero", "x", "y", 0.0, True)]
    df = spark.createDataFrame([(c, t, [(1, l)], f) for c, t, l, f, _, _ in cases],
                               "cwe string, t string, lines array<struct<lineNum:int,lineCode:string>>, fix string")
    got = [(r.s.confidence, r.s.valid) for r in df.select(G.score_fix("cwe", "t", "lines", "fix").alias("s")).collect()]
    assert got == [(c[4], c[5]) for c in cases]


def test_normalize(spark):
    df = spark.createDataFrame([("  a \n\n b",)], "t string")
    assert df.select(normalize_text("t")).first()[0] == "a\nb"


def test_snapshot_compare(spark):
    old = spark.createDataFrame([("a", 1, 0, "X"), ("a", 1, 0, "Y"), ("b", 5, 0, "Z")], "f string, l int, r int, item string")
    new = spark.createDataFrame([("a", 1, 0, "Y"), ("a", 1, 0, "W"), ("c", 9, 0, "Q"), ("c", 9, 0, "Q")],
                                "f string, l int, r int, item string")
    got = {(r.f, r.l): (r.added, r.n_added, r.removed) for r in D.compare_snapshots(old, new, ["f", "l"], "r", "item").collect()}
    assert got == {("a", 1): ("W", 1, "X"), ("c", 9): ("Q", 2, "")}
    full = D.compare_snapshots(old, new, ["f", "l"], "r", "item", include_removed=True)
    assert {(r.f, r.removed) for r in full.collect()} == {("a", "X"), ("c", ""), ("b", "Z")}


def test_knn_ties_and_self(spark):
    from strata.operators.knn import knn_exact
    vecs = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [5.0, 5.0])]
    df = spark.createDataFrame(vecs, "id long, v array<float>")
    r = knn_exact(df, "id", "v", 3).filter("query_id = 1").orderBy("rank").collect()
    assert [(x.neighbor_id, x.dist) for x in r] == [(1, 0.0), (2, 1.0), (3, 1.0)]


def test_hybrid_priority(spark):
    from strata.operators.vectors import hybrid_context
    files = spark.createDataFrame([(1, "c", [0.0, 0.0])], "file_id long, lang string, embedding array<double>")
    kb = spark.createDataFrame([(i, "c", f"kb{i}", f"t{i}", "High", [float(i), 0.0]) for i in (1, 2, 3)],
                               "kb_id int, language string, text string, vulnerability_type string, risk_level string, embedding array<double>")
    hits = spark.createDataFrame([(1, "p1", 1, "a"), (1, "p1", 2, "b"), (1, "p2", 1, "a"), (1, "p2", 3, "c")],
                                 "file_id long, pattern string, line_no int, line_code string")
    got = [(r.kind, r.text) for r in hybrid_context(files, kb, hits).orderBy("rank").collect()]
    assert got == [("semantic", "kb1"), ("semantic", "kb2"), ("semantic", "kb3"),
                   ("pattern", "Pattern match at line 1: a"), ("pattern", "Pattern match at line 2: b")]


def test_pack_parallel_equals_fold(spark):
    """The large-group path (no group collected) gives the fold's batches."""
    lengths = [0, 0, 30, 1, 5, 5, 5, 0, 12, 0, 3, 25, 0, 0, 7]
    rows = [(g, i, "x" * n) for g in (1, 2) for i, n in enumerate(lengths if g == 1 else lengths[::-1])]
    df = spark.createDataFrame(rows, "g long, o long, text string")
    fold = C.pack_groups(df, ["g"], "o", "text", max_chars=20)
    par = C.pack_groups(df, ["g"], "o", "text", max_chars=20, bound=1)
    a = sorted(tuple(r) for r in fold.collect())
    b = sorted(tuple(r) for r in par.collect())
    assert a == b and len(a) > 4


def test_pack_parallel_on_conversations(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "text")
    fold = {tuple(r) for r in C.pack_groups(conv, ["conv_id"], "turn", "text").collect()}
    par = {tuple(r) for r in C.pack_groups(conv, ["conv_id"], "turn", "text", bound=1).collect()}
    assert fold == par


def test_ttl_parallel_equals_fold(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "event_id", "ts")
    keys = ["user_id", "event_type"]
    fold = {r.event_id for r in K.ttl_dedupe(ev, keys, "ts", "event_id").collect()}
    par = {r.event_id for r in K.ttl_dedupe(ev, keys, "ts", "event_id", bound=1).collect()}
    assert fold == par and len(fold) == 685
    hours = {r.event_id for r in K.ttl_dedupe(_hours_events(spark), keys, "ts", "event_id", bound=1).collect()}
    assert hours == {0, 3, 6}


def test_user_encoder_slot(spark):
    """A user encoder runs once per worker over Arrow batches."""
    from strata.operators.vectors import encoder_udf

    def load():
        return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]
    df = spark.createDataFrame([("a b",), ("abc",)], "t string")
    got = [r[0] for r in df.select(encoder_udf(load, 2)("t")).collect()]
    assert got == [[3.0, 1.0], [3.0, 0.0]]


def test_knn_of_many_cells_equals_all_pairs(spark, monkeypatch):
    import numpy as np

    from strata.operators import knn
    rng = np.random.default_rng(4)
    vecs = np.round(8 * np.concatenate([rng.normal(c, 0.3, (60, 6)) for c in rng.normal(0, 2, (8, 6))] + [np.zeros((90, 6))])) / 8  # sums are exact
    rows = [(i * 3, v.tolist(), "ab"[i % 2] if i % 7 else "c") for i, v in enumerate(vecs)]
    frame = spark.createDataFrame([*rows, (None, [0.0] * 6, "a"), (9999, None, "a"), (9998, [0.0] * 6, None)], "id long, v array<double>, g string")
    want = {}
    for grouped in (False, True):
        for i, v, g in rows if grouped else [*rows, (9998, [0.0] * 6, None)]:
            near = sorted((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w, h in (rows if grouped else [*rows, (9998, [0.0] * 6, None)]) if not grouped or g == h)
            want[(grouped, i)] = [j for _, j in near[:4]]
    for block in (8192, 40):
        monkeypatch.setattr(knn, "BLOCK_ROWS", block)
        for group in (None, "g"):
            got = {}
            for r in knn.knn_exact(frame, "id", "v", 4, group_col=group).orderBy("query_id", "rank").collect():
                got.setdefault((group is not None, r.query_id), []).append(r.neighbor_id)
            assert got == {k: v for k, v in want.items() if k[0] == (group is not None)}
    one = spark.createDataFrame([(1, [0.0] * 6)], "id long, v array<double>")
    assert knn.knn_exact(frame.where("false"), "id", "v", 3).count() == 0 and knn.knn_exact(one, "id", "v", 3).count() == 1
    assert knn.knn_exact(frame, "id", "v", 3, queries=one.where("false")).count() == 0


def test_knn_of_many_dimensions(spark):
    import numpy as np

    from strata.operators.knn import knn_exact
    vecs = np.random.default_rng(5).normal(size=(200, 768))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, v array<float>")
    got = {r.query_id: r.neighbor_id for r in knn_exact(frame, "id", "v", 2).where("rank = 2").collect()}
    d = ((vecs.astype(np.float32).astype(float)[:, None] - vecs.astype(np.float32).astype(float)[None]) ** 2).sum(axis=2) + np.eye(200) * 1e9
    assert [got[i] for i in range(200)] == d.argmin(axis=1).tolist()


def test_blocked_scans_carry_across_blocks(spark):
    """Tiny blocks force every carry path of the blocked helpers."""
    from pyspark.sql import Window

    from strata.operators.ordered import asof_first, asof_last, blocked_running_sum
    rows = [(g, o, (o * 7 + g) % 5) for g in (1, 2) for o in range(23)]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = blocked_running_sum(df, ["g"], ["o"], F.col("v"), F.floor(F.col("o") / 2), "rs")
    want = df.withColumn("rs", F.sum("v").over(Window.partitionBy("g").orderBy("o")))
    assert sorted(map(tuple, got.select("g", "o", "rs").collect())) == sorted(map(tuple, want.select("g", "o", "rs").collect()))
    ev = spark.createDataFrame([(1, t, t) for t in (3, 4, 10, 11, 30)], "g long, t long, id long")
    pr = spark.createDataFrame([(1, t, 100 + t) for t in (0, 4, 5, 12, 31)], "g long, t long, src long")
    nxt = {r.src: r.nxt for r in asof_first(ev, pr, ["g"], 2).collect()}
    assert nxt == {100: 3, 104: 4, 105: 10, 112: 30, 131: None}
    marks = spark.createDataFrame([(1, o, o, o // 3) for o in (2, 9)], "g long, o long, id long, b long")
    probes = spark.createDataFrame([(1, o, 200 + o, o // 3) for o in (1, 2, 5, 9, 14)], "g long, o long, src long, b long")
    prev = {r.src: r.prev for r in asof_last(marks, probes, ["g"], "b").collect()}
    assert prev == {201: None, 202: 2, 205: 2, 209: 9, 214: 9}


def test_pack_parallel_small_blocks(spark):
    lengths = [0, 0, 30, 1, 5, 5, 5, 0, 12, 0, 3, 25, 0, 0, 7, 9, 9, 9, 1]
    df = spark.createDataFrame([(1, i, "y" * n) for i, n in enumerate(lengths)], "g long, o long, text string")
    fold = sorted(tuple(r) for r in C.pack_groups(df, ["g"], "o", "text", max_chars=20).collect())
    par = sorted(tuple(r) for r in C.pack_groups_parallel(df, ["g"], "o", "text", max_chars=20, block=3)
                 .select("g", "batch_no", F.col("first_ord").cast("bigint"), F.col("last_ord").cast("bigint"),
                         "n_pieces", "text").collect())
    assert fold == par


C_SRC = """/* header comment
 * with { braces }
 */
#include <stdio.h>

int a(int x) {
    return x; /* trailing { */
}
/* between */
int b(void)
{
    // { not counted
    char *s = "}";
    return 0;
}
// trailing comment
struct S { int v; };
"""

PY_SRC = """import os
# comment at col 0

def f(x):
    y = 1
# odd comment inside
    return y

class C:
    pass
"""


def test_definition_blocks_with_comments(spark):
    import duckdb

    from strata.plans.q_chunks import blocks_sql
    files = [(1, "c", C_SRC), (2, "python", PY_SRC)]
    df = spark.createDataFrame(files, "file_id long, lang string, code string")
    got = sorted((r.file_id, r.start_line, r.end_line, r.kind)
                 for r in B.block_chunks(df, ["file_id"], "code", "lang").collect())
    assert got == [(1, 6, 8, "function_definition"), (1, 10, 15, "function_definition"),
                   (1, 17, 17, "struct_specifier"), (2, 4, 7, "function_definition"), (2, 9, 10, "class_definition")]
    con = duckdb.connect()
    con.execute("CREATE TABLE src(file_id BIGINT, lang VARCHAR, code VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?, ?, ?)", files)
    sql = "WITH " + blocks_sql("files AS (SELECT * FROM src)") + " SELECT file_id, start_line, end_line, kind FROM blk"
    assert sorted(tuple(r) for r in con.execute(sql).fetchall()) == got


def test_consensus_null_group(spark):
    votes = _votes(spark, [(True, "CWE-89", 7.0, "x"), (True, "CWE-89", 8.0, "x")]).withColumn("g", F.lit(None).cast("int"))
    r = A.consensus(votes, ["g"], [F.col("o")]).first()
    assert (r.g, r.risk_level, r.fix_code, r.confidence) == (None, 8.0, "x", 1.0)


def test_snapshots_of_any_month_equal_their_oracle(spark, tmp_path):
    import duckdb

    from strata.plans.q_diffs import SNAP_SQL, q_compare_snapshots
    path = str(tmp_path / "events.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts") + F.expr("INTERVAL 47 DAYS 5 HOURS")).coalesce(1).write.parquet(path)
    got = q_compare_snapshots(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cols = ["user_id", "day_no", "hour", "n_added", "added", "n_removed", "removed"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({SNAP_SQL})").fetchall()
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(want) and any(r.n_removed for r in got)


def test_snapshot_counts_keep_duplicates_and_nulls(spark):
    old = spark.createDataFrame([("a", 1, "X"), ("a", 2, "X"), ("a", 2, "X"), ("a", 2, "Y"), ("a", 2, None), ("z", 1, "V")], "k string, r int, item string")
    new = spark.createDataFrame([("a", 1, "Y"), ("a", 1, "W"), ("a", 1, "W"), ("a", 1, None), ("a", 3, "X"), ("b", 1, "Q"), (None, 1, "N")],
                                "k string, r int, item string")
    got = {(r.k, r.r): (r.n_added, r.added, r.n_removed, r.removed) for r in D.compare_snapshots(old, new, ["k"], "r", "item", include_removed=True).collect()}
    assert got == {("a", 1): (3, "W", 3, "X"), ("a", 3): (0, "", 2, "Y"), ("b", 1): (1, "Q", 0, ""), (None, 1): (1, "N", 0, ""), ("z", None): (0, "", 1, "V")}
    assert D.compare_snapshots(old.limit(0), new.limit(0), ["k"], "r", "item").collect() == []


def test_near_copies_equal_brute_force_with_split_tokens(spark, monkeypatch):
    import random
    monkeypatch.setattr(D, "PART_TEXTS", 3)
    rnd = random.Random(5)
    # few lines in all, so that every token is frequent and every text has many neighbours
    rows = [(i, "\n".join(rnd.sample("abcdefgh", rnd.randint(1, 6)))) for i in range(120)] + [(900, None), (901, "")]
    texts = {}
    for i, t in rows:
        if t:
            texts.setdefault(t, i)
    sets = [(i, set(t.split("\n"))) for t, i in texts.items()]
    want = {(min(i, j), max(i, j)) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if 2 * len(a & b) >= len(a | b)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.near_copy_pairs(docs, "doc_id", "text").collect()
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want) > 100


def test_review_with_context_keeps_failures(spark):
    """A call that fails, a reply without JSON, a reply with lines beyond the code and a fix of another length."""
    import json

    from strata.operators.verdicts import review_with_context

    def model(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for key, request in zip(pdf["work_key"], pdf["request"]):
                if "boom" in request:
                    raise ValueError("boom")
                if "silent" not in request:
                    lines = [{"lineNum": n, "lineCode": "b"} for n in (0, 2, 9)]
                    good = {"language": "c", "is_vulnerability": True, "vulnerabilityType": "t", "cwe": "CWE-1", "vulnerabilityLines": lines,
                            "riskLevel": "High", "explanation": "known" if "hint" in request else "new", "fixCode": "one line"}
                    out.append((key, "no result" if "vague" in request else f"So: {json.dumps(good)}"))
            yield pd.DataFrame(out, columns=["work_key", "reply"])
    files = spark.createDataFrame([(1, "c", "a\nb"), (2, "c", "boom"), (3, "c", "vague"), (4, "c", "silent"), (5, "c", "a\nb"), (6, "c", None), (7, "c", "a\nb")],
                                  "id long, lang string, code string")
    context = spark.createDataFrame([(7, "- hint (Risk: Low)")], "id long, context string")
    got = {r.id: r for r in review_with_context(files, context, ["id"], "lang", "code", model).collect()}
    assert len(got) == 7
    for i, word in ((1, "new"), (5, "new"), (7, "known")):
        r = got[i]
        assert [(x.lineNum, x.line_matches) for x in r.record.vulnerabilityLines] == [(2, True)]
        assert (r.record.fixCode, r.record.explanation, r.accepted, r.risk_score, r.error) == ("a\nb", word, True, 7.0, None)
    assert got[2].record.failed and "boom" in got[2].error and got[2].record.fixCode == "boom"
    assert got[3].record.failed and got[3].reason == "bad_json" and got[3].error is None
    assert got[4].record.failed and got[4].error == "no answer"
    assert got[6].record.failed and not got[6].accepted
    assert review_with_context(files.limit(0), context, ["id"], "lang", "code", model).collect() == []


def test_work_is_done_once_per_content(spark):
    rows = [(3, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "c"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = K.dedupe_work(df, "id", "text", lambda reps: reps.select("_hash", "rep_id", F.length("text").alias("n")))
    assert sorted((r.id or 0, r.rep_id or 0, r.n) for r in got.collect()) == [(0, 0, 1), (1, 1, 1), (2, 2, 1), (2, 2, 1), (3, 2, 1), (5, 5, 0)]
    assert K.dedupe_work(df.limit(0), "id", "text", lambda reps: reps.select("_hash", "rep_id")).collect() == []


def _brute_nearest(ids, vecs, members, bounds, k):
    import numpy as np
    d2 = np.zeros((len(vecs), len(members)))
    for j in range(vecs.shape[1]):
        diff = vecs[:, j][:, None] - members[:, j][None]
        d2 += diff * diff
    out = []
    for q, row in enumerate(d2):
        near = sorted((d, m) for m, d in enumerate(row.tolist()) if np.isfinite(d) and d <= bounds[q])[:k]
        out += [(int(ids[q]), m, d) for d, m in near]
    return sorted(out)


def test_knn_sums_few_pairs_exactly(monkeypatch):
    """Rows of a block in, the k nearest out: the same as with the distances of all pairs, of which few are summed."""
    import math

    import numpy as np
    import pyarrow as pa

    from strata.operators import knn
    rng = np.random.default_rng(6)
    plain = rng.normal(size=(1500, 16)).astype(np.float32).astype(np.float64)
    odd = [np.nan, np.inf]
    cases = {"plain": plain, "far": plain + 1e7, "close": 5 + plain * 1e-9, "ties": np.round(plain[:, :3]), "long": plain * 1e30, "tiny": plain[:300] * 1e-30,
             "hot": np.concatenate([plain[:300], np.repeat(plain[:1], 1200, axis=0)]), "odd": np.concatenate([plain[:300], np.outer(odd, np.ones(16))])}
    pairs, exact = [], getattr(knn, "_exact", None)
    monkeypatch.setattr(knn, "_exact", lambda a, b, q, m: pairs.append(len(q)) or exact(a, b, q, m), raising=False)
    for name, members in cases.items():
        n = len(members)
        asked = members[rng.permutation(n)[:400]]
        for bounds in (np.full(len(asked), math.inf), np.full(len(asked), np.median((members[:-2] - members[0]) ** 2) * members.shape[1] / 2)):
            pairs.clear()
            ids = np.concatenate([np.arange(n), 10_000 + np.arange(len(asked))])
            size = len(ids)
            columns = {"grp": pa.array([""] * size), "cell": pa.array(np.zeros(size, np.int32)), "block": pa.array(np.zeros(size, np.int32)),
                       "part": pa.array(np.zeros(size, np.int32)), "role": pa.array((ids >= 10_000).astype(np.int32)), "id": pa.array(ids),
                       "vec": pa.array(np.concatenate([members, asked]).tolist()), "bound": pa.array(np.concatenate([np.zeros(n), bounds]))}
            batches = pa.table(columns).to_batches(max_chunksize=700)
            got = [tuple(r.values()) for out in knn._nearest(3)(iter(batches)) for r in out.to_pylist()]
            with np.errstate(all="ignore"):
                assert sorted(got) == _brute_nearest(ids[n:], asked, members, bounds, 3), name
            if name in ("plain", "far", "hot"):
                assert pairs and sum(pairs) < 0.1 * n * len(asked), name


def test_knn_queries_of_one_block_are_shared_by_tasks(spark, monkeypatch):
    from strata.operators import knn
    monkeypatch.setattr(knn, "BLOCK_ROWS", 50)
    seen = spark.sparkContext.accumulator(0)
    tasks = knn._nearest

    def counted(k):
        run = tasks(k)

        def nearest(batches):
            def count():
                for b in batches:
                    keys = set(zip(*(b.column(c).to_pylist() for c in ("grp", "cell", "block", "part")))) if "part" in b.schema.names else {0}
                    seen.add(len(keys))
                    yield b
            yield from run(count())
        return nearest
    monkeypatch.setattr(knn, "_nearest", counted)
    corpus = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, v array<double>")
    queries = spark.range(400).selectExpr("id", "array(id / 40.0, 0.25D) AS v")
    got = knn.knn_exact(corpus, "id", "v", 1, queries=queries).collect()
    assert len(got) == 400 and all(r.neighbor_id == min(range(10), key=lambda j: (abs(r.query_id / 40 - j), j)) for r in got)
    assert seen.value >= 400 // 50
