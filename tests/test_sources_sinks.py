"""S1 source tree, K1/S4 result files, K4 index persistence."""

import json

from pyspark.sql import functions as F

from strata.operators.sinks import read_index, read_results, save_results, write_index
from strata.sources.sourcetree import scan_source_tree


def test_source_tree(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    (root / "vendor").mkdir()
    (root / "a.py").write_text("x = 1\r\ny = 2\n")
    (root / "pkg" / "__init__.py").write_text("")
    (root / ".hid.py").write_text("h = 1\n")
    (root / "vendor" / "v.py").write_text("v = 1\n")
    (root / "bad.py").write_bytes(b"\xff\xfe")
    (root / "n.txt").write_text("n\n")
    df = scan_source_tree(spark, str(root), [".py"], ["vendor"])
    got = {r.name: r.text for r in df.collect()}
    assert set(got) == {"a.py", "__init__.py", ".hid.py"}
    assert got["a.py"] == "x = 1\ny = 2\n"
    one_per_task = scan_source_tree(spark, str(root), [".py"], ["vendor"], files_per_task=1)
    assert one_per_task.rdd.getNumPartitions() >= 3 and one_per_task.count() == 3


def test_source_tree_by_uri(spark, tmp_path):
    """A URI with odd characters, excluded names at any depth, links that lead back, an empty and a missing root."""
    root = tmp_path / "a tree%41"
    deep = root / "x" / "y" / "z"
    deep.mkdir(parents=True)
    (root / "x" / "vendor").mkdir()
    (root / "x" / "vendor" / "v.c").write_text("v")
    (deep / "_d.c").write_text("int a;\r\n")
    (root / "h.h").write_text("")
    (root / "x" / "back").symlink_to(root)
    (root / "gone.c").symlink_to(root / "nothing")
    (root / "f.c").mkdir()
    got = {r.path: (r.size, r.text) for r in scan_source_tree(spark, root.as_uri(), [".c", ".h"], ["vendor"]).collect()}
    assert got == {f"{root.as_uri()}/x/y/z/_d.c": (8, "int a;\n"), f"{root.as_uri()}/h.h": (0, "")}
    assert scan_source_tree(spark, str(deep), [".py"]).collect() == []
    assert scan_source_tree(spark, str(tmp_path / "missing")).collect() == []


def test_c_windows_of_a_tree(spark, tmp_path):
    from strata.plans.pipeline import tree_windows
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "a.c").write_text("".join(f"line {i}\n" for i in range(45)))
    (tmp_path / "b.py").write_text("x")
    got = sorted((r.name, r.chunk_no, r.start_line, r.end_line, r.text[:7]) for r in tree_windows(spark, str(tmp_path)).collect())
    assert got == [("a.c", 0, 1, 20, "line 0\n"), ("a.c", 1, 21, 40, "line 20"), ("a.c", 2, 41, 45, "line 40")]


def test_scan_of_a_tree_in_one_flow(spark, tmp_path):
    """Tree, language, chunks, rules, cached and new verdicts, written rows and envelope; failed calls are counted."""
    from strata.operators.verdicts import VERDICT_OUT
    from strata.plans.pipeline import scan_tree
    root = tmp_path / "src"
    (root / "skip").mkdir(parents=True)
    (root / "a.py").write_text("import os\n\ndef f(x):\n    return eval(x)\n")
    (root / "b.py").write_text("def g(x):\n    return x\n")
    (root / "notes.txt").write_text("def no(): eval(1)\n")
    (root / "skip" / "c.py").write_text("def h(x):\n    return eval(x)\n")
    rows, envelope = scan_tree(spark, str(root), str(tmp_path / "out"), "r", exclude_dirs=["skip"])
    got = {r.file_path.rsplit("/", 1)[1]: r for r in rows.collect()}
    assert set(got) == {"a.py", "b.py"} and got["a.py"].is_vulnerability and not got["b.py"].is_vulnerability
    assert [(x.line, x.code) for x in got["a.py"].vulnerable_lines] == [(4, "return eval(x)")]
    assert [(e.status, e.n_results, e.n_flagged, e.n_rejects) for e in envelope.collect()] == [("SUCCESS", 2, 1, 0)]

    def broken(batches):
        raise RuntimeError("no service")
    cache = spark.createDataFrame([(got["a.py"].work_key, "python", True, "CWE-95", 1, "high", "known", [2], None, None)], VERDICT_OUT)
    rows, envelope = scan_tree(spark, str(root), str(tmp_path / "out2"), "r", exclude_dirs=["skip"], verdict_fn=broken, cache=cache)
    got = {r.file_path.rsplit("/", 1)[1]: (r.failed, r.explanation) for r in rows.collect()}
    assert got["a.py"] == (False, "known") and got["b.py"][0]
    assert [(e.status, e.n_rejects) for e in envelope.collect()] == [("FAILURE", 1)]


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("f.c", 1, [("c", True)])],
                                 "file_path string, start_line int, vulnerabilities array<struct<language:string,is_vulnerability:boolean>>")
    p = str(tmp_path / "res")
    save_results(rows, p)
    back = read_results(spark, p, envelope=False).collect()
    assert back[0].vulnerabilities[0].is_vulnerability is True
    env = tmp_path / "env.json"
    env.write_text(json.dumps({"status": "SUCCESS", "repo_name": "r", "results": [
        {"file_path": "a", "start_line": 1}, {"file_path": "b", "start_line": 2}]}, indent=2))
    assert read_results(spark, str(env)).count() == 2


def test_index_partition_pruning(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    p = str(tmp_path / "idx")
    write_index(e, p, "label")
    df = read_index(spark, p, "label", 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "label" in plan
    assert df.count() == e.filter(F.col("label") == 3).count()
