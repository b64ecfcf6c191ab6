"""Independent plain-Python checks for queries without an SQL oracle."""


from pyspark.sql import functions as F

from conftest import SF_SMALL
from strata.functions.dims import SPLIT_OVERLAP, SPLIT_SEPARATORS, SPLIT_SIZE


def _segments(text, lo, hi, seps, size):
    if hi - lo <= size or not seps:
        return [(lo, hi)]
    cuts, j = [lo], text.find(seps[0], lo + 1, hi)
    while j != -1:
        cuts.append(j)
        j = text.find(seps[0], j + len(seps[0]), hi)
    return [x for a, b in zip(cuts, [*cuts[1:], hi]) for x in _segments(text, a, b, seps[1:], size)]


def _plain_pieces(text, size, overlap, seps):
    """(start, end) of the pieces of a text: close when the next span doesn't fit, go on with what may be repeated."""
    if not text:
        return []
    pieces, cur = [], []
    for lo, hi in _segments(text, 0, len(text), seps, size):
        if cur and hi - cur[0][0] > size:
            pieces.append((cur[0][0], cur[-1][1]))
            cur = [s for s in cur if lo - s[0] <= overlap and hi - s[0] <= size]
        cur.append((lo, hi))
    return [*pieces, (cur[0][0], cur[-1][1])]


def test_recursive_split(spark):
    import random

    from strata.operators import splitter
    rnd = random.Random(3)
    texts = [None, "", "a", "\n", "x" * 2000, ";" * 1500, "\n" * 1501, "ü;ß\n" * 400, "ab;" * 3000]
    for _ in range(150):
        words = ["\n\n", "\n", ";", "\n\n\n", " ", "é" * rnd.randint(1, 30), "w" * rnd.randint(1, 300)]
        texts.append("".join(rnd.choices(words, [1, 3, 3, 1, 5, 6, 1], k=rnd.randint(1, 400))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    # a small size, so that many blocks of spans are folded, and the production one
    for size, overlap, block in ((SPLIT_SIZE, SPLIT_OVERLAP, 512), (40, 8, 7), (5, 0, 3)):
        splitter.BLOCK_SPANS, before = block, splitter.BLOCK_SPANS
        try:
            got = splitter.with_recursive_pieces(df, "text", size, overlap).collect()
        finally:
            splitter.BLOCK_SPANS = before
        for r in got:
            want = _plain_pieces(r.text, size, overlap, SPLIT_SEPARATORS)
            assert [(p.start, p.end, p.text) for p in r.pieces] == [(a, b, r.text[a:b]) for a, b in want], (r.doc_id, size)
            for (a0, b0), (a1, b1) in zip(want, want[1:]):
                assert a0 < a1 <= b0 and b0 - a1 <= overlap
            for a, b in want:
                assert b - a <= size or not any(s in r.text[a + 1:b] for s in SPLIT_SEPARATORS)


def test_recall_of_approximate_neighbours(spark, catalog):
    """Against brute force over all vectors, for every query."""
    import numpy as np
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
        vecs, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
        want = set()
        for q in np.flatnonzero(ids % 50 == 0):
            d = ((vecs - vecs[q]) ** 2).sum(axis=1)
            want |= {(ids[q], ids[j]) for j in np.lexsort((ids, d))[:3]}
        got = catalog.QUERIES["knn_approximate"](spark, sf).collect()
        assert len(got) == len(want) and len(want) >= 30
        assert len({(r.query_id, r.neighbor_id) for r in got} & want) >= 0.9 * len(want)


def test_ttl_stream_equals_batch(spark, catalog):
    a = {tuple(r) for r in catalog.QUERIES["ttl_dedupe_stream"](spark, SF_SMALL).collect()}
    b = {tuple(r) for r in catalog.QUERIES["ttl_dedupe"](spark, SF_SMALL).collect()}
    assert a == b and len(a) == 685


def test_ttl_stream_across_batches(spark, tmp_path):
    """Several micro-batches (one file each): state carries the anchor."""
    import datetime as dt
    from strata.session import scratch_path
    from strata.streaming.ttl import run_to_table, ttl_dedupe_stream
    base = dt.datetime(2024, 1, 1)
    hours = [0, 10, 23, 24, 30, 47, 48]
    src = str(tmp_path / "in")
    for i, h in enumerate(hours):
        spark.createDataFrame([(1, "x", i, base + dt.timedelta(hours=h))],
                              "user_id long, event_type string, event_id long, ts timestamp_ntz") \
            .write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "t")
    kept = run_to_table(spark, ttl_dedupe_stream(stream, ["user_id", "event_type"]), out + "/o", out + "/c")
    assert sorted(r.event_id for r in kept.collect()) == [0, 3, 6]

def _event_table(spark, tmp_path, events):
    events.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_stream_reads_a_directory_of_part_files(spark, catalog, tmp_path):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    folder = _event_table(spark, tmp_path, events.repartition(5, "event_id"))
    got = sorted(map(tuple, catalog.QUERIES["ttl_dedupe_stream"](spark, folder).collect()))
    assert got == sorted(map(tuple, catalog.QUERIES["ttl_dedupe"](spark, f"{SF_SMALL}").collect())) and got


def test_stream_of_an_empty_table(spark, catalog, tmp_path):
    folder = _event_table(spark, tmp_path, spark.read.parquet(f"{SF_SMALL}/events.parquet").where("false"))
    assert catalog.QUERIES["ttl_dedupe_stream"](spark, folder).collect() == []


def test_near_copies_of_short_lines(spark):
    from strata.operators.diffs import near_copy_pairs
    rows = [(1, "a\nb\nc"), (2, "a\nb\nd"), (3, "x\n\ny"), (4, "a\nb\nc"), (5, None), (6, ""), (7, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in near_copy_pairs(docs, "doc_id", "text").collect()] == [(1, 2, 3, 3, 2)]
    assert near_copy_pairs(docs, "doc_id", "text", min_len=2).collect() == []


def test_every_exact_copy_has_its_representative(spark, catalog, tmp_path):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nd"), (4, "a\nb\nc"), (5, None), (6, ""), (7, None), (9, "a\nb\nc"), (10, "a\nb\nd")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    members = {r.doc_id: r.rep_id for r in catalog.QUERIES["near_copy_members"](spark, str(tmp_path)).collect()}
    assert members == {1: 1, 2: 2, 4: 1, 5: 5, 6: 6, 7: 5, 9: 1, 10: 2}
    pairs = {(r.id_a, r.id_b) for r in catalog.QUERIES["near_copy_pairs"](spark, str(tmp_path)).collect()}
    assert pairs and {i for p in pairs for i in p} <= set(members.values())


def test_stream_bounds_the_rows_of_a_key(spark, catalog, tmp_path, monkeypatch):
    """A key of most rows, in files of no order, comes in several micro-batches of bounded size."""
    from strata.streaming import ttl
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("user_id", F.when(F.col("event_id") % 4 > 0, 1).otherwise(F.col("user_id")))
    folder = _event_table(spark, tmp_path, events.repartition(5, "event_id"))
    monkeypatch.setattr(ttl, "SLICE_ROWS", events.count() // 3, raising=False)
    runs, run = [], ttl.run_to_table
    monkeypatch.setattr(ttl, "run_to_table", lambda *args: runs.append(1) or run(*args))
    got = sorted(map(tuple, catalog.QUERIES["ttl_dedupe_stream"](spark, folder).collect()))
    assert got == sorted(map(tuple, catalog.QUERIES["ttl_dedupe"](spark, folder).collect())) and got
    assert len(runs) >= 3


def test_ttl_stream_calls_python_per_bucket(spark, tmp_path, monkeypatch):
    """Calls don't grow with keys; null keys and keys beyond 2**53 keep their values."""
    from pyspark.sql import functions as F

    from strata.operators import cache as K
    from strata.streaming import ttl
    calls = spark.sparkContext.accumulator(0)
    make = ttl._ttl_fn

    def counted(*args):
        run = make(*args)

        def fn(*group):
            calls.add(1)
            yield from run(*group)
        return fn
    monkeypatch.setattr(ttl, "_ttl_fn", counted)
    monkeypatch.setattr(ttl, "BUCKETS", 8, raising=False)
    big = F.lit(2**53)
    rows = spark.range(3000).select(F.when(F.col("id") % 500 != 3, big + F.col("id") % 1000).alias("user_id"), F.lit("a\"b").alias("event_type"),
                                    F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 60)").alias("ts"))
    keys = ["user_id", "event_type"]
    got = ttl.run_in_order(spark, rows, lambda stream: ttl.ttl_dedupe_stream(stream, keys), str(tmp_path))
    known = K.ttl_dedupe(rows.where("user_id is not null"), keys, "ts", "event_id")
    kept = {(r.user_id, r.event_type, r.event_id) for r in got.collect()}
    assert {r for r in kept if r[0] is not None} == {(r.user_id, r.event_type, r.event_id) for r in known.collect()}
    assert (None, "a\"b", 3) in kept and calls.value <= 8 * 3
