"""Operators on texts: results against brute force, and defined results for odd rows."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import bpe, exact_dedup, langid, minhash, token_files

ODD = [(1, None), (2, ""), (3, "one two three four five six"), (4, "one two three four five six"), (None, "one two three four five six"),
       (5, "ONE  two three four five six"), (6, " \n\t"), (7, "x" * 70_000), (8, "a b"), (8, "a b"), (9, "12 34 !!")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, "clash", 1.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, entry string, score double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_dedup_odd_rows(odd, none):
    rows = exact_dedup.dedup(odd, page_entries=2).collect()
    texts = [t or "" for _, t in ODD]
    assert sorted((r.doc_id or 0, r.text_sha256) for r in rows) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)
    for r in rows:
        group = [(i, t) for i, t in ODD if hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(group) and r.keep_id == max(i or -1 for i, _ in group)
    assert sum(r.kept for r in rows) == len(set(texts))
    assert exact_dedup.dedup(none).collect() == []


def test_dedup_equals_its_sql_on_odd_rows(spark, tmp_path):
    """Repeated rows, null ids beside others and alone."""
    import duckdb

    from strata.llm.oracles import SQL
    rows = [*ODD, (None, "alone"), (None, "alone"), (12, "alone too"), (12, "alone too"), (-4, "alone too")]
    path = str(tmp_path / "documents.parquet")
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    frame.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({SQL['op2_exact_dedup']})").fetchall()
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_directory_splits_only_overfull_buckets():
    counts = [(p, 100 if p == 5 else 1, 10) for p in range(16)]
    buckets = exact_dedup.directory(counts, 4, 8, 1 << 20)
    assert (5, 4) in buckets and sum(1 << (4 - d) for _, d in buckets) == 16
    assert [b for b, _ in buckets] == sorted(b for b, _ in buckets) and (8, 1) in buckets


def test_chain_tells_texts_of_one_hash():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"h": [1, 1, 1, 2], "entry": ["a", "b", "c", "d"], "top_id": [1, 9, 3, 4], "n": [1, 2, 3, 4], "text": ["x", "y", "x", "x"]})
    out = {r["entry"]: r for b in exact_dedup._own(iter([batch])) for r in b.to_pylist()}
    assert out["a"]["group_size"] == out["c"]["group_size"] == 4 and out["a"]["keep_id"] == 3 and out["a"]["keeper"] == "c"
    assert out["b"]["group_size"] == 2 and out["d"]["group_size"] == 4


def links_of(docs, size, percent=80):
    """Smallest reachable id by comparing all pairs."""
    sets = {}
    for i, t in docs:
        w = tuple((t or "").encode().lower().split())
        sets[i] = {w[k:k + size] for k in range(len(w) - size + 1)} or ({w} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_groups_equal_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    docs = []
    base = [rng.choice(words) for _ in range(60)]
    for i in range(120):
        t = list(base) if i % 2 else [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, " ".join(t)))
    docs += [(200 + i, docs[i][1].upper()) for i in range(0, 60, 7)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(spark.createDataFrame(docs, "doc_id bigint, text string"), size=4).collect()}
    assert got == links_of(docs, 4)


def test_near_groups_odd_rows(odd, none):
    rows = minhash.groups(odd).collect()
    assert len(rows) == len(ODD)
    at = {r.doc_id: r for r in rows}
    assert at[1].n_shingles == at[2].n_shingles == at[6].n_shingles == 0 and at[1].component_id == 1
    assert at[4].component_id == at[5].component_id == 3 and not at[4].kept and at[3].kept and at[7].n_shingles == 1
    assert at[None].kept and at[None].component_id is None
    assert minhash.groups(none).collect() == []


def test_word_hashes_dont_depend_on_chunks(monkeypatch):
    data = b" ".join(b"word%d" % (i % 50) for i in range(400))
    whole = minhash.word_hashes(data)
    monkeypatch.setattr(minhash, "CHUNK", 64)
    assert (minhash.word_hashes(data) == whole).all() and len(set(whole.tolist())) == 50


# ---------------------------------------------------------------- token ids

@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.Codec.from_file(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def by_tiktoken():
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.text(st.sampled_from("ab Ae.,'s\n\t 12é日😀\u00a0!"), max_size=60) | st.text(max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe_equals_tiktoken(codec, by_tiktoken, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(codec.texts([text])[0], dtype=bpe.IDS)
    assert ids.tolist() == by_tiktoken.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_long_pre_tokens(codec, by_tiktoken):
    for text in ("a" * 5000, "ab" * 3000, "thethe" * 2000, "\n" * 999, "é" * 1500):
        assert codec.merge([text.encode()])[0] == by_tiktoken._core_bpe.encode_single_piece(text.encode())


def test_rank_queue_gives_lowest_rank_first():
    q, rng = bpe.RankQueue(10_000), random.Random(1)
    items = [(rng.randrange(10_000), i) for i in range(500)]
    for r, i in items:
        q.push(r, i)
    out = []
    while (top := q.pop()) is not None:
        out += [(top[0], i) for i in top[1]]
    assert out == sorted(items)


def test_bpe_frames(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert sorted((bytes(r.decoded), r.text or "") for r in back) == sorted(((t or "").encode(), t or "") for _, t in ODD)
    assert back[0].entry == "clash" and bpe.digests(none, path, public_tokenizers.PATTERN, ["doc_id"]).collect() == []
    rows = bpe.digests(odd.withColumnRenamed("score", "n_tokens"), path, public_tokenizers.PATTERN, ["doc_id"]).collect()
    assert {r.decoded_sha256 for r in rows} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD}


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_pieces_equal_whole_texts(text):
    from tokenizers import Tokenizer
    text = text.encode("utf-8", "ignore").decode()
    if not hasattr(test_pieces_equal_whole_texts, "tok"):
        test_pieces_equal_whole_texts.tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        test_pieces_equal_whole_texts.tok.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        got = token_files.library_encoder(f.read(), 2)([text])[0]
    assert np.frombuffer(got, dtype="<u2").tolist() == test_pieces_equal_whole_texts.tok.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, odd, none):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    folder, keys = token_files.write_shards(odd, public_tokenizers.path("byte_bpe_50k.json"), 2, shard_docs=3)
    rows = sorted(token_files.read_digests(spark, folder, keys).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    at, texts = 0, {(i or 0): t or "" for i, t in ODD}
    for r in rows:
        ids = [*tok.encode(texts[r.doc_id or 0], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    shard = token_files.Shard(folder, 0)
    asked = token_files.key_hash(np.arange(10**6, 10**6 + 999), np.zeros(999, bool), np.zeros(999, np.int64))
    assert not shard.find(asked)[0].any()
    folder, keys = token_files.write_shards(none, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_files.read_digests(spark, folder, keys).collect() == []


def test_writer_holds_no_ids(tmp_path):
    import tracemalloc

    import pyarrow as pa

    def batches():
        for i in range(60):
            payload = np.full(1 << 19, i, dtype="<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([7 if i < 50 else i, i + 100 if i >= 50 else 7]), pa.array([0, 0], pa.int32()),
                                              pa.array([payload, payload[:2]])], names=["doc_id", "shard", "ids"])
    tracemalloc.start()
    keys = pa.Table.from_batches(token_files._write(str(tmp_path), 2, 2)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 < (tmp_path / "shard-000000.ids").stat().st_size
    assert keys.column("ordinal").to_pylist()[:100] == [*range(100)] and keys.num_rows == 120
    shard = token_files.Shard(str(tmp_path), 0)
    known, starts, counts = shard.find(token_files.key_hash(np.array([7, 7, 59]), np.zeros(3, bool), np.array([0, 99, 0])))
    assert known.all() and counts.tolist() == [1 << 19, 1, 1 << 19] and set(shard.ids(int(starts[2]), 9).tolist()) == {59}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), dtype=np.uint64)
    assert sorted(token_files.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


# ---------------------------------------------------------------- languages

def test_kneser_ney_probabilities():
    from collections import Counter
    text = "   abracadabra abba"
    model = langid.build({"x": Counter(text[i:i + 3] for i in range(len(text) - 2))}, 3)
    # over all known characters and the unknown one, probabilities after a context sum to 1
    for ctx in ("ab", "br", "zz"):
        total = 0.0
        for c in [*sorted(set(text)), "\u4e00"]:
            codes = np.array([ord(x) for x in ctx + c], dtype=np.uint32)
            total += float(np.exp(model._score(codes)[-1, 0]))
        assert abs(total - 1) < 0.02, ctx


def plain_kneser_ney(counts, order):
    """P(character | context) by the textbook's recursion over dictionaries."""
    levels = [counts]
    while len(levels) < order:
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    discounts, total, kinds = [], [Counter() for _ in levels], [Counter() for _ in levels]
    for level, t, k in zip(levels, total, kinds):
        once, twice = (sum(v == n for v in level.values()) for n in (1, 2))
        discounts.append(min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5)
        for g, c in level.items():
            t[g[:-1]] += c
            k[g[:-1]] += 1

    def p(ctx, c):
        n = len(ctx)
        lower = p(ctx[1:], c) if n else 1 / (len(levels[0]) + 1)
        if not total[n][ctx]:
            return lower
        return (max(levels[n][ctx + c] - discounts[n], 0) + discounts[n] * kinds[n][ctx] * lower) / total[n][ctx]
    return p


def test_language_model_equals_a_plain_scorer():
    rng, order, counts = random.Random(1), 4, {}

    def marked(t):
        return "\0" * (order - 1) + re.sub("[^a-z\u4e00é]+", " ", t.lower()).lstrip()

    for lang, letters in (("a", "abcde "), ("b", "cdefg "), ("c", "xyzab ")):
        said = [marked("".join(rng.choices(letters, k=60))) for _ in range(4)]
        counts[lang] = Counter(t[i:i + order] for t in said for i in range(len(t) - order + 1))
    model, plain = langid.build(counts, order), {lang: plain_kneser_ney(c, order) for lang, c in counts.items()}
    texts = ["".join(rng.choices("abcdefgxyzQ é,\u4e00", k=rng.randint(1, 30))) for _ in range(200)]
    found, sizes, _ = model.entropies(texts)
    for t, row, n in zip(texts, found, sizes):
        s = marked(t)
        assert n == len(s) - order + 1
        if not n:
            assert not row.any()
            continue
        want = [-sum(np.log(plain[x](s[i - order + 1:i], s[i])) for i in range(order - 1, len(s))) / n for x in model.languages]
        assert np.allclose(row, want, atol=1e-4), t
        assert model.languages[row.argmin()] == model.languages[int(np.argmin(want))] or np.ptp(want) < 1e-3


def test_fold_closes_entries_of_copies(monkeypatch):
    from types import SimpleNamespace

    import pyspark
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(exact_dedup, "HELD_ROWS", 100)
    batches = [pa.record_batch({"doc_id": pa.array(range(i, i + 50)), "text": pa.array(["copy"] * 49 + [None])}) for i in range(0, 1000, 50)]
    made = list(exact_dedup._fold(iter(batches)))
    assert sum(b.num_rows for b in made) == 1000 and max(b.num_rows for b in made) == 100
    assert all(len(set(b.column("entry").to_pylist())) == 2 and b.column("text").null_count == 98 for b in made)


def test_bpe_memory_of_a_very_long_pre_token(codec):
    import tracemalloc
    data = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=300_000)).encode()
    tracemalloc.start()
    try:
        codec.merge([data])
        assert tracemalloc.get_traced_memory()[1] < 40 * len(data)
    finally:
        tracemalloc.stop()


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    rows = langid.identify(docs.where("doc_id % 2 = 1"), model).select("lang", "lang_pred", "score", "rejected").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and not any(r.rejected for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    odd_rows = langid.identify(odd, model).collect()
    for r in odd_rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and (r.lang_pred != "und" or r.rejected and r.score == 0)
    other = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5)], "doc_id bigint, text string")
    assert langid.identify(other, model).first().rejected
    assert langid.identify(none, model).collect() == []
    assert {r.lang_pred for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}
    long = "the cat and the dog " * 200_000
    assert abs(model.entropies([long])[0] - model.entropies([long[:len(long) // 8]])[0]).max() < 0.01


def test_near_copies_of_an_id_with_several_texts(spark):
    """An id with two texts joins the partners of both."""
    one, two = ([f"{p}{n}" for n in range(120)] for p in "xy")
    rows = [(1, " ".join(one + ["end"])), (5, " ".join(one)), (5, " ".join(two)), (9, " ".join(two + ["end"])), (12, "other words stand alone here now")]
    got = minhash.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "component_id").distinct().collect()
    assert {tuple(r) for r in got} == {(1, 1), (5, 1), (9, 1), (12, 12)}


def test_near_copies_that_no_star_or_neighbour_edge_tests(spark, monkeypatch):
    """Links inside a bucket don't depend on the edges that stars and neighbours happen to propose."""
    base, rows = [f"w{n}" for n in range(200)], []
    for i in range(60):  # a family just under 80 %; every tenth has one partner above it
        own = [f"d{i}x{n}" for n in range(26)]
        rows.append((i, " ".join(base + own)))
        if i % 10 == 3:
            rows.append((100 + i, " ".join(base + own[:5] + [f"e{i}x{n}" for n in range(21)])))
    rows += [(200, " ".join(base[:120])), (200, " ".join(f"v{n}" for n in range(90))), (201, " ".join(base[:125]))]
    star, further = minhash.star, minhash.candidates
    monkeypatch.setattr(minhash, "star", lambda *args: star(*args).where("false"))
    monkeypatch.setattr(minhash, "candidates", lambda *args: further(*args).where("false"))
    monkeypatch.setattr(minhash, "BLOCK", 16, raising=False)  # buckets of several blocks
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.groups(docs).collect()}
    assert got == {i: 200 if i >= 200 else i - 100 if i >= 100 else i for i, _ in rows}


def test_language_model_covers_every_labelled_language(spark):
    """Languages of few rows, and of few very long ones, are counted and calibrated."""
    words = {"en": "the cat and the dog ", "de": "der Hund und die Katze ", "ru": "кошка и собака вместе ", "el": "η γάτα και ο σκύλος "}
    rows = [(f"{lang}{i}", words[lang] * times, lang) for lang, n, times in (("en", 400, 30), ("de", 2, 30), ("ru", 6, 20_000), ("el", 1, 30)) for i in range(n)]
    rows += [(f"en-long{i}", words["en"] * 50_000, "en") for i in range(3)] + [("none", "12 34", "xx")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["de", "el", "en", "ru"]
    drawn = langid.draw(docs.select("lang", "text", docs.doc_id.alias("key")), 1_200_000)
    got = {(r["lang"], r["counts"]): r["count"] for r in drawn.groupBy("lang", "counts").count().collect()}
    assert got["de", True] == got["de", False] == got["el", True] == 1 and got["ru", True] == got["ru", False] == 3
    assert min(got["en", True], got["en", False]) >= langid.LEAST_ROWS
