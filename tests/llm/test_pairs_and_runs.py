"""Alignment, n-gram join and periodic runs: results against brute force, and defined results for odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from strata.llm import alignment, linking, minhash, ngram_join, periodic, queries
from test_text_operators import ODD, links_of

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, entry string, score double, start string, runs int, label string, n int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1.0, "s", 7, "l", 3) for i, t in ODD], FIELDS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def families(seed, n, edits, long=80):
    """Texts of a family that differ in a few words, others of their own, and copies in capitals."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base, docs = [rng.choice(words) for _ in range(long)], []
    for i in range(n):
        t = list(base) if i % 2 else [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(*edits)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, " ".join(t)))
    return docs + [(1000 + i, docs[i][1].upper()) for i in range(0, n // 4, 7)]


# ---------------------------------------------------------------- n-gram join

@pytest.mark.parametrize("rows", [2048, 16])
def test_join_equals_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(linking, "BLOCK_ROWS", rows)
    docs = families(5, 240, (0, 5))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == links_of(docs, 5)


def test_minhash_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK_ROWS", 16)
    docs = families(6, 200, (1, 5))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(spark.createDataFrame(docs, "doc_id bigint, text string"), size=4).collect()}
    assert got == links_of(docs, 4)


def test_join_odd_rows(odd, none):
    rows = ngram_join.join(odd).collect()
    assert len(rows) == len(ODD)
    at = {r.doc_id: r for r in rows}
    assert at[1].n_shingles == at[2].n_shingles == at[6].n_shingles == 0 and at[1].component_id == 1 and at[2].component_id == 2
    assert at[4].component_id == at[5].component_id == at[3].component_id == 3 and at[7].n_shingles == 1 and at[8].component_id == 8
    assert at[None].component_id is None and at[None].n_shingles == 2
    assert ngram_join.join(none).collect() == []


def test_join_links_an_id_by_any_of_its_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (4, "other words that nothing else has"), (1, a), (2, b)]
    got = {(r.doc_id, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_large_family_just_under_the_bound(spark):
    """Thousands of texts of one base, each pair a little too far apart, but for two that a chain joins."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(3000):
        t = list(base)
        for p in rng.sample(range(8, 100, 8), 3):
            t[p] = f"own{i}-{p}"
        docs.append((i, " ".join(t)))
    near = docs[17][1].split()
    near[99] = "last"
    docs.append((5000, " ".join(near)))
    got = Counter(r.component_id for r in ngram_join.join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    sets = [minhash.shingles(t, 5) for _, t in docs]
    ids = [i for i, _ in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    has = np.zeros((len(docs), codes.max() + 1), dtype=np.int8)
    for x in range(len(docs)):
        has[x, codes[cuts[x]:cuts[x + 1]]] = 1
    has = has[:, has.sum(axis=0) > 1].astype(np.float32)
    both = (has @ has.T).astype(np.int64)
    for x, y in zip(*np.nonzero(np.triu(100 * both >= 80 * (sizes[:, None] + sizes[None] - both), 1))):
        a, b = find(x), find(y)
        up[max(a, b)] = min(a, b)
    assert got == Counter(ids[find(x)] for x in range(len(docs))) and got[17] >= 2


def test_joining_gives_a_spanning_forest():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 25).astype(np.uint64)) for _ in range(60)]
    size, label = np.array([len(s) for s in sets]), rng.integers(0, 20, 60)

    def parts(pairs):
        up = {int(x): int(x) for x in label}
        for x, y in pairs:
            a, b = up[int(label[x])], up[int(label[y])]
            up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
        return up
    similar = [(x, y) for x, y in itertools.combinations(range(60), 2)
               if 100 * len(np.intersect1d(sets[x], sets[y])) >= 60 * len(np.union1d(sets[x], sets[y]))]
    found = linking.joining(label, size, sets, None, 60)
    assert parts(found) == parts(similar) and len(found) == len(set(label.tolist())) - len(set(parts(similar).values()))
    side = np.arange(60) < 30
    across = linking.joining(label, size, sets, side, 60)
    assert parts(across) == parts([(x, y) for x, y in similar if side[x] != side[y]])


# ---------------------------------------------------------------- periodic runs

def brute_runs(w, exponent, least):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, exponent * q):
                found.append((s, i + q - s, q))
            i += i == s
    return sorted(((s, n, q) for s, n, q in found if not any(x <= s and x + m >= s + n and p < q and q % p == 0 for x, m, p in found)),
                  key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 10])
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 6)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    return w


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_runs_equal_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(periodic, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(300):
        docs = [periodic_words(rng) for _ in range(3)]
        for exponent, least in ((2, 0), (3, 0), (4, 6)):
            got = periodic.runs_by_text([np.array(w, dtype=np.int64) for w in docs], exponent, least)
            assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(w, exponent, least) for w in docs]


def test_runs_of_very_long_texts():
    rng = np.random.default_rng(1)
    long = np.tile(rng.integers(0, 5000, 20_000), 10)
    found = periodic.runs_by_text([long, np.zeros(100_000, np.int64), rng.integers(0, 9, 200_000)], 4, 6)
    assert found[0].tolist() == [[0, 200_000, 20_000]] and found[1].tolist() == [[0, 100_000, 1]]


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{x}" for x in periodic_words(rng))) for i in range(400)] + list(ODD) + [(None, "a a a a a a a"), (17, "ü  b " * 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w))]
        runs = brute_runs(w, 4, 6)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[(i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
              hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
              hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())] += 1
    assert got == want and any(r[1] for r in got)


def test_runs_odd_rows(odd, none):
    out = periodic.find_runs(odd)
    assert len(out.columns) == len(set(out.columns)) and {"lang", "label", "entry"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.n_runs == 0 and r.runs == [] and r.start is None for r in rows)
    assert {r.collapsed for r in rows if r.doc_id in (1, 2, 6)} == {""}
    assert periodic.find_runs(none).collect() == []


# ---------------------------------------------------------------- alignment

@pytest.fixture(scope="module")
def files():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner(files):
    return alignment.Aligner(*(open(f, "rb").read() for f in files))


@pytest.fixture(scope="module")
def plain(files, aligner):
    """Tokens, groups and links of one text, by offsets in sets."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=files[1])

    def align(text):
        if not text:
            return [], [], [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = [[aligner.a.tokens[i] for i in ids[0]], [aligner.b.tokens[i] for i in ids[1]]]
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            return [], [], [], []
        ends = [list(itertools.accumulate(map(len, s))) for s in spelled]
        groups, links, last = [], [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for i, e in zip(ids[x], ends[x]) if last < e <= cut] for x in (0, 1)])
            last = cut
        links = [(i, j) for i, e in zip(ids[0], ends[0]) for j in [dict(zip(ends[1], ids[1])).get(e)] if j is not None]
        return ids[0], ids[1], groups, links
    return align


STRANGE = [None, "", " ", "a", "  two  spaces", " before", "behind ", "\n", "a\nb\n\nc", "x" * 3000, "日本語 テスト😀 é", "▁as it is", "<s> </s> <0x0A> <|endoftext|>",
           "tab\tx", " nb", "ﬁ①", "The quick brown fox\njumps over the lazy dog."]


def said(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


def test_alignment_equals_offsets_in_sets(aligner, plain):
    rng = random.Random(2)
    texts = STRANGE + ["".join(rng.choice("ab Ae.,'s\n\t 12é日😀 !") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    made = aligner([t or "" for t in texts])
    for i, (t, groups, links) in enumerate(zip(texts, made.groups(), made.links())):
        a, b, want, pairs = plain(t)
        assert groups == said(want) and sorted(links.tolist()) == sorted((x << 32) + y for x, y in pairs), t
        assert (np.diff(made.first[0])[i], np.diff(made.first[1])[i], made.n_groups()[i]) == (len(a), len(b), len(want))


def test_overlaps_equal_all_pairs(aligner):
    made = aligner(["The unbelievable", "  antidisestablishmentarianism, naïve", "x"])
    (s0, s1), (e0, e1) = made.starts, made.ends
    want = [(i, j) for i in range(len(s0)) for j in range(len(s1)) if s0[i] < e1[j] and s1[j] < e0[i]]
    assert list(zip(made.a.tolist(), made.b.tolist())) == want and all(made.group[0][i] == made.group[1][j] for i, j in want)


def test_link_counts_equal_brute_force(spark, monkeypatch, plain, files):
    monkeypatch.setattr(alignment, "BLOCK_SLICES", 1)
    rng = random.Random(3)
    words = "the of naïve unbelievable 1234 x, and. Straße 日本".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(i, t) for i, t in enumerate(STRANGE, 500)] + list(ODD)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, pairs string, block int").repartition(5)
    got = Counter(tuple(r) for r in alignment.link_counts(frame, *files).collect())
    done = [(i, *plain(t)) for i, t in rows]
    total = Counter(p for *_, pairs in done for p in pairs)
    best = Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    want = Counter((i, len(a), len(b), len(g), len(pairs), sum(total[p] == best[p[1]] for p in pairs), sum(total[p] for p in pairs),
                    hashlib.sha256(said(g).encode()).hexdigest() if g else "") for i, a, b, g, pairs in done)
    assert got == want
    assert alignment.link_counts(frame.where("false"), *files).collect() == []
    spans = {r.doc_id: r.groups for r in alignment.align(frame.where("doc_id >= 500"), *files).collect()}
    assert said([(g.a, g.b) for g in spans[516]]) == said(plain(STRANGE[-1])[2]) and spans[500] == []
    assert [g["from"] for g in spans[516]] == [0, *(g["to"] for g in spans[516][:-1])] and spans[516][-1]["to"] == len(STRANGE[-1]) + 1


def test_alignment_remembers_a_bounded_number_of_segments(monkeypatch, files, plain):
    """A worker keeps what it remembers while it serves later stages, so there is little of it, and tokens stay right without."""
    assert alignment.SEGMENTS_A + alignment.SEGMENTS_B <= 400_000
    monkeypatch.setattr(alignment, "SEGMENTS_A", 300)
    monkeypatch.setattr(alignment, "SEGMENTS_B", 100)
    aligner = alignment.Aligner(*(open(f, "rb").read() for f in files))
    words = ["".join(x) for x in itertools.product("aeiou", "bdfgkl", "aeiou", "mnprst")]
    texts = [" ".join([*words[lo:lo + 50], *words[:5], f"{lo}x"]) for lo in range(0, len(words), 50)]
    for t in texts + texts[:2]:
        assert aligner([t]).groups() == [said(plain(t)[2])]
        assert 0 < len(aligner.b.recent.young) + len(aligner.b.recent.old) <= 200
        assert 0 < len(aligner.a.library.rest.young) + len(aligner.a.library.rest.old) <= 600


@pytest.mark.parametrize("short", [alignment.SHORT, 3])
def test_places_of_links_are_read_as_written(monkeypatch, files, plain, short):
    """Links name pairs by two bytes, in blocks of many pairs by four."""
    from types import SimpleNamespace

    import pyarrow as pa
    monkeypatch.setattr(alignment, "SHORT", short)
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [t for t in STRANGE if t]
    shared = SimpleNamespace(value=tuple(open(f, "rb").read() for f in files))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    rows = [r for b in alignment._blocks(shared)([batch]) for r in b.to_pylist()]
    pairs, docs = rows[0], rows[1:]
    width = 4 if short == 3 else 2
    assert [len(d["links"]) for d in docs] == [width * len(plain(t)[3]) for t in texts]
    known = [{"block": pairs["block"], "kind": 1, "total": n, "best": 1, "links": None} for n in pairs["counts"]]
    lines = pa.RecordBatch.from_pylist(known + [d | {"total": None, "best": None} for d in docs],
                                       schema=pa.schema({"block": pa.int64(), "kind": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
                                                         "groups_sha256": pa.string(), "links": pa.binary(), "total": pa.int64(), "best": pa.int64()}))
    got = [r for b in alignment._scores([lines]) for r in b.to_pylist()]
    count = Counter((p >> 32, p & 0xFFFFFFFF) for t in texts for p in [(a << 32) + b for a, b in plain(t)[3]])
    assert [(r["n_links"], r["n_best"], r["count_sum"]) for r in got] == [(len(x), len(x), sum(count[p] for p in x)) for x in (plain(t)[3] for t in texts)]


def test_ngram_blocks_are_bounded(monkeypatch):
    """A task holds a million n-grams at a time, about: several arrays of that length stand beside them."""
    from types import SimpleNamespace

    import pyarrow as pa

    from strata.llm import ngram_join
    monkeypatch.setattr(ngram_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(14)), "text": [" ".join(f"{i}x{j}" for j in range(250_000)) for i in range(14)]})
    sent = {}
    for batch in ngram_join._scatter(5, 80, 4)(iter([docs])):
        for r in batch.to_pylist():
            if r["kind"] == 1:
                sent[r["block"]] = sent.get(r["block"], 0) + len(r["grams"]) // 8
    assert sum(sent.values()) > 1_200_000 and max(sent.values()) < 1_200_000
