"""Pages, URLs, quality, mixing and the pipeline."""

import itertools
import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from strata.llm import html_extract, mixing, quality_knn, quality_rules, queries, url_filter

SF = "/root/testdata/sf0.001"


def extract(page):
    weights = {"stops 0": -1.0, "stops 2": 1.0, "commas 3": 1.0, "length 8": 1.0, "links 4": -1.0, "tag p": 0.5, "length 2": -1.0}
    return html_extract.extract(page, weights)[0]


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One\n  two.<p>Three<br>four &nbsp;five.</article><footer>f</footer>",
     "T & U\nOne two.\nThree four five."),
    ("<article><p>Body.</p><aside>skip</aside><form><p>mail</p></form><div class='comments'><p>Nice, very nice. So good.</p></div></article>", "Body."),
    ("<main><div id=ad-top>Buy.</div><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>Yes.</p></main>", "Yes."),
    ("<article><p>Unclosed <b>bold<p>Next", "Unclosed bold\nNext"),
    ("<article><p>a &lt;b&gt; &#233; &unknown;</p></article>", "a <b> é &unknown;"),
])
def test_extract(page, text):
    assert extract(page) == text


LONG = "A paragraph of some length, with commas, goes on for a while. It has sentences. " * 3


def test_edges_decide_unmarked_blocks():
    weights = {"stops 0": -1.0, "stops 4": 1.0, "commas 3": 1.0, "links 4": -1.0, "tag p": 0.5, "rights True": -1.0}
    page = (f"<body><div><a href=/>Home</a></div><ul><li><a href=/n>News</a><li><a href=/o>Old</a></ul><div><h1>{LONG}</h1><p>{LONG}</p><p>Chapter two</p>"
            f"<p>{LONG}</p></div><div>© 2020</div>")
    long = LONG.strip()
    assert html_extract.extract(page, weights)[0].split("\n") == [long, long, "Chapter two", long]
    assert html_extract.extract(page, weights, smooth=0)[0].split("\n") == [long, long, long]  # without edges a short block is lost


def test_certain_marks_hold_against_text_and_neighbours():
    for clutter in ("<div class=ad>{}</div>", "<aside>{}</aside>", "<p class=cookie-notice>{}</p>", "<section id=comments><p>{0}</p><p>{0}</p></section>"):
        assert extract(f"<article><h1>T</h1><p>{LONG}</p>{clutter.format(LONG)}<p>{LONG}</p></article>").split("\n") == ["T", LONG.strip(), LONG.strip()]
    assert extract("<article><p><a href=x>See also</a></p><p>x <math><mi>y</mi></math> z</p></article><nav>" + LONG + "</nav>") == "See also\nx y z"


@pytest.mark.parametrize("page, blocks", [("<div>" * 100_000 + "x", 1), ("<div>a" * 30_000, 30_000), ("<b><div></div>" * 50_000 + "t", 1),
                                          ("<div>" * 50_000 + "</x>" * 50_000, 0), ("<svg>" * 50_000 + "x", 1), ("<div class=main><h1>a" * 20_000, 20_000)])
def test_time_grows_with_the_page(page, blocks):
    begin = time.process_time()
    assert html_extract.extract(page, {})[1] == blocks and time.process_time() - begin < 5


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.choice([-3, -2, -1, -0.5, 0.5, 1, 2, 3]) * rng.random() for _ in range(n)]
        edges = [(i, j, rng.random() * 2) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side):
            return (sum(max(0, round(s * 1000)) for s, x in zip(scores, side) if not x) + sum(max(0, -round(s * 1000)) for s, x in zip(scores, side) if x)
                    + sum(round(w * 1000) for i, j, w in edges if side[i] != side[j]))
        assert cost(html_extract.cut(scores, edges)) == min(cost(x) for x in itertools.product([False, True], repeat=n))


def test_pages_odd_rows(spark):
    kinds = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "clash", ""), (1, "u", "<article><p>A, b. C.</p></article>", "", ""), (None, "u", "<<<", "", ""), (2, "u", "<p" * 5000, "", "")]
    got = html_extract.main_text(spark.createDataFrame(rows, kinds)).collect()
    assert len(got) == 4 and {r.n_chars for r in got if r.url is None} == {0} and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.main_text(spark.createDataFrame([], kinds)).collect() == []


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/de", "x://net", "x://a.net/", "x://example.com/de/1", "x://org/fr/", "x://a.org/fr",
            "http://m.spam-farm.example.org/en/1", "x://spam-farm.example.org/fr/1", "x://notspam-farm.example.org/1", None, "no scheme", "x://", "x://h#/en/://net/"]
    frame = spark.createDataFrame([(i, u, "clash", "x") for i, u in enumerate(urls)] + [(0, urls[0], "", "")], "page_id int, url string, rule string, word string")
    entries = spark.createDataFrame([(h, p, v, False) for h, p, v in queries.RULES] + [("spam-farm.example.org", "/", "block", True)],
                                    "host string, path string, verdict string, listed boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame, entries).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1][2:] == ("net/", "block") and got[2] == ("net", "", None, "allow")
    assert got[3][3] == "block" and got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow") and got[6][2] is None
    assert got[7][2:] == (None, "block") and got[8][2:] == ("org/fr/", "allow") and got[9][3] == "allow"
    assert got[10] == got[11] == got[12] == ("", "", None, "allow") and got[13][:2] == ("h", "")
    assert url_filter.judge(frame, entries).count() == len(urls) + 1 and url_filter.judge(frame.where("false"), entries).collect() == []
    assert {r.verdict for r in url_filter.judge(frame, entries.where("false")).collect()} == {"allow"}


def test_url_of_very_many_labels(spark):
    """Its probes are as many as the entries have numbers of labels, not as its labels."""
    host = "a." * 200_000 + "spam-farm.example.org"
    frame = spark.createDataFrame([(1, f"x://{host}/"), (2, "x://org/"), (3, "x://.spam-farm.example.org/")], "page_id int, url string")
    entries = spark.createDataFrame([("spam-farm.example.org", "/", "block", True), ("org", "/fr/", "allow", False)],
                                    "host string, path string, verdict string, listed boolean")
    got = {r.page_id: (len(r.host), r.verdict) for r in url_filter.judge(frame, entries).collect()}
    assert got == {1: (len(host), "block"), 2: (3, "allow"), 3: (22, "block")}


def test_bloom_has_no_false_negatives(spark):
    from pyspark.sql import functions as F
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    words = url_filter.bloom(keys, 500)
    probed = spark.range(20_000).select(F.col("id").cast("string").alias("key")).withColumns({"block": url_filter._block(F.col("key"), 500), "bits": url_filter._bits(F.col("key"))})
    hits = {int(r.key) for r in probed.join(words, "block").where(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits")).collect()}
    assert set(range(2000)) <= hits and len(hits) < 2000 + 0.1 * 18_000


def test_knn_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality as label")
    model = quality_knn.train(docs, labels, neighbours=5)
    rows = {r.doc_id: r for r in quality_knn.score(docs, model).collect()}
    assert len(rows) == docs.count()
    for r in docs.limit(20).collect():
        v = model.vectors_of(quality_knn.counts(r.text)[None])[0]
        near = sorted(((float(v @ x), y) for x, y in zip(model.vectors, model.labels)), reverse=True)[:5]
        total = sum(max(s, 0) ** 8 for s, _ in near)
        assert rows[r.doc_id].score == pytest.approx(sum(max(s, 0) ** 8 * y for s, y in near) / total, abs=1e-3)


def test_knn_odd_rows(spark):
    kinds = "doc_id bigint, text string, score string, label string"
    docs = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (None, "abc", "", ""), (3, "x", "", ""), (3, "x", "", "")], kinds)
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (2, None)], "doc_id bigint, label int")
    got = quality_knn.score(docs, quality_knn.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in quality_knn.score(docs, quality_knn.train(docs, labels.where("false"))).collect()} == {0.5}
    assert quality_knn.score(docs.where("false"), quality_knn.train(docs.where("false"), labels)).collect() == []


def test_knn_fetches_one_row_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, None), (2, "good words here"), *[(1, f"text {i}") for i in range(300)]], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id bigint, label int")
    model = quality_knn.train(docs, labels)
    assert len(model.vectors) == len(model.labels) == 2 and quality_knn.score(docs, model).count() == 302


def repeats(words):
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(hit)


def test_counts_equal_brute_force(spark):
    import re
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) + "\n" * (n % 3) + "a b\n \na b" for n in range(0, 60, 3)]
    texts += [None, "", "  ", "a\u00a0b c\x0bd", "#x $ <|> é!", "A\nA\n\nA"]
    docs = spark.createDataFrame([(i, "en", t, "c") for i, t in enumerate(texts)], "doc_id bigint, lang string, text string, words string")
    for r in quality_rules.counts(docs).collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), repeats(words)), t
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.05), (20, 3000, 0.01)):
        got = spark.range(1).select(quality_rules.binomial_below(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p).alias("x")).first().x
        assert got == pytest.approx(float(sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))), rel=1e-6)


def test_cutoffs_keep_their_promise(spark):
    rows = [(i, None if i % 2 else "en", ("w " * 60 + ("# " * 50 if i % 5 == 0 else "")), "x") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(6000)], "doc_id bigint, label int")
    got = quality_rules.judge(docs, labels).where("not base_failed").collect()
    assert got == []  # every text repeats itself
    varied = docs.selectExpr("doc_id", "lang", "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', i)), if(doc_id % 5 = 0, repeat('#', 50), '')) AS text")
    got = quality_rules.judge(varied, labels).collect()
    assert all(r.kept == (r.doc_id % 5 > 0) and ("symbols" in r.rejected_by) == (not r.kept) for r in got) and len(got) == 6000
    assert all(r.kept for r in quality_rules.judge(varied, labels.where("false")).collect())
    assert quality_rules.judge(varied.where("false"), labels).collect() == []


@pytest.mark.parametrize("sources", [[("a", 50, 0.5), ("b", 30, 0.3), ("c", 20, 0.2)], [("a", 100, 0.1), ("b", 3, 0.6), ("c", 17, 0.3)],
                                     [("a", 40, 0.5)] + [(f"s{i:02}", 2, 0.5 / 30) for i in range(30)], [("a", 1, 1.0)], []])
def test_schedule_deviates_by_less_than_a_block(sources):
    plan = mixing.schedule(sources)
    assert sorted((s, k) for s, k, *_ in plan) == sorted((s, k) for s, (_, n, _) in enumerate(sources) for k in range(1, n + 1))
    assert [x[2] for x in plan] == list(range(len(plan))) and all(release <= slot < deadline for _, _, slot, release, deadline in plan)
    weights = [max(1, round(w * 1_000_000)) for _, _, w in sources]
    ran, v = [0] * len(sources), Fraction(0)
    for t, (s, *_) in enumerate(plan):
        ran[s] += 1
        left = Fraction(1)  # move virtual time on by one slot
        while left:
            active = [i for i, (_, n, _) in enumerate(sources) if v * weights[i] < n]
            total = sum(weights[i] for i in active)
            if not total:
                break
            step = min(left / total, min(Fraction(sources[i][1], weights[i]) - v for i in active))
            v, left = v + step, left - step * total
        assert all(abs(ran[i] - min(Fraction(n), v * weights[i])) < 1 for i, (_, n, _) in enumerate(sources)), t


def test_mixed_keeps_every_row(spark):
    from pyspark.sql import functions as F
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}", "t", i) for i in range(500)] + [(1, "s1", "t", 1), (None, "s1", "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, mix_slot int")
    for weights in (None, {"s0": 0.7, "s1": 0.3}):
        got = mixing.mixed(docs, weights, block_rows=20).collect()
        assert Counter(map(tuple, got)) == Counter(rows)
    clash = docs.select("*", *[F.lit(n).alias(n) for n in ("_n", "_S", "_t", "_b", "_mixing_slot")])
    assert Counter(map(tuple, mixing.mixed(clash, block_rows=20).collect())) == Counter((*r, "_n", "_S", "_t", "_b", "_mixing_slot") for r in rows)
    slots = mixing.slots(docs, mixing.plan(docs, block_rows=20)).collect()
    assert len(slots) == len(rows) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in slots)
    assert mixing.mixed(docs.where("false")).collect() == []


def pipeline_rows(spark):
    """Documents of the test table with copies, near copies, odd rows, a very long text and clashing columns."""
    from pyspark.sql import functions as F
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    long = " ".join(w for r in docs[:60] if r[2] == "en" for w in r[1].split())
    rows = docs + [(9001, None, "en", None, None), (9002, "12 34", None, "s", 5), (9003, "", "en", "s", 0), (9004, long, "en", "long", len(long)),
                   (9005, docs[0][1], "en", None, 1), (9006, long + " and", "en", None, 1), (9007, long, None, "s", 1),
                   (None, "The and of the this with are on is that to be.", None, None, 9)]
    frame = spark.createDataFrame(rows + rows[:40] + rows[-8:], spark.read.parquet(f"{SF}/documents.parquet").schema)
    return frame.select("*", *[F.lit(n).alias(n) for n in ("score", "rejected", "_own", "_first", "_id", "_n", "_s", "_t", "_b", "mix_slot", "ids", "_language_score")])


def test_pipeline_equals_brute_force(spark, monkeypatch, tmp_path):
    """run() against plain Python: languages by the operator (compared elsewhere with a plain scorer), all other stages by sets and loops."""
    import hashlib

    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from strata.llm import bpe, langid
    docs = pipeline_rows(spark)
    (tmp_path / "sf").mkdir()
    docs.repartition(3).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]

    model = langid.train(docs.select("doc_id", "text", "lang"), usable=corpus_pipeline.id_remainder(docs.doc_id, 4) != 2)
    held = spark.createDataFrame([(t,) for t in {t for _, t, _ in rows}], "text string")
    refused = {r.text for r in langid.identify(held, model).where("rejected").collect()}
    assert {None, "", "12 34"} <= refused and len(refused) < 10
    kept = {r for r in rows if r[1] not in refused}
    best = {}
    for i, t, _ in kept:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    kept = {r for r in kept if (-1 if r[0] is None else r[0]) == best[r[1]]}
    words = {r: re.findall(r"[^\x20\t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) for r in kept}
    sets = {r: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for r, w in words.items()}
    group = {r: r for r in kept}

    def root(r):
        while group[r] != r:
            r = group[r]
        return r
    for a, b in itertools.combinations(kept, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and a[0] is not None and b[0] is not None:
            group[root(a)] = root(b)
    least = {}
    for r in kept:
        if r[0] is not None:
            least[root(r)] = min(least.get(root(r), r[0]), r[0])
    assert len(kept) > len(least)
    kept = {r for r in kept if r[0] is None or r[0] == least[root(r)]}

    # the schedule: few rows, so one block per source; all are due in slot 0..; earliest deadline first, in exact fractions
    sizes = Counter(s for *_, s in kept)
    names = sorted(sizes, key=lambda s: (s is not None, s or ""))
    assert all(n <= 1000 for n in sizes.values())
    weight = {s: max(1, round(sizes[s] ** 0.5 / sum(n ** 0.5 for n in sizes.values()) * 1_000_000)) for s in names}
    ends = {s: Fraction(1, weight[s]) for s in names}  # the virtual time when its one block has been due
    deadline = {}
    for s in names:
        due = sum(1 for x in names if ends[x] <= ends[s]) + sum(weight[x] for x in names if ends[x] > ends[s]) * ends[s]
        deadline[s] = -(-due.numerator // due.denominator)
    slot = {s: k for k, s in enumerate(sorted(names, key=lambda s: (deadline[s], names.index(s))))}

    ranks = bpe.Codec.from_file(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, s in kept:
        ids = library.encode_ordinary(t)
        want[i, slot[s], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert Counter((r.doc_id, r.mix_slot, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want


def test_pipeline_stages_keep_columns_and_take_empty_tables(spark):
    import corpus_pipeline
    assert len(corpus_pipeline.STAGES) == 5
    before = docs = pipeline_rows(spark)
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, SF), name)
        assert after.columns == docs.columns and after.count() <= before.count()
        assert after.select("_own", "score", "mix_slot", "_language_score").distinct().collect() == [("_own", "score", "mix_slot", "_language_score")]
        assert stage(spark, empty, SF).collect() == []
        before = after
    assert before.where("doc_id is null").count() == 1 and before.select("source").distinct().count() > 2
    assert corpus_pipeline.STAGES[-1][1](spark, before, SF).count() == before.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    from strata.plans.check import _rows, duck_connect
    df = queries.queries()[name](spark, SF)
    rel = duck_connect(SF).sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_vectors_are_finite():
    assert np.isfinite(quality_knn._unit(np.zeros((2, 3), np.float32))).all()
