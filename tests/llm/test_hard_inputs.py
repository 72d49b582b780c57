"""Clashing names, hostile and very long inputs, hot groups; and the parts of methods against plain versions of them."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.llm import block_naming, bpe, html_content, jaccard, mixing, pii, queries, shared, toxicity, url_rules, vectors, warc

SF = "/root/testdata/sf0.001"
CLASHING = ("row", "stays", "_row", "taken", "copies", "nth", "i", "y", "place", "id", "th", "_id", "_th", "_own", "_y", "_component", "component", "k", "s", "n", "digest", "held", "Row")


def with_clashes(df):  # noqa: ANN001, ANN201
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING) if c.lower() not in {x.lower() for x in CLASHING[:k]}})


@pytest.fixture(scope="module")
def docs(spark):  # noqa: ANN001, ANN201
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "s1"), (2, text, "en", "s1"), (3, text + " more", "de", None), (4, None, None, "s2"), (None, "", "en", "s2"), (5, "x y", "en", "s3"), (5, "x y", "en", "s3"), (6, "z" * 300_000, "fr", "s1")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_clashing_names(spark, docs):  # noqa: ANN001
    wide = with_clashes(docs)
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    scorer = toxicity.train(wide, with_clashes(labels))
    for f in (
        lambda d: toxicity.keep_clean(d, scorer), block_naming.keep_one, jaccard.keep_one_of_each,
        lambda d: mixing.take(d, queries.domain_of_source(), queries.WEIGHTS, (9, 10), 1),
    ):
        got = f(wide)
        assert got.columns == wide.columns
        assert Counter(map(tuple, got.select(*docs.columns).collect())) == Counter(map(tuple, f(docs).collect()))
    for f in (pii.find, block_naming.exact_copies, jaccard.similar_texts, lambda d: toxicity.score(d, scorer), lambda d: bpe.round_trip(d, queries.vocabulary())):
        assert Counter(map(tuple, f(wide).collect())) == Counter(map(tuple, f(docs).collect()))
    pages = spark.createDataFrame([(1, "http://a.net/x", "<p>text that is here, and more of it."), (2, None, None)], "page_id bigint, url string, html string")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    for f in (lambda d: url_rules.judge_urls(d, rules), html_content.extract, warc.archive):
        assert Counter(map(tuple, f(with_clashes(pages)).collect())) == Counter(map(tuple, f(pages).collect()))
    table = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(vectors.near_vectors(with_clashes(table)).collect()) == sorted(vectors.near_vectors(table).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_pipeline_on_awkward_tables(spark, docs, tmp_path):  # noqa: ANN001
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for number, table in enumerate((docs, docs.limit(0), with_clashes(docs))):
        table.write.parquet(f"file://{tmp_path}/{number}/documents.parquet")
        labels.write.parquet(f"file://{tmp_path}/{number}/labels.parquet")
    runs = [corpus_pipeline.run(spark, f"file://{tmp_path}/{k}") for k in range(3)]
    assert [r.count() for r in runs][1] == 0 and runs[0].columns == ["doc_id", "n_tokens", "ids"]
    assert sorted(map(str, runs[0].collect())) == sorted(map(str, runs[2].collect()))


def test_settled_tables_go(spark):  # noqa: ANN001
    table = shared.settle(spark.range(5), "t")
    place = shared._places[table]
    assert table.count() == 5
    shared.free(table, None, spark.range(3))
    files, path = shared._filesystem(spark, place)
    assert not files.exists(path) and table not in shared._places
    assert shared.unused(["Row", "_row"], "row", "row") == ["__row", "___row"]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):  # noqa: ANN002, ANN202
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: ANN202, N802
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


# 1


def test_hot_group_is_salted(spark):  # noqa: ANN001
    """A group's points lie in several tasks, each with all rules of the group."""
    points = spark.range(4000).select(F.lit("g").alias("group"), F.format_string("k%05d", "id").cast("binary").alias("key"), F.col("id"))
    rules = spark.createDataFrame([("g", bytearray(b"k"), "all"), ("g", bytearray(b"k01"), "some")], "group string, key binary, rule string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        swept = url_rules._sweep(points, rules, ["id"], 100)
        assert "hashpartitioning(group" in (plan := swept._jdf.queryExecution().executedPlan().toString())
        assert any("REPARTITION_BY_COL" in line and "salt" in line for line in plan.splitlines())
        got = swept.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got) == 4000 and all(r["stack"] == (["all", "some"] if 1000 <= r["id"] < 2000 else ["all"]) for r in got)
    tasks = Counter(r["task"] for r in got)
    assert len(tasks) > 4 and max(tasks.values()) < 2000


# 2


LONG = " ".join("The quick brown fox jumps over the lazy dog." for _ in range(8))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><h1>T</h1><section id="related-work"><h2>Related work</h2><p>{LONG}</p></section><section id="search-methods"><p>{LONG}</p></section></article>', f"T\nRelated work\n{LONG}\n{LONG}"),
        (f"<html><body><div><a href=1>Home</a> | <a href=2>News</a></div><div><h1>Title here</h1><div>{LONG}</div><div>{LONG}</div></div><div>&copy; 2020 Us</div></body></html>", f"Title here\n{LONG}\n{LONG}"),
        (f"<article><p>The value <math><mi>x</mi> = <mn>5</mn></math> holds. {LONG}</p></article>", f"The value x = 5 holds. {LONG}"),
        (f"<article><p>See <svg><title>no</title><text>the map</text></svg> here. {LONG}</p></article>", f"See the map here. {LONG}"),
        (f"<article><p>{LONG}</p><script src=/a/>code</script></article>", LONG),
        (f"<article><p>Go <a title=it's href=\"x\">there</a> now. {LONG}</p></article>", f"Go there now. {LONG}"),
        (f"<article><p>If a < b, then &lt;b&gt; &amp;amp; so. {LONG}<p>x</article>", f"If a < b, then <b> &amp; so. {LONG}\nx"),
        (f"<main><h1>Story</h1><p>{LONG}</p><aside class='newsletter-signup'><p>Sign up for our weekly letter today.</p></aside><p>{LONG}</p></main><div id='comments-area'><h3>2 replies</h3><p>I liked this one a lot, thank you.</p></div>", f"Story\n{LONG}\n{LONG}"),
        (f"<body><table><tr><td><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></td><td><h1>Old page</h1>{LONG}<br><br>{LONG}</td></tr></table></body>", f"Old page\n{LONG} {LONG}"),
        (f"<article><noscript>Turn it on.</noscript><p>{LONG}</p><select><option>a</select><p>{LONG}<!-- <p>no --></p><noscript><p>{LONG}</article>", f"{LONG}\n{LONG}\n{LONG}"),
    ],
)
def test_layouts(page, want):  # noqa: ANN001
    """Pages written by hand, apart from the layouts that the model learns from."""
    assert html_content.main_text(page, html_content.trained()) == want


def test_hostile_pages_take_linear_time():
    model = html_content.trained()
    pages = ["<a " * 700_000 + '"', "<div>" * 200_000 + "</section>" * 200_000, "<li><div>" + "<blockquote>" * 80_000 + "</li>" * 80_000, "<" * 1_000_000, "<!--" * 500_000, "<a b='" * 300_000, "<noscript>" * 200_000, "<a b" + " " * 1_000_000 + "c" + " " * 1_000_000, "<p>" * 300_000, "&" * 1_000_000]
    for page in pages:
        began = time.time()
        html_content.main_text(page, model)
        assert time.time() - began < 30, page[:20]


# 3


def test_many_spans_take_little_time():
    text = " ".join(f"call ({k % 1000:03d}) 555-{k % 10_000:04d} now" for k in range(30_000))
    began = time.time()
    spans = pii.all_spans(text, pii.base_spans(text), pii.trained())
    assert time.time() - began < 20 and len(spans) == 30_000


def test_added_spans_against_all_pairs():
    """The ordered look-up takes the same spans as comparing with every span taken."""
    rng, trees = random.Random(3), pii.trained()
    bits = ["+49 30 1234567", "(030) 123-4567", "4111 1111 1111 1111", "a@b.de", "mara (at) mail (dot) com", "10.1.2.3", "378282246310005", "call", "card", "12 34 56 78 90", "-", " "]
    for _ in range(200):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        base = pii.base_spans(text)
        scored = [(s, x) for x in pii.candidates(text) if (s := trees.accepts(text, x)) is not None]
        taken = list(base)
        for _, x in sorted(scored, key=lambda p: (-p[0], p[1][1], p[1][0])):
            if all(x[2] <= a or x[1] >= b for _, a, b in taken):
                taken.append(x)
        assert pii.all_spans(text, base, trees) == sorted(taken, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_remarks_are_no_addresses():
    trees = pii.trained()
    for text in ("the ratio (at) noon . is fine", "serial 12:34:56:78:90:12:34:56 end", "beans (at) 3.50 each"):
        assert pii.all_spans(text, pii.base_spans(text), trees) == []
    for text, kind in (("reach j.doe [at] site [dot] org", "email"), ("address 2001:0db8:85a3:0000:0000:8a2e:0370:7334 here", "ip")):
        assert [s[0] for s in pii.all_spans(text, pii.base_spans(text), trees)] == [kind]
    assert trees.thresholds.keys() == set(pii.KINDS) and max(trees.thresholds.values()) < float("inf")


# 5


def test_archives_in_pieces(spark, tmp_path):  # noqa: ANN001
    """Archives are read by several tasks, and payloads of many chunks come back whole."""
    rng = random.Random(8)
    rows = [(k, f"u{k}", "".join(chr(rng.choice([0, 10, 31, 139, 200, 20_000])) for _ in range(rng.choice([0, 5, 3000])))) for k in range(60)] + [(60, "u", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        place = f"file://{tmp_path}/w"
        warc.write(warc.chunks(warc.records(pages.coalesce(1)), 1000), place)
        parts = warc.read(spark, place)
        assert parts.rdd.getNumPartitions() > 5
        got = {r["page_id"]: r for r in warc.verified(parts).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(got) == 61 and all(r["intact"] for r in got.values())
    assert all(got[i]["payload_digest"] == hashlib.sha1(h.encode()).hexdigest() and got[i]["payload_bytes"] == len(h.encode()) for i, _, h in rows)


def test_repeats_by_shuffle(spark, monkeypatch):  # noqa: ANN001
    """With too many repeats for every task, the same archive comes out."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000))
    want = Counter(map(tuple, warc.archive(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, warc.archive(pages).collect())) == want
    assert sum(n for r, n in want.items() if r[3] == "revisit") >= 40


# 7


def test_bounded_memory_of_pairs(monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 50)
    definition = open(queries.vocabulary(), encoding="utf-8").read()
    ours, text = bpe.PrefixEncoder(definition), " ".join("".join(random.Random(k).choices("abcdeé日 ", k=12)) for k in range(300))
    small = ours.encode(text)
    assert len(ours.fits) <= 50
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 10**6)
    assert bpe.PrefixEncoder(definition).encode(text) == small and ours.decode(small) == text


# 8


def test_noisy_or_plainly():
    """A text's score is one less the product of what its sentences and the leak leave."""
    scorer = toxicity.Scorer({"vile.": 2.5, "hate": 1.5, "fool.": 0.7}, -3.0, -4.0)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for text in ("", "All is well. Nothing here.", "You vile hater! A fool said so. Fine.\nHATEFUL vile, vile fool", "fools are not in it. hates is"):
        left = 1 - sigmoid(-4.0)
        for a, b in toxicity.sentences(text.lower()):
            words = {w for w in toxicity.WORD.findall(text.lower()[a:b])}
            own = {e for w in words for e in ([w + "."] + [w[:4]]) if e in scorer.weights}
            if own:
                left *= 1 - sigmoid(-3.0 + sum(scorer.weights[e] for e in own))
        assert abs(scorer.score(text) - (1 - left)) < 1e-12


def test_blame_is_the_gradient():
    import numpy as np

    rng = np.random.default_rng(2)
    z, doc_of, y, leak = rng.normal(-1, 1.5, 12), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3, 3, 5, 5]), np.array([1, 0, 1, 0, 1, 1.0]), -2.0

    def likelihood(z, leak):  # noqa: ANN001, ANN202
        total = 0.0
        for d in range(6):
            left = math.prod([1 - 1 / (1 + math.exp(-x)) for x in z[doc_of == d]]) * (1 - 1 / (1 + math.exp(-leak)))
            total += math.log(1 - left) if y[d] else math.log(left)
        return total

    _, _, g, leak_pull = toxicity.blame(z, doc_of, y, leak)
    step = 1e-6
    for k in range(12):
        up, down = z.copy(), z.copy()
        up[k] += step
        down[k] -= step
        assert abs((likelihood(up, leak) - likelihood(down, leak)) / (2 * step) - g[k]) < 1e-5
    assert abs((likelihood(z, leak + step) - likelihood(z, leak - step)) / (2 * step) - leak_pull.sum()) < 1e-5


def test_sample_is_bounded_by_bytes(spark, monkeypatch):  # noqa: ANN001
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append(texts))
    docs = spark.createDataFrame([(k, "x" * 1000) for k in range(100)], "doc_id bigint, text string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    toxicity.train(docs, labels, most_bytes=10_500)
    toxicity.train(docs, labels, most_bytes=10)
    toxicity.train(docs, labels, rows=20)
    assert [len(s) for s in seen] == [10, 0, 20] and all(len(t) == 1000 for s in seen for t in s)


# 9


def test_recall_of_many_links(spark):  # noqa: ANN001
    """Pairs spread from the threshold upward: nearly all links are found, none that isn't one."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for k in range(1500):
        a = rng.standard_normal(48)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(48)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = rng.uniform(0.925, 0.95)
        rows += [(2 * k, a.astype("f4").tolist(), 1), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).astype("f4").tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    v = np.array([r[1] for r in rows], "f4").astype("f8")
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    near = v @ v.T >= 0.93
    np.fill_diagonal(near, False)
    assert near.sum() > 1500
    for bucket in (250, 40):
        kept = vectors.plan_tables.__defaults__
        vectors.plan_tables.__defaults__ = (*kept[:2], bucket)
        try:
            got = {r["vec_id"]: r for r in vectors.near_vectors(table).collect()}
        finally:
            vectors.plan_tables.__defaults__ = kept
        assert sum(r["n_links"] for r in got.values()) >= 0.985 * near.sum()
        assert all(r["n_links"] <= near[k].sum() for k, r in got.items())
    assert vectors.plan_tables(10**12)[0] > 24 and vectors.plan_tables(1)[0] == 1


# 10


def test_common_keys_come_last(spark, monkeypatch):  # noqa: ANN001
    """A passage that most texts hold changes no result, however few texts make it common."""
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for k in range(60):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([0, 3, 25, 60]))]
        at = rng.randint(0, len(own))
        rows.append((k, own[:at] + passage + own[at:]))
        if k % 3 == 0:
            near = list(rows[-1][1])
            near[rng.randrange(len(near))] = "changed"
            rows.append((100 + k, near))
    docs = [(i, " ".join(w)) for i, w in rows]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in docs)}
    root = {i: i for i in sets}

    def find(x):  # noqa: ANN001, ANN202
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    for block in (3, 20, 4096):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        common = jaccard._common(table, "text")
        assert bool(common) == (block < 4096)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_texts(table).collect()}
        assert got == {i: find(i) for i in sets}
