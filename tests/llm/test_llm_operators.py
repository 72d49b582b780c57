"""Each operator against a plain version of itself, and on awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import block_naming, bpe, components, html_content, jaccard, mixing, pii, queries, shared, toxicity, url_rules, vectors, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
#: Nulls in every column, empty and blank texts, repeated ids and rows, a long word.
AWKWARD = [
    (1, "a b c d e f g", "en", "src1", 13, "x"), (2, "a b c d e f g", "en", "src1", 13, "y"), (2, "a b c d e f g", "en", "src1", 13, "y"), (3, None, None, None, None, None), (None, "a b c d e f g", "de", "src2", 1, None),
    (4, "", "en", "src3", 0, ""), (5, " \n\t", "en", "odd", 3, ""), (6, "q" * 40_000, "fr", "src4", 40_000, ""), (2, "other text of the same id", "en", "src1", 5, ""), (None, None, None, "src9", None, None), (7, "A b c D e f g", "es", "src5", 13, ""),
]


@pytest.fixture(scope="module")
def awkward(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(AWKWARD, DOC)


@pytest.fixture(scope="module")
def empty(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([], DOC)


def texts(spark, table="documents", columns=("doc_id", "text")):  # noqa: ANN001, ANN201
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*columns).collect()]


def union_find(nodes):  # noqa: ANN001, ANN201
    root = {n: n for n in nodes}

    def find(x):  # noqa: ANN001, ANN202
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(a, b):  # noqa: ANN001, ANN202
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)

    return find, join


# 1: urls


def test_urls(spark):  # noqa: ANN001
    rng = random.Random(2)
    hosts = ["net", "a.net", "x.example.net", "example.net", "badexample.net", "EXAMPLE.com", "m.example.com:80", "org", "u@b.org", "localhost", ""]
    urls = [(k, rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(["", "/", "/en/", "/en", "/de/x", "/fr/a/b", "/en/?q=/de/", "#/en/"])) for k in range(400)] + [(400, None), (401, "no scheme/en/"), (402, ""), (400, None), (403, "x://é.net/ü")]
    rules = [*queries.RULES, ("example.net", "/en/deep/", "block"), ("net", "/e", "allow"), ("net", "/e", "block"), (None, "/", "block")]
    got = url_rules.judge_urls(spark.createDataFrame(urls, "page_id bigint, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), per_group=7).collect()

    def plain(url):  # noqa: ANN001, ANN202
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best[2] if best else None, best[3] if best else "allow"

    assert Counter(tuple(r) for r in got) == Counter((k, *plain(u)) for k, u in urls)
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


# 2: html


def test_html_on_pages(spark):  # noqa: ANN001
    import html

    for page_id, page in texts(spark, "pages", ("page_id", "html")):
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert html_content.main_text(page, html_content.trained()) == "\n".join(b for b in blocks if b), page_id


def test_html_layouts():
    page = """<html><head><title>no</title><script>x("</p>")</script></head><body><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies here.</p></div><main><article><h1>A &amp; B</h1>
    <p>First  <a href="/x">linked</a>\n words are here.<p>Second one.</p><div class="ad"><p>Buy this thing now.</p></div><ul><li>item one is here.</li><li>item two is here.</li></ul></article></main>
    <section class="comments"><div class="comment"><p>I think so too, said a reader.</p></div></section><form><label>Name</label><input><button>Send</button></form><footer>&copy; Us</footer></body></html>"""
    assert html_content.main_text(page, html_content.trained()) == "A & B\nFirst linked words are here.\nSecond one.\nitem one is here.\nitem two is here."
    assert html_content.main_text(None, html_content.trained()) == "" == html_content.main_text("", html_content.trained())


def test_html_held_out():
    rng, wrong, n = random.Random(99), 0, 0
    for _ in range(100):
        nodes = html_content.parse(html_content._made_page(rng))
        labels = {k: x.text.startswith("KK") for k, x in enumerate(nodes) if x.tag == "#text"}
        for k in labels:
            nodes[k].text = nodes[k].text[3:] or "x"
        odds = html_content.trained().marginals(nodes)
        wrong += sum(labels[k] != (odds[k] > 0.5) for k in labels)
        n += len(labels)
    assert wrong / n < 0.02


def test_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small tree."""
    import math

    nodes = html_content.parse('<div class="x"><p>one two three.</p><p>four</p><nav><a>five</a></nav></div>')
    model = html_content.trained()
    n, seen = len(nodes), html_content.evidence(nodes)
    total, on = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n - 1):
        y = (0, *labels)
        w = sum(model.score(seen[k]) * y[k] for k in range(1, n))
        for k in range(1, n):
            if nodes[k].parent:
                w += model.edges[html_content.edge_kind(nodes[k].tag)][{(1, 1): 0, (1, 0): 1, (0, 1): 2, (0, 0): 3}[y[nodes[k].parent], y[k]]]
        total += math.exp(w)
        for k in range(1, n):
            on[k] += math.exp(w) * y[k]
    odds = model.marginals(nodes)
    assert all(abs(on[k] / total - odds[k]) < 1e-9 for k in range(1, n))


def test_html_rows(spark):  # noqa: ANN001
    pages = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>just a text that is here.")], "page_id bigint, url string, html string")
    assert html_content.extract(pages).count() == 3 and html_content.extract(pages.limit(0)).count() == 0


# 3: personal data


def plain_spans(t):  # noqa: ANN001, ANN201
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_base_spans(spark):  # noqa: ANN001
    rng = random.Random(4)
    parts = ["@", ".", "1", "23", "a", "b-", "+", " ", "-", "(", ")", "é", "@x.com", "192.168.0.1", "4111 1111 1111 1111", "+1 555 1234567", "255", "٣", "_", "%"]
    for t in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)] + [t or "" for _, t in texts(spark)]:
        assert pii.base_spans(t) == plain_spans(t)
    long = "1" * 50_000 + "." + "0" * 50_000 + "a" * 100_000 + "@"
    assert pii.base_spans(long) == []


def test_added_spans(spark, awkward, empty):  # noqa: ANN001
    trees = pii.trained()
    text = "write to mara [at] site [dot] org or call (555) 123-4567 about order 2024-01-02, mail j@x.org"
    spans = pii.all_spans(text, pii.base_spans(text), trees)
    assert [text[a:b] for _, a, b in spans] == ["mara [at] site [dot] org", "j@x.org", "(555) 123-4567"]
    assert pii.redact(text).startswith("write to [email] or call [phone] about order 2024-01-02")
    xs, ys, kinds = pii._labelled(800, random.Random(77))
    kept = [(y, trees.score(x) >= trees.thresholds[k]) for x, y, k in zip(xs, ys, kinds, strict=True)]
    assert sum(y and s for y, s in kept) / max(1, sum(s for _, s in kept)) > 0.97
    rows = pii.find(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.find(empty).count() == 0


# 4: mixing


def test_budgets(spark):  # noqa: ANN001
    rng = random.Random(8)
    leaves = [(d, g, f"s{k}", rng.choice([0, 1, 50, 1000, 20_000])) for d in ("web", "books", "code") for g in ("en", "de") for k in range(4)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    for fill, epochs in (((1, 3), 1), ((4, 5), 2), ((5, 1), 2)):
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.leaf_budgets(frame, queries.WEIGHTS, fill, epochs).collect()}
        whole = sum(x[3] for x in leaves)
        assert sum(got.values()) == min(whole * fill[0] // fill[1], whole * epochs)

        def settled(names, cap, weight, budget):  # noqa: ANN001, ANN202
            """Water filling one step at a time."""
            given, live = dict.fromkeys(names, 0.0), [n for n in names if cap[n]]
            while budget > 1e-9 and live:
                level = min([budget / sum(weight[n] for n in live), *((cap[n] - given[n]) / weight[n] for n in live)])
                for n in live:
                    given[n] += level * weight[n]
                budget -= level * sum(weight[n] for n in live)
                live = [n for n in live if cap[n] - given[n] > 1e-9]
            return given

        def walk(level, rows, budget):  # noqa: ANN001, ANN202
            if level == 3:
                return {rows[0][:3]: budget}
            cap, parts = defaultdict(int), defaultdict(list)
            for r in rows:
                cap[r[level]] += r[3] * epochs
                parts[r[level]].append(r)
            weight = {n: queries.WEIGHTS.get(mixing.LEVELS[level], {}).get(n, 1) for n in parts}
            out = {}
            for n, b in settled(list(parts), cap, weight, budget).items():
                out |= walk(level + 1, parts[n], b)
            return out

        for leaf, budget in walk(0, leaves, min(whole * fill[0] / fill[1], whole * epochs)).items():
            assert abs(got[leaf] - budget) <= 12


def test_mix_rows(spark, awkward, empty):  # noqa: ANN001
    rows = mixing.mix(awkward, queries.domain_of_source(), queries.WEIGHTS, (1, 2), 2).collect()
    assert len(rows) == len(AWKWARD) and {r["domain"] for r in rows if r["source"] in ("odd", "unknown")} == {"unknown"}
    taken = mixing.take(awkward, queries.domain_of_source(), queries.WEIGHTS, (1, 1), 1)
    assert taken.columns == awkward.columns
    assert mixing.mix(empty, queries.domain_of_source(), queries.WEIGHTS).count() == 0 == mixing.take(empty, queries.domain_of_source(), queries.WEIGHTS).count()
    with pytest.raises(ValueError):
        mixing.weight_of("lang", {"en": 0})


# 5: archives


def test_archive(spark):  # noqa: ANN001
    rows = [(1, "u", "x" * 3000), (1, "u", "x" * 3000), (1, "u", "y" * 2500), (2, None, "x" * 3000), (None, "http://a b", None), (5, "é\nq", "ü\0" * 600), (6, "u", "short"), (7, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (512, 1 << 18):
        got = warc.archive(pages, chunk_bytes=size).collect()
        assert all(r["intact"] for r in got)
        want = []
        for i, _, h in rows:
            raw = (h or "").encode()
            same = [j for j, _, g in rows if (g or "") == (h or "")]
            again = len(raw) >= 1000 and i != max(j for j in same if j is not None)
            want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(same) if again else None))
        assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert warc.archive(pages.limit(0)).count() == 0
    real = spark.read.parquet(f"{SF}/pages.parquet")
    assert warc.archive(real, chunk_bytes=900).exceptAll(warc.archive(real)).count() == 0


def test_archive_is_gzip(spark, tmp_path):  # noqa: ANN001
    import gzip

    place = f"file://{tmp_path}/w"
    warc.write(warc.chunks(warc.records(spark.createDataFrame([(1, "http://x/", "h\0i" * 500)], "page_id bigint, url string, html string")), 700), place)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("w/part-*") if p.stat().st_size)
    assert data.count(b"WARC/1.1\r\n") == 3 and data.count(b"WARC-Type: continuation") == 2
    heads = [f for p in tmp_path.glob("w/part-*") for m in p.read_bytes().split(warc.SEPARATOR) if m for f, _ in [warc.opened(gzip.decompress(m))]]
    assert [h["warc-segment-number"] for h in heads] == ["1", "2", "3"] and heads[2]["warc-segment-total-length"] == "1500"


def test_broken_archives_are_found(spark, tmp_path):  # noqa: ANN001
    """Lengths and digests are those of the bytes read; a wrong, short or missing chunk fails the query."""
    place = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(1, "u", "x" * 100), (2, "u", "abc" * 500), (3, "u", "z" * 1500), (4, "u", "abc" * 500)], "page_id bigint, url string, html string")
    warc.write(warc.chunks(warc.records(pages), 600), place)
    parts = warc.read(spark, place)
    good = warc.verified(parts)
    assert all(r["intact"] for r in good.collect()) and warc.sound(good).count() == 4 and "intact" not in warc.sound(good).columns
    other = lambda body: F.when(F.col("row_id") == "1", F.lit(body.encode())).otherwise(F.col("body")).alias("body")
    rest = [c for c in parts.columns if c != "body"]
    broken = [(parts.select(*rest, other("y" * 100)), 1, b"y" * 100), (parts.select(*rest, other("x" * 40)), 1, b"x" * 40)]
    broken += [(parts.where(f"NOT (row_id = '3' AND chunk = {k})"), 3, b"z" * n) for k, n in ((1, 900), (2, 900), (3, 1200))]
    for some, row, left in broken:
        got = {r["page_id"]: r for r in warc.verified(some).collect()}
        assert len(got) == 4 and {i for i, r in got.items() if not r["intact"]} == {row}
        assert (got[row]["payload_bytes"], got[row]["payload_digest"]) == (len(left), hashlib.sha1(left).hexdigest())
        with pytest.raises(Exception, match="differs from its header"):
            warc.sound(warc.verified(some)).collect()


# 6: copies


def test_copies(spark, awkward, empty):  # noqa: ANN001
    big = spark.createDataFrame([(k, ("ab" * 37 + str(k % 3)) * 9, "en", "s", 1, "") for k in range(12)], DOC)
    for docs, size in ((awkward, 16384), (awkward, 3), (big, 64), (big, 1 << 20)):
        rows = docs.select("doc_id", "text").collect()
        got = block_naming.exact_copies(docs, block_bytes=size, buckets=7).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[t or ""].append(i)
        want = Counter((i, max((j for j in groups[t or ""] if j is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    kept = block_naming.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({t or "" for _, t, *_ in AWKWARD})
    assert block_naming.exact_copies(empty).count() == 0 == block_naming.keep_one(empty).count()


def test_names_do_not_rest_on_hashes(spark):  # noqa: ANN001
    """Two blocks with the same hash keep different names."""
    blocks = spark.createDataFrame([(5, bytearray(b"a")), (5, bytearray(b"b")), (5, bytearray(b"a")), (6, bytearray(b"a"))], "h bigint, block binary")
    names = {(r["h"], bytes(r["block"]) if r["block"] else None): r["name"] for r in block_naming._named_blocks(blocks, 4).collect()}
    assert len(set(names.values())) == 3 == len(names)


# 7: tokens


def test_bpe(spark, awkward, empty):  # noqa: ANN001
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    theirs = Tokenizer.from_file(path)
    ours = bpe.PrefixEncoder(open(path, encoding="utf-8").read())
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "the", "ing", "é", "ß", "中", "\x1c", "\x85", "\xa0", "\u3000", "😀", "'s", "'LL", "0", "٣", "²", "!", "$$", "\t", "<|endoftext|>", "\u0301", "aaaa", "\u200b", "_", "ab" * 30]
    for t in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + [t or "" for _, t in texts(spark)] + ["a" * 5000, " " * 3000]:
        want = theirs.encode(t, add_special_tokens=False).ids
        coded = ours.encode(t)
        assert list(memoryview(coded).cast("I")) == want
        assert ours.decode(coded) == theirs.decode(want, skip_special_tokens=False)
    coded = bpe.encode_texts(awkward, path)
    assert coded.count() == len(AWKWARD) and coded.where("n_tokens != size(ids)").count() == 0
    assert Counter(r["text"] for r in bpe.decode_ids(coded, path).collect()) == Counter(t or "" for _, t, *_ in AWKWARD)
    assert bpe.round_trip(empty, path).count() == 0


# 8: toxicity


def test_toxicity(spark, awkward, empty):  # noqa: ANN001
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.train(docs, labels)
    got = toxicity.score(docs, scorer).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit / sum(r["toxic"] for r in got) > 0.85 and hit / sum(r["predicted"] for r in got) > 0.9
    assert scorer.offending("All is well. You are a pathetic idiot and scum. Bye.") == ["You are a pathetic idiot and scum."]
    for r in toxicity.score(awkward, scorer).collect():
        assert r["predicted"] == 0 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert toxicity.keep_clean(awkward, scorer).count() == len(AWKWARD) and toxicity.score(empty, scorer).count() == 0
    assert toxicity.fit([], []).score("x") < 0.01 and toxicity.fit(["a"], [1]).score("") > 0.9


# 9: vectors


def test_vectors(spark):  # noqa: ANN001
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 64))
    rows = [(k, (base[k % 30] + rng.standard_normal(64) * rng.choice([0, 0.1, 0.25, 0.5])).astype("f4").tolist(), k % 30 % 4) for k in range(300)]
    rows += [(300, rows[0][1], rows[0][2]), (301, None, 1), (302, [0.0] * 64, 1), (303, [float("nan")] * 64, 1), (304, [None] * 64, 1), (305, rows[0][1], None), (306, rows[0][1][:10], 0), (300, rows[0][1], rows[0][2]), (307, [float("inf")] * 64, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    sound = [(k, np.array(v, float) / np.linalg.norm(np.array(v, float)), y) for k, v, y in rows if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    count, (find, join) = Counter(), union_find({r[0] for r in rows})
    for (a, x, y), (b, z, w) in itertools.combinations(sound, 2):
        if y == w and len(x) == len(z) and x @ z >= 0.93:
            count[a] += 1
            count[b] += 1
            join(a, b)
    for block in (2000, 5):
        got = vectors.near_vectors(table, block=block).collect()
        assert len(got) == len(rows)
        # rows of an id that is there twice share their counts
        total = sum(r["n_links"] for r in got)
        assert 0.97 * sum(count.values()) <= total <= sum(count.values())
        assert all(r["component_id"] == find(r["vec_id"]) for r in got if r["vec_id"] > 300)
        assert sum(r["component_id"] != find(r["vec_id"]) for r in got) <= 3
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_components(spark):  # noqa: ANN001
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, k) for k in range(201, 230)] + [(300, 300)]
    find, join = union_find({x for e in links for x in e})
    for a, b in links:
        join(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# 10: near copies


def plain_components(rows):  # noqa: ANN001, ANN201
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])))
    find, join = union_find({i for i, _ in sets})
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            join(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_copies(spark):  # noqa: ANN001
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    shared_part = [word() for _ in range(50)]
    rows = []
    for _ in range(25):
        body = [word() for _ in range(rng.choice([3, 5, 12, 60, 300]))]
        for _ in range(rng.randint(1, 8)):
            copy = list(body)
            for _ in range(rng.randint(0, max(1, len(body) // 30))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy if rng.random() < 0.7 else copy + shared_part)))
    rows += [(900, None), (901, ""), (902, "\t \n"), (903, "One two"), (904, "oNE\ttwo"), (905, rows[0][1].upper())]
    want = plain_components(rows)
    got = jaccard.similar_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_trees_lose_nothing():
    """The trees' pairs hold all similar pairs, with small leaves and two blocks too."""
    import numpy as np

    rng = random.Random(1)
    sets = []
    for _ in range(60):
        base = {rng.getrandbits(60) for _ in range(rng.randint(5, 80))}
        for _ in range(3):
            sets.append(frozenset(x for x in base if rng.random() > 0.06) | {rng.getrandbits(60) for _ in range(rng.randint(0, 4))})
    sets.sort(key=len)
    bits = np.zeros((len(sets), jaccard.BITS), np.uint8)
    for k, s in enumerate(sets):
        bits[k, [x % jaccard.BITS for x in s]] = 1
    words = np.packbits(bits, axis=1).view(np.uint64)
    n, group = np.array([len(s) for s in sets]), np.arange(len(sets))
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard.similar(len(sets[i]), len(sets[j]), len(sets[i] & sets[j]))}
    i, j = jaccard.tree_pairs(n, words, group, np.zeros(len(sets), int), leaf=4, fan=2)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert want <= found and len(found) < len(sets) * (len(sets) - 1) / 8
    block = np.arange(len(sets)) % 2
    i, j = jaccard.tree_pairs(n, words, group, block)
    assert {p for p in want if block[p[0]] != block[p[1]]} <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_near_copies_awkward(spark, awkward, empty):  # noqa: ANN001
    got = jaccard.similar_texts(awkward).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in AWKWARD)
    same = [r["component_id"] for r in got if r["n_shingles"] == 3]
    assert set(same) == {1} and len(same) == 5
    kept = jaccard.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    # one of the five alike, the other text, the long word, and all rows without words
    assert kept.count() == 1 + 1 + 1 + 4
    assert jaccard.similar_texts(empty).count() == 0 == jaccard.keep_one_of_each(empty).count()


def test_near_copies_of_null_and_repeated_ids(spark):  # noqa: ANN001
    """Texts of different components all stay, though their ids are null or the same; within a component one row stays."""
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = word(1) + " end"
    rows = [(None, word(1)), (None, near), (None, word(2)), (None, word(3)), (7, word(4)), (7, word(5)), (7, word(5).upper()), (8, word(6)), (None, word(6)), (None, ""), (None, None)]
    kept = [r["text"] for r in jaccard.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sum(t in (word(1), near) for t in kept) == 1 and sum((t or "").lower() == word(5) for t in kept) == 1
    assert Counter(t for t in kept if t not in (word(1), near) and (t or "").lower() != word(5)) == Counter([word(2), word(3), word(4), word(6), "", None])


# the pipeline and the shared parts


def test_pipeline(spark):  # noqa: ANN001
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scorer = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect() if scorer.score(r["text"] or "") < 0.5}
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for i, t in rows.items() if last[t] == i}
    found = plain_components(list(rows.items()))
    rows = {i: t for i, t in rows.items() if found[i][1] == i}
    left = docs.where(F.col("doc_id").isin(list(rows)))
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(left, queries.domain_of_source(), queries.WEIGHTS, corpus_pipeline.MIX_FILL, corpus_pipeline.MIX_EPOCHS, corpus_pipeline.MIX_SEED).collect()}
    ours = bpe.PrefixEncoder(open(queries.vocabulary(), encoding="utf-8").read())
    want = Counter((i, len(ours.encode(t)) // 4) for i, t in rows.items() for _ in range(mixed[i]))
    got = corpus_pipeline.run(spark, SF)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = shared.settle(f(spark, stage, SF), "t")
        assert stage.columns == docs.columns


@pytest.mark.parametrize("name", ["op1_url_filters", "op4_mixing", "op5_warc", "op6_exact_dedup"])
def test_sql(spark, name):  # noqa: ANN001
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = c.execute(queries.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(map(str, r)) for r in cur.fetchall()) == Counter(tuple(str(r[n]) for n in names) for r in df.collect())


def test_native_plans(spark):  # noqa: ANN001
    for name in ("op1_url_filters", "op4_mixing", "op6_exact_dedup"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
