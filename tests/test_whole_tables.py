"""Queries work on whole tables: against brute force over the small tables, beside the comparison with SQL."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from marginalia.operators import bootstrap, impact, retrieval
from marginalia.plans import base, evaluations
from marginalia.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def words(text):  # noqa: ANN001, ANN201
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return set(re.findall(r"[^\W_]+", plain))


@pytest.fixture(scope="module")
def sections(spark):  # noqa: ANN001, ANN201
    return base.sections(spark, SF).collect()


@pytest.fixture(scope="module")
def terms(sections):  # noqa: ANN001, ANN201
    """Terms of each section, and the number of sections that hold each term."""
    own = {r["section_id"]: words(r["text"]) for r in sections}
    return own, Counter(t for ts in own.values() for t in ts)


def roles(before, after):  # noqa: ANN001, ANN201
    return {t: "kept" if t in before and t in after else "replaced" if t in before else "added" for t in before | after}


def strength(df, n, is_word, replaced):  # noqa: ANN001, ANN201
    whole = math.floor(round(math.log((n + 1) / df) * 1000, 6))
    whole = whole // 3 if is_word else whole
    return whole if replaced else whole // 4


def test_changed_terms(spark, sections, terms):  # noqa: ANN001
    own = {(r["doc_id"], r["idx"]): terms[0][r["section_id"]] for r in sections}
    changes = {(d, i) for d, i in own} | {(d, i - 1) for d, i in own if i}
    want = {(f"{d}-{i}", t, role) for d, i in changes for t, role in roles(own.get((d, i), set()), own.get((d, i + 1), set())).items()}
    got = [tuple(r) for r in QUERIES["changed_terms"](spark, SF).select("change", "term", "role").collect()]
    assert len(got) == len(want) and set(got) == want


def test_impact_candidates(spark, sections, terms):  # noqa: ANN001
    own, df = terms
    at, n = {(r["doc_id"], r["idx"]): own[r["section_id"]] for r in sections}, len(sections)
    held = defaultdict(list)
    hashes = {(r["doc_id"], r["idx"]): r["section_hash"] for r in sections}
    by_id = {r["section_id"]: r["section_hash"] for r in sections}
    for r in sections:
        for t in own[r["section_id"]]:
            held[t].append((r["section_id"], r["doc_id"]))
    order, want = {"replaced": 0, "added": 1, "kept": 2}, set()
    for d in {d for d, i in at if i < 2}:
        found = roles(at.get((d, 0), set()), at.get((d, 1), set()))
        chosen = sorted((order[role], df[t], t) for t, role in found.items() if df[t] <= max(10, math.floor(n * 0.2)))[:12]
        score = Counter()
        now = hashes.get((d, 1))
        for role, f, t in chosen:
            for s in held[t]:
                if s == (f"{d}#0", d) or now is not None and by_id[s[0]] == now:
                    continue  # the changed section itself, and those that read as it does now
                score[s] += strength(f, n, not re.search("[0-9]", t), role == 0)
        taken, place = Counter(), 0
        for (section, doc), x in sorted(score.items(), key=lambda p: (-p[1], p[0][0])):
            taken[doc] += 1
            if taken[doc] <= 2 and place < 8:
                place += 1
                want.add((d, section, x, place))
    got = [tuple(r) for r in QUERIES["impact_candidates"](spark, SF).select("change", "section_id", "strength", "place").collect()]
    assert len(got) == len(want) and set(got) == want


def test_qrels_hold_the_whole_passage(spark, tmp_path):  # noqa: ANN001
    """A document that shares the opening only isn't relevant, nor are passages with equal openings each other's."""
    opening = "one opening of forty characters and more is "
    docs = [(1, f"x {opening}shared here y"), (2, f"{opening}other"), (3, f"{opening}shared her"), (4, None), (5, f"{opening}shared here\n{opening}other")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, f"{opening}shared here"), (2, f"{opening}other")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in base.qrels(spark, str(tmp_path)).collect())
    assert got == [(1, "1"), (1, "5"), (2, "2"), (2, "5")]


def test_qrels_of_the_tables(spark):  # noqa: ANN001
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = {(q, str(d)) for q, passage in items for d, text in docs if text is not None and passage in text}
    assert {tuple(r) for r in base.qrels(spark, SF).collect()} == want


def test_every_term_has_its_frequency_and_weight(spark, sections, terms):  # noqa: ANN001
    df, n = terms[1], len(sections)
    got = [tuple(r) for r in QUERIES["term_df"](spark, SF).select("term", "df").collect()]
    assert len(got) == len(df) and dict(got) == df
    got = [tuple(r) for r in QUERIES["strength_weight"](spark, SF).select("term", "weight").collect()]
    assert len(got) == len(df) and dict(got) == {t: strength(f, n, not re.search("[0-9]", t), len(t) % 2 == 0) for t, f in df.items()}


def test_every_section_is_embedded_whole(spark, sections):  # noqa: ANN001
    want = {r["section_id"]: hashlib.md5(f"{r['source']} / {r['lang']}\n{r['text']}\n{r['text']}".encode()).hexdigest() for r in sections}
    got = [tuple(r) for r in QUERIES["embed_texts"](spark, SF).select("section_id", "digest").collect()]
    assert len(got) == len(want) and dict(got) == want


def test_signature_groups_without_a_bound(spark):  # noqa: ANN001
    rows = spark.createDataFrame([(i, ["a"], ["b"]) for i in range(40)] + [(50, ["c"], []), (51, ["c"], []), (52, ["d"], [])], "id bigint, removed array<string>, added array<string>")
    groups = lambda most: sorted((r["n"], r["first_id"]) for r in impact.signature_groups(rows, most).collect())
    assert groups(None) == [(2, 50), (40, 0)] and groups(30) == [(2, 50)]


def test_bootstrap_of_all_labels(spark, tmp_path, monkeypatch):  # noqa: ANN001
    """The table's means are those of the collected list, in blocks and pieces too, and ids of any size count."""
    import random

    rng = random.Random(4)
    rows = [(i * 7, rng.randint(0, 5)) for i in range(300)]
    rng.shuffle(rows)
    y, start = [float(q) for _, q in sorted(rows)], bootstrap.stream_start(evaluations.SEED, "quality")
    table = spark.createDataFrame(rows, "doc_id bigint, quality bigint")
    want = {r["draw"]: round(r["mean"], 9) for r in bootstrap.draw_means(spark, [y], [start], 70).collect()}
    means = lambda: {r["draw"]: round(r["mean"], 9) for r in bootstrap.table_means(table, ["doc_id"], "quality", start, 70).collect()}
    assert means() == want
    monkeypatch.setattr(bootstrap, "BLOCK", 64)
    monkeypatch.setattr(bootstrap, "PIECE", 37)
    assert means() == want
    table.write.parquet(f"{tmp_path}/labels.parquet")
    one = bootstrap.interval(bootstrap.draw_means(spark, [y], [start], 2000)).first()
    assert tuple(QUERIES["bootstrap_ci"](spark, str(tmp_path)).first()) == (round(one[0], 6), round(one[1], 6))


def test_quantiles_of_all_users(spark, tmp_path):  # noqa: ANN001
    rows = [(u, float(i * i % 17)) for u in (1, 19, 20, 10**9) for i in range(u % 7 + 1)]
    spark.createDataFrame(rows, "user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    own = defaultdict(list)
    for u, v in rows:
        own[u].append(v)
    for name, half in (("quantiles_t4", 0.5), ("quantiles_latency", 0.0)):
        want = {u: tuple(sorted(v)[math.floor((len(v) - 1) * q + half)] for q in (0.5, 0.9)) for u, v in own.items()}
        assert {r["user_id"]: (r["p50"], r["p90"]) for r in QUERIES[name](spark, str(tmp_path)).collect()} == want


def test_f1_of_all_documents(spark, tmp_path):  # noqa: ANN001
    docs = [(1, "a b"), (399, " ".join(f"w{i}" for i in range(30))), (400, " ".join(f"w{i}" for i in range(30))), (10**9, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["f1"] for r in QUERIES["set_f1"](spark, str(tmp_path)).collect()}.keys() == {1, 399, 400, 10**9}


def rows_of(spark, name):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_arms_take_turns_over_all_events(spark):  # noqa: ANN001
    turn, first = Counter(), {}
    for r in sorted(rows_of(spark, "events"), key=lambda r: r["event_id"]):
        turn[r["event_type"]] += 1
        at = (turn[r["event_type"]], r["event_type"])
        first[r["event_id"] % 90] = min(first.get(r["event_id"] % 90, at), at)
    got = QUERIES["round_robin_arms"](spark, SF).collect()
    assert {(r["item"], r["arm"], r["turn"]) for r in got} == {(i, a, t) for i, (t, a) in first.items()} and len(got) == len(first)


def test_arms_take_late_events(spark, tmp_path):  # noqa: ANN001
    spark.createDataFrame([(1, "a"), (600, "b")], "event_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert {(r["item"], r["arm"]) for r in QUERIES["round_robin_arms"](spark, str(tmp_path)).collect()} == {(1, "a"), (60, "b")}


def test_depths_of_all_users(spark, tmp_path):  # noqa: ANN001
    rows = [(u * 1000 + i, u, "e", float(-i)) for u in (19, 20, 10**6) for i in range(12)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in QUERIES["adaptive_depth"](spark, str(tmp_path)).select("query_id", "depth").collect()} == {(u, 16) for u in (19, 20, 10**6)}


def test_folders_count_all_orders(spark):  # noqa: ANN001
    changed = defaultdict(set)
    for r in rows_of(spark, "orders"):
        changed[r["o_orderpriority"], r["o_orderdate"].toordinal()].add(r["o_custkey"])
    members = {(f, d): len(set().union(*(changed.get((f, d - k), set()) for k in range(14)))) for f, d in changed}
    got = {(r["folder"], r["day"].toordinal()): r["members"] for r in QUERIES["calendar_questions"](spark, SF).collect()}
    assert got == {k: n for k, n in members.items() if 1 <= n <= 12}


def test_all_sections_are_relocated(spark, sections):  # noqa: ANN001
    now = defaultdict(list)
    for r in base.edited(base.sections(spark, SF)).collect():
        now[r["doc_id"]].append((r["idx"], r["section_hash"]))
    want = {}
    for r in sections:
        met = [(0 if h == r["section_hash"] and i == r["idx"] else 1 if h == r["section_hash"] else 3, i) for i, h in now[r["doc_id"]] if h == r["section_hash"] or i == r["idx"]]
        if met:
            want[r["doc_id"], r["idx"]] = min(met)[1]
    assert {(r["doc_id"], r["idx"]): r["now_idx"] for r in QUERIES["relocated"](spark, SF).collect()} == want


def test_all_hashes_fan_out(spark, sections):  # noqa: ANN001
    alike = defaultdict(list)
    for r in sections:
        alike[r["section_hash"]].append(r["section_id"])
    got = [tuple(r) for r in QUERIES["hash_fanout"](spark, SF).select("hit", "section_id").collect()]
    assert sorted(got) == sorted((min(ids), s) for ids in alike.values() for s in ids)


def test_every_fiftieth_vector_asks(spark):  # noqa: ANN001
    v = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id id", "embedding vector")
    want = retrieval.vector_hits(v, v.where("id % 50 = 0").selectExpr("id query_id", "vector"), 10).select("query_id", "id", "cosine", "rank").collect()
    got = QUERIES["vector_topk"](spark, SF).select("query_id", "id", "cosine", "rank").collect()
    assert len({r["query_id"] for r in got}) == v.where("id % 50 = 0").count() and Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_blocks_of_vectors_lose_no_hit(spark, monkeypatch):  # noqa: ANN001
    """Ties, short tables of other lengths and null vectors, in blocks of a few rows."""
    rows = [(i, [float(i % 3), float(i % 5 - 2), 1.0]) for i in range(60)] + [(60 + i, [1.0, float(i)]) for i in range(4)] + [(70, None)]
    v = spark.createDataFrame(rows, "id bigint, vector array<float>")
    asked = v.where("id % 4 = 0").selectExpr("id query_id", "vector")
    monkeypatch.setattr(retrieval, "VECTORS_A_BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERIES_A_BLOCK", 3)
    columns = ["query_id", "id", "cosine", "rank"]
    assert Counter(map(tuple, retrieval.vector_hits_in_blocks(v, asked, 5).select(*columns).collect())) == Counter(map(tuple, retrieval.vector_hits(v, asked, 5).select(*columns).collect()))
