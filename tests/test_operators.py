"""Small cases with known answers."""

from __future__ import annotations

import sqlite3
from datetime import UTC, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import markdown, times
from marginalia.operators import bootstrap, cards, diff, impact, parsing, reports, retrieval
from marginalia.sources import files, git
from marginalia.streaming import watch


def delta(spark, old, new):  # noqa: ANN001, ANN202
    frame = lambda rows: spark.createDataFrame([("d", h, i) for i, h in enumerate(rows)], "doc_id string, section_hash string, idx int")
    got = diff.section_delta(frame(old), frame(new)).groupBy("kind").count().collect()
    n = {r["kind"]: r["count"] for r in got}
    return tuple(n.get(k, 0) for k in ("added", "unchanged", "moved", "removed"))


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [("ab", "ab", (0, 2, 0, 0)), ("", "ab", (2, 0, 0, 0)), ("ab", "ac", (1, 1, 0, 1)), ("ab", "acb", (1, 1, 1, 0)), ("ab", "ba", (0, 0, 2, 0)), ("aa", "a", (0, 1, 0, 1)), ("a", "aa", (0, 1, 1, 0)), ("", "aa", (1, 0, 0, 0)), ("a", "", (0, 0, 0, 1))],
)
def test_section_delta(spark, old, new, want):  # noqa: ANN001
    assert delta(spark, old, new) == want


def test_bm25_equals_fts5(spark):  # noqa: ANN001
    """Scores and order against SQLite's own index, with weights, phrases and prefixes."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("section_id"), F.concat_ws(" / ", "source", "lang").alias("heading"), "text").collect()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(section_id UNINDEXED, heading, text, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [tuple(r) for r in rows])
    frame = spark.createDataFrame(rows)
    index, sizes = retrieval.postings(frame, ["heading", "text"]).cache(), retrieval.lengths(frame, ["heading", "text"]).cache()
    asked = {"the of": '"the" AND "of"', "of.the": '"of the"', "thing*": "thing*", "src1 en": '"src1" AND "en"'}
    scored = retrieval.all_terms(retrieval.bm25(retrieval.phrase_hits(index, retrieval.phrases(retrieval.query_frame(spark, {q: q for q in asked}))), sizes, {"heading": 3.0, "text": 1.0})).collect()
    for query, match in asked.items():
        want = {r[0]: round(-r[1], 6) for r in db.execute("SELECT section_id, bm25(t, 0, 3, 1) FROM t WHERE t MATCH ?", (match,))}
        got = {r["section_id"]: round(r["score"], 6) for r in scored if r["query_id"] == query}
        assert got.keys() == want.keys() and want
        assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_markdown_sections():
    doc = markdown.parse("---\ntitle: T\n---\nintro\n\n# A\ntext [x](b.md) <https://e.org>\n## B\n```python\n# no heading\n```\n| a | b |\n|---|---|\n\nSet\n===\nend\n")
    assert [(s.level, s.heading_path, s.line_start, s.line_end) for s in doc.sections] == [(0, [], 4, 4), (1, ["A"], 6, 7), (2, ["A", "B"], 8, 13), (1, ["Set"], 15, 17)]
    assert doc.title == "A" and doc.frontmatter == "title: T"
    assert doc.links_internal == ["b.md"] and doc.links_external == ["https://e.org"]
    assert doc.sections[2].code_langs == ["python"] and doc.sections[2].has_tables
    assert markdown.parse("import X from 'x'\n\nexport const title = 'Y'\n\n# H\n", "mdx").sections[0].line_start == 5
    assert markdown.parse("").sections == []


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab #`~*|-=\n<>!", max_size=200))
def test_markdown_ranges(text):  # noqa: ANN001
    doc = markdown.parse(text)
    last = 0
    lines = text.split("\n")
    for s in doc.sections:
        assert last < s.line_start <= s.line_end <= len(lines)
        assert s.text == "\n".join(x.rstrip() for x in lines[s.line_start - 1 : s.line_end])
        last = s.line_end
    again = markdown.parse(text.replace("\n", "\r\n"))
    assert [s.hash for s in again.sections] == [s.hash for s in doc.sections]


def test_snippet_and_chunk():
    assert markdown.snippet("# H\n\n- one **two**\n---\n[l](x) three") == "one two l three"
    assert markdown.chunk_text("a" * 10) == ("a" * 10, False)
    text, cut = markdown.chunk_text("one\n\n" + "two " * 20, 10)
    assert cut and text.startswith("one") and "truncated" in text


def test_markdown_files(spark, tmp_path):  # noqa: ANN001
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    for name, body in {"a/x.md": b"# X\n", "b.MDX": b"# B\n", "c.txt": b"no", ".git/d.md": b"# D\n", "a/skip.md": b"# S\n", "bad.md": b"\xff\xfe"}.items():
        (tmp_path / name).write_bytes(body)
    found = files.markdown_files(spark, str(tmp_path), ["skip.md"])
    assert {(r["path"], r["text"]) for r in found.collect()} == {("a/x.md", "# X\n"), ("b.MDX", "# B\n"), ("bad.md", None)}
    parsed = parsing.sections_of(parsing.parse_markdown(found.where("text IS NOT NULL")))
    assert {(r["path"], tuple(r["heading_path"])) for r in parsed.collect()} == {("a/x.md", ("X",)), ("b.MDX", ("B",))}
    known = found.where("path = 'a/x.md'").select("path", F.sha2("text", 256).alias("content_hash"))
    assert {r["path"] for r in parsing.only_changed(found.where("text IS NOT NULL"), known).collect()} == {"b.MDX"}


def test_cards(spark):  # noqa: ANN001
    body = '{"tldr": " T ", "summary": "s", "keywords": ["k", "k", " "], "questions_answered": [], "entities": {"people": ["Ann", "Bob"], "orgs": [], "products": [], "technologies": [], "files_paths": [], "commands": []}, "mentioned_dates": [{"raw": "May 2024", "iso": "2024-05", "precision": "month", "evidence": ""}, {"raw": "May 2024", "iso": "2023-05", "precision": "month", "evidence": ""}, {"raw": "x", "iso": "2024-02-30", "precision": "day", "evidence": ""}], "decisions": [], "action_items": []}'
    rows = spark.createDataFrame([("ann met “them” in May 2024. x", body), ("t", '{"tldr": 1, "odd": 2}'), ("t", "no")], "text string, summary string")
    got = cards.validate(cards.read_cards(rows)).collect()
    assert [g["state"] for g in got] == ["summarized", "failed", "failed"]
    assert got[0]["card"]["entities"]["people"] == ["Ann"] and got[0]["dropped_entities"] == ["people:Bob"]
    assert [d["iso"] for d in got[0]["card"]["mentioned_dates"]] == ["2024-05"]
    assert got[0]["card"]["keywords"] == ["k"] and got[0]["card"]["tldr"] == "T" and got[0]["trimmed"] == ["keywords"]


def test_splitmix_is_sequential():
    start = bootstrap.stream_start(7, "x")
    assert bootstrap.indices(start, 0, 500, 37).tolist() == bootstrap.sequential(start, 500, 37)
    assert bootstrap.value_at(0, 0) == 0xE220A8397B1DCDAF  # the generator's published first value for seed 0


def test_paired(spark):  # noqa: ANN001
    pairs = spark.createDataFrame([("p", i, i % 2, 1) for i in range(20)] + [("q", i, 1, 1) for i in range(5)], "project string, id int, base int, new int")
    r = bootstrap.paired(pairs, 1, "a", 400).first()
    assert r["delta"] == 0.25 and (r["wins"], r["losses"], r["ties"]) == (10, 0, 15) and r["low"] <= 0.25 <= r["high"]


def test_times():
    now = datetime(2024, 2, 1, tzinfo=UTC)
    assert times.parse_time("7d", now).day == 25 and times.parse_time("2026-09-21", now).hour == 0 and times.parse_time("2026-09-21T10:00:00Z", now).hour == 10
    for bad in ("3x", "yesterday", "9223372036854775807h"):
        with pytest.raises(ValueError):
            times.parse_time(bad, now)


def test_prices(spark):  # noqa: ANN001
    calls = spark.createDataFrame([("small-2-pro", 1_000_000, 0), ("small", 0, 1_000_000), ("none", 5, 5)], "model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("small", 0.25, 1.25), ("small-2", 0.5, 2.0)], "prefix string, usd_in double, usd_out double")
    assert {r["model"]: r["cost_usd"] for r in reports.price(calls, prices).collect()} == {"small-2-pro": 0.5, "small": 1.25, "none": 0.0}


def test_pair_sections(spark):  # noqa: ANN001
    frame = lambda rows: spark.createDataFrame([("p", *r) for r in rows], "path string, idx int, heading string, text string")
    got = impact.pair_sections(frame([(0, "A", "x"), (1, "B", "y"), (2, "C", "z"), (3, "C", "w")]), frame([(0, "B", "y2"), (1, "A", "x"), (2, "C", "q"), (3, "C", "w")])).collect()
    assert {(r["old_idx"], r["new_idx"]) for r in got if r["stage"]} == {(0, 1), (1, 0), (2, 2), (3, 3)}


def test_git_outputs(spark):  # noqa: ANN001
    now = F.timestamp_seconds(F.lit(10_000))
    sha = "a" * 40
    out = "".join(f"{sha} {n} {n} 1\nauthor x\nauthor-time {100 * n}\ncommitter y\ncommitter-time {50 + 100 * n}\nfilename f\n\tline {n}\n" for n in (1, 2))
    got = git.line_times(spark.createDataFrame([("f", out)], "path string, output string"), now).select("line", F.unix_seconds("at").alias("s")).collect()
    assert {(r["line"], r["s"]) for r in got} == {(1, 100), (2, 200)}
    tree = git.tree(spark.createDataFrame([(f"100644 blob {sha}\tdir/a b.md",), (f"120000 blob {sha}\tlink",)], "line string")).collect()
    assert [(r["path"], r["blob"]) for r in tree] == [("dir/a b.md", sha)]


def test_quotes():
    assert parsing.locate("“Hello  world”", 'say "hello\nworld" now') == (4, 17)
    assert parsing.locate("absent", "text") == (None, None)


def test_plan_batch(spark):  # noqa: ANN001
    f = lambda rows, s: spark.createDataFrame(rows, s)
    got = watch.plan_batch(f([("a.md",), ("b.md",), ("c.md",), ("d.txt",), ("e.md",)], "path string"), f([("b.md", "1"), ("c.md", "2")], "path string, content_hash string"), f([("a.md", "1"), ("c.md", "9"), ("e.md", "7")], "path string, content_hash string")).collect()
    assert {(r["path"], r["action"], r["from_path"]) for r in got} == {("b.md", "rename", "a.md"), ("c.md", "index", None), ("d.txt", "ignore", None), ("e.md", "tombstone", None)}


def test_event_time_sessions(spark, tmp_path):  # noqa: ANN001
    rows = [("a.md", datetime(2024, 1, 1, 0, 0, 0), 1), ("a.md", datetime(2024, 1, 1, 0, 0, 0, 500000), 2), ("a.md", datetime(2024, 1, 1, 0, 1, 0), 3), ("b.md", datetime(2024, 1, 1, 0, 10, 0), 1)]
    spark.createDataFrame(rows, "path string, at timestamp, size long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, at timestamp, size long").parquet(str(tmp_path / "in"))
    query = watch.settled_paths(stream).writeStream.format("memory").queryName("let_go").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["path"], r["hints"], r["size"]) for r in spark.table("let_go").collect()}
    assert got == {("a.md", 2, 2), ("a.md", 1, 3)}


def test_backoff_and_concurrency():
    assert [watch.next_interval(n) for n in range(9)] == [0.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0, 300.0, 300.0]
    assert watch.concurrency(["ok"] * 8 + ["rate_limited", "ok"])[-3:] == [3, 1, 1]



def test_growing_files_wait():
    """A path whose size changed since its last hint is held for another quiet period."""
    import pandas as pd

    from marginalia.streaming.watch import Debounce

    class Value:
        now = None

        def exists(self):  # noqa: ANN202
            return self.now is not None

        def get(self):  # noqa: ANN202
            return self.now

        def update(self, row):  # noqa: ANN001, ANN202
            self.now = row

        def clear(self):  # noqa: ANN202
            self.now = None

    class Handle:
        def __init__(self):
            self.value, self.timers = Value(), []

        def getValueState(self, *_):  # noqa: ANN002, ANN202, N802
            return self.value

        def listTimers(self):  # noqa: ANN202, N802
            return list(self.timers)

        def deleteTimer(self, at):  # noqa: ANN001, ANN202, N802
            self.timers.remove(at)

        def registerTimer(self, at):  # noqa: ANN001, ANN202, N802
            self.timers.append(at)

    class Clock:
        def __init__(self, now):  # noqa: ANN001
            self.now = now

        def getCurrentProcessingTimeInMs(self):  # noqa: ANN202, N802
            return self.now

    sizes = {"a.md": 10}
    handle, debounce = Handle(), type("D", (Debounce,), {"size_now": staticmethod(sizes.get)})()
    debounce.init(handle)
    list(debounce.handleInputRows(("a.md",), iter([pd.DataFrame({"size": [7]})]), Clock(0)))
    assert list(debounce.handleExpiredTimer(("a.md",), Clock(1000), None)) == [] and handle.timers[-1] == 2000
    sizes["a.md"] = 12
    assert list(debounce.handleExpiredTimer(("a.md",), Clock(2000), None)) == [] and handle.timers[-1] == 3000
    (out,) = debounce.handleExpiredTimer(("a.md",), Clock(3000), None)
    assert out["path"].tolist() == ["a.md"] and out["hints"].tolist() == [1] and not handle.value.exists()


def test_saved_tables_follow_their_inputs(spark, tmp_path):  # noqa: ANN001
    from marginalia.sources import store

    place, made = f"file://{tmp_path}/in", []

    def make():  # noqa: ANN202
        made.append(1)
        return spark.read.parquet(place)

    spark.range(3).write.parquet(place)
    for _ in range(2):
        assert store.saved(spark, "t", [place], make).count() == 3
    assert len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(place)
    assert store.saved(spark, "t", [place], make).count() == 5 and len(made) == 2


def test_stop_words():
    from marginalia.operators.retrieval import STOP_WORDS

    assert {"the", "how", "your"} <= STOP_WORDS and len(STOP_WORDS) == 40


def test_many_queries_meet_all_vectors(spark, monkeypatch):  # noqa: ANN001
    from marginalia.operators import retrieval as R

    v = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)], "id bigint, vector array<double>")
    asked = v.where("id < 9").selectExpr("id AS query_id", "vector")
    want = sorted(map(tuple, R.vector_hits(v, asked, 4).collect()))
    monkeypatch.setattr(R, "FEW_QUERIES", 3)
    monkeypatch.setattr(R, "VECTORS_A_SALT", 10)
    assert sorted(tuple(r[c] for c in ("query_id", "id", "cosine", "rank")) for r in R.vector_hits(v, asked, 4).collect()) == want


def test_search_gives_what_joins_of_postings_give(spark):  # noqa: ANN001
    """Phrases, prefixes, words asked for twice, many equal scores, several batches; and only the best rows are shuffled."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from marginalia.operators import retrieval as R

    words = ["the", "of", "thing", "things", "in", "end"]
    made = [(f"{k // 4}#{k % 4}", " ".join(words[(k * 7 + i * i * (1 + k % 5)) % 6] for i in range(1 + k % 9)), f"{words[k % 6]} head") for k in range(1200)]
    rows = spark.createDataFrame([*made, ("x#0", None, ""), ("y#0", "", None)], "section_id string, text string, heading string").repartition(3)
    weights = {"heading": 3.0, "text": 1.0}
    asked = R.phrases(R.query_frame(spark, {"a": "the of", "b": "the-of thing*", "c": "in in nosuch", "d": "the.the", "e": "t* of", "f": "end"}))
    scored = R.bm25(R.phrase_hits(R.postings(rows, list(weights)), asked), R.lengths(rows, list(weights)), weights).cache()
    own = F.row_number().over(Window.partitionBy("query_id", F.substring_index("section_id", "#", 1)).orderBy(F.desc("score"), "section_id"))
    wanted = {
        "all": R.top(R.all_terms(scored), 7).withColumn("partial", F.lit(False)), "best": R.top(R.any_if_none(scored), 7),
        "any": R.top(scored.withColumn("own", own).where("own <= 2"), 7).withColumn("partial", F.lit(False)),
    }
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for need, want in wanted.items():
            got = R.search(R.terms(rows, list(weights)), asked, weights, 7, need=need, per_doc=2 if need == "any" else None)
            columns = ["query_id", "section_id", "n_phrases", "matched", "partial", "score", "rank"]
            assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())), need
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # it is what the registered queries do: before, each shuffled postings and every hit
    from marginalia.plans.registry import QUERIES

    plan = QUERIES["bm25_or_fallback"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_means_summed_in_another_order_are_the_same(spark):  # noqa: ANN001
    """On both sides of a rounding limit, apart by the last bits only; nulls and NaN equal themselves."""
    from marginalia.operators import replays

    nan, inf = float("nan"), float("inf")
    frame = lambda rows: spark.createDataFrame(rows, "id int, n long, mean double")
    was = frame([(1, 3, 0.1234565 - 1e-12), (2, 3, 0.1234), (3, 1, None), (4, 1, nan), (5, 1, None), (6, 2, 1.0), (7, 1, inf), (8, 1, 0.0)])
    now = frame([(1, 3, 0.1234565 + 1e-12), (2, 3, 0.123402), (3, 1, None), (4, 1, nan), (5, 1, 0.0), (6, 3, 1.0), (7, 1, inf), (9, 1, 0.0)])
    got = {tuple(r) for r in replays.regenerated(was, now, "id", ["n", "mean"]).collect()}
    assert got == {(2, "different"), (5, "different"), (6, "different"), (8, "extra"), (9, "missing")}


def test_terms_of_changes_are_told_apart_in_one_shuffle(spark):  # noqa: ANN001
    frame = lambda rows: spark.createDataFrame(rows, "change string, text string")
    got = impact.changed_terms(frame([("a", "one two two"), ("b", "old"), ("d", None)]), frame([("a", "two three"), ("c", "new"), ("d", "Été")]))
    want = {("a", "one", "replaced"), ("a", "two", "kept"), ("a", "three", "added"), ("b", "old", "replaced"), ("c", "new", "added"), ("d", "ete", "added")}
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_many_files_are_paired_in_a_batch(spark):  # noqa: ANN001
    """No Python call a file, texts stay out, and both sides go through one shuffle."""
    frame = lambda rows: spark.createDataFrame(rows, "path string, idx int, heading string, text string")
    old, new = frame([(f"f{k}", i, f"h{i}", f"t{i}") for k in range(700) for i in range(2)]), frame([(f"f{k}", 1 - i, f"h{i}", f"t{i}") for k in range(699) for i in range(2)])
    made = impact.pair_sections(old, new)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {tuple(r) for r in made.collect()}
    assert got == {(f"f{k}", i, 1 - i, 1) for k in range(699) for i in range(2)} | {("f699", i, None, None) for i in range(2)}


def test_parsed_files_leave_python_in_slices():
    """A batch of files isn't held as sections all at once; every file is parsed."""
    import pandas as pd

    texts = pd.Series([f"# t{k}\n\n" + "word " * 4000 for k in range(300)])
    parts = list(parsing.parsed_slices(iter([(texts, pd.Series(["markdown"] * 300))])))
    assert len(parts) > 2 and max(map(len, parts)) * 20_000 < 2 * parsing.SLICE_CHARS
    assert [d["title"] for p in parts for d in p["doc"]] == [f"t{k}" for k in range(300)]


def test_candidates_are_those_of_scoring_every_section(spark, monkeypatch):  # noqa: ANN001
    """Many equal strengths, documents over several slices, floors that rise; no more rows than a change's best leave a task."""
    import random

    rnd, words = random.Random(5), [f"w{k}" for k in range(25)]
    sections = [(f"{k // 5}#{k % 5}", k // 5, f"h{k % 40}", " ".join(rnd.sample(words, rnd.randint(0, 9)))) for k in range(900)]
    held = {s[0]: set(s[3].split()) for s in sections}
    df = {w: sum(w in h for h in held.values()) for w in words}
    changes = [(c, [(w, df[w], rnd.choice((0, 3, 3, 7))) for w in rnd.sample(words, rnd.randint(1, 6))], f"{c}#0", f"h{c}" if c % 2 else None) for c in range(30)]
    want = set()
    for c, terms, own, after in changes:
        scored = [(-sum(w for t, _, w in terms if t in held[i]), i, d) for i, d, h, _ in sections if i != own and h != after and any(t in held[i] for t, _, _ in terms)]
        of_doc: dict = {}
        best = []
        for s, i, d in sorted(scored):
            of_doc[d] = of_doc.get(d, 0) + 1
            best += [(c, i, d, -s)] if of_doc[d] <= 2 else []
        want |= {(*r, k + 1) for k, r in enumerate(best[:8])}
    asked = spark.createDataFrame(changes, "change bigint, terms array<struct<term: string, df: bigint, weight: bigint>>, own string, after string")
    frame = spark.createDataFrame(sections, "section_id string, doc_id bigint, section_hash string, held string").coalesce(1)
    monkeypatch.setattr(impact, "CHANGES_A_BLOCK", 11)
    got = impact.candidates(asked, frame)
    assert {tuple(r[k] for k in ("change", "section_id", "doc_id", "strength", "place")) for r in got.collect()} == want
    # the same in one process, in small slices
    for name, value in (("SECTIONS_A_SLICE", 16), ("ROWS_A_PRUNING", 40), ("PAIRS_A_SUM", 30)):
        monkeypatch.setattr(impact, name, value)
    block = impact._block(asked.toArrow(), None)
    block |= {"whole": True}
    first = impact._best_of_task(iter(frame.toArrow().to_batches(max_chunksize=100)), block, 2, 8)
    assert 0 < first.num_rows <= 8 * len(changes)
    order = {c: k for k, c in enumerate(block["change"].to_pylist())}
    import numpy as np

    ends = {r[0]: r for r in want if r[4] == 8}
    floors = np.array([ends[c][3] if c in ends else -1 for c in order], np.int64), [ends[c][1] if c in ends else None for c in order]
    best = impact._best_of_task(iter(frame.toArrow().to_batches(max_chunksize=100)), impact._block(asked.toArrow(), floors), 2, 8)
    assert {(c, *r) for c, k in order.items() for r in zip(*(best.filter(np.array(best.column("c")) == k).column(n).to_pylist() for n in ("section_id", "doc_id", "strength")), strict=True)} == {r[:4] for r in want}


def test_first_look_sees_common_terms_and_sums_agree(monkeypatch):  # noqa: ANN001
    """Bounds of the first look count a change's common terms too (before: its rarest ones only, so that almost every pair was
    summed); changes summed one by one have the result of those summed together, and of scoring every section."""
    import random

    import numpy as np
    import pyarrow as pa

    rnd, common = random.Random(8), [f"c{k}" for k in range(12)]
    held = [(["rare"] if k % 40 == 7 else []) + [w for w in common if rnd.random() < 0.4] for k in range(4000)]
    ids = [f"{k // 7}#{k % 7}" for k in range(4000)]
    frame = pa.table({"section_id": ids, "doc_id": [k // 7 for k in range(4000)], "section_hash": [f"h{k % 900}" for k in range(4000)], "held": [" ".join(h) for h in held]})
    df = {w: sum(w in h for h in held) for w in ("rare", *common)}
    asked = [[("rare", 900)] + [(w, rnd.randint(200, 400)) for w in rnd.sample(common, 5)] for _ in range(20)]
    rows = [{"change": c, "terms": [{"term": t, "df": df[t], "weight": w} for t, w in terms], "own": f"{c}#0", "after": f"h{c}" if c % 2 else None} for c, terms in enumerate(asked)]
    kind = pa.struct([("term", pa.string()), ("df", pa.int64()), ("weight", pa.int64())])
    changes = pa.Table.from_pylist(rows, schema=pa.schema([("change", pa.int64()), ("terms", pa.list_(kind)), ("own", pa.string()), ("after", pa.string())]))
    want = {}
    for c, terms in enumerate(asked):
        scored = sorted((-sum(w for t, w in terms if t in h), i, k // 7) for k, (i, h) in enumerate(zip(ids, held, strict=True)) if i != f"{c}#0" and not (c % 2 and k % 900 == c) and any(t in h for t, _ in terms))
        of_doc, best = {}, []
        for s, i, d in scored:
            of_doc[d] = of_doc.get(d, 0) + 1
            best += [(i, -s)] if of_doc[d] <= 2 else []
        want[c] = best[:8]

    def best_of(floors):  # noqa: ANN001, ANN202
        got = impact._best_of_task(iter(frame.to_batches(max_chunksize=700)), impact._block(changes, floors), 2, 8)
        return {c: [(r["section_id"], r["strength"]) for r in got.to_pylist() if r["c"] == c] for c in range(20)}

    first = best_of(None)
    assert all(900 < first[c][7][1] <= want[c][7][1] for c in range(20))
    floors = np.array([first[c][7][1] for c in range(20)]), [first[c][7][0] for c in range(20)]
    for alone, size in ((0, 1500), (0, 10_000), (10**9, 1500), (256, 10_000)):
        for name, value in (("PAIRS_BY_ITSELF", alone), ("SECTIONS_A_SLICE", size), ("ROWS_SORTED", 5), ("CHANGES_AS_LISTS", 3)):
            monkeypatch.setattr(impact, name, value)
        assert best_of(floors) == want


def test_a_task_hands_on_its_own_best_only(spark, monkeypatch):  # noqa: ANN001
    """However many slices a task reads, k rows of a question leave it (before: k of each slice, which grew with the table)."""
    from marginalia.operators import retrieval as R

    made = [(f"{k // 3}#{k % 3}", " ".join(["the"] * (1 + k * 7 % 5) + ["of"] * (k * 3 % 4))) for k in range(900)]
    rows = spark.createDataFrame(made, "section_id string, text string").repartition(2).cache()
    asked = R.phrases(R.query_frame(spark, {"a": "the", "b": "the of"}))
    handed, real = [], R.top
    monkeypatch.setattr(R, "top", lambda found, k: handed.append(found) or real(found, k))
    find = lambda **more: sorted(map(tuple, R.search(R.terms(rows, ["text"]), asked, {"text": 1.0}, 5, **more).select("query_id", "section_id", "score", "rank").collect()))
    for more in ({}, {"need": "any", "per_doc": 2}):
        want = find(**more)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
        try:
            assert find(**more) == want and len(want) == 10
            assert handed[-1].count() <= 2 * 2 * 5 * more.get("per_doc", 1)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranks_are_cut_before_the_shuffle(spark):  # noqa: ANN001
    """Before, every scored row was shuffled to its question's task."""
    from marginalia.operators import retrieval as R

    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "id bigint, vector array<float>")
    asked = v.where("id < 2").selectExpr("id query_id", "vector")
    scored = v.selectExpr("id % 2 query_id", "cast(id as string) section_id", "cast(id as double) score")
    for df in (R.top(scored, 3), R.vector_hits(v, asked, 3), R.vector_hits_in_blocks(v, asked, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        final, exchange, partial = (plan.index(x) for x in ("WindowGroupLimit", "Exchange hashpartitioning(query_id", "Partial"))
        assert final < exchange < partial
        assert sorted(r["rank"] for r in df.collect()) == [0, 0, 1, 1, 2, 2]
