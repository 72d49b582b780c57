"""State transitions that SQL can't express, and paths."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import path_prefix_under
from marginalia.operators import impact as I
from marginalia.operators import states as T


def test_review_takes_turns(spark):  # noqa: ANN001
    rows = [
        ("r", 1, 0, 5, "s1", ["a"]), ("r", 1, 1, 9, "s2", ["b", "a"]), ("r", 1, 2, 9, "s3", ["a"]),
        ("r", 2, 0, 10, "s2", ["a", "b"]), ("r", 2, 1, 1, "s4", []), ("r", 3, 0, 1, "s4", []),
    ]
    pairs = spark.createDataFrame(rows, "review string, change int, rank int, strength int, section_id string, wording array<string>")
    out = [(r.change, r["rank"], r.repeated) for r in T.review_order(pairs).orderBy("place").collect()]
    # 2 goes first (10); 1's next (s2) repeats it, so 1 takes s3; then 3; next round 1's s1 before 2's s4
    assert out == [(2, 0, False), (1, 2, False), (3, 0, False), (1, 0, False), (2, 1, False), (1, 1, True)]


def test_review_keeps_every_pair(spark):  # noqa: ANN001
    rnd = random.Random(5)
    rows = [(f"r{k % 3}", k % 7, k, rnd.randrange(5), f"s{rnd.randrange(6)}", rnd.sample("abc", rnd.randrange(3))) for k in range(150)]
    pairs = spark.createDataFrame(rows, "review string, change int, rank int, strength int, section_id string, wording array<string>")
    out = T.review_order(pairs).collect()
    assert len({(r.review, r.change, r["rank"]) for r in out}) == len(rows) == len(out)
    kept = {(r.review, r.change, r["rank"]) for r in out if not r.repeated}
    keys = [(r[0], r[4], tuple(sorted(r[5]))) for r in rows if (r[0], r[1], r[2]) in kept and r[5]]
    assert len(keys) == len(set(keys))
    assert {k for k in keys} == {(r[0], r[4], tuple(sorted(r[5]))) for r in rows if r[5]}


def test_settled_cards_stay(spark):  # noqa: ANN001
    cards = spark.createDataFrame([("a", "pending", None, None, None), ("b", "summarized", "mine", None, None), ("c", "failed", None, "why", None)], "section_hash string, state string, tldr string, fail_reason string, summarized_at timestamp")
    failed = T.mark_failed(cards, spark.createDataFrame([("b", "x"), ("c", "x"), ("zz", "x")], "section_hash string, reason string"))
    assert sorted(map(tuple, failed.collect())) == sorted(map(tuple, cards.collect()))
    made = spark.sql("SELECT * FROM VALUES ('a', 'late', TIMESTAMP '2024-01-02'), ('a', 'early', TIMESTAMP '2024-01-01'), ('b', 'other', TIMESTAMP '2024-01-01') t(section_hash, tldr, summarized_at)")
    assert {r.section_hash: (r.state, r.tldr) for r in T.attach_cards(cards, made).collect()} == {"a": ("summarized", "early"), "b": ("summarized", "mine"), "c": ("failed", None)}


@pytest.mark.parametrize(
    ("source", "target", "path"),
    [
        ("a/b.md", "c.md", "a/c.md"), ("a/b.md", "../c.md?x#y", "c.md"), ("a/b.md", "../../c.md", None), ("a/b.md", "//h/c.md", None), ("b.md", "#top", None), ("a/b.md", "/", ""),
        ("b.md", "x%20y+z.md", "x y+z.md"), ("b.md", "50%.md", "50%.md"), ("b.md", "a%2Fb", None), ("b.md", "%FF.md", None), ("b.md", "d/%2E%2E/e.md", "e.md"), ("a/b.md", "./d//e", "a/d/e"),
    ],
)
def test_link_paths(spark, source, target, path):  # noqa: ANN001
    assert spark.range(1).select(I.link_path(F.lit(source), F.lit(target))).first()[0] == path


def test_what_a_link_means_first(spark):  # noqa: ANN001
    known = spark.createDataFrame([(p,) for p in ("a/index.md", "a/README.md", "a.md", "b.mdx", "b/index.md", "c.d/index.md", "index.mdx")], "path string")
    links = spark.createDataFrame([("x.md", t) for t in ("a/", "a", "b", "c.d", "/")], "from_path string, target string")
    out = {r.to_path for r in I.resolve_links(links, known).collect()}
    assert out == {"a/index.md", "a.md", "b.mdx", "index.mdx"}


def test_prefixes_below_a_root():
    roots = ["/home/me/docs", "/alias"]
    given = {"": None, ".": None, "./": None, "./a/": "a/", "a": "a", "/home/me/docs": None, "/home/me/docs/": None, "/home/me/docs/a/": "a/", "/home/me/x/../docs/a": "a", "/alias/./b": "b"}
    assert {raw: path_prefix_under(roots, raw) for raw in given} == given
    for raw in ("/home/me/docs2", "/home/me/docs/../x", "/"):
        with pytest.raises(ValueError, match="not under"):
            path_prefix_under(roots, raw)


def test_changes_that_say_something(spark):  # noqa: ANN001
    rows = [(1, "uses Node 18 now", "uses Node 20 now"), (2, "at 2024-01-02", "at 2024-01-03"), (3, "the cat", "the cow"), (4, "same words", "same words"), (5, "a1 b2 c3 d4", "e5"), (6, "old server", "renamed server")]
    out = I.change_signatures(spark.createDataFrame(rows, "id int, before string, after string")).collect()
    assert {r.id: (r.removed, r.added) for r in out} == {1: (["18"], ["20"])}
