"""N-gram Jaccard join by signature trees; it loses no link that two components would need to be one.

Texts with equal shingle sets form one class. If two sets have a Jaccard similarity of at least 4/5, they share one of
their smallest hashes: any ceil-free fifth and one more of either set (the prefix). Classes are therefore dealt by the
hashes of their prefixes, as branches of one tree; hashes that one class alone has fall away.

Any order of the hashes will do for that, so very common ones come last in it: a passage that a large part of all texts
quote then makes a branch of the few texts that hold little else, not of all. They are counted over all texts first;
how many there can be is bounded by their definition (``COMMON_PARTS``), so they can be sent to every task.

Below each branch stands a signature tree: classes in order of size are its leaves' rows, and a node holds the OR of the
rows' bitmaps and their range of sizes. A pair of nodes is cut off if no pair of rows in them can overlap enough: the
bits that both nodes have are fewer than any row pair needs, or the sizes are too far apart. Both sides are descended
together; row pairs that are left are compared exactly, by the texts.

Large groups of near copies would fill such lists with pairs that add nothing to the components. So first each class is
compared with a few heads, classes that share at least half of its prefix, and what is thereby linked becomes one
component; the trees are then walked for pairs of different components only. The components are thus whole, but links
inside one are not listed or counted. Branches of ``SMALL`` classes or fewer have no tree: their pairs are compared by
bitmaps. Branches of many classes are split by size bands (similar sizes are at most one band apart) and those into
blocks, dealt as block pairs; nothing is capped.

Every table that a step needs is written to the shared folder and deleted once its last reader is written; texts are
fetched for those classes only that a pair to be compared holds.

Hashes have 64 bits; links are decided on the two texts' own shingle sets. Defined results: A-Z are lower-cased and
words are runs of anything but space and the controls tab to carriage return; with fewer than five words the whole
sequence is the one shingle; null, empty and blank texts have no shingles and are their own component. A component's id
is its least non-null document id. Repeated rows are a class's members; extra columns are ignored by ``similar_texts``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import WORD, free, integer_names, settle, unused

WORDS = 5
#: Bits of a row's signature, rows of a tree's leaf, children of its nodes, rows of a block. Leaves are small, as the OR of many
#: rows that are unlike each other has most bits set and cuts nothing off.
BITS, LEAF, FAN, BLOCK = 2048, 2, 4, 4096
#: Branches of so many rows or less have their row pairs checked at once, without a tree.
SMALL = 16
#: Heads of a branch and of a class, and the share of a class's prefix that a head must hold.
HEADS, HEAD_SHARE = 3, 0.5
#: A hash is common if more prefixes hold it than a block has rows and than this part of all texts.
COMMON_PARTS = 20_000
#: Keys are counted up to so many times a prefix.
FURTHER = 1.25
#: Prefix keys have 63 bits; the first bit is set for common ones, so that keys in ascending order have them last.
COMMON_BIT = 1 << 63
# Odd 64-bit numbers (fixed values) that mix the hashes of a shingle's words.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def shingles(text: str | None):  # noqa: ANN201
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np
    from xxhash import xxh3_64_intdigest as code

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    n = len(words)
    if n < WORDS:
        return np.array([code(b" ".join(words), 1)] if n else [], np.uint64)
    c = np.fromiter(map(code, words), np.uint64, n)
    mix = [np.uint64(m) for m in MIX]
    x = c[: n - WORDS + 1] * mix[0]
    for i in range(1, WORDS):
        x = (x ^ (x >> np.uint64(29))) * mix[i] + c[i : n - WORDS + 1 + i]
    x ^= x >> np.uint64(32)
    x *= mix[0]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1 if n else 0


def similar(a: int, b: int, both: int) -> bool:
    return 100 * both >= 80 * (a + b - both)


def prefix_keys(hashes, common, times: float = 1):  # noqa: ANN001, ANN201
    """The first keys of a set, ``times`` a prefix of them: ascending, as unsigned numbers, with the common ones last."""
    import numpy as np

    keys = hashes >> np.uint64(1)
    if len(common):
        keys = np.where(np.isin(keys, common), keys | np.uint64(COMMON_BIT), keys)
    return np.sort(keys)[: math.ceil(times * prefix_size(len(hashes)))]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (id and th, a hash of the text: they find the row again) and text."""
    text = F.col(text_col)
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("th")).alias("row"), text.alias("text"))


def _common(docs: DataFrame, text_col: str) -> list[int]:
    """The keys that are among the first of very many texts. Somewhat more than prefixes is counted, as without them those reach further.

    Of all keys counted, at most COMMON_PARTS times the mean prefix can be common; the work stays right whatever is left out.
    """
    total = docs.count()
    least = max(BLOCK, total // COMMON_PARTS)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        none = np.empty(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys = [prefix_keys(shingles(t), none, FURTHER) for t in batch.column(0).slice(at, 500).to_pylist()]
                # equal ones are counted here first: what many texts hold is a few rows
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["s", "n"])

    if total <= least:
        return []
    counted = docs.select(F.col(text_col)).mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    often = settle(counted.where(F.col("n") > least), "common")
    out = [r["s"] for r in often.select("s").orderBy(F.desc("n"), "s").limit(COMMON_PARTS * 10).collect()]
    free(often)
    return out


def _profiles(docs: DataFrame, id_col: str, text_col: str, common: list[int]) -> DataFrame:
    """row, n, digest (of the set), prefix (its keys), bits."""
    rows = _numbered(docs, id_col, text_col)
    late = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        last = np.sort(np.array(late.value, np.int64).view(np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, digests, prefixes, bits = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text)
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    prefixes.append(prefix_keys(s, last).view(np.int64))
                    mask = np.zeros(BITS, np.uint8)
                    mask[(s >> np.uint64(40)) % np.uint64(BITS)] = 1  # not the high bits alone: prefixes have small hashes
                    bits.append(np.packbits(mask).tobytes())
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype("i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))
                columns = [part.column("row"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), lists, pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "digest", "prefix", "bits"])

    kind = dict(rows.dtypes)["row"]
    return rows.mapInArrow(run, f"row {kind}, n int, digest binary, prefix array<bigint>, bits binary")


def _heads(shared: DataFrame) -> DataFrame:
    """a, b: each class with the few classes that hold most of its prefix, of those first in their branch by seeded orders."""
    places = {f"place_{i}": F.xxhash64("k", F.lit(i)) for i in range(HEADS)}
    first = shared.withColumns(places).groupBy("s").agg(*[F.min(p).alias(f"first_{p}") for p in places])
    leads = F.greatest(*[(F.col(p) == F.col(f"first_{p}")).cast("int") for p in places]) == 1
    head = shared.withColumns(places).join(first, "s").where(leads).select("s", F.col("k").alias("head"), F.col("n").alias("head_n"))
    votes = shared.join(head, "s").where("k != head AND 5 * n >= 4 * head_n AND 5 * head_n >= 4 * n").groupBy("k", "n", "head").count()
    needed = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1
    best = votes.where(F.col("count") >= needed * HEAD_SHARE)
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("count"), "head")))
    return best.where(F.col("at") <= HEADS).select(F.greatest("k", "head").alias("a"), F.least("k", "head").alias("b")).distinct()


def tree_pairs(n, bits, group, block, leaf: int = LEAF, fan: int = FAN):  # noqa: ANN001, ANN201
    """Row pairs of different components that may be similar, by walking a signature tree against itself.

    n: sizes in ascending order; bits: (rows, words) of unsigned 64-bit; group: component of each row; block: rows of one block aren't
    paired with each other if there are two (that is another task's work).
    """
    import numpy as np

    rows = len(n)
    count = np.bitwise_count(bits).sum(axis=1).astype(int)
    own_need = count - n  # a partner's bits must cover all of a row's but n - overlap
    two = block.max() != block.min()
    # levels from the leaves up: bounds of rows, ORs, sizes, least need, range of components
    edges = np.append(np.arange(0, rows, leaf), rows)
    levels = []
    starts = edges[:-1]
    ors, low, high, need = np.bitwise_or.reduceat(bits, starts, axis=0), n[starts], n[edges[1:] - 1], np.minimum.reduceat(own_need, starts)
    g_low, g_high = np.minimum.reduceat(group, starts), np.maximum.reduceat(group, starts)
    levels.append((ors, low, high, need, g_low, g_high))
    while len(levels[-1][1]) > 1:
        ors, low, high, need, g_low, g_high = levels[-1]
        at = np.arange(0, len(low), fan)
        last = np.append(at[1:], len(low)) - 1
        levels.append((np.bitwise_or.reduceat(ors, at, axis=0), low[at], high[last], np.minimum.reduceat(need, at), np.minimum.reduceat(g_low, at), np.maximum.reduceat(g_high, at)))

    def fits(level: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which node pairs (i before or at j) may hold a similar row pair."""
        ors, low, high, need, g_low, g_high = level
        ok = (5 * high[i] >= 4 * low[j]) & ~((g_low[i] == g_high[i]) & (g_low[j] == g_high[j]) & (g_low[i] == g_low[j]))
        i, j, at = i[ok], j[ok], np.nonzero(ok)[0]
        both = np.concatenate([np.bitwise_count(ors[a] & ors[b]).sum(axis=1).astype(int) for a, b in zip(np.array_split(i, len(i) // 20000 + 1), np.array_split(j, len(j) // 20000 + 1), strict=True)]) if len(i) else np.empty(0, int)
        overlap = -(-4 * (low[i] + low[j]) // 9)
        out = np.zeros(len(ok), bool)
        out[at] = both >= np.maximum(need[i], need[j]) + overlap
        return out

    def children(i: np.ndarray, j: np.ndarray, fan: int, total: int) -> tuple[np.ndarray, np.ndarray]:
        step = np.arange(fan)
        a = (i[:, None, None] * fan + step[None, :, None] + 0 * step[None, None, :]).ravel()
        b = (j[:, None, None] * fan + step[None, None, :] + 0 * step[None, :, None]).ravel()
        ok = (a <= b) & (b < total)
        return a[ok], b[ok]

    found = []
    row_level = (bits, n, n, own_need, group, group)
    stack = [(len(levels) - 1, np.zeros(1, int), np.zeros(1, int))]
    while stack:
        depth, i, j = stack.pop()
        if depth >= 0:
            ok = fits(levels[depth], i, j)
            i, j = i[ok], j[ok]
            for a, b in zip(np.array_split(i, len(i) // 5000 + 1), np.array_split(j, len(j) // 5000 + 1), strict=True):
                if len(a):
                    stack.append((depth - 1, *children(a, b, fan if depth else leaf, len(levels[depth - 1][1]) if depth else rows)))
        else:
            ok = (i < j) & (group[i] != group[j])
            if two:
                ok &= block[i] != block[j]
            i, j = i[ok], j[ok]
            ok = fits(row_level, i, j)
            found.append((i[ok], j[ok]))
    return np.concatenate([f[0] for f in found]) if found else np.empty(0, int), np.concatenate([f[1] for f in found]) if found else np.empty(0, int)


def _candidates(branches: DataFrame) -> DataFrame:
    """a, b: row pairs that the trees leave, once for each branch. branches: s, band, first, second, own (of this band, not the next lower), block, k, n, root, bits."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key = ["s", "band", "first", "second"]
        waiting = None

        def pairs(table: pa.Table) -> pa.RecordBatch:
            ids = np.stack([table.column(c).to_numpy() for c in key])
            new = np.ones(table.num_rows, bool)
            new[1:] = (ids[:, 1:] != ids[:, :-1]).any(axis=0)
            starts = np.append(np.nonzero(new)[0], table.num_rows)
            n, k, root, own, block = (table.column(c).to_numpy() for c in ("n", "k", "root", "own", "block"))
            n = n.astype(int)
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(table.num_rows, BITS // 64)
            out_a, out_b = [], []
            sizes = np.diff(starts)
            # small branches: all at once, comparing each row with those at a distance of 1, 2, ...
            end = np.repeat(starts[1:], sizes)
            small = np.repeat(sizes <= SMALL, sizes)
            need = np.bitwise_count(bits).sum(axis=1).astype(int) - n
            for d in range(1, min(SMALL, int(sizes.max()))):
                i = np.nonzero(small[:-d] & (np.arange(d, table.num_rows) < end[:-d]))[0]
                j = i + d
                ok = (root[i] != root[j]) & ((own[i] == 1) | (own[j] == 1)) & (5 * n[i] >= 4 * n[j])
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(bits[i] & bits[j]).sum(axis=1).astype(int) >= np.maximum(need[i], need[j]) - (-4 * (n[i] + n[j]) // 9)
                out_a.append(np.minimum(k[i[ok]], k[j[ok]]))
                out_b.append(np.maximum(k[i[ok]], k[j[ok]]))
            for a, b in zip(starts[:-1][sizes > SMALL], starts[1:][sizes > SMALL], strict=True):
                i, j = tree_pairs(n[a:b], bits[a:b], root[a:b], block[a:b])
                i, j = i + a, j + a
                ok = (own[i] == 1) | (own[j] == 1)
                out_a.append(np.minimum(k[i[ok]], k[j[ok]]))
                out_b.append(np.maximum(k[i[ok]], k[j[ok]]))
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            if not table.num_rows:
                continue
            # a branch is whole once rows of another follow it; a block pair's rows are at most four blocks
            ids = np.stack([table.column(c).to_numpy() for c in key])
            cut = table.num_rows
            while cut and (ids[:, cut - 1] == ids[:, -1]).all():
                cut -= 1
            waiting = table.slice(cut)
            if cut:
                yield pairs(table.slice(0, cut))
        if waiting is not None and waiting.num_rows:
            yield pairs(waiting)

    order = ["s", "band", "first", "second"]
    return branches.repartition(*order).sortWithinPartitions(*order, "n", "k").mapInArrow(run, "a bigint, b bigint")


def _enough_shared(met: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b that met in as many branches as similar sets must.

    Of the sets x and y take the one whose prefix ends first, x. All but at most |x| - overlap of its prefix are in y, and as
    none lies beyond the end of y's prefix, those are in y's prefix. Pairs meet once for each hash that both prefixes hold.
    """
    counted = met.groupBy("a", "b").agg(F.count("*").alias("shared"))
    for side in ("a", "b"):
        counted = counted.join(classes.select(F.col("k").alias(side), F.col("n").alias(f"n_{side}"), F.col("top").alias(f"top_{side}")), side)
    # signed numbers stand for unsigned hashes: the sign bit turned over keeps their order
    order = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    first = F.when(order("top_a") <= order("top_b"), F.col("n_a")).otherwise(F.col("n_b"))
    overlap = F.ceil(F.expr("4 * (n_a + n_b) / 9D"))
    least = (first - F.ceil(F.expr("4D") * first / 5) + 1) - (first - overlap)
    return counted.where(F.col("shared") >= least).select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b whose texts are similar, settled. rows: row, text; classes: k, row. Texts are fetched for classes in pairs only."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    wanted = classes.select("k", "row").join(ends, "k", "left_semi")
    texts = settle(rows.join(wanted, "row").dropDuplicates(["row"]).select("k", "text"), "texts")
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("k").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, known = None, None
        for batch in batches:
            ok = []
            for ta, tb in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                ta, tb = ta.as_py(), tb.as_py()  # one at a time: texts may be long
                if last is None or tb != last:  # the join leaves equal b together
                    last, known = tb, shingles(tb)
                a = shingles(ta)
                ok.append(similar(len(a), len(known), len(np.intersect1d(a, known, assume_unique=True))))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = settle(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"), "links-found")
    free(texts)
    return found


def _trees(shared: DataFrame, roots: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs a, b that the signature trees leave, of different components, settled. shared: s, k, n; roots: node, root."""
    rooted = shared.join(roots.withColumnRenamed("node", "k"), "k", "left").select("s", "k", "n", F.coalesce("root", "k").alias("root"))
    rooted = settle(rooted, "rooted")
    mixed = rooted.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("s")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)).cast("int")
    dealt = rooted.join(mixed, "s").withColumn("low", band)
    dealt = dealt.select("s", "k", "n", "root", "low", F.explode(F.array(F.col("low"), F.col("low") + 1)).alias("band"))
    dealt = settle(dealt.select("s", "k", "n", "root", "band", (F.col("low") == F.col("band")).cast("int").alias("own")), "dealt")
    free(rooted)
    sums = [F.count("*").alias("c"), F.sum("own").alias("owned"), F.min("root").alias("lo"), F.max("root").alias("hi")]
    filled = dealt.groupBy("s", "band").agg(*sums).where("owned > 0 AND lo != hi")
    filled = filled.select("s", "band", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    placed = dealt.join(filled, ["s", "band"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    placed = placed.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    first, second = F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    placed = placed.select("s", "band", first, second, "own", "block", "k", "n", "root").join(bits.select("k", "bits"), "k")
    met = settle(_candidates(placed), "met")
    free(dealt)
    pairs = settle(_enough_shared(met, bits), "pairs")
    free(met)
    return pairs


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, th, which with the id tells rows apart, and component.

    ``component`` numbers the components (null without shingles): their ids may be null or repeat, these numbers don't.
    """
    rows = _numbered(docs, id_col, text_col)
    profiles = settle(_profiles(docs, id_col, text_col, _common(docs, text_col)), "profiles")
    some = profiles.where("n > 0")
    classes = some.groupBy("digest").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("row.id").alias("least"))
    classes = settle(integer_names(classes, ["digest"], F.xxhash64("digest"), 65536, "k"), "classes")
    # rows of a class have the same set, so any of them will do
    sets = some.groupBy("digest").agg(F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    sets = settle(sets.join(classes.select("digest", "k", "n"), "digest").select("k", "n", "prefix", "bits"), "sets")
    members = settle(profiles.select("row", "n", "digest"), "members")
    free(profiles)

    keys = sets.select("k", F.explode("prefix").alias("s"))
    often = keys.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s")
    shared = settle(keys.join(often, "s").select("s", "k").join(sets.select("k", "n"), "k").select("s", "k", "n"), "shared")
    met = shared.select("k").distinct()
    bits = settle(sets.select("k", "n", F.element_at("prefix", -1).alias("top"), "bits").join(met, "k", "left_semi"), "bits")
    free(sets)

    heads = settle(_heads(shared), "heads")
    head_links = _verified(heads, rows, classes)
    roots = components(head_links)
    pairs = _trees(shared, roots, bits)
    free(heads, roots, shared, bits)
    tree_links = _verified(pairs, rows, classes)
    roots = components(head_links.unionByName(tree_links))
    free(pairs, head_links, tree_links)

    least = classes.join(roots.withColumnRenamed("node", "k"), "k", "left").select("digest", "least", F.coalesce("root", "k").alias("root"))
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(ids, "root").select("digest", "component_id", F.col("root").alias("component"))
    out = members.where("n > 0").join(named, "digest").select("row", "n", "component_id", "component")
    alone = members.where("n = 0").select("row", "n", F.col("row.id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    out = out.unionByName(alone)
    return out.select(F.col("row.id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", "row.th", "component")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns; rows without shingles all stay.

    An id may repeat within a component, and be null or repeat in others: one row stays for each component.
    """
    found = similar_texts(docs, id_col, text_col).where("component IS NOT NULL AND " + f"`{id_col}` <=> component_id")
    row, stays = unused(docs.columns, "row", "stays")
    stay = found.groupBy("component").agg(F.min(F.struct(F.col(id_col).alias("id"), "th")).alias(stays)).select(stays)
    has_words = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    worded = docs.where(has_words).withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")))
    kept = worded.join(stay, F.col(row) == F.col(stays), "left_semi").dropDuplicates([row])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~has_words))
