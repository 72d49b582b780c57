"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors of one label that are equal form one class. A class's vector is hashed by the signs of its products with seeded
hyperplanes, a few bits in each of several tables; classes that share a label and a table's bits are compared by their
cosine in double precision. Links are counted as they are found: a pair that already met in an earlier table isn't counted again, which the
rows decide alone, as they carry all their hashes. From a bucket only counts and a forest of links leave, never all pairs.

Vectors are hashed once; buckets are counted and dealt out by number and hash alone, and the vectors then join those
that have company, as single-precision bytes if they came so. Bits grow with the logarithm of the largest label, without
an upper bound, so buckets keep their size; tables follow from bits and the wanted recall at the threshold (pairs above
it are found with more). A bucket of more than ``block`` classes is dealt as pairs of blocks.

Defined results: null labels, null vectors, zero vectors and vectors with null or non-finite parts have no links and are
their own component; so have vectors of lengths that differ. Rows that repeat id and vector link with each other. A null
id is never a component's id unless all are null. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import free, integer_names, settle

THRESHOLD, RECALL = 0.93, 0.995
#: Classes of a block, and of a bucket on average: large enough for products of matrices, small beside a block.
BLOCK, BUCKET = 2000, 250


def plan_tables(largest: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a table (63 at most, as a bucket's name is one integer) and number of tables for labels of up to ``largest`` classes."""
    bits = min(63, max(1, round(math.log2(max(2, largest) / bucket))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _hashed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """label, dim, k, size, hashes (of all tables), vector (as bytes; of single precision if the column's parts are)."""
    part = "f4" if "float" in dict(classes.dtypes)["vector"] else "f8"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype="i8")
        for batch in batches:
            values = batch.column("vector")
            flat, offsets = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            starts, dims = offsets[:-1] - offsets[0], np.diff(offsets)
            for dim in np.unique(dims):
                if int(dim) not in planes:
                    planes[int(dim)] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
                at = np.nonzero(dims == dim)[0]
                for rows in np.array_split(at, max(1, len(at) * tables * bits // 1_000_000)):
                    v = flat[starts[rows][:, None] + np.arange(dim)[None, :]]
                    signs = (v.astype("f8") @ planes[int(dim)] > 0).reshape(len(rows), tables, bits)
                    codes = (signs * weights).sum(axis=2)
                    hashes = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="i4") * tables), pa.array(codes.ravel()))
                    vectors = pa.array([x.tobytes() for x in v.astype("<" + part)], pa.binary())
                    own = [batch.column(c).take(pa.array(rows)) for c in ("label", "k", "size")]
                    columns = [own[0], pa.array(np.full(len(rows), dim, "i4")), own[1], own[2], hashes, vectors]
                    yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "k", "size", "hashes", "vector"])

    schema = "label string, dim int, k bigint, size bigint, hashes array<bigint>, vector binary"
    return classes.select("label", "k", "size", "vector").mapInArrow(run, schema)


def _compared(blocks: DataFrame, threshold: float, part: str) -> DataFrame:
    """Links found in each dealt block pair: k, links (rows linked to each row of the class), to (a node of the forest, or k)."""
    key = ["label", "dim", "table_no", "bucket", "first", "second"]

    def compare(table):  # noqa: ANN001, ANN202
        import numpy as np

        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        number, block = table.column("table_no")[0].as_py(), table.column("block").to_numpy()
        k, size = table.column("k").to_numpy(), table.column("size").to_numpy()
        v = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<" + part).reshape(len(k), -1).astype("f8")
        v /= np.abs(v).max(axis=1)[:, None]  # squares of very small or large parts would not be finite
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
        codes = table.column("hashes").combine_chunks().flatten().to_numpy().reshape(len(k), -1)
        rows, cols = np.nonzero(block == first)[0], np.nonzero(block == second)[0]
        links = np.zeros(len(k), "i8")
        root = np.arange(len(k))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for some in np.array_split(rows, max(1, len(rows) * len(cols) // 2_000_000)):
            near = v[some] @ v[cols].T >= threshold
            near &= (some[:, None] < cols[None, :]) if first == second else True
            i, j = np.nonzero(near)
            i, j = some[i], cols[j]
            new = ~(codes[i, :number] == codes[j, :number]).any(axis=1) if number else np.ones(len(i), bool)
            i, j = i[new], j[new]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        at = np.nonzero(links)[0]
        return k[at], links[at], k[[find(int(x)) for x in at]] if len(at) else k[at]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        waiting, names = None, ["k", "links", "to"]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            if not table.num_rows:
                continue
            new = np.zeros(table.num_rows, bool)
            for c in key:
                column = table.column(c).to_numpy(zero_copy_only=False)
                new[1:] |= column[1:] != column[:-1]
            # the last group may go on in the next batch
            starts = [0, *np.nonzero(new)[0].tolist()]
            found = [compare(table.slice(a, b - a)) for a, b in zip(starts, starts[1:], strict=False)]
            waiting = table.slice(starts[-1])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)
        if waiting is not None and waiting.num_rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, compare(waiting))), names=names)

    return blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "k bigint, links bigint, to bigint")


def near_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, seed: int = 17,
) -> DataFrame:
    """A row for each row of ``table``: ``id_col``, n_links, component_id, kept."""
    single = dict(table.dtypes)[vector_col] == "array<float>"
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col(label_col).isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound"))
    # two 64-bit hashes stand for a vector, so that rows find their class again without moving it
    same = [F.xxhash64(F.lit(i), "label", "vector").alias(f"h{i}") for i in (1, 2)]
    good = rows.where("sound").select("id", "label", "vector", *same)
    classes = good.groupBy("label", "h1", "h2").agg(F.first("vector").alias("vector"), F.count("*").alias("size"), F.min("id").alias("least"))
    classes = settle(integer_names(classes, ["label", "h1", "h2"], F.col("h1"), 65536, "k"), "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, tables = plan_tables(largest, threshold, recall)
    hashed = settle(_hashed(classes, bits, tables, seed), "hashed")
    key = ["label", "dim", "table_no", "bucket"]
    named = hashed.select("label", "dim", "k", F.posexplode("hashes").alias("table_no", "bucket"))
    counts = named.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = named.join(counts, key).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    dealt = dealt.select(*key, "first", "second", "block", "k").join(hashed.select("k", "size", "hashes", "vector"), "k")
    found = settle(_compared(dealt, threshold, "f4" if single else "f8"), "vector-links")
    free(hashed)
    roots = components(found.select(F.col("k").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    own = classes.drop("vector").join(links, "k", "left").join(roots.withColumnRenamed("node", "k"), "k", "left")
    own = own.select("k", "label", "h1", "h2", "size", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "k").alias("root"))
    ids = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(ids, "root").select("label", "h1", "h2", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id")
    named = settle(named, "vector-components")
    free(classes, found, roots)
    out = good.drop("vector").join(named, ["label", "h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
