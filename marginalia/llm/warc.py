"""WARC archives written and read as a chunked record table.

Writing: each payload is cut into chunks, rows of (record, chunk number, bytes, digest so far) that no task joins up
again. They are made one by one from the page's buffer, with a digest that runs along; nothing holds a payload's chunks
at once. A chunk becomes a WARC record of its own, "response" for the first and "continuation" for the rest, as the
format's segmentation rules have it (WARC-Segment-Number, -Origin-ID, -Total-Length); a payload of one chunk is a plain
record. Each record is one gzip member. Payloads of at least ``revisit_bytes`` that repeat are written once, for the
largest id; the others become "revisit" records that name it. What repeats is found from lengths and digests (SHA-256
beside the SHA-1 that the format wants), so payloads stay where they are; only if very many repeat (``BROADCAST_ROWS``)
are chunks dealt out to meet the list.

Members go out through Spark's text writer, so archives land in any store that Spark can write, under its commit
protocol: a lost executor's files are written again, never twice. Between members stands an empty gzip member with a
mark in its header, which unpacks to nothing. It is the line separator: Spark's text reader splits archives at it, so
they are read as a stream of members, by several tasks if they are large, and no file is held whole.

Reading: archives are read once. Members are inflated one by one. Records of one chunk are checked where they are read;
chunks of longer ones meet again sorted by number, and a running SHA-1 checks each chunk's digest so far and the whole.

Defined results: a null html counts as empty. A payload's record with the largest id is the response; rows that repeat that id and payload are
responses too. Null ids sort first. Extra columns are ignored; an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_place, settle

CHUNK_BYTES = 1 << 18
#: Rows of a written table's files; archives may be of any size, as they are read as streams.
MEMBERS_A_FILE = 100_000
REVISIT_BYTES = 1000
#: The list of repeated payloads goes to every task if it has at most so many rows, of about a hundred bytes.
BROADCAST_ROWS = 200_000
#: The archives' date; a run's results shouldn't depend on its clock.
DATE = "2024-01-01T00:00:00Z"
#: The mark, and the empty gzip member (header with an extra field, empty block, CRC and length of nothing) that carries it.
MARK = b"chunked-record-table"
SEPARATOR = (
    b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (len(MARK) + 4).to_bytes(2, "little") + b"CR" + len(MARK).to_bytes(2, "little") + MARK
    + b"\x03\0" + bytes(8)
)
_TEXT = {"lineSep": SEPARATOR.decode("latin-1"), "encoding": "ISO-8859-1"}


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, payload, payload_bytes, payload_digest, strong (another digest)."""
    raw = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), raw.alias("payload"))
    return rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload"), "strong": F.sha2("payload", 256)})


def repeated(rows: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """payload_bytes, strong, first (the largest id): of payloads that occur more than once. Payloads aren't moved."""
    large = rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_bytes", "strong")
    return large.agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def chunks(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """A row for each chunk: id, url, payload_bytes, payload_digest, refers_to, chunk (from 1), n_chunks, so_far, body.

    ``so_far`` is the digest of the payload up to this chunk's end. A revisit has one chunk, which is empty.
    """
    again = settle(repeated(rows, revisit_bytes), "repeated")
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, url string, payload_bytes bigint, payload_digest string, strong string, chunk int, n_chunks int, so_far string, body binary"

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["id", "url", "payload_bytes", "payload_digest", "strong", "chunk", "n_chunks", "so_far", "body"]
        kinds = [None, pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        for batch in batches:
            kinds[0] = batch.schema.field("id").type
            waiting, held = [], 0
            for k in range(batch.num_rows):
                payload = memoryview(batch.column("payload")[k].as_buffer())
                about = [batch.column(c)[k].as_py() for c in names[:5]]
                n, digest = max(1, -(-len(payload) // chunk_bytes)), hashlib.sha1()
                for c in range(n):
                    body = payload[c * chunk_bytes : (c + 1) * chunk_bytes]
                    digest.update(body)
                    waiting.append((*about, c + 1, n, digest.hexdigest(), body))
                    held += len(body)
                    if held >= 4 * chunk_bytes or len(waiting) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*waiting, strict=True), kinds, strict=True)], names=names)
                        waiting, held = [], 0
            if waiting:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*waiting, strict=True), kinds, strict=True)], names=names)

    parts = rows.select("id", "url", "payload", "payload_bytes", "payload_digest", "strong").mapInArrow(cut, schema)
    few = again.count() <= BROADCAST_ROWS
    parts = parts.join(F.broadcast(again) if few else again, ["payload_bytes", "strong"], "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    parts = parts.withColumn("refers_to", F.when(other, F.col("first"))).where("refers_to IS NULL OR chunk = 1")
    seen = F.col("refers_to").isNotNull()
    return parts.select(
        "id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk", F.when(seen, 1).otherwise(F.col("n_chunks")).alias("n_chunks"),
        F.when(seen, F.col("payload_digest")).otherwise(F.col("so_far")).alias("so_far"), F.when(~seen, F.col("body")).alias("body"),
    )


def name_of(row_id: object, digest: str, number: int = 1) -> str:
    """A record's URI: made from its row's id, its payload's digest and the segment number, so that rewriting gives the same archive."""
    h = hashlib.sha1(f"{row_id}#{digest}#{number}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def member(row: dict) -> bytes:
    """The gzip member of a chunk's record."""
    part, first = row["n_chunks"] > 1, row["chunk"] == 1
    kind = "revisit" if row["refers_to"] is not None else "response" if first else "continuation"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name_of(row["id"], row["payload_digest"], row["chunk"])), ("WARC-Date", DATE)]
    # white space would end the field, and a page's address may hold anything
    head += [("WARC-Target-URI", (row["url"] or "").encode("unicode_escape").decode().replace(" ", "%20"))]
    head += [("X-Row-ID", "" if row["id"] is None else str(row["id"])), ("X-Payload-Length", str(row["payload_bytes"]))]
    head += [("WARC-Payload-Digest", "sha1:" + row["payload_digest"])]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        head += [("WARC-Refers-To", name_of(row["refers_to"], row["payload_digest"])), ("X-Refers-To-Row", str(row["refers_to"]))]
    if part:
        head += [("WARC-Segment-Number", str(row["chunk"])), ("X-Digest-So-Far", "sha1:" + row["so_far"])]
        head += [] if first else [("WARC-Segment-Origin-ID", name_of(row["id"], row["payload_digest"]))]
        head += [("WARC-Segment-Total-Length", str(row["payload_bytes"]))] if row["chunk"] == row["n_chunks"] else []
    body = bytes(row["body"] or b"")
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode()) + packer.compress(body + b"\r\n\r\n") + packer.flush()


def write(parts: DataFrame, place: str, members_a_file: int = MEMBERS_A_FILE) -> None:
    """Write chunk rows to archives in the folder ``place``."""
    columns = parts.columns

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # few at a time: chunks are large
                rows = zip(*[c.to_pylist() for c in batch.slice(start, 64).columns], strict=True)
                made = [member(dict(zip(columns, row, strict=True))) for row in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    packed = parts.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.options(**_TEXT).option("maxRecordsPerFile", members_a_file).option("compression", "none").text(place)


def opened(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("a record's block doesn't end where its length says")
    return fields, rest[:size]


def read(spark: SparkSession, place: str) -> DataFrame:
    """Chunk rows of the archives in a folder: record_id, row_id, url, kind, chunk, total, digest, so_far, refers_to_row, body."""
    schema = "record_id string, row_id string, url string, kind string, chunk int, total bigint, digest string, so_far string, refers_to_row string, body binary"
    lines = spark.read.options(**_TEXT).option("pathGlobFilter", "part-*").text(place).select(F.col("value").cast("binary").alias("value"))

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for value in batch.column(0).slice(at, 64):
                    f, body = opened(zlib.decompress(value.as_py(), 31))
                    url = f.get("warc-target-uri", "").encode().decode("unicode_escape")
                    digest, so_far = (f.get(k, "").removeprefix("sha1:") for k in ("warc-payload-digest", "x-digest-so-far"))
                    record = f.get("warc-segment-origin-id", f["warc-record-id"])
                    number, total = int(f.get("warc-segment-number", 1)), int(f["x-payload-length"])
                    rows.append((record, f.get("x-row-id") or None, url, f["warc-type"], number, total, digest, so_far or digest, f.get("x-refers-to-row"), body))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return lines.mapInArrow(unpack, schema)


def verified(parts: DataFrame, id_type: str = "bigint", id_col: str = "page_id") -> DataFrame:
    """A row for each record: ``id_col``, payload_bytes, payload_digest, record_type, refers_to, intact.

    Length and digest are those of the bytes read (of a revisit, which has none, those of its header); intact says whether the
    headers name the same ones.
    Records of one chunk are checked where they are read and their bytes left behind. Chunks of longer ones are dealt by
    record, sorted by number and run through an incremental digest, chunk by chunk.
    """
    again = F.col("kind") == "revisit"
    whole = again | ((F.col("chunk") == 1) & (F.length("body") == F.col("total")))
    read = F.when(again, F.col("digest")).otherwise(F.sha1("body"))
    sound = F.when(again, F.length("body") == 0).otherwise(F.sha1("body") == F.col("digest"))
    seen = parts.select(
        "record_id", "row_id", "kind", "chunk", F.when(whole & ~again, F.length("body").cast("long")).otherwise(F.col("total")).alias("total"),
        F.when(whole, read).otherwise(F.col("digest")).alias("digest"), "so_far", "refers_to_row", F.when(whole, sound).alias("intact"),
        F.when(~whole, F.col("body")).alias("body"),
    )
    out = ["record_id", "row_id", "kind", "total", "digest", "refers_to_row", "intact"]

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        schema = pa.schema(list(zip(out, kinds, strict=True)))
        now = None  # the record in work: its id, row, total, digest, the running digest, bytes, last chunk, rows, soundness

        def done() -> list[dict]:
            record, row, total, digest, state, size, _, copies, ok = now
            read = state.hexdigest()
            one = {"record_id": record, "row_id": row, "kind": "response", "total": size, "digest": read, "refers_to_row": None}
            # a record whose first chunk is missing stays, once
            return [one | {"intact": ok and read == digest and size == total}] * max(1, copies)

        for batch in batches:
            ready = []
            for k in range(batch.num_rows):
                record = batch.column("record_id")[k].as_py()
                if now is not None and record != now[0]:
                    ready += done()
                    now = None
                row = {c: batch.column(c)[k].as_py() for c in out}
                if row["intact"] is not None:
                    ready.append(row)
                    continue
                if now is None:
                    now = [record, row["row_id"], row["total"], row["digest"], hashlib.sha1(), 0, 0, 0, True]
                number = batch.column("chunk")[k].as_py()
                now[7] += number == 1
                if number == now[6]:
                    continue  # the same row, archived twice, has the same chunks
                body = batch.column("body")[k].as_py() or b""
                now[4].update(body)
                now[5] += len(body)
                now[6] = number
                now[8] = now[8] and now[4].hexdigest() == batch.column("so_far")[k].as_py()
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist(done(), schema=schema)

    ddl = "record_id string, row_id string, kind string, total bigint, digest string, refers_to_row string, intact boolean"
    folded = seen.repartition("record_id").sortWithinPartitions("record_id", "chunk").mapInArrow(fold, ddl)
    kind = F.when(F.col("kind") == "revisit", "revisit").otherwise("response")
    return folded.select(
        F.col("row_id").cast(id_type).alias(id_col), F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        kind.alias("record_type"), F.col("refers_to_row").cast(id_type).alias("refers_to"), "intact",
    )


def sound(rows: DataFrame) -> DataFrame:
    """``verified`` rows without intact; the query fails if one of them isn't."""
    said = F.concat(F.lit("a payload differs from its header: record of row "), F.coalesce(F.col(rows.columns[0]).cast("string"), F.lit("null")))
    fine = F.when(F.coalesce("intact", F.lit(False)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return rows.where(fine).drop("intact")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", place: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` to archives in ``place`` (a new folder in the shared one by default), read them back, check every payload."""
    spark = pages.sparkSession
    place = place or new_place(spark, "warc")
    write(chunks(records(pages, id_col, url_col, html_col), chunk_bytes), place)
    return verified(read(spark, place), dict(pages.dtypes)[id_col], id_col)
