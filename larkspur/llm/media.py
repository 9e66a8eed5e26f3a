"""Content-addressed media columns: payloads in tar shards, rows with digest, offset and length.

Every payload (a text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64) becomes
an 8-bit greyscale PNG image 64 pixels wide, a lossless form whose unit is the byte.

1. Payloads are digested on Spark. A digest that several rows have is given to one of them, its
   owner (the smallest id); the table of such digests holds what is shared only.
2. Tasks append the images of owners, and of rows alone with their payload, to tar shards in the
   shared folder, under the SHA-256 as the name: a payload is stored once in the whole table. (Rows
   that are equal in id and text own it together; one copy of theirs is referred to.)
3. A row keeps (digest, shard, offset, length). The metadata columns (width, height, bit depth, and
   from them the payload's size) come from range reads of the 33 header bytes alone; a second pass
   reads each stored payload back once, for its digests and features, which its rows share by a join.

Tasks may run again after an executor is lost: a shard's name is unique to the attempt and a row
names the shard its own attempt wrote, so no reader sees a half-written or replaced shard. Shards
left by lost attempts are not referenced by any row.

Nulls and odd input: a null text is an empty one, whose payload is 64 zero bytes; equal texts have
equal digests and features; a null id is kept as it is; other columns are not read; an empty table
gives an empty index.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, hot_rows, join_spread, map_in_arrow, materialize, small

WIDTH = 64
HEADER = 33
SHARD_BYTES = 256 << 20
#: About how much a task reads back.
READ_BYTES = 32 << 20
INDEX = "id long, n_bytes long, digest string, shared boolean, shard string, offset long, length long"
HEADERS = INDEX + ", width long, height long, bit_depth long, payload_bytes long"
FACTS = HEADERS + ", payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG with the payload as its samples, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first 33 bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image made by to_png; every chunk's checksum is verified."""
    at, body = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data):
            raise ValueError("damaged PNG")
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("PNG line filters other than 0 aren't written here")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """A 64-bit average hash over the columns, the mean and the entropy of the samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    counts = np.bincount(rows.reshape(-1), minlength=256)
    columns = rows.sum(axis=0, dtype=np.int64)
    bits = "".join("1" if x else "0" for x in columns * WIDTH > columns.sum())
    share = counts[counts > 0] / rows.size
    return f"ahash={int(bits, 2):016x};mean={columns.sum() / rows.size:.3f};entropy={abs(float(-(share * np.log2(share)).sum())):.3f}"


def _filesystem(uri: str):
    """A file system for the uri (local, or any that Arrow opens) and a function from uri to its path."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), lambda u: urlparse(u).path
    found, _ = fs.FileSystem.from_uri(uri)
    return found, lambda u: fs.FileSystem.from_uri(u)[1]


def _writer(folder: str, shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path_of = _filesystem(folder)
        schema = _types(INDEX)
        known: dict[str, tuple[str, int, int]] = {}  # of the open shard only, so bounded by its size
        out, at, shard = None, 0, ""
        for batch in batches:
            cells: list[tuple] = []
            for doc, n_bytes, digest, shared, owned, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not owned:
                    cells.append((doc, n_bytes, digest, shared, None, None, None))
                    continue
                if digest not in known:
                    if out is None or at > shard_bytes:
                        if out is not None:
                            out.write(bytes(1024))
                            out.close()
                        shard, at, known = f"{folder}/{uuid.uuid4().hex}.tar", 0, {}
                        out = files.open_output_stream(path_of(shard))
                    media = to_png(pad((text or "").encode("utf-8", "surrogatepass")))
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.GNU_FORMAT)
                    out.write(head)
                    out.write(media)
                    out.write(bytes(-len(media) % 512))
                    known[digest] = (shard, at + len(head), len(media))
                    at += len(head) + len(media) + -len(media) % 512
                cells.append((doc, n_bytes, digest, shared, *known[digest]))
            columns = list(zip(*cells)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return write


def _types(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def payload_of(text: Column) -> Column:
    """The padded bytes of a text."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = (F.greatest(F.ceil(F.octet_length(data) / WIDTH), F.lit(1)) * WIDTH).cast("int")
    return F.rpad(data, size, F.lit(bytearray(1)))


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes each different payload of the rows' texts to tar shards in folder; returns the index.

    One row for every row of docs; shard, offset and length are null where another row owns the payload.
    """
    spark = docs.sparkSession
    _make_folder(spark, folder)
    text = docs[text_col].cast("string")
    rows = docs.select(
        docs[id_col].cast("long").alias("id"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), F.sha2(payload_of(text), 256).alias("digest"), text.alias("text")
    )
    copies = rows.groupBy("digest").agg(F.count("*").alias("k"), F.min("id").alias("owner")).where("k > 1")
    copies = materialize(copies, "copies")
    n, total = copies.agg(F.count("*"), F.sum("k")).first()
    if small(copies, n) is not copies:
        owned = rows.join(small(copies, n), "digest", "left")
    else:
        owned = join_spread(rows, copies, "digest", materialize(copies.where(F.col("k") > hot_rows(total)).select("digest"), "hot"), "left")
    shared = F.col("k").isNotNull()
    mine = ~shared | F.col("id").eqNullSafe(F.col("owner"))
    owned = owned.select("id", "n_bytes", "digest", shared.alias("shared"), mine.alias("mine"), F.when(mine, F.col("text")).alias("text"))
    index = f"{folder}/index.parquet"
    map_in_arrow(owned, _writer(folder, shard_bytes), INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def _each_stored(batches: Iterator[pa.RecordBatch], read, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows with what read (open file, row) gives for them, in the order of their places in the shards."""
    files, path_of, name, opened = None, None, None, None
    for batch in batches:
        rows = sorted(batch.to_pylist(), key=lambda r: (r["shard"], r["offset"]))
        for r in rows:
            if r["shard"] != name:
                if files is None:
                    files, path_of = _filesystem(r["shard"])
                if opened is not None:
                    opened.close()
                name, opened = r["shard"], files.open_input_file(path_of(r["shard"]))
            r.update(read(opened, r))
        yield pa.RecordBatch.from_pylist(rows, schema)


def _header(opened, r: dict) -> dict:
    width, height, depth = png_header(opened.read_at(HEADER, r["offset"]))
    return {"width": width, "height": height, "bit_depth": depth, "payload_bytes": width * height * depth // 8}


def _payload(opened, r: dict) -> dict:
    media = opened.read_at(r["length"], r["offset"])
    payload = from_png(media)
    if len(payload) != r["payload_bytes"]:
        raise ValueError("a stored payload isn't of the size that its header says")
    return {
        "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(payload),
    }


def media_headers(stored: DataFrame) -> DataFrame:
    """Rows of an index that have a place, with width, height, bit_depth and payload_bytes from header-only range reads."""
    return map_in_arrow(stored, lambda batches: _each_stored(batches, _header, _types(HEADERS)), HEADERS)


def media_facts(with_headers: DataFrame) -> DataFrame:
    """Such rows with what the stored bytes, read back, give."""
    return map_in_arrow(with_headers, lambda batches: _each_stored(batches, _payload, _types(FACTS)), FACTS)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Stores every row's text and returns (id, n_bytes, ..., feature) as read back from the shards."""
    index = store_media(docs, folder or fresh_path(docs.sparkSession, "media"), id_col, text_col)
    stored = index.where("shard is not null")
    # the index is small beside what it points to, so its rows are dealt by the bytes to read, shards in pieces
    tasks = max(1, -(-(stored.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    stored = stored.repartition(tasks, "shard", F.floor(F.col("offset") / READ_BYTES))
    facts = materialize(media_facts(media_headers(stored)), "facts")
    known = [c for c in facts.columns if c not in ("id", "n_bytes", "digest", "shared")]
    of_shared = facts.where("shared").groupBy("digest").agg(F.min(F.struct(*known)).alias("f")).select("digest", "f.*")
    of_shared = materialize(of_shared, "shared")
    rows = index.where("shared").select("id", "n_bytes", "digest")
    n = of_shared.count()
    if small(of_shared, n) is not of_shared:
        joined = rows.join(small(of_shared, n), "digest")
    else:
        counts = rows.groupBy("digest").agg(F.count("*").alias("k"))
        joined = join_spread(rows, of_shared, "digest", materialize(counts.where(F.col("k") > hot_rows(rows.count())).select("digest"), "hot"), "inner")
    columns = ["id", "n_bytes", "digest", *known]
    return facts.where("not shared").select(columns).unionByName(joined.select(columns)).select(
        F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.col("length").alias("media_bytes"), "media_sha256", "feature", "digest", "shard", "offset", "width", "height", "bit_depth",
    )
