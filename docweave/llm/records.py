"""Operator 5, token ids as length-delimited binary records with an offset index.

A file is a sequence of records: u64 length of the payload, u32 masked checksum of these eight bytes, the payload,
u32 masked checksum of the payload (all little-endian). A payload: i64 doc_id, u8 bytes of an id (2 or 4), the ids.
A checksum is the crc32 of the bytes, rotated right by 15 bits, plus 0xa282ead8, as in the well-known record format, so
that a checksum stored in data that is checked again is not its own. The index is a table beside the files, of one
row a record: file, offset, bytes, doc_id, n_tokens, and the tokens before it in the file; readers may take any rows of
it, in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators.scratch import shared_dir

from .common import small_batches, text_bytes
from .tokens import TOKENIZER, encoder

END = 1
INDEX = "part int, file string, offset long, bytes long, doc_id long, n_tokens long, before long"
READ = "part int, doc_id long, before long, n_tokens long, ids_crc32 long"
#: Rows of the index that a reader takes at once, and texts a writer encodes at once (by bytes).
READ_ROWS, WRITE_BYTES = 512, 4 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one record; ValueError if the record is damaged."""
    if len(record) < 16 or struct.unpack("<I", record[8:12])[0] != masked(record[:8]) or struct.unpack("<Q", record[:8])[0] != len(record) - 16:
        raise ValueError("damaged record length")
    payload = record[12:-4]
    if struct.unpack("<I", record[-4:])[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


#: Hadoop's names of stores that the native readers know by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def native_uri(uri: str) -> str:
    """The folder's URI as native file systems read it; a plain path is a local one."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return f"file://{uri}"
    if scheme == "file" and not rest.startswith("//"):  # Hadoop's short form
        return f"file://{rest}"
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(native_uri(uri))


def parts(texts: list[bytes], most: int = WRITE_BYTES) -> Iterator[slice]:
    """Slices of so many bytes about."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def writer(directory: str, tokenizer: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, out, offset, before = f"part-{part:06d}-{uuid.uuid4().hex}.rec", None, 0, 0
        enc = encoder(tokenizer)
        tail, width = np.array([end], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:  # a task's own file: a repeated task leaves one that no index row names
                system, path = file_system(directory)
                out = system.open_output_stream(f"{path}/{name}")
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in parts(texts):
                rows = []
                for doc, tokens in zip(ids[some], enc.encode(texts[some]), strict=True):
                    record = frame(struct.pack("<qB", -(2**63) if doc is None else doc, width) + tokens + tail)
                    n = len(tokens) // width + 1
                    out.write(record)
                    rows.append((part, name, offset, len(record), doc, n, before))
                    offset, before = offset + len(record), before + n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.string(), *[pa.int64()] * 5], strict=True)], names=["part", "file", "offset", "bytes", "doc_id", "n_tokens", "before"])
        if out is not None:
            out.close()

    return write


def write_records(docs: DataFrame, directory: str, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Writes the documents' ids in ascending doc_id order, a file a range of ids, and the index; returns the index.

    Null text: the end id alone. Null doc_ids come first; equal doc_ids in the order of their texts. The index is
    written with Spark's commit, so files of tasks that were repeated are not in it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    system, path = file_system(directory)
    system.create_dir(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(writer(directory, tokenizer, end), INDEX).write.parquet(f"{directory}/index")
    return spark.read.schema(INDEX).parquet(f"{directory}/index")


def payload_ids(payload: bytes) -> tuple[int, np.ndarray]:
    doc, width = struct.unpack_from("<qB", payload)
    return doc, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=9)


def read_records(index: DataFrame, directory: str) -> DataFrame:
    """Reads the records that the index rows name and checks them: part, doc_id, before, n_tokens, ids_crc32 of what was read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(directory)
        opened: dict = {}
        for whole in batches:
            for first in range(0, whole.num_rows, READ_ROWS):
                batch, rows = whole.slice(first, READ_ROWS).to_pydict(), []
                for part, name, offset, size, doc, before in zip(batch["part"], batch["file"], batch["offset"], batch["bytes"], batch["doc_id"], batch["before"], strict=True):
                    if name not in opened:
                        for f in opened.values():
                            f.close()
                        opened = {name: system.open_input_file(f"{path}/{name}")}
                    found, ids = payload_ids(unframe(opened[name].read_at(size, offset)))
                    if found != (-(2**63) if doc is None else doc):
                        raise ValueError("the index names another document")
                    rows.append((part, doc, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.int64()] * 4], strict=True)], names=["part", "doc_id", "before", "n_tokens", "ids_crc32"])

    return index.mapInArrow(read, READ)


def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as records, read back through the index: doc_id, start, n_tokens, ids_crc32 from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    directory = shared_dir(spark)
    index = write_records(docs, directory)
    # One row a file: the tokens of the files before it.
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    files = files.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__base"))
    read = read_records(index, directory)
    return read.join(files, "part").select("doc_id", (F.col("__base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
