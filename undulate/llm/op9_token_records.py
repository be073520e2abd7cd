"""Token ids as length-delimited binary records, with an offset index beside them.

A file begins with a magic word and the bytes per id. A record is: payload length (4 bytes), masked checksum of those 4
bytes, payload (little-endian ids), masked checksum of the payload. The checksum is CRC-32, rotated by 15 bits plus a
constant, so that data that hold checksums stay checkable. The index (a table) has file, offset and length of each
record: readers fetch records in any order with one seek each, and a file needs no marks to be split.

Files are written in ascending doc_id (null first; equal ids by the hash of their text) by a range partitioning: file
k+1 goes on where file k ends. Each task attempt writes a file of its own name and the index lists those of the attempt
that counted, so a lost executor leaves a file that nobody reads. Null texts are empty documents of the end id alone.
Only doc_id and text are read; repeated rows are records of their own; an empty table gives an empty index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from undulate.llm.common import encoder, id_count, in_batches, shared_folder, stored, text_batches, texts_of, vocabulary

MAGIC = b"UREC1"
INDEX = "doc_id long, file string, part int, nth long, offset long, bytes int, n_tokens long"
READ = "doc_id long, part int, nth long, n_tokens long, ids_before long, ids_crc32 long"
READ_IDS = READ + ", ids array<int>"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<I", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(data: bytes) -> bytes:
    """The payload of one whole record; a broken one raises."""
    if len(data) < 12:
        raise ValueError("record cut short")
    n, c = struct.unpack("<II", data[:8])
    payload = data[8:-4]
    if masked(data[:4]) != c or n != len(payload) or struct.pack("<I", masked(payload)) != data[-4:]:
        raise ValueError("record fails its checksum")
    return payload


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_records(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write the files; the index, kept in the shared folder as well."""
    import pyarrow as pa

    spark = docs.sparkSession
    text_batches(spark)
    folder = f"{shared_folder(spark)}/records"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, at, nth = TaskContext.get().partitionId(), None, 0, 0
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rec"
        enc = encoder(vocabulary(tokenizer), True)
        code = np.dtype("<u4" if id_count(enc.path) > 1 << 16 else "<u2")
        for b in in_batches(batches):
            if out is None:
                fs, path = _open(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path)
                out.write(MAGIC + bytes([code.itemsize]))
                at = len(MAGIC) + 1
            ids, edges = enc.encode(texts_of(b.column("text")))
            ids = ids.astype(code)
            end = np.array([end_id], code).tobytes()
            rows, chunk, begin = [], [], at
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                record = framed(ids[lo:hi].tobytes() + end)
                chunk.append(record)
                rows.append((begin, len(record), hi - lo + 1))
                begin += len(record)
            out.write(b"".join(chunk))
            n = len(rows)
            offset, size, tokens = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), pa.array([uri] * n), pa.array([part] * n, pa.int32()), pa.array(range(nth, nth + n), pa.int64()),
                pa.array(offset, pa.int64()), pa.array(size, pa.int32()), pa.array(tokens, pa.int64())],
                names=["doc_id", "file", "part", "nth", "offset", "bytes", "n_tokens"])
            at, nth = begin, nth + n
        if out is not None:
            out.close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order)  # rows of one id, or of none, spread by their texts
    return stored(rows.sortWithinPartitions(*order).mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """Fetch the records of an index (or of any part of it) by their offsets, check and decode them.

    ids_before: ids of the records read before in the same file.
    """
    import pyarrow as pa

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, width, before = None, None, 2, 0
        for b in batches:
            if not b.num_rows:
                continue
            counts, sums, crcs, all_ids = [], [], [], []
            for uri, offset, size in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "bytes"))):
                if uri != name:
                    if f is not None:
                        f.close()
                    fs, path = _open(uri)
                    f, name, before = fs.open_input_file(path), uri, 0
                    head = f.read_at(len(MAGIC) + 1, 0)
                    if head[:-1] != MAGIC:
                        raise ValueError(f"{uri} is no record file")
                    width = head[-1]
                ids = np.frombuffer(unframed(f.read_at(size, offset)), f"<u{width}").astype("<u4")
                counts.append(len(ids))
                sums.append(before)
                crcs.append(zlib.crc32(ids.tobytes()))
                before += len(ids)
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            arrays = [b.column("doc_id"), b.column("part"), b.column("nth"), *(pa.array(x, pa.int64()) for x in (counts, sums, crcs))]
            names = ["doc_id", "part", "nth", "n_tokens", "ids_before", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        if f is not None:
            f.close()

    rows = index.select("doc_id", "part", "nth", "file", "offset", "bytes").repartition("file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, READ_IDS if with_ids else READ)


def token_positions(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: a running sum over the files, and inside each as read."""
    read = stored(read, "read")
    files = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return read.join(files, "part").select("doc_id", (F.col("base") + F.col("ids_before")).cast("long").alias("start"), "n_tokens", "ids_crc32")
