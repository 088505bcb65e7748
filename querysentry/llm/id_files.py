"""Token-ID files: fixed-width bit packing with block offsets.

Every id takes the least number of bits that hold the vocabulary. Documents follow each
other in ascending key order. A file's rows are segments: whole documents, their ids in
blocks of ``block_ids``, each block starting at a byte whose offset is stored. A reader
unpacks any block, or any id, by numpy arithmetic without touching the rest. The rows are
Parquet, so writing is atomic, works on any store Spark writes to, and a lost task leaves
nothing behind.

Defined cases: a null text is empty and holds the end id only; equal keys are ordered by
a hash of their texts, then by the texts; null keys come first; an empty table gives no files' rows; a document of
any length is one segment; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querysentry.llm.frames import doc_columns, steps
from querysentry.llm.pretokens import word_encoder
from querysentry.session import shared_path

BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 19
SEGMENTS = (
    "part int, segment int, width int, block_ids int, n_ids bigint, block_offsets array<bigint>, payload binary, "
    "doc_ids array<bigint>, doc_lengths array<bigint>"
)


def width_of(vocabulary: int) -> int:
    """Bits an id of the vocabulary needs."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Little-endian bit string of the ids; id k takes the bits from k * width on."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` ids of a packed block, from id ``first`` on."""
    if width == 16:
        return np.frombuffer(payload, "<u2", n, 2 * first).astype(np.uint32)
    if n == 0:
        return np.zeros(0, np.uint32)
    at = (np.arange(first, first + n, dtype=np.int64)) * width
    low = int(at[0] >> 3)
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8)[low : int(at[-1] >> 3) + 8].astype(np.uint64)
    place = (at >> 3) - low
    word = np.zeros(n, np.uint64)
    for k in range(5):
        word |= raw[place + k] << np.uint64(8 * k)
    return (word >> (at & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray, width: int, block_ids: int = BLOCK_IDS) -> tuple[bytes, list[int]]:
    """Blocks that begin at whole bytes, and the byte each begins at."""
    blocks = [pack(ids[k : k + block_ids], width) for k in range(0, len(ids), block_ids)]
    sizes = np.cumsum([0, *map(len, blocks)])
    return b"".join(blocks), sizes[:-1].tolist()


def read_ids(segment: dict, first: int, n: int) -> np.ndarray:
    """Random access: ``n`` ids of a segment from id ``first`` on, reading only the blocks that hold them."""
    size, made = segment["block_ids"], []
    for block in range(first // size, -(-(first + n) // size)):
        begin = segment["block_offsets"][block]
        end = segment["block_offsets"][block + 1] if block + 1 < len(segment["block_offsets"]) else len(segment["payload"])
        low, high = max(first, block * size), min(first + n, (block + 1) * size)
        made.append(unpack(segment["payload"][begin:end], segment["width"], high - low, low - block * size))
    return np.concatenate(made) if made else np.zeros(0, np.uint32)


def write_id_files(
    docs: DataFrame, path: str, model_file: str, end_id: int, cut: str = "blank", text: str = "text", key: str = "doc_id",
    block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of all documents in ascending key order.

    Texts are dealt out by key ranges first and encoded afterwards: finding the ranges
    runs what lies below them once more, which should be a plain read.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*doc_columns(text, key)).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    kinds = (
        pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()),
        pa.list_(pa.int64()),
    )

    def segments(batches):
        from pyspark import TaskContext

        encoder, part = word_encoder(model_file, cut), TaskContext.get().partitionId()
        width, number, held, size = width_of(encoder.size), 0, [], 0

        def closed():
            ids = np.concatenate([ids for _, ids in held])
            payload, offsets = pack_blocks(ids, width, block_ids)
            row = (part, number, width, block_ids, len(ids), offsets, payload, [d for d, _ in held], [len(x) for _, x in held])
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for piece in steps(batch):
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text"))):
                    if held and size + len(ids) + 1 > segment_ids:
                        yield closed()
                        number, held, size = number + 1, [], 0
                    held.append((doc_id, np.append(ids, end_id)))
                    size += len(ids) + 1
        if held:
            yield closed()

    ordered.select("doc_id", "text").mapInArrow(segments, SEGMENTS).write.parquet(path)


def read_id_files(spark, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def documents_in(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    sizes = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", "segment", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("local")).join(parts, "part")

    def run(batches):
        for batch in batches:
            for segment in batch.to_pylist():
                ids = read_ids(segment, 0, segment["n_ids"]).astype("<u4")
                lengths = np.array(segment["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
                k = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment["part"]] * k, pa.int32()), pa.array([segment["segment"]] * k, pa.int32()),
                        pa.array(segment["doc_ids"], pa.int64()), pa.array(ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    made = files.mapInArrow(run, "part int, segment int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return made.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("local") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def id_files(docs: DataFrame, model_file: str, end_id: int, cut: str = "blank", **options) -> DataFrame:
    """Write the files to the shared folder and give back what they hold."""
    path = shared_path(docs.sparkSession, "id-files")
    write_id_files(docs, path, model_file, end_id, cut, **options)
    return documents_in(read_id_files(docs.sparkSession, path))
