"""Documents in blocks, and an exchange that tells each block which of its keys other blocks hold too.

A block is a run of rows with about ``block_bytes`` of text, kept as one compressed Arrow batch and written
once to the shared checkpoint folder: its content no longer depends on which executor makes it again.
Keys (64-bit hashes) are made unique inside a block before they are shuffled, so a key that a third of all
rows share is sent once per block; the answer is one bit per sent key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ebbtide.llm.kernels import bytes_of
from ebbtide.session import pin

BLOCK_BYTES = 1 << 20


def encode(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def decode(payload) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as reader:
        return reader.read_next_batch()


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text; a longer text stands alone or ends its run."""
    _, cuts = bytes_of(batch.column(text))
    place = cuts[:-1] // limit
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def blocks(docs: DataFrame, text: str, columns: Sequence[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block, (block, payload), written to the checkpoint folder."""
    limit = block_bytes

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([encode(part)], pa.binary())], ["block", "payload"]
                )
                number += 1

    return pin(docs.select(*columns).mapInArrow(pack, "block long, payload binary"))


def rows_of(packed: DataFrame, schema: StructType) -> DataFrame:
    """The rows of all blocks with their places, ``block`` and ``row``: keys that no two rows share."""
    placed = StructType([*schema, StructField("block", LongType()), StructField("row", IntegerType())])
    arrow = to_arrow_schema(placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                rows = decode(payload.as_buffer())
                columns = [*rows.columns, pa.array(np.full(rows.num_rows, block)), pa.array(np.arange(rows.num_rows))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return packed.mapInArrow(run, placed)


def take_rows(packed: DataFrame, chosen: DataFrame, columns: Sequence[str], schema: StructType) -> DataFrame:
    """The rows at the places (block, row, copies) of ``chosen``, each as often as its copies say.

    ``columns`` of the payload come out in the order and with the names and types of ``schema``.
    """
    arrow, wanted = to_arrow_schema(schema), list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, places in zip(batch.column("payload"), batch.column("places").to_pylist()):
                at = np.repeat([p["row"] for p in places], [p["copies"] for p in places])
                rows = decode(payload.as_buffer()).select(wanted).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(rows.columns, arrow)], schema=arrow)

    listed = F.sort_array(F.collect_list(F.struct(F.col("row").cast("int").alias("row"), F.col("copies").cast("int").alias("copies"))))
    places = chosen.groupBy("block").agg(listed.alias("places"))
    return packed.join(places.hint("shuffle_hash"), "block").select("payload", "places").mapInArrow(run, schema)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The shuffle part of a key; rises with the key, so sorted keys lie part by part."""
    return ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def parts_of(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def outgoing(block: int, keys: np.ndarray, parts: int, checks: np.ndarray | None = None) -> Iterator[tuple]:
    """Sorted unique keys of a block as one row per part."""
    edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[part], edges[part + 1]
        yield block, part, keys[a:b].tobytes(), b"" if checks is None else checks[a:b].tobytes()


SENT = "block long, part int, keys binary, checks binary"
SENT_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary())])


def send(packed: DataFrame, keys_of: Callable[..., tuple[np.ndarray, np.ndarray | None]], parts: int) -> DataFrame:
    """Keys of every block; ``keys_of`` gets the block's batch and its other columns as a dictionary."""
    names = [c for c in packed.columns if c not in ("block", "payload")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                extra = {n: batch.column(n)[row].as_py() for n in names}
                keys, checks = keys_of(decode(batch.column("payload")[row].as_buffer()), **extra)
                sent = list(outgoing(batch.column("block")[row].as_py(), keys, parts, checks))
                if sent:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*sent), SENT_ARROW)], schema=SENT_ARROW
                    )

    return packed.mapInArrow(run, SENT)


def shared(sent: DataFrame, parts: int, out: str) -> DataFrame:
    """Per block, the bits that say which of its sent keys another block has sent as well.

    ``out`` holds the bit strings of the parts in order. Each part is compared in one task and holds a
    share of the distinct keys of each block; ``parts`` (the shuffle partitions) bounds its size.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for block, part, keys, checks in zip(*(batch.column(n).to_pylist() for n in SENT_ARROW.names)):
                held[part].append((block, np.frombuffer(keys, np.uint64), np.frombuffer(checks, np.uint32)))
        for part in sorted(held):
            rows = held.pop(part)
            keys = np.concatenate([r[1] for r in rows])
            checks = np.concatenate([r[2] for r in rows])
            order = np.lexsort((checks, keys)) if len(checks) else np.argsort(keys, kind="stable")
            same = keys[order[1:]] == keys[order[:-1]]
            if len(checks):
                same &= checks[order[1:]] == checks[order[:-1]]
            both = np.zeros(len(keys), dtype=bool)
            both[order[1:]] = same
            both[order[:-1]] |= same
            edges = np.cumsum([0, *(len(r[1]) for r in rows)])
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([part] * len(rows), pa.int32()),
                pa.array([np.packbits(both[a:b]).tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
            ], ["block", "part", "bits"])

    told = sent.repartition(parts, "part").mapInArrow(compare, "block long, part int, bits binary")
    ordered = F.sort_array(F.collect_list(F.struct("part", "bits")))
    return told.groupBy("block").agg(F.transform(ordered, lambda x: x["bits"]).alias(out))


def with_answers(packed: DataFrame, answers: DataFrame) -> DataFrame:
    return packed.join(answers.hint("shuffle_hash"), "block", "left")


def read_bits(keys: np.ndarray, parts: int, answer: Sequence[bytes] | None) -> np.ndarray:
    """The answer to ``outgoing``: true where another block holds the key."""
    out = np.zeros(len(keys), dtype=bool)
    edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    filled = np.flatnonzero(np.diff(edges)).tolist()
    if len(filled) != len(answer or ()):
        raise ValueError(f"{len(filled)} parts were sent, {len(answer or ())} came back")
    for part, bits in zip(filled, answer or ()):
        a, b = edges[part], edges[part + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out
