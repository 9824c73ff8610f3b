"""Helpers of the training-data operators: columns, durable tables, columnar block shuffles."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dealt
from .kernels import mix as mixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table each row of which is work, spread over the cores if its files' layout would give it to a few."""
    return dealt(table(spark, sf_dir, name))


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, under names of our own; whatever other columns docs has stay out of the way. Rows without a key are left out."""
    return docs.select(docs[key].cast("long").alias("tl_doc"), docs[text].cast("string").alias("tl_text")).where("tl_doc is not null")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the cluster's shared checkpoint folder, so that a lost executor takes nothing with it.

    The folder is the session's spark.checkpoint.dir; where that is unset and the master is local, a temporary one of our own."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's own switch (4.1): what an action has shuffled is deleted when the action ends. A DataFrame has it as it was set when the DataFrame was made.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """durable(df), and the shuffle files it came from are deleted as soon as it is written; otherwise they stay until the driver happens to collect its garbage.

    Only what this one computation of df has shuffled goes: a later one of df, or of anything df was made of, shuffles again."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        own = df.select("*")
    finally:
        if before is None:
            conf.unset(DROP_SHUFFLES)
        else:
            conf.set(DROP_SHUFFLES, before)
    return durable(own)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. On a cluster it has to be set: a folder of one machine would do there only until another one reads it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """(df as a Parquet table of its own in the shared checkpoint folder, the table's path); it stays there until it is dropped."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shipped(spark: SparkSession, value: object):
    """value broadcast to the executors; for values of a size that is bounded by a parameter."""
    return spark.sparkContext.broadcast(value)


class Scatter:
    """Map side of a block shuffle: rows held as numpy columns go out as one binary row per bucket.

    A row-wise exchange costs about a microsecond a row on either side; packed columns cost a few
    nanoseconds, and sorted ids inside a block compress well. Rows are held until about `hold` of
    them (or HOLD_BYTES of long values) are there, so that blocks stay large however many buckets there
    are. With long, a last column holds a run of 64-bit values for each row."""

    HOLD_BYTES = 1 << 26

    def __init__(self, buckets: int, dtypes: list[str], hold: int = 1 << 20, long: bool = False):
        self.buckets, self.dtypes, self.hold, self.long = buckets, [np.dtype(d) for d in dtypes], hold, long
        self.held: list[tuple[np.ndarray, ...]] = []
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = self.bytes = 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray, run: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        """run: the values of all rows' runs, and how many each row has."""
        if len(bucket):
            self.held.append((bucket.astype(np.int32), *(np.asarray(c).astype(d, copy=False) for c, d in zip(columns, self.dtypes, strict=True))))
            self.n += len(bucket)
            if run is not None:
                self.runs.append((run[0].astype(np.uint64, copy=False), run[1].astype(np.int64)))
                self.bytes += 8 * len(run[0])
        if self.n >= self.hold or self.bytes >= self.HOLD_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        bucket, *columns = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        there, start = np.unique(bucket, return_index=True)
        ends = np.append(start, len(bucket))
        out = [pa.array(there, pa.int32())]
        for c, d in zip(columns, self.dtypes, strict=True):
            out.append(_binary(c[order], ends * d.itemsize))
        if self.long:
            values, sizes = (np.concatenate(c) for c in zip(*self.runs, strict=True))
            at = np.cumsum(sizes) - sizes
            sizes, at = sizes[order], at[order]
            before = np.concatenate([[0], np.cumsum(sizes)])
            out += [_binary(sizes.astype(np.int32), ends * 4), _binary(values[np.repeat(at, sizes) + ranges(sizes)], before[ends] * 8)]
        self.held, self.runs, self.n, self.bytes = [], [], 0, 0
        yield pa.RecordBatch.from_arrays(out, names=["bucket", *(f"c{k}" for k in range(len(out) - 1))])

    @property
    def schema(self) -> str:
        return "bucket int, " + ", ".join(f"c{k} binary" for k in range(len(self.dtypes) + 2 * self.long))


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key, from its high bits."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def block_shuffle(df: DataFrame, buckets: int) -> DataFrame:
    """df of a Scatter's rows, each bucket in the partition of its number."""
    return df.repartitionById(buckets, F.col("bucket"))


def gathered(batches: Iterator[pa.RecordBatch], dtypes: list[str]) -> list[np.ndarray]:
    """Reduce side of a block shuffle: the columns of all blocks of the partition, or an empty list."""
    blocks: list[list[bytes]] = [[] for _ in dtypes]
    for batch in batches:
        for k in range(len(dtypes)):
            blocks[k] += [v.as_buffer() for v in batch.column(k + 1) if v.is_valid]
    if not blocks[0]:
        return []
    return [np.concatenate([np.frombuffer(b, d) for b in block]) for block, d in zip(blocks, dtypes, strict=True)]


def block_reduce(df: DataFrame, buckets: int, dtypes: list[str], f: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over the numpy columns of each bucket of df, a Scatter's rows."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if columns := gathered(batches, dtypes):
            yield from f(*columns)

    return block_shuffle(df, buckets).mapInArrow(reduce, schema)


class Blocks:
    """Rows held as numpy columns go out as one packed row a block, which names the bucket that the block belongs to.

    A block has about `hold` rows (values, if sizes are added by the value), of whole texts. Block numbers are of
    the partition and the place in it, so a partition has to have the same rows in the same order whenever it is computed, as scans of files and durable tables have."""

    def __init__(self, buckets: int, dtypes: list[str], hold: int = 1 << 20):
        self.buckets, self.dtypes, self.hold = buckets, [np.dtype(d) for d in dtypes], hold
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n, self.next = 0, TaskContext.get().partitionId() << 32

    def add(self, n: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if n:
            self.held.append(tuple(np.asarray(c).astype(d, copy=False) for c, d in zip(columns, self.dtypes, strict=True)))
            self.n += n
        if self.n >= self.hold:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            block, columns = self.take()
            yield pa.RecordBatch.from_pydict({"bucket": block_bucket(np.array([block]), self.buckets), "block": pa.array([block], pa.int64()), **{f"b{k}": pa.array([c.tobytes()], pa.binary()) for k, c in enumerate(columns)}})

    def take(self) -> tuple[int, list[np.ndarray]]:
        """The block's number and columns; the next block begins."""
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.n, self.next = [], 0, self.next + 1
        return self.next - 1, columns


def block_schema(dtypes: list[str]) -> str:
    return "bucket int, block long, " + ", ".join(f"b{k} binary" for k in range(len(dtypes)))


def block_bucket(block: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(mixed(block.astype(np.uint64)), buckets)


def unpacked(batch: pa.RecordBatch, dtypes: list[str], first: int = 2) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Number and columns of the blocks in a batch."""
    for i in range(len(batch)):
        if batch.column(first).is_valid()[i].as_py():
            yield batch.column(1)[i].as_py(), [np.frombuffer(batch.column(first + k)[i].as_buffer(), d) for k, d in enumerate(dtypes)]


def ask(
    blocks: DataFrame,
    buckets: int,
    dtypes: list[str],
    question: Callable[..., tuple[np.ndarray, ...]],
    values: list[str],
    answer: Callable[..., tuple[np.ndarray, ...]],
    answers: list[str],
    use: Callable[..., Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """What the corpus says about the keys of every block, brought back to the block.

    question(*columns of a block): its distinct keys, and values for each; only these are shuffled, so that a key
    that a third of all rows have goes out once a block. answer(keys, *values of all blocks): indices of the questions that get an
    answer, and columns of the answers. use(*columns of a block, keys, *answers): keys in order, with their answers."""

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Scatter(buckets, ["u8", *values, "i8"])
        for batch in batches:
            for block, columns in unpacked(batch, dtypes):
                key, *value = question(*columns)
                yield from out.add(bucket_of(key, buckets), key, *value, np.full(len(key), block))
        yield from out.flush()

    def replies(key: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        *value, block = rest
        at, *reply = answer(key, *value)
        out = Scatter(buckets, ["i8", "u8", *answers], 1 << 19)
        for a in range(0, len(at), 1 << 19):
            x = slice(a, a + (1 << 19))
            yield from out.add(block_bucket(block[at[x]], buckets), block[at[x]], key[at[x]], *(r[x] for r in reply))
        yield from out.flush()

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, kinds = [], ["i8", "u8", *answers]
        parts_: list[list[np.ndarray]] = [[] for _ in kinds]
        n = 2 + len(dtypes)
        for batch in batches:
            whole += list(unpacked(batch, dtypes))
            for i in np.flatnonzero(batch.column(n).is_valid().to_numpy(zero_copy_only=False)).tolist():
                for k, d in enumerate(kinds):
                    parts_[k].append(np.frombuffer(batch.column(n + k)[i].as_buffer(), d))
        block, key, *reply = (np.concatenate(p) if p else np.zeros(0, d) for p, d in zip(parts_, kinds, strict=True))
        order = np.lexsort((key, block))
        block, key, *reply = (c[order] for c in (block, key, *reply))
        for number, columns in whole:
            a, b = np.searchsorted(block, number), np.searchsorted(block, number, "right")
            yield from use(*columns, key[a:b], *(r[a:b] for r in reply))

    asked = blocks.mapInArrow(asks, Scatter(buckets, ["u8", *values, "i8"]).schema)
    replied = block_reduce(asked, buckets, ["u8", *values, "i8"], replies, Scatter(buckets, ["i8", "u8", *answers]).schema)
    return block_shuffle(blocks.unionByName(replied, allowMissingColumns=True), buckets).mapInArrow(uses, schema)


def found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key among sorted ones, whether it is there)."""
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of rows that are equal in all keys begins."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])]))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c in counts, one after another."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def cut(texts: pa.Array, spans: pa.ListArray) -> pa.Array:
    """texts without the spans: lists of structs start, end in code points, which may overlap; a null list cuts nothing."""
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text is None or not cuts:
            out.append(text)
            continue
        kept, at = [], 0
        for c in sorted(cuts, key=lambda c: c["start"]):
            if c["start"] > at:
                kept.append(text[at : c["start"]])
            at = max(at, c["end"])
        out.append("".join([*kept, text[at:]]))
    return pa.array(out, pa.string())


def joined(big: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """big joined with small, which holds ids and short lists, by a shuffle of both: small grows with the corpus, so it isn't broadcast. big is streamed past hash tables of small's partitions and needn't be sorted."""
    return big.join(small.hint("shuffle_hash"), on, how)
