"""Exact duplicates by a tree-merge of sorted digest runs.

Every document falls into one of ``RUNS`` runs by a hash of its id; a run is its distinct digests in order, with
smallest id and count, cut into slices of the digest space. In each binomial round, run r of ``FAN ** k`` neighbours
takes over the runs of ``FAN - 1`` others: a task streams the sorted files of one slice and merges them, a block of
each at a time. After the last round run 0 is left, one sorted file a slice. Equal sha256 alone joins nothing: at
every level a second hash and the length have to agree too. A digest met by all rows is one entry a run, so it can't
swell; files are put in place by a rename, so a task that runs again leaves no half run behind.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RUNS, FAN = 64, 4
#: Digests of a slice, about; slices are told apart by the first 16 bits of a digest.
SLICE_ROWS, MOST_SLICES = 500_000, 1 << 16
#: Rows of a block of a run in a merge.
BLOCK = 32_768
_KEYS = ("sha", "check", "bytes")
_SCHEMA = pa.schema([("sha", pa.binary()), ("check", pa.int64()), ("bytes", pa.int32()), ("first", pa.int64()), ("n", pa.int64())])
_MANIFEST = "run int, slice int, path string"


def normalised(text):
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


class Block:
    """Rows of a run: keys as six unsigned numbers a row, in the order of (sha, check, bytes); smallest ids, whether there is one, counts."""

    def __init__(self, keys: np.ndarray, first: np.ndarray, known: np.ndarray, n: np.ndarray):
        self.keys, self.first, self.known, self.n = keys, first, known, n

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Block:
        sha = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(-1, 4)
        # signed numbers in their own order
        check = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        keys = np.column_stack([sha.astype(np.uint64), check, batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)])
        first = batch.column(3)
        return cls(keys, first.fill_null(0).to_numpy(zero_copy_only=False), first.is_valid().to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False))

    def __len__(self) -> int:
        return len(self.n)

    def __getitem__(self, rows) -> Block:
        return Block(self.keys[rows], self.first[rows], self.known[rows], self.n[rows])

    def key(self, row: int) -> tuple[int, ...]:
        return tuple(self.keys[row].tolist())

    def until(self, key: tuple[int, ...]) -> int:
        """How many rows have this key or a smaller one."""
        return bisect_right(range(len(self)), key, key=self.key)

    def batch(self) -> pa.RecordBatch:
        sha = np.ascontiguousarray(self.keys[:, :4].astype(">u8")).view(np.uint8).reshape(-1, 32)
        digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(self), [None, pa.py_buffer(np.ascontiguousarray(sha))]).cast(pa.binary())
        check = (self.keys[:, 4] ^ np.uint64(1 << 63)).view(np.int64)
        first = pa.array(self.first, pa.int64(), mask=~self.known)
        return pa.RecordBatch.from_arrays([digests, pa.array(check), pa.array(self.keys[:, 5].astype(np.int32)), first, pa.array(self.n.astype(np.int64))], schema=_SCHEMA)


def joined(blocks: list[Block]) -> Block:
    """The rows of several blocks in order; equal keys are one, with the smallest id and the sum of counts."""
    keys, first, known, n = (np.concatenate(x) for x in zip(*((b.keys, b.first, b.known, b.n) for b in blocks)))
    order = np.lexsort(keys.T[::-1])
    keys, first, known, n = keys[order], first[order], known[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    least = np.minimum.reduceat(np.where(known, first, np.iinfo(np.int64).max), begin)
    return Block(keys[begin], least, np.logical_or.reduceat(known, begin), np.add.reduceat(n, begin))


def merged(runs: list[Iterator[Block]]) -> Iterator[Block]:
    """Multiway merge of sorted runs that hold each key once. A block of each run is held, no more."""
    heads: dict[int, Block] = {}
    going = dict(enumerate(runs))
    while True:
        for k in [k for k in going if not len(heads.get(k, ()))]:
            block = next(going[k], None)
            if block is None:
                going.pop(k)
                heads.pop(k, None)
            else:
                heads[k] = block
        if not heads:
            return
        # all that is to come is above the smallest of the blocks' last keys
        bound = min(b.key(len(b) - 1) for b in heads.values() if len(b))
        taken = []
        for k, block in heads.items():
            if at := block.until(bound):
                taken.append(block[:at])
                heads[k] = block[at:]
        yield joined(taken)


def _place(folder: str, run: int, piece: int) -> str:
    return f"{folder}/run-{run:03d}-{piece:05d}.parquet"


class _Writer:
    """A run's file, in place under its name only when it is whole."""

    def __init__(self, path: str):
        from pyspark import TaskContext

        self.fs, base = C.filesystem(path)
        folder, _, name = base.rpartition("/")
        self.base, self.temporary = base, f"{folder}/_{name}.{TaskContext.get().taskAttemptId()}"
        self.out = pq.ParquetWriter(self.temporary, _SCHEMA, filesystem=self.fs, compression="lz4", use_dictionary=False)

    def write(self, batch: pa.RecordBatch) -> None:
        self.out.write_batch(batch)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.base)


def _manifest(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    run, piece, path = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(piece, pa.int32()), pa.array(path)], ["run", "slice", "path"])


def _write_runs(folder: str):
    """Rows (run, slice, sha, check, bytes, first, n) in order: one file for each run and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, done = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
            bounds = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
            for a, b in zip(bounds, bounds[1:]):
                now = tuple(where[a].tolist())
                if now != own:
                    if out:
                        out.close()
                    own, path = now, _place(folder, *now)
                    out = _Writer(path)
                    done.append((*now, path))
                out.write(batch.select(range(2, 7)).slice(a, b - a).cast(_SCHEMA))
        if out:
            out.close()
            yield _manifest(done)

    return run


def _blocks(path: str) -> Iterator[Block]:
    fs, base = C.filesystem(path)
    with fs.open_input_file(base) as f:
        for batch in pq.ParquetFile(f).iter_batches(BLOCK):
            yield Block.of(batch)


def _merge_runs(folder: str):
    """(run, slice, paths): the runs' files of one slice become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, piece, paths in zip(*(batch.column(k).to_pylist() for k in range(3))):
                path = _place(folder, own, piece)
                out = _Writer(path)
                for block in merged([_blocks(p) for p in paths]):
                    out.write(block.batch())
                out.close()
                yield _manifest([(own, piece, path)])

    return run


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, check, bytes, run) of each row: sha256 of the normalised text, and two more marks to verify it by."""
    text = normalised(F.col("text"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    return own.select(
        "doc_id",
        F.unhex(F.sha2(F.encode("t", "utf-8"), 256)).alias("sha"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").alias("bytes"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(RUNS)).cast("int").alias("run"),
    )


def tree_merge(runs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Merge the runs (run, sha, check, bytes, first, n) in binomial rounds until one is left in each slice."""
    spark = runs.sparkSession
    folder = C.scratch_path(spark, "runs")

    def level(k: int) -> str:
        fs, base = C.filesystem(f"{folder}/level{k}")
        fs.create_dir(base, recursive=True)
        return f"{folder}/level{k}"

    slices = min(MOST_SLICES, 8 << max(0, runs.count() // slice_rows).bit_length())
    head = F.conv(F.hex(F.substring("sha", 1, 2)), 16, 10).cast("int")
    ordered = runs.select("run", F.call_function("div", head * slices, F.lit(1 << 16)).cast("int").alias("slice"), *_KEYS, F.col("first").cast("long").alias("first"), "n")
    ordered = ordered.repartition("run", "slice").sortWithinPartitions("run", "slice", *_KEYS)
    manifest = C.materialise(ordered.mapInArrow(_write_runs(level(0)), _MANIFEST), "manifest")
    step, k = 1, 0
    while step < RUNS:
        step, k = step * FAN, k + 1
        # a run goes to the neighbour whose number has this round's digit, and those before it, at zero
        tasks = manifest.groupBy((F.col("run") - F.col("run") % step).cast("int").alias("run"), "slice").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        tasks = tasks.repartition(max(C.partitions(spark), 12), "run", "slice")
        manifest = C.materialise(tasks.mapInArrow(_merge_runs(level(k)), _MANIFEST), "manifest")
    return spark.read.schema("sha binary, check long, bytes int, first long, n long").parquet(f"{folder}/level{k}")


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs`` (doc_id, text; further columns are ignored).

    Null counts as the empty text. keep_id is the smallest doc_id of the equal texts; rows without doc_id are grouped
    like any other and never give it (keep_id is null where no row of the group has one). Of whole repeated rows, all
    say kept. An empty table gives an empty one.
    """
    C.tune(docs.sparkSession)
    rows = C.materialise(digests(docs), "digests")
    runs = rows.groupBy("run", *_KEYS).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    merged = tree_merge(runs).select(*_KEYS, F.col("first").alias("keep_id"), F.col("n").alias("group_size"))
    found = C.lookup(rows, _KEYS, merged, "run")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
