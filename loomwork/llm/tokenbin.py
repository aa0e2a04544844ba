"""Token ids as wavelet-matrix files: succinct bit-planes with rank and select, one file a shard.

File (little-endian): the magic ``LWWM0001``; a header length (uint32) and JSON header; the zstd-compressed document
table (doc_ids int64 with a null mask, lengths uint32); then one zstd frame a bit-plane, each on its own, so that
a reader can fetch single planes. A plane's rank directory (ones before each 512 bits) is rebuilt when it is opened.
"""

from __future__ import annotations

import gc
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textkernel as K

MAGIC, END_ID, BLOCK = b"LWWM0001", 0, 512
#: Ids in one file: bounds a worker's memory and the loss when a task is run again.
SHARD_IDS = 2_000_000


class WaveletMatrix:
    """Bit-planes from the top bit down; each level is stably parted by its bit, zeros first."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.planes, self.n = planes, n
        self.ranks, self.zeros = [], []
        for plane in planes:
            per = np.bitwise_count(plane.view(np.uint64)).astype(np.int64).reshape(-1, BLOCK // 64).sum(axis=1) if len(plane) else np.zeros(0, np.int64)
            self.ranks.append(np.concatenate([[0], np.cumsum(per)]))
            self.zeros.append(n - int(self.ranks[-1][-1]))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        planes, now = [], np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = now & now.dtype.type(1 << level) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)]))
            parted, zeros = np.empty_like(now), len(now) - np.count_nonzero(bit)
            np.compress(~bit, now, out=parted[:zeros])
            np.compress(bit, now, out=parted[zeros:])
            now = parted
        return cls(planes, len(ids))

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8 : (i + 7) // 8]
        ones = int(np.bitwise_count(part).sum())
        if i % 8 and len(part):
            ones -= int(part[-1] >> (i % 8)).bit_count()
        return int(self.ranks[level][block]) + ones

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8] >> (i % 8)) & 1

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _span(self, value: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        for level in range(len(self.planes)):
            x, y = self._rank1(level, a), self._rank1(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if value >> (len(self.planes) - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` stands before place ``i``."""
        if value < 0 or value >> len(self.planes):
            return 0
        a, b = self._span(value, i)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) ``bit`` in a plane."""
        ranks = self.ranks[level]
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        raw = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(raw == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """Place of the ``k``-th (from 0) ``value``; -1 where there are fewer."""
        if value < 0 or value >> len(self.planes):
            return -1
        a, b = self._span(value, self.n)
        if not 0 <= k < b - a:
            return -1
        at = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, value: int) -> Iterator[int]:
        k = 0
        while (at := self.select(value, k)) >= 0:
            yield at
            k += 1

    def ids(self) -> np.ndarray:
        """All ids in order: the partings undone from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            back[np.flatnonzero(~bit)] = now[: self.zeros[level]]
            back[np.flatnonzero(bit)] = now[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            now = back
        return now


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Kinds of characters that the byte-level pattern tells apart; _HEAD begins a character of more bytes than one.
_LETTER, _NUMBER, _SPACE, _OTHER, _HEAD, _TAIL = 1, 2, 3, 4, 5, 6


class PieceEncoder:
    """Ids of whole texts, each distinct pre-token given to the tokenizers library once while it is remembered.

    For a byte-level vocabulary with the usual pattern, the pattern's cuts are found for a batch at once: characters are
    classed (by asking the library, once each), runs of a class are pre-tokens, a space goes to the
    pre-token after it. Distinct pre-tokens that aren't remembered then go to the model, many to a call. Texts with a
    special token pass the whole tokenizer, as do all texts of any other kind of vocabulary.
    """

    #: Pre-tokens met in more than one batch; and those met lately, twice over.
    KNOWN, RECENT = 500_000, 250_000

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.bare = Tokenizer.from_file(file), Tokenizer.from_file(file)
        kind = json.loads(self.tokenizer.to_str())
        pre, model = kind.get("pre_tokenizer") or {}, kind.get("model") or {}
        self.plain = (
            kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        self.bare.pre_tokenizer = WhitespaceSplit()
        # UTF-8 never holds the bytes FE and FF: one is the letter between pre-tokens of a call, one the space around it
        self.letters = np.array([ord(x) for _, x in sorted(_byte_letters().items())], "<u4")
        self.between = self.tokenizer.token_to_id(chr(self.letters[0xFE]))
        self.letters[0xFF] = 32
        self.plain = self.plain and self.between is not None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = np.zeros(0x110000, np.uint8)
        self.bytes = np.full(256, _HEAD, np.uint8)
        self.bytes[:128] = [self._kind(chr(b)) for b in range(128)] if self.plain else _OTHER
        self.bytes[128:192] = _TAIL
        self.known: dict[bytes, bytes] = {}
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _kind(self, c: str) -> int:
        """How the library's pattern classes a character, read from where it cuts."""
        cut = lambda x: [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(x)]
        around = cut(f"a{c}1")
        if len(around) == 2 and c != " ":
            return _LETTER if around[0] == (0, 2) else _NUMBER
        return _SPACE if len(cut(f"{c}\n")) == 1 else _OTHER

    def _classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte; all bytes of a character have its class."""
        kinds = self.bytes[data]
        heads = np.flatnonzero(kinds == _HEAD)
        if not len(heads):
            return kinds
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        lead, b1, b2, b3 = (padded[heads + k] for k in range(4))
        b1, b2, b3 = b1 & 63, b2 & 63, b3 & 63
        points = np.where(lead < 0xE0, (lead & 31) << 6 | b1, np.where(lead < 0xF0, (lead & 15) << 12 | b1 << 6 | b2, (lead & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        for c in np.unique(points[self.kinds[points] == 0]).tolist():
            self.kinds[c] = self._kind(chr(c))
        own = self.kinds[points]
        kinds[heads] = own
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            long = lead >= least
            kinds[heads[long] + k] = own[long]
        return kinds

    def cuts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where the pattern begins a pre-token in these bytes; ``rows`` are the texts' first places (no empty text)."""
        kinds, n = self._classes(data), len(data)
        begin = np.empty(n, bool)
        begin[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=begin[1:])
        edge = np.zeros(n + 1, bool)
        edge[rows] = edge[n] = begin[rows] = True
        # a run of white space: its last character leaves it where something else of the same text follows
        run = np.flatnonzero(begin)
        white = np.flatnonzero(kinds[run] == _SPACE)
        ends = np.append(run, n)[white + 1]
        inner = ~edge[ends]
        first, last = run[white][inner], ends[inner] - 1
        while (tail := data[last] & 0xC0 == 0x80).any():
            last[tail] -= 1
        begin[last] = True
        blank = data[last] == 32
        begin[last[blank] + 1] = False
        # contractions, where a run begins with the mark and no space was drawn to it
        marks = np.flatnonzero((data == 39) & begin)
        if len(marks):
            stop = np.append(rows, n)[np.searchsorted(rows, marks, "right")]
            after = np.concatenate([data, np.zeros(2, np.uint8)])
            one, two = after[marks + 1], after[marks + 2]
            short = (marks + 1 < stop) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = (marks + 2 < stop) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
            for found, size in ((short, 2), (long, 3)):
                at = marks[found]
                begin[at + 1] = False
                rest = at + size
                begin[rest[rest < n]] = True
        return np.flatnonzero(begin)

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pre-tokens, a thousand to a call of the library."""
        out = []
        for i in range(0, len(pieces), 1000):
            few = np.frombuffer(b"\xff\xfe\xff".join(pieces[i : i + 1000]), np.uint8)
            said = self.letters[few].tobytes().decode("utf-32-le")
            ids = np.array(self.bare.encode_batch_fast([said], add_special_tokens=False)[0].ids, np.uint32)
            raw, cut = ids.tobytes(), (4 * np.flatnonzero(ids == self.between)).tolist()
            out += [raw[a:b] for a, b in zip([0, *(x + 4 for x in cut)], [*cut, len(raw)])]
        return out

    def _found(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pre-tokens. One that a later batch meets again becomes known; the others are soon forgotten."""
        if len(self.recent) > self.RECENT:
            self.older, self.recent = self.recent, {}
        if len(self.known) > self.KNOWN:
            # what this batch holds is likely to come again
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        known, recent, older = self.known, self.recent, self.older
        found = list(map(known.get, pieces))
        strange = [i for i, x in enumerate(found) if x is None]
        fresh = []
        for i in strange:
            p = pieces[i]
            if x := recent.get(p) or older.get(p):
                known[p] = found[i] = x
            else:
                fresh.append(i)
        new = [pieces[i] for i in fresh]
        own = self._learn(new)
        recent.update(zip(new, own))
        for i, x in zip(fresh, own):
            found[i] = x
        return found

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of a string column, and how many each row has."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not self.plain:
            whole[:] = True
        odd = np.flatnonzero(whole)
        given = dict(zip(odd.tolist(), self._whole(texts.take(pa.array(odd)).to_pylist())))
        data, off = K.column_bytes(pc.if_else(pa.array(whole), "", texts) if len(odd) else texts)
        lengths = np.zeros(len(texts), np.int64)
        if len(data):
            rows = off[:-1][np.diff(off) > 0]
            cuts = self.cuts(data, rows)
            bounds = pa.py_buffer(np.append(cuts, len(data)).astype(np.int64))
            flat = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
            found = self._found(flat.dictionary.to_pylist())
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            pool, begins = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes
            index = flat.indices.to_numpy()
            each = sizes[index]
            total = np.concatenate([[0], np.cumsum(each)])
            kind = np.int32 if max(total[-1], len(pool)) < 2**31 else np.int64
            at = np.arange(total[-1], dtype=kind)
            at += np.repeat((begins[index] - total[:-1]).astype(kind), each)
            ids = pool[at]
            lengths = np.diff(total[np.searchsorted(cuts, off)])
        else:
            ids = np.zeros(0, np.uint32)
        if given:
            cut = np.split(ids, np.cumsum(lengths)[:-1])
            for row, own in given.items():
                cut[row], lengths[row] = own, len(own)
            ids = np.concatenate(cut)
        return ids, lengths


_encoders: dict[str, PieceEncoder] = {}


def encoder(file: str) -> PieceEncoder:
    """One encoder a worker process: what it remembers serves later tasks as well."""
    if file not in _encoders:
        _encoders[file] = PieceEncoder(file)
    return _encoders[file]


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.build(ids)
    press = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], bool)
    table = press(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits(known).tobytes() + lengths.astype("<u4").tobytes())
    planes = [press(p.tobytes()) for p in matrix.planes]
    header = json.dumps({"docs": len(doc_ids), "ids": len(ids), "table": len(table), "planes": [len(p) for p in planes]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, table, *planes])


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    if raw[:8] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    (size,) = struct.unpack_from("<I", raw, 8)
    head, at = json.loads(raw[12 : 12 + size]), 12 + size
    n, unpress = head["docs"], zstandard.ZstdDecompressor().decompress
    table, at = unpress(raw[at : at + head["table"]]), at + head["table"]
    known = np.unpackbits(np.frombuffer(table, np.uint8, -(-n // 8), 8 * n), count=n).astype(bool)
    doc_ids = [d if k else None for d, k in zip(np.frombuffer(table, "<i8", n).tolist(), known.tolist())]
    lengths = np.frombuffer(table, "<u4", n, 8 * n + -(-n // 8)).astype(np.int64)
    planes = []
    for length in head["planes"]:
        planes.append(np.frombuffer(unpress(raw[at : at + length]), np.uint8))
        at += length
    return doc_ids, lengths, WaveletMatrix(planes, head["ids"])


def write_shards(docs: DataFrame, folder: str, tokenizer: str, limit: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder``, ascending by doc_id (null first, ties in the input's order).

    Returns the manifest (part, seq, path, docs, ids); part and seq give the files' order. A task that runs again
    writes the same names, each put in place by a rename, so a lost executor leaves no half file behind.
    """
    spark = docs.sparkSession
    C.tune(spark)
    C.filesystem(folder)[0].create_dir(C.filesystem(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = C.filesystem(folder)
        encode = encoder(tokenizer)
        doc_ids: list[int | None] = []
        pieces: list[np.ndarray] = []
        held = seq = 0

        def flush() -> pa.RecordBatch:
            file = f"shard-{task.partitionId():06d}-{seq:06d}.lwwm"
            name = f"{base}/{file}"
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            raw = encode_file(doc_ids, lengths, np.concatenate(pieces))
            with fs.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as f:
                f.write(raw)
            fs.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            row = [[task.partitionId()], [seq], [f"{folder}/{file}"], [len(pieces)], [int(lengths.sum())]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "path", "docs", "ids"])

        for batch in batches:
            gc.disable()  # some hundred thousand live objects and no cycles: the collector would only walk them
            try:
                ids, lengths = encode(batch.column(1))
            finally:
                gc.enable()
            begins = np.cumsum(lengths) - lengths
            for doc_id, begin, length in zip(batch.column(0).to_pylist(), begins.tolist(), lengths.tolist()):
                doc_ids.append(doc_id)
                pieces.append(np.append(ids[begin : begin + length], np.uint32(END_ID)))
                held += length + 1
                if held >= limit:
                    yield flush()
                    doc_ids, pieces, held, seq = [], [], 0, seq + 1
        if pieces:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the tie only spreads a doc_id that many rows share
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(max(C.partitions(spark), 24), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    return C.materialise(ordered.mapInArrow(write, "part int, seq int, path string, docs long, ids long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of a manifest."""
    files = C.global_order(manifest, ["part", "seq"], "ids").select("path", F.col("_before").alias("start"))
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, base = C.filesystem(path)
                with fs.open_input_stream(base) as f:
                    doc_ids, lengths, matrix = decode_file(f.read())
                ids = matrix.ids().astype("<u4")
                stops = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip((stops - lengths).tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + stops - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(C.partitions(spark), 24), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents as wavelet-matrix files in the shared folder, and read their table back from the files.

    Null and empty texts are the end id alone; whole texts are encoded, however long. Repeated rows are written as
    often as they come. An empty table writes no file and gives an empty table.
    """
    folder = C.scratch_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, folder, tokenizer))
