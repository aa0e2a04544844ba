"""SimHash near-duplicates by a binary trie self-join.

Three rotations bring each third of the 64 bits to the front. Two fingerprints within two bits share one third whole,
so in one of the rotations their paths part below that third at the earliest. Nodes of the trie, at the depth where
they hold some ``NODE`` fingerprints, are the unit of distribution; a node that holds more than ``HOT_NODE`` is taken
eight bits deeper and handed out as pairs of nodes, again and again until none is left that large. A task walks its
node with itself, level by level: pairs of nodes carry the bits in which they differ, and a pair that overruns the
error budget is dropped with all that lies under it. A task returns a spanning forest of its links, never all pairs;
connected components come from alternating large and small stars over written edge tables.

``keep_one_of_each`` goes on from there: it also links texts whose sets of five-word shingles are alike by 0.8 or
more, exactly, and keeps one row of each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textkernel as K

BITS, DISTANCE, WORDS = 64, 2, 3
#: First bit and length of the thirds.
THIRDS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a node as handed out; beyond HOT_NODE it is split by DEEPER bits, down to DEEPEST. Pairs of a leaf.
NODE, HOT_NODE, DEEPER, DEEPEST, LEAF = 4096, 50_000, 8, 48, 8
#: Words of a shingle of keep_one_of_each. Of the shingles' counts over all documents only the order depends.
COPY_WORDS = 5
#: Shingles below this hash are counted: prefixes are mostly cut from there. How many of the most frequent are put last, and from which count.
COUNTED, LAST, OFTEN = 1 << 46, 200_000, 8
#: Rows of one key that are compared with one another in one group.
BLOCK_ROWS = 1000
#: Ids, and keys of dropped rows, that may be sent to every executor; beyond, tables are joined.
BROADCAST_IDS, BROADCAST_ROWS = 2_000_000, 500_000
_LANES = np.uint64(0x0101010101010101)


def _fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits of each row's hashes: byte lanes added up to 255 at a time, then by row."""
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    stops = np.cumsum(counts)
    begins = stops - counts
    cuts = np.unique(np.concatenate([begins[counts > 0], *(np.arange(b, e, 255) for b, e in zip(begins[counts > 255], stops[counts > 255]))]))
    rows = np.flatnonzero(counts > 0)
    of_row = np.searchsorted(cuts, begins[rows])
    half = counts[rows]
    for lane in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(lane)) & _LANES, cuts)
        for byte in range(8):
            ones = np.add.reduceat((packed >> np.uint64(8 * byte)) & np.uint64(255), of_row)
            out[rows] |= (2 * ones.astype(np.int64) > half).astype(np.uint64) << np.uint64(lane + 8 * byte)
    return out


def fingerprints(texts: list[bytes], width: int = WORDS) -> np.ndarray:
    """Unsigned fingerprints of whole texts: majority bits of XXH64 (seed 42) over word shingles, repeats included."""
    hashes, counts, digest = [], [], xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()
        if len(words) <= width:
            own = [digest(b" ".join(words), 42)] if words else []
        else:
            whole = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(lengths) - 1
            own = [digest(whole[a:b], 42) for a, b in zip((ends - lengths + 1).tolist(), ends[width - 1 :].tolist())]
        hashes.append(np.array(own, np.uint64))
        counts.append(len(own))
    return _fold(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(counts, np.int64))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = K.column_bytes(batch.column(1))
        for i, j in K.pieces(off):
            raw = data[off[i] : off[j]].tobytes()
            own = (off[i : j + 1] - off[i]).tolist()
            prints = fingerprints([raw[a:b] for a, b in zip(own, own[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


class Walk:
    """The trie over sorted distinct values, walked with itself (or one node with another) under an error budget.

    A node is a span of the sorted array. ``visited`` and ``pruned`` count pairs of nodes, ``compared`` pairs of
    values that were compared in leaves.
    """

    def __init__(self, values: np.ndarray, budget: int = DISTANCE, alike: int = 0):
        self.values, self.budget = values, budget
        #: Bits from the top that may not differ.
        self.alike = alike
        self.visited = self.pruned = self.compared = 0

    def _middle(self, a: np.ndarray, bit: int) -> np.ndarray:
        """Where, in the node that begins at ``a``, the values begin that have the bit."""
        path = self.values[a] >> np.uint64(bit) | np.uint64(1)
        return np.searchsorted(self.values, path << np.uint64(bit))

    def _leaves(self, a, b, c, d) -> tuple[np.ndarray, np.ndarray]:
        wide = d - c
        count = (b - a) * wide
        which = np.repeat(np.arange(len(a)), count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        i, j = a[which] + at // wide[which], c[which] + at % wide[which]
        keep = i < j
        i, j = i[keep], j[keep]
        self.compared += len(i)
        apart = self.values[i] ^ self.values[j]
        good = np.bitwise_count(apart) <= self.budget
        if self.alike:
            good &= apart >> np.uint64(BITS - self.alike) == 0
        return i[good], j[good]

    def links(self, depth: int = 0, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j), i < j, of all linked values. With ``split``, only those that are linked across that place.

        All values share their ``depth`` first bits; with ``split``, those on either side of it do.
        """
        n, found = len(self.values), []
        ends = [0, n, 0, n] if split is None else [0, split, split, n]
        a, b, c, d = (np.array([x]) for x in ends)
        used = np.zeros(1, np.int64)
        if split is not None and depth and 0 < split < n:
            used[0] = int(np.bitwise_count((self.values[0] ^ self.values[-1]) >> np.uint64(BITS - depth)))
        for bit in range(BITS - 1 - depth, -1, -1):
            same = (a == c) & (b == d)
            alive = np.where(same, b - a > 1, (b > a) & (d > c))
            a, b, c, d, used = (x[alive] for x in (a, b, c, d, used))
            self.visited += len(a)
            small = (b - a) * (d - c) <= LEAF
            if small.any():
                found.append(self._leaves(a[small], b[small], c[small], d[small]))
                a, b, c, d, used = (x[~small] for x in (a, b, c, d, used))
            if not len(a):
                break
            same = (a == c) & (b == d)
            m = np.clip(self._middle(a, bit), a, b)
            k = np.where(same, m, np.clip(self._middle(c, bit), c, d))
            steps = [(a, m, c, k, used), (m, b, k, d, used)]
            may = (used < self.budget) if bit < BITS - self.alike else np.zeros(len(a), bool)
            self.pruned += int(np.count_nonzero(~may))
            steps.append((a[may], m[may], k[may], d[may], used[may] + 1))
            may &= ~same
            steps.append((m[may], b[may], c[may], k[may], used[may] + 1))
            a, b, c, d, used = (np.concatenate(x) for x in zip(*steps))
        else:
            found.append(self._leaves(a, b, c, d))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def trie_join(values: np.ndarray, budget: int, bit: int, join) -> None:
    """Call ``join(i, j)``, i < j, for all pairs of the sorted ``values`` at most ``budget`` bits apart; all are alike above ``bit``."""
    for i, j in zip(*(x.tolist() for x in Walk(values, budget).links(BITS - 1 - bit))):
        join(i, j)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (place, smallest place of its group) of the groups that links among ``n`` places make."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
        if np.array_equal(before, least):
            break
    moved = np.flatnonzero(least != np.arange(n))
    return moved, least[moved]


def _turn(values: np.ndarray, by: int) -> np.ndarray:
    """64-bit values turned left by so many bits."""
    return values << np.uint64(by) | values >> np.uint64(BITS - by) if by % BITS else values


def _node_links(keys: list[int], turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one task's node, or pair of nodes, as pairs of fingerprints."""
    third, depth, lo, hi = keys
    first, size = THIRDS[third]
    values = np.sort(turned)
    split = None if lo == hi else int(np.searchsorted(values, np.uint64(hi) << np.uint64(BITS - depth)))
    a, b = _forest(len(values), *Walk(values, DISTANCE, size).links(depth, split))
    return _turn(values[a], BITS - first), _turn(values[b], BITS - first)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (third, depth, lo, hi): walk each node, or pair of nodes. Only the node at hand is held."""
    held: list[np.ndarray] = []
    own: list[int] = []

    def done() -> Iterator[pa.RecordBatch]:
        values = np.concatenate(held).view(np.uint64)
        if len(values) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in _node_links(own, values)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        bounds = [0, *(np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1).tolist(), len(rows)]
        for x, y in zip(bounds, bounds[1:]):
            keys = rows[x, :4].tolist()
            if held and keys != own:
                yield from done()
                held.clear()
            own = keys
            held.append(np.ascontiguousarray(rows[x:y, 4]))
    if held:
        yield from done()


_KEYS = ("third", "depth", "lo", "hi")


def _shift(value, by):
    """Unsigned shift to the right by 64 bits at most."""
    return F.when(by < BITS, F.call_function("shiftrightunsigned", value, by)).otherwise(F.lit(0).cast("long"))


def _split(rows: DataFrame) -> DataFrame:
    """Nodes, or pairs of nodes, taken ``DEEPER`` bits down: each fingerprint goes to the pairs that may still be linked."""
    few = sorted(range(1 << DEEPER), key=lambda x: (x.bit_count(), x))
    masks = F.array(*(F.lit(x) for x in few if x.bit_count() <= DISTANCE))
    used = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi")))
    sizes = F.element_at(F.array(*(F.lit(size) for _, size in THIRDS)), F.col("third").cast("int") + 1)
    fixed = F.greatest(F.lit(0), F.least(F.lit(DEEPER), sizes - F.col("depth")))
    own, next_ = _shift(F.col("turned"), F.lit(BITS) - F.col("depth")), _shift(F.col("turned"), F.lit(BITS - DEEPER) - F.col("depth"))
    other = F.when(F.col("lo") == F.col("hi"), own).when(own == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    may = rows.select("third", "depth", "turned", next_.alias("next"), other.alias("other"), F.filter(masks, lambda x: (F.bit_count(x) + used <= DISTANCE) & (x < F.call_function("shiftleft", F.lit(1), F.lit(DEEPER) - fixed))).alias("masks"))
    may = may.select("third", "depth", "turned", "next", "other", F.explode("masks").alias("mask"))
    partner = F.shiftleft("other", DEEPER).bitwiseOR(F.col("next").bitwiseAND(F.lit((1 << DEEPER) - 1).cast("long")).bitwiseXOR(F.col("mask").cast("long")))
    return may.select("third", (F.col("depth") + DEEPER).cast("int").alias("depth"), F.least("next", partner).alias("lo"), F.greatest("next", partner).alias("hi"), "turned")


def links(prints: DataFrame, hot: int = HOT_NODE, node: int = NODE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` of ``prints`` exactly as links of two bits or less do."""
    depth = min(min(size for _, size in THIRDS), max(0, (prints.count() // node).bit_length()))
    turn = lambda at: F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", BITS - at)) if at else F.col("fp")
    turned = F.explode(F.array(*(F.struct(F.lit(k).alias("third"), turn(at).alias("turned")) for k, (at, _) in enumerate(THIRDS))))
    path = F.shiftrightunsigned("turned", BITS - depth) if depth else F.lit(0).cast("long")
    rows = prints.select(turned.alias("x")).select("x.*").select(F.col("third").cast("int").alias("third"), F.lit(depth).alias("depth"), path.alias("lo"), path.alias("hi"), "turned")
    rows = C.materialise(rows, "nodes")
    while depth + DEEPER <= DEEPEST:
        big = C.materialise(rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).drop("n"), "hot")
        if big.isEmpty():
            break
        # a hot node is cut by its rows' own bits, so they meet it in many places
        spread = rows.withColumn("_spread", C.spread_of(F.col("turned")))
        marked = C.lookup(spread, _KEYS, big.withColumn("_hot", F.lit(True)), "_spread").drop("_spread")
        calm = marked.where("_hot is null").drop("_hot")
        rows = C.materialise(calm.unionByName(_split(marked.where("_hot"))), "nodes")
        depth += DEEPER
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS).select(*(F.col(k).cast("long").alias(k) for k in _KEYS), "turned").mapInArrow(C.lean(_walk), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of ``edges`` (a, b) reaches, by alternating large and small stars.

    A vertex with very many neighbours meets its smallest one in ``SPREAD`` places.
    """
    edges = C.materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = C.lookup(both.withColumn("_spread", C.spread_of(F.col("v"))), ["u"], least, "_spread")
        large = C.materialise(met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = C.lookup(large.withColumn("_spread", C.spread_of(F.col("b"))), ["a"], least, "_spread")
        ends = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        edges = C.materialise(met.select(ends.alias("e")).select("e.*").where("a <> b").distinct(), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()


def near_duplicates(docs: DataFrame, hot: int = HOT_NODE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text; further columns are ignored).

    Null and blank texts have fingerprint zero and are linked like any other. A row without doc_id takes part, and
    can't be a component's id; a component of such rows alone has a null id. Repeated rows come back as often as
    they came. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    C.tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(C.lean(_fingerprint_batches), "doc_id long, fp long")
    rows = C.materialise(rows, "prints").withColumn("_spread", C.spread_of(F.col("doc_id"), F.lit(1)))
    prints = C.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(prints.select("fp"), hot))
    rooted = C.materialise(prints.join(roots, prints.fp == roots.v, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = C.lookup(rooted.withColumn("_spread", C.spread_of(F.col("fp"))), ["root"], least, "_spread").select("fp", "component_id")
    return C.lookup(rows, ["fp"], table, "_spread").select("doc_id", "fp", "component_id")


def _shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct hashes (48 bits, ascending) of its shingles of COPY_WORDS lower-cased words; a shorter text is one shingle."""
    data = K.LOWER[data]
    starts, ends, first = K.word_bounds(data, off, K.SOLID)
    words = K.word_hashes(data, starts, ends)
    grams = {k: K.gram_hashes(words, k) + np.uint64(k) >> np.uint64(16) for k in range(1, COPY_WORDS + 1)}
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        n = b - a
        out.append(np.unique(grams[COPY_WORDS][a : b - COPY_WORDS + 1]) if n >= COPY_WORDS else grams[n][a : a + 1] if n else words[:0])
    return out


def _packed(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *sets]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    ends = 6 * np.cumsum([0, *map(len, sets)])
    return pa.Array.from_buffers(pa.large_binary(), len(sets), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of packed sets, and where each row's begin (one more at the end)."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").reshape(-1), (ends - ends[0]) // 6


def _parity(own: np.ndarray) -> bytes:
    """Whether an odd number of the set's hashes falls on each of 2**k bits, at least as many bits as hashes (64 at least)."""
    bits = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _marks(width: int, sets: bool):
    """(k1, k2, doc_id, text) to (k1, k2, doc_id, fp, sh, n, p, s): fingerprint, the set's own hash and size, its parities, and the packed set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.column_bytes(batch.column(3))
            for i, j in K.pieces(off, K.CHUNK // 4):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                raw, cut = part.tobytes(), at.tolist()
                prints = fingerprints([raw[a:b] for a, b in zip(cut, cut[1:])], width)
                own = _shingle_sets(part, at) if sets else [np.zeros(0, np.uint64)] * (j - i)
                names = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in own], np.uint64) if sets else prints
                kept = [batch.column(k).slice(i, j - i) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(prints.view(np.int64)), pa.array(names.view(np.int64)), pa.array(list(map(len, own)), pa.int32()), pa.array(list(map(_parity, own)), pa.binary()), _packed(own)], ["k1", "k2", "doc_id", "fp", "sh", "n", "p", "s"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, _ = _unpacked(batch.column(0))
        keys, counts = np.unique(flat[flat < COUNTED], return_counts=True)
        for at in range(0, len(keys), C.ARROW_ROWS * 16):
            few = slice(at, at + C.ARROW_ROWS * 16)
            yield pa.RecordBatch.from_arrays([pa.array(keys[few].astype(np.int64)), pa.array(counts[few])], ["key", "c"])


def _prefixes(often: np.ndarray, ranks: np.ndarray):
    """(sh, s) to (key, sh, n): the first n - ceil(0.8 n) + 1 shingles of each set, in the order of ``ranks`` (0 where not in ``often``) and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            flat, first = _unpacked(batch.column(1))
            place = np.minimum(np.searchsorted(often, flat), max(len(often) - 1, 0))
            rank = np.where(often[place] == flat, ranks[place], 0) if len(often) else np.zeros(len(flat), np.int64)
            keys, names, sizes, lengths = [], [], [], []
            if len(seen) > 1_000_000:  # copies of one set are only fewer rows, so they may be forgotten
                seen.clear()
            for sh, a, b in zip(batch.column(0).to_pylist(), first.tolist(), first[1:].tolist()):
                if a == b or sh in seen:
                    continue
                seen.add(sh)
                n = b - a
                most = n - (4 * n + 4) // 5 + 1
                own = flat[a:b]
                if rank[a:b].any():
                    own = own[np.lexsort((own, rank[a:b]))]
                keys.append(own[:most])
                names.append(sh)
                sizes.append(n)
                lengths.append(most)
            key = np.concatenate([np.zeros(0, np.uint64), *keys]).astype(np.int64)
            name, size = np.repeat(np.array(names, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths)
            for at in range(0, len(key), C.ARROW_ROWS * 16):
                few = slice(at, at + C.ARROW_ROWS * 16)
                yield pa.RecordBatch.from_arrays([pa.array(key[few]), pa.array(name[few]), pa.array(size[few])], ["key", "sh", "n"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sh, n) sorted by key and sh: those whose key another set has too, with the key's first set (sh, n). One row is held."""
    names = ["key", "sh", "n", "first", "first_n"]
    held = np.zeros((0, 6), np.int64)  # key, sh, n, first, first_n, whether the row before has its key

    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k].astype(np.int32 if k in (2, 4) else np.int64)) for k in range(5)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.zeros((batch.num_rows, 6), np.int64)
        for k in range(3):
            rows[:, k] = batch.column(k).to_numpy(zero_copy_only=False)
        rows[:, 3:5] = rows[:, 1:3]
        rows = np.concatenate([held, rows])
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
        again = np.concatenate([[False], rows[1:, 0] == rows[:-1, 0]])
        begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(rows))))
        rows[:, 3:5] = rows[begin, 3:5]
        rows[1:, 5] = again[1:]
        good = rows[:, 5] != 0
        good[:-1] |= again[1:]
        yield out(rows[:-1][good[:-1]])
        held = rows[-1:]
    if len(held) and held[0, 5]:
        yield out(held)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb): the pairs whose sets are alike by 0.8 or more."""
    for batch in batches:
        x, xs = _unpacked(batch.column(2))
        y, ys = _unpacked(batch.column(3))
        good = [9 * len(np.intersect1d(x[i:j], y[k:m], True)) >= 4 * (j - i + m - k) for i, j, k, m in zip(xs.tolist(), xs[1:].tolist(), ys.tolist(), ys[1:].tolist())]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _perhaps_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, pa, pb): the pairs that may be alike. Sets whose parities differ in d bits differ in d hashes at least; alike ones in a ninth of both sizes at most."""
    for batch in batches:
        good = []
        for na, nb, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
            x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
            while len(y) > len(x):  # bit i of the shorter is bits i, i + size, ... of the longer
                y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
            good.append(9 * int(np.bitwise_count(x ^ y).sum()) <= na + nb)
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with columns of ``table`` (sh, ...) for either side. A set that many pairs name meets them in ``SPREAD`` places."""
    for side, other in (("a", "b"), ("b", "a")):
        own = table.select(F.col("sh").alias(side), *(F.col(c).alias(c + side) for c in columns))
        pairs = C.lookup(pairs.withColumn("_spread", C.spread_of(F.col(other))), [side], own, "_spread").drop("_spread")
    return pairs.select("a", "b", *(c + side for c in columns for side in "ab"))


def _of(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (sh, ...) of these ids (sh), one for each."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.select("sh", *columns).join(few, "sh", "left_semi").groupBy("sh").agg(*(F.first(c).alias(c) for c in columns))


def _verified(pairs: DataFrame, parities: DataFrame, rows: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are alike: parities (sh, n, p) turn most strangers away before sets are fetched."""
    may = C.materialise(_both(pairs, parities, "n", "p").mapInArrow(C.lean(_perhaps_alike), "a long, b long"), "may")
    ids = C.materialise(may.select(F.explode(F.array("a", "b")).alias("sh")).distinct(), "ids")
    sets = C.materialise(_of(rows, ids, "s"), "sets")
    return C.materialise(_both(may, sets, "s").mapInArrow(C.lean(_alike), "a long, b long"), "alike")


def similar(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (a, b) that, with the edges ``known``, connect the sets (sh, n, p, s) of ``rows`` as all links of 0.8 or more do.

    Exact: of two such sets, ordered alike, the first n - ceil(0.8 n) + 1 shingles share one; the rest is counted out.
    The order puts shingles last that many documents share, by counts over all documents. Each key first links its sets
    to one of them, so that a family of copies is one component before any pairs are made; then the sets of a key are
    compared across components alone, ``BLOCK_ROWS`` against as many.
    """
    counts = rows.select("s").mapInArrow(C.lean(_counted), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN)
    found = counts.orderBy(F.desc("c"), "key").limit(LAST).toArrow()
    often, c = (found.column(k).to_numpy().astype(np.int64) for k in range(2))
    order = np.argsort(often)
    often, ranks = often[order].astype(np.uint64), np.array([int(x).bit_length() for x in c[order]], np.int64)
    keys = rows.select("sh", "s").mapInArrow(C.lean(_prefixes(often, ranks)), "key long, sh long, n int")
    shared = keys.repartition("key").sortWithinPartitions("key", "sh").mapInArrow(C.lean(_shared), "key long, sh long, n int, first long, first_n int")
    shared = C.materialise(shared, "shared")
    close = lambda a, b: 5 * F.least(a, b) >= 4 * F.greatest(a, b)
    ids = C.materialise(shared.select("sh").distinct(), "ids")
    parities = C.materialise(_of(rows, ids, "n", "p"), "parities")
    pairs = shared.where(F.col("sh") != F.col("first")).where(close("n", "first_n")).select(F.greatest("sh", "first").alias("a"), F.least("sh", "first").alias("b")).distinct()
    edges = known.unionByName(_verified(pairs, parities, rows))

    roots = components(edges)
    placed = C.lookup(shared.withColumn("_spread", C.spread_of(F.col("key"))), ["sh"], roots.toDF("sh", "root"), "_spread")
    placed = C.materialise(placed.select("key", "sh", "n", F.coalesce("root", "sh").alias("root")), "placed")
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key", "m")
    apart = C.lookup(placed.withColumn("_spread", C.spread_of(F.col("sh"))), ["key"], mixed, "_spread").where("m is not null")
    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    apart = apart.withColumn("block", F.pmod(F.xxhash64("sh"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    apart = C.materialise(apart.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sh", "n", "root"), "apart")
    left, right = (apart.select("key", "lo", "hi", *(F.col(x).alias(x + k) for x in ("block", "sh", "n", "root"))) for k in "ab")
    met = left.join(right, ["key", "lo", "hi"]).where("sha > shb and roota <> rootb and (lo = hi or blocka <> blockb)").where(close("na", "nb"))
    met = C.materialise(met.select(F.col("sha").alias("a"), F.col("shb").alias("b")).distinct(), "met")
    return edges.unionByName(_verified(met, parities, rows))


def _keep(docs: DataFrame, width: int, alike: bool) -> DataFrame:
    spark = docs.sparkSession
    C.tune(spark)
    k1, k2 = C.row_keys(docs)
    plain = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = C.materialise(plain.mapInArrow(C.lean(_marks(width, alike)), "k1 long, k2 long, doc_id long, fp long, sh long, n int, p binary, s binary"), "marks")
    # one set stands for all of a fingerprint; linked fingerprints link those
    prints = C.materialise(rows.groupBy("fp").agg(F.min("sh").alias("m")), "prints")
    spread = rows.select("fp", "sh").distinct().withColumn("_spread", C.spread_of(F.col("sh")))
    same = C.lookup(spread, ["fp"], prints, "_spread").select(F.col("sh").alias("a"), F.col("m").alias("b"))
    near = links(prints.select("fp")).join(prints.toDF("a", "ma"), "a").join(prints.toDF("b", "mb"), "b").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
    edges = C.materialise(same.unionByName(near).where("a <> b").distinct(), "known")
    if alike:
        edges = similar(rows, edges)
    roots = components(edges).toDF("sh", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    first = C.materialise(rows.groupBy("sh").agg(F.min(order).alias("w"), F.count(F.lit(1)).alias("c")), "first")
    best = first.join(roots, "sh", "left").groupBy(F.coalesce("root", "sh").alias("g")).agg(F.min("w").alias("w"))
    a, b = C.fresh(docs, "k1", "k2")
    best = C.materialise(best.select(F.col("w.k1").alias(a), F.col("w.k2").alias(b)), "best")
    keyed, dropped = docs.withColumns({a: k1, b: k2}), rows.select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct().join(best, [a, b], "left_anti")
    dropped = C.materialise(dropped, "dropped")
    # few dropped rows are known everywhere, and no text moves
    kept = keyed.join(F.broadcast(dropped), [a, b], "left_anti") if dropped.count() <= BROADCAST_ROWS else keyed.join(best, [a, b], "left_semi")
    if not rows.groupBy("k1", "k2").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([a, b])  # rows alike in every column: any of them will do
    return kept.select(*C.named(docs))


def keep_representatives(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """One row of each component of linked fingerprints of ``docs`` (doc_id, text, any further columns).

    The row with the smallest doc_id stays, one without doc_id only where no row of the component has one. Ties are
    cut by a hash of all columns, so reruns agree; of rows alike in every column one stays. An empty table gives an
    empty one. Null and blank texts are one component.
    """
    return _keep(docs, width, False)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group that is connected by fingerprints (of five-word shingles) within two bits, or by sets of five-word shingles alike by 0.8 or more.

    Which row stays, nulls, ties and empty tables: as in :func:`keep_representatives`. Two different sets of one
    64-bit hash would count as one: of 20 billion texts some ten pairs.
    """
    return _keep(docs, COPY_WORDS, True)
