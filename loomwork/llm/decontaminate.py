"""Benchmark decontamination by winnowing.

Documents and items keep the smallest ``K``-gram hash of every ``SPAN`` neighbouring K-grams. A run of
K + SPAN - 1 = ``WINDOW`` words has the same smallest hash wherever it stands, so every shared window shares a kept
fingerprint. Hits are extended to the whole window and compared word by word. Items of fewer words are one window
of their own length, kept as they are.

Where the windows of the benchmark are few (``BROADCAST_WINDOWS``, a checked count) they go to every worker; beyond
that fingerprints are joined as tables. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textkernel as K

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
BROADCAST_WINDOWS = 200_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def winnow(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the kept grams: the smallest hash of every SPAN grams that lie within one row's words."""
    n = len(grams) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    two = np.minimum(grams[:-1], grams[1:])
    four = np.minimum(two[:-2], two[2:])
    least = np.minimum(four[:n], two[SPAN - 2 : SPAN - 2 + n])
    whole = _within(n, first, WINDOW)
    kept = np.zeros(len(grams), bool)
    for d in range(SPAN):
        kept[d : d + n] |= whole & (grams[d : d + n] == least)
    return np.flatnonzero(kept)


def _within(n: int, first: np.ndarray, length: int) -> np.ndarray:
    """Which of the first n places begin ``length`` words of one row."""
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    return left >= length


class Piece:
    """Some rows' words: lower-cased bytes, bounds, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = K.LOWER[data]
        self.starts, self.ends, self.first = K.word_bounds(self.data, offsets, K.WORD)
        self.hashes = K.word_hashes(self.data, self.starts, self.ends)

    def kept(self, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window length, places, fingerprints): winnowed grams for full windows, whole windows for short items."""
        for length in lengths:
            if length == WINDOW:
                grams = K.gram_hashes(self.hashes, GRAM)
                at = winnow(grams, self.first)
            else:
                grams = K.gram_hashes(self.hashes, length)
                at = np.flatnonzero(_within(len(grams), self.first, length))
            yield length, at, grams[at] + np.uint64(length)

    def starts_of(self, length: int, at: np.ndarray) -> np.ndarray:
        """Places of the windows around fingerprints, each once."""
        if length < WINDOW:
            return np.unique(at)
        around = np.unique((at[:, None] - np.arange(SPAN)).ravel())
        around = around[around >= 0]
        if not len(around):
            return around
        row = np.searchsorted(self.first, around, "right")
        near = around + WINDOW <= self.first[row]
        return around[near]

    def window(self, at: int, length: int) -> bytes:
        s, e = self.starts, self.ends
        raw = self.data[s[at] : e[at + length - 1]].tobytes()
        return b" ".join(raw[a - s[at] : b - s[at]] for a, b in zip(s[at : at + length].tolist(), e[at : at + length].tolist()))


def _result(rows, doc_ids, spans: dict[int, list[tuple[int, int]]], items: dict[int, set[str]], counts: np.ndarray) -> pa.RecordBatch:
    n = len(doc_ids)
    hit, number, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), [hashlib.sha256(b"").hexdigest()] * n
    for row, own in spans.items():
        end = 0
        for a, length in sorted(own):
            hit[row] += max(0, a + length - max(a, end))
            end = max(end, a + length)
    for row, own in items.items():
        number[row] = len(own)
        digest[row] = hashlib.sha256(",".join(sorted(own, key=lambda s: s.encode())).encode()).hexdigest()
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), pa.array(hit), pa.array(number), pa.array(digest), pa.array(hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Bench:
    """The benchmark's windows, and a bitmap of their fingerprints."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.lengths: dict[int, None] = {}
        self.items: dict[bytes, list[str]] = defaultdict(list)
        kept: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in rows:
            raw = np.frombuffer(text, np.uint8)
            piece = Piece(raw, np.array([0, len(raw)]))
            n = len(piece.starts)
            if not n:
                continue
            length = min(n, WINDOW)
            self.lengths[length] = None
            for window in {piece.window(i, length) for i in range(n - length + 1)}:
                self.items[window].append(item)
            for _, _, prints in piece.kept([length]):
                kept[length].append(prints)
        self.prints = {k: np.unique(np.concatenate(v)) for k, v in kept.items()}
        self.bitmap = {}
        for k, v in self.prints.items():
            self.bitmap[k] = np.zeros(1 << 20, bool)
            self.bitmap[k][(v & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, length: int, prints: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bitmap[length][(prints & np.uint64((1 << 20) - 1)).astype(np.int64)])
        return maybe[np.isin(prints[maybe], self.prints[length])]


def _scan(bench: Bench):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.column_bytes(batch.column(1))
            for i, j in K.pieces(off):
                piece = Piece(data[off[i] : off[j]], off[i : j + 1] - off[i])
                spans, items = defaultdict(list), defaultdict(set)
                for length, at, prints in piece.kept(list(bench.lengths)):
                    for start in piece.starts_of(length, at[bench.hits(length, prints)]).tolist():
                        if found := bench.items.get(piece.window(start, length)):
                            row = int(np.searchsorted(piece.first, start, "right")) - 1
                            spans[row].append((start, length))
                            items[row].update(found)
                yield _result(None, batch.column(0).slice(i, j - i), spans, items, np.diff(piece.first))

    return scan


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the items: (item_id, length, words)."""
    for batch in batches:
        data, off = K.column_bytes(batch.column(1))
        ids, lengths, words = [], [], []
        for row, item in enumerate(batch.column(0).to_pylist()):
            piece = Piece(data[off[row] : off[row + 1]], np.array([0, off[row + 1] - off[row]]))
            if n := len(piece.starts):
                length = min(n, WINDOW)
                own = {piece.window(k, length) for k in range(n - length + 1)}
                ids += [item] * len(own)
                lengths += [length] * len(own)
                words += [w.decode("utf-8", "replace") for w in own]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lengths, pa.int32()), pa.array(words, pa.string())], ["item_id", "length", "words"])


def _prints(lengths: list[int], context: bool):
    """Kept fingerprints of rows (key, text); with context also the place and the words of all windows around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.column_bytes(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in K.pieces(off, K.CHUNK // 4):
                piece = Piece(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for length, at, prints in piece.kept(lengths):
                    row = np.searchsorted(piece.first, at, "right") - 1
                    columns = [pa.array(keys[i + row].astype(np.int64)), pa.array(np.full(len(at), length, np.int32)), pa.array(prints.view(np.int64))]
                    names = ["key", "length", "print"]
                    if context:
                        around = SPAN - 1 if length == WINDOW else 0
                        a = np.maximum(at - around, piece.first[row])
                        b = np.minimum(at + (GRAM if length == WINDOW else length) + around, piece.first[row + 1])
                        columns += [pa.array(a - piece.first[row]), pa.array([piece.window(int(x), int(y - x)).decode("utf-8", "replace") for x, y in zip(a, b)], pa.string())]
                        names += ["at", "near"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _by_join(rows: DataFrame, bench: DataFrame, windows: DataFrame) -> DataFrame:
    """The same rows where the benchmark is too large to send around: joins on fingerprints, then on window words."""
    windows = C.materialise(windows, "windows")
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most WINDOW numbers
    rows = C.materialise(rows.withColumn("key", F.monotonically_increasing_id()), "texts")
    known = windows.select(F.monotonically_increasing_id().alias("key"), "words").mapInArrow(_prints(lengths, False), "key long, length int, print long")
    known = known.select("length", "print").distinct()
    own = rows.select("key", "text").mapInArrow(_prints(lengths, True), "key long, length int, print long, at long, near string")
    spread = lambda: C.spread_of(F.col("key"), F.col("at"))
    known = known.withColumn("_known", F.lit(True))
    near = C.lookup(own.withColumn("_spread", spread()), ["length", "print"], known, "_spread").where("_known").drop("_spread", "_known").withColumn("w", F.split("near", " "))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("length"))
    cut = near.where(F.size("w") >= F.col("length")).select("key", "length", "at", "w", F.explode(starts).alias("s"))
    cut = cut.select("key", "length", (F.col("at") + F.col("s")).alias("at"), F.array_join(F.slice("w", F.col("s") + 1, F.col("length")), " ").alias("words")).distinct()
    items_of = windows.groupBy("length", "words").agg(F.collect_set("item_id").alias("_of"))
    met = C.lookup(cut.withColumn("_spread", spread()), ["length", "words"], items_of, "_spread").where("_of is not null")
    hits = C.materialise(met.select("key", "at", "length", F.explode("_of").alias("item_id")), "hits")
    at = hits.select("key", "at", "length").distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "length"))).alias("spans"))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    add = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(x["at"], s["end"]))).cast("long").alias("n"), F.greatest(s["end"], x["at"] + x["length"]).cast("long").alias("end"))
    spans = at.select("key", F.aggregate("spans", begin, add)["n"].alias("n_hit"))
    items = hits.select("key", "item_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("_items"))
    plain = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower()), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    count = F.size(F.filter(F.split(plain, " "), lambda x: x != ""))
    out = rows.withColumn("n_words", count.cast("long")).select("key", "doc_id", "n_words").join(spans, "key", "left").join(items, "key", "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("_items", F.lit("")), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _small(items: DataFrame, most: int) -> Bench | None:
    """The benchmark's windows, if a count shows that they are ``most`` at most."""
    size = items.agg(F.sum(F.octet_length("text") / 2), F.count(F.lit(1))).first()
    if (size[0] or 0) <= most * 8 and size[1] <= most and items.mapInArrow(C.lean(_windows), "item_id string, length int, words string").count() <= most:
        return Bench([(r.item_id, r.text.encode()) for r in items.collect()])
    return None


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs`` (doc_id, text).

    ``benchmark`` has (item_id, text). Null has no words; an item without words hits nothing; items without an id
    are known by the empty one; items that share an id count once. Repeated rows come back as often as they came.
    An empty table on either side gives no rows, or rows without hits.
    """
    C.tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    if bench := _small(items, most):
        return rows.mapInArrow(_scan(bench), _SCHEMA)
    return _by_join(rows, items, items.mapInArrow(_windows, "item_id string, length int, words string"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark window, with all their columns, whatever their names.

    Rows with null or empty texts stay, repeated rows stay or go together, an empty benchmark lets all stay, and an
    empty table gives an empty one.
    """
    C.tune(docs.sparkSession)
    items = _items(benchmark)
    if bench := _small(items, most):
        place, scan = docs.columns.index("text"), _scan(bench)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(place)
                seen = scan(iter([pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text], ["doc_id", "text"])]))
                hit = pa.concat_arrays([x.column(5) for x in seen]) if len(text) else pa.array([], pa.bool_())
                yield batch.filter(pc.invert(hit))

        return C.batches_of(docs, clean)
    (row,) = C.fresh(docs, "_row")
    carried = C.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "carried")
    marked = _by_join(carried.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text")), items, items.mapInArrow(_windows, "item_id string, length int, words string"))
    clean = marked.where(~F.col("contaminated")).select(F.col("doc_id").alias(row))
    return carried.join(clean, row, "left_semi").select(*C.named(docs))
