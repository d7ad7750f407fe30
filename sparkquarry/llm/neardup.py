"""Near-duplicate texts: an exact similarity join on sets of word n-grams.

Method: prefix-tree join. The n-grams of all texts have one global order, rare ones first.
Ordered sets that may be alike are brought together in blocks; the sets of a block are
stored in one trie, which is traversed with each set in turn: sets with a common beginning
share the overlap counted so far, and a subtree is given up when even all that remains
can't reach the threshold. Every row of the result comes out of a trie. Which sets share a
block is told by their prefixes: sets alike enough share n-grams among their first ones,
under bounds of position and length, and a set lies in the block of its least relation, so
a family of many near copies is one block to which each text is sent once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import materialize
from .common import MOST_TASKS

WORDS, LEAST_WORDS, THRESHOLD = 3, 20, 0.6
#: Bits of the frequency sketch's cells: enough for SKETCH_PER_ROW cells a row, within these bounds. All n-grams of all
#: texts are counted in it, whatever its size; a coarser order only costs time.
SKETCH_BITS, SKETCH_PER_ROW = (16, 24), 16
SLICES = 32
#: N-grams that occur about so often, by the sketch, are common: pairs of texts are met by them only where their
#: common n-grams alone could make them alike.
COMMON = 2_000
#: N-grams that two texts must share in their prefixes, which are longer by as many; one can be shared by chance.
MEETINGS = 4
#: Sets that are stored in one trie; larger blocks are split by the halves of their pairs.
PARTNERS = 2000
#: N-grams that occur more often, by the sketch, are spread over several buckets, pair of shares by pair of shares.
HOT = 8_000
#: Load of the sketch's cells up to which counts are taken as they are; above it the mean load is noise and taken off.
LOAD = 64
#: Texts for each bucket of prefixes; a task holds the prefixes of one bucket.
ROWS_PER_BUCKET = 15_000
#: Characters and texts worked on at once.
BLOCK, BLOCK_TEXTS = 1 << 22, 8_000
#: Bits of an n-gram's fingerprint and of its level of frequency; with the number of a text of a block they make one sort key.
GRAM_BITS, LEVEL_BITS = 44, 6
#: Words whose fingerprints a worker remembers.
REMEMBERED = 1 << 20

U = np.uint64
#: Words are maximal runs of letters and digits of the lower-cased text.
_words = re.compile(r"[^\W_]+").findall


class _Fingerprints(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


_prints = _Fingerprints()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def gram_sets(texts: list[str | None], words: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, its begin in the grams, grams): the distinct n-grams of each text with
    at least ``least_words`` words, ascending within a text; begins has one entry more."""
    found = [_words(t.lower()) if t else [] for t in texts]
    index = np.array([i for i, w in enumerate(found) if len(w) >= max(least_words, words)], np.int64)
    sizes = np.array([len(found[i]) for i in index], np.int64)
    flat = np.fromiter(map(_prints.__getitem__, chain.from_iterable(found[i] for i in index)), U, int(sizes.sum()))
    if not len(flat):
        return index, np.zeros(1, np.int64), flat
    grams = flat[: len(flat) - words + 1] * U(0x9E3779B97F4A7C15)
    for k in range(1, words):
        grams = (grams ^ (grams >> U(29))) * U(0xBF58476D1CE4E5B9) + flat[k : len(flat) - words + 1 + k] * U(0x9E3779B97F4A7C15)
    grams = _mix(grams) >> U(64 - GRAM_BITS)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(index)), sizes)[: len(grams)]
    inside = np.arange(len(grams)) < ends[doc] - words + 1
    keys = np.sort(doc[inside].astype(U) << U(GRAM_BITS) | grams[inside])
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return index, np.searchsorted(keys, np.arange(len(index) + 1, dtype=U) << U(GRAM_BITS)), keys & U((1 << GRAM_BITS) - 1)


def _set_names(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Name of each set, equal for equal sets."""
    if not len(grams):
        return np.zeros(0, np.int64)
    return _mix(np.add.reduceat(_mix(grams ^ U(0x5851F42D4C957F2D)), begins[:-1]) ^ np.diff(begins).astype(U)).view(np.int64)


def _ordered(grams: np.ndarray, begins: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The grams of each set in global order: by level of frequency, then by value."""
    doc = np.repeat(np.arange(len(begins) - 1, dtype=U), np.diff(begins))
    level = levels[grams >> U(GRAM_BITS + 1 - len(levels).bit_length())].astype(U)
    keys = np.sort(doc << U(GRAM_BITS + LEVEL_BITS) | level << U(GRAM_BITS) | grams)
    return keys & U((1 << GRAM_BITS) - 1)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list]]:
    """Runs of a batch's texts of about BLOCK characters, with the place of the first."""
    texts = batch.column(column).to_pylist()
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > BLOCK or k - begin >= BLOCK_TEXTS:
            yield begin, texts[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


class _Bounds:
    """Integer forms of the threshold: J >= p/q."""

    def __init__(self, threshold: float):
        t = Fraction(str(threshold))
        self.p, self.q = t.numerator, t.denominator

    def overlap(self, total):
        """Least overlap of two sets with ``total`` elements together."""
        return -(-self.p * total // (self.p + self.q))

    def probe(self, n):
        """Prefix in which a set meets MEETINGS times any like one that is not larger."""
        return n - (-(-self.p * n // self.q)) + MEETINGS

    def index(self, n):
        """Prefix in which a set meets MEETINGS times any like one that is not smaller."""
        return n - (-(-2 * self.p * n // (self.p + self.q))) + MEETINGS


class Trie:
    """Ordered sets by their common beginnings, each node with the least and greatest set size below it."""

    __slots__ = ("root", "count")

    def __init__(self) -> None:
        self.root: list = [{}, 1 << 60, 0, []]  # children by gram, least size, greatest size, members that end here
        self.count = 0

    def add(self, grams: list[int], member) -> None:
        node, n = self.root, len(grams)
        for g in grams:
            if n < node[1]:
                node[1] = n
            if n > node[2]:
                node[2] = n
            nxt = node[0].get(g)
            if nxt is None:
                nxt = node[0][g] = [{}, n, n, []]
            node = nxt
        node[3].append((n, member))

    def alike(self, grams: list[int], bounds: _Bounds) -> Iterator:
        """Members whose similarity with the ordered set ``grams`` reaches the threshold."""
        n, p, q = len(grams), bounds.p, bounds.q
        place = {g: i for i, g in enumerate(grams)}
        stack = [(self.root, 0, 0, 0)]  # node, depth, overlap, grams of the set that lie behind
        while stack:
            node, depth, overlap, behind = stack.pop()
            for size, member in node[3]:
                if overlap * (p + q) >= p * (n + size):
                    yield member
            for g, child in node[0].items():
                at = place.get(g)
                if at is None:
                    o, b = overlap, behind
                else:
                    o, b = overlap + 1, at + 1
                rest = child[2] - depth - 1
                if n - b < rest:
                    rest = n - b
                # the smallest set below asks for least, the largest has most left
                if (o + rest) * (p + q) >= p * (n + child[1]):
                    stack.append((child, depth + 1, o, b))


class NearDuplicates:
    """Texts alike by the Jaccard similarity of their word n-gram sets.

    Texts of fewer than ``least_words`` words, null, empty and blank ones take no part, nor
    do rows of a null id. Rows that repeat an id are expected to be equal and count once.
    Texts of equal sets are one set to all steps, however many they are; the threshold
    itself is alike enough. Whole texts are compared; other columns are not read.
    """

    def __init__(self, df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS):
        if not 0 < threshold <= 1 or words < 1:
            raise ValueError("threshold must be in (0, 1] and words at least 1")
        self.id_col, self.words, self.threshold, self.least = id_col, words, threshold, least_words
        self.kind = df.schema[id_col].dataType.simpleString()
        # a word and its separator take two characters, so shorter texts can't have enough
        self.docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= 2 * max(least_words, words) - 1))
        self._members = self._levels = self._links = self._rows = None

    def _first_pass(self) -> None:
        """Names every text's set and counts all n-grams in the sketch."""
        words, least = self.words, self.least
        rows = self._rows = self.docs.select("id").count()
        bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], (SKETCH_PER_ROW * rows).bit_length()))
        cells = 1 << bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(cells, np.uint32)
            for batch in batches:
                for begin, texts in _texts(batch, 1):
                    index, begins, grams = gram_sets(texts, words, least)
                    counts += np.bincount((grams >> U(GRAM_BITS - bits)).astype(np.int64), minlength=cells).astype(np.uint32)
                    m = len(index)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index + begin)), pa.array(_set_names(grams, begins)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["id", "set", "slice", "counts"])
            if counts.any():
                parts = [zlib.compress(p.astype(np.uint16).tobytes(), 1) for p in np.split(np.minimum(counts, 65_535), SLICES)]
                yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, ids), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["id", "set", "slice", "counts"])

        ids = to_arrow_type(self.docs.schema["id"].dataType)
        both = materialize(self.docs.mapInArrow(run, f"id {self.kind}, set long, slice int, counts binary"), "sets")
        self._members = both.filter(F.col("slice").isNull()).select("id", "set").distinct()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    sums.setdefault(k, np.zeros(cells // SLICES, np.uint64))
                    sums[k] += np.frombuffer(zlib.decompress(part), np.uint16)
            # noise is told slice by slice: n-grams are spread over the cells evenly
            levels = [np.ceil(np.log2(np.maximum(s - max(0.0, s.mean() - LOAD), 0) + 1)).astype(np.uint8).tobytes() for s in ((x.astype(float)) for x in sums.values())]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["slice", "levels"])

        rows = both.filter(F.col("slice").isNotNull()).select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, levels binary").collect()
        levels = np.zeros((SLICES, cells // SLICES), np.uint8)
        for row in rows:
            levels[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
        self._levels = self.docs.sparkSession.sparkContext.broadcast(levels.reshape(-1))

    def members(self) -> DataFrame:
        """(id, set): the set of every text that takes part."""
        if self._members is None:
            self._first_pass()
        return self._members

    def candidates(self) -> DataFrame:
        """(a, b), a < b: sets that meet in their prefixes under the bounds of length and position."""
        self.members()
        words, least, levels, bounds = self.words, self.least, self._levels, _Bounds(self.threshold)
        common, hot = int(np.ceil(np.log2(COMMON + 1))), max(1, int(np.ceil(np.log2(HOT + 1))))
        buckets = max(8, -(-self._rows // ROWS_PER_BUCKET))

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in _texts(batch, 0):
                    _, begins, grams = gram_sets(texts, words, least)
                    if not len(grams):
                        continue
                    names, sizes = _set_names(grams, begins), np.diff(begins)
                    grams = _ordered(grams, begins, levels.value)
                    doc = np.repeat(np.arange(len(sizes)), sizes)
                    pos = np.arange(len(grams)) - begins[:-1][doc]
                    level = levels.value[grams >> U(GRAM_BITS + 1 - len(levels.value).bit_length())]
                    rare = np.add.reduceat((level < common).astype(np.int64), begins[:-1])
                    _, once = np.unique(names, return_index=True)
                    mine = np.zeros(len(sizes), bool)
                    mine[once] = True
                    keep = (pos < bounds.probe(sizes)[doc]) & mine[doc]
                    doc, pos, grams = _spread(doc[keep], pos[keep], grams[keep], level[keep], names, hot)
                    bucket = ((grams >> U(20)) % U(buckets)).astype(np.int64)
                    order = np.lexsort((doc, bucket))
                    doc, pos, short, bucket = doc[order], pos[order], (grams[order] & U(0xFFFFFFFF)).astype(np.uint32), bucket[order]
                    edges = np.searchsorted(bucket, np.arange(buckets + 1))
                    rows = []
                    for b in np.flatnonzero(np.diff(edges)):
                        d = doc[edges[b] : edges[b + 1]]
                        used, times = np.unique(d, return_counts=True)
                        rows.append((int(b), names[used].tobytes(), sizes[used].astype(np.uint32).tobytes(), rare[used].astype(np.uint32).tobytes(), short[edges[b] : edges[b + 1]].tobytes(), times.astype(np.uint32).tobytes(), pos[edges[b] : edges[b + 1]].astype(np.uint32).tobytes()))
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "names", "sizes", "rare", "grams", "times", "places"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            for _, group in groupby(rows, lambda row: row[0]):
                parts = [row[1:] for row in group]
                names, sizes, rare, grams, places = [], [], [], [], []
                for nm, sz, ra, gr, times, pl in parts:
                    t = np.frombuffer(times, np.uint32)
                    names.append(np.repeat(np.frombuffer(nm, np.int64), t)), sizes.append(np.repeat(np.frombuffer(sz, np.uint32), t)), rare.append(np.repeat(np.frombuffer(ra, np.uint32), t))
                    grams.append(np.frombuffer(gr, np.uint32)), places.append(np.frombuffer(pl, np.uint32))
                parts.clear()
                for a, b, *numbers in _meetings(*map(np.concatenate, (names, sizes, rare, grams, places)), bounds):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(x, pa.int32()) for x in numbers)], ["a", "b", "need", "least", "n", "rest"])

        blobs = self.docs.select("text").mapInArrow(post, "bucket int, names binary, sizes binary, rare binary, grams binary, times binary, places binary")
        blobs = blobs.repartitionById(min(buckets, MOST_TASKS), F.col("bucket") % MOST_TASKS).sortWithinPartitions("bucket")
        met = blobs.mapInArrow(meet, "a long, b long, need int, least int, n int, rest int")
        pairs = met.groupBy("a", "b").agg(F.max("need").alias("need"), F.max("least").alias("least"), F.sum("n").alias("n"), F.min("rest").alias("rest"))
        # all that is shared before the last meeting was met too; behind it lies at most ``rest``
        return pairs.filter("n >= need AND n + rest >= least").select("a", "b")

    def links(self) -> DataFrame:
        """(a, b), a < b: different sets that are alike enough, each pair once."""
        if self._links is not None:
            return self._links
        pairs = materialize(self.candidates(), "candidates")
        words, levels, bounds = self.words, self._levels, _Bounds(self.threshold)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        block = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("least", "a").alias("block"))
        pairs = pairs.join(block, "a")
        size = pairs.select("block", F.explode(F.array("a", "b")).alias("set")).distinct().groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
        share = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
        placed = pairs.join(size, "block").select("block", share("a").alias("i"), share("b").alias("j"), F.explode(F.array("a", "b")).alias("set")).distinct()
        one = self.members().groupBy("set").agg(F.min("id").alias("id"))
        rows = self.docs.join(placed.join(one, "set"), "id").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "set")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, last, trie = None, None, Trie()
            for batch in batches:
                keys, sets = list(zip(*(batch.column(k).to_pylist() for k in range(3)))), batch.column(3).to_pylist()
                out: list[tuple[int, int]] = []
                for begin, texts in _texts(batch, 4):
                    _, begins, grams = gram_sets(texts, words, 0)
                    grams = _ordered(grams, begins, levels.value)
                    for k in range(len(texts)):
                        if keys[begin + k] != group:
                            group, last, trie = keys[begin + k], None, Trie()
                        own = sets[begin + k]
                        if own == last:  # a repeated row brings the same set again
                            continue
                        mine, last = grams[begins[k] : begins[k + 1]].tolist(), own
                        out += [(min(own, m), max(own, m)) for m in trie.alike(mine, bounds)]
                        trie.add(mine, own)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        self._links = materialize(rows.select("block", "i", "j", "set", "text").mapInArrow(verify, "a long, b long").distinct(), "links")
        return self._links

    def pairs(self) -> DataFrame:
        """(id_a, id_b), the smaller first: all pairs of texts alike enough, copies included."""
        links, a, b = self.links(), f"{self.id_col}_a", f"{self.id_col}_b"
        left = self.members().select(F.col("set").alias("a"), F.col("id").alias("x"))
        right = self.members().select(F.col("set").alias("b"), F.col("id").alias("y"))
        far = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b))
        near = left.join(right, F.col("a") == F.col("b")).filter("x < y").select(F.col("x").alias(a), F.col("y").alias(b))
        return far.unionByName(near)

    def groups(self) -> DataFrame:
        """(id, group_id, links): for every text that takes part its connected group, named by
        the smallest id in it, and the number of other texts it is alike to."""
        members = self.members()
        sizes = members.groupBy("set").agg(F.count(F.lit(1)).alias("copies"))
        both = self.links().unionByName(self.links().select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.join(sizes.withColumnRenamed("set", "b"), "b").groupBy(F.col("a").alias("set")).agg(F.sum("copies").alias("others"))
        roots = connected(self.links())
        rows = members.join(sizes, "set").join(degree, "set", "left").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
        names = rows.groupBy("root").agg(F.min("id").alias("group_id"))
        return rows.join(names, "root").select(F.col("id").alias(self.id_col), "group_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def _spread(doc: np.ndarray, pos: np.ndarray, grams: np.ndarray, level: np.ndarray, names: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings, those of hot grams once for each pair of shares that their set's share is in.

    A gram of 2^k times the hot frequency has 2^k shares of its sets; every two of them, and
    each with itself, meet under a name of their own.
    """
    rows = np.flatnonzero(level > hot)
    if not len(rows):
        return doc, pos, grams
    shares = np.left_shift(1, level[rows].astype(np.int64) - hot)
    own = names.view(U)[doc[rows]] % shares.astype(U)
    rows_, own_ = np.repeat(rows, shares), np.repeat(own.astype(np.int64), shares)
    other = np.arange(len(rows_)) - np.repeat(np.cumsum(shares) - shares, shares)
    pair = np.minimum(own_, other) << 20 | np.maximum(own_, other)
    named = _mix(grams[rows_] ^ (pair.astype(U) + U(1)) << U(GRAM_BITS - 22)) >> U(64 - GRAM_BITS)
    rest = level <= hot
    return np.concatenate([doc[rest], doc[rows_]]), np.concatenate([pos[rest], pos[rows_]]), np.concatenate([grams[rest], named])


def _meetings(names: np.ndarray, sizes: np.ndarray, rare: np.ndarray, grams: np.ndarray, places: np.ndarray, bounds: _Bounds) -> Iterator[tuple]:
    """(a, b, need, least, n, rest): pairs of sets that share ``n`` grams of one bucket within
    the bounds. They must share ``need`` of those that are met, and ``least`` in all; behind
    their last shared gram here lie ``rest`` at most.

    ``rare``: how many grams of a set come before its common ones. A common gram makes two
    sets meet only if the common grams alone can reach ``least``; for other pairs the common
    grams of the prefixes are taken off ``need``.
    """
    order = np.lexsort((names, sizes, grams))
    names, grams = names[order], grams[order]
    sizes, rare, places = (x[order].astype(np.int64) for x in (sizes, rare, places))
    # copies of one set come from several tasks
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (names[1:] != names[:-1])])
    names, sizes, rare, grams, places = names[new], sizes[new], rare[new], grams[new], places[new]
    index, probe = np.minimum(bounds.index(sizes), sizes), np.minimum(bounds.probe(sizes), sizes)
    common = places >= rare
    held: list[tuple] = []
    total, step = 0, 1
    at = np.arange(len(grams))
    while len(at):
        # partners of a gram lie behind in order of size: what fails by gram or size now fails for every further step
        at = at[at + step < len(grams)]
        j = at + step
        least = bounds.overlap(sizes[at] + sizes[j])
        near = (grams[j] == grams[at]) & (sizes[at] * bounds.q >= bounds.p * sizes[j]) & (~common[at] | (least <= sizes[at] - rare[at]))
        at, j, least = at[near], j[near], least[near]
        rest = np.minimum(sizes[at] - places[at], sizes[j] - places[j]) - 1
        alone = np.minimum(sizes[at] - rare[at], sizes[j] - rare[j]) >= least  # the common grams suffice
        ok = (places[at] < index[at]) & (1 + np.minimum(places[at], places[j]) + rest >= least) & (~common[at] | alone)
        x, y = at[ok], j[ok]
        unmet = np.where(alone[ok], 0, np.minimum(np.maximum(index[x] - rare[x], 0), np.maximum(probe[y] - rare[y], 0)))
        need = np.maximum(np.minimum(least[ok], MEETINGS) - unmet, 1)
        held.append((np.minimum(names[x], names[y]), np.maximum(names[x], names[y]), need, least[ok], rest[ok]))
        total += len(x)
        if total > 2_000_000:
            yield _counted(held)
            held, total = [], 0
        step += 1
    if total:
        yield _counted(held)


def _counted(held: list[tuple]) -> tuple:
    x, y, need, least, rest = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((y, x))
    x, y, need, least, rest = x[order], y[order], need[order], least[order], rest[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    return x[first], y[first], need[first], least[first], np.diff(np.concatenate([first, [len(x)]])), np.minimum.reduceat(rest, first)


def connected(edges: DataFrame) -> DataFrame:
    """(set, root): the smallest node of each node's component, by alternating large and small
    stars; every round is written to the shared folder, the rounds grow with the logarithm
    of the longest path."""
    now = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v")))
        down = large.filter("v < u").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("set"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("set"), "root").distinct())
