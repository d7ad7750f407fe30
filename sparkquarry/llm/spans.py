"""Long exact spans that occur in more than one document.

Method: prefix-partitioned suffix trees. Suffixes begin at anchors: in every span of
``length`` characters the gram of ``GRAM`` characters with the least fingerprint, which
depends on the span's characters alone, so equal spans have equal anchors. Anchors whose
gram stands in a single text have no inner node and are given up before any text is moved.
Variable-length prefixes split the other suffixes into groups that fit into memory: the
shortest prefix of a ladder that few enough suffixes share. In each group the suffixes are
sorted, the longest common prefixes of neighbours give the inner nodes of the subtree, and
the occurrences below a node that also agree to the left as far as the node lacks depth are
the maximal repeats. A gram too frequent for a group goes on to a prefix of the whole
length: there a node is a group of equal suffixes, which is formed by a shuffle and not in
one task. Copies of a text are one text to all of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

LENGTH = 200
GRAM = 64
#: Suffixes that may share a prefix before a longer one splits their group.
GROUP_SUFFIXES = 4_000
#: Lengths of the prefixes that split the suffixes, as shares of the gram; the last step is the whole length.
LADDER = (0.25, 0.5, 1.0)
#: Characters handled at once by vector operations.
BLOCK = 1 << 18
#: Characters of contexts held by a task before whole groups are worked off.
HELD = 1 << 21

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * BLOCK), base, U)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of every run of ``width`` codes."""
    n = len(codes)
    sums = np.zeros(n + 1, U)
    np.cumsum((codes + U(0x51ED27)) * _power(_BASE, n), out=sums[1:])
    return _mix((sums[width:] - sums[:-width]) * _power(_INVERSE, n - width + 1))


def partition_names(codes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For the span of ``length`` at every place: the least fingerprint of its grams."""
    least, width, n = _rolling(codes.astype(U), gram), 1, length - gram + 1
    while 2 * width <= n:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (n - width)], least[n - width :]) if n > width else least


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _slices(texts: list[str], overlap: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, int]]:
    """(indices, begins, codes, place) of texts joined to about BLOCK characters.

    A longer text comes alone, in slices that begin at ``place`` and repeat ``overlap``
    characters of the one before.
    """
    held, size = [], 0
    for k, t in enumerate([*texts, None]):
        if held and (t is None or size + len(t) > BLOCK):
            ends = np.cumsum([len(texts[i]) for i in held])
            yield held, np.concatenate([[0], ends]), _codes("".join(texts[i] for i in held)), 0
            held, size = [], 0
        if t is None:
            continue
        if len(t) <= BLOCK:
            held.append(k)
            size += len(t)
            continue
        step = max(BLOCK - overlap, 1)
        for at in range(0, len(t) - overlap, step):
            piece = _codes(t[at : at + step + overlap])
            yield [k], np.array([0, len(piece)]), piece, at


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the rows of two matrices."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _padded(strings: list[str], width: int) -> np.ndarray:
    return _codes("".join(s.ljust(width, "\0") for s in strings)).reshape(len(strings), width)


def inner_nodes(shared: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the inner nodes at least ``least`` deep of the suffix tree
    whose sorted leaves share ``shared[i]`` characters with the leaf before."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*shared, 0]):
        first = i - 1
        while stack and stack[-1][0] > depth:
            own, first = stack.pop()
            yield own, first, i - 1
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeats(sets: list[bytes], contexts: list[str], cuts: list[int], length: int, gram: int) -> Iterator[tuple[list[int], int, int]]:
    """(leaves, depth, left): the occurrences of the repeats of at least ``length``
    characters, in several texts, in a forest of suffixes.

    Suffix i begins at ``cuts[i]`` of its context. The leaves below a node share ``depth``
    characters from there on, and those of one repeat at least ``left`` before.
    """
    order = sorted(range(len(sets)), key=[c[k:] for c, k in zip(contexts, cuts)].__getitem__)
    rights = [contexts[i][cuts[i] : cuts[i] + length] for i in order]
    sizes = np.fromiter(map(len, rights), np.int64, len(rights))
    codes = _padded(rights, length)
    shared = np.minimum(_common(codes[1:], codes[:-1]), np.minimum(sizes[1:], sizes[:-1])) if len(order) > 1 else np.zeros(0, np.int64)
    for depth, first, last in inner_nodes([0, *shared.tolist()], gram):
        left = length - depth
        below: dict[str, list[int]] = {}
        for i in order[first : last + 1]:
            if left <= 0:
                below.setdefault("", []).append(i)
            elif cuts[i] >= left:
                below.setdefault(contexts[i][cuts[i] - left : cuts[i]], []).append(i)
        for leaves in below.values():
            if len(leaves) > 1 and any(sets[i] != sets[leaves[0]] for i in leaves):
                yield leaves, depth, max(left, 0)


def reach(leaves: list[int], sets: list[bytes], lefts: list[str], width: int) -> list[int]:
    """For each leaf how many characters before it the leaf of some other text shares."""
    order = sorted(range(len(leaves)), key=[lefts[i][::-1] for i in leaves].__getitem__)
    ranked = [leaves[k] for k in order]
    sizes = np.array([len(lefts[i]) for i in ranked])
    codes = _padded([lefts[i][::-1] for i in ranked], max(width, 1))
    shared = np.minimum(_common(codes[1:], codes[:-1]), np.minimum(sizes[1:], sizes[:-1])).tolist()
    out = [0] * len(leaves)
    for places in (range(1, len(ranked)), range(len(ranked) - 2, -1, -1)):
        far = 0
        for k in places:
            before, common = (k - 1, shared[k - 1]) if places.step > 0 else (k + 1, shared[k])
            far = common if sets[ranked[k]] != sets[ranked[before]] else min(far, common)
            out[order[k]] = max(out[order[k]], far)
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as tables that end where a group ends, of about HELD characters."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("context").nbytes
        if size > HELD:
            rows = pa.Table.from_batches(held)
            names = rows.column("group").to_numpy()
            cut = int(np.searchsorted(names, names[-1]))
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
            size = sum(b.column("context").nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


class SharedSpans:
    """Spans of at least ``length`` characters that two or more documents have in common.

    Rows of a null id or text, and texts under ``length`` characters, share nothing. Rows
    that repeat an id are one document; exact copies under other ids are documents like any
    other. Texts are told apart by their MD5, as are suffixes of the whole length; all other
    agreement is read from the characters. Other columns are not read.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None):
        if length < 2:
            raise ValueError("length must be at least 2")
        self.length, self.id_col = length, id_col
        self.gram = gram or max(1, min(GRAM, length // 2))
        docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= length))
        self.docs = docs.withColumn("set", F.unhex(F.md5("text")))
        self._members = self._suffixes = None
        self._frequent = False  # whether some gram is too frequent for a group

    def members(self) -> DataFrame:
        """(id, set, chars): the text of every document that is long enough."""
        if self._members is None:
            self._members = materialize(self.docs.select("id", "set", F.length("text").alias("chars")).distinct(), "texts")
        return self._members

    def _names(self) -> DataFrame:
        """(set, name): the anchors' grams of every text."""
        length, gram = self.length, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for held, begins, codes, _ in _slices(batch.column(1).to_pylist(), length - 1):
                    names = partition_names(codes, length, gram)
                    new = np.concatenate([[True], names[1:] != names[:-1]])
                    new[begins[:-1]] = True
                    for a in begins[1:-1]:
                        new[max(0, a - length + 1) : a] = False  # spans that run over the end of a text
                    at = np.flatnonzero(new)
                    doc = np.array(held)[np.searchsorted(begins, at, "right") - 1]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), _signed(names[at])], ["set", "name"])

        return self.docs.select("set", "text").mapInArrow(run, "set binary, name long")

    def suffixes(self) -> DataFrame:
        """(set, at, cut, fresh, context, group): suffixes of several texts by the group of their prefix.

        A suffix begins at character ``at`` of its text and at ``cut`` of its context; spans
        that begin before ``fresh`` hold an earlier place of the same gram as well.
        ``group`` is null where the gram is too frequent and the whole length splits it.
        """
        if self._suffixes is not None:
            return self._suffixes
        length, gram = self.length, self.gram
        names = materialize(self._names(), "names")
        shared = names.groupBy("name").agg(F.min("set").alias("a"), F.max("set").alias("b")).filter("a < b").select("name")
        wanted = names.join(shared, "name").groupBy("set").agg(F.collect_set("name").alias("names"))
        # the text is read from one of its documents
        one = self.members().groupBy("set").agg(F.min("id").alias("id"))
        texts = self.docs.select("id", "text").join(wanted.join(one, "set"), "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                wanted = [np.array(n, np.int64) for n in batch.column(2).to_pylist()]
                last: dict[tuple[int, int], int] = {}
                for held, begins, codes, place in _slices(texts, gram - 1):
                    prints = _rolling(codes.astype(U), gram).view(np.int64)
                    doc, at, cut, fresh, context = [], [], [], [], []
                    for k, i in enumerate(held):
                        own = prints[begins[k] : max(begins[k], begins[k + 1] - gram + 1)]
                        hits = np.flatnonzero(np.isin(own, wanted[i]))
                        for p, name in zip((hits + place).tolist(), own[hits].tolist()):
                            begin = max(0, p - length + gram)
                            doc.append(i), at.append(p), cut.append(p - begin), context.append(texts[i][begin : p + length])
                            fresh.append(max(0, last.get((i, name), -1) + 1 - begin))
                            last[i, name] = p
                    rows = batch.column(0).take(pa.array(doc, pa.int64()))
                    yield pa.RecordBatch.from_arrays([rows, pa.array(at, pa.int64()), pa.array(cut, pa.int32()), pa.array(fresh, pa.int32()), pa.array(context, pa.string())], ["set", "at", "cut", "fresh", "context"])

        found = texts.select("set", "text", "names").mapInArrow(run, "set binary, at long, cut int, fresh int, context string")
        steps = sorted({max(1, int(share * gram)) for share in LADDER})
        for n in steps:
            found = found.withColumn(f"p{n}", F.xxhash64(F.lit(n), F.substring("context", F.col("cut") + 1, F.lit(n))))
        found = materialize(found, "suffixes")
        keys = [f"p{n}" for n in steps]
        tree = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))  # what shares a prefix shares the shorter ones
        for key in keys:
            tree = tree.join(tree.groupBy(key).agg((F.sum("n") <= GROUP_SUFFIXES).alias(f"fits_{key}")), key)
        group = F.coalesce(*(F.when(F.col(f"fits_{k}"), F.col(k)) for k in keys))
        tree = materialize(tree.select(*keys, group.alias("group")), "prefixes")
        self._frequent = not tree.filter(F.col("group").isNull()).isEmpty()
        self._suffixes = found.join(tree, keys).select("set", "at", "cut", "fresh", "context", "group")
        return self._suffixes

    def _trees(self, schema: str, run) -> DataFrame:
        """``run`` over the suffixes of whole groups, each of which a task can hold."""
        rows = self.suffixes().filter(F.col("group").isNotNull()).repartition("group").sortWithinPartitions("group")
        return rows.mapInArrow(lambda batches: (out for rows in _whole_groups(batches) for out in run(rows)), schema)

    def _whole(self) -> DataFrame:
        """(node, set, begin): suffixes of frequent grams that share the whole length with another text's."""
        length = self.length
        rows = self.suffixes().filter(F.col("group").isNull() & (F.col("fresh") + length <= F.length("context")))
        rows = rows.select("set", (F.col("at") - F.col("cut")).alias("first"), "context", F.explode(F.sequence(F.col("fresh"), F.length("context") - length)).alias("k"))
        rows = rows.select(F.unhex(F.md5(F.substring("context", F.col("k") + 1, F.lit(length)))).alias("node"), "set", (F.col("first") + F.col("k")).alias("begin"))
        nodes = rows.groupBy("node").agg(F.min("set").alias("a"), F.max("set").alias("b")).filter("a < b").select("node")
        return rows.join(nodes, "node", "left_semi")

    def nodes(self) -> DataFrame:
        """(node, set): the texts below a deep inner node, once for each collection of texts."""
        length, gram = self.length, self.gram

        def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            sets = rows.column("set").to_pylist()
            node, text, seen = [], [], set()
            for leaves, _, _ in repeats(sets, rows.column("context").to_pylist(), rows.column("cut").to_pylist(), length, gram):
                own = sorted({sets[i] for i in leaves})
                name = hashlib.md5(b"".join(own)).digest()
                if name not in seen:
                    seen.add(name)
                    node += [name] * len(own)
                    text += own
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(text, pa.binary())], ["node", "set"])

        trees = self._trees("node binary, set binary", run)
        if not self._frequent:
            return trees.distinct()
        whole = self._whole().select("node", "set").distinct()
        same = whole.groupBy("node").agg(F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64(F.lit(1), "set").cast("decimal(38,0)")).alias("t"), F.count(F.lit(1)).alias("n"))
        once = same.groupBy("s", "t", "n").agg(F.min("node").alias("node")).select("node")
        return trees.unionByName(whole.join(once, "node", "left_semi")).distinct()

    def pairs(self) -> DataFrame:
        """(id_a, id_b), a < b: documents that share a span, copies included."""
        nodes = materialize(self.nodes(), "nodes")
        a, b = f"{self.id_col}_a", f"{self.id_col}_b"
        links = nodes.select("node", F.col("set").alias("x")).join(nodes.select("node", F.col("set").alias("y")), "node").filter("x < y").select("x", "y").distinct()
        left, right = self.members().select(F.col("set").alias("x"), F.col("id").alias("i")), self.members().select(F.col("set").alias("y"), F.col("id").alias("j"))
        far = links.join(left, "x").join(right, "y").filter("i <> j").select(F.least("i", "j").alias(a), F.greatest("i", "j").alias(b))
        near = left.join(right, F.col("x") == F.col("y")).filter("i < j").select(F.col("i").alias(a), F.col("j").alias(b))
        return far.unionByName(near)

    def coverage(self) -> DataFrame:
        """(id, shared_chars, shared_spans): characters of a document that lie in shared spans,
        and the number of maximal runs they form; documents that share none have no row."""
        length, gram = self.length, self.gram

        def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            sets, contexts, cuts, at = (rows.column(c).to_pylist() for c in ("set", "context", "cut", "at"))
            lefts = [c[:k] for c, k in zip(contexts, cuts)]
            found: set[tuple] = set()
            for leaves, depth, _ in repeats(sets, contexts, cuts, length, gram):
                for i, before in zip(leaves, reach(leaves, sets, lefts, length - gram)):
                    if before + depth >= length:
                        found.add((sets[i], at[i] - before, at[i] + depth))
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64()))], ["set", "begin", "end"])

        spans = self._trees("set binary, begin long, end long", run)
        if self._frequent:
            spans = spans.unionByName(self._whole().select("set", "begin", (F.col("begin") + length).alias("end")))
        spans = spans.distinct()
        w = Window.partitionBy("set").orderBy("begin", "end")
        before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        runs = spans.withColumn("before", before)
        own = runs.groupBy("set").agg(
            F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce("before", "begin")))).alias("chars_shared"),
            F.sum(F.when(F.col("before").isNull() | (F.col("before") < F.col("begin")), 1).otherwise(0)).alias("runs"),
        )
        copies = self.members().groupBy("set").agg(F.count(F.lit(1)).alias("copies"))
        rows = self.members().join(copies, "set").join(own, "set", "left").filter("copies > 1 OR runs > 0")
        whole = F.col("copies") > 1  # a copied text is shared from end to end
        return rows.select(
            F.col("id").alias(self.id_col),
            F.when(whole, F.col("chars").cast("long")).otherwise(F.col("chars_shared")).alias("shared_chars"),
            F.when(whole, F.lit(1).cast("long")).otherwise(F.col("runs")).alias("shared_spans"),
        )
