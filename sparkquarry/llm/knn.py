"""The k most similar vectors of every vector.

Method: adaptive dimension scan over an inverted file. Vectors are rotated by a random
orthogonal matrix, so that a prefix of the dimensions estimates the whole distance; in each
probed list the first block of columns is scanned for all candidates, a hypothesis test on
the partial distance abandons most, and only survivors see the other columns. Similarities
of what is kept are then computed again in double precision from the stored numbers. The
index has two levels: lists fitted on a sample, whose number is bounded, and below them
sublists of constant size that the task holding a list makes of its members. A list too
large for a task is split over several, which all get its queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import MOST_TASKS

K, DIM = 10, 64
#: The index is fitted on at most so many vectors, drawn by the hash of their id; every vector is indexed.
SAMPLE = 60_000
#: Vectors a list and a cell (the lists of one task) aim at; lists are at most MAX_LISTS. A list of more than SPLIT vectors
#: is searched by sublists of LIST_SIZE, one of more than 2 x CELL_SIZE is split over tasks.
LIST_SIZE, CELL_SIZE, MAX_LISTS, SPLIT = 150, 20_000, 12_288, 900
#: Lists probed for a vector, in at most so many cells, as long as their centroid is at most MARGIN less similar than the nearest.
PROBES, CELLS, MARGIN = 12, 4, 0.15
#: Similarities to centroids held at once.
CELLS_HELD = 4_000_000
#: Columns of the first block; width of the hypothesis test (2.1: one in thousands is lost).
FIRST_BLOCK, EPSILON = 16, 2.1
#: Above this share of survivors the rest of the columns is scanned for all.
DENSE = 0.2
#: Rounding of single precision that may hide a better candidate.
SLACK = 3e-6


@dataclass
class Index:
    """Centroids ordered by cell; bounded by MAX_LISTS, so it may be broadcast."""

    centroids: np.ndarray  # (lists, dim)
    cell: np.ndarray  # first cell of each list, ascending
    parts: np.ndarray  # cells over which each list is split
    rotation: np.ndarray

    def lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest ``probes`` lists of each row of ``x``, nearest first."""
        probes = min(probes, len(self.centroids))
        step = max(1, CELLS_HELD // len(self.centroids))
        out = np.empty((len(x), probes), np.int64)
        for i in range(0, len(x), step):
            near = x[i : i + step] @ self.centroids.T
            top = np.argpartition(-near, probes - 1, 1)[:, :probes]
            out[i : i + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), 1, "stable"), 1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _means(x: np.ndarray, lists: int, random: np.random.Generator, rounds: int = 5) -> np.ndarray:
    """Centroids of spherical k-means."""
    c = x[random.choice(len(x), lists, replace=False)]
    for _ in range(rounds if lists > 1 else 0):
        own = _nearest(x, c)
        order = np.argsort(own, kind="stable")
        begins = np.searchsorted(own[order], np.arange(lists))
        filled = np.flatnonzero(np.bincount(own, minlength=lists))
        c[filled] = _unit(np.add.reduceat(x[order], begins[filled], axis=0))
        empty = np.setdiff1d(np.arange(lists), filled)
        c[empty] = x[random.choice(len(x), len(empty))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)])


def fit(sample: np.ndarray, total: int, dim: int = DIM, seed: int = 7, max_lists: int = MAX_LISTS) -> Index:
    """k-means lists, and cells of equal population by halving the lists along their main axis."""
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0].astype(np.float32)
    x = _unit(sample.astype(np.float32)) if len(sample) else np.zeros((1, dim), np.float32)
    lists = max(1, min(max_lists, total // LIST_SIZE, len(x) // 4))
    c = _means(x, lists, random)
    own = _nearest(x, c)
    weight = np.bincount(own, minlength=lists) + 0.01
    cells: list[np.ndarray] = []
    todo = [np.arange(lists)]
    limit = max(CELL_SIZE / max(total, 1), 1e-9) * weight.sum()
    while todo:
        part = todo.pop()
        if len(part) < 2 or weight[part].sum() <= limit:
            cells.append(part)
            continue
        centred = c[part] - np.average(c[part], 0, weight[part])
        axis = np.linalg.svd(centred * np.sqrt(weight[part])[:, None], full_matrices=False)[2][0]
        part = part[np.argsort(centred @ axis, kind="stable")]
        half = int(np.searchsorted(np.cumsum(weight[part]), weight[part].sum() / 2))
        half = min(max(half, 1), len(part) - 1)
        todo += [part[:half], part[half:]]
    order = np.concatenate(cells)
    share = weight[order] / weight.sum() * total
    alone = np.repeat([len(p) == 1 for p in cells], [len(p) for p in cells])
    parts = np.where(alone & (share > 2 * CELL_SIZE), np.ceil(share / CELL_SIZE), 1).astype(np.int64)
    # a cell of one list takes as many numbers as the list has parts
    width = np.array([parts[i] for i in np.cumsum([0, *(len(p) for p in cells)])[:-1]])
    first = np.cumsum(width) - width
    return Index(c[order], np.repeat(first, [len(p) for p in cells]), parts, rotation)


def sublists(x: np.ndarray, home: np.ndarray, probes: list[np.ndarray], most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """``home`` and ``probes`` by sublists of about LIST_SIZE vectors, where some list of a
    cell is longer than SPLIT: each query gets the ``most`` nearest sublists of its lists."""
    lists, sizes = np.unique(home[home >= 0], return_counts=True)
    if not len(sizes) or sizes.max() <= SPLIT:
        return home, probes
    random, unit = np.random.default_rng(7), _unit(x)
    fine = np.full(len(home), -1, np.int64)
    centroids, begins = [], {}
    made = 0
    for ls, size in zip(lists.tolist(), sizes.tolist()):
        rows = np.flatnonzero(home == ls)
        fitted = rows if size <= SAMPLE else random.choice(rows, SAMPLE, replace=False)
        c = _means(unit[fitted], max(1, min(size // LIST_SIZE, len(fitted) // 4)), random, 3)
        fine[rows] = made + _nearest(unit[rows], c)
        begins[ls] = np.arange(made, made + len(c))
        centroids.append(c)
        made += len(c)
    c = np.concatenate(centroids)
    out = []
    for i, own in enumerate(probes):
        among = np.concatenate([begins[ls] for ls in own.tolist() if ls in begins] or [np.zeros(0, np.int64)])
        near = c[among] @ unit[i]
        out.append(among[np.argsort(-near, kind="stable")[:most]])
    return fine, out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def _keep(best: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The larger values of both, as many columns as ``best``."""
    both = np.concatenate([best, add], 1)
    return -np.partition(-both, best.shape[1] - 1, 1)[:, : best.shape[1]]


def scan_cell(index: Index, x: np.ndarray, home: np.ndarray, probes: list[np.ndarray], copies: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, base) candidates among the vectors of one cell.

    ``home``: the list of a vector that lies in this cell, -1 for a guest that only asks;
    ``probes``: the lists of this cell to scan for it, nearest first; ``copies``: how many
    ids of a vector may be answers.
    """
    n, dim = x.shape
    r = _unit(x) @ index.rotation
    m = min(FIRST_BLOCK, dim)
    head = (r[:, :m] ** 2).sum(1)
    slack = m / dim * (1 + epsilon / np.sqrt(m)) ** 2
    base_order = np.argsort(home, kind="stable")
    sorted_home = home[base_order]
    want = k + 1
    best = np.full((n, want), -2, np.float32)  # with single precision, the want-th is the bar
    rank = np.concatenate([np.arange(len(p)) for p in probes]) if n else np.zeros(0, int)
    who = np.repeat(np.arange(n), [len(p) for p in probes])
    what = np.concatenate(probes) if n else np.zeros(0, int)
    order = np.lexsort((what, np.minimum(rank, 1)))  # every query's nearest list first: it sets the bar
    rank, who, what = rank[order], who[order], what[order]
    edges = np.flatnonzero(np.concatenate([[True], (what[1:] != what[:-1]) | ((rank[1:] > 0) != (rank[:-1] > 0)), [True]]))
    found_q, found_b, found_s = [], [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        lo, hi = np.searchsorted(sorted_home, [what[a], what[a] + 1])
        base_all = base_order[lo:hi]
        if not len(base_all):
            continue
        for q in np.array_split(who[a:b], max(1, (b - a) * len(base_all) // 2_000_000)):
            for base in np.array_split(base_all, max(1, len(base_all) // 20_000)):
                bar = best[q, -1]
                part = r[q, :m] @ r[base, :m].T
                if rank[a] > 0:
                    # squared distance so far against what the bar allows for so many dimensions
                    alive = head[q][:, None] + head[base][None, :] - 2 * part <= ((2 - 2 * np.minimum(bar, 1)) * slack + 1e-5)[:, None]
                    share = np.count_nonzero(alive) / alive.size
                else:
                    share = 1.0
                if share > DENSE:
                    s = part + r[q, m:] @ r[base, m:].T
                    i, j = np.nonzero(s >= bar[:, None] - SLACK)
                    s = s[i, j]
                else:
                    i, j = np.nonzero(alive)
                    s = part[i, j] + np.einsum("ij,ij->i", r[q[i], m:], r[base[j], m:])
                    ok = s >= bar[i] - SLACK
                    i, j, s = i[ok], j[ok], s[ok]
                if not len(i):
                    continue
                # a vector with copies offers several answers
                weight = np.minimum(copies[base[j]], want)
                ii, ss = (np.repeat(i, weight), np.repeat(s, weight)) if weight.max() > 1 else (i, s)
                top = np.lexsort((-ss, ii))
                ii, ss = ii[top], ss[top]
                place = np.arange(len(ii)) - np.searchsorted(ii, ii)
                add = np.full((len(q), want), -2, np.float32)
                inside = place < want
                add[ii[inside], place[inside]] = ss[inside]
                best[q] = _keep(best[q], add)
                ok = s >= best[q[i], -1] - SLACK
                found_q.append(q[i[ok]]), found_b.append(base[j[ok]]), found_s.append(s[ok])
    if not found_q:
        return np.zeros(0, int), np.zeros(0, int)
    fq, fb, fs = np.concatenate(found_q), np.concatenate(found_b), np.concatenate(found_s)
    ok = fs >= best[fq, -1] - SLACK
    return fq[ok], fb[ok]


def _usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    v = F.col(vector_col).cast("array<float>")
    whole = F.size("v").eqNullSafe(dim) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & whole)


def nearest(vectors: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", k: int = K, dim: int = DIM, *, probes: int = PROBES, cells: int = CELLS, margin: float = MARGIN, epsilon: float = EPSILON, max_lists: int = MAX_LISTS, exact: bool = False) -> DataFrame:
    """(id, rank, neighbour_id, similarity): the k most similar others of every usable vector.

    Similarity is the cosine in double precision rounded to 6 decimals; equal ones are
    ranked by the smaller id, ranks count from 1. Left out: null ids; vectors that are
    null, all zero, not ``dim`` long, or hold a null or non-finite number. Rows that repeat
    an id are expected to be equal and count once. Fewer than k others give fewer rows; an
    empty table gives none. Other columns are not read.

    Equal vectors are searched once, whatever their number: a map task sends a group of
    copies as one row with the k + 1 smallest of its ids, so it can't fill a list.

    ``probes``, ``cells`` and ``margin`` say how many lists are searched for a vector,
    ``epsilon`` how wide the hypothesis test is. With ``exact`` the answers found so are
    only the bar: a second search takes every list that may hold a better one, by the angle
    between vector and centroid and the list's widest angle, and abandons nothing.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    clean = _usable(vectors, id_col, vector_col, dim).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    total = clean.count()
    share = min(1.0, 0.9 * SAMPLE / max(total, 1))
    drawn = clean.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 62)) < max(1, int(share * (1 << 62)))).select("v").limit(SAMPLE).toArrow()
    sample = _matrix(drawn.column("v").combine_chunks(), dim) if drawn.num_rows else np.zeros((0, dim), np.float32)
    fitted = fit(sample, total, dim, max_lists=max_lists)
    index = spark.sparkContext.broadcast(fitted)

    members = clean.select("h", "g", "id").distinct()
    found = _search(clean, index, kind, k, dim, probes, cells, margin, epsilon)
    if exact:
        # the k-th other of a vector is behind itself; fewer leave every list open
        bars = found.select("h", "g", F.when(F.size("near") > k, -F.element_at("near", k + 1)["d"] - 1e-6).otherwise(-1.0).alias("bar"))
        found = _search(clean.join(materialize(bars, "bars"), ["h", "g"]), index, kind, k, dim, SAMPLE, SAMPLE, margin, float("inf"), _widths(clean, index, dim))
    answers = members.join(found, ["h", "g"]).select("id", F.posexplode(F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)).alias("rank", "n"))
    return answers.select(F.col("id").alias(id_col), (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), (-F.col("n.d")).alias("similarity"))


def _widths(clean: DataFrame, index, dim: int) -> np.ndarray:
    """The widest angle between the centroid of each list and its members; one number a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, widest = index.value, np.zeros(len(index.value.centroids))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0), dim))
                ls = own.lists(x, 1)[:, 0]
                np.maximum.at(widest, ls, _angle(np.einsum("ij,ij->i", x, own.centroids[ls])))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(widest)), pa.int32()), pa.array(widest)], ["list", "width"])

    rows = clean.select("v").mapInArrow(run, "list int, width double").groupBy("list").agg(F.max("width").alias("width")).collect()
    out = np.zeros(len(index.value.centroids))
    for r in rows:
        out[r["list"]] = r["width"]
    return out


def _angle(cosine: np.ndarray) -> np.ndarray:
    """Angles, a little too wide for what single precision hides."""
    return np.arccos(np.clip(cosine - SLACK, -1, 1))


def _search(clean: DataFrame, index, kind: str, k: int, dim: int, probes: int, most_cells: int, margin: float, epsilon: float, widths: np.ndarray | None = None) -> DataFrame:
    """(h, g, near): for every distinct vector up to k + 1 (-similarity, id) of the nearest, itself among them.

    With ``widths`` the column bar tells which lists are searched.
    """
    cells = int(index.value.cell[-1] + index.value.parts[-1])
    columns_in = ["h", "g", "v", "id", *(["bar"] if widths is not None else [])]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids: dict[tuple[int, int], list] = {}
            first = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key not in ids:
                    first.append(i)
                ids.setdefault(key, []).append(batch.column(3)[i].as_py())
            at = pa.array(first)
            offers = pa.array([sorted(set(v))[: k + 1] for v in ids.values()], pa.list_(batch.column(3).type))
            columns = [*(batch.column(j).take(at) for j in (0, 1, 2)), offers]
            x = _unit(_matrix(columns[2], dim))
            row, cell, home, asked = [], [], [], []
            salt = columns[0].to_numpy()
            if widths is None:
                lists = own.lists(x, probes)
                near = np.stack([np.einsum("ij,ij->i", x, own.centroids[lists[:, j]]) for j in range(lists.shape[1])], 1)
                wanted = [ls[:m] for ls, m in zip(lists, (near >= near[:, :1] - margin).sum(1).tolist())]
            else:
                bar = _angle(batch.column(4).take(at).to_numpy().astype(np.float64))
                wanted = []
                for i in range(0, len(x), 512):
                    angles = np.arccos(np.clip(x[i : i + 512] @ own.centroids.T + SLACK, -1, 1))
                    first = own.lists(x[i : i + 512], 1)[:, 0]
                    wanted += [np.concatenate([[f], np.setdiff1d(np.flatnonzero(a <= b + widths), [f])]) for a, b, f in zip(angles, bar[i : i + 512], first)]
            for i, ls in enumerate(wanted):
                cs = own.cell[ls].tolist()
                for c in list(dict.fromkeys(cs))[:most_cells]:
                    mine = [a for a, b in zip(ls.tolist(), cs) if b == c]
                    parts = int(own.parts[mine[0]])
                    for part in range(parts):
                        row.append(i), cell.append(c + part)
                        home.append(ls[0] if c == cs[0] and part == salt[i] % parts else -1)
                        asked.append(mine)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *(c.take(at) for c in columns), pa.array(home, pa.int32()), pa.array(asked, pa.list_(pa.int32()))], ["cell", "h", "g", "v", "ids", "home", "probes"])

    routed = clean.select(*columns_in).mapInArrow(route, f"cell int, h long, g long, v array<float>, ids array<{kind}>, home int, probes array<int>")

    def merge(rows: pa.Table) -> pa.Table:
        """One row for each vector of a cell: copies may come from several batches."""
        keys = list(zip(rows.column("h").to_pylist(), rows.column("g").to_pylist()))
        if len(set(keys)) == len(keys):
            return rows
        ids: dict[tuple[int, int], set] = {}
        first = []
        for i, (key, own) in enumerate(zip(keys, rows.column("ids").to_pylist())):
            if key not in ids:
                first.append(i)
            ids[key] = set(sorted(ids.get(key, set()) | set(own))[: k + 1])
        rows = rows.take(pa.array(first))
        offers = pa.chunked_array([pa.array([sorted(v) for v in ids.values()], rows.column("ids").type)])
        return rows.set_column(rows.schema.get_field_index("ids"), "ids", offers)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for rows in map(merge, _by_cell(batches)):
            x = _matrix(rows.column("v").combine_chunks(), dim)
            home = rows.column("home").to_numpy()
            asked = [np.array(p, np.int64) for p in rows.column("probes").to_pylist()]
            if widths is None:
                home, asked = sublists(x, home, asked, probes)
            ids = rows.column("ids").to_pylist()
            copies = np.fromiter(map(len, ids), np.int64, len(ids))
            q, b = scan_cell(own, x, home, asked, copies, k, epsilon)
            exact = _unit(x.astype(np.float64))
            s = np.concatenate([np.einsum("ij,ij->i", exact[q[i : i + 200_000]], exact[b[i : i + 200_000]]) for i in range(0, len(q), 200_000)]) if len(q) else np.zeros(0)
            s = np.round(s, 6) + 0.0
            # every answer once for each of the ids it stands for
            flat = np.array([i for own_ids in ids for i in own_ids], dtype=object if kind == "string" else None)
            first = np.cumsum(copies) - copies
            times = copies[b]
            entry = np.repeat(first[b], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            q, s = np.repeat(q, times), np.repeat(s, times)
            order = np.lexsort((flat[entry], -s, q)) if len(q) else np.zeros(0, int)
            q, s, entry = q[order], s[order], entry[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            ok = place <= k
            q, s, entry = q[ok], s[ok], entry[ok]
            offsets = np.searchsorted(q, np.arange(len(x) + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(-s, pa.float64()), pa.array(flat[entry].tolist(), rows.column("ids").type.value_type)], ["d", "id"])
            near = pa.ListArray.from_arrays(pa.array(offsets), structs)
            some = pa.array(np.flatnonzero(np.diff(offsets)))
            yield pa.RecordBatch.from_arrays([rows.column("h").combine_chunks().take(some), rows.column("g").combine_chunks().take(some), near.take(some)], ["h", "g", "near"])

    parts = routed.repartitionById(min(cells, MOST_TASKS), F.col("cell") % MOST_TASKS).sortWithinPartitions("cell").mapInArrow(search, f"h long, g long, near array<struct<d: double, id: {kind}>>")
    return parts.groupBy("h", "g").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + 1).alias("near"))


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]])) if len(cells) else []
        for a, b in zip(edges[:-1], edges[1:]):
            if held and held[-1].column(0)[0].as_py() != cells[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield pa.Table.from_batches(held)


def similar_pairs(neighbours: DataFrame, least: float, id_col: str = "chunk_id") -> DataFrame:
    """(id_a, id_b), a < b: pairs of ``nearest`` with a similarity of ``least`` or more, each once."""
    a, b = F.col(id_col), F.col("neighbour_id")
    return neighbours.filter(F.col("similarity") >= least).select(F.least(a, b).alias(f"{id_col}_a"), F.greatest(a, b).alias(f"{id_col}_b")).distinct()
