"""Exact top-k inner products by best-first search in M-trees.

Inner products are searched in a metric space: candidates get one more
component so that all have the norm of the longest, the query gets a zero
there; then the largest inner product is the smallest Euclidean distance.

The tree's root is shared: up to ``ROUTES`` routing vectors, chosen from a bounded sample of all
rows. Every row goes to the page of its nearest one, so a page is a region of space, and the
driver keeps each page's routing vector, covering radius and size. A page of more than
``GROUP_ROWS`` rows is dealt to groups of that size. In a task, a group is an M-tree below it:
pages of entries, each entry a vector (leaf) or a routing vector with the covering radius of the
page below it, and every entry with its distance to the routing vector above.

A query first searches one group of its nearest page. Its k-th best score there bounds the
distance of any answer, and it then meets only the groups of pages whose smallest possible
distance is within that bound. Inside a group it visits pages in the order of their
smallest possible distance, skips entries that the triangle inequality on stored
parent distances rules out, and stops when nothing left can enter.

The bounds only choose what is computed: scores are exact integers. A group meets
its queries in blocks of bounded size, so neither a broadcast nor
a task grows with the number of queries, and each group keeps k rows a query.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shredkit.llm.frames import saved

PAGE, FANOUT = 256, 32
GROUP_ROWS, QUERY_ROWS = 16384, 4096
#: Pages of the shared root, and bytes of their routing vectors; rows of the sample per page.
ROUTES, ROUTE_BYTES, SAMPLE = 4096, 8 << 20, 8
SCALE = 256
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


@dataclass
class Page:
    """A node. ``at`` are rows of the candidate matrix: entries of a leaf, routing
    vectors of an inner page; ``parent`` their distances to the routing vector above."""

    at: np.ndarray
    parent: np.ndarray
    radius: np.ndarray | None = None
    below: list[Page] = field(default_factory=list)


def bulk_load(x: np.ndarray, rows: np.ndarray, to_parent: np.ndarray) -> Page:
    """Tree over ``rows`` of ``x``: routing vectors are spread rows (farthest first), every
    row goes to its nearest one. Equal vectors cannot be told apart by distance, so
    a set that does not divide is cut into pages of even size."""
    if len(rows) <= PAGE:
        return Page(rows, to_parent)
    n = min(FANOUT, -(-len(rows) // (PAGE // 2)))
    picks, nearest = [0], _distances(x[rows], x[rows[0]])
    owner = np.zeros(len(rows), np.int64)
    for i in range(1, n):
        far = int(nearest.argmax())
        if nearest[far] == 0:
            break
        d = _distances(x[rows], x[rows[far]])
        closer = d < nearest
        owner[closer], nearest[closer] = i, d[closer]
        picks.append(far)
    sizes = np.bincount(owner, minlength=len(picks))
    if len(picks) == 1 or sizes.max() > 0.9 * len(rows):
        owner = np.arange(len(rows)) * n // len(rows)
        picks = [int(np.flatnonzero(owner == i)[0]) for i in range(n)]
    routing = rows[picks]
    radius, below = [], []
    for i, r in enumerate(routing):
        own = rows[owner == i]
        d = _distances(x[own], x[r])
        radius.append(d.max())
        below.append(bulk_load(x, own, d))
    return Page(routing, to_parent[picks], np.array(radius), below)


def _distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    diff = x - v
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def _exact(candidates: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; object arrays of Python integers beyond 53 bits."""
    if candidates.dtype == object:
        return np.array([min(max(int(v), LONG_MIN), LONG_MAX) for v in candidates.dot(query.astype(object))], object)
    return candidates @ query


def search(page: Page, x: np.ndarray, ints: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int,
           longest: float, k: int, floor: float = -math.inf) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of one query that score ``floor`` or more: best first over pages."""
    q = np.append(query.astype(np.float64), 0.0)
    norm = float(q @ q)
    slack = 1e-6 * (math.sqrt(norm) + longest + 1)
    best: list[tuple] = []  # heap of (score, -vec_id): the worst on top

    def reach() -> float:
        """Distance beyond which nothing can enter the k best (ties still can)."""
        least = max(floor, float(best[0][0])) if len(best) == k else floor
        if least == -math.inf:
            return math.inf
        return math.sqrt(max(0.0, norm + longest * longest - 2.0 * least)) + slack

    count = 0
    todo: list[tuple[float, int, Page, float | None]] = [(0.0, 0, page, None)]
    while todo:
        least, _, node, to_above = heapq.heappop(todo)
        limit = reach()
        if least > limit:
            break
        keep = np.arange(len(node.at))
        if to_above is not None and limit < math.inf:
            bound = np.abs(to_above - node.parent) - (0.0 if node.radius is None else node.radius)
            keep = keep[bound <= limit]
        if not len(keep):
            continue
        if node.radius is None:
            at = node.at[keep]
            at = at[ids[at] != own]
            scores = _exact(ints[at], query)
            if len(best) == k:
                near = scores >= best[0][0]
                at, scores = at[near], scores[near]
            elif len(at) > 4 * k and scores.dtype != object:
                near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                at, scores = at[near], scores[near]
            for s, i in zip(scores.tolist(), ids[at].tolist(), strict=True):
                item = (int(s), -i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            continue
        d = _distances(x[node.at[keep]], q)
        for j, dist in zip(keep.tolist(), d.tolist(), strict=True):
            low = max(0.0, dist - float(node.radius[j]))
            if low <= limit:
                count += 1
                heapq.heappush(todo, (low, count, node.below[j], dist))
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def group_search(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k of a block of queries in one group of candidates of one dimension. Vectors
    whose squares overflow have no usable bounds: all their products are computed."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _group_search(candidates, queries, k)


def _group_search(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    raw = np.array(candidates["v"].tolist(), dtype=np.float64)
    asked = np.array(queries["v"].tolist(), dtype=np.float64)
    top = max(np.abs(raw).max(initial=0.0), np.abs(asked).max(initial=0.0))
    ids = candidates["vec_id"].to_numpy(np.int64)
    x = raw.reshape(len(raw), -1)
    norms = np.einsum("ij,ij->i", x, x)
    longest = float(norms.max(initial=0.0))
    x = np.concatenate([x, np.sqrt(np.maximum(longest - norms, 0))[:, None]], axis=1)
    small = top * top * max(1, raw.shape[1]) < 2**53
    ints = raw if small else np.array([[int(c) for c in v] for v in raw.tolist()], dtype=object)
    out = []
    if _bounded(longest):
        tree = bulk_load(x, np.arange(len(x)), np.zeros(len(x)))
    else:
        tree = Page(np.arange(len(x)), np.zeros(len(x)))
    floors = queries["floor"].fillna(-math.inf).tolist() if "floor" in queries else [-math.inf] * len(queries)
    for own, q, floor in zip(queries["vec_id"].tolist(), asked, floors, strict=True):
        query = q if small else np.array([int(c) for c in q.tolist()], dtype=object)
        out += [(own, i, int(s)) for s, i in search(tree, x, ints, ids, query, own, math.sqrt(longest), k, floor)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def scaled(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, v): components as floor(256 * x); vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    # from 2^52 on a double is whole, and floor() to a long would not hold the largest
    whole = F.transform("x", lambda c: F.when(F.abs(SCALE * c) < float(1 << 52),
                                              F.floor(SCALE * c).cast("double")).otherwise(SCALE * c))
    return clean.where(~bad).select("vec_id", whole.alias("v"))


def _bounded(norm: float) -> bool:
    """Do vectors of at most this squared norm have usable distances?"""
    return bool(np.isfinite(norm)) and norm < 1e300


@dataclass
class Root:
    """The shared routing vectors of the vectors of one dimension (``longest``: their largest norm)."""

    routes: np.ndarray  # with the added component
    longest: float
    radius: np.ndarray | None = None
    groups: np.ndarray | None = None  # groups that each page is dealt to

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Page of each vector, and its distance to the routing vector."""
        rest = np.maximum(self.longest**2 - np.einsum("ij,ij->i", v, v), 0)
        x = np.concatenate([v, np.sqrt(rest)[:, None]], axis=1)
        page = (np.einsum("ij,ij->i", self.routes, self.routes) - 2 * (x @ self.routes.T)).argmin(axis=1)
        return page, np.sqrt(((x - self.routes[page]) ** 2).sum(axis=1))

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of a query to each routing vector, and the least distance of a vector of its page."""
        d = _distances(self.routes, np.append(q, 0.0))
        return d, np.maximum(d - self.radius - self.slack(q), 0)

    def slack(self, q: np.ndarray) -> float:
        return 1e-6 * (float(np.sqrt(q @ q)) + self.longest + 1)


def _roots(data: DataFrame, group_rows: int) -> dict[int, Root]:
    """Routing vectors for every dimension, far apart in a bounded sample of its rows.
    Dimensions without usable distances, or of which the sample holds none, have no root."""
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    sizes = data.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("norm"))
    sizes = sizes.orderBy(F.desc("n"), "dim").limit(ROUTES).collect()
    out: dict[int, Root] = {}
    for r in sizes:
        pages = min(ROUTES, max(1, ROUTE_BYTES // (8 * (r["dim"] + 1))), -(-r["n"] // group_rows))
        if pages < 2 or not r["dim"] or not _bounded(r["norm"]):
            continue
        rows = data.where(F.col("dim") == r["dim"])
        rows = rows.orderBy(F.xxhash64(F.monotonically_increasing_id())).limit(SAMPLE * pages)
        v = np.array([x["v"] for x in rows.select("v").collect()], np.float64)
        rest = np.maximum(r["norm"] - np.einsum("ij,ij->i", v, v), 0)
        x = np.concatenate([v, np.sqrt(rest)[:, None]], axis=1)
        picks, nearest = [0], _distances(x, x[0])
        while len(picks) < pages and nearest.max() > 0:
            picks.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, _distances(x, x[picks[-1]]))
        out[r["dim"]] = Root(x[picks], math.sqrt(r["norm"]))
    return out


def _paged(data: DataFrame, roots: dict[int, Root]) -> DataFrame:
    """Every vector with its page (0 where there is no root), its distance to the routing vector, and
    a number that deals the rows of a page."""

    def run(it):
        for c in it:
            page, dist = np.zeros(len(c), np.int32), np.zeros(len(c))
            for dim, at in c.groupby("dim").indices.items():
                if dim in roots:
                    page[at], dist[at] = roots[dim].nearest(np.array(c["v"].iloc[at].tolist(), np.float64))
            yield c.assign(page=page, dist=dist)

    rows = data.withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
    return rows.mapInPandas(run, "vec_id long, v array<double>, dim int, deal long, page int, dist double")


def _visits(asked: DataFrame, roots: dict[int, Root], groups: dict[tuple[int, int], int], first: bool) -> DataFrame:
    """The groups that each query meets: first one of its nearest page, then, within the bound
    that ``floor`` sets, all the others."""
    pages: dict[int, list[int]] = {}
    for dim, page in sorted(groups):
        pages.setdefault(dim, []).append(page)

    def run(it):
        for q in it:
            out = []
            for i, (vec_id, dim, v, floor) in enumerate(zip(q["vec_id"], q["dim"], q["v"], q["floor"])):
                held = pages.get(dim, [])
                if not held:
                    continue
                home, near = held[0], held
                if dim in roots:
                    root, v = roots[dim], np.array(v, np.float64)
                    d, least = root.reach(v)
                    home = held[int(d[held].argmin())]
                    if floor == floor and floor is not None:  # the k-th best score so far
                        far = math.sqrt(max(0.0, float(v @ v) + root.longest**2 - 2.0 * floor)) + root.slack(v)
                        near = [p for p in held if least[p] <= far]
                mine = (home, hash(int(vec_id)) % groups[dim, home])
                if first:
                    out.append((i, *mine))
                else:
                    out += [(i, p, g) for p in near for g in range(groups[dim, p]) if (p, g) != mine]
            at, page, group = (np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
            yield q.iloc[at].assign(page=page.astype(np.int32), g=group.astype(np.int32))

    return asked.mapInPandas(run, "vec_id long, dim int, v array<double>, floor double, page int, g int")


def _meet(paged: DataFrame, visits: DataFrame, k: int, query_rows: int) -> DataFrame:
    """Search every group that is visited, in blocks of its queries."""
    at = ["dim", "page", "g"]
    visits = saved(visits, "topk-visits")
    met = visits.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks"))
    met = saved(met, "topk-groups")
    left = paged.join(met, at).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = visits.join(met, at).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

    def run(key: tuple, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="int64")})
        return group_search(c, q, k)

    keys = [*at, "b"]
    found = left.select("vec_id", "v", *keys).groupBy(*keys).cogroup(
        right.select("vec_id", "v", "floor", *keys).groupBy(*keys))
    return found.applyInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, group_rows: int = GROUP_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every vec_id divisible by ``every`` the ``k``
    largest integer inner products with the other rows (all, if fewer), ties to the smaller vec_id.

    Only vectors of one length are compared with each other. Rows that repeat
    a vec_id are candidates each; a repeated query id is asked once, with its
    smallest vector, and no row with its own id answers it. Scores beyond 64 bits
    are held at the ends of the range. A query without candidates has no rows;
    an empty table gives none; extra columns are ignored.
    """
    data = saved(scaled(vectors).withColumn("dim", F.size("v")), "topk-vectors")
    asked = data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min(F.struct("dim", "v")).alias("q"))
    asked = saved(asked.select("vec_id", "q.dim", "q.v", F.lit(None).cast("double").alias("floor")), "topk-queries")
    roots = _roots(data, group_rows)
    paged = saved(_paged(data, roots), "topk-paged")
    sizes = paged.groupBy("dim", "page").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
    groups: dict[tuple[int, int], int] = {}
    for r in sizes.collect():  # at most ROUTES pages a dimension
        groups[r["dim"], r["page"]] = -(-r["n"] // group_rows)
        if r["dim"] in roots:
            root = roots[r["dim"]]
            root.radius = np.zeros(len(root.routes)) if root.radius is None else root.radius
            root.radius[r["page"]] = r["radius"]
    # a group has about group_rows rows: single rows are dealt, so neither a vector nor an id can make it hot
    dealt = F.from_json(F.lit(json.dumps({f"{d} {p}": n for (d, p), n in groups.items()})), "map<string, int>")
    many = F.coalesce(F.try_element_at(dealt, F.concat_ws(" ", "dim", "page")), F.lit(1))
    paged = paged.withColumn("g", F.pmod(F.col("deal"), many).cast("int"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = saved(_meet(paged, _visits(asked, roots, groups, True), k, query_rows), "topk-first")
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = floors.select(F.col("query_id").alias("vec_id"), F.col("floor").cast("double"))
    asked = asked.drop("floor").join(floors, "vec_id", "left")
    more = _meet(paged, _visits(asked.select("vec_id", "dim", "v", "floor"), roots, groups, False), k, query_rows)
    ranked = first.unionByName(more).withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
