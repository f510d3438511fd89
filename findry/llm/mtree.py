"""Exact top-k search by inner product with M-trees searched best first.

Inner products become distances by one more coordinate: with ``m`` the largest
squared length of any vector, an object ``x`` gets ``sqrt(m - |x|^2)`` and a
query gets 0. Then ``d(q, x)^2 = |q|^2 + m - 2 q.x``, so the nearest objects
are those of the highest product, and the triangle inequality holds.

The table is parted among routing objects; each part is cut into trees of
bounded size. A tree is one row: nodes with a routing object, a covering radius
and the distance to the parent's routing object, and pages of vectors with
their distances to the page's routing object.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from findry.llm.common import mix64
from findry.session import materialize

PAGE, FAN = 128, 16
#: Trees are dealt out in shelves: about so many, until a shelf holds so many trees.
SHELVES, ON_SHELF = 32, 16
#: Elements of the queries that meet a tree in a task, unless their number is given.
BLOCK_ELEMENTS = 2_097_152


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with an id and a vector without null, NaN or infinity."""
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    there = F.col(key).isNotNull() & F.col(vector).isNotNull()
    return rows.where(there & F.coalesce(fine, F.lit(False)))


def floor_scaled(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, as a long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as a matrix; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the cheapest type in which products of their rows are exact integers."""

    def most(x: np.ndarray) -> int:
        return max(int(x.max(initial=0)), -int(x.min(initial=0)))

    top = most(a) * most(b) * a.shape[-1]
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    return a.astype(kind, copy=False), b.astype(kind, copy=False)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of ``a`` with rows of ``b``, both as ``_exact`` gives them."""
    return a @ b.T


def _narrow(low: int, high: int) -> np.dtype:
    """The smallest of the integer types of Spark arrays that holds both."""
    fit = (t for t in (np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return np.dtype(next(fit, np.int64))


class Space:
    """Distances between objects, and bounds on products from distances."""

    def __init__(self, top: int) -> None:
        self.top = float(top)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.maximum(0.0, self.top - (x * x).sum(axis=-1))
        return np.concatenate((x, np.sqrt(rest)[..., None]), axis=-1)

    @staticmethod
    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between lifted rows of ``a`` and one lifted ``b``."""
        return np.sqrt(((a - b) ** 2).sum(axis=-1))

    def most(self, square: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The highest product that an object at distance ``least`` or more can have.

        A little is added for the rounding of distances.
        """
        total = square + self.top
        return (total - np.maximum(0.0, least) ** 2) / 2 + 1e-9 * total + 1e-6

    def reach(self, square: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The longest distance at which ``most`` is ``floor`` or more; minus infinity if none."""
        total = square + self.top
        left = total * (1 + 2e-9) + 2e-6 - 2.0 * floor
        return np.where(left >= 0, np.sqrt(np.maximum(left, 0.0)), -np.inf)


class Best:
    """The best ``k`` rows of each of several queries, ties to the smaller id.

    ``floors`` holds what a product must be to count; it rises to the ``k``-th
    product of a query when the rows added are sorted.
    """

    def __init__(self, floors: np.ndarray, k: int) -> None:
        self.floors, self.k, self.added = floors.astype(np.float64), k, 0
        self.rows = [(np.empty(0, np.int64),) * 3]

    def add(self, who: np.ndarray, ids: np.ndarray, products: np.ndarray) -> bool:
        """Take rows of queries ``who``; true if floors may have risen."""
        self.rows.append((who, ids, products.astype(np.int64)))
        self.added += len(who)
        full = self.added >= self.k * len(self.floors)
        if full:
            self.settle()
        return full

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(who, ids, products)`` by query, best first."""
        who, ids, products = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((ids, -products, who))
        who = who[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        order, who, rank = (x[rank < self.k] for x in (order, who, rank))
        ids, products = ids[order], products[order]
        full = rank == self.k - 1
        self.floors[who[full]] = np.maximum(self.floors[who[full]], products[full])
        self.rows, self.added = [(who, ids, products)], 0
        return self.rows[0]


class Tree:
    """An M-tree over some rows, in arrays.

    ``nodes`` has a row per node: routing row, radius, distance to the parent's
    routing object, first and end (of children, or of rows in a page), whether
    it is a page. Node 0 is the root. Rows are in page order, those of a page by
    their distance to its routing object (``far``).
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, far: np.ndarray, nodes: np.ndarray):
        self.ids, self.rows, self.far, self.nodes = ids, rows, far, nodes

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, space: Space) -> Tree:
        lifted = space.lift(rows)
        draw = np.random.default_rng(len(ids))
        nodes: list[list[float]] = []
        order: list[np.ndarray] = []
        far = np.zeros(len(ids))
        members = [np.arange(len(ids))]
        routing, parents = [int(np.argmin(ids))], [-1]
        at = 0
        placed = 0
        while at < len(members):
            own, pivot = members[at], routing[at]
            away = space.apart(lifted[own], lifted[pivot])
            up = parents[at]
            to_parent = float(space.apart(lifted[pivot], lifted[routing[up]])) if up >= 0 else 0.0
            node = [pivot, float(away.max(initial=0.0)), to_parent, 0, 0, 0]
            if len(own) <= PAGE:
                own = own[np.argsort(away, kind="stable")]
                far[own] = np.sort(away)
                order.append(own)
                node[3:] = [placed, placed + len(own), 1]
                placed += len(own)
            else:
                n = min(FAN, -(-len(own) // (PAGE // 2)))
                seeds = own[draw.choice(len(own), n, replace=False)]
                near = np.stack([space.apart(lifted[own], lifted[s]) for s in seeds]).argmin(axis=0)
                groups = [(own[near == i], seeds[i]) for i in range(n) if (near == i).any()]
                if len(groups) == 1:  # copies: any split is as good
                    groups = [(part, part[0]) for part in np.array_split(own, n)]
                node[3:] = [len(members), len(members) + len(groups), 0]
                members += [g for g, _ in groups]
                routing += [int(s) for _, s in groups]
                parents += [at] * len(groups)
            nodes.append(node)
            at += 1
        sequence = np.concatenate(order)
        place = np.empty(len(ids), np.int64)
        place[sequence] = np.arange(len(ids))
        table = np.array(nodes)
        table[:, 0] = place[table[:, 0].astype(np.int64)]
        return cls(ids[sequence], rows[sequence], far[sequence], table)

    def search(
        self, query: np.ndarray, own: int, k: int, floor: float, space: Space
    ) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, products)`` of the best ``k`` rows of other ids with products of ``floor`` or more."""
        best = Best(np.array([floor]), k)
        asked, owns = query.astype(np.int64)[None, :], np.array([own])
        self.search_all(asked, owns, np.zeros(1, np.int64), best, space)
        return best.settle()[1:]

    def search_all(
        self, queries: np.ndarray, owns: np.ndarray, who: np.ndarray, best: Best, space: Space,
        dive: bool = True,
    ) -> None:
        """Add to ``best`` what the queries at the places ``who`` find among rows of other ids.

        Nodes wait in order of the best product that they can hold, each with
        the queries that it can hold one for. A child or row whose distance to
        its parent's routing object rules it out for all of them is passed over
        without computing a distance. ``dive`` first takes each query to
        the page with the nearest routing objects, for a floor to begin with.
        """
        rows, asked = _exact(self.rows, queries)
        square = (queries.astype(np.float64) ** 2).sum(axis=1)
        total = square + space.top
        pivot = self.nodes[:, 0].astype(np.int64)
        radius, to_parent = self.nodes[:, 1], self.nodes[:, 2]
        begin, stop = self.nodes[:, 3].astype(np.int64), self.nodes[:, 4].astype(np.int64)
        page = self.nodes[:, 5] > 0

        def away(nodes: np.ndarray, who: np.ndarray) -> np.ndarray:
            """Distances of the routing objects of ``nodes`` (rows) from queries (columns)."""
            products = _products(rows[pivot[nodes]], asked[who])
            return np.sqrt(np.maximum(0.0, total[who] - 2.0 * products))

        going = [(0, who)] if dive else []
        while going:
            at, some = going.pop()
            if not page[at]:
                child = np.arange(begin[at], stop[at])
                to = away(child, some).argmin(axis=0)
                going += [(int(c), some[to == i]) for i, c in enumerate(child) if (to == i).any()]
            elif stop[at] - begin[at] >= best.k:
                here = slice(begin[at], stop[at])
                products = _products(rows[here], asked[some]).astype(np.float64)
                products[self.ids[here][:, None] == owns[some]] = -np.inf
                kth = np.partition(products, -best.k, axis=0)[-best.k]
                best.floors[some] = np.maximum(best.floors[some], kth)

        reach = space.reach(square, best.floors)
        waiting = [(0.0, 0, who, away(np.zeros(1, np.int64), who)[0])]
        while waiting:
            _, at, who, here = heapq.heappop(waiting)
            still = here - radius[at] <= reach[who]
            who, here = who[still], here[still]
            if not len(who):
                continue
            if page[at]:
                far = self.far[begin[at] : stop[at]]
                low = np.searchsorted(far, here - reach[who])
                high = np.searchsorted(far, here + reach[who], "right")
                some = low < high
                if not some.any():
                    continue
                who = who[some]
                first, end = begin[at] + low[some].min(), begin[at] + high[some].max()
                products = _products(rows[first:end], asked[who])
                least = best.floors[who]
                if products.dtype == np.float32:  # products are whole numbers
                    least = np.ceil(least).astype(np.float32)
                row, col = np.divmod(np.flatnonzero(products >= least), len(who))
                ids = self.ids[first + row]
                other = ids != owns[who[col]]
                row, col = row[other], col[other]
                if best.add(who[col], ids[other], products[row, col]):
                    reach = space.reach(square, best.floors)
            else:
                child = np.arange(begin[at], stop[at])
                least = np.abs(here - to_parent[child, None]) - radius[child, None]
                child = child[(least <= reach[who]).any(axis=1)]
                if not len(child):
                    continue
                apart = away(child, who)
                least = apart - radius[child, None]
                can = least <= reach[who]
                for i, c in enumerate(child.tolist()):
                    some = can[i]
                    if some.any():
                        most = space.most(square[who[some]], least[i, some]).max()
                        heapq.heappush(waiting, (-most, c, who[some], apart[i, some]))

    def row(self) -> list[bytes]:
        kind = _narrow(int(self.rows.min(initial=0)), int(self.rows.max(initial=0)))
        return [x.tobytes() for x in (self.ids, self.rows.astype(kind), self.far, self.nodes)]

    @classmethod
    def of(cls, dim: int, ids: bytes, rows: bytes, far: bytes, nodes: bytes) -> Tree:
        found = np.frombuffer(ids, np.int64)
        kind = f"i{len(rows) // (len(found) * dim)}"
        return cls(
            found,
            np.frombuffer(rows, kind).reshape(len(found), dim),
            np.frombuffer(far, np.float64),
            np.frombuffer(nodes, np.float64).reshape(-1, 6),
        )


_TREE = "shelf int, place int, ids binary, rows binary, far binary, nodes binary"
_PAIR = "shelf int, block long, ask long, query_id long, q array<{}>, floor double, trees int"
_FOUND = "ask long, query_id long, vec_id long, score long"
#: Spark's and Arrow's names of the types that ``_narrow`` gives.
_TYPES = {2: ("short", pa.int16()), 4: ("int", pa.int32()), 8: ("long", pa.int64())}


def _ends(vector: str) -> tuple[Column, Column]:
    """The lowest and the highest component of a column of vectors."""
    low, high = F.min(F.array_min(vector)), F.max(F.array_max(vector))
    return low.alias("low"), high.alias("high")


def _kind(ends: Row) -> tuple[str, pa.DataType]:
    """The type of component that holds what lies between ``_ends``."""
    return _TYPES[_narrow(ends["low"] or 0, ends["high"] or 0).itemsize]


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The query block of each id; even for ids with a common factor too."""
    return (mix64(ids.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


class MTreeIndex:
    """Trees over a table of ``(vec_id, v)`` with integer vectors ``v``.

    Routing objects are a hash sample of at most ``max_regions`` rows; they and
    their radii go to every task, so ``max_regions`` times the dimension bounds
    what is broadcast. Every row is in exactly one tree of about ``tree_rows``
    rows; a region with more rows, also one of equal vectors, has several.
    Trees are numbered by region; runs of up to ``ON_SHELF`` numbers are a shelf,
    so a query's vector goes to a shelf once and not to each of its trees.
    """

    def __init__(self, points: DataFrame, tree_rows: int = 8_192, max_regions: int = 1_024):
        spark = points.sparkSession
        self.points = points
        square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
        stats = points.agg(
            F.count("*").alias("n"), F.max(square).alias("top"), F.max(F.size("v")).alias("dim"),
            *_ends("v"),
        ).first()
        self.n, self.dim = stats["n"], max(1, stats["dim"] or 1)
        self.space = Space(stats["top"] or 0)
        if not self.n:
            return
        n_regions = min(max_regions, max(1, -(-self.n // tree_rows)))
        sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_regions).toArrow()
        self.route_ids = sample.column("vec_id").to_numpy()
        self.routes = _matrix(sample.column("v"), self.dim)
        shipped = spark.sparkContext.broadcast((self.routes, self.space, self.dim))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            routes, space, dim = shipped.value
            there = space.lift(routes)
            squares = (there * there).sum(axis=1)
            for batch in batches:
                here = space.lift(_matrix(batch.column(1), dim))
                region = (squares - 2 * here @ there.T).argmin(axis=1)
                far = np.sqrt(((here - there[region]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(region.astype(np.int32)), pa.array(far)],
                    ["vec_id", "v", "region", "far"],
                )

        parts = points.select("vec_id", "v").mapInArrow(
            assign, "vec_id long, v array<long>, region int, far double"
        )
        parts = materialize(parts, "mtree-regions")
        radius, subs = np.zeros(n_regions), np.zeros(n_regions, np.int64)
        sizes = parts.groupBy("region").agg(F.count("*").alias("n"), F.max("far").alias("far"))
        for r in sizes.collect():  # at most max_regions rows
            radius[r["region"]], subs[r["region"]] = r["far"], -(-r["n"] // tree_rows)
        self.radius, self.subs = radius, subs
        self.on_shelf = on_shelf = int(min(ON_SHELF, max(1, subs.sum() // SHELVES)))
        start = np.cumsum(subs) - subs
        several = F.element_at(F.array(*(F.lit(int(s)) for s in subs)), F.col("region") + 1)
        space, dim = self.space, self.dim

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            tree = Tree.build(
                rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), dim), space
            )
            shelf, place = divmod(int(start[key[0].as_py()]) + key[1].as_py(), on_shelf)
            return pa.table(
                [pa.array([shelf], pa.int32()), pa.array([place], pa.int32()),
                 *(pa.array([x], pa.binary()) for x in tree.row())],
                ["shelf", "place", "ids", "rows", "far", "nodes"],
            )

        sub = F.pmod(F.xxhash64("vec_id"), several).cast("int")
        v = F.col("v").cast(f"array<{_kind(stats)[0]}>").alias("v")
        keyed = parts.select("vec_id", v, "region", sub.alias("sub"))
        self.trees = materialize(keyed.groupBy("region", "sub").applyInArrow(build, _TREE), "mtrees")

    def _visit(self, pairs: DataFrame, k: int, dive: bool) -> DataFrame:
        space, dim = self.space, self.dim

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            who = ids = products = np.empty(0, np.int64)
            owns = right.column("query_id").to_numpy()
            if left.num_rows and right.num_rows:
                queries = _matrix(right.column("q"), dim)
                trees = right.column("trees").to_numpy()
                best = Best(right.column("floor").to_numpy(), k)
                packed = (left.column(c) for c in ("place", "ids", "rows", "far", "nodes"))
                for place, *tree in zip(*packed, strict=True):
                    asking = np.flatnonzero(trees >> place.as_py() & 1)
                    if len(asking):
                        Tree.of(dim, *(x.as_py() for x in tree)).search_all(
                            queries, owns, asking, best, space, dive
                        )
                who, ids, products = best.settle()
            asks = right.column("ask").to_numpy()
            columns = [asks[who], owns[who], ids, products]
            names = ["ask", "query_id", "vec_id", "score"]
            return pa.table([pa.array(c, pa.int64()) for c in columns], names)

        keys = ["shelf", "block"]
        pairs = materialize(pairs, "mtree-pairs")
        # a shelf goes to the blocks of queries that visit it, and to no other
        asked = pairs.select(*(F.col(c).alias(c) for c in keys)).distinct()
        copies = self.trees.join(F.broadcast(asked), "shelf")
        return copies.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(search, _FOUND)

    def search(self, queries: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
        """``(query_id, rank, vec_id, score)``: the ``k`` highest products with rows of other ids.

        ``queries`` holds ``(query_id, q)``. First each query searches the trees
        of its own region; the ``k``-th product found rules out most others
        where vectors lie in clusters. Where they do not, nearly all rows are
        visited, and the time grows with rows times queries. Ties go to the
        smaller id. A tree meets at most about ``block_rows`` queries in a task,
        or as many as have two million elements; for more, it is sent again.
        """
        spark = queries.sparkSession
        schema = "query_id long, rank int, vec_id long, score long"
        if not self.n:
            return spark.createDataFrame([], schema)
        stats = queries.agg(F.count("*").alias("n"), *_ends("q")).first()
        blocks = max(1, -(-stats["n"] // (block_rows or max(1, BLOCK_ELEMENTS // self.dim))))
        kind, arrow = _kind(stats)
        state = (self.routes, self.route_ids, self.radius, self.subs, self.space, self.dim)
        shipped = spark.sparkContext.broadcast(state)
        on_shelf = self.on_shelf

        def pairs(home: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                routes, route_ids, radius, subs, space, dim = shipped.value
                bits = 1 << np.arange(on_shelf)
                spare = -int(subs.sum()) % on_shelf
                parts = (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024))
                for part in parts:
                    own, floors = part.column(1).to_numpy(), part.column(3).to_numpy()
                    q = _matrix(part.column(2), dim)
                    products = _products(*_exact(q, routes)).astype(np.float64)
                    square = (q.astype(np.float64) ** 2).sum(axis=1)
                    total = square[:, None] + space.top
                    apart = np.sqrt(np.maximum(0.0, total - 2.0 * products))
                    nearest = np.arange(len(routes)) == apart.argmin(axis=1)[:, None]
                    can = nearest
                    if len(routes) >= k:  # routing objects are rows too
                        products[route_ids == own[:, None]] = -np.inf
                        floors = np.maximum(floors, np.partition(products, -k, axis=1)[:, -k])
                    if not home:
                        can = (apart - radius <= space.reach(square, floors)[:, None]) & ~nearest
                    trees = np.pad(np.repeat(can, subs, axis=1), ((0, 0), (0, spare)))
                    trees = trees.reshape(len(q), -1, on_shelf) @ bits
                    row, shelf = np.nonzero(trees)
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shelf, pa.int32()), pa.array(block_of(own, blocks)[row]),
                         *taken.columns[:2], taken.column(2).cast(pa.list_(arrow)),
                         pa.array(floors[row]), pa.array(trees[row, shelf], pa.int32())],
                        ["shelf", "block", "ask", "query_id", "q", "floor", "trees"],
                    )

            return run

        low = F.lit(float("-inf")).alias("floor")
        asked = queries.select("query_id", F.col("q").cast(f"array<{kind}>").alias("q")).distinct()
        # one number for each distinct query: an id may come with several vectors
        asked = asked.select(F.monotonically_increasing_id().alias("ask"), "query_id", "q")
        asked = materialize(asked, "mtree-queries")
        pair = _PAIR.format(kind)
        first = asked.select("ask", "query_id", "q", low).mapInArrow(pairs(True), pair)
        near = materialize(self._visit(first, k, True), "mtree-home")
        best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
        ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        reached = ranked.where(F.col("rank") == k).select("ask", "score")
        floors = asked.join(reached, "ask", "left").select(
            "ask", "query_id", "q", F.coalesce(F.col("score").cast("double"), low).alias("floor")
        )
        rest = self._visit(floors.mapInArrow(pairs(False), pair), k, False)
        found = ranked.drop("rank").unionByName(rest)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_products(
    rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
    k: int = 5, every: int = 50,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of every row whose id is divisible by ``every``.

    Components become ``floor(scale * x)``; scores are integer inner products
    with all rows of other ids, the ``k`` highest, ties to the smaller id; all
    if there are fewer. Rows without id, or whose vector is null or holds
    null, NaN or infinity, take no part. Shorter vectors count as ending in
    zeros. A repeated row is one query and several candidates. Products must
    fit a long. An empty table has no result. Other columns are not read.
    """
    fine = valid_vectors(rows.select(key, vector), key, vector)
    points = fine.select(
        F.col(key).cast("long").alias("vec_id"), floor_scaled(F.col(vector), scale).alias("v")
    )
    points = materialize(points, "points")
    asked = points.where(F.col("vec_id") % every == 0)
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return MTreeIndex(points).search(queries, k)
