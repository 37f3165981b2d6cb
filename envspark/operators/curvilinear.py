"""Grids without a formula: each node has a longitude and latitude of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.operators.grids import dealt

#: How far off its nearest node a point may lie (in that node's spacing), how many nodes past the outer ones a place may lie,
#: how far out of a cell a point still counts as in it, and the least cosine between a point and a corner.
REACH, MARGIN, IN_CELL, LEAST_COSINE = 3.0, 2.0, 1e-9, 0.5
_CORNERS = ((0, 0), (1, 0), (0, 1), (1, 1))


def _unit(lon: Column, lat: Column) -> list[Column]:
    x, y = F.radians(lon), F.radians(lat)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def _xyz(name: str) -> list[Column]:
    return [F.col(f"{name}.{c}") for c in "xyz"]


def nodes_of(grid: DataFrame) -> DataFrame:
    """(col, row, at) of a grid (col, row, lon, lat); nodes without a position are left out."""
    ok = ~F.isnan("lon") & ~F.isnan("lat") & (F.abs("lon") < float("inf")) & (F.abs("lat") <= 90)
    where = F.struct(*[v.alias(c) for c, v in zip("xyz", _unit(F.col("lon"), F.col("lat")))])
    return grid.filter(ok).select(F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), where.alias("at"))


def cells_of(nodes: DataFrame) -> DataFrame:
    """(col, row, c0, c1, c2, c3) of nodes: cells by their first corner, with the corners along the row, then along the next one."""
    part = F.explode(F.array(*[F.struct((F.col("col") - i).alias("col"), (F.col("row") - j).alias("row"), F.lit(k).alias("k")) for k, (i, j) in enumerate(_CORNERS)]))
    corner = nodes.select(part.alias("p"), "at").select("p.col", "p.row", "p.k", "at")
    cells = corner.groupBy("col", "row").agg(*[F.first(F.when(F.col("k") == k, F.col("at")), ignorenulls=True).alias(f"c{k}") for k in range(4)])
    return cells.dropna(subset=["c0", "c1", "c2", "c3"])


def _placed(lon: Column, lat: Column) -> Column:
    """(s, t) of a point in the cell c0 to c3, by the bilinear map of the corners' places on the plane that touches the globe at the point; null where there is none."""
    x, y = F.radians(lon), F.radians(lat)
    p = _unit(lon, lat)
    east, north = [-F.sin(x), F.cos(x), F.lit(0.0)], [-F.sin(y) * F.cos(x), -F.sin(y) * F.sin(x), F.cos(y)]
    seen = F.transform(F.array(*[F.col(f"c{k}") for k in range(4)]), lambda q: F.struct(_dot([q.x, q.y, q.z], p).alias("d"), _dot([q.x, q.y, q.z], east).alias("e"), _dot([q.x, q.y, q.z], north).alias("n")))
    flat = F.when(F.forall(seen, lambda q: q.d >= LEAST_COSINE), F.transform(seen, lambda q: F.struct((q.e / q.d).alias("e"), (q.n / q.d).alias("n"))))
    at = lambda m, k: [m[k]["e"], m[k]["n"]]
    less = lambda a, b: [a[0] - b[0], a[1] - b[1]]

    def solve(m: Column) -> Column:
        a, b, c, d = (at(m, k) for k in range(4))
        e1, e2 = less(b, a), less(c, a)
        return F.struct(*[F.struct(v[0].alias("e"), v[1].alias("n")).alias(n) for n, v in (("a", a), ("e1", e1), ("e2", e2), ("e3", less(less(d, b), e2)))])

    def roots(q: Column) -> Column:
        a, e1, e2, e3 = ([q[n]["e"], q[n]["n"]] for n in ("a", "e1", "e2", "e3"))
        k2, k1, k0 = _cross(e1, e3), _cross(a, e3) + _cross(e1, e2), _cross(a, e2)
        h = -(k1 + F.when(k1 < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(k1 * k1 - 4 * k2 * k0, F.lit(0.0)))) / 2
        return F.transform(F.array(F.try_divide(k0, h), F.try_divide(h, k2)), lambda s: F.struct(s.alias("s"), _along(a, e1, e2, e3, s).alias("t")))

    def _along(a, e1, e2, e3, s):
        w = [e2[0] + s * e3[0], e2[1] + s * e3[1]]
        v = [a[0] + s * e1[0], a[1] + s * e1[1]]
        return F.try_divide(-(v[0] * w[0] + v[1] * w[1]), w[0] * w[0] + w[1] * w[1])

    one = lambda v, f: F.transform(F.array(v), f)[0]  # noqa: E731  (names a value once, as its expression is used often)
    both = one(one(flat, solve), roots)
    off = lambda r: F.greatest(F.abs(r.s - 0.5), F.abs(r.t - 0.5))
    ranked = F.filter(both, lambda r: r.s.isNotNull() & r.t.isNotNull())
    return F.array_min(F.transform(ranked, lambda r: F.struct(off(r).alias("off"), r.s.alias("s"), r.t.alias("t"))))


def _buckets(low: list[Column], high: list[Column], size: float) -> Column:
    """Boxes of the given size that a box of space meets."""
    spans = [F.sequence(F.floor(a / size), F.floor(b / size)) for a, b in zip(low, high)]
    return F.flatten(F.transform(spans[0], lambda x: F.flatten(F.transform(spans[1], lambda y: F.transform(spans[2], lambda z: F.struct(x.alias("bx"), y.alias("by"), z.alias("bz")))))))


def _listed(df: DataFrame, low: list[Column], high: list[Column], size: float) -> DataFrame:
    return df.withColumn("_b", F.explode(_buckets(low, high, size))).select("*", "_b.*").drop("_b")


def locate(points: DataFrame, grid: DataFrame, n_col: int, n_row: int) -> DataFrame:
    """(id, col, row): where points (id, lon, lat) lie on a grid (col, row, lon, lat) of n_col by n_row nodes, whole numbers on its nodes; null off it.

    A point takes the cell that holds it (on a border the smallest row, then column). One in no cell takes the outer cell beside its nearest
    node, if no farther from it than three of its spacings and no more than two nodes past the edge; beside a node without a position there
    is no such cell. Cells are found through boxes of space, so that neither poles nor the antimeridian are special. ids are unique, as are nodes.
    """
    nodes = nodes_of(grid)
    cells = cells_of(nodes).filter(F.col("col").between(0, n_col - 2) & F.col("row").between(0, n_row - 2))
    corners = [_xyz(f"c{k}") for k in range(4)]
    low, high = [F.least(*[c[i] for c in corners]) for i in range(3)], [F.greatest(*[c[i] for c in corners]) for i in range(3)]
    wide = F.greatest(*[b - a for a, b in zip(low, high)])
    size = cells.agg(F.percentile_approx(wide, 0.5)).first()[0]
    if not size:  # no cell at all, or all in one point
        return points.select("id", F.lit(None).cast("double").alias("col"), F.lit(None).cast("double").alias("row"))
    size = 2 * float(size)
    bulge = 0.75 * wide * wide + 1e-9  # a cell bends out of the box of its corners by less than a quarter of its squared diagonal
    ok = ~F.isnan("lon") & ~F.isnan("lat") & (F.abs("lon") < float("inf")) & (F.abs("lat") <= 90)
    p = _unit(F.col("lon"), F.col("lat"))
    at = dealt(points.filter(ok)).select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    at = at.withColumns({b: F.floor(v / size) for b, v in zip(("bx", "by", "bz"), p)})
    near = at.join(_listed(cells, [a - bulge for a in low], [b + bulge for b in high], size), ["bx", "by", "bz"]).withColumn("in", F.explode(F.array(_placed(F.col("lon"), F.col("lat")))))  # a generator, so that no filter works it out again
    held = near.filter(F.col("in.off") <= 0.5 + IN_CELL).groupBy("id").agg(F.min(F.struct("row", "col", F.col("in.s").alias("s"), F.col("in.t").alias("t"))).alias("c"))
    inside = held.select("id", (F.col("c.col") + F.col("c.s")).alias("col"), (F.col("c.row") + F.col("c.t")).alias("row"))

    # only nodes that fewer than four cells meet can be nearest to a point in no cell
    whole = cells.select(F.explode(F.array(*[F.struct((F.col("col") + i).alias("col"), (F.col("row") + j).alias("row")) for i, j in _CORNERS])).alias("n")).groupBy("n.col", "n.row").count().filter("count = 4")
    sides = F.explode(F.array(*[F.struct((F.col("col") + i).alias("col"), (F.col("row") + j).alias("row")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    met = nodes.select(sides.alias("n"), "at", "col", "row").select("n.*", "at", ((F.col("n.col") == F.col("col")) & (F.col("n.row") == F.col("row"))).alias("own"))
    around = met.groupBy("col", "row").agg(F.first(F.when(F.col("own"), F.col("at")), ignorenulls=True).alias("at"), F.collect_list(F.when(~F.col("own"), F.col("at"))).alias("sides"))  # four at most
    apart = lambda a, b: F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))
    mine = _xyz("at")
    edge = around.filter("at is not null").join(whole, ["col", "row"], "left_anti").select("col", "row", "at", (REACH * F.array_max(F.transform("sides", lambda q: apart(mine, [q.x, q.y, q.z])))).alias("reach")).filter("reach > 0")
    rest = at.join(inside, "id", "left_anti")
    around_edge = _listed(edge, [v - F.col("reach") for v in mine], [v + F.col("reach") for v in mine], size)
    nearest = rest.join(around_edge, ["bx", "by", "bz"]).withColumn("d", apart(mine, p))
    nearest = nearest.groupBy("id", "lon", "lat").agg(F.min(F.struct("d", "row", "col", "reach")).alias("n")).filter("n.d <= n.reach")
    beside = nearest.select("id", "lon", "lat", F.explode(F.array(*[F.struct((F.col("n.col") - i).alias("col"), (F.col("n.row") - j).alias("row")) for i, j in _CORNERS])).alias("c")).select("id", "lon", "lat", "c.*")
    tried = beside.join(cells, ["col", "row"]).withColumn("in", F.explode(F.array(_placed(F.col("lon"), F.col("lat")))))  # a generator, so that no filter works it out again

    def may(axis: str, share: str, n: int) -> Column:
        over = F.col(f"in.{share}")
        return ((over >= -IN_CELL) | (F.col(axis) == 0) & (over >= -MARGIN)) & ((over <= 1 + IN_CELL) | (F.col(axis) == n - 2) & (over <= 1 + MARGIN))

    past = tried.filter(may("col", "s", n_col) & may("row", "t", n_row)).groupBy("id").agg(F.min(F.struct("row", "col", F.col("in.s").alias("s"), F.col("in.t").alias("t"))).alias("c"))
    outside = past.select("id", (F.col("c.col") + F.col("c.s")).alias("col"), (F.col("c.row") + F.col("c.t")).alias("row"))
    return points.select("id").join(inside.union(outside), "id", "left")
