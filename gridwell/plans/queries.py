"""One query per operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwell import functions as G
from gridwell.operators import clustering as C
from gridwell.operators import neighbors as N
from gridwell.operators.cells import cell_links
from gridwell.operators.components import connected_components, reachable, with_edges
from gridwell.operators.nearest import core_distances, k_nearest, k_nearest_anywhere
from gridwell.operators.partitioner import Partitions, leaf_copies, plan_partitions, replicate
from gridwell.operators.rectangles import points_in, rectangles_in
from gridwell.session import ship, written
from gridwell.sources import points
from gridwell.sources.sink import labelled_points, labelled_text

EPS, MIN_POINTS = 0.03, 5
SIDE = 2 * EPS
#: Fixed rectangles (pid, x, y, x2, y2) that queries on rectangles use.
BOXES = [(0, -0.5, -0.5, 0.0, 0.0), (1, 0.0, -0.5, 0.5, 0.0), (2, -0.5, 0.0, 0.5, 0.5), (3, -0.25, -0.25, 0.25, 0.25)]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_EMB = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings"
_PART = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part"
_D = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)"
_E = f"CAST({EPS} AS DOUBLE)"
_CELL = f"CAST(floor(x / CAST({SIDE} AS DOUBLE)) AS BIGINT) AS cx, CAST(floor(y / CAST({SIDE} AS DOUBLE)) AS BIGINT) AS cy"
_NB = f"pts AS ({_EMB}), nb AS (SELECT a.id AS i, b.id AS j, {_D} AS d2 FROM pts a JOIN pts b ON {_D} <= {_E}*{_E})"
_HIST = f"pts AS ({_EMB}), h AS (SELECT {_CELL}, count(*) AS n FROM pts GROUP BY ALL)"
_BOXES = "b(pid, x, y, x2, y2) AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, {', '.join(f'CAST({v} AS DOUBLE)' for v in r)})" for p, *r in BOXES) + "))"
_DB = f"""
WITH RECURSIVE {_NB},
core AS (SELECT i AS id FROM nb GROUP BY i HAVING count(*) >= {MIN_POINTS}),
e AS (SELECT nb.i, nb.j FROM nb JOIN core a ON nb.i = a.id JOIN core b ON nb.j = b.id),
cc(id, comp) USING KEY (id) AS (
  SELECT id, id FROM core UNION
  SELECT e.j, min(cc.comp) FROM cc JOIN e ON cc.id = e.i JOIN recurring.cc r ON r.id = e.j WHERE cc.comp < r.comp GROUP BY e.j
),
comp AS (SELECT id, min(comp) AS comp FROM cc GROUP BY id),
k AS (SELECT comp, row_number() OVER (ORDER BY comp) AS cluster_id FROM (SELECT DISTINCT comp FROM comp)),
bo AS (SELECT nb.i AS id, min(comp.comp) AS comp FROM nb JOIN comp ON nb.j = comp.id GROUP BY nb.i),
lab AS (
  SELECT p.id, p.label, CASE WHEN c.id IS NOT NULL THEN 'CORE' WHEN bo.id IS NOT NULL THEN 'BORDER' ELSE 'NOISE' END AS flag,
    CAST(coalesce(k.cluster_id, 0) AS BIGINT) AS cluster_id
  FROM pts p LEFT JOIN core c ON c.id = p.id LEFT JOIN bo ON bo.id = p.id LEFT JOIN comp m ON m.id = p.id
  LEFT JOIN k ON k.comp = coalesce(m.comp, bo.comp)
)
"""
_OPT = f"""
WITH RECURSIVE pts AS ({_EMB}),
nb AS MATERIALIZED (SELECT a.id AS i, b.id AS j, sqrt({_D}) AS d FROM pts a JOIN pts b ON {_D} <= {_E}*{_E}),
cd AS MATERIALIZED (SELECT i AS id, max(d) FILTER (rn = {MIN_POINTS}) AS cdist FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM nb) GROUP BY i),
st(id, reach, pos, done, step) USING KEY (id) AS (
  SELECT id, CAST('infinity' AS DOUBLE), CAST(-1 AS BIGINT), false, CAST(0 AS BIGINT) FROM pts
  UNION
  (WITH nxt AS (SELECT id FROM recurring.st WHERE NOT done ORDER BY reach, id LIMIT 1),
    k AS (SELECT coalesce(max(pos), -1) + 1 AS p FROM recurring.st)
   SELECT r.id, CASE WHEN r.id = n.id THEN r.reach ELSE least(r.reach, greatest(cd.cdist, nb.d)) END,
     CASE WHEN r.id = n.id THEN k.p ELSE r.pos END, r.id = n.id, k.p
   FROM nxt n CROSS JOIN k JOIN nb ON nb.i = n.id JOIN recurring.st r ON r.id = nb.j LEFT JOIN cd ON cd.id = n.id
   WHERE r.id = n.id OR (NOT r.done AND cd.cdist IS NOT NULL))
),
o AS (
  SELECT st.id, pos, nullif(reach, CAST('infinity' AS DOUBLE)) AS reach, cd.cdist, pts.x, pts.y,
    sqrt((pts.x - lag(pts.x) OVER (ORDER BY pos)) * (pts.x - lag(pts.x) OVER (ORDER BY pos)) + (pts.y - lag(pts.y) OVER (ORDER BY pos)) * (pts.y - lag(pts.y) OVER (ORDER BY pos))) AS gap
  FROM st JOIN pts USING (id) LEFT JOIN cd USING (id)
),
f AS (SELECT *, CASE WHEN cdist IS NOT NULL THEN 'CORE' WHEN reach IS NOT NULL THEN 'BORDER' ELSE 'NOISE' END AS flag FROM o)
"""

MOST = 150
_INSIDE = "h.cx >= b.x AND h.cx < b.x2 AND h.cy >= b.y AND h.cy < b.y2"
# the partitions, as boxes of cells, by repeated bisection; then their occupied cells and all copies of points
_PARTS = f"""
WITH RECURSIVE {_HIST},
box(x, y, x2, y2, n) AS (
  SELECT min(cx), min(cy), max(cx) + 1, max(cy) + 1, CAST(sum(n) AS BIGINT) FROM h
  UNION ALL
  SELECT * FROM (
    WITH m AS (
      SELECT b.*, 0 AS axis, h.cx + 1 AS position, sum(h.n) AS k FROM box b JOIN h ON {_INSIDE} WHERE b.n > {MOST} GROUP BY ALL
      UNION ALL SELECT b.*, 1, h.cy + 1, sum(h.n) FROM box b JOIN h ON {_INSIDE} WHERE b.n > {MOST} GROUP BY ALL
    ),
    s AS (SELECT *, CAST(sum(k) OVER (PARTITION BY x, y, x2, y2, axis ORDER BY position) AS BIGINT) AS n_before FROM m),
    c AS (
      SELECT *, row_number() OVER (PARTITION BY x, y, x2, y2 ORDER BY abs(n // 2 - n_before), axis, position) AS best
      FROM s WHERE position < CASE axis WHEN 0 THEN x2 ELSE y2 END
    ),
    t AS (
      SELECT x, y, CASE axis WHEN 0 THEN position ELSE x2 END AS x2, CASE axis WHEN 1 THEN position ELSE y2 END AS y2, n_before AS n FROM c WHERE best = 1
      UNION ALL SELECT CASE axis WHEN 0 THEN position ELSE x END, CASE axis WHEN 1 THEN position ELSE y END, x2, y2, n - n_before FROM c WHERE best = 1
    )
    SELECT * FROM t WHERE n > 0
  )
),
leaf AS (
  SELECT b.* FROM box b WHERE n <= {MOST} OR NOT EXISTS (SELECT 1 FROM h WHERE {_INSIDE} AND (h.cx + 1 < b.x2 OR h.cy + 1 < b.y2))
),
part AS (SELECT CAST(row_number() OVER (ORDER BY x, y) - 1 AS INTEGER) AS pid, * FROM leaf),
cell AS (SELECT b.pid, h.cx, h.cy FROM part b JOIN h ON {_INSIDE}),
copy AS (
  SELECT c.pid, p.id, any_value(p.x) AS x, any_value(p.y) AS y, bool_or(floor(p.x / CAST({SIDE} AS DOUBLE)) = c.cx AND floor(p.y / CAST({SIDE} AS DOUBLE)) = c.cy) AS home
  FROM pts p JOIN cell c ON p.x BETWEEN c.cx * CAST({SIDE} AS DOUBLE) - CAST({EPS * (1 + 1e-9)!r} AS DOUBLE) AND (c.cx + 1) * CAST({SIDE} AS DOUBLE) + CAST({EPS * (1 + 1e-9)!r} AS DOUBLE)
    AND p.y BETWEEN c.cy * CAST({SIDE} AS DOUBLE) - CAST({EPS * (1 + 1e-9)!r} AS DOUBLE) AND (c.cy + 1) * CAST({SIDE} AS DOUBLE) + CAST({EPS * (1 + 1e-9)!r} AS DOUBLE)
  GROUP BY c.pid, p.id
)
"""


def _merged(any_shared: bool) -> str:
    """The clusters of each partition's copies, the links between them, and what they make."""
    return f"""{_PARTS},
nb AS MATERIALIZED (SELECT a.pid, a.id AS i, b.id AS j FROM copy a JOIN copy b ON a.pid = b.pid AND {_D} <= {_E}*{_E}),
core AS MATERIALIZED (SELECT pid, i AS id FROM nb GROUP BY pid, i HAVING count(*) >= {MIN_POINTS}),
e AS MATERIALIZED (SELECT nb.* FROM nb JOIN core a ON nb.pid = a.pid AND nb.i = a.id JOIN core b ON nb.pid = b.pid AND nb.j = b.id),
lc(pid, id, cluster) USING KEY (pid, id) AS (
  SELECT pid, id, id FROM core UNION
  SELECT e.pid, e.j, min(lc.cluster) FROM lc JOIN e ON lc.pid = e.pid AND lc.id = e.i JOIN recurring.lc r ON r.pid = e.pid AND r.id = e.j
  WHERE lc.cluster < r.cluster GROUP BY e.pid, e.j
),
own AS MATERIALIZED (SELECT pid, id, min(cluster) AS cluster FROM lc GROUP BY pid, id),
next_to AS MATERIALIZED (SELECT DISTINCT nb.i AS id, own.cluster FROM nb JOIN own ON nb.pid = own.pid AND nb.j = own.id
  WHERE NOT EXISTS (SELECT 1 FROM core WHERE core.pid = nb.pid AND core.id = nb.i) UNION SELECT id, cluster FROM own),
at_home AS MATERIALIZED (SELECT core.id FROM core JOIN copy USING (pid, id) WHERE copy.home),
adjacent AS MATERIALIZED (
  SELECT DISTINCT a.src, b.cluster AS dst FROM (SELECT id, min(cluster) AS src FROM next_to GROUP BY id) a JOIN next_to b USING (id)
  WHERE a.src <> b.cluster {"" if any_shared else "AND a.id IN (SELECT id FROM at_home)"}
),
link AS MATERIALIZED (SELECT src, dst FROM adjacent UNION SELECT dst, src FROM adjacent),
gm(cluster, component) USING KEY (cluster) AS (
  SELECT DISTINCT cluster, cluster FROM own UNION
  SELECT link.dst, min(gm.component) FROM gm JOIN link ON gm.cluster = link.src JOIN recurring.gm r ON r.cluster = link.dst WHERE gm.component < r.component GROUP BY link.dst
),
whole AS MATERIALIZED (SELECT cluster, min(component) AS component FROM gm GROUP BY cluster),
named AS MATERIALIZED (SELECT id, min(component) AS component FROM next_to JOIN whole USING (cluster) GROUP BY id),
numbered AS (SELECT component, row_number() OVER (ORDER BY component) AS cluster_id FROM (SELECT DISTINCT component FROM named)),
lab AS (
  SELECT p.id, CASE WHEN p.id IN (SELECT id FROM at_home) THEN 'CORE' WHEN n.id IS NOT NULL THEN 'BORDER' ELSE 'NOISE' END AS flag,
    CAST(coalesce(k.cluster_id, 0) AS BIGINT) AS cluster_id
  FROM pts p LEFT JOIN named n ON n.id = p.id LEFT JOIN numbered k ON k.component = n.component
)
"""


def micro(c: Column, name: str) -> Column:
    """Millionths, as a long: the same whatever the last bits are."""
    return F.floor(c * 1e6 + 0.5).cast("long").alias(name)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "emb2d")


def boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOXES, "pid int, x double, y double, x2 double, y2 double")


def _band(found: DataFrame) -> DataFrame:
    """Of points in rectangles those that are not further than eps from an edge."""
    return found.where(~G.contains_open(F.col("px"), F.col("py"), G.shrink(F.col("r"), EPS))).select("pid", "id")


def _inner(points: DataFrame, rectangles: DataFrame) -> DataFrame:
    r = G.shrink(F.struct("x", "y", "x2", "y2"), EPS)
    return points_in(points, rectangles.select("pid", r.alias("r")).select("pid", "r.*"), closed=False).select("pid", "id")


@query(f"WITH pts AS ({_PART}) SELECT id, x, y FROM pts")
def points_scan(spark, sf):
    return points(spark, sf, "part2d")


@query(f"WITH pts AS ({_PART}) SELECT DISTINCT x, y FROM pts")
def points_distinct(spark, sf):
    return points(spark, sf, "part2d").select("x", "y").distinct()


@query(f"WITH pts AS ({_EMB}) SELECT min(x) AS x, min(y) AS y, max(x) AS x2, max(y) AS y2, count(*) AS n FROM pts")
def points_bounding_box(spark, sf):
    return emb(spark, sf).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("n"))


@query(f"WITH pts AS ({_EMB}) SELECT id, {_CELL} FROM pts")
def cell_assign(spark, sf):
    return N.with_cells(emb(spark, sf), SIDE).select("id", "cx", "cy")


@query(f"WITH {_HIST} SELECT * FROM h")
def cell_histogram(spark, sf):
    return N.histogram(emb(spark, sf), SIDE)


@query(f"WITH pts AS ({_EMB}), {_BOXES} SELECT pid, id FROM pts p JOIN b ON p.x BETWEEN b.x AND b.x2 AND p.y BETWEEN b.y AND b.y2")
def rect_contains_closed(spark, sf):
    return points_in(emb(spark, sf), boxes(spark)).select("pid", "id")


@query(f"WITH pts AS ({_EMB}), {_BOXES} SELECT pid, id FROM pts p JOIN b ON p.x > b.x AND p.x < b.x2 AND p.y > b.y AND p.y < b.y2")
def rect_contains_open(spark, sf):
    return points_in(emb(spark, sf), boxes(spark), closed=False).select("pid", "id")


_CAND = f"""WITH {_HIST}, t AS (SELECT sum(n) AS n, max(cx) AS mx, max(cy) AS my FROM h),
s AS (
  SELECT 0 AS axis, cx + 1 AS position, sum(sum(n)) OVER (ORDER BY cx) AS n_before FROM h GROUP BY cx
  UNION ALL SELECT 1, cy + 1, sum(sum(n)) OVER (ORDER BY cy) FROM h GROUP BY cy
),
c AS (SELECT CAST(abs(t.n // 2 - n_before) AS BIGINT) AS cost, axis, position, CAST(n_before AS BIGINT) AS n_before FROM s, t WHERE position <= CASE axis WHEN 0 THEN mx ELSE my END)
SELECT * FROM c"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Costs of all splits, as window sums over the histogram's two marginal counts."""
    h = N.histogram(emb(spark, sf), SIDE)
    total = h.agg(F.sum("n").alias("total"), F.max("cx").alias("m0"), F.max("cy").alias("m1"))
    parts = []
    for axis, c in enumerate(("cx", "cy")):
        before = F.sum("n").over(Window.orderBy("position"))
        marginal = h.groupBy((F.col(c) + 1).alias("position")).agg(F.sum("n").alias("n"))
        parts.append(marginal.select(F.lit(axis).alias("axis"), "position", before.alias("n_before")))
    s = parts[0].union(parts[1]).join(F.broadcast(total))
    cost = F.abs(F.expr("total div 2") - F.col("n_before")).alias("cost")
    return s.where(F.col("position") <= F.when(F.col("axis") == 0, F.col("m0")).otherwise(F.col("m1"))).select(cost, "axis", "position", "n_before")


@query(_CAND)
def split_candidates(spark, sf):
    return _candidates(spark, sf)


@query(_CAND + " ORDER BY cost, axis, position LIMIT 1")
def best_split(spark, sf):
    return _candidates(spark, sf).orderBy("cost", "axis", "position").limit(1)


def _plan(spark: SparkSession, sf: str) -> Partitions:
    return plan_partitions(spark, emb(spark, sf), EPS, MOST)


@query(_PARTS + "SELECT pid, x AS cx, y AS cy, x2 AS cx2, y2 AS cy2, n FROM part")
def even_split_partitions(spark, sf):
    return _plan(spark, sf).boxes


@query(_PARTS + "SELECT pid, cx, cy FROM cell")
def partition_cells(spark, sf):
    return _plan(spark, sf).cells.select("pid", "cx", "cy")


@query(_PARTS + "SELECT pid, id, home FROM copy")
def replicate_outer(spark, sf):
    return replicate(emb(spark, sf), _plan(spark, sf), EPS).select("pid", "id", "home")


# the planned partitions as rectangles, and the same with all sides moved
_RECT = f"{_PARTS}, S(s) AS (SELECT CAST({SIDE} AS DOUBLE)), b AS (SELECT pid, x * s AS x, y * s AS y, x2 * s AS x2, y2 * s AS y2 FROM part, S) "
_IN = "p.x > b.x + {e} AND p.x < b.x2 - {e} AND p.y > b.y + {e} AND p.y < b.y2 - {e}".format(e=_E)


def _rectangles(spark: SparkSession, sf: str) -> DataFrame:
    side = F.lit(SIDE)
    return _plan(spark, sf).boxes.select("pid", *((F.col(c) * side).alias(n) for c, n in (("cx", "x"), ("cy", "y"), ("cx2", "x2"), ("cy2", "y2"))))


@query(_RECT + f"SELECT pid, x + {_E} AS ix, y + {_E} AS iy, x2 - {_E} AS ix2, y2 - {_E} AS iy2, x - {_E} AS ox, y - {_E} AS oy, x2 + {_E} AS ox2, y2 + {_E} AS oy2 FROM b")
def rect_margins(spark, sf):
    rows = _rectangles(spark, sf).select("pid", F.struct("x", "y", "x2", "y2").alias("r"))
    inner, outer = G.shrink(F.col("r"), EPS), G.shrink(F.col("r"), -EPS)
    return rows.select("pid", *(inner[c].alias("i" + c) for c in ("x", "y", "x2", "y2")), *(outer[c].alias("o" + c) for c in ("x", "y", "x2", "y2")))


@query(_RECT + f"SELECT a.pid AS outer_pid, b.pid AS inner_pid FROM b a JOIN b ON a.x <= b.x + {_E} AND a.y <= b.y + {_E} AND a.x2 >= b.x2 - {_E} AND a.y2 >= b.y2 - {_E}")
def rect_in_rect(spark, sf):
    """Partitions in partitions, the inner ones without a margin of eps."""
    rows = _rectangles(spark, sf)
    return rectangles_in(rows, rows.select("pid", G.shrink(F.struct("x", "y", "x2", "y2"), EPS).alias("r")).select("pid", "r.*"))


@query(_RECT + "SELECT pid, id FROM pts p JOIN b ON p.x BETWEEN b.x AND b.x2 AND p.y BETWEEN b.y AND b.y2")
def partition_points(spark, sf):
    return points_in(emb(spark, sf), _rectangles(spark, sf)).select("pid", "id")


@query(_RECT + f"SELECT pid, id FROM pts p JOIN b ON p.x BETWEEN b.x AND b.x2 AND p.y BETWEEN b.y AND b.y2 AND NOT ({_IN})")
def partition_band(spark, sf):
    return _band(points_in(emb(spark, sf), _rectangles(spark, sf)))


@query(_RECT + f"SELECT pid, id FROM pts p JOIN b ON {_IN}")
def partition_inner(spark, sf):
    return _inner(emb(spark, sf), _rectangles(spark, sf))


# cells of more than FEW points as the leaves of quadtrees
FEW, HALVINGS = 6, 5
_M = f"(CAST({SIDE} AS DOUBLE) / (1 << %s))"
_SPREAD = "min(p.x) < max(p.x) OR min(p.y) < max(p.y)"
_LEAVES = _PARTS.replace(f"> {MOST}", f"> {FEW}").replace(f"<= {MOST}", f"<= {FEW}") + f""",
q(depth, lx, ly, n, spread) AS (
  SELECT 0, h.cx, h.cy, b.n, {_SPREAD} FROM part b JOIN h ON {_INSIDE} JOIN pts p ON floor(p.x / {_M % 0}) = h.cx AND floor(p.y / {_M % 0}) = h.cy WHERE b.n > {FEW} GROUP BY h.cx, h.cy, b.n
  UNION ALL
  SELECT q.depth + 1, CAST(floor(p.x / {_M % '(q.depth + 1)'}) AS BIGINT), CAST(floor(p.y / {_M % '(q.depth + 1)'}) AS BIGINT), count(*), {_SPREAD}
  FROM q JOIN pts p ON floor(p.x / {_M % 'q.depth'}) = q.lx AND floor(p.y / {_M % 'q.depth'}) = q.ly
  WHERE q.n > {FEW} AND q.spread AND q.depth < {HALVINGS} GROUP BY ALL
),
cut AS (SELECT depth, lx, ly, n, {_M % 'depth'} AS m FROM q WHERE NOT (n > {FEW} AND spread AND depth < {HALVINGS}))
"""


def _cut_plan(spark: SparkSession, sf: str) -> Partitions:
    return plan_partitions(spark, emb(spark, sf), EPS, FEW, halvings=HALVINGS)


@query(_LEAVES + f"SELECT 0 AS depth, x AS cx, y AS cy, x2 AS cx2, y2 AS cy2, n FROM part WHERE n <= {FEW} UNION ALL SELECT depth, lx, ly, lx + 1, ly + 1, n FROM cut")
def below_cell_partitions(spark, sf):
    found = _cut_plan(spark, sf)
    leaves = found.leaves.select("depth", F.col("lx").alias("cx"), F.col("ly").alias("cy"), (F.col("lx") + 1).alias("cx2"), (F.col("ly") + 1).alias("cy2"), "n")
    return found.boxes.select(F.lit(0).alias("depth"), "cx", "cy", "cx2", "cy2", "n").union(leaves)


@query(_LEAVES + f"""SELECT depth, lx, ly, id, floor(p.x / m) = lx AND floor(p.y / m) = ly AS home FROM cut JOIN pts p
  ON p.x BETWEEN lx * m - CAST({EPS * (1 + 1e-9)!r} AS DOUBLE) AND (lx + 1) * m + CAST({EPS * (1 + 1e-9)!r} AS DOUBLE)
  AND p.y BETWEEN ly * m - CAST({EPS * (1 + 1e-9)!r} AS DOUBLE) AND (ly + 1) * m + CAST({EPS * (1 + 1e-9)!r} AS DOUBLE)""")
def below_cell_copies(spark, sf):
    return leaf_copies(emb(spark, sf), _cut_plan(spark, sf), EPS).select("depth", "lx", "ly", "id", "home")


@query(_DB + "SELECT id, flag, cluster_id FROM lab")
def dbscan_below_cells(spark, sf):
    return C.dbscan(emb(spark, sf), EPS, MIN_POINTS, FEW, halvings=HALVINGS).labeled


def _local(spark: SparkSession, sf: str) -> DataFrame:
    return written(C.local_labels(replicate(emb(spark, sf), _plan(spark, sf), EPS), EPS, MIN_POINTS), "local")


@query(_merged(False) + "SELECT DISTINCT pid, cluster FROM own")
def local_cluster_ids(spark, sf):
    return C.local_cluster_ids(_local(spark, sf))


@query(_merged(False) + "SELECT src, dst FROM adjacent")
def cluster_adjacencies(spark, sf):
    return C.cluster_adjacencies(C.copies_merged(_local(spark, sf)))


@query(_merged(False) + "SELECT cluster, component FROM whole")
def global_cluster_map(spark, sf):
    local = _local(spark, sf)
    return C.global_cluster_map(local, C.cluster_adjacencies(C.copies_merged(local)))


@query(_merged(False) + "SELECT id, flag, cluster_id FROM lab")
def relabel_union(spark, sf):
    local = _local(spark, sf)
    known = C.copies_merged(local)
    return C.relabel_union(emb(spark, sf).select("id"), known, C.global_cluster_map(local, C.cluster_adjacencies(known)))


@query(_merged(True) + "SELECT id, flag, cluster_id FROM lab")
def dbscan_any_shared(spark, sf):
    return C.dbscan(emb(spark, sf), EPS, MIN_POINTS, MOST, merge="any_shared").labeled


@query(f"""WITH pts AS ({_EMB}), {_BOXES} SELECT pid, id FROM pts p JOIN b ON p.x BETWEEN b.x AND b.x2 AND p.y BETWEEN b.y AND b.y2
  AND NOT (p.x > b.x + {_E} AND p.x < b.x2 - {_E} AND p.y > b.y + {_E} AND p.y < b.y2 - {_E})""")
def band_points(spark, sf):
    return _band(points_in(emb(spark, sf), boxes(spark)))


@query(f"WITH pts AS ({_EMB}), {_BOXES} SELECT pid, id FROM pts p JOIN b ON p.x > b.x + {_E} AND p.x < b.x2 - {_E} AND p.y > b.y + {_E} AND p.y < b.y2 - {_E}")
def inner_points(spark, sf):
    return _inner(emb(spark, sf), boxes(spark))


@query(f"WITH {_NB} SELECT i, j FROM nb")
def neighbor_pairs(spark, sf):
    p = emb(spark, sf)
    return N.neighbor_pairs(p, p, EPS).select("i", "j")


@query(f"WITH {_NB} SELECT i, j FROM nb")
def neighbor_pairs_salted(spark, sf):
    """The same pairs with heavy cells dealt in parts."""
    p = emb(spark, sf)
    return N.neighbor_pairs(p, p, EPS, heavy=64).select("i", "j")


@query(f"WITH {_NB} SELECT i AS id, count(*) AS n FROM nb GROUP BY i")
def neighbor_counts(spark, sf):
    return N.neighbor_counts(emb(spark, sf), EPS)


@query(f"WITH {_NB} SELECT i AS id FROM nb GROUP BY i HAVING count(*) >= {MIN_POINTS}")
def core_points(spark, sf):
    return N.core_points(emb(spark, sf), EPS, MIN_POINTS)


@query(f"WITH {_NB}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS k FROM nb) SELECT i AS id, CAST(k AS INTEGER) AS rank, j AS neighbor FROM r WHERE k <= {MIN_POINTS}")
def knn(spark, sf):
    return k_nearest(emb(spark, sf), EPS, MIN_POINTS).select("id", "rank", "neighbor")


@query(f"""WITH {_NB}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS k FROM nb)
SELECT pts.id, CAST(floor(sqrt(d2) * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS core_dist FROM pts LEFT JOIN r ON r.i = pts.id AND k = {MIN_POINTS}""")
def core_distance(spark, sf):
    return core_distances(emb(spark, sf), EPS, MIN_POINTS).select("id", micro(F.col("core_dist"), "core_dist"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Links of suppliers within 1, not all pairs, whose number grows with their square."""
    return cell_links(points(spark, sf, "supp2d"), 1.0).withColumnsRenamed({"src": "i", "dst": "j"})


_SUPP = f"""WITH RECURSIVE pts AS (SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal / CAST(1000 AS DOUBLE) AS y FROM supplier),
l AS (SELECT a.id AS i, b.id AS j FROM pts a JOIN pts b ON {_D} <= 1 AND a.id <> b.id),
cc(id, comp) USING KEY (id) AS (
  SELECT i, i FROM (SELECT DISTINCT i FROM l) UNION
  SELECT l.j, min(cc.comp) FROM cc JOIN l ON cc.id = l.i JOIN recurring.cc r ON r.id = l.j WHERE cc.comp < r.comp GROUP BY l.j
), c AS (SELECT id, min(comp) AS component FROM cc GROUP BY id) """


@query(_SUPP + "SELECT id, component FROM c")
def graph_components(spark, sf):
    return connected_components(_edges(spark, sf), "i", "j")


@query(_SUPP + "SELECT b.id FROM c a JOIN c b USING (component) WHERE a.id = (SELECT min(id) FROM c) AND b.id <> a.id")
def graph_reachable(spark, sf):
    """What the smallest vertex reaches, by steps from it alone."""
    edges = written(_edges(spark, sf), "edges")
    start = edges.agg(F.min("i").alias("id")).where("id is not null")
    return reachable(edges, start, "i", "j").join(start, "id", "left_anti")


@query(_SUPP + "SELECT id, component FROM c")
def graph_components_added(spark, sf):
    """Components of a first lot of edges, to which a second lot is added."""
    edges = written(_edges(spark, sf), "edges")
    first = connected_components(edges.where("(i + j) % 3 != 0"), "i", "j")
    return with_edges(first, edges.where("(i + j) % 3 = 0"), "i", "j")


def _partitioned(spark: SparkSession, sf: str) -> C.ClusterModel:
    return C.dbscan(emb(spark, sf), EPS, MIN_POINTS, MOST)


@query(_DB + "SELECT id, flag, cluster_id FROM lab")
def dbscan_labels(spark, sf):
    return C.dbscan_declarative(emb(spark, sf), EPS, MIN_POINTS).labeled


@query(_DB + "SELECT id, flag, cluster_id FROM lab")
def dbscan_partitioned(spark, sf):
    return _partitioned(spark, sf).labeled


@query(_DB + "SELECT id, flag, cluster_id FROM lab")
def dbscan_cells(spark, sf):
    return C.dbscan_cells(emb(spark, sf), EPS, MIN_POINTS).labeled


@query(_DB + "SELECT id, cluster_id FROM lab WHERE flag = 'CORE'")
def optics_partitioned(spark, sf):
    """Clusters of core points from the orders of partitions, cut at eps and merged."""
    return C.optics_clusters(emb(spark, sf), EPS, MIN_POINTS, MOST).where("flag = 'CORE'").select("id", "cluster_id")


@query(f"""WITH {_NB}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS k FROM nb)
SELECT pts.id, CAST(floor(sqrt(d2) * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS core_dist FROM pts LEFT JOIN r ON r.i = pts.id AND k = {MIN_POINTS}""")
def optics_partitioned_core_distances(spark, sf):
    """Core distances from the orders of partitions: those of the whole."""
    return C.optics(emb(spark, sf), EPS, MIN_POINTS, MOST).select("id", micro(F.col("core_dist"), "core_dist"))


CUTS = [0.03, 0.02, 0.012]


@query(" UNION ALL ".join(f"SELECT {n} AS cut, * FROM ({_DB.replace(_E, f'CAST({t} AS DOUBLE)')} SELECT id, cluster_id FROM lab WHERE flag = 'CORE')" for n, t in enumerate(CUTS)))
def optics_forest_cuts(spark, sf):
    """Clusters of core points at three thresholds, from one spanning forest."""
    return C.forest_cuts(emb(spark, sf), EPS, MIN_POINTS, CUTS)


@query(f"""WITH pts AS ({_EMB}), r AS (SELECT a.id, b.id AS neighbor, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS k FROM pts a, pts b)
SELECT id, CAST(k AS INTEGER) AS rank, neighbor FROM r WHERE k <= {MIN_POINTS}""")
def knn_unbounded(spark, sf):
    """The nearest points wherever they are."""
    return k_nearest_anywhere(emb(spark, sf), MIN_POINTS, SIDE).select("id", "rank", "neighbor")


_EVENTS = "WITH RECURSIVE pts AS (SELECT event_id AS id, epoch_us(ts) / CAST(3.6e9 AS DOUBLE) AS x, value AS y, 0 AS label FROM events)"


@query(_EVENTS + _DB.split("SELECT vec_id", 1)[1].split("FROM embeddings)", 1)[1].replace(_E, "CAST(2 AS DOUBLE)") + "SELECT id, flag, cluster_id FROM lab")
def dbscan_events(spark, sf):
    """Events by hour and value: 1,000,000 x sf points."""
    return C.dbscan(points(spark, sf, "events2d"), 2.0, MIN_POINTS, 2_000).labeled


@query("WITH pts AS (SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal / CAST(1000 AS DOUBLE) AS y FROM customer), "
    "h AS (SELECT CAST(floor(x / CAST(0.6 AS DOUBLE)) AS BIGINT) AS cx, CAST(floor(y / CAST(0.6 AS DOUBLE)) AS BIGINT) AS cy, count(*) AS n FROM pts GROUP BY ALL) SELECT * FROM h")
def customer_histogram(spark, sf):
    return N.histogram(points(spark, sf, "cust2d"), 0.6)


@query(_DB + "SELECT id, format('({}, {}) {} {}', CAST(floor(p.x * 1000) AS BIGINT), CAST(floor(p.y * 1000) AS BIGINT), flag, cluster_id) AS line FROM lab JOIN pts p USING (id)")
def labelled_lines(spark, sf):
    """Labelled points as text, coordinates in thousandths."""
    found = labelled_points(_partitioned(spark, sf))
    whole = found.withColumns({c: F.floor(F.col(c) * 1000).cast("long") for c in ("x", "y")})
    return whole.select("id", labelled_text().alias("line"))


@query(_DB + "SELECT cluster_id, count(*) AS n FROM lab GROUP BY cluster_id")
def dbscan_sizes(spark, sf):
    return _partitioned(spark, sf).labeled.groupBy("cluster_id").agg(F.count("*").alias("n"))


@query(_DB + "SELECT id FROM lab WHERE flag = 'NOISE'")
def dbscan_noise(spark, sf):
    return _partitioned(spark, sf).labeled.where("flag = 'NOISE'").select("id")


@query(_OPT + "SELECT id, pos, CAST(floor(reach * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS reach FROM o")
def optics_order(spark, sf):
    return C.optics(emb(spark, sf), EPS, MIN_POINTS).select("id", "pos", micro(F.col("reach"), "reach"))


@query(
    _OPT
    + """, v AS (SELECT *, coalesce(reach, gap) AS val, flag = 'NOISE' AS noise FROM f),
w AS (SELECT *, NOT noise AND (coalesce(lag(noise) OVER (ORDER BY pos), true) OR coalesce(val > 0 AND lag(val) OVER (ORDER BY pos) < CAST(0.4 AS DOUBLE) * val, false)) AS step FROM v)
SELECT id, pos, flag, CASE WHEN noise THEN 0 ELSE CAST(sum(CAST(step AS BIGINT)) OVER (ORDER BY pos) AS BIGINT) END AS cluster_id FROM w"""
)
def optics_ratio_clusters(spark, sf):
    return C.ratio_clusters(C.optics(emb(spark, sf), EPS, MIN_POINTS)).drop("pid")


@query(
    _OPT
    + """, v AS (SELECT *, coalesce(reach > CAST(0.02 AS DOUBLE), true) AS far, coalesce(cdist <= CAST(0.02 AS DOUBLE), false) AS dense FROM f)
SELECT id, pos, flag, CASE WHEN far AND NOT dense THEN 0 ELSE CAST(sum(CAST(far AND dense AS BIGINT)) OVER (ORDER BY pos) AS BIGINT) END AS cluster_id FROM v"""
)
def optics_eps_cut(spark, sf):
    return C.eps_clusters(C.optics(emb(spark, sf), EPS, MIN_POINTS), 0.02).drop("pid")


@query(_OPT + "SELECT count(reach) AS n_reached, count(cdist) AS n_core, CAST(floor(max(reach) * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS max_reach FROM o")
def reachability_stats(spark, sf):
    o = C.optics(emb(spark, sf), EPS, MIN_POINTS)
    return o.agg(F.count("reach").alias("n_reached"), F.count("core_dist").alias("n_core"), micro(F.max("reach"), "max_reach"))


def _with_truth(spark: SparkSession, sf: str) -> DataFrame:
    truth = points(spark, sf, "emb2d", "label").select("id", "label")
    return _partitioned(spark, sf).labeled.join(truth, "id")


_MAP = ", m AS (SELECT cluster_id, label FROM (SELECT cluster_id, label, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, label) AS k FROM lab WHERE cluster_id <> 0 GROUP BY cluster_id, label) WHERE k = 1) "


@query(_DB + "SELECT cluster_id, label, count(*) AS n FROM lab GROUP BY cluster_id, label")
def contingency(spark, sf):
    return C.contingency(_with_truth(spark, sf))


@query(_DB + _MAP + "SELECT cluster_id, label FROM m")
def label_mapping(spark, sf):
    return C.label_mapping(_with_truth(spark, sf))


@query(_DB + _MAP + "SELECT count(*) AS n, CAST(coalesce(sum(CAST(coalesce(m.label, 0) = lab.label AS BIGINT)), 0) AS BIGINT) AS n_right FROM lab LEFT JOIN m USING (cluster_id)")
def accuracy(spark, sf):
    return C.accuracy(_with_truth(spark, sf))


@query(
    _DB
    + f""", q AS (SELECT vec_id AS id, CAST(embedding[3] AS DOUBLE) AS x, CAST(embedding[4] AS DOUBLE) AS y FROM embeddings),
n AS (SELECT a.id, l.cluster_id, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS k FROM q a JOIN pts b ON {_D} <= {_E}*{_E} JOIN lab l ON l.id = b.id AND l.flag = 'CORE')
SELECT q.id, coalesce(n.cluster_id, 0) AS cluster_id FROM q LEFT JOIN n ON n.id = q.id AND n.k = 1"""
)
def predict_nearest_core(spark, sf):
    raw = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = raw.select(F.col("vec_id").alias("id"), F.expr("CAST(embedding[2] AS DOUBLE)").alias("x"), F.expr("CAST(embedding[3] AS DOUBLE)").alias("y"))
    return _partitioned(spark, sf).predict(asked, emb(spark, sf))
