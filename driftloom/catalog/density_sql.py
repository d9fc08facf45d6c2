"""SQL counterpart of density clustering, over the vectors of `embeddings`.

Prim's order of the points has a property that SQL can use: the components at any distance are runs
of that order, cut where the joining distance is larger. So the merge tree is the tree of intervals
between boundaries, and boundaries of equal distance cut an interval at once.
"""

#: Minimum cluster size and samples, as in `ClusterConfig`.
TREE = """
p AS MATERIALIZED (
  SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) AS INTEGER) AS i, list_transform(CAST(embedding AS DOUBLE[]),
    lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v
  FROM embeddings
), d AS MATERIALIZED (
  SELECT a.i, b.i AS j, round(least(greatest(1 - list_dot_product(a.v, b.v), 0), 2), 9) AS d FROM p a, p b
), core AS MATERIALIZED (
  SELECT i, d AS core FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM d WHERE i <> j) WHERE r = 3
), reach AS MATERIALIZED (
  SELECT d.i, list(greatest(d.d, a.core, b.core) ORDER BY d.j) AS row
  FROM d JOIN core a ON a.i = d.i JOIN core b ON b.i = d.j GROUP BY d.i
), prim AS MATERIALIZED (
  SELECT list_reduce(range(1, (SELECT count(*) FROM reach)), lambda a, x: list_transform(
      [list_transform(list_zip(a.best, m[a.i]), lambda y, j: CASE WHEN y[1] IS NOT NULL AND j <> a.i THEN least(y[1], y[2]) END)],
      lambda b: struct_pack(i := CAST(list_position(b, list_min(b)) AS INTEGER), best := b,
        ids := list_append(a.ids, CAST(list_position(b, list_min(b)) AS INTEGER)), ws := list_append(a.ws, list_min(b))))[1],
    struct_pack(i := 1, best := list_transform(m[1], lambda y: CAST('inf' AS DOUBLE)), ids := [1], ws := [CAST(NULL AS DOUBLE)])) AS o
  FROM (SELECT list(row ORDER BY i) AS m FROM reach)
), steps AS (
  SELECT unnest(o.ids) AS i, unnest(o.ws) AS w, unnest(range(1, len(o.ids) + 1)) AS k FROM prim
), placed AS MATERIALIZED (
  SELECT steps.k, p.vec_id, greatest(w, 1e-12) AS w FROM steps JOIN p USING (i)
), n AS (SELECT max(k) AS n FROM placed),
ends AS MATERIALIZED (
  SELECT b.k, b.w, coalesce(max(l.k), 1) AS lo, coalesce(min(r.k), (SELECT n + 1 FROM n)) AS hi
  FROM placed b LEFT JOIN placed l ON l.k < b.k AND l.w > b.w LEFT JOIN placed r ON r.k > b.k AND r.w > b.w
  WHERE b.w IS NOT NULL GROUP BY b.k, b.w
), nodes AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY hi - lo, lo) AS node, lo, hi, hi - lo AS size, any_value(w) AS w
  FROM ends GROUP BY lo, hi HAVING hi - lo >= 5
), parents AS MATERIALIZED (
  SELECT c.node, arg_min(p.node, p.size) AS parent FROM nodes c JOIN nodes p ON p.lo <= c.lo AND p.hi >= c.hi AND p.size > c.size
  GROUP BY c.node
), large AS MATERIALIZED (
  SELECT x.*, parent, p.w AS parent_w, coalesce(k.kids, 0) AS kids, coalesce(k.kid_size, 0) AS kid_size,
    coalesce(s.kids, 0) AS siblings
  FROM nodes x LEFT JOIN parents USING (node) LEFT JOIN nodes p ON p.node = parent
  LEFT JOIN (SELECT parent AS node, count(*) AS kids, sum(size) AS kid_size FROM parents JOIN nodes USING (node) GROUP BY parent) k USING (node)
  LEFT JOIN (SELECT parent, count(*) AS kids FROM parents GROUP BY parent) s USING (parent)
), tops AS MATERIALIZED (
  SELECT x.node, arg_min(y.node, y.size) AS top FROM large x JOIN large y ON y.lo <= x.lo AND y.hi >= x.hi
  WHERE y.parent IS NULL OR y.siblings > 1 GROUP BY x.node
), grown AS MATERIALIZED (
  SELECT t.top, max(size) AS size, sum((size - CASE WHEN kids = 1 THEN kid_size ELSE 0 END) / w) AS rows
  FROM tops t JOIN large USING (node) GROUP BY t.top
), clusters AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY g.size, g.top) AS c, g.top, g.size, l.lo, l.hi, g.rows - g.size / l.parent_w AS own, t.top AS up
  FROM grown g JOIN large l ON l.node = g.top JOIN tops t ON t.node = l.parent
), sums AS MATERIALIZED (
  SELECT list_reduce(range(1, len(own) + 1), lambda below, c: list_transform(below, lambda x, i:
      CASE WHEN i = above[c] THEN x + greatest(own[c], below[c]) ELSE x END), list_transform(own, lambda x: 0.0::DOUBLE)) AS below
  FROM (
    SELECT list(k.own ORDER BY k.c) AS own, list(coalesce(u.c, 0) ORDER BY k.c) AS above
    FROM clusters k LEFT JOIN clusters u ON u.top = k.up
  )
), chosen AS MATERIALIZED (
  SELECT clusters.* FROM clusters, sums WHERE own >= below[CAST(c AS INTEGER)] * (1 - 1e-9)
), picked AS MATERIALIZED (
  SELECT a.* FROM chosen a WHERE NOT EXISTS (FROM chosen b WHERE b.size > a.size AND b.lo <= a.lo AND b.hi >= a.hi)
), members AS MATERIALIZED (
  SELECT placed.vec_id, c.top FROM placed LEFT JOIN picked c ON k >= lo AND k < hi
), numbered AS MATERIALIZED (
  SELECT top, row_number() OVER (ORDER BY min(vec_id)) - 1 AS cluster_id, count(*) AS member_count
  FROM members WHERE top IS NOT NULL GROUP BY top
)
"""

LABELS = f"WITH {TREE} SELECT vec_id AS id, coalesce(cluster_id, -1) AS cluster_id FROM members LEFT JOIN numbered USING (top)"

CLUSTERS = f"""WITH {TREE}
SELECT cluster_id, member_count, round(own / (member_count * (SELECT max(1 / w) FROM nodes)), 6) AS persistence_score
FROM numbered JOIN picked USING (top)
"""
