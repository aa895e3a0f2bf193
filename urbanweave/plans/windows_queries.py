"""Window, ranking and top-k queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from urbanweave.functions import columns as C
from urbanweave.operators import raster as R
from urbanweave.operators.numbering import stable_ids
from urbanweave.plans.registry import query
from urbanweave.sources import bindings as B
from urbanweave.sources.bindings import with_sql


@query("SELECT c_name AS id, row_number() OVER (ORDER BY c_name) AS number FROM customer")
def w1_numeric_ids(spark, sf):
    return stable_ids(B.table(spark, sf, "customer").select(F.col("c_name").alias("id")))


@query(with_sql("tile_cell", "SELECT r, c, round(arg_min(v, CASE tile WHEN 2 THEN 1 WHEN 0 THEN 2 WHEN 3 THEN 3 ELSE 4 END), 6) AS v, arg_min(tile, CASE tile WHEN 2 THEN 1 WHEN 0 THEN 2 WHEN 3 THEN 3 ELSE 4 END) AS source, count(*) AS n_tiles FROM tile_cell GROUP BY r, c"))
def w2_priority_tile(spark, sf):
    p = R.first_by_priority(B.tile_cell(spark, sf), [2, 0, 3, 1])
    return p.select("r", "c", C.r6(F.col("v")).alias("v"), "source", "n_tiles")


@query("""WITH k AS (SELECT DISTINCT l_partkey%500 AS col, l_orderkey%64 AS k FROM lineitem), g AS (SELECT col, k, k - row_number() OVER (PARTITION BY col ORDER BY k) AS island FROM k)
SELECT col, min(k) AS k0, max(k)+1 AS k1 FROM g GROUP BY col, island""")
def w3_run_length_spans(spark, sf):
    k = B.table(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("col"), (F.col("l_orderkey") % 64).alias("k")).distinct()
    g = k.withColumn("island", F.col("k") - F.row_number().over(Window.partitionBy("col").orderBy("k")))
    return g.groupBy("col", "island").agg(F.min("k").alias("k0"), (F.max("k") + 1).alias("k1")).drop("island")


@query("""WITH k AS (SELECT DISTINCT l_partkey%500 AS col, l_orderkey%64 AS k FROM lineitem), g AS (SELECT col, k - row_number() OVER (PARTITION BY col ORDER BY k) AS island FROM k)
SELECT col, count(DISTINCT island) AS spans FROM g GROUP BY col HAVING count(DISTINCT island) > 1""")
def w5_disconnected_columns(spark, sf):
    k = B.table(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("col"), (F.col("l_orderkey") % 64).alias("k")).distinct()
    starts = k.withColumn("new", (F.col("k") - F.lag("k").over(Window.partitionBy("col").orderBy("k"))).eqNullSafe(1))
    return starts.groupBy("col").agg(F.count_if(~F.col("new")).alias("spans")).where("spans > 1")


_PRIO = ", p AS (SELECT r, c, arg_min(v, tile) v, min(tile) source FROM tile_cell GROUP BY r, c)"


@query(with_sql("tile_cell", _PRIO + " SELECT a.r, a.c, 'east' AS side, round(b.v-a.v, 6) AS jump, (a.source <> b.source) AS switch FROM p a JOIN p b ON a.r = b.r AND b.c = a.c+1 UNION ALL SELECT a.r, a.c, 'north', round(b.v-a.v, 6), a.source <> b.source FROM p a JOIN p b ON a.c = b.c AND b.r = a.r+1"))
def w6_neighbour_jumps(spark, sf):
    p = R.first_by_priority(B.tile_cell(spark, sf), [0, 1, 2, 3]).withColumn("x", F.struct("v", "source"))
    e = R.edges(p, "x")
    return e.select("r", "c", "side", C.r6(F.col("v1.v") - F.col("v0.v")).alias("jump"), (F.col("v0.source") != F.col("v1.source")).alias("switch"))


@query(with_sql("cell_a", "SELECT a.r, a.c, round(sqrt(pow((e.v-w.v)/2, 2)+pow((n.v-s.v)/2, 2)), 6) AS slope FROM cell_a a JOIN cell_a e ON e.r=a.r AND e.c=a.c+1 JOIN cell_a w ON w.r=a.r AND w.c=a.c-1 JOIN cell_a n ON n.c=a.c AND n.r=a.r+1 JOIN cell_a s ON s.c=a.c AND s.r=a.r-1"))
def w7_slope(spark, sf):
    return R.slope(B.cell_a(spark, sf)).select("r", "c", C.r6(F.col("slope")).alias("slope"))


@query(with_sql("cell_a", "SELECT a.r, a.c, round(max(b.v), 6) AS highest FROM cell_a a JOIN cell_a b ON b.r BETWEEN a.r-4 AND a.r+4 AND b.c BETWEEN a.c-4 AND a.c+4 GROUP BY a.r, a.c"))
def w8_local_maximum(spark, sf):
    return R.local_max(B.cell_a(spark, sf)).select("r", "c", C.r6(F.col("highest")).alias("highest"))


@query("""WITH f AS (SELECT p_brand AS category, min(p_partkey) AS id FROM part WHERE p_size < 10 GROUP BY 1), s AS (SELECT p_type AS category, min(p_partkey) FILTER (WHERE p_partkey NOT IN (SELECT id FROM f)) AS unused, min(p_partkey) AS lowest FROM part GROUP BY 1)
SELECT category, id FROM f UNION ALL SELECT category, coalesce(unused, lowest) FROM s""")
def w9_first_per_category(spark, sf):
    part = B.table(spark, sf, "part")
    first = part.where("p_size < 10").groupBy(F.col("p_brand").alias("category")).agg(F.min("p_partkey").alias("id"))
    used = first.select(F.col("id").alias("p_partkey")).distinct().withColumn("used", F.lit(True))
    second = part.join(used, "p_partkey", "left").groupBy(F.col("p_type").alias("category")).agg(F.coalesce(F.min(F.when(F.col("used").isNull(), F.col("p_partkey"))), F.min("p_partkey")).alias("id"))
    return first.unionByName(second)


@query(with_sql("claim", "SELECT r, c, arg_max(id, (top, id)) AS last_wins, arg_min(id, (top, id)) AS first_wins, count(*) AS claims FROM claim GROUP BY r, c"))
def w10_owner_by_order(spark, sf):
    k = F.struct("top", "id")
    return B.claims(B.bld(spark, sf)).groupBy("r", "c").agg(F.max_by("id", k).alias("last_wins"), F.min_by("id", k).alias("first_wins"), F.count("*").alias("claims"))


@query(with_sql("tile_cell", _PRIO + ", e AS (SELECT a.r, a.c, 'east' side, abs(b.v-a.v) jump FROM p a JOIN p b ON a.r = b.r AND b.c = a.c+1 WHERE a.source <> b.source UNION ALL SELECT a.r, a.c, 'north', abs(b.v-a.v) FROM p a JOIN p b ON a.c = b.c AND b.r = a.r+1 WHERE a.source <> b.source) SELECT r, c, side, round(jump, 6) AS jump FROM e ORDER BY round(jump, 6) DESC, r, c, side LIMIT 1"))
def t1_largest_switch(spark, sf):
    p = R.first_by_priority(B.tile_cell(spark, sf), [0, 1, 2, 3]).withColumn("x", F.struct("v", "source"))
    e = R.edges(p, "x").where("v0.source <> v1.source").select("r", "c", "side", C.r6(F.abs(F.col("v1.v") - F.col("v0.v"))).alias("jump"))
    return e.agg(F.max_by(F.struct("r", "c", "side", "jump"), F.struct("jump", -F.col("r"), -F.col("c"), (F.col("side") == "east").cast("int"))).alias("x")).where("x IS NOT NULL").select("x.*")  # without a switch there is no row


@query(with_sql("bld", "SELECT id, x0, y0, round(top, 6) AS top FROM bld ORDER BY top DESC, id"))
def t2_ordered_output(spark, sf):
    return B.bld(spark, sf).orderBy(F.desc("top"), "id").select("id", "x0", "y0", C.r6(F.col("top")).alias("top"))


@query(with_sql("claim cell_a", ", k AS (SELECT id, r, c, v, row_number() OVER (PARTITION BY id ORDER BY (v IS NULL OR v < 10) DESC, r, c) AS k FROM claim LEFT JOIN cell_a USING (r, c)) SELECT id, r, c, CAST(k AS INTEGER) AS k, round(v, 6) AS v FROM k WHERE k <= 5"))
def t3_first_five_cells(spark, sf):
    j = B.claims(B.bld(spark, sf)).join(B.cell_a(spark, sf), ["r", "c"], "left")
    low = F.coalesce(F.col("v") < 10, F.lit(True))
    return j.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(low.desc(), "r", "c"))).where("k <= 5").select("id", "r", "c", "k", C.r6(F.col("v")).alias("v"))


@query(with_sql("cell_a cell_b", ", d AS (SELECT r, c, abs(b.v-a.v) d FROM cell_a a JOIN cell_b b USING (r, c)) SELECT r//32 AS block, arg_max(r, (d, -r, -c)) AS r, arg_max(c, (d, -r, -c)) AS c, round(max(d), 6) AS error FROM d GROUP BY 1"))
def t4_worst_cells(spark, sf):
    j = B.cell_a(spark, sf).withColumnRenamed("v", "a").join(B.cell_b(spark, sf).withColumnRenamed("v", "b"), ["r", "c"]).withColumn("d", F.abs(F.col("b") - F.col("a")))
    w = j.groupBy(F.expr("r div 32").alias("block")).agg(F.max_by(F.struct("r", "c", "d"), F.struct("d", -F.col("r"), -F.col("c"))).alias("x"))
    return w.select("block", "x.r", "x.c", C.r6(F.col("x.d")).alias("error"))
