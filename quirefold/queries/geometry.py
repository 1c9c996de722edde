"""Queries on boxes: made by integer arithmetic from lines, so both engines have them alike."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import layout, segment
from . import harness as H

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


BOXES = """,
boxes AS (SELECT doc_id, page, seq, CAST((doc_id + pos) % 5 * 30 AS DOUBLE) AS l, 800.0 - CAST(seq * 11 + (doc_id + pos) % 3 * 4 AS DOUBLE) AS t, CAST((doc_id + pos) % 5 * 30 + 20 + pos % 7 * 5 AS DOUBLE) AS r, 800.0 - CAST(seq * 11 + (doc_id + pos) % 3 * 4 AS DOUBLE) - CAST(8 + doc_id % 6 AS DOUBLE) AS b, (doc_id + pos) % 2 = 0 AS code FROM lines)"""


def boxes(spark, d):
    k, pos = F.col("doc_id") + F.col("pos"), F.col("pos")
    left = (k % 5 * 30).cast("double")
    top = F.lit(800.0) - (F.col("seq") * 11 + k % 3 * 4).cast("double")
    box = F.struct(left.alias("left"), top.alias("top"), (k % 5 * 30 + 20 + pos % 7 * 5).cast("double").alias("right"), (top - (8 + F.col("doc_id") % 6).cast("double")).alias("bottom"))
    kind = F.when(k % 2 == 0, "code").otherwise("paragraph")
    return segment.as_blocks(H.lines(spark, d).select("doc_id", "page", "seq", kind.alias("type"), box.alias("bbox")))


@query("bbox_union", H.sql(H.LINES + BOXES, 'SELECT doc_id, page, min(l) AS "left", max(t) AS top, max(r) AS "right", min(b) AS bottom FROM boxes GROUP BY doc_id, page'))
def bbox_union(spark, d):
    around = boxes(spark, d).groupBy("doc_id", "page").agg(geometry.union_of(F.collect_list("bbox")).alias("u"))
    return around.select("doc_id", "page", "u.*")


SAME = "greatest(0, least({0}t, {1}t) - greatest({0}b, {1}b)) / least(greatest(0.01, {0}t - {0}b), greatest(0.01, {1}t - {1}b)) >= 0.65 AND {1}l - {0}r BETWEEN -2 AND 18"


@query("same_visual_line", H.sql(H.LINES + BOXES, ", n AS (SELECT *, lag(l) OVER w AS pl, lag(t) OVER w AS pt, lag(r) OVER w AS pr, lag(b) OVER w AS pb FROM boxes WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)) SELECT doc_id, page, seq, coalesce(".replace("\n", "") + SAME.format("p", "").replace("pt", "pt") + ", false) AS same FROM n").replace("\n, n AS", ", n AS"))
def same_visual_line(spark, d):
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    own = boxes(spark, d).withColumn("before", F.lag("bbox").over(order))
    return own.select("doc_id", "page", "seq", geometry.same_line(F.col("before"), F.col("bbox")).alias("same"))


@query(
    "touching_fragments",
    H.sql(H.LINES + BOXES, "SELECT x.doc_id, x.page, x.seq AS first, y.seq AS second FROM boxes x JOIN boxes y ON x.doc_id = y.doc_id AND x.page = y.page AND x.seq < y.seq WHERE (x.code OR y.code) AND greatest(0, least(x.t, y.t) - greatest(x.b, y.b)) / greatest(1, least(x.t - x.b, y.t - y.b)) >= 0.25 AND least(x.r, y.r) - greatest(x.l, y.l) >= -8"),
)
def touching_fragments(spark, d):
    return layout.touching_pairs(boxes(spark, d))


IMAGES = """,
images AS (SELECT doc_id, page, CAST(20 + doc_id % 3 * 10 AS DOUBLE) AS il, CAST(700 + doc_id % 4 * 5 AS DOUBLE) AS it, CAST(120 + doc_id % 5 * 10 AS DOUBLE) AS ir, CAST(600 - page AS DOUBLE) AS ib FROM (SELECT DISTINCT doc_id, page FROM lines))"""


def images(spark, d):
    """One image a page: width 400, height 200, placed by a matrix."""
    left, top, right, bottom = (20 + F.col("doc_id") % 3 * 10).cast("double"), (700 + F.col("doc_id") % 4 * 5).cast("double"), (120 + F.col("doc_id") % 5 * 10).cast("double"), (600 - F.col("page")).cast("double")
    zero = F.lit(0.0)
    return H.lines(spark, d).select("doc_id", "page").distinct().select("doc_id", "page", F.array(right - left, zero, zero, top - bottom, left, bottom).alias("placement"))


@query("bbox_overlap_join", H.sql(H.LINES + BOXES + IMAGES, "SELECT doc_id, page, seq, round(greatest(0, least(r, ir) - greatest(l, il)) * greatest(0, least(t, it) - greatest(b, ib)) / greatest(1, (r - l) * (t - b)), 6) AS ratio FROM boxes JOIN images USING (doc_id, page) WHERE greatest(0, least(r, ir) - greatest(l, il)) * greatest(0, least(t, it) - greatest(b, ib)) / greatest(1, (r - l) * (t - b)) >= 0.5"))
def bbox_overlap_join(spark, d):
    ratio = geometry.overlap_ratio(F.col("bbox"), geometry.placed_box(F.col("placement")))
    return boxes(spark, d).join(images(spark, d), ["doc_id", "page"]).where(ratio >= 0.5).select("doc_id", "page", "seq", F.round(ratio, 6).alias("ratio"))


@query("point_in_box_join", H.sql(H.LINES + BOXES + IMAGES, ", p AS (SELECT *, il + 0.5 * (ir - il) AS x, ib + (1 - seq / 20.0) * (it - ib) AS y, greatest(3.0, (t - b) * 0.015) AS m FROM boxes JOIN images USING (doc_id, page)) SELECT doc_id, page, seq FROM p WHERE x BETWEEN l - m AND r + m AND y BETWEEN b - m AND t + m").replace("\n, p AS", ", p AS"))
def point_in_box_join(spark, d):
    """A point half across the image, further down with seq, against the block's box."""
    own = boxes(spark, d).join(images(spark, d), ["doc_id", "page"])
    x, y = geometry.image_to_page(F.col("placement"), F.lit(400.0), F.lit(200.0), F.lit(200.0), F.col("seq") * 10.0)
    return own.where(geometry.in_box(x, y, F.col("bbox"))).select("doc_id", "page", "seq")


@query("affine_product", "SELECT doc_id, CAST(2 * (doc_id % 5) + 3 AS DOUBLE) AS a, CAST(doc_id % 7 AS DOUBLE) AS b, CAST(4 AS DOUBLE) AS d, CAST(10 * (doc_id % 5) + 1 AS DOUBLE) AS e FROM documents")
def affine_product(spark, d):
    one = lambda *x: F.array(*((v if not isinstance(v, (int, float)) else F.lit(float(v))).cast("double") for v in x))
    k = (F.col("doc_id") % 5).cast("double")
    # scale by (2k + 3)/1, shear, then move: [1 0 0 1 10 0] x [2k... ] checked term by term
    m = geometry.multiply(one(1, 0, 0, 1, 0, 0), one(2 * k + 3, F.col("doc_id") % 7, 0, 4, 10 * k + 1, 0))
    return H.table(spark, d, "documents").select("doc_id", m[0].alias("a"), m[1].alias("b"), m[3].alias("d"), m[4].alias("e"))


@query("tiny_pictures", H.sql(H.LINES + BOXES, "SELECT doc_id, count(*) FILTER (WHERE r - l < 24 OR t - b < 18 OR (r - l) * (t - b) < 500) AS n FROM (SELECT doc_id, l, r, t + 10 AS t, b FROM boxes) GROUP BY doc_id"))
def tiny_pictures(spark, d):
    taller = F.col("bbox").withField("top", F.col("bbox.top") + 10)
    return boxes(spark, d).groupBy("doc_id").agg(F.count_if(geometry.is_tiny_picture(taller)).alias("n"))
