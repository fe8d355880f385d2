"""Detection, pose and sequence post-processing, pixel tables, replay tables.

``orders`` serve as boxes: the image is the customer, geometry and score are
arithmetic on keys and price; finished orders (status F) are the truth boxes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.core.keyed import keyed_integer, keyed_uniform
from loomframe.functions import activations as A, text as T, vectors as V
from loomframe.operators import detection as D, joins as J
from loomframe.operators.topk import topk
from loomframe.plans.catalog.features import PIXELS, pixels
from loomframe.plans.registry import LONG_EMBEDDINGS, Tables, h, query, r

_GEOMETRY = {
    "box_id": "o_orderkey",
    "image": "o_custkey",
    "class": "o_orderkey % 3",
    "score": "(cast(round(o_totalprice * 100) as bigint) % 10007) / 10007.0{d}",
    "x1": "((o_orderkey * 37) % 101) / 202.0{d}",
    "y1": "((o_orderkey * 53) % 97) / 194.0{d}",
    "x2": "((o_orderkey * 37) % 101) / 202.0{d} + 0.15{d} + (o_orderkey % 13) / 40.0{d}",
    "y2": "((o_orderkey * 53) % 97) / 194.0{d} + 0.15{d} + (o_orderkey % 11) / 40.0{d}",
}
BOXES = (
    "(SELECT "
    + ", ".join(f"({e.format(d='')})::{'BIGINT' if k in ('box_id', 'image', 'class') else 'DOUBLE'} AS {k}" for k, e in _GEOMETRY.items()).replace(
        "0.15 ", "0.15::DOUBLE "
    )
    + ", o_orderstatus FROM orders)"
)
# decimals in DuckDB literals would round differently
for _n in ("10007.0", "202.0", "194.0", "40.0"):
    BOXES = BOXES.replace(f"/ {_n}", f"/ {_n}::DOUBLE")


def boxes(t: Tables):
    cols = [F.expr(e.format(d="D")).alias(k) for k, e in _GEOMETRY.items()]
    return t.orders.select(*cols, "o_orderstatus")


def iou_sql(a: str, b: str) -> str:
    w = f"greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0)"
    hh = f"greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0)"
    area = lambda p: f"({p}x2 - {p}x1) * ({p}y2 - {p}y1)"
    return f"(({w} * {hh}) / ({area(a)} + {area(b)} - {w} * {hh}))"


ANCHORS = f"(SELECT * FROM {BOXES} WHERE o_orderstatus <> 'F')"
TRUTHS = f"(SELECT * FROM {BOXES} WHERE o_orderstatus = 'F')"


def anchors_and_truths(t: Tables):
    b = boxes(t)
    return (
        b.filter("o_orderstatus <> 'F'").drop("o_orderstatus"),
        b.filter("o_orderstatus = 'F'").drop("o_orderstatus"),
    )


@query(
    "iou_join",
    f"SELECT a.image, a.box_id, b.box_id AS t_box_id, {r(iou_sql('a.', 'b.'))} AS iou FROM {ANCHORS} a JOIN {TRUTHS} b ON a.image = b.image WHERE {iou_sql('a.', 'b.')} > 0.2",
)
def _iou_join(t: Tables):
    anchors, truths = anchors_and_truths(t)
    out = J.iou_join(anchors, truths, ["image"], 0.2)
    return out.select("image", "box_id", "t_box_id", F.round("iou", 6).alias("iou"))


@query(
    "box_iou",
    f"""SELECT box_id, {r(iou_sql('', 'b_'))} AS iou FROM (SELECT *, x1 + image % 7 / 10.0::DOUBLE AS b_x1, y1 + image % 5 / 10.0::DOUBLE AS b_y1, x2 + image % 7 / 10.0::DOUBLE AS b_x2, y2 + image % 5 / 10.0::DOUBLE AS b_y2 FROM {BOXES})""",
)
def _box_iou(t: Tables):
    b = boxes(t)
    mine = {c: F.col(c) for c in J.CORNERS}
    other = {
        "x1": F.col("x1") + F.col("image") % 7 / 10.0,
        "y1": F.col("y1") + F.col("image") % 5 / 10.0,
        "x2": F.col("x2") + F.col("image") % 7 / 10.0,
        "y2": F.col("y2") + F.col("image") % 5 / 10.0,
    }
    return b.select("box_id", F.round(D.box_iou(mine, other), 6).alias("iou"))


def nms_sql(boxes: str, threshold: float, columns: str) -> str:
    """Greedy suppression as a recursion over the rank inside (image, class)."""
    return f"""
WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY score DESC, box_id) AS rk FROM {boxes}),
g AS (SELECT image, class, 1::BIGINT AS rk, [{{'id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM b WHERE rk = 1
  UNION ALL SELECT g.image, g.class, b.rk, CASE WHEN len(list_filter(g.kept, lambda k: {iou_sql('k.', 'b.')} >= {threshold})) > 0 THEN g.kept
    ELSE list_append(g.kept, {{'id': b.box_id, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) END FROM g JOIN b ON b.image = g.image AND b.class = g.class AND b.rk = g.rk + 1),
l AS (SELECT image, class, arg_max(kept, rk) AS kept FROM g GROUP BY 1, 2),
k AS (SELECT image, class, u.id AS box_id FROM (SELECT image, class, unnest(kept) AS u FROM l))
SELECT {columns} FROM k JOIN b USING (image, class, box_id)"""


_NMS_SQL = nms_sql(BOXES, 0.4, "image, class, box_id")


@query("nms", _NMS_SQL)
def _nms(t: Tables):
    return D.nms(boxes(t).drop("o_orderstatus"), ["image", "class"], "box_id", "score", 0.4).select("image", "class", "box_id")


@query("nms_rounds", _NMS_SQL)
def _nms_rounds(t: Tables):
    """The path for groups too large for one task, forced on all of them."""
    return D.nms_rounds(boxes(t).drop("o_orderstatus"), ["image", "class"], "box_id", "score", 0.4, grid=4).select("image", "class", "box_id")


@query(
    "nms_topk",
    f"SELECT image, box_id, rank FROM (SELECT image, box_id, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS rank FROM {BOXES}) WHERE rank <= 3",
)
def _nms_topk(t: Tables):
    out = D.nms_topk(boxes(t), ["image"], "score", "box_id", 3)
    return out.select("image", "box_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "threshold_filter",
    f"""SELECT box_id, class, {r('x1 * 640 / 800')} AS x, {r('y1 * 480 / 600')} AS y, {r('x2 * 640 / 800 - x1 * 640 / 800')} AS w, {r('y2 * 480 / 600 - y1 * 480 / 600')} AS h
FROM (SELECT * REPLACE (class - 1 AS class) FROM {BOXES}) WHERE class >= 0 AND score > 0.5""",
)
def _threshold(t: Tables):
    scaled = boxes(t).withColumns(
        {"class": F.col("class") - 1, "x1": F.col("x1") * 640, "x2": F.col("x2") * 640, "y1": F.col("y1") * 480, "y2": F.col("y2") * 480}
    )
    out = D.threshold_filter(scaled, 0.5, F.lit(800.0), F.lit(600.0))
    return out.select("box_id", "class", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


@query(
    "corner_boxes",
    f"SELECT box_id, {r('x1')} AS x, {r('y1')} AS y, {r('x2 - x1')} AS w, {r('y2 - y1')} AS h FROM {BOXES} WHERE score >= 0.7",
)
def _corner(t: Tables):
    return D.corner_boxes(boxes(t)).select("box_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


# eight cells of eight numbers per vector: cx, cy, w, h, objectness, three class scores
_CELLS = f"(SELECT vec_id, pos // 8 AS cell, list(1.0 / (1.0 + exp(-4.0 * x)) ORDER BY pos) AS v FROM {LONG_EMBEDDINGS} GROUP BY 1, 2)"


@query(
    "yolo_decode",
    f"""
WITH c AS (SELECT vec_id, cell, v, greatest(v[6], v[7], v[8]) AS best FROM {_CELLS})
SELECT vec_id, cell, (list_position(v[6:8], best) - 1)::BIGINT AS class, {r('best * v[5]')} AS score, {r('greatest(0, v[1] - v[3] / 2)')} AS x,
  {r('greatest(0, v[2] - v[4] / 2)')} AS y, {r('v[3]')} AS w, {r('v[4]')} AS h FROM c WHERE best * v[5] > 0.35""",
)
def _yolo(t: Tables):
    v = F.transform(V.doubles("embedding"), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(x * -4.0)))
    cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.slice(v, s * 8 + 1, F.lit(8)))
    df = t.embeddings.select("vec_id", F.posexplode(cells).alias("cell", "v"))
    out = D.yolo_decode(df, "v", 3, 0.35)
    return out.select(
        "vec_id", F.col("cell").cast("bigint").alias("cell"), "class", *[F.round(c, 6).alias(c) for c in ("score", "x", "y", "w", "h")]
    )


@query(
    "anchor_boxes",
    f"""
WITH s AS (SELECT * FROM (VALUES (0, 0.2::DOUBLE, 0.2::DOUBLE), (1, 0.4, 0.4), (2, 0.2 * sqrt(2.0), 0.2 / sqrt(2.0)), (3, 0.2 * sqrt(0.5), 0.2 / sqrt(0.5))) v(anchor, w, h))
SELECT image, anchor, count(*) AS n, {r('sum((y * 8 + x + 1) * ((x + 0.5) / 8 - w / 2))')} AS x1, {r('sum((y * 8 + x + 1) * ((y + 0.5) / 8 - h / 2))')} AS y1,
  {r('sum((y * 8 + x + 1) * ((x + 0.5) / 8 + w / 2))')} AS x2, {r('sum((y * 8 + x + 1) * ((y + 0.5) / 8 + h / 2))')} AS y2 FROM {PIXELS}, s GROUP BY 1, 2""",
)
def _anchors(t: Tables):
    out = D.anchor_boxes(pixels(t), "x", "y", 8, 8, [0.2, 0.4], [1.0, 2.0, 0.5])
    weight = F.col("y") * 8 + F.col("x") + 1
    return out.groupBy("image", "anchor").agg(
        F.count("*").alias("n"), *[F.round(F.sum(weight * F.col(c)), 6).alias(c) for c in J.CORNERS]
    )


@query(
    "default_boxes",
    f"""
WITH lv AS (SELECT * FROM (VALUES (0, 4, 75.0::DOUBLE, 0.21::DOUBLE, 0.45::DOUBLE), (1, 2, 150.0, 0.45, 0.69)) v(level, cells, step, s1, s2)),
sh AS (SELECT level, 0 AS shape, s1 AS w, s1 AS h FROM lv UNION ALL SELECT level, 1, sqrt(s1 * s2), sqrt(s1 * s2) FROM lv
  UNION ALL SELECT level, 2, s1 * sqrt(2.0), s1 / sqrt(2.0) FROM lv UNION ALL SELECT level, 3, s1 / sqrt(2.0), s1 * sqrt(2.0) FROM lv
  UNION ALL SELECT level, 4, s1 * sqrt(3.0), s1 / sqrt(3.0) FROM lv WHERE level = 1 UNION ALL SELECT level, 5, s1 / sqrt(3.0), s1 * sqrt(3.0) FROM lv WHERE level = 1),
b AS (SELECT level, shape, i, j, least((j + 0.5) / (300 / step), 1.0) AS cx, least((i + 0.5) / (300 / step), 1.0) AS cy, least(w, 1.0) AS w, least(h, 1.0) AS h
  FROM lv JOIN sh USING (level), range(4) a(i), range(4) c(j) WHERE i < cells AND j < cells)
SELECT vec_id, level, shape, count(*) AS n, {r('sum(cx * (j + 1))')} AS cx, {r('sum(cy * (i + 1))')} AS cy, {r('sum(w)')} AS w, {r('sum(h)')} AS h FROM embeddings, b GROUP BY 1, 2, 3""",
)
def _default_boxes(t: Tables):
    out = D.default_boxes(t.embeddings.select("vec_id"), 300, [4, 2], [75, 150], [63, 135, 207], [[2], [2, 3]])
    return out.groupBy("vec_id", "level", "shape").agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.col("cx") * (F.col("j") + 1)), 6).alias("cx"),
        F.round(F.sum(F.col("cy") * (F.col("i") + 1)), 6).alias("cy"),
        F.round(F.sum("w"), 6).alias("w"),
        F.round(F.sum("h"), 6).alias("h"),
    )


@query(
    "box_decode",
    f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
b AS (SELECT vec_id, v, 0.3 + v[1] AS cx, 0.4 + v[2] AS cy, 0.5 + abs(v[3]) AS w, 0.5 + abs(v[4]) AS h FROM e),
d AS (SELECT vec_id, v, cx, cy, w, h, exp(v[7] * 0.2) * w AS bw, exp(v[8] * 0.2) * h AS bh FROM b)
SELECT vec_id, {r('v[5] * 0.1 * w + cx - bw * 0.5')} AS x, {r('v[6] * 0.1 * h + cy - bh * 0.5')} AS y, {r('bw')} AS w, {r('bh')} AS h FROM d""",
)
def _box_decode(t: Tables):
    df = t.embeddings.select("vec_id", V.doubles("embedding").alias("v"))
    v = F.col("v")
    anchor = {"cx": v[0] + 0.3, "cy": v[1] + 0.4, "w": F.abs(v[2]) + 0.5, "h": F.abs(v[3]) + 0.5}
    box = D.box_decode(anchor, [v[i] for i in range(4, 8)])
    return df.select("vec_id", *[F.round(c, 6).alias(k) for k, c in box.items()])


_OFFSETS = " + ".join(
    f"{i} * ({e})"
    for i, e in enumerate(
        (
            "((t.x1 + t.x2) / 2 - (a.x1 + a.x2) / 2) / (a.x2 - a.x1) / 0.1",
            "((t.y1 + t.y2) / 2 - (a.y1 + a.y2) / 2) / (a.y2 - a.y1) / 0.1",
            "ln((t.x2 - t.x1) / (a.x2 - a.x1)) / 0.2",
            "ln((t.y2 - t.y1) / (a.y2 - a.y1)) / 0.2",
        ),
        1,
    )
)


@query(
    "box_target",
    f"""
WITH a AS (SELECT * FROM {ANCHORS}), t AS (SELECT * FROM {TRUTHS}),
p AS MATERIALIZED (SELECT a.image, a.box_id, t.box_id AS truth, {iou_sql('a.', 't.')} AS iou FROM a JOIN t USING (image) WHERE {iou_sql('a.', 't.')} > 0),
c AS (SELECT image, box_id, truth, iou, 1 AS forced FROM p QUALIFY row_number() OVER (PARTITION BY image, truth ORDER BY iou DESC, box_id) = 1
  UNION ALL SELECT image, box_id, truth, iou, 0 FROM p WHERE iou > 0.3),
b AS (SELECT image, box_id, truth FROM c QUALIFY row_number() OVER (PARTITION BY image, box_id ORDER BY forced DESC, iou DESC, truth) = 1),
l AS (SELECT a.image, a.box_id, a.score, coalesce(t.class + 1, 0) AS target, (t.box_id IS NOT NULL)::INT::DOUBLE AS mask, coalesce({_OFFSETS}, 0) AS offsets
  FROM a LEFT JOIN b ON a.image = b.image AND a.box_id = b.box_id LEFT JOIN t ON t.box_id = b.truth),
m AS (SELECT *, sum(mask) OVER (PARTITION BY image) AS pos, row_number() OVER (PARTITION BY image, target = 0 ORDER BY score, box_id) - 1 AS k FROM l)
SELECT image, box_id, CASE WHEN target > 0 OR k < floor(pos * 3) THEN target ELSE -1 END AS target, mask, {r('offsets')} AS offsets FROM m""",
)
def _box_target(t: Tables):
    anchors, truths = anchors_and_truths(t)
    out = D.box_target(anchors, truths, "image", "box_id", "box_id", 0.3, negative_ratio=3.0, confidence="score")
    return out.select("image", "box_id", "target", "mask", F.round(V.fingerprint(F.col("offsets")), 6).alias("offsets"))


_SSD_BOXES = f"""(SELECT vec_id // 8 AS image, vec_id * 8 + cell AS box_id, (list_position(ps, list_max(ps)) - 1)::BIGINT AS class, list_max(ps) AS score,
    o[1] * 0.1 * 0.3 + cx - bw / 2 AS x1, o[2] * 0.1 * 0.4 + cy - bh / 2 AS y1, o[1] * 0.1 * 0.3 + cx + bw / 2 AS x2, o[2] * 0.1 * 0.4 + cy + bh / 2 AS y2
  FROM (SELECT *, exp(o[3] * 0.2) * 0.3 AS bw, exp(o[4] * 0.2) * 0.4 AS bh, ((cell % 4) + 0.5) / 4 AS cx, ((cell // 4) + 0.5) / 2 AS cy FROM
    (SELECT vec_id, cell, v[5:8] AS o, list_transform(v[2:4], lambda x: exp(x) / list_sum(list_transform(v[1:4], lambda y: exp(y)))) AS ps FROM
      (SELECT vec_id, pos // 8 AS cell, list(x * 4.0 ORDER BY pos) AS v FROM {LONG_EMBEDDINGS} GROUP BY 1, 2))) WHERE list_max(ps) >= 0.3)"""


@query(
    "ssd_decode",
    nms_sql(_SSD_BOXES, 0.45, "image, box_id AS anchor, class, " + ", ".join(f"{r(c)} AS {c}" for c in ("score", "x1", "y1", "x2", "y2"))),
)
def _ssd_decode(t: Tables):
    """Four anchors per vector, three classes and the background each."""
    v = F.transform(V.doubles("embedding"), lambda x: x * 4.0)
    cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.slice(v, s * 8 + 1, F.lit(8)))
    df = t.embeddings.select("vec_id", F.posexplode(cells).alias("anchor", "c")).select(
        F.floor(F.col("vec_id") / 8).alias("image"),
        (F.col("vec_id") * 8 + F.col("anchor")).alias("anchor"),
        F.slice("c", 1, 4).alias("logits"),
        F.slice("c", 5, 4).alias("offsets"),
        ((F.col("anchor") % 4 + 0.5) / 4).alias("cx"),
        ((F.floor(F.col("anchor") / 4) + 0.5) / 2).alias("cy"),
        F.lit(0.3).alias("w"),
        F.lit(0.4).alias("h"),
    )
    out = D.ssd_decode(df, "image", "anchor", "logits", "offsets", 0.3)
    return out.select("image", "anchor", "class", *[F.round(c, 6).alias(c) for c in ("score", *J.CORNERS)])


# four joints of a 4 x 4 heat map per vector
@query(
    "pose_peaks",
    f"""
WITH m AS (SELECT vec_id, pos // 16 AS joint, arg_max(pos % 16, (x, -pos)) AS peak, max(x) AS top FROM {LONG_EMBEDDINGS} GROUP BY 1, 2)
SELECT vec_id, joint, (peak % 4) / 4.0::DOUBLE AS x, (peak // 4) / 4.0::DOUBLE AS y, {r('top')} AS confidence FROM m WHERE top > 0.2""",
)
def _pose(t: Tables):
    v = V.doubles("embedding")
    maps = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.slice(v, s * 16 + 1, F.lit(16)))
    df = t.embeddings.select("vec_id", F.posexplode(maps).alias("joint", "heat"))
    peaks = df.select("vec_id", F.col("joint").cast("bigint").alias("joint"), D.pose_peaks(F.col("heat"), 4, 4).alias("p"))
    return peaks.filter("p IS NOT NULL").select("vec_id", "joint", "p.x", "p.y", F.round("p.confidence", 6).alias("confidence"))


@query(
    "answer_span",
    """
WITH w AS (SELECT doc_id, string_split(rtrim(text, ' '), ' ') AS w FROM documents),
s AS (SELECT doc_id, w, list_transform(w, lambda x, i: (length(x) * 37 + i * 11) % 101) AS st, list_transform(w, lambda x, i: (length(x) * 53 + i * 7) % 103) AS en FROM w),
p AS (SELECT doc_id, w, list_position(st, list_max(st)) AS a, list_position(en, list_max(en)) AS b FROM s)
SELECT doc_id, CASE WHEN b >= a THEN array_to_string(w[a:b], ' ') ELSE '' END AS answer FROM p""",
)
def _answer(t: Tables):
    df = t.documents.select("doc_id", T.tokenize_simple(F.col("text")).alias("w"))
    start = F.transform("w", lambda x, i: (F.length(x) * 37 + (i + 1) * 11) % 101)
    end = F.transform("w", lambda x, i: (F.length(x) * 53 + (i + 1) * 7) % 103)
    return df.select("doc_id", F.array_join(D.answer_span(F.col("w"), start, end), " ").alias("answer"))


@query(
    "sequence_collapse",
    f"""
WITH s AS (SELECT vec_id, pos // 4 AS step, arg_max(pos % 4, (x, -pos)) AS c FROM {LONG_EMBEDDINGS} GROUP BY 1, 2),
l AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY step) AS before FROM s)
SELECT 'array' AS form, vec_id AS id, coalesce(string_agg(chr(96 + c::INT), '' ORDER BY step) FILTER (c <> 0 AND (before IS NULL OR before <> c)), '') AS word FROM l GROUP BY 2
UNION ALL SELECT 'rows', user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) FROM
  (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type GROUP BY 2""",
)
def _collapse(t: Tables):
    v = V.doubles("embedding")
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda s: V.argmax(F.slice(v, s * 4 + 1, F.lit(4))).cast("int")
    )
    letters = F.transform(D.collapse(F.col("steps")), lambda c: F.get(F.array(*[F.lit(x) for x in "_abc"]), c))
    arrays = t.embeddings.select("vec_id", steps.alias("steps")).select(
        F.lit("array").alias("form"), F.col("vec_id").alias("id"), F.array_join(letters, "").alias("word")
    )
    rows = D.collapse_rows(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")
    short = rows.withColumn("c", F.substring("event_type", 1, 1)).withColumnRenamed("event_id", "pos")
    words = J.recollect(short, ["user_id"], "c", "w").select(
        F.lit("rows").alias("form"), F.col("user_id").alias("id"), F.array_join("w", "").alias("word")
    )
    return arrays.unionByName(words)


@query(
    "sentiment_probs",
    f"""
WITH e AS (SELECT vec_id, pos, exp(x * 10.0) AS e FROM {LONG_EMBEDDINGS} WHERE pos < 2), p AS (SELECT vec_id, pos, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)
SELECT vec_id, CASE pos WHEN 0 THEN 'Negative' ELSE 'Positive' END AS class, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, pos) AS rank, {r('p')} AS prob FROM p""",
)
def _sentiment(t: Tables):
    probs = A.softmax(F.transform(F.slice(V.doubles("embedding"), 1, 2), lambda x: x * 10.0))
    df = t.embeddings.select("vec_id", F.posexplode(topk(probs, ["Negative", "Positive"], 2)).alias("p", "c"))
    return df.select("vec_id", "c.class", (F.col("p") + 1).cast("bigint").alias("rank"), F.round("c.prob", 6).alias("prob"))


@query("mask_filter", f"SELECT image, y, x, {r('v / 255.0')} AS mask FROM {PIXELS} WHERE v / 255.0 > 0.3")
def _mask(t: Tables):
    df = pixels(t).withColumn("mask", F.col("v") / 255.0).filter(F.col("mask") > 0.3)
    return df.select("image", "y", "x", F.round("mask", 6).alias("mask"))


# pixels -----------------------------------------------------------------------------
@query("pixel_crop", f"SELECT image, y - 2 AS y, x - 1 AS x, c, v FROM {PIXELS} WHERE x >= 1 AND x < 5 AND y >= 2 AND y < 8")
def _crop(t: Tables):
    return D.pixel_crop(pixels(t), 1, 2, 4, 6)


@query("pixel_center_crop", f"SELECT image, y - 1 AS y, x - 2 AS x, c, v FROM {PIXELS} WHERE x >= 2 AND x < 6 AND y >= 1 AND y < 7")
def _center(t: Tables):
    return D.pixel_center_crop(pixels(t), 8, 8, 4, 6)


@query("pixel_flip", f"SELECT 'x' AS axis, image, y, 7 - x AS x, c, v FROM {PIXELS} UNION ALL SELECT 'y', image, 7 - y, x, c, v FROM {PIXELS}")
def _pixel_flip(t: Tables):
    p = pixels(t)
    return D.pixel_flip(p, width=8).withColumn("axis", F.lit("x")).unionByName(D.pixel_flip(p, height=8).withColumn("axis", F.lit("y")))


@query("pixel_rotate", f"SELECT image, 7 - x AS y, y AS x, c, v FROM {PIXELS}")
def _pixel_rotate(t: Tables):
    return D.pixel_rotate(pixels(t), 8, 8, 1)


@query(
    "pixel_resize_nearest",
    f"SELECT image, ny AS y, nx AS x, c, v FROM {PIXELS} p JOIN (SELECT ny, nx FROM range(5) a(ny), range(12) b(nx)) n ON p.y = n.ny * 8 // 5 AND p.x = n.nx * 8 // 12",
)
def _resize(t: Tables):
    return D.pixel_resize_nearest(pixels(t), 8, 8, 12, 5)


# replay -----------------------------------------------------------------------------
@query(
    "q_target",
    f"""SELECT event_id, {r("CASE WHEN event_type = 'purchase' THEN value ELSE value + 0.9 * list_max(embedding[1:4]::DOUBLE[]) END")} AS target
FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings)""",
)
def _q_target(t: Tables):
    n = t.embeddings.agg(F.count("*")).scalar()
    steps = t.events.select("event_id", "event_type", "value", F.pmod("event_id", n).alias("vec_id"))
    table = t.embeddings.select("vec_id", F.slice(V.doubles("embedding"), 1, 4).alias("q"))
    joined = J.embedding_lookup(steps, table, "vec_id", "q")
    target = D.q_target(F.col("value"), F.col("event_type") == "purchase", F.col("q"), 0.9)
    return joined.select("event_id", F.round(target, 6).alias("target"))


_TWO_52 = "4503599627370496.0::DOUBLE"


@query(
    "epsilon_greedy",
    f"""SELECT vec_id, CASE WHEN {h('31/draw', 'vec_id')} / {_TWO_52} < greatest(0.1, 0.9 - vec_id * 0.002) THEN floor({h('31/action', 'vec_id')} / {_TWO_52} * 4)::BIGINT
  ELSE list_position(embedding[1:4], list_max(embedding[1:4]))::BIGINT - 1 END AS action FROM embeddings""",
)
def _epsilon(t: Tables):
    epsilon = F.greatest(F.lit(0.1), F.lit(0.9) - F.col("vec_id") * 0.002)
    action = D.epsilon_greedy(
        F.slice("embedding", 1, 4), epsilon, keyed_uniform("31/draw", "vec_id"), keyed_integer("31/action", 0, 4, "vec_id")
    )
    return t.embeddings.select("vec_id", action.cast("bigint").alias("action"))
