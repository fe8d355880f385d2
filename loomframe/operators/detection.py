"""Detection, pose and sequence post-processing on box, heat-map and pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.core.session import materialize
from loomframe.functions.vectors import argmax
from loomframe.operators.joins import CORNERS, iou, iou_join, with_cells
from loomframe.operators.topk import topk_rows

LOCAL_BOXES = 20_000  # a group up to this size is suppressed inside one task
TASK_BOXES = 1 << 16  # boxes whose copies, one a cell, a task sorts in memory


def threshold_filter(df: DataFrame, threshold: float, width: Column, height: Column, cls: str = "class", score: str = "score") -> DataFrame:
    """Drop the background (class -1) and low scores; corners become relative x, y, w, h."""
    kept = df.filter((F.col(cls) >= 0) & (F.col(score) > threshold))
    rel = lambda c, size: F.when(size > 0, F.col(c) / size).otherwise(F.col(c))
    return kept.withColumns({"x": rel("x1", width), "y": rel("y1", height)}).withColumns(
        {"w": rel("x2", width) - F.col("x"), "h": rel("y2", height) - F.col("y")}
    )


def corner_boxes(df: DataFrame, threshold: float = 0.7, score: str = "score") -> DataFrame:
    return df.filter(F.col(score) >= threshold).withColumns(
        {"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}
    )


def yolo_decode(df: DataFrame, cell: str, classes: int, threshold: float) -> DataFrame:
    """[cx, cy, w, h, objectness, class scores…] to (class, score, x, y, w, h)."""
    v = F.col(cell)
    scores = F.slice(v, 6, classes)
    best = F.greatest(F.array_max(scores), F.lit(0.0))
    cls = F.when(best > 0, argmax(scores)).otherwise(F.lit(0))
    out = df.withColumns({"class": cls.cast("bigint"), "score": best * v[4]}).filter(F.col("score") > threshold)
    return out.withColumns(
        {
            "x": F.greatest(F.lit(0.0), v[0] - v[2] / 2),
            "y": F.greatest(F.lit(0.0), v[1] - v[3] / 2),
            "w": v[2],
            "h": v[3],
        }
    ).drop(cell)


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return iou(a, b)


# non-maximum suppression -----------------------------------------------------------
def nms(
    df: DataFrame,
    group: Sequence[str],
    box_id: str,
    score: str,
    threshold: float = 0.4,
    local_boxes: int = LOCAL_BOXES,
    grid: int = 16,
) -> DataFrame:
    """Greedy suppression by falling score (ties: lowest id), IoU >= ``threshold`` drops.

    Groups of up to ``local_boxes`` run as one pandas group each. Larger groups
    are never collected: they go through distributed rounds with the same result.
    """
    group = list(group)
    sizes = materialize(df.groupBy(*group).agg(F.count("*").alias("_n")), "nms-sizes")
    large_groups = sizes.filter(F.col("_n") > local_boxes).select(*group)
    if large_groups.isEmpty():
        return _nms_local(df, group, box_id, score, threshold)
    # sizes are counted, so the anti and semi joins know how large their side is
    small = df.join(large_groups, group, "left_anti")
    large = df.join(large_groups, group, "left_semi")
    kept = _nms_local(small.select(*df.columns), group, box_id, score, threshold)
    return kept.unionByName(nms_rounds(large.select(*df.columns), group, box_id, score, threshold, grid, local_boxes))


def _nms_local(df: DataFrame, group: list[str], box_id: str, score: str, threshold: float) -> DataFrame:
    """Whole groups per partition, walked in sorted order batch by batch."""
    ordered = df.repartition(*group).sortWithinPartitions(*group, F.desc(score), box_id)

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            starts = _group_starts(pdf, group)
            # the last group may go on in the next batch
            yield _greedy(pdf.iloc[: starts[-1]], starts[:-1], threshold)
            rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield _greedy(rest, np.array([0]), threshold)

    return ordered.mapInPandas(run, df.schema)


def _group_starts(pdf: pd.DataFrame, group: list[str]) -> np.ndarray:
    new = np.zeros(len(pdf), dtype=bool)
    new[0] = True
    for c in group:
        v = pdf[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.nonzero(new)[0]


def _greedy(pdf: pd.DataFrame, starts: np.ndarray, threshold: float) -> pd.DataFrame:
    """Keep the boxes greedy suppression keeps; rows are sorted by falling score per group."""
    x1, y1, x2, y2 = (pdf[c].to_numpy(dtype=np.float64) for c in CORNERS)
    area = (x2 - x1) * (y2 - y1)
    alive = np.ones(len(pdf), dtype=bool)
    for start, end in zip(starts, [*starts[1:], len(pdf)]):
        for i in range(start, end):
            if not alive[i]:
                continue
            later = slice(i + 1, end)
            w = np.minimum(x2[i], x2[later]) - np.maximum(x1[i], x1[later])
            h = np.minimum(y2[i], y2[later]) - np.maximum(y1[i], y1[later])
            inter = np.maximum(w, 0.0) * np.maximum(h, 0.0)
            alive[later] &= ~((inter > 0) & (inter / (area[i] + area[later] - inter) >= threshold))
    return pdf[alive]


def nms_rounds(
    df: DataFrame, group: Sequence[str], box_id: str, score: str, threshold: float, grid: int = 16, one_task: int = LOCAL_BOXES
) -> DataFrame:
    """The same greedy result by rounds over grid cells.

    A box that leads every cell it touches overlaps no better open box, so greedy
    keeps it; the boxes it suppresses share a cell with it. A round keeps all
    such leaders and drops what they suppress. Cells have one leader each, so
    a round is linear in the open boxes.

    The cells of a group of at most ``one_task`` boxes lie in one task: a box moves
    once a round and its copies never do. Those of a larger group are dealt over all tasks.
    A box without a group, an id or corners is in no result.
    """
    group = list(group)
    named = df.filter(" and ".join(f"`{c}` is not null" for c in [*group, box_id]))
    sizes = named.groupBy(*group).agg(F.count("*").alias("_n"))
    above = F.col("_n") > one_task
    total, dealt = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("_n"))), F.lit(0))).first()
    terms = (group, box_id, score, threshold, grid)
    if not dealt:
        return _rounds(named, total, _round_in_groups, *terms)
    # sizes are counted, so the joins know how large their side is
    large = materialize(sizes.filter(above).select(*group), "nms-large")
    small = named.join(large, group, "left_anti").select(*df.columns)
    boxes = materialize(named.join(large, group, "left_semi").select(*df.columns), "nms-open")
    return _rounds(small, total - dealt, _round_in_groups, *terms).unionByName(_rounds(boxes, dealt, _round_in_cells, *terms))


def _rounds(df: DataFrame, boxes: int, one_round, *terms) -> DataFrame:
    rest, kept = df, df.limit(0)
    while boxes:
        fresh, rest = one_round(rest, boxes, *terms)
        kept = kept.unionByName(fresh)
        boxes = rest.count()
    return kept


def _round_in_groups(
    rest: DataFrame, boxes: int, group: list[str], box_id: str, score: str, threshold: float, grid: int
) -> tuple[DataFrame, DataFrame]:
    """(kept, still open), written as one table; every step after the move by group stays in its task."""
    columns = rest.columns
    cores = rest.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-boxes // TASK_BOXES), min(cores, boxes))
    cell, box = Window.partitionBy(*group, "_cx", "_cy"), Window.partitionBy(*group, box_id)
    order = F.struct((-F.col(score)).alias("s"), F.col(box_id).alias("id"), *CORNERS)
    led = with_cells(rest.repartition(tasks, *group), grid).withColumn("_lead", F.min(order).over(cell))
    overlap = iou({c: F.col(c) for c in CORNERS}, {c: F.col(f"_lead.{c}") for c in CORNERS})
    hit = F.coalesce((overlap > 0) & (overlap >= threshold), F.lit(False))
    marked = led.select(*columns, "_cx", "_cy", (F.col("_lead.id") == F.col(box_id)).alias("_is"), hit.alias("_hit"))
    won = marked.withColumn("_kept", F.bool_and("_is").over(box)).withColumn("_won", F.bool_or(F.col("_is") & F.col("_kept")).over(cell))
    decided = won.withColumn("_out", F.bool_or(F.col("_hit") & F.col("_won")).over(box))
    first = (F.col("_cx") == F.floor(F.col("x1") * grid)) & (F.col("_cy") == F.floor(F.col("y1") * grid))
    left = decided.filter(first & (F.col("_kept") | ~F.col("_out"))).select(*columns, "_kept")
    written = materialize(left, "nms-round")
    return written.filter("_kept").select(*columns), written.filter("not _kept").select(*columns)


def _round_in_cells(
    rest: DataFrame, boxes: int, group: list[str], box_id: str, score: str, threshold: float, grid: int
) -> tuple[DataFrame, DataFrame]:
    """The same for groups that no task could hold: the cells of a group meet wherever their keys send them."""
    columns = rest.columns
    cells = with_cells(rest, grid)
    order = F.struct((-F.col(score)).alias("s"), F.col(box_id).alias("id"))
    leaders = cells.groupBy(*group, "_cx", "_cy").agg(F.min(order).alias("_lead"))
    led = cells.join(leaders, [*group, "_cx", "_cy"]).withColumn("_is", F.col("_lead.id") == F.col(box_id))
    winners = (
        led.groupBy(*group, box_id).agg(F.bool_and("_is").alias("_all")).filter("_all").select(*group, box_id)
    )
    fresh = materialize(rest.join(winners, [*group, box_id]).select(*columns), "nms-kept")
    lead = with_cells(fresh, grid).select(
        *group, "_cx", "_cy", F.col(box_id).alias("_w"), *[F.col(c).alias(f"_{c}") for c in CORNERS]
    )
    overlap = iou({c: F.col(c) for c in CORNERS}, {c: F.col(f"_{c}") for c in CORNERS})
    dropped = (
        cells.join(lead, [*group, "_cx", "_cy"])
        .filter(((overlap > 0) & (overlap >= threshold)) | (F.col("_w") == F.col(box_id)))
        .select(*group, box_id)
        .distinct()
    )
    left = rest.filter(" and ".join(f"`{c}` is not null" for c in CORNERS)).join(dropped, [*group, box_id], "left_anti")
    return fresh, materialize(left.select(*columns), "nms-open")


def nms_topk(df: DataFrame, image: Sequence[str], score: str, box_id: str, k: int) -> DataFrame:
    """The k best candidates per image before suppression."""
    return topk_rows(df, image, [F.desc(score), box_id], k)


# anchors ---------------------------------------------------------------------------
def anchor_boxes(
    df: DataFrame, x: str, y: str, width: int, height: int, sizes: Sequence[float], ratios: Sequence[float], clip: bool = False
) -> DataFrame:
    """Per pixel: every size with the first ratio, the first size with the other ratios."""
    shapes = [(s, ratios[0]) for s in sizes] + [(sizes[0], q) for q in ratios[1:]]
    aspect = height / width
    half = [(s * aspect * float(np.sqrt(q)) / 2.0, s / float(np.sqrt(q)) / 2.0) for s, q in shapes]
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in half])
    cx, cy = (F.col(x) + 0.5) / width, (F.col(y) + 0.5) / height
    out = df.select("*", F.posexplode(table).alias("anchor", "_s"))
    corners = {"x1": cx - F.col("_s.w"), "y1": cy - F.col("_s.h"), "x2": cx + F.col("_s.w"), "y2": cy + F.col("_s.h")}
    if clip:
        corners = {k: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for k, c in corners.items()}
    return out.withColumns(corners).drop("_s")


def default_boxes(
    df: DataFrame, figure: int, features: Sequence[int], steps: Sequence[int], scales: Sequence[int], ratios: Sequence[Sequence[int]]
) -> DataFrame:
    """Multi-scale grid boxes (cx, cy, w, h, clipped to 0..1) for every row of ``df``.

    Level ``k`` has a square grid of ``features[k]`` cells a side, ``steps[k]`` pixels apart. Each cell has a square
    of its level's scale, a square half-way (geometrically) to the next scale, and, per ratio, a wide and a tall box
    of its level's scale: sides ``size * sqrt(aspect)`` and ``size / sqrt(aspect)``.
    """
    levels = [
        F.struct(
            F.lit(cells).alias("cells"),
            F.lit(step / figure).alias("step"),
            F.lit(own / figure).alias("own"),
            F.lit(following / figure).alias("following"),
            F.lit([float(r) for r in aspects]).cast("array<double>").alias("aspects"),
        )
        for cells, step, own, following, aspects in zip(features, steps, scales, scales[1:], ratios)
    ]
    shape = lambda size, aspect: F.struct(size.alias("size"), aspect.alias("aspect"))
    own, one = F.col("_l.own"), F.lit(1.0)
    pairs = F.transform("_l.aspects", lambda r: F.array(shape(own, r), shape(own, 1 / r)))
    shapes = F.concat(F.array(shape(own, one), shape(F.sqrt(own * F.col("_l.following")), one)), F.flatten(pairs))
    clipped = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    placed = df.select("*", F.posexplode(F.array(*levels)).alias("level", "_l")).select("*", F.posexplode(shapes).alias("shape", "_s"))
    cell = F.explode(F.sequence(F.lit(0), F.col("_l.cells") * F.col("_l.cells") - 1)).alias("_cell")
    row, column = F.floor(F.col("_cell") / F.col("_l.cells")).cast("int"), F.col("_cell") % F.col("_l.cells")
    stretch = F.sqrt("_s.aspect")
    return placed.select("*", cell).select(
        *df.columns,
        "level",
        "shape",
        row.alias("i"),
        column.alias("j"),
        clipped((column + 0.5) * F.col("_l.step")).alias("cx"),
        clipped((row + 0.5) * F.col("_l.step")).alias("cy"),
        clipped(F.col("_s.size") * stretch).alias("w"),
        clipped(F.col("_s.size") / stretch).alias("h"),
    )


def box_decode(anchor: dict[str, Column], offset: Sequence[Column], variances: tuple[float, float] = (0.1, 0.2)) -> dict[str, Column]:
    """Centre anchors (cx, cy, w, h) and offsets to corner boxes (x, y, w, h)."""
    w = F.exp(offset[2] * variances[1]) * anchor["w"]
    h = F.exp(offset[3] * variances[1]) * anchor["h"]
    return {
        "x": offset[0] * variances[0] * anchor["w"] + anchor["cx"] - w * 0.5,
        "y": offset[1] * variances[0] * anchor["h"] + anchor["cy"] - h * 0.5,
        "w": w,
        "h": h,
    }


def box_target(
    anchors: DataFrame,
    truths: DataFrame,
    image: str,
    anchor_id: str,
    truth_id: str,
    threshold: float = 0.5,
    negative_ratio: float | None = None,
    confidence: str | None = None,
    variances: tuple[float, float] = (0.1, 0.2),
) -> DataFrame:
    """Training targets per anchor: class (0 = background), mask and offsets.

    An anchor takes its best truth above the threshold, and every truth takes its
    best anchor whatever the overlap. With ``negative_ratio``, only the least
    confident backgrounds, ratio x positives of the image, stay class 0; the
    others are ignored (-1).
    """
    pairs = materialize(
        iou_join(anchors, truths, [image]).select(
            image, anchor_id, f"t_{truth_id}", "iou", "t_class", *[f"t_{c}" for c in CORNERS]
        ),
        "overlaps",
    )
    truth = F.struct(F.col("iou"), F.col("t_class").alias("class"), *[F.col(f"t_{c}").alias(c) for c in CORNERS])
    rank = F.struct("iou", (-F.col(f"t_{truth_id}")).alias("r"))
    forced = (
        pairs.groupBy(image, f"t_{truth_id}")
        .agg(F.max_by(F.struct(anchor_id, truth.alias("t")), F.struct("iou", (-F.col(anchor_id)).alias("r"))).alias("f"))
        .select(image, F.col(f"f.{anchor_id}").alias(anchor_id), F.col("f.t").alias("t"), F.lit(1).alias("forced"), (-F.col(f"t_{truth_id}")).alias("r"))
    )
    best = (
        pairs.filter(F.col("iou") > threshold)
        .groupBy(image, anchor_id)
        .agg(F.max_by(truth, rank).alias("t"), F.max(rank).alias("m"))
        .select(image, anchor_id, "t", F.lit(0).alias("forced"), F.col("m.r").alias("r"))
    )
    chosen = (
        forced.unionByName(best)
        .groupBy(image, anchor_id)
        .agg(F.max_by("t", F.struct("forced", F.col("t.iou"), "r")).alias("t"))
    )
    out = anchors.join(chosen, [image, anchor_id], "left")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    tw, th = F.col("t.x2") - F.col("t.x1"), F.col("t.y2") - F.col("t.y1")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2.0
    offsets = F.array(
        (middle("t.x1", "t.x2") - middle("x1", "x2")) / w / variances[0],
        (middle("t.y1", "t.y2") - middle("y1", "y2")) / h / variances[0],
        F.log(tw / w) / variances[1],
        F.log(th / h) / variances[1],
    )
    matched = F.col("t").isNotNull()
    labelled = out.withColumns(
        {
            "target": F.when(matched, F.col("t.class") + 1).otherwise(F.lit(0)).cast("bigint"),
            "mask": matched.cast("double"),
            "offsets": F.when(matched, offsets).otherwise(F.array_repeat(F.lit(0.0), 4)),
        }
    ).drop("t")
    if negative_ratio is None:
        return labelled
    return _mine(labelled, image, anchor_id, confidence, negative_ratio)


def _mine(df: DataFrame, image: str, anchor_id: str, confidence: str, ratio: float) -> DataFrame:
    from loomframe.core.order import group_rank

    positives = df.groupBy(image).agg(F.sum("mask").alias("_pos"))
    ranked = group_rank(df.withColumn("_bg", F.col("target") == 0), [image, "_bg"], [confidence, anchor_id], "_rank")
    kept = ~F.col("_bg") | (F.col("_rank") < F.floor(F.col("_pos") * ratio))
    return (
        ranked.join(positives, image)
        .withColumn("target", F.when(kept, F.col("target")).otherwise(F.lit(-1).cast("bigint")))
        .drop("_pos", "_rank", "_bg")
    )


def ssd_decode(
    df: DataFrame, image: str, anchor_id: str, logits: str, offsets: str, threshold: float, overlap: float = 0.45
) -> DataFrame:
    """Softmax without the background class, best class, decoded box, threshold, suppression.

    ``df`` has one row per (image, anchor) with centre anchors cx, cy, w, h.
    """
    from loomframe.functions.activations import softmax

    probs = df.withColumn("_p", F.slice(softmax(F.col(logits)), F.lit(2), F.size(logits) - 1))
    scored = probs.withColumns(
        {"class": argmax(F.col("_p")).cast("bigint"), "score": F.array_max("_p")}
    ).filter(F.col("score") >= threshold)
    o = [F.col(offsets)[i] for i in range(4)]
    box = box_decode({c: F.col(c) for c in ("cx", "cy", "w", "h")}, o)
    decoded = scored.select(
        image,
        anchor_id,
        "class",
        "score",
        box["x"].alias("x1"),
        box["y"].alias("y1"),
        (box["x"] + box["w"]).alias("x2"),
        (box["y"] + box["h"]).alias("y2"),
    )
    return nms(decoded, [image, "class"], anchor_id, "score", overlap)


# pose, answers, sequences ------------------------------------------------------------
def pose_peaks(heat: Column, width: int, height: int, threshold: float = 0.2) -> Column:
    """struct(x, y, confidence) of the heat map's peak, NULL at or below the threshold."""
    at, top = argmax(heat), F.array_max(heat)
    peak = F.struct(
        (F.pmod(at, F.lit(width)) / width).alias("x"),
        (F.floor(at / width) / height).alias("y"),
        top.alias("confidence"),
    )
    return F.when(top > threshold, peak)


def answer_span(tokens: Column, start: Column, end: Column) -> Column:
    a, b = argmax(start), argmax(end)
    return F.when(
        b >= a, F.slice(tokens, (a + 1).cast("int"), F.greatest(b - a + 1, F.lit(0)).cast("int"))
    ).otherwise(F.array().cast("array<string>"))


def collapse(steps: Column, blank: int = 0) -> Column:
    """Drop the blank class and repeats of the preceding step."""
    return F.filter(
        steps, lambda c, i: (c != blank) & ((i == 0) | (c != F.element_at(steps, F.greatest(i, F.lit(1)))))
    )


def collapse_rows(df: DataFrame, group: Sequence[str], order_by, value: str) -> DataFrame:
    """The same on one row per step, for sequences of any length."""
    from loomframe.operators.windows import previous

    with_last = previous(df, value, group, order_by, "_last")
    return with_last.filter(F.col("_last").isNull() | (F.col("_last") != F.col(value))).drop("_last")


# pixel tables (image, y, x, c, v) ------------------------------------------------------
def pixel_crop(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = (F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)
    return df.filter(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def pixel_center_crop(df: DataFrame, image_width: int, image_height: int, width: int, height: int) -> DataFrame:
    return pixel_crop(df, (image_width - width) // 2, (image_height - height) // 2, width, height)


def pixel_flip(df: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Mirror left-right (given the width) and/or top-bottom (given the height)."""
    moves = {}
    if width is not None:
        moves["x"] = F.lit(width) - 1 - F.col("x")
    if height is not None:
        moves["y"] = F.lit(height) - 1 - F.col("y")
    return df.withColumns({k: c.cast("bigint") for k, c in moves.items()})


def pixel_rotate(df: DataFrame, width: int, height: int, times: int = 1) -> DataFrame:
    """Counter-clockwise quarter turns."""
    x, y = F.col("x"), F.col("y")
    nx, ny = {
        0: (x, y),
        1: (y, F.lit(width) - 1 - x),
        2: (F.lit(width) - 1 - x, F.lit(height) - 1 - y),
        3: (F.lit(height) - 1 - y, x),
    }[times % 4]
    return df.withColumns({"x": nx.cast("bigint"), "y": ny.cast("bigint")})


def pixel_resize_nearest(df: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Every target pixel takes the source pixel under its scaled coordinate.

    A source pixel knows its targets (a coordinate range), so no join is needed.
    """

    def targets(c: str, old: int, new: int) -> Column:
        first = F.ceil(F.col(c) * new / old).cast("bigint")
        last = (F.ceil((F.col(c) + 1) * new / old) - 1).cast("bigint")
        return F.when(last >= first, F.sequence(first, F.greatest(first, last)))

    return (
        df.withColumn("_x", F.explode(targets("x", width, new_width)))
        .withColumn("_y", F.explode(targets("y", height, new_height)))
        .withColumns({"x": F.col("_x"), "y": F.col("_y")})
        .drop("_x", "_y")
    )


# replay tables ---------------------------------------------------------------------------
def q_target(reward: Column, done: Column, next_values: Column, discount: float) -> Column:
    return F.when(done, reward).otherwise(reward + F.array_max(next_values) * discount)


def epsilon_greedy(values: Column, epsilon: Column, draw: Column, random_action: Column, training: bool = True) -> Column:
    """A random action with probability epsilon, else the best one."""
    best = argmax(values).cast("bigint")
    return F.when(draw < epsilon, random_action).otherwise(best) if training else best
