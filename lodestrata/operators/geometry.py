"""Boxes and what is read from their places: rows, columns, slots and tables.

Boxes are arrays x1, y1, x2, y2. Overlaps and containment are column expressions;
the folds that depend on what came before (rows with a moving centre, running
means of columns) take one page at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.session import ship

# Distance of column centres that are one, of rows and of an engine's lines that are one, and of a block from its column.
COLUMN_GAP, ROW_TOLERANCE, LINE_TOLERANCE, ASSIGN_TOLERANCE = 40.0, 25.0, 25.0, 180.0
# Blocks of a structured row, rows of a table, and the least score of a table's core.
STRUCTURED, TABLE_ROWS, CORE_SCORE = 2, 3, 0.40
# Gap of rows and likeness from which they are one group, near and far.
GROUP_RULES = [(150.0, 0.40), (300.0, 0.65)]


def normal_box(box: Column) -> Column:
    """A box of four finite numbers with its corners in order, else null."""
    ok = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull() | F.isnan(v))
    x, y = F.array(box[0], box[2]), F.array(box[1], box[3])
    return F.when(ok, F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def polygon_box(points: Column) -> Column:
    """The box around a polygon given as an array of (x, y) arrays."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def centre(box: Column) -> Column:
    return F.struct(((box[0] + box[2]) / 2).alias("x"), ((box[1] + box[3]) / 2).alias("y"))


def intersection(a: Column, b: Column) -> Column:
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def overlap_of_first(a: Column, b: Column) -> Column:
    """Intersection as share of the first box; 0 where it has no area."""
    return F.coalesce(intersection(a, b) / F.nullif(area(a), F.lit(0.0)), F.lit(0.0))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Intersection as share of the smaller box; 0 where that has no area."""
    return F.coalesce(intersection(a, b) / F.nullif(F.least(area(a), area(b)), F.lit(0.0)), F.lit(0.0))


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width as share of the narrower box."""
    shared = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return F.coalesce(shared / F.nullif(F.least(a[2] - a[0], b[2] - b[0]), F.lit(0.0)), F.lit(0.0))


def contains_centre(region: Column, box: Column, margin: float = 0.0) -> Column:
    c = centre(box)
    return (c["x"] >= region[0] - margin) & (c["x"] <= region[2] + margin) & (c["y"] >= region[1] - margin) & (c["y"] <= region[3] + margin)


def outside_regions(blocks: DataFrame, regions: DataFrame, on: list[str]) -> DataFrame:
    """Blocks whose centre lies in no region of their page."""
    held = regions.select(*on, F.col("bbox").alias("region"))
    condition = contains_centre(F.col("region"), F.col("bbox"))
    for c in on:
        held = held.withColumnRenamed(c, f"_{c}")
        condition = condition & (F.col(c) == F.col(f"_{c}"))
    return blocks.join(held, condition, "left_anti")


def union_box(boxes: Column) -> Column:
    """The box around all boxes of an array."""
    side = lambda i, f: f(F.transform(boxes, lambda b: b[i]))
    return F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))


def combine_cells(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks of one slot as a cell: texts from top to bottom and left to right, box around all, least confidence."""
    read = F.array_sort(F.collect_list(F.struct(F.col("bbox")[1].alias("y"), F.col("bbox")[0].alias("x"), F.col("text"))))
    return blocks.groupBy(*by).agg(
        F.array_join(F.transform(read, lambda r: r["text"]), " ").alias("text"), union_box(F.collect_list("bbox")).alias("bbox"), F.min("confidence").alias("confidence")
    )


def _middle(values: list[float]) -> float:
    """The upper median."""
    return sorted(values)[len(values) // 2]


def visual_rows(page: pd.DataFrame) -> list[int]:
    """Row number of each block of a page (columns x1, y1, y2), from top to bottom.

    Blocks come by their top and left edge. A block may join every row that it
    overlaps by a fifth of the lower of both heights, or whose median centre is within
    the tolerance; the nearest is taken unless a gap parts the block from all of its
    blocks. Medians keep a tall block from drawing a row away.
    """
    boxes = page[["y1", "y2", "x1"]].astype(float)
    heights = np.maximum(1.0, boxes["y2"] - boxes["y1"])
    usual = _middle(heights.tolist()) if len(page) else 1.0
    gap_limit = max(10.0, 0.75 * usual)
    rows: list[list[tuple[float, float]]] = []
    owner: dict = {}
    for i, (top, bottom, _) in boxes.sort_values(["y1", "x1"], kind="stable").iterrows():
        height, centre_y = max(1.0, bottom - top), (top + bottom) / 2
        found = []
        for r, row in enumerate(rows):
            low, high = min(t for t, _ in row), max(b for _, b in row)
            share = max(0.0, min(bottom, high) - max(top, low)) / max(1.0, min(height, high - low if high > low else height))
            away = abs(centre_y - _middle([(t + b) / 2 for t, b in row]))
            tolerance = max(8.0, ROW_TOLERANCE, 0.55 * max(usual, height, _middle([max(1.0, b - t) for t, b in row])))
            if share >= 0.20 or away <= min(tolerance, max(ROW_TOLERANCE, 1.25 * usual)):
                found.append((away, -share, r))
        best = min(found)[2] if found else None
        if best is not None and min(max(0.0, top - b, t - bottom) for t, b in rows[best]) > gap_limit:
            best = None
        if best is None:
            rows.append([])
            best = len(rows) - 1
        rows[best].append((top, bottom))
        owner[i] = best
    order = sorted(range(len(rows)), key=lambda r: sum(t + b for t, b in rows[r]) / len(rows[r]))
    number = {r: n for n, r in enumerate(order)}
    return [number[owner[i]] for i in page.index]


def line_rows(page: pd.DataFrame, tolerance: float = LINE_TOLERANCE) -> list[int]:
    """Row number of each cell of an engine's table (columns x1, x2, y1, y2): a cell joins the first row whose mean centre is within the tolerance."""
    centres = ((page["y1"] + page["y2"]) / 2).astype(float)
    across = ((page["x1"] + page["x2"]) / 2).astype(float)
    sums: list[list[float]] = []
    owner: dict = {}
    for i in pd.DataFrame({"y": centres, "x": across}).sort_values(["y", "x"], kind="stable").index:
        r = next((r for r, (total, n) in enumerate(sums) if abs(centres[i] - total / n) <= tolerance), len(sums))
        if r == len(sums):
            sums.append([0.0, 0])
        sums[r][0] += centres[i]
        sums[r][1] += 1
        owner[i] = r
    number = {r: n for n, r in enumerate(sorted(range(len(sums)), key=lambda r: sums[r][0] / sums[r][1]))}
    return [number[owner[i]] for i in page.index]


def engine_rows(cells: DataFrame, table: list[str], key: str) -> DataFrame:
    """(table…, key, row_number, column_number) of an engine's cells by their boxes; a cell without one has no place."""
    ship(cells.sparkSession)
    flat = cells.where("bbox IS NOT NULL").select(*table, key, *(F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))

    def place(own: pd.DataFrame) -> pd.DataFrame:
        own = own.reset_index(drop=True).assign(row_number=lambda f: [r + 1 for r in line_rows(f)], middle=lambda f: f["x1"] + f["x2"])
        own = own.sort_values(["row_number", "middle", key], kind="stable")
        return own.assign(column_number=own.groupby("row_number").cumcount() + 1)[[*table, key, "row_number", "column_number"]]

    kinds = ", ".join(f"{c} {flat.schema[c].dataType.simpleString()}" for c in [*table, key])
    return flat.groupBy(*table).applyInPandas(place, f"{kinds}, row_number INT, column_number INT")


def column_centres(values: list[float], gap: float = COLUMN_GAP) -> list[float]:
    """Centres of one-dimensional clusters: a value joins the last cluster while it is near its running mean."""
    centres: list[list[float]] = []
    for v in sorted(values):
        if centres and abs(v - centres[-1][0] / centres[-1][1]) <= gap:
            centres[-1][0] += v
            centres[-1][1] += 1
        else:
            centres.append([v, 1])
    return [s / n for s, n in centres]


def nearest_slot(x: float, centres: list[float]) -> int:
    """The column whose slot holds x: slots end half way between centres."""
    return bisect_right([(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)], x)


def grid_of_blocks(blocks: DataFrame, page: list[str], key: str) -> DataFrame:
    """(page…, key, row_number, column_number) of every block with a box, from its place on the page.

    A page is one task's unit: its blocks are bounded by what fits on a page.
    """
    ship(blocks.sparkSession)
    flat = blocks.where("bbox IS NOT NULL").select(*page, key, *(F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))

    def place(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["y1", "x1", key]).reset_index(drop=True)
        centres = column_centres(own["x1"].tolist())
        return own[[*page, key]].assign(row_number=[r + 1 for r in visual_rows(own)], column_number=[nearest_slot(x, centres) + 1 for x in own["x1"]])

    kinds = ", ".join(f"{c} {flat.schema[c].dataType.simpleString()}" for c in [*page, key])
    return flat.groupBy(*page).applyInPandas(place, f"{kinds}, row_number INT, column_number INT")


def dense_grid(cells: DataFrame, table: list[str]) -> DataFrame:
    """Every slot of each table, the ones without a cell with an empty text.

    Rows and columns are numbered from 1, so slots come from two sequences and not
    from a join.
    """
    size = cells.groupBy(*table).agg(F.max("row_number").alias("r"), F.max("column_number").alias("c"))
    slots = size.withColumn("row_number", F.explode(F.sequence(F.lit(1), F.col("r")))).withColumn("column_number", F.explode(F.sequence(F.lit(1), F.col("c")))).drop("r", "c")
    return slots.join(cells, [*table, "row_number", "column_number"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def likeness(a: list[float], b: list[float]) -> float:
    """Likeness of two rows by the centres of their blocks: .45 for the number, .55 for the places relative to the row's width; 0 under two blocks."""
    if min(len(a), len(b)) < STRUCTURED:
        return 0.0
    scaled = [[(x - min(v)) / max(1.0, max(v) - min(v)) for x in v] for v in (a, b)]
    apart = [abs(x - y) for x, y in zip(*scaled, strict=False)]
    return 0.45 * min(len(a), len(b)) / max(len(a), len(b)) + 0.55 * min(1.0, max(0.0, 1.0 - sum(apart) / len(apart)))


def row_similarity(a: Column, b: Column) -> Column:
    """``likeness`` as a column over arrays in the order of the row."""
    scale = lambda v: F.transform(v, lambda x: (x - F.array_min(v)) / F.greatest(F.lit(1.0), F.array_max(v) - F.array_min(v)))
    n = F.least(F.size(a), F.size(b))
    apart = F.zip_with(F.slice(scale(a), F.lit(1), n), F.slice(scale(b), F.lit(1), n), lambda x, y: F.abs(x - y))
    mean = F.aggregate(apart, F.lit(0.0), lambda t, x: t + x) / n
    return F.when(n >= STRUCTURED, 0.45 * n / F.greatest(F.size(a), F.size(b)) + 0.55 * F.greatest(F.lit(0.0), 1 - mean)).otherwise(0.0)


def row_groups(rows: DataFrame, by: list[str], order: str, starts: Column) -> DataFrame:
    """``rows`` numbered by groups of consecutive rows: a new one begins where ``starts`` holds (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("group_number", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def anchor_groups(rows: DataFrame, page: list[str]) -> DataFrame:
    """Groups of two or more structured rows, one after the other, that lie close and are alike by GROUP_RULES.

    ``rows``: page…, row_number, y (centre) and edges (places of the row's blocks).
    Rows of one block neither join nor part a group.
    """
    w = Window.partitionBy(*page).orderBy("row_number")
    gap, like = F.col("y") - F.lag("y").over(w), row_similarity(F.col("edges"), F.lag("edges").over(w))
    joined = F.lit(False)
    for most, least in GROUP_RULES:
        joined = joined | ((gap <= most) & (like >= least))
    marked = rows.where(F.size("edges") >= STRUCTURED).withColumn("_start", ~F.coalesce(joined, F.lit(False)))
    grouped = row_groups(marked, page, "row_number", F.col("_start")).groupBy(*page, "group_number")
    return grouped.agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row")).where("n_rows >= 2")


def core_score(rows: list[list[float]]) -> float:
    """How much consecutive rows (centres of their blocks) are a table: .30 for structured rows, .40 for blocks near a column, .30 for rows alike."""
    own = [r for r in rows if len(r) >= STRUCTURED]
    if len(rows) < TABLE_ROWS or len(own) < STRUCTURED:
        return 0.0
    centres = column_centres([x for r in own for x in r])
    if len(centres) < 2:
        return 0.0
    near = [min(abs(x - c) for c in centres) <= ASSIGN_TOLERANCE for r in rows for x in r]
    alike = [likeness(a, b) for a, b in zip(own, own[1:], strict=False)]
    return 0.30 * len(own) / len(rows) + 0.40 * sum(near) / len(near) + 0.30 * sum(alike) / len(alike)


def sustained(rows: list[list[float]]) -> tuple[int, int]:
    """First and last of the rows that keep to the columns: the best run by .70 of its mean occupancy and .30 of its share; all rows without such a run."""
    centres = column_centres([x for r in rows if len(r) >= STRUCTURED for x in r])
    whole = (0, len(rows) - 1)
    if len(rows) < TABLE_ROWS or len(centres) < 2:
        return whole

    def occupancy(row: list[float]) -> float:
        held = {c for x in row if abs(x - (c := min(centres, key=lambda v: abs(x - v)))) <= ASSIGN_TOLERANCE}
        return len(held) / len(centres)

    scores = [occupancy(r) for r in rows]
    least = 0.35 if len(centres) >= 4 else 0.50
    runs, start = [], 0
    for kept, run in groupby(scores, key=lambda v: v >= least):
        size = len(list(run))
        if kept and size >= max(4, len(rows) // 5):
            runs.append((start, start + size - 1))
        start += size
    if not runs:
        return whole
    first, last = max(runs, key=lambda r: 0.70 * float(np.mean(scores[r[0] : r[1] + 1])) + 0.30 * (r[1] - r[0] + 1) / len(rows))
    first -= first > 0 and scores[first - 1] >= 0.20
    last += last + 1 < len(rows) and scores[last + 1] >= 0.20
    return first, last


def table_cores(blocks: DataFrame, page: list[str], key: str) -> DataFrame:
    """(page…, first_row, last_row, n_rows, score, bbox) of the table cores of every page: groups of rows that score CORE_SCORE, trimmed to the rows that keep to the columns.

    Rows are those of ``visual_rows``, numbered from 1. A page is one task's unit.
    """
    ship(blocks.sparkSession)
    flat = blocks.where("bbox IS NOT NULL").select(*page, key, *(F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))

    def find(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["y1", "x1", key]).reset_index(drop=True)
        own = own.assign(row=visual_rows(own), x=(own["x1"] + own["x2"]) / 2, y=(own["y1"] + own["y2"]) / 2).sort_values(["row", "x1", key], kind="stable")
        rows = [list(g["x"]) for _, g in own.groupby("row")]
        middles = own.groupby("row")["y"].mean().tolist()
        groups: list[list[int]] = []
        for i in (i for i, r in enumerate(rows) if len(r) >= STRUCTURED):
            last = groups[-1][-1] if groups else None
            if last is not None and any(middles[i] - middles[last] <= most and likeness(rows[last], rows[i]) >= least for most, least in GROUP_RULES):
                groups[-1].append(i)
            else:
                groups.append([i])
        found = []
        for group in groups:
            core = rows[group[0] : group[-1] + 1]
            score = core_score(core) if len(group) >= STRUCTURED else 0.0
            if score >= CORE_SCORE:
                a, b = sustained(core)
                held = own[own["row"].between(group[0] + a, group[0] + b)]
                box = [held["x1"].min(), held["y1"].min(), held["x2"].max(), held["y2"].max()]
                found.append((*own.iloc[0][page], group[0] + a + 1, group[0] + b + 1, b - a + 1, round(score, 6), box))
        return pd.DataFrame(found, columns=[*page, "first_row", "last_row", "n_rows", "score", "bbox"])

    kinds = ", ".join(f"{c} {flat.schema[c].dataType.simpleString()}" for c in page)
    return flat.groupBy(*page).applyInPandas(find, f"{kinds}, first_row INT, last_row INT, n_rows INT, score DOUBLE, bbox ARRAY<DOUBLE>")


def grid_slot(value: Column, lines: Column) -> Column:
    """The slot of a ruled grid that holds a coordinate, from 1 on: between one line and the next; null outside of the lines (sorted)."""
    at = F.size(F.filter(lines, lambda v: v <= value))
    return F.when((at > 0) & (at < F.size(lines)), at)


def grid_cells(blocks: DataFrame, on: list[str]) -> DataFrame:
    """Blocks with the row_number and column_number of the grid cell that holds their centre; ``verticals`` and ``horizontals`` are the ruled lines of their region."""
    c = centre(F.col("bbox"))
    return blocks.withColumns({"row_number": grid_slot(c["y"], F.col("horizontals")), "column_number": grid_slot(c["x"], F.col("verticals"))}).where("row_number IS NOT NULL AND column_number IS NOT NULL").select(
        *on, "row_number", "column_number", *(x for x in blocks.columns if x not in (*on, "verticals", "horizontals"))
    )


def scale_box(box: Column, width: Column, height: Column) -> Column:
    """A box in whole pixels inside its image; one with all corners in 0 … 1 is relative."""
    relative = F.forall(box, lambda v: (v >= 0) & (v <= 1))
    size = lambda i: width if i % 2 == 0 else height
    held = [F.greatest(F.lit(0.0), F.least(size(i), F.when(relative, box[i] * size(i)).otherwise(box[i]))) for i in range(4)]
    sides = [F.least(held[0], held[2]), F.least(held[1], held[3]), F.greatest(held[0], held[2]), F.greatest(held[1], held[3])]
    return F.when(F.size(box) == 4, F.array(*(F.bround(v).cast("int") for v in sides)))


def is_suspicious(box: Column, text_: Column, width: Column, height: Column) -> Column:
    """Whether a paragraph's box can't be its place: without area, or a short text in a strip over much of the page's height."""
    w, h = F.greatest(F.lit(0.0), box[2] - box[0]), F.greatest(F.lit(0.0), box[3] - box[1])
    flat = (w <= 0) | (h <= 0) | (width <= 0) | (height <= 0)
    strip = (h >= 0.40 * height) & (h / F.greatest(w, F.lit(1.0)) >= 12.0) & (F.length(text_) <= 160)
    return F.coalesce(box.isNotNull() & (flat | strip), F.lit(False))


def longest_run(rows: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """(by…, longest): the longest run of consecutive rows whose flag holds; 0 where it never does."""
    w = Window.partitionBy(*by).orderBy(order)
    islands = rows.withColumn("_i", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w))
    runs = islands.groupBy(*by, "_i").agg(F.count(F.when(F.col(flag), 1)).alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("longest"))


def merge_regions(page: pd.DataFrame, gap: float = 60.0) -> pd.DataFrame:
    """Regions of a page (x1, y1, x2, y2) with those that overlap sideways and lie close merged, until none is left."""
    boxes = [tuple(b) for b in page[["x1", "y1", "x2", "y2"]].itertuples(index=False)]
    merged = True
    while merged:
        merged = False
        out: list[tuple] = []
        for b in sorted(boxes, key=lambda b: (b[1], b[0])):
            for i, o in enumerate(out):
                sideways = min(b[2], o[2]) - max(b[0], o[0])
                if sideways > 0.5 * min(b[2] - b[0], o[2] - o[0]) and b[1] - o[3] <= gap:
                    out[i] = (min(b[0], o[0]), min(b[1], o[1]), max(b[2], o[2]), max(b[3], o[3]))
                    merged = True
                    break
            else:
                out.append(b)
        boxes = out
    return pd.DataFrame(boxes, columns=["x1", "y1", "x2", "y2"])


def upper_rank(values: Column, share: float) -> Column:
    """The value at a share of the sorted values, the upper of two middles for the median."""
    ordered = F.sort_array(values)
    at = F.least(F.size(values) - 1, F.floor(F.size(values) * F.lit(share)).cast("int"))
    return F.when(F.size(values) > 0, F.get(ordered, at))


def suppress_overlaps(regions: DataFrame, on: list[str], key: str, priority: str, least: float) -> DataFrame:
    """Regions that no region of higher priority on their page covers by ``least`` of the smaller."""
    other = regions.select(*on, F.col(key).alias("_key"), F.col("bbox").alias("_box"), F.col(priority).alias("_priority"))
    beaten = regions.join(other, on).where((F.col("_priority") > F.col(priority)) & (overlap_of_smaller(F.col("bbox"), F.col("_box")) >= least)).select(key).distinct()
    return regions.join(beaten, key, "left_anti")
