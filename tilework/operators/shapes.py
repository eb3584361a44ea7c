"""Outlines of masks and the parting of shapes that touch: contours as closed rings, distances to the background, peaks and flooding.

Rings and floods are followed by pointer jumping and by contracting fragments, so
neither a slide nor a component is ever one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .rasters import runs_of
from .tables import written

#: Directions on the screen, x to the right and y down; turning left is one less.
RIGHT, DOWN, LEFT, UP = range(4)


def _place(x: Column, y: Column) -> Column:
    """A corner as one number."""
    return y.cast("long") * 2**32 + x.cast("long")


def border_edges(found: DataFrame) -> DataFrame:
    """(slide_id, component, x, y, nx, ny, way): edges of pixels between mask and background, the mask on their right; runs (slide_id, component, row, lo, hi) give upright ones of length 1 and level ones as long as they go. A level edge has no component."""
    upright = lambda x, y, ny, way: found.select("slide_id", "component", x.cast("long").alias("x"), y.cast("long").alias("y"), x.cast("long").alias("nx"), ny.cast("long").alias("ny"), F.lit(way).alias("way"))
    row, lo, hi = F.col("row"), F.col("lo"), F.col("hi")
    sides = upright(hi + 1, row, row + 1, DOWN).unionByName(upright(lo, row + 1, row, UP))
    ends = F.explode(F.array(*[F.struct(y.cast("long").alias("y"), x.cast("long").alias("x"), F.lit(b).alias("below"), F.lit(a).alias("above")) for y, b, a in ((row, 1, 0), (row + 1, 0, 1)) for x, b, a in ((lo, b, a), (hi + 1, -b, -a))]))
    marks = found.select("slide_id", ends.alias("e")).groupBy("slide_id", "e.y", "e.x").agg(F.sum("e.below").alias("b"), F.sum("e.above").alias("a"))
    line = Window.partitionBy("slide_id", "y").orderBy("x")
    state = marks.select("slide_id", "y", "x", F.lead("x").over(line).alias("nx"), F.sum("b").over(line).alias("b"), F.sum("a").over(line).alias("a")).where("a + b = 1 and nx is not null")
    below = F.col("b") == 1
    level = state.select("slide_id", F.when(below, F.col("x")).otherwise(F.col("nx")).alias("x"), "y", F.when(below, F.col("nx")).otherwise(F.col("x")).alias("nx"), F.col("y").alias("ny"), F.when(below, RIGHT).otherwise(LEFT).alias("way"))
    return sides.unionByName(level, allowMissingColumns=True)


def _in_block(kind: str, component: str, edges: DataFrame) -> DataFrame:
    """Edges with their block's part of a ring: of rings that stay in the block only the vertices, placed; of others each edge, the way of the next, the edge `part` where the ring leaves the block, the place as the number of edges up to that, and the part's least edge."""
    side = blocks.SIDE

    def follow(table, block):
        x, y, nx, ny, way, br, bc = (blocks.numbers(table, c) for c in ("x", "y", "nx", "ny", "way", "br", "bc"))
        r0, c0, every = br * side - side // 2, bc * side - side // 2, np.arange(len(x))
        start, end = (((block * side) + b - r0) * side + a - c0 for a, b in ((x, y), (nx, ny)))
        leaves = (nx < c0) | (nx >= c0 + side) | (ny < r0) | (ny >= r0 + side)
        first = np.minimum(np.searchsorted(start, end), len(x) - 1)
        second = np.minimum(first + 1, len(x) - 1)
        left = (start[second] == end) & (way[first] != (way + 3) % 4)
        after = np.where(leaves, every, np.where(left, second, first))
        head = blocks.joined(len(x), every, after)
        opened = np.zeros(len(x), bool)
        opened[head[leaves]] = True
        opened = opened[head]
        last = head.copy()
        last[head[leaves]] = every[leaves]
        last = last[head]  # the edge that is the end of the count: where the ring leaves, or its head
        to, count = after.copy(), (~leaves).astype("i8")
        while (go := to != last).any():
            to, count = np.where(go, to[to], to), count + np.where(go, count[to], 0)
        upright = head.copy()
        upright[head[nx == x]] = every[nx == x]
        doubled = np.zeros(len(x), "i8")
        np.add.at(doubled, head, x * ny - nx * y)
        shown = np.flatnonzero(opened | (way[after] != way))
        o, h, e = opened[shown], head[shown], last[shown]
        ids = (y * 2**32 + x) * 4 + way
        size = np.bincount(head, minlength=len(x))
        rows = pa.array(np.where(o, shown, upright[h]))
        ints = [np.where(o, ids[shown], ids[h]), np.where(o, count[shown], size[h] - count[shown]), np.where(o, x[shown], nx[shown]), np.where(o, y[shown], ny[shown]), nx[shown], ny[shown], way[shown], way[after[shown]], ids[e], ids[h]]
        return [table["slide_id"].take(pa.array(shown)), table["component"].take(rows), pa.array(~o), pa.array(doubled[h] < 0), *map(pa.array, ints)]

    there = edges.withColumns({"br": blocks.block_of(F.col("y")), "bc": blocks.block_of(F.col("x"))})
    longs = ", ".join(f"{c} bigint" for c in ("id", "place", "x", "y", "nx", "ny", "way", "next_way", "part", "least"))
    return blocks.by_block(there, ["slide_id", "br", "bc"], ["y", "x", "way"], follow, f"slide_id {kind}, component {component}, closed boolean, hole boolean, {longs}")


def _rings(opened: DataFrame) -> DataFrame:
    """Edges of rings through several blocks (see _in_block) with `head`, their ring's least edge, and their place behind that. Parts of rings are followed as wholes, so the number of rounds grows with the logarithm of the number of parts."""
    by = ["slide_id"]
    ends = opened.where("place = 0").select(*by, "part", "least", _place(F.col("nx"), F.col("ny")).alias("to"), "way")
    starts = opened.groupBy(*by, _place(F.col("x"), F.col("y")).alias("to")).agg(F.count("*").alias("n"), F.first("way").alias("only"))
    # of two edges that begin there the one to the left, so that pixels that meet at a corner only stay together; an edge that is not here is of a ring that stays in its block
    followed = ends.join(starts, [*by, "to"]).select(*by, "part", "least", (F.col("to") * 4 + F.when(F.col("n") == 1, F.col("only")).otherwise((F.col("way") + 3) % 4)).alias("next_edge"))
    sizes = opened.groupBy(*by, "part").agg(F.count("*").alias("n"))
    entered = opened.select(*by, F.col("id").alias("next_edge"), F.col("part").alias("next"))
    chain = written(followed.join(entered, [*by, "next_edge"]).join(sizes, [*by, "part"]))
    state = chain.select(*by, "part", "next", F.col("least").alias("head"))
    while True:  # the least edge among ever more parts that follow
        other = state.select(*by, F.col("part").alias("next"), F.col("next").alias("far"), F.col("head").alias("their"))
        moved = written(state.join(other, [*by, "next"]).select(*by, "part", F.col("far").alias("next"), F.least("head", "their").alias("head"), (F.col("their") < F.col("head")).alias("moved")))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    heads = chain.select(*by, F.col("least").alias("head"), F.col("part").alias("stop"))
    ahead = chain.select(*by, F.col("part").alias("next"), F.col("n").alias("left"))
    left = written(chain.join(state.select(*by, "part", "head"), [*by, "part"]).join(heads, [*by, "head"]).join(ahead, [*by, "next"]).select(*by, "part", "next", "next_edge", "head", "stop", "n", "left"))
    while not left.where("next <> stop").isEmpty():  # how many edges are left from a part's end to that of the head's part
        other = left.select(*by, F.col("part").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        step = F.col("next") != F.col("stop")
        left = written(left.join(other, [*by, "next"]).select(*by, "part", F.when(step, F.col("far")).otherwise(F.col("next")).alias("next"), "next_edge", "head", "stop", "n", (F.col("left") + F.when(step, F.col("more")).otherwise(0)).alias("left")))
    whole = left.groupBy(*by, "head").agg(F.sum("n").alias("all"))
    placed = opened.join(left.join(whole, [*by, "head"]).drop("next", "n"), [*by, "part"])
    first = placed.where(F.col("id") == F.col("head")).select(*by, "head", F.col("place").alias("head_place"))
    behind = F.pmod(F.col("head_place") - F.col("place") - F.col("left"), F.col("all"))
    next_way = F.when(F.col("id") == F.col("part"), F.pmod(F.col("next_edge"), F.lit(4))).otherwise(F.col("next_way"))
    return placed.join(first, [*by, "head"]).select(*by, "component", "id", "head", behind.alias("place"), "x", "y", "nx", "ny", "way", next_way.alias("next_way"))


def contours(found: DataFrame) -> DataFrame:
    """Vertices (slide_id, component, label, roi_id, hole, vertex_id, x, y) of the rings around components (slide_id, component, row, lo, hi) and around their holes.

    Vertices are corners of pixels where a ring turns, in order: clockwise around
    a component, the other way around a hole, so the signed areas of a component's
    rings add up to its pixels. Pixels that meet at a corner are in one ring.
    Rings are followed within blocks; rounds are only for those that leave one.
    """
    parts = written(_in_block(*(found.schema[c].dataType.simpleString() for c in ("slide_id", "component")), border_edges(found)))
    named = lambda df, head, place: df.select("slide_id", "component", F.lit("tissue").alias("label"), F.col(head).alias("roi_id"), "hole", F.col(place).alias("vertex_id"), "x", "y")
    inside, opened = named(parts.where("closed"), "id", "place"), parts.where("not closed")
    if opened.isEmpty():
        return inside
    placed = written(_rings(opened))
    doubled = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    rings = placed.groupBy("slide_id", "head").agg(F.min("component").alias("component"), (doubled < 0).alias("hole"))
    turns = placed.where("next_way <> way").select("slide_id", "head", "place", F.col("nx").alias("x"), F.col("ny").alias("y"))
    return inside.unionByName(named(turns.join(rings, ["slide_id", "head"]), "head", "place"))


def contour_measures(vertices: DataFrame) -> DataFrame:
    """(slide_id, component, area, perimeter, rings, holes) of each component, its holes taken off the area."""
    ring = Window.partitionBy("slide_id", "roi_id").orderBy("vertex_id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    sides = vertices.select("slide_id", "component", "roi_id", "hole", "x", "y", nxt("x").alias("nx"), nxt("y").alias("ny"))
    rings = sides.groupBy("slide_id", "component", "roi_id", "hole").agg(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).alias("doubled"), F.sum(F.abs(F.col("nx") - F.col("x")) + F.abs(F.col("ny") - F.col("y"))).alias("length"))
    return rings.groupBy("slide_id", "component").agg((F.sum("doubled") / 2).cast("long").alias("area"), F.sum("length").alias("perimeter"), F.count("*").alias("rings"), F.sum(F.col("hole").cast("long")).alias("holes"))


def nearest_squares(heights: np.ndarray) -> np.ndarray:
    """Of each place k of a run the least heights[j] ** 2 + (k - j) ** 2, the ends of the run having neighbours of height 0."""
    padded = np.concatenate([[0], heights, [0]]).astype("i8") ** 2
    best, k = padded.copy(), 1
    while k * k < best.max():
        best[k:] = np.minimum(best[k:], padded[:-k] + k * k)
        best[:-k] = np.minimum(best[:-k], padded[k:] + k * k)
        k += 1
    return best[1:-1]


def distances(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, d2): the squared distance of each mask pixel to the nearest pixel outside, which all pixels beyond the mask are.

    First along columns, out of their runs; then along the runs of rows, since
    nothing behind a run's end is nearer than the end. A run is one row of an
    Arrow batch.
    """
    key = F.struct(*keys)
    cells = mask.select(key.alias("slide_id"), "row", "col").distinct()
    turned = runs_of(cells.select("slide_id", F.col("col").alias("row"), F.col("row").alias("col")))
    upright = turned.select("slide_id", F.col("row").alias("col"), "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("row"))
    tall = upright.select("slide_id", "row", "col", (F.least(F.col("row") - F.col("lo"), F.col("hi") - F.col("row")) + 1).alias("g"))
    island = F.col("col") - F.row_number().over(Window.partitionBy("slide_id", "row").orderBy("col"))
    lines = tall.withColumn("island", island).groupBy("slide_id", "row", "island").agg(F.array_sort(F.collect_list(F.struct("col", "g"))).alias("all"))
    lines = lines.select("slide_id", "row", F.col("all")[0]["col"].alias("col"), F.col("all.g").alias("g"))

    def near(batches):
        for batch in batches:
            made = [nearest_squares(np.asarray(x.as_py())) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.int64()))], ["slide_id", "row", "col", "d2"])

    kind = lines.schema
    found = lines.mapInArrow(near, f"slide_id {kind['slide_id'].dataType.simpleString()}, row {kind['row'].dataType.simpleString()}, col {kind['col'].dataType.simpleString()}, d2 array<bigint>")
    return found.select(*[F.col(f"slide_id.{k}").alias(k) for k in keys], "row", "col", F.posexplode("d2").alias("k", "d2")).select(*keys, "row", (F.col("col") + F.col("k")).alias("col"), "d2")


def _precedence() -> Column:
    """Pixels far from the background come first, of equals the one above, then to the left."""
    return F.struct(F.col("d2"), -F.col("row").cast("long"), -F.col("col").cast("long"))


def peaks(dist: DataFrame, keys: list[str], apart: int) -> DataFrame:
    """Pixels of distances() that come before all others of their key within `apart` rows and columns; so two peaks are further apart.

    A cell of `apart` pixels has one candidate, which is held against the pixels of
    the cells around it, an equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / apart)
    ranked = dist.select(*keys, "row", "col", "d2", _precedence().alias("p"), cell("row").alias("r"), cell("col").alias("c"))
    first = ranked.groupBy(*keys, "r", "c").agg(F.max_by(F.struct("row", "col", "d2", "p"), "p").alias("m"))
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    asked = first.select(*keys, "m", F.explode(F.transform(steps, lambda k: F.col("r") + k)).alias("r"), "c").select(*keys, "m", "r", F.explode(F.transform(steps, lambda k: F.col("c") + k)).alias("c"))
    near = (F.abs(F.col("row") - F.col("m.row")) <= apart) & (F.abs(F.col("col") - F.col("m.col")) <= apart)
    beaten = asked.join(ranked, [*keys, "r", "c"]).where(near & (F.col("p") > F.col("m.p"))).select(*keys, "m").distinct()
    return first.select(*keys, "m").join(beaten, [*keys, "m"], "left_anti").select(*keys, "m.row", "m.col", "m.d2")


def _roots(parents: DataFrame) -> DataFrame:
    """(key, frag, root) out of (key, frag, up), by pointer jumping; a root is its own parent."""
    state = written(parents)
    while True:
        other = state.select("key", F.col("frag").alias("up"), F.col("up").alias("further"))
        moved = written(state.join(other, ["key", "up"]).select("key", "frag", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state.withColumnRenamed("up", "root")


def _flood_blocks(dist: DataFrame, tops: DataFrame, keys: list[str]) -> DataFrame:
    """(key, row, col, d2, frag_row, frag_col, peak): each pixel's fragment within its block, named after its peak if it has one. A fragment joins the one behind its greatest border while that is in the block; the neighbours of a block's pixels are there, too, and stay as they are."""
    side, key = blocks.SIDE, F.struct(*keys)
    br, bc = blocks.block_of(F.col("row")), blocks.block_of(F.col("col"))
    pixel = dist.select(key.alias("key"), "row", "col", F.col("d2").cast("bigint").alias("d2"), br.alias("br"), bc.alias("bc"))
    r0, c0 = blocks.origin(F.col("br")), blocks.origin(F.col("bc"))
    shift = lambda on, r, c: F.when(on, F.struct((F.col("br") + r).alias("br"), (F.col("bc") + c).alias("bc")))
    sides = [(F.col("row") == r0, -1, 0), (F.col("row") == r0 + side - 1, 1, 0), (F.col("col") == c0, 0, -1), (F.col("col") == c0 + side - 1, 0, 1)]
    beside = pixel.where(sides[0][0] | sides[1][0] | sides[2][0] | sides[3][0]).select("key", "row", "col", "d2", F.explode(F.array_compact(F.array(*[shift(*x) for x in sides]))).alias("to")).select("key", "row", "col", "d2", "to.br", "to.bc")
    marks = tops.select(key.alias("key"), "row", "col", F.col("d2").cast("bigint").alias("d2"), br.alias("br"), bc.alias("bc"))
    rows = pixel.withColumn("kind", F.lit(0)).unionByName(beside.withColumn("kind", F.lit(1))).unionByName(marks.withColumn("kind", F.lit(2)))  # a mark comes right behind its pixel

    def fragments(table, block):
        kind = blocks.numbers(table, "kind")
        at, marked = np.flatnonzero(kind < 2), np.cumsum(kind < 2)[kind == 2] - 1
        row, col, d2, br, bc = (blocks.numbers(table, c)[at] for c in ("row", "col", "d2", "br", "bc"))
        n, ghost, every = len(at), kind[at] == 1, np.arange(len(at))
        settled = ghost.copy()
        settled[marked] = True
        place = (block[at] * (side + 2) + row - br * side + side // 2 + 1) * (side + 2) + col - bc * side + side // 2 + 1
        rank = np.empty(n, "i8")
        rank[np.lexsort((-col, -row, d2))] = every
        u, v = [], []
        for step in (1, side + 2):
            to = np.minimum(np.searchsorted(place, place + step), n - 1)
            there = (place[to] == place + step) & ~(ghost & ghost[to])
            u.append(every[there])
            v.append(to[there])
        u, v = np.concatenate(u), np.concatenate(v)
        w, frag = np.minimum(rank[u], rank[v]) * n + np.maximum(rank[u], rank[v]), every.copy()
        while True:
            a, b = frag[u], frag[v]
            kept = (a != b) & ~(settled[a] & settled[b])
            u, v, w, a, b = (x[kept] for x in (u, v, w, a, b))
            best, up = np.full(n, -1), every.copy()
            np.maximum.at(best, np.concatenate([a, b]), np.concatenate([w, w]))
            for x, y in ((a, b), (b, a)):
                chosen = (w == best[x]) & ~settled[x] & ~ghost[y]
                up[x[chosen]] = y[chosen]
            both = (up[up] == every) & (every < up)
            up[both] = every[both]
            if (up == every).all():
                break
            while (up[up] != up).any():
                up = up[up]
            frag = up[frag]
        own = np.flatnonzero(~ghost)
        rows, firsts = pa.array(at[own]), pa.array(at[frag[own]])
        return [*(table[c].take(rows) for c in ("key", "row", "col", "d2")), table["row"].take(firsts), table["col"].take(firsts), pa.array(settled[frag[own]])]

    kind = {f.name: f.dataType.simpleString() for f in pixel.schema}
    return blocks.by_block(rows, ["key", "br", "bc"], ["row", "col", "kind"], fragments, f"key {kind['key']}, row {kind['row']}, col {kind['col']}, d2 bigint, frag_row {kind['row']}, frag_col {kind['col']}, peak boolean")


def flood(dist: DataFrame, tops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, peak_row, peak_col): each pixel's peak, by flooding from the peaks, pixels far from the background first; null where no path of neighbours leads to one.

    The border between two neighbours counts by the later one's precedence, then by
    the earlier one's, so all are different and the flood is the one spanning
    forest of greatest borders. It is grown from all fragments at once: a fragment
    without a peak joins the one behind its greatest border; then fragments are
    contracted, and only borders between different ones are kept. That is done
    within blocks first; rounds are for what is left without a peak there.
    """
    whole = lambda c: F.col(c).cast("int").alias(c)
    local = written(_flood_blocks(dist, tops, keys))
    named = [F.col(f"key.{k}").alias(k) for k in keys]
    left = local.where("not peak")
    if left.isEmpty():
        return local.select(*named, whole("row"), whole("col"), F.col("frag_row").cast("int").alias("peak_row"), F.col("frag_col").cast("int").alias("peak_col"))
    frag = _place(F.col("frag_col"), F.col("frag_row"))
    node = _place(F.col("col"), F.col("row"))
    marked = written(local.where("peak").select("key", frag.alias("frag"), F.lit(True).alias("peak")).distinct())
    there = local.select("key", node.alias("to"), frag.alias("b"), _precedence().alias("q"))
    borders = left.select("key", frag.alias("a"), _precedence().alias("p"), F.explode(F.array(*[node + k for k in (1, -1, 2**32, -(2**32))])).alias("to")).join(there, ["key", "to"]).where("a <> b")
    edges = written(borders.groupBy("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.struct(F.least("p", "q").alias("late"), F.greatest("p", "q").alias("early"))).alias("w")))
    names = written(local.select("key", frag.alias("node")).distinct().select("key", "node", F.col("node").alias("frag")))
    while True:
        both = edges.unionByName(edges.select("key", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        best = both.join(marked.select("key", F.col("frag").alias("a")), ["key", "a"], "left_anti").groupBy("key", F.col("a").alias("frag")).agg(F.max_by("b", "w").alias("up"))
        best = written(best)
        if best.isEmpty():
            break
        back = best.select("key", F.col("frag").alias("up"), F.col("up").alias("back"))
        hooked = best.join(back, ["key", "up"], "left").select("key", "frag", F.when((F.col("back") == F.col("frag")) & (F.col("frag") < F.col("up")), F.col("frag")).otherwise(F.col("up")).alias("up"))
        others = hooked.select("key", F.col("up").alias("frag")).distinct().join(hooked.select("key", "frag"), ["key", "frag"], "left_anti").select("key", "frag", F.col("frag").alias("up"))
        roots = _roots(hooked.unionByName(others))
        names = written(names.join(roots, ["key", "frag"], "left").select("key", "node", F.coalesce("root", "frag").alias("frag")))
        renamed = lambda df, c: df.join(roots.select("key", F.col("frag").alias(c), "root"), ["key", c], "left").withColumn(c, F.coalesce("root", c)).drop("root")  # noqa: E731, B023
        edges = written(renamed(renamed(edges, "a"), "b").where("a <> b").groupBy("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w")))
    low = F.lit(2**32)
    found = local.withColumn("node", frag).drop("peak").join(names, ["key", "node"]).join(marked, ["key", "frag"], "left")
    col, row = (F.pmod(F.col("frag") + 2**31, low) - 2**31).cast("int"), F.floor((F.col("frag") + 2**31) / low).cast("int")
    return found.select(*named, whole("row"), whole("col"), F.when(F.col("peak"), row).alias("peak_row"), F.when(F.col("peak"), col).alias("peak_col"))


def split_touching(found: DataFrame, apart: int = 10) -> DataFrame:
    """(slide_id, component, row, col, peak_row, peak_col): the pixels of components (slide_id, component, row, lo, hi), each with the peak of the shape that it belongs to.

    A component has one shape for each peak of its distances; shapes that touch,
    such as two disks, become two where their peaks are more than `apart` from each
    other.
    """
    keys = ["slide_id", "component"]
    dist = written(distances(found.select(*keys, "row", F.explode(F.sequence("lo", "hi")).alias("col")), keys))
    return flood(dist, peaks(dist, keys, apart), keys)
