"""Spatial joins over a uniform grid.

A non-equi join would compare every pair of rows of a page. Here both sides are dealt to grid cells, so
the join is an equi-join on (page, cell) that shuffles, sorts and spills like any other, and the exact
predicate is checked on what meets in a cell. A pair that shares several cells is kept in one: that of
the lower left corner of the two ranges' overlap, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.geom import Box
from sheetwise.operators import shapes
from sheetwise.operators.graph import components, written


def _cells(df: DataFrame, box: Box, cell: float, names: tuple[str, str]) -> DataFrame:
    """One row for each cell that the box covers."""
    x0, y0 = (F.floor(v / cell) for v in (box.x0, box.y0))
    x1, y1 = (F.floor(v / cell) for v in (box.x1, box.y1))
    df = df.withColumn(names[0], F.explode(F.sequence(x0, F.greatest(x0, x1))))
    return df.withColumn(names[1], F.explode(F.sequence(y0, F.greatest(y0, y1))))


def grid_join(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, on: list[str], cell: float, where: Column | None = None) -> DataFrame:
    """Pairs of rows with equal `on` whose boxes meet and for which `where` holds.

    Columns of the two sides must differ but for `on`. Rows with a null coordinate meet nothing. Choose
    `cell` near the usual size of a box: a box of size s goes to about (s / cell + 1) ** 2 cells.
    """
    a = _cells(left, left_box, cell, ("_gx", "_gy"))
    b = _cells(right, right_box, cell, ("_gx", "_gy"))
    low_x = F.floor(F.greatest(left_box.x0, right_box.x0) / cell)
    low_y = F.floor(F.greatest(left_box.y0, right_box.y0) / cell)
    out = a.join(b, [*on, "_gx", "_gy"]).filter(left_box.meets(right_box) & (F.col("_gx") == low_x) & (F.col("_gy") == low_y))
    return (out if where is None else out.filter(where)).drop("_gx", "_gy")


def distance_join(left: DataFrame, right: DataFrame, left_at: tuple[Column, Column], right_at: tuple[Column, Column], on: list[str], radius: float, where: Column | None = None) -> DataFrame:
    """Pairs of points with equal `on` at most `radius` apart: each left point is dealt to its own cell, each right
    point to the cells within reach, which are four where a cell is twice the radius."""
    (lx, ly), (rx, ry) = left_at, right_at
    near = (lx - rx) * (lx - rx) + (ly - ry) * (ly - ry) <= float(radius) * float(radius)
    point, square = Box(lx, ly, lx, ly), Box(rx, ry, rx, ry).grown(radius)
    return grid_join(left, right, point, square, on, max(2.0 * radius, 1e-9), near if where is None else where & near)


def copies(rows: DataFrame, by: list[str], key: str, chunk: int = 256) -> DataFrame:
    """One row for each distinct `by` and up to `chunk` of its keys, in the array `_keys`."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    dealt = rows.select(*by, key, F.floor((n - 1) / chunk).alias("_chunk"))
    return dealt.groupBy(*by, "_chunk").agg(F.collect_list(key).alias("_keys")).drop("_chunk")


def alike(rows: DataFrame, on: list[str], key: str, values: list[str], chunk: int = 256) -> tuple[DataFrame, DataFrame]:
    """Keys with equal rows as one class, named by one of its keys: (on, _class, values), the rows of each class, and (on,
    _class, _keys), in arrays of up to `chunk` its keys. Rows with a null in `on` or `key` are left out. Where keys have
    several rows, or values are not numbers, a class may stand as a few, each named by another key.

    Rows pass in the order of their values, and runs of equal ones are cut into arrays."""
    group = Window.partitionBy(*on, key)
    mark = F.shiftright(F.xxhash64(*values), 32)  # brings keys of equal rows together; the rows decide
    named = rows.select(*on, key, *values).dropna(subset=[*on, key]).withColumn("_n", F.count("*").over(group)).withColumn("_mark", F.when(F.col("_n") > 1, F.sum(mark).over(group)))
    named = named.withColumn("_of", F.when(F.col("_n") > 1, F.col(key)))
    alone = (F.when(F.col("_n") == 1, F.col(c)) for c in values)
    dealt = named.repartition(*on, "_mark", *alone).sortWithinPartitions(*on, "_mark", "_of", *values, key)

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def plain(c):
            valid = np.asarray(c.is_valid().to_numpy(zero_copy_only=False))
            return valid, (c.fill_null(pa.scalar(0).cast(c.type)) if c.null_count else c).to_numpy(zero_copy_only=False)

        def same(b, columns, i, j):
            """Whether rows i and j are equal, nulls among them."""
            out = np.ones(len(i), bool)
            for c in columns:
                for v in plain(b.column(c)):
                    out &= v[i] == v[j]
            return out

        def rows_of(b, kept, first, names, lists):
            at = pa.array(kept)
            return pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in [*on, *values]), names, pa.array(np.full(len(kept), first)), lists], names=[*on, *values, "_class", "_first", "_keys"])

        last = name = None

        def pieces(b):
            nonlocal last, name
            n = b.num_rows
            at, keys, size = np.arange(n), b.column(key), b.column("_n").to_numpy()
            many, before = size > 1, np.maximum(at - 1, 0)
            opens = ~many | ~same(b, [*on, "_mark", "_of"], at, before)  # the first row of a key
            opens[0] = True
            # A key goes on with the class of the key before if each of its rows equals that one's.
            twin = np.maximum(at - size, 0)
            equal = (at >= size) & (size[twin] == size) & same(b, [*on, "_mark", *values], at, twin)
            starts = np.flatnonzero(opens)
            goes_on = np.logical_and.reduceat(equal, starts)
            first = b.select([*on, "_mark", *values]).slice(0, 1).to_pylist()[0]
            carried = not many[0] and first == last
            last = None if many[-1] else b.select([*on, "_mark", *values]).slice(n - 1, 1).to_pylist()[0]
            fresh = ~goes_on
            unit = np.arange(len(starts))
            since = np.maximum.accumulate(np.where(fresh, unit, 0))
            ends = np.flatnonzero((unit - since) % chunk == 0)
            units = keys.take(pa.array(starts))
            names = units.take(pa.array(since[ends]))
            if carried:
                names = pc.if_else(pa.array(since[ends] == 0), pa.scalar(name, names.type), names)
                fresh[0] = False
            name = names[-1].as_py()
            lists = pa.ListArray.from_arrays(pa.array(np.append(ends, len(starts)), pa.int32()), units)
            yield rows_of(b, starts[ends], False, names, lists)
            shown = np.flatnonzero(np.repeat(fresh, np.diff(np.append(starts, n))))
            if len(shown):
                yield rows_of(b, shown, True, keys.take(pa.array(shown)), pa.array([[]] * len(shown), lists.type))

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            begin, size = b.num_rows, b.column("_n")[b.num_rows - 1].as_py()
            if size > 1:  # the rows of a key stay together
                back = np.arange(max(0, b.num_rows - size), b.num_rows)
                tail = same(b, [*on, "_of"], back, np.full(len(back), b.num_rows - 1))
                begin = int(back[np.flatnonzero(tail)[0]])
            held = b.slice(begin) if begin < b.num_rows else None
            if begin:
                yield from pieces(b.slice(0, begin))
        if held is not None:
            yield from pieces(held)

    types = dict(named.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*on, *values]), f"_class {types[key]}, _first boolean, _keys array<{types[key]}>"])
    classes = written(dealt.mapInArrow(cut, schema))
    return classes.filter("_first").select(*on, "_class", *values), classes.filter("NOT _first").select(*on, "_class", "_keys")


def close_keys(rows: DataFrame, on: list[str], key: str, ends: list[tuple[str, str]], radius: float) -> DataFrame:
    """on, lo, hi: the pairs of different keys that have points at most radius apart, each once; a row has the points `ends`.

    Rows are shuffled once, to tiles. There keys of equal shape are compared once, and arrays of keys come out, which are
    paired where they stand: neither pairs nor arrays are shuffled."""
    lists = shapes.close_lists(rows, on, key, ends, radius)
    pairs = lists.withColumn("_ka", F.explode("_a")).withColumn("_kb", F.explode("_b")).filter("NOT _same OR _ka < _kb")
    return pairs.select(*on, F.least("_ka", "_kb").alias("lo"), F.greatest("_ka", "_kb").alias("hi"))


def nearest(left: DataFrame, right: DataFrame, left_at, right_at, on: list[str], key: str, other: str, radius: float) -> DataFrame:
    """For each left row the nearest right row within radius; ties to the smaller id.

    Points that coincide are searched once, and of right rows that coincide the smallest id stands for all. Most points have
    one much nearer than the radius, so a third of it is searched first, and only points without a hit there in full."""
    spot, place = [F.col("_lx"), F.col("_ly")], [F.col("_rx"), F.col("_ry")]
    dx, dy = spot[0] - place[0], spot[1] - place[1]
    rows = left.select(*on, key, *(c.alias(n) for c, n in zip(left_at, ("_lx", "_ly"))))
    places = right.groupBy(*on, *(c.alias(n) for c, n in zip(right_at, ("_rx", "_ry")))).agg(F.min(other).alias(other))

    def within(points: DataFrame, reach: float) -> DataFrame:
        pairs = distance_join(points, places, spot, place, on, reach).withColumn("_square", dx * dx + dy * dy)
        return pairs.groupBy(*on, "_lx", "_ly").agg(F.min(F.struct("_square", other)).alias("_n"))

    points = written(rows.select(*on, "_lx", "_ly").distinct())
    first = written(within(points, radius / 3))
    rest = within(points.join(first, [*on, "_lx", "_ly"], "left_anti"), radius)
    won = rows.join(first.unionByName(rest), [*on, "_lx", "_ly"]).groupBy(*on, key).agg(F.min("_n").alias("_n"))
    return won.select(*on, key, F.col(f"_n.{other}").alias(other), F.sqrt("_n._square").alias("gap"))


def vouched(marks: DataFrame, box: Box, key: str, on: list[str], half_x: float, half_y: float, least: int = 2) -> DataFrame:
    """Marks with at least `least` others whose centre lies within half_x by half_y of theirs. Centres that coincide are
    compared once and counted; a mark's own rows, itself among them, are taken off."""
    cx, cy = box.centre
    rows = marks.select(*on, key, cx.alias("ax"), cy.alias("ay"))
    spots = rows.groupBy(*on, "ax", "ay").agg(F.count("*").alias("_rows"))
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    reach = Box(bx - half_x, by - half_y, bx + half_x, by + half_y)
    pairs = grid_join(spots.drop("_rows"), spots.withColumnsRenamed({"ax": "bx", "ay": "by"}), Box(ax, ay, ax, ay), reach, on, max(half_x, half_y))
    around = pairs.groupBy(*on, "ax", "ay").agg(F.sum("_rows").alias("_rows"))
    own = rows.join(rows.withColumnsRenamed({"ax": "bx", "ay": "by"}), [*on, key]).filter(Box(ax, ay, ax, ay).meets(reach)).groupBy(*on, key).agg(F.count("*").alias("_own"))
    near = rows.join(around, [*on, "ax", "ay"]).groupBy(*on, key).agg(F.sum("_rows").alias("_rows"))
    return near.join(own, [*on, key]).select(*on, key, (F.col("_rows") - F.col("_own")).alias("vouchers")).filter(F.col("vouchers") >= least)


def linked(points: DataFrame, key: str, at: tuple[Column, Column], on: list[str], radius: float) -> DataFrame:
    """on, key, group: the least key that each point is connected to by steps of at most radius.

    Points that coincide are one, and those of a cell of two thirds of the radius are connected anyway, so only one link
    for each pair of cells is kept."""
    rows = points.select(*on, key, *(c.alias(n) for c, n in zip(at, ("_x", "_y"))))
    rows = rows.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    spots, links = spot_links(rows, key, on, radius)
    label = components(links.select(F.struct(*on, F.col("an").alias("n")).alias("src"), F.struct(*on, F.col("bn").alias("n")).alias("dst")))
    label = label.select(*(F.col(f"node.{c}").alias(c) for c in on), F.col("node.n").alias("_node"), F.col("component.n").alias("group"))
    spots = spots.join(label, [*on, "_node"], "left").select(*on, "_x", "_y", F.coalesce("group", "_node").alias("group"))
    return rows.join(spots, [*on, "_x", "_y"]).select(*on, key, "group")


def spot_links(rows: DataFrame, key: str, on: list[str], radius: float) -> tuple[DataFrame, DataFrame]:
    """(on, _x, _y, _node), each place with the least key of its cell, and the links (on, an, bn) between such keys."""
    cell = max(radius / 1.5, 1e-9)
    inside = Window.partitionBy(*on, F.floor(F.col("_x") / cell), F.floor(F.col("_y") / cell))
    spots = rows.groupBy(*on, "_x", "_y").agg(F.min(key).alias("_node")).withColumn("_node", F.min("_node").over(inside))
    spots = written(spots)
    a, b = (spots.withColumnsRenamed({"_x": f"{p}x", "_y": f"{p}y", "_node": f"{p}n"}) for p in "ab")
    pairs = distance_join(a, b, (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), on, radius, F.col("an") < F.col("bn"))
    return spots, pairs.select(*on, "an", "bn").distinct()
