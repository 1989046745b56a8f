"""Assignments of least cost between detections, gaps that links leave, frames of labels matched by overlap, and drift.

Costs are sparse: only candidates within a gate exist, so the detections fall into components that candidates connect, and each
component is solved apart, by shortest augmenting paths in a task. Nothing larger than one component is in one place. Detections
are solved in tiles instead, and what a tile can't settle in wider ones; their candidates are looked up as they are needed.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ragged import spread
from ..sources.shared import stored
from .connect import linked_components
from .graph import contingency
from .near import EPS, Grid, Links, column, finite, listed, overlapping, tiled
from .track import as_links, best_parents, bucketed, linkable, reached, starts_and_ends

#: Slack for rounding in sums of costs along paths.
TOL = 1e-9
#: Detections in the fullest of the tiles in which an assignment begins.
FIRST = 1 << 18
#: How far a phase of an assignment goes, in gaps.
FAR = 16
#: Candidates of an assignment that are looked at together.
HELD = 1 << 19


def assigned(n: int, m: int, edges: list[tuple[int, int, float]], alone: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the least sum of costs, each row or column without a partner costing `alone`.
    A pair dearer than two alone is never made. Each row in turn takes the cheapest augmenting path, which may end in a free
    column or leave some row alone; potentials keep reduced costs from being negative, so paths are found in order of cost."""
    # row i may also go to its own dummy column m + i at the cost 2 * alone (its own and the column it would have had)
    out: list[list[tuple[int, float]]] = [[(m + i, 2 * alone)] for i in range(n)]
    for i, j, c in edges:
        out[i].append((j, c))
    mate_row, mate_col = [-1] * n, [-1] * (m + n)
    pot_row, pot_col = [0.0] * n, [0.0] * (m + n)
    for i in range(n):
        pot_row[i] = min(c for _, c in out[i])
    for start in range(n):
        dist, prev, done = {}, {}, set()
        heap: list[tuple[float, int]] = []
        for j, c in out[start]:
            d = c - pot_row[start] - pot_col[j]
            if d < dist.get(j, np.inf):
                dist[j], prev[j] = d, start
                heapq.heappush(heap, (d, j))
        end, far = -1, 0.0
        while heap:
            d, j = heapq.heappop(heap)
            if j in done:
                continue
            done.add(j)
            if mate_col[j] < 0:
                end, far = j, d
                break
            i = mate_col[j]
            for k, c in out[i]:
                e = d + c - pot_row[i] - pot_col[k]
                if k not in done and e < dist.get(k, np.inf) - 1e-15:
                    dist[k], prev[k] = e, i
                    heapq.heappush(heap, (e, k))
        pot_row[start] += far
        for j in done:
            if mate_col[j] >= 0 and dist[j] <= far:
                pot_row[mate_col[j]] += far - dist[j]
            if dist[j] <= far:
                pot_col[j] -= far - dist[j]
        while end >= 0:
            i = prev[end]
            mate_col[end], end_before = i, mate_row[i]
            mate_row[i] = end
            end = end_before if i != start else -1
    return [(i, j) for i, j in enumerate(mate_row) if 0 <= j < m]


def assigned_links(links: DataFrame, alone: float) -> DataFrame:
    """The links (from_id, to_id, ...) of the assignment of least cost, in which an end without a link costs `alone`. links:
    candidates with `cost`, between frames next to each other, so an id is a start of one frame and an end of another."""
    # the same id is two nodes, as a start and as an end: even and odd numbers
    found = linked_components(links.select((F.col("from_id") * 2).alias("a"), (F.col("to_id") * 2 + 1).alias("b")))
    parts = links.withColumn("node", F.col("from_id") * 2).join(found.select(F.col("id").alias("node"), "component"), "node").drop("node")

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cost", "ascending"), ("from_id", "ascending"), ("to_id", "ascending")])
        starts, i = np.unique(np.asarray(table.column("from_id")), return_inverse=True)
        stops, j = np.unique(np.asarray(table.column("to_id")), return_inverse=True)
        cost = np.asarray(table.column("cost"))
        made = set(assigned(len(starts), len(stops), list(zip(i.tolist(), j.tolist(), cost.tolist(), strict=True)), alone))
        return table.filter(pa.array([p in made for p in zip(i.tolist(), j.tolist(), strict=True)], pa.bool_())).drop_columns(["component"])

    return parts.groupBy("component").applyInArrow(solve, links.schema)


def least_cost(n: int, m: int, listed: Callable, limit: float, gap: float) -> np.ndarray:
    """The column (or -1) of each row in the assignment with the least sum of costs, a row without a column costing `limit`; costs
    are not negative. listed(rows, bounds, prices) gives (row, column, cost): all pairs of cost <= limit with cost - price <= bound."""
    at = Assignment(n, m)
    at.improve(listed, limit, gap)
    return at.mate_row


class Assignment:
    """An assignment under way: mates of rows, what rows pay (`base_row`, how dear the way to a free column is) and columns ask for
    (`base_col`, 0 if free and never more), and which rows are open: all that aren't left alone for good. No pair costs less than its
    row pays and its column asks for together, and a made pair costs just that, so that when each open row has a column, no other
    assignment is cheaper. Rows pay more and columns less with time, so pairs with a frozen column, one that others may reassign at
    the same time, stay within these bounds."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.mate_row, self.paid, self.live = np.full(n, -1), np.zeros(n), np.ones(n, bool)
        self.base_row, self.base_col, self.frozen = np.zeros(n), np.zeros(m), np.zeros(m, bool)

    def improve(self, listed: Callable, limit: float, gap: float) -> None:
        """Gives each open row a column or leaves it alone, unless its cheapest way leads to a frozen column: then it stays open.

        Each phase finds the shortest paths from all rows to free columns (or to a row that is rather left alone, or a frozen column)
        at once, by reduced costs, until nine in ten of the waiting rows are reached; distances become prices, by which these paths
        cost nothing, and one path to each end is taken. Prices only fall, so pairs beyond a row's bound stay beyond it, and a list is
        whole while the row's own price is within its bound; lists hold some `gap` more than that, so their size doesn't depend on how
        many lie within the gate. A phase goes no farther than FAR gaps for the same reason: it raises prices by that then, and lists are
        made anew by these. What leads to a frozen column will not lead elsewhere later, as other ways only get longer."""
        n, m, mate_row, paid, live = self.n, self.m, self.mate_row, self.paid, self.live
        base_row, base_col = self.base_row, self.base_col
        if not n or not m or limit <= 0:
            live[:] = False
            return
        mate_col = np.full(m, -1)
        taken = np.flatnonzero(mate_row >= 0)
        mate_col[mate_row[taken]] = taken
        on, most = live.copy(), FAR * gap
        bound, want = np.full(n, -1.0), np.minimum(base_row + gap, limit)
        row, col, cost = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        while True:
            renewed = np.flatnonzero((want > bound) & on)
            if len(renewed):
                keep = (want <= bound)[row] & on[row]
                row, col, cost = row[keep], col[keep], cost[keep]
                more = listed(renewed, want[renewed], base_col)
                row, col, cost = (np.concatenate([a, b.astype(a.dtype, copy=False)]) for a, b in zip((row, col, cost), more, strict=True))
                order = np.argsort(col, kind="stable")
                row, col, cost = row[order], col[order], cost[order]
                del more, order, keep
                start = np.searchsorted(col, np.arange(m + 1, dtype=np.int32))
                bound = np.maximum(bound, want)
            waiting = np.flatnonzero((mate_row < 0) & on)
            if not len(waiting):
                break
            taken = np.flatnonzero(mate_col >= 0)
            step = paid[mate_col[taken]].mean() / 4 if len(taken) else np.inf
            price_row, by = np.where(on, limit, -np.inf), np.full(n, -1)
            price = base_col.copy()
            price[taken] = paid[mate_col[taken]] - limit
            # columns to look from, nearest first; those of rows that would rather be left alone come in when it is their turn
            far = base_col - price
            free = np.flatnonzero(mate_col < 0)
            late = taken[np.argsort(far[taken], kind="stable")]
            late_far = far[late]
            at, used, top = free, 0, -1.0
            open_ = np.zeros(m, bool)
            open_[at] = True
            while True:
                far = base_col[at] - price[at]
                low = min(far.min(initial=np.inf), late_far[used] if used < len(late) else np.inf)
                if low > top:
                    if top >= most or np.count_nonzero(price_row[waiting] - base_row[waiting] <= top) >= 0.9 * len(waiting):
                        break
                    top = min(low + step, most)
                    if low > most:
                        break
                    upto = int(np.searchsorted(late_far, top, side="right"))
                    more = late[used:upto]
                    more, used = more[~open_[more]], upto
                    open_[more] = True
                    at = np.concatenate([at, more])
                    far = base_col[at] - price[at]
                front, at = at[far <= top], at[far > top]
                open_[front] = False
                size = start[front + 1] - start[front]
                edge = spread(start[front], size)
                r, key = row[edge], cost[edge] - np.repeat(price[front], size)
                less = np.flatnonzero(key < price_row[r] - TOL)
                r, key = r[less], key[less]
                np.minimum.at(price_row, r, key)
                best = key == price_row[r]
                r = r[best]
                by[r] = col[edge[less[best]]]
                r = r[mate_row[r] >= 0]
                price[mate_row[r]] = paid[r] - price_row[r]
                r = mate_row[r]
                r = np.unique(r[~open_[r]])
                open_[r] = True
                at = np.concatenate([at, r])
            reached_ = price_row - base_row <= top
            price_row = np.where(on, np.minimum(price_row, base_row + top), base_row)
            if (on & (price_row > bound) & (bound < limit)).any():
                # a row that no way has reached yet gets a list twice as wide, not one of all pairs
                further = np.maximum(np.minimum(price_row, 2 * bound), bound) + gap
                want = np.where(on & (price_row > bound - gap / 2), np.minimum(further, limit), bound)
                continue
            price[taken] = paid[mate_col[taken]] - price_row[mate_col[taken]]
            base_row, base_col = price_row, price
            # rows in a row: who must give way to whom, up to the end of the path
            last = np.arange(n)
            way = np.flatnonzero(by >= 0)
            way = way[mate_col[by[way]] >= 0]
            last[way] = mate_col[by[way]]
            while (last[last] != last).any():
                last = last[last]
            waiting = waiting[reached_[waiting]]
            end = by[last[waiting]]
            stopped = (end >= 0) & self.frozen[end]
            on[waiting[stopped]] = False
            waiting, end = waiting[~stopped], end[~stopped]
            end = np.where(end >= 0, end, m + last[waiting])
            order = np.lexsort((waiting, price_row[waiting], end))
            now = waiting[order][np.diff(end[order], prepend=-1) > 0]
            while len(now):
                to = by[now]
                alone = now[to < 0]
                live[alone], on[alone], mate_row[alone] = False, False, -1
                now, to = now[to >= 0], to[to >= 0]
                out = mate_col[to]
                mate_col[to], mate_row[now] = now, to
                now = out[out >= 0]
            made = np.flatnonzero(mate_row[row] == col)
            paid[row[made]] = cost[made]
        self.base_row, self.base_col = base_row, base_col


#: A detection of a pair of frames: its mate and what it pays or asks for; of the side of which there are `few`, which looks for
#: partners, also whether it is open, and the parts of the pair's cost.
UNDER_WAY = "side int, few int, t long, t2 long, id long, y double, x double, size double, known boolean, mate long, price double, open boolean, d2 double, rel double"


def _in_tile(table: pa.Table, gate: float, alone: float) -> Iterator[pa.RecordBatch]:
    """The tile's own detections (`core`), assigned as far as what lies around it doesn't matter. Pairs with a detection outside stay."""
    core_, mate_ = column(table, "core"), table.column("mate").fill_null(-1).to_numpy()
    any_mate, price_, open_ = table.column("mate").is_valid().to_numpy(), column(table, "price"), column(table, "open")
    few = int(table.column("few")[0].as_py())
    links = Links(table, gate, 1.0)
    at, to = (links.parts[s]["at"] for s in (few, 1 - few))
    me, other = links.parts[few], links.parts[1 - few]

    def found(ids: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the mates of these rows of the table are among the ids, or -1."""
        where = np.searchsorted(ids, mate_[i])
        ok = any_mate[i] & (where < len(ids))
        ok[ok] = ids[where[ok]] == mate_[i][ok]
        return np.where(ok, where, -1)

    partner = found(other["id"], at)
    inside = core_[to]
    rows = np.flatnonzero(core_[at] & open_[at] & (~any_mate[at] | ((partner >= 0) & inside[partner] if len(to) else False)))
    is_row = np.zeros(len(at) + 1, bool)
    is_row[rows] = True
    work = Assignment(len(rows), len(to))
    work.mate_row, work.base_row, work.base_col = partner[rows], price_[at[rows]], price_[to]
    work.frozen = ~inside | (any_mate[to] & ~is_row[found(me["id"], to)])
    cost_of = lambda i, p: links.cost(i, p) if few == 0 else links.cost(p, i)
    made = np.flatnonzero(work.mate_row >= 0)
    work.paid[made] = cost_of(rows[made], work.mate_row[made])[2]
    limit, gap = 2 * alone, 0.0
    if len(to):
        grid = Grid(other["y"], other["x"], gate)
        # some eight partners a row to begin with, and fewer where prices are known
        gap = 8 / np.pi * np.count_nonzero(np.diff(grid.start)) * grid.c**2 / len(to)
        gap = max(gap / 4 if work.base_row.any() else gap, limit / 4096)

    def listed(which: np.ndarray, bounds: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, ...]:
        # no price is above 0, so a pair within the bound is no farther apart than its root
        cells = np.ceil(np.minimum(np.sqrt(bounds), gate) / grid.c).astype(np.int64) + 1
        got = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))]
        for r in np.unique(cells):
            i, most = which[cells == r], bounds[cells == r]
            for _, _, q, p in grid.around(me["y"][rows[i]], me["x"][rows[i]], int(r), HELD):
                d2, _, cost = cost_of(rows[i[q]], p)
                ok = (d2 <= gate * gate) & (cost <= limit) & (cost - price[p] <= most[q])
                got.append((i[q[ok]].astype(np.int32), p[ok].astype(np.int32), cost[ok]))
        return tuple(np.concatenate(c) for c in zip(*got, strict=True))

    work.improve(listed, limit, gap)
    mate, mated, price, still = mate_.copy(), any_mate.copy(), price_.copy(), open_.copy()
    parts = {c: table.column(c).to_numpy().copy() for c in ("d2", "rel")}
    price[at[rows]], still[at[rows]] = work.base_row, work.live
    ours = to[~work.frozen]
    price[ours], mated[ours] = work.base_col[~work.frozen], False
    mated[at[rows]] = False
    made = np.flatnonzero(work.mate_row >= 0)
    i, j = at[rows[made]], to[work.mate_row[made]]
    mated[i], mated[j], mate[i], mate[j] = True, True, other["id"][work.mate_row[made]], me["id"][rows[made]]
    parts["d2"][i], parts["rel"][i], _ = cost_of(rows[made], work.mate_row[made])
    mine = np.concatenate([at, to])
    mine = mine[core_[mine]]
    out = table.select([c.split()[0] for c in UNDER_WAY.split(", ")]).take(pa.array(mine))
    new = {"mate": pa.array(mate[mine], mask=~mated[mine]), "price": pa.array(price[mine]), "open": pa.array(still[mine]), "d2": pa.array(parts["d2"][mine]), "rel": pa.array(parts["rel"][mine])}
    for name, values in new.items():
        out = out.set_column(out.schema.get_field_index(name), name, values)
    yield from out.to_batches(max_chunksize=1 << 17)


def _frames(points: DataFrame, gate: float) -> DataFrame:
    """(t, few, y0, x0, wide, base), a row a pair of frames: the side of fewer detections, the least place, the extent, and the side
    of the widest tiles (4 gates at least) none of which holds more than FIRST detections."""
    n = lambda s: F.count_if(F.col("side") == s)
    reach = F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x"))
    frames = stored(points.groupBy("t").agg(F.when(n(0) <= n(1), 0).otherwise(1).alias("few"), F.min("y").alias("y0"), F.min("x").alias("x0"), reach.alias("wide")))
    cell = [F.floor((F.col(c) - F.col(f"{c}0")) / (4 * gate)).alias(f"b{c}") for c in ("y", "x")]
    cells = points.join(F.broadcast(frames), "t").groupBy("t", *cell).count().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(12))))
    wider = cells.groupBy("t", "level", *[F.expr(f"shiftright(b{c}, level)").alias(f"b{c}") for c in ("y", "x")]).agg(F.sum("count").alias("n"))
    full = wider.groupBy("t", "level").agg(F.max("n").alias("n"))
    level = full.groupBy("t").agg(F.coalesce(F.max(F.when(F.col("n") <= FIRST, F.col("level"))), F.lit(0)).alias("level"))
    return stored(frames.join(level, "t").select(*frames.columns, (4 * gate * F.pow(2.0, "level")).alias("base")))


def assigned_best(d: DataFrame, gate: float, alone: float) -> DataFrame:
    """assigned_links(candidates(d, gate), alone) without a table of candidates. Each pair of frames is solved in tiles of some FIRST
    detections at most; ways that lead out of a tile wait for the next round, in shifted tiles and then in ones twice as wide,
    where what is assigned and what it costs is taken up again. Only tiles with detections that wait are solved anew, and pairs of frames
    without any go no further. Each round is a table in the shared folder. Of assignments of the same cost it may be another."""
    points = stored(starts_and_ends(d))
    frames = F.broadcast(_frames(points, gate))  # six numbers a pair of frames
    begun = points.join(frames.select("t", "few"), "t").withColumns({"mate": F.lit(None).cast("long"), "price": F.lit(0.0), "open": F.lit(True), "d2": F.lit(0.0), "rel": F.lit(0.0)})
    names = [c.split()[0] for c in UNDER_WAY.split(", ")]
    left, done = stored(begun.select(*names)), []
    halo = min(gate, (2 * max(alone, 0.0)) ** 0.5) * (1 + EPS)
    looks = F.col("side") == F.col("few")
    for turn in count():
        level, shift = turn // 2, (0.0 if turn == 0 else 0.25) + 0.5 * (turn % 2)
        side = F.col("base") * 2.0**level
        at = left.join(frames.drop("few"), "t").withColumn("width", side).withColumn("shift", F.when(side > F.col("wide"), 0.0).otherwise(shift))
        place = lambda c, e=0.0: F.floor((F.col(c) + e - F.col(f"{c}0")) / F.col("width") + F.col("shift"))
        at = at.withColumns({"oy": place("y"), "ox": place("x")})
        tiles = stored(at.where(looks & F.col("open") & F.col("mate").isNull()).select("t", F.col("oy").alias("ty"), F.col("ox").alias("tx")).distinct())
        busy = F.broadcast(tiles.select("t").distinct())
        done.append(left.join(busy, "t", "left_anti"))
        if tiles.isEmpty():
            return as_links(_made(done), d)
        tiles = F.broadcast(tiles)  # three numbers for each tile that is solved
        e = F.when(looks, 0.0).otherwise(halo)
        for c in ("y", "x"):
            at = at.withColumn(f"t{c}", F.explode(F.sequence(place(c, -e), place(c, e))))
        core = (F.col("ty") == F.col("oy")) & (F.col("tx") == F.col("ox"))
        sent = at.join(tiles, ["t", "ty", "tx"], "left_semi").select(*names, "ty", "tx", core.alias("core"))
        solved = listed(sent, ["t", "ty", "tx"], UNDER_WAY, lambda table: _in_tile(table, gate, alone))
        idle = at.where(core).join(busy, "t", "left_semi").join(tiles, ["t", "ty", "tx"], "left_anti").select(*names)
        left = stored(solved.unionByName(idle))


def _made(tables: list[DataFrame]) -> DataFrame:
    """The links (LINK_ROWS) of tables of detections under way."""
    start = F.col("few") == 0
    ends = [F.when(start, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("id", "mate", "from_id"), ("mate", "id", "to_id"))]
    parts = [d.where("side = few and mate is not null").select(*ends, "t", "t2", "d2", F.col("rel").alias("rel_size"), (F.col("d2") + F.col("rel")).alias("cost")) for d in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def gap_candidates(d: DataFrame, links: DataFrame, gate: float, most: int) -> DataFrame:
    """(from_id, to_id, dt, d2, cost): ends of tracks (no link on) and starts (no link before) within the gate, 2 to `most`
    frames later; cost is the squared distance over the frames passed. Listed in tiles, as candidates are."""
    ends = d.join(links.select(F.col("from_id").alias("id")), "id", "left_anti")
    starts = d.join(links.select(F.col("to_id").alias("id")), "id", "left_anti")
    # an end meets the starts of all its later frames in one tile; the tile's key is the end's frame
    starts = starts.withColumn("t2", F.explode(F.sequence(F.lit(2), F.lit(most)))).withColumn("t2", F.col("t") - F.col("t2"))
    pair = linkable(ends.withColumn("t2", F.col("t")), starts, gate)
    pair = pair.select("from_id", "to_id", (F.col("to_t") - F.col("from_t")).alias("dt"), "d2")
    return pair.withColumn("cost", F.col("d2") / F.col("dt"))


def divisions(links: DataFrame, made: DataFrame, gate: float) -> DataFrame:
    """(parent, first, second, cost): of each start with a link the best further candidate whose end has none, within the gate:
    a track that splits. A candidate serves one parent, the one it costs least."""
    free = links.join(made.select("to_id"), "to_id", "left_anti").where(F.col("d2") <= gate * gate)
    open_ = free.join(made.select("from_id", F.col("to_id").alias("first")), "from_id")
    best = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("cost", "from_id", "to_id"))
    one = open_.withColumn("r", best("to_id")).where("r = 1").withColumn("s", best("from_id")).where("s = 1")
    return one.select(F.col("from_id").alias("parent"), "first", F.col("to_id").alias("second"), "cost")


def divided(d: DataFrame, made: DataFrame, gate: float) -> DataFrame:
    """divisions(candidates, made, gate) without a table of candidates, where the candidates' gate is no smaller."""
    one = best_parents(d, made, gate)
    best = F.row_number().over(Window.partitionBy("from_id").orderBy("cost", "from_id", "to_id"))
    one = one.withColumn("s", best).where("s = 1").join(made.select("from_id", F.col("to_id").alias("first")), "from_id")
    return one.select(F.col("from_id").alias("parent"), "first", F.col("to_id").alias("second"), "cost")


def match_frames(labels: DataFrame, least: float) -> DataFrame:
    """(img, a, b, n, iou): of labels a and b the pairs with that intersection over union at least, each label in one pair, the best
    first: above a half no label has two such partners, below it pairs are each other's best."""
    joint = contingency(labels.where("a != 0 and b != 0"))
    size = lambda c: labels.where(F.col(c) != 0).groupBy("img", c).agg(F.count("*").alias(f"n{c}"))
    pair = joint.join(size("a"), ["img", "a"]).join(size("b"), ["img", "b"])
    pair = pair.withColumn("iou", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 9)).where(F.col("iou") >= least)
    best = lambda key: F.row_number().over(Window.partitionBy("img", key).orderBy(F.desc("iou"), "a", "b"))
    return pair.withColumn("r", best("a")).withColumn("s", best("b")).where("r = 1 and s = 1").select("img", "a", "b", "n", F.round("iou", 6).alias("iou"))


def slice_overlaps(labels: DataFrame) -> DataFrame:
    """(img, z, a, b, n, iou): labels a in plane z and b in plane z + 1 that share places: overlap as a feature of candidates."""
    here = labels.where("label != 0").select("img", "z", "y", "x", F.col("label").alias("a"))
    there = labels.where("label != 0").select("img", (F.col("z") - 1).alias("z"), "y", "x", F.col("label").alias("b"))
    shared = here.join(there, ["img", "z", "y", "x"]).groupBy("img", "z", "a", "b").agg(F.count("*").alias("n"))
    na, nb = here.groupBy("img", "z", "a").agg(F.count("*").alias("na")), there.groupBy("img", "z", "b").agg(F.count("*").alias("nb"))
    out = shared.join(na, ["img", "z", "a"]).join(nb, ["img", "z", "b"])
    return out.select("img", "z", "a", "b", "n", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("iou"))


def drift(d: DataFrame, links: DataFrame) -> DataFrame:
    """(t, dy, dx, sum_y, sum_x): the mean shift of the links that start in frame t, and all shifts up to it. A frame is a row here."""
    a = d.select(F.col("id").alias("from_id"), "t", F.col("y").alias("y1"), F.col("x").alias("x1"))
    b = d.select(F.col("id").alias("to_id"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    shift = links.select("from_id", "to_id").join(a, "from_id").join(b, "to_id")
    frames = shift.groupBy("t").agg(F.avg(F.col("y2") - F.col("y1")).alias("dy"), F.avg(F.col("x2") - F.col("x1")).alias("dx"))
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return frames.select("t", "dy", "dx", F.sum("dy").over(upto).alias("sum_y"), F.sum("dx").over(upto).alias("sum_x"))


def boundary_f1(labels: DataFrame, tolerance: int) -> DataFrame:
    """(img, precision, recall, f1) of b's boundary cells against a's, in each plane: a cell is on the boundary if one of its four
    neighbours there has another label, and is hit if the other side has one within the tolerance. Counts are of all planes."""
    sides = {}
    for c in ("a", "b"):
        cells = labels.select("img", "z", "y", "x", F.col(c).alias("label"))
        next_ = lambda axis: F.lead("label").over(Window.partitionBy("img", "z", "x" if axis == "y" else "y").orderBy(axis))
        last = lambda axis: F.lag("label").over(Window.partitionBy("img", "z", "x" if axis == "y" else "y").orderBy(axis))
        differs = [F.coalesce(f(axis) != F.col("label"), F.lit(False)) for axis in ("y", "x") for f in (next_, last)]
        sides[c] = cells.where(F.col("label").isNotNull()).withColumn("edge", differs[0] | differs[1] | differs[2] | differs[3]).where("edge").select("img", "z", "y", "x")
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-tolerance, tolerance + 1) for j in range(-tolerance, tolerance + 1) if i * i + j * j <= tolerance * tolerance])

    def hits(mine: DataFrame, other: DataFrame, name: str) -> DataFrame:
        near = other.select("img", "z", "y", "x", F.explode(steps).alias("o")).select("img", "z", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
        found = mine.join(near.withColumn("hit", F.lit(1)), ["img", "z", "y", "x"], "left")
        return found.groupBy("img").agg((F.count("hit") / F.count("*")).alias(name))

    both = hits(sides["b"], sides["a"], "precision").join(hits(sides["a"], sides["b"], "recall"), "img", "full").na.fill(0.0, ["precision", "recall"])
    total = F.col("precision") + F.col("recall")
    return both.select("img", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0), 6).alias("f1"))


def lineages(d: DataFrame, links: DataFrame, splits: DataFrame) -> DataFrame:
    """(lineage_id, n_detections, n_divisions, t_start, t_end): what links and divisions (parent, second) hold together; its id is
    its least detection's."""
    edges = links.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(splits.select("parent", "second"))
    found = linked_components(edges)
    at = d.join(found, "id", "left").withColumn("lineage_id", F.coalesce("component", "id"))
    at = at.join(splits.select(F.col("parent").alias("id"), F.lit(1).alias("divides")).distinct(), "id", "left")
    return at.groupBy("lineage_id").agg(F.count("*").alias("n_detections"), F.count("divides").alias("n_divisions"), F.min("t").alias("t_start"), F.max("t").alias("t_end"))


def _overlap(least: float) -> Column:
    """Whether box and box2 (columns y, x, half and y2, x2, half2) have that intersection over union at least."""
    side = lambda a: F.greatest(F.least(F.col(a) + F.col("half"), F.col(f"{a}2") + F.col("half2")) - F.greatest(F.col(a) - F.col("half"), F.col(f"{a}2") - F.col("half2")), F.lit(0.0))
    shared = side("y") * side("x")
    return (shared > 0) & (shared / (4 * F.col("half") * F.col("half") + 4 * F.col("half2") * F.col("half2") - shared) >= least)


#: box2 goes before box
STRONGER = "score2 > score or (score2 = score and id2 < id)"


def _second(d: DataFrame, *more: str) -> DataFrame:
    return d.select("t", "by", "bx", *[F.col(c).alias(f"{c}2") for c in ("id", "y", "x", "half", "score")], *more)


def overlapping_boxes(d: DataFrame, least: float, most: float) -> DataFrame:
    """(id, other): boxes of one frame (half sides `half`, at most `most`) whose intersection over union is `least` at least, the
    other with the larger score, or the same and the smaller id. Pairs are listed in tiles of eight times the largest half side, so only
    boxes are shuffled. A box without a place or a side overlaps none."""
    ids = d.schema["id"].dataType
    at = d.where(finite("y", "x", "half") & F.col("t").isNotNull() & F.col("score").isNotNull())
    at = tiled(at.select("t", "id", *[F.col(c).cast("double").alias(c) for c in ("y", "x", "half")], "score"), 2 * most, 2 * most * (1 + EPS))
    form = f"id {ids.simpleString()}, beats boolean, partners array<{ids.simpleString()}>"
    found = listed(at, ["t", "ty", "tx"], form, lambda table: overlapping(table, least, most)).select("id", "beats", F.explode("partners").alias("p"))
    return found.select(F.when(F.col("beats"), F.col("p")).otherwise(F.col("id")).alias("id"), F.when(F.col("beats"), F.col("id")).otherwise(F.col("p")).alias("other"))


def _unbeaten(d: DataFrame, least: float, most: float) -> DataFrame:
    """The boxes that no stronger one overlaps. The strongest of each bucket of half the largest half side beat nearly all others in a
    crowded frame, each of which meets nine of them; the few left are compared with all around."""
    side = most / 2
    strongest = bucketed(d, side).groupBy("t", "by", "bx").agg(F.max_by(F.struct("id", "y", "x", "half", "score"), F.struct("score", F.bitwise_not("id"))).alias("p")).select("t", "p.*")
    rest = _without(d, strongest, least, side, STRONGER)
    wide = reached(rest, 2 * most, 1)
    beaten = wide.join(_second(bucketed(d, 2 * most)), ["t", "by", "bx"]).where(_overlap(least) & F.expr(STRONGER)).select("id").distinct()
    return rest.join(beaten, "id", "left_anti")


def _without(d: DataFrame, others: DataFrame, least: float, side: float, if_: str) -> DataFrame:
    """d without the boxes that one of the others, in the buckets around, overlaps."""
    wide = _second(reached(others, side, 1)).select(*[F.col(c).alias(f"{c}_") for c in ("t", "by", "bx")], "id2", "y2", "x2", "half2", "score2")
    same = (F.col("t") == F.col("t_")) & (F.col("by") == F.col("by_")) & (F.col("bx") == F.col("bx_"))
    return bucketed(d, side).join(wide, same & _overlap(least) & F.expr(if_), "left_anti").drop("by", "bx")


def kept_boxes(d: DataFrame, least: float, most: float) -> DataFrame:
    """The boxes kept if each is taken by falling score, then id, unless it overlaps one kept before (as in overlapping_boxes): rounds
    of unbeaten boxes among those left, which take away what they overlap. Each round is two tables in the shared folder; no table of
    pairs is made. Ids are keys; a box without a frame, place, side or score is near none and stays."""
    whole = finite("y", "x", "half") & F.col("t").isNotNull() & F.col("score").isNotNull() & F.col("id").isNotNull()
    left, kept = stored(d.where(whole).select("id", "t", "y", "x", "half", "score")), d.where(~whole).select("id")
    while not left.isEmpty():
        best = stored(_unbeaten(left, least, most))
        kept = kept.union(best.select("id"))
        left = stored(_without(left.join(best.select("id"), "id", "left_anti").select(*left.columns), best, least, 2 * most, "true"))
    return d.join(kept, "id", "left_semi").select(*d.columns)
