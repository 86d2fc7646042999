"""Same-size clusters: capacity-bound greedy assignment and pairwise swaps.

The greedy assignment is one pass over all rows in order of their distance, each to its nearest cluster with room.  Between
two clusters becoming full that is a plain nearest-cluster pass, so K rounds over the data give it at any size; up to
``MAX_ROWS`` rows it runs in one task.  Swaps depend on all swaps before them.  ``same_size`` makes them in one task and takes
at most ``MAX_ROWS`` rows; ``by_swaps`` makes the same ones at any size, tile by tile, and ``balanced`` picks between the two.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meanfield.functions.storage import discard, stored
from meanfield.functions.vectors import matrix

from .assign import PARTIAL, positions, reduced, sums_batch

MAX_ROWS = 100_000
#: Rows whose wishes are counted together; the driver sees K numbers for each.
BLOCK = 65_536
#: Rows of one side of a tile of swaps, and coordinates in a row of the packed table.
TILE = 131_072
PACKED = 1 << 19
#: Rows whose least distances are known together, at least, and the most such numbers.
GROUP = 128
CELLS = 1 << 24


def greedy(d: np.ndarray) -> np.ndarray:
    """Rows leave a heap farthest first (ties: lowest position); a full cluster sends its row to the nearest free one."""
    n, k = d.shape
    room = np.full(k, -(-n // k))
    heap = [(-float(d[i].min()), i, int(d[i].argmin())) for i in range(n)]
    heapq.heapify(heap)
    out = np.zeros(n, np.int64)
    while heap:
        _, i, c = heapq.heappop(heap)
        if room[c]:
            out[i] = c
            room[c] -= 1
        else:
            c = int(np.where(room > 0, d[i], np.inf).argmin())
            heapq.heappush(heap, (-float(d[i, c]), i, c))
    return out


def swaps(d: np.ndarray, cid: np.ndarray) -> int:
    """For each row that has a nearer centroid, in order: swaps it with the first later row if that lowers the cost."""
    return swap_rows(d, cid, d.min(1) < d[np.arange(len(d)), cid])


def swap_rows(d: np.ndarray, cid: np.ndarray, todo: np.ndarray, later: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Swaps each row in ``todo``, in order, with the first later row if that lowers the cost; the number of swaps.

    Later rows are those behind it, or those of ``later`` (distances, clusters).  Clusters change in place; a swapped row
    leaves ``todo``.  Groups of rows hold the least of d[j, a] - d[j, b] over their rows j of each cluster b: a row of
    cluster a with no larger d[i, a] - d[i, b] has no partner among them.  Only the other groups are read.
    """
    dj, cj = later or (d, cid)
    n, k = dj.shape
    if not n or not todo.any():
        return 0
    size = max(GROUP, -(-n * k * k // CELLS))
    starts = np.arange(0, n, size)
    own = dj[np.arange(n), cj]
    low = np.empty((k, k, len(starts)))
    for b in range(k):
        low[:, b] = np.fmin.reduceat(np.where((cj == b)[:, None], dj - own[:, None], np.inf), starts, axis=0).T
    # a difference of two distances may be off by their rounding: groups are read if in doubt, and rows compared exactly
    slack = 8 * np.finfo(float).eps * max(float(np.abs(x[np.isfinite(x)]).max(initial=0)) for x in (d, dj))

    def within(i, a, lo, hi):
        hit = d[i, cj[lo:hi]] + dj[lo:hi, a] < d[i, a] + own[lo:hi]
        at = int(hit.argmax()) if hi > lo else 0
        return lo + at if hi > lo and hit[at] else -1

    def partner(i, a, key):
        g, step = 0, 16
        if later is None:
            g = i // size + 1
            j = within(i, a, i + 1, min(n, g * size))
            if j >= 0:
                return j
        while g < len(starts):
            for x in (g + np.flatnonzero((low[a, :, g : g + step] < key[:, None]).any(0))).tolist():
                j = within(i, a, x * size, min(n, (x + 1) * size))
                if j >= 0:
                    return j
            g, step = g + step, step * 4
        return -1

    count = 0
    for lo in range(0, len(d), size):
        rows = lo + np.flatnonzero(todo[lo : lo + size])
        if not len(rows):
            continue
        least = np.fmin.reduce(low[:, :, lo // size if later is None else 0 :], axis=2)
        key = d[rows, cid[rows]][:, None] - d[rows] + slack
        key[np.arange(len(rows)), cid[rows]] = -np.inf
        maybe = (least[cid[rows]] < key).any(1)
        p = 0
        while p < len(rows):
            p += int(maybe[p:].argmax())
            if not maybe[p]:
                break
            i = int(rows[p])
            a = int(cid[i])
            j = partner(i, a, key[p])
            p += 1
            if j < 0:
                continue
            b = int(cj[j])
            cid[i], cj[j], own[j], todo[i] = b, a, dj[j, a], False
            count += 1
            g = j // size
            there = g * size + np.flatnonzero(cj[g * size : (g + 1) * size] == b)
            low[:, b, g] = np.fmin.reduce(dj[there] - own[there, None], axis=0, initial=np.inf)
            low[:, a, g] = np.fmin(low[:, a, g], dj[j] - own[j])
            # the row that moved may suit rows of this round that nothing suited
            if later is None:
                at = int(np.searchsorted(rows, j))
                if at < len(rows) and rows[at] == j:
                    key[at], maybe[at] = d[j, a] - d[j] + slack, True
                    key[at, a] = -np.inf
            maybe[p:] |= key[p:, a] > dj[j, cid[rows[p:]]] - own[j]
    return count


def assigned(x: np.ndarray, c: np.ndarray, rounds: int, cid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Same-size clusters of the rows of ``x``, each row's squared distance, and the mean one ahead of the swaps."""
    c = c.copy()
    dist = lambda: np.stack([((x - row) ** 2).sum(1) for row in c], 1)
    d = dist()
    cid = greedy(d) if cid is None else cid.astype(np.int64)
    before = float(d[np.arange(len(x)), cid].mean()) if len(x) else 0.0
    for _ in range(rounds):
        if not swaps(d, cid):
            break
        for j in range(len(c)):
            if (cid == j).any():
                c[j] = x[cid == j].mean(0)
        d = dist()
    return cid, d[np.arange(len(x)), cid], before


def _squares(batch, c):
    x = matrix(batch)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def by_rounds(df: DataFrame, c: np.ndarray) -> DataFrame:
    """What ``same_size`` returns without swaps, at any size.

    Rows are numbered by (distance to their nearest centroid, farthest first; id).  While no cluster becomes full, each goes
    to the nearest of those with room; the counts of blocks of rows tell in which block the next becomes full, and that
    block's rows at which row.  So each of at most K rounds counts blocks and reads one; a last pass assigns all rows.
    """
    k = len(c)

    def nearest(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_squares(batch, c).min(1))], ["id", "v", "d2"])

    ranked = positions(df.select("id", "v").mapInArrow(nearest, "id long, v array<double>, d2 double"), F.desc("d2"), "id").select("id", "v", "pos")
    n = ranked.count()
    room, start, spans = np.full(k, -(-n // k)), 0, []
    while start < n:
        free = room > 0

        def wishes(batches, free=free):
            for batch in batches:
                if len(batch):
                    want = np.where(free, _squares(batch, c), np.inf).argmin(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(want)], ["pos", "cid"])

        wished = ranked.where(F.col("pos") >= start).mapInArrow(wishes, "pos long, cid int")
        full = n
        blocks = wished.groupBy(F.floor(F.col("pos") / BLOCK).alias("b"), "cid").agg(F.count("*").alias("n")).orderBy("b").collect()
        taken = np.zeros(k, np.int64)
        for b in sorted({r["b"] for r in blocks}):
            here = np.zeros(k, np.int64)
            for r in blocks:
                if r["b"] == b:
                    here[r["cid"]] = r["n"]
            if ((taken + here >= room) & free).any():
                rows = wished.where((F.col("pos") >= b * BLOCK) & (F.col("pos") < (b + 1) * BLOCK)).orderBy("pos").collect()
                for r in rows:
                    taken[r["cid"]] += 1
                    if taken[r["cid"]] == room[r["cid"]]:
                        full = r["pos"] + 1
                        break
                break
            taken += here
        spans.append((full, free))
        room, start = room - taken, full

    ends = np.array([e for e, _ in spans])
    open_ = np.array([f for _, f in spans]).reshape(-1, k)

    def last(batches):
        for batch in batches:
            if len(batch):
                d = _squares(batch, c)
                cid = np.where(open_[np.searchsorted(ends, batch.column(2).to_numpy(), "right")], d, np.inf).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cid.astype(np.int32)), pa.array(d[np.arange(len(d)), cid])], ["id", "cid", "d2"])

    out = ranked.mapInArrow(last, "id long, cid int, d2 double")
    return out.join(F.broadcast(out.agg(F.avg("d2").alias("before"))))  # one row


def by_swaps(df: DataFrame, c: np.ndarray, rounds: int, given: str | None = None) -> DataFrame:
    """What ``same_size`` returns with swaps, at any size.

    Rows lie packed in the order of id, with their clusters beside them, and blocks of ``TILE`` rows meet pairwise: what the
    rows of block I make of those of block J depends only on what I made of the blocks before J, and on what those before I
    made of J.  So all tiles with the same I + J run at once, each in a task that holds two blocks' distances, and a round
    of swaps takes 2 * blocks - 1 such steps, and one pass for the new means.
    """
    c = c.copy()
    k, dim = c.shape
    placed = df if "pos" in df.columns else positions(df)
    if given is None:
        start = by_rounds(placed.select(F.col("pos").alias("id"), "v"), c).select(F.col("id").alias("pos"), "cid")
        placed = placed.select("id", "v", "pos").join(start, "pos")
    else:
        placed = placed.select("id", "v", "pos", F.col(given).cast("int").alias("cid"))
    tile = max(1, min(TILE, (8 * TILE) // k))
    size = max(1, min(tile, PACKED // dim))
    per = tile // size

    def pack(key, t):
        t = t.sort_by("pos")
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"chunk": [key[0].as_py()], "ids": [t["id"].to_numpy().tobytes()], "x": [x.tobytes()], "cid": [t["cid"].to_numpy().astype(np.int32).tobytes()]})

    chunk = F.floor(F.col("pos") / size).alias("chunk")
    packed = stored(placed.select(chunk, "pos", "id", "v", "cid").groupBy("chunk").applyInArrow(pack, "chunk long, ids binary, x binary, cid binary"), "same-rows")
    last = packed.agg(F.max("chunk")).first()[0]
    if last is None:
        return df.select("id", F.lit(0).alias("cid"), F.lit(0.0).alias("d2"), F.lit(0.0).alias("before"))
    n, blocks = last * size, last // per + 1
    state = packed.select("chunk", "cid", F.lit(b"").alias("todo"), F.lit(0).cast("long").alias("swaps"))
    of = lambda col, kind: np.frombuffer(col.as_py(), kind)

    def beside(state):
        """Vectors with their clusters; these are 5 bytes a row."""
        return packed.select("chunk", "ids", "x").join(F.broadcast(state) if n <= 4_000_000 else state, "chunk")

    def squares(x, c):
        x = of(x, np.float64).reshape(-1, dim)
        return x, np.stack([((x - row) ** 2).sum(1) for row in c], 1)

    def means(state, c):
        """The clusters' sums, squared errors and, as penalties, swaps."""

        def run(batches):
            for batch in batches:
                for x, cid, swaps in zip(batch["x"], batch["cid"], batch["swaps"], strict=True):
                    x, d = squares(x, c)
                    cid = of(cid, np.int32)
                    s, m = np.zeros((k, dim)), np.bincount(cid, minlength=k)
                    np.add.at(s, cid, x)
                    made = np.zeros(k)
                    made[cid[0]] = swaps.as_py()
                    yield sums_batch(s, m, np.bincount(cid, d[np.arange(len(d)), cid], k), made)

        return reduced(beside(state).select("x", "cid", "swaps").mapInArrow(run, PARTIAL))

    def wave(state, c, t):
        """The tiles of blocks I <= J with I + J = t; the other blocks stay."""
        block = F.floor(F.col("chunk") / per)
        now = block.between(max(0, t - blocks + 1), min(t, blocks - 1))

        def distances(batches):
            for batch in batches:
                for at, x, cid, todo, swaps in zip(*(batch[f] for f in ("chunk", "x", "cid", "todo", "swaps")), strict=True):
                    _, d = squares(x, c)
                    b = at.as_py() // per
                    if t == b:  # the round begins for these rows
                        todo, swaps = (d.min(1) < d[np.arange(len(d)), of(cid, np.int32)]).tobytes(), 0
                    yield pa.RecordBatch.from_pydict({"tile": [min(b, t - b)], "d": [d.tobytes()], "chunk": [at], "cid": [cid], "todo": [todo], "swaps": pa.array([swaps], pa.int64())})

        def swapped(key, table):
            table = table.sort_by("chunk")
            joined = lambda rows, col, kind: np.concatenate([of(v, kind) for v in rows[col]])
            side = np.array(table["chunk"].to_pylist()) // per
            sides = []
            for b in np.unique(side).tolist():
                rows = table.filter(pa.array(side == b))
                sides.append((joined(rows, "d", np.float64).reshape(-1, k), joined(rows, "cid", np.int32), joined(rows, "todo", bool)))
            made = swap_rows(*sides[0], later=sides[1][:2] if len(sides) > 1 else None)
            cid, todo = (np.concatenate([s[f] for s in sides]) for f in (1, 2))
            ends = np.cumsum([len(x.as_py()) // 4 for x in table["cid"]])[:-1]
            swaps = table["swaps"].to_pylist()
            swaps[0] += made
            return pa.table({"chunk": table["chunk"], "cid": [x.tobytes() for x in np.split(cid, ends)], "todo": [x.tobytes() for x in np.split(todo, ends)], "swaps": swaps})

        schema = "chunk long, cid binary, todo binary, swaps long"
        tiles = beside(state.where(now)).drop("ids").mapInArrow(distances, f"tile long, d binary, {schema}")
        new = stored(tiles.groupBy("tile").applyInArrow(swapped, schema).unionByName(state.where(~now)), "same-state")
        discard(state)
        return new

    rows = means(state, c)
    before = sum(r["sse"] for r in rows) / sum(r["n"] for r in rows)
    for _ in range(rounds):
        for t in range(2 * blocks - 1):
            state = wave(state, c, t)
        rows = means(state, c)
        if not sum(r["pen"] for r in rows):
            break
        for r in rows:
            c[r["cid"]] = np.array(r["s"]) / r["n"]

    def unpacked(batches):
        for batch in batches:
            for ids, x, cid in zip(batch["ids"], batch["x"], batch["cid"], strict=True):
                _, d = squares(x, c)
                cid = of(cid, np.int32)
                yield pa.RecordBatch.from_pydict({"id": of(ids, np.int64), "cid": cid, "d2": d[np.arange(len(d)), cid], "before": np.full(len(d), before)})

    return beside(state).select("ids", "x", "cid").mapInArrow(unpacked, "id long, cid int, d2 double, before double")


def balanced(df: DataFrame, c: np.ndarray, rounds: int, given: str | None = None) -> DataFrame:
    """``same_size`` with swaps at any size: in one task up to ``MAX_ROWS`` rows, by tiles beyond."""
    large = df.limit(MAX_ROWS + 1).count() > MAX_ROWS
    return (by_swaps if large else same_size)(df, c, rounds, given)


def same_size(df: DataFrame, c: np.ndarray, rounds: int = 0, given: str | None = None) -> DataFrame:
    """(id, cid, d2, before): same-size assignment of ``df`` (id, v); with rounds, swaps and new means until none helps.

    before is the mean squared distance ahead of the swaps, d2 each row's at the end.  ``given``: a column of ``df`` with
    each row's cluster, from which the swaps start instead of the greedy assignment; they keep its sizes.
    """
    if df.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        if given is None and not rounds:
            return by_rounds(df, c)
        raise ValueError(f"same-size clustering takes at most {MAX_ROWS} rows")

    def run(table):
        table = table.sort_by("id")
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        cid, d2, before = assigned(x, c, rounds, None if given is None else table["given"].to_numpy())
        return pa.table({"id": table["id"], "cid": pa.array(cid.astype(np.int32)), "d2": pa.array(d2), "before": pa.array(np.full(len(x), before))})

    start = F.lit(0) if given is None else F.col(given)
    return df.select("id", "v", start.cast("int").alias("given"), F.lit(0).alias("_g")).groupBy("_g").applyInArrow(lambda t: run(t.drop_columns(["_g"])), "id long, cid int, d2 double, before double")
