"""K-means accelerated by the triangle inequality.

Every algorithm gives the same assignment as the naive one and counts the distances it computes.  The vectors stay where
they are, dealt by position; each row's cluster and bounds are a table of their own, written once an iteration together
with the clusters' sums, and joined to the vectors by position in the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meanfield.functions.storage import discard, stored
from meanfield.functions.vectors import matrix

from . import assign, samesize

BOUNDS = "cid int, ub double, lb array<double>, near array<int>"
STATE = f"pos long, {BOUNDS}, dists long, active int, s array<double>, n long, sse double"


def _dist(x, c):
    return np.sqrt(((x - c) ** 2).sum(-1))


def _all(x, c):
    return np.stack([_dist(x, row) for row in c], 1)


def _needed(x, c, need):
    """Distances where ``need`` is set, infinity elsewhere; no other is computed."""
    out = np.full(need.shape, np.inf)
    for j in range(len(c)):
        rows = np.flatnonzero(need[:, j])
        if len(rows):
            out[rows, j] = _dist(x[rows], c[j])
    return out


class Rows:
    """Bounds of a batch of rows ``x``: cid, ub, lb, near (lb and near are None at first), and the distances computed."""

    def __init__(self, x, c, cid, ub, lb, near, ctx):
        self.x, self.c, self.cid, self.ub, self.lb, self.near, self.ctx = x, c, cid, ub, lb, near, ctx
        self.count = np.zeros(len(x), np.int64)
        self.active = 0

    def tighten(self, rows):
        """Makes the upper bounds of ``rows`` exact."""
        self.ub[rows] = _dist(self.x[rows], self.c[self.cid[rows]])
        self.count[rows] += 1


def _half_to_next(ctx):
    """Half the distance of each centroid to its nearest other one."""
    cc = ctx["cc"]
    return np.where(np.eye(len(cc), dtype=bool), np.inf, cc / 2).min(1)


def elkan(r: Rows) -> None:
    """One lower bound for each centroid."""
    c, ctx = r.c, r.ctx
    r.lb = np.zeros((len(r.x), len(c))) if r.lb is None else np.maximum(r.lb - ctx["drift"][None, :], 0)
    half = ctx["cc"] / 2
    rows = np.flatnonzero(r.ub > _half_to_next(ctx)[r.cid])
    if not len(rows):
        return
    r.tighten(rows)
    a, at = r.cid[rows], np.arange(len(rows))
    own = r.ub[rows]
    r.lb[rows, a] = own
    need = (own[:, None] > r.lb[rows]) & (own[:, None] > half[a])
    need[at, a] = False
    d = _needed(r.x[rows], c, need)
    r.count[rows] += need.sum(1)
    r.lb[rows] = np.where(need, d, r.lb[rows])
    d[at, a] = own
    r.cid[rows], r.ub[rows] = d.argmin(1), d.min(1)


def _band(norms, order, centre, radius):
    """Which centroids have a norm within ``radius`` of ``centre``: a run of the norms in order, found by binary search."""
    slack = radius * 1e-12 + 1e-12
    lo = np.searchsorted(norms[order], centre - radius - slack, "left")
    hi = np.searchsorted(norms[order], centre + radius + slack, "right")
    place = np.arange(len(order))
    out = np.zeros((len(centre), len(order)), bool)
    out[:, order] = (place >= lo[:, None]) & (place < hi[:, None])
    return out


def hamerly(r: Rows, annulus: bool = False) -> None:
    """One lower bound, on the second nearest centroid."""
    c, ctx, drift = r.c, r.ctx, r.ctx["drift"]
    if r.lb is None:
        r.lb = np.zeros((len(r.x), 1))
    else:
        top = int(drift.argmax())
        second = np.delete(drift, top).max() if len(c) > 1 else 0.0
        r.lb = r.lb - np.where(r.cid == top, second, drift[top])[:, None]
    s = _half_to_next(ctx)
    rows = np.flatnonzero(r.ub > np.maximum(s[r.cid], r.lb[:, 0]))
    r.tighten(rows[np.isfinite(r.ub[rows])])
    rows = rows[r.ub[rows] > np.maximum(s[r.cid[rows]], r.lb[rows, 0])]
    if not len(rows):
        return
    at = np.arange(len(rows))
    need = np.ones((len(rows), len(c)), bool)
    if annulus and r.near is not None:
        radius = np.maximum(r.ub[rows], _dist(r.x[rows], c[r.near[rows, 0]]))
        need = _band(ctx["norms"], ctx["order"], np.sqrt((r.x[rows] ** 2).sum(1)), radius)
        need[at, r.cid[rows]] = need[at, r.near[rows, 0]] = True
        r.count[rows] += 1
    d = _needed(r.x[rows], c, need)
    r.count[rows] += need.sum(1)
    order = np.argsort(d, axis=1, kind="stable")
    first, second = order[:, 0], order[:, min(1, len(c) - 1)]
    r.cid[rows], r.ub[rows] = first, d[at, first]
    r.lb[rows, 0] = d[at, second] if len(c) > 1 else np.inf
    if annulus:
        r.near = np.zeros((len(r.x), 1), np.int64) if r.near is None else r.near
        r.near[rows, 0] = second


def annulus(r: Rows) -> None:
    """As Hamerly's, but only centroids in a band of norms are compared."""
    hamerly(r, annulus=True)


def drake(r: Rows) -> None:
    """Sorted bounds on the next b centroids and one bound on all others; active is the widest bound that was needed."""
    c, ctx, k = r.c, r.ctx, len(r.c)
    b = max(1, min(ctx["n_bounds"], k - 1))
    if k == 1:
        r.tighten(np.arange(len(r.x)))
        r.lb, r.near = np.zeros((len(r.x), 1)), np.zeros((len(r.x), 1), np.int64)
        return
    if r.lb is None:
        rows = np.arange(len(r.x))
        r.lb, r.near = np.zeros((len(r.x), b)), np.zeros((len(r.x), b), np.int64)
    else:
        drift, lb = ctx["drift"], r.lb
        if lb.shape[1] > b:  # fewer bounds than before: the last one kept holds for all that follow
            lb, r.near = lb[:, :b].copy(), r.near[:, :b].copy()
        lb[:, :-1] -= drift[r.near[:, :-1]]
        lb[:, -1] -= drift.max()
        r.lb = lb = np.minimum.accumulate(lb[:, ::-1], axis=1)[:, ::-1].copy()
        open_ = np.flatnonzero(r.ub > lb[:, 0])
        r.tighten(open_)
        # the first bound that the upper bound doesn't pass; the last bound stands for all other centroids
        z = (r.ub[open_, None] > lb[open_]).sum(1)
        r.active = int(min(b, z.max(initial=0) + 1))
        rows = open_[z == b]
        for m in range(1, b):
            part = open_[z == m]
            if len(part):
                ids = np.concatenate([r.cid[part, None], r.near[part, :m]], 1)
                d = np.concatenate([r.ub[part, None], np.sqrt(((r.x[part, None, :] - c[ids[:, 1:]]) ** 2).sum(-1))], 1)
                r.count[part] += m
                order = np.lexsort((ids, d), axis=1)
                ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
                r.cid[part], r.ub[part] = ids[:, 0], d[:, 0]
                r.near[part, :m], lb[part, :m] = ids[:, 1:], np.minimum(d[:, 1:], lb[part, m : m + 1])
    if len(rows):
        d = _all(r.x[rows], c)
        r.count[rows] += k
        order = np.argsort(d, axis=1, kind="stable")[:, : b + 1]
        d = np.take_along_axis(d, order, 1)
        r.cid[rows], r.ub[rows], r.near[rows], r.lb[rows] = order[:, 0], d[:, 0], order[:, 1:], d[:, 1:]


def yinyang(r: Rows) -> None:
    """One lower bound for each group of centroids, with a global, a group and (if ctx says so) a local filter."""
    c, ctx = r.c, r.ctx
    group, t = ctx["group"], int(ctx["group"].max()) + 1
    first = r.lb is None
    if first:
        before = r.lb = np.zeros((len(r.x), t))
        rows = np.arange(len(r.x))
    else:
        before = r.lb
        r.lb = before - np.array([ctx["drift"][group == g].max() for g in range(t)])[None, :]
        rows = np.flatnonzero(r.ub > r.lb.min(1))
        r.tighten(rows)
        rows = rows[r.ub[rows] > r.lb[rows].min(1)]
    if not len(rows):
        return
    at, old, own = np.arange(len(rows)), r.cid[rows].copy(), r.ub[rows].copy()
    scan = np.ones((len(rows), t), bool) if first else r.lb[rows] < own[:, None]
    need = scan[:, group]
    # what a centroid is at least away: its group's former bound less its own drift
    least = np.zeros(need.shape) if first else before[rows][:, group] - ctx["drift"][None, :]
    if not first:
        if ctx["local_filter"]:
            need &= least < own[:, None]
        need[at, old] = False
    d = _needed(r.x[rows], c, need)
    r.count[rows] += need.sum(1)
    rest = np.where(need, d, np.where(scan[:, group], least, np.inf))
    if not first:
        d[at, old] = rest[at, old] = own
    best = d.argmin(1)
    r.cid[rows], r.ub[rows] = best, d[at, best]
    rest[at, best] = np.inf
    for g in range(t):
        new = rest[:, group == g].min(1)
        left = (group[old] == g) & (best != old)  # the former centroid bounds its own group too
        r.lb[rows, g] = np.where(scan[:, g], new, np.where(left, np.minimum(r.lb[rows, g], own), r.lb[rows, g]))


KERNELS = {"elkan": elkan, "hamerly": hamerly, "annulus": annulus, "drake": drake, "yinyang": yinyang}


def group_centroids(c: np.ndarray, groups: int | None, rounds: int = 5, by: str = "kmeans") -> np.ndarray:
    """Groups for Yinyang: the centroids themselves clustered into k / 10 (or ``groups``) groups; none is empty.

    by: "kmeans" from the first centroids, "samesize" with groups of equal sizes, at most twice as many rounds of swaps.
    """
    t = max(1, min(groups or len(c) // 10 or 1, len(c)))
    seeds = c[:t].copy()
    for _ in range(rounds):
        g = _all(c, seeds).argmin(1)
        for j in range(t):
            if (g == j).any():
                seeds[j] = c[g == j].mean(0)
    if by == "samesize":
        return np.unique(samesize.assigned(c, seeds, 2 * rounds)[0], return_inverse=True)[1]
    g = _all(c, seeds).argmin(1)
    return np.unique(g, return_inverse=True)[1]


def contiguous(c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The centroids in the order of their groups, the groups' numbers in that order, and the permutation (new[p[i]] = old[i])."""
    order = np.argsort(group, kind="stable")
    perm = np.empty(len(c), np.int64)
    perm[order] = np.arange(len(c))
    return c[order], group[order], perm.tolist()


def block_groups(k: int, t: int) -> np.ndarray:
    """k centroids in t runs, the larger first."""
    return np.repeat(np.arange(t), [k // t + (i < k % t) for i in range(t)])


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _kernel_rows(kernel, c, ctx):
    """A task: bounds of its rows, then a row for each cluster with its sums."""

    def run(batches):
        k = len(c)
        s, m, e, active = np.zeros_like(c), np.zeros(k, np.int64), np.zeros(k), 0
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch)
            fresh = "ub" not in batch.schema.names
            cid = np.zeros(len(x), np.int64) if fresh else _column(batch, "cid").to_numpy().astype(np.int64)
            ub = np.full(len(x), np.inf) if fresh else _column(batch, "ub").to_numpy() + ctx["drift"][cid]
            lb = None if fresh else matrix(batch, "lb").copy()
            near = None if fresh or not len(_column(batch, "near").flatten()) else matrix(batch, "near").astype(np.int64)
            r = Rows(x, c, cid, ub, lb, near, ctx)
            kernel(r)
            np.add.at(s, r.cid, x)
            m += np.bincount(r.cid, minlength=k)
            e += np.bincount(r.cid, ((x - c[r.cid]) ** 2).sum(1), k)
            none = np.zeros((len(x), 0), np.int64) if r.near is None else r.near
            yield _batch(len(x), pos=_column(batch, "pos"), cid=r.cid.astype(np.int32), ub=r.ub, lb=list(r.lb), near=list(none.astype(np.int32)), dists=r.count, active=np.full(len(x), r.active, np.int32))
            active = max(active, r.active)
        at = np.flatnonzero(m)
        yield _batch(len(at), cid=at.astype(np.int32), s=list(s[at]), n=m[at], sse=e[at], active=np.full(len(at), active, np.int32))

    return run


def _batch(size: int, **cols) -> pa.RecordBatch:
    kinds = {"pos": pa.int64(), "cid": pa.int32(), "ub": pa.float64(), "lb": pa.list_(pa.float64()), "near": pa.list_(pa.int32()), "dists": pa.int64(), "active": pa.int32(), "s": pa.list_(pa.float64()), "n": pa.int64(), "sse": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c not in cols else cols[c] if isinstance(cols[c], pa.Array) else pa.array(cols[c], t) for c, t in kinds.items()], list(kinds))


def step(df: DataFrame, n: int, algorithm: str, repair, *, groups: int | np.ndarray | None = None, group_by: str = "kmeans", reorder: bool = False, n_bounds: int = 2, adaptive: bool = False, local_filter: bool = True, verify: bool = False):
    """An iteration as ``kmeans.run`` wants it, over (pos, v).

    groups: for Yinyang their number, or each centroid's group; group_by: how centroids are grouped; reorder: whether they
    are put in the order of their groups, which changes the clusters' numbers.  n_bounds, adaptive: Drake's bounds; adaptive
    begins with a quarter of the centroids and goes on with the most that an iteration needed, an eighth less one at least.
    verify: compares every bound with the distances and raises AssertionError where one doesn't hold.
    """
    from .kmeans import updated

    if algorithm not in KERNELS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    kernel = KERNELS[algorithm]
    state: dict = {"rows": None, "c": None, "group": None, "active": 0}
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # both sides of the join below are dealt by position into as many parts: the vectors once, the bounds each time
    data = df.select("pos", "v").repartition(tasks, "pos").persist()

    def one(c, i):
        k = len(c)
        if state["group"] is None and algorithm == "yinyang":
            given = isinstance(groups, (list, tuple, np.ndarray))
            state["group"] = np.asarray(groups) if given else group_centroids(c, groups, by=group_by)
            if reorder:
                c, state["group"], _ = contiguous(c, state["group"])
        drift = np.zeros(k) if state["c"] is None else _dist(c, state["c"])
        bounds = n_bounds if not adaptive else -(-k // 4) if i <= 2 else max(-(-k // 8) - 1, state["active"], 1)
        norms = np.sqrt((c**2).sum(1))
        ctx = {"drift": drift, "cc": _all(c, c), "group": state["group"], "n_bounds": bounds, "norms": norms, "order": np.argsort(norms, kind="stable"), "local_filter": local_filter}
        source = data if state["rows"] is None else data.join(state["rows"].hint("shuffle_hash"), "pos")
        rows = stored(source.mapInArrow(_kernel_rows(kernel, c, ctx), STATE), algorithm)
        sums = rows.where("pos is null").select("cid", "s", "n", "sse", F.col("sse").alias("pen"))
        parts = assign.reduced(sums)
        dists, active = rows.where("pos is not null").agg(F.sum("dists"), F.max("active")).first()
        new, counts, sse, _ = updated(c, parts, repair, i)
        discard(state.get("table"))
        state.update({"table": rows, "rows": rows.where("pos is not null").select("pos", "cid", "ub", "lb", "near"), "c": c, "active": active})
        if verify:
            wrong = broken_bounds(data, state["rows"], c, algorithm, state["group"])
            assert not wrong, f"iteration {i}: {wrong} rows with a wrong cluster or bound"
        return new, {"fit": sse / n, "pure": sse / n, "counts": counts.tolist(), "dist_count": dists, "max_active": active}

    one.close = lambda: (discard(state.get("table")), data.unpersist())
    return one


def broken_bounds(data: DataFrame, rows: DataFrame, c: np.ndarray, algorithm: str, group: np.ndarray | None) -> int:
    """Rows of (pos, v) and (pos, BOUNDS) with another cluster than the nearest, an upper bound too low or a lower bound too high."""

    def run(batches):
        wrong = 0
        for batch in batches:
            if not len(batch):
                continue
            d, cid, ub, lb = _all(matrix(batch), c), _column(batch, "cid").to_numpy(), _column(batch, "ub").to_numpy(), matrix(batch, "lb")
            at, slack = np.arange(len(d)), 1e-9 * (1 + d.max(initial=0))
            other = d.copy()
            other[at, cid] = np.inf
            if algorithm == "elkan":
                low = (lb > d + slack).any(1)
            elif algorithm == "yinyang":
                low = np.any([lb[:, g] > other[:, group == g].min(1) + slack for g in range(int(group.max()) + 1)], axis=0)
            elif algorithm == "drake":
                near = np.sort(other, axis=1)[:, : lb.shape[1]]
                low = (lb[:, : near.shape[1]] > near + slack).any(1) if len(c) > 1 else np.zeros(len(d), bool)
            else:
                low = lb[:, 0] > other.min(1) + slack
            wrong += int((low | (ub < d[at, cid] - slack) | (d[at, cid] > d.min(1) + slack)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([wrong], pa.int64())], ["wrong"])

    return data.join(rows, "pos").mapInArrow(run, "wrong long").agg(F.sum("wrong")).first()[0] or 0
