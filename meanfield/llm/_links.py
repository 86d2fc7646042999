"""Finds the components of a similarity graph from banded keys, sketches and exact checks, without all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, maybe_broadcast, parts, spans, stored, tidy
from ._graph import components
from ._text import mix64

FAR = 1 << 40
EDGE = "a long, b long"
#: Ids whose band keys one task deals with.
PART_IDS = 200_000
#: Share of all ids from which a key's entries are spread over tasks before they are grouped.
HOT_SHARE = 1e-4
#: Bytes of stored sets that are expanded at once.
RUN = 1 << 20
#: Tasks that write a small table, and rows that one of more tasks writes.
TASKS, PART_ROWS = 8, 50_000


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows, from sorted batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not len(table):
            continue
        cols = [table[k].to_numpy() for k in keys]
        last = np.ones(len(table), bool)
        for c in cols:
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None and len(rest):
        yield rest


def _deal(count: int, hot: np.ndarray):
    """Rows (p, x): the (key, id) entries of each part p as bytes, so that single keys are never rows.

    Entries of the keys in ``hot`` (rising) are spread over all parts by id, those of another key meet in one part.
    """

    def run(batches):
        for batch in batches:
            ids, bands = batch.column(0).to_numpy(), batch.column(1)
            keys = bands.flatten().to_numpy()
            if not len(keys):
                continue
            entry = np.stack([keys, np.repeat(ids, np.diff(bands.offsets.to_numpy()))], 1)
            place = np.where(_is_in(keys, hot), mix64(entry[:, 1].view(np.uint64) ^ keys.view(np.uint64)), keys.view(np.uint64))
            part = (place >> np.uint64(20)) % np.uint64(count)
            order = np.argsort(part, kind="stable")
            entry, ends = entry[order], np.cumsum(np.bincount(part.astype(np.int64), minlength=count))
            full = np.flatnonzero(np.diff(np.concatenate([[0], ends])))
            starts = np.concatenate([[0], ends])
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([entry[starts[p] : ends[p]].tobytes() for p in full.tolist()], pa.binary())], ["p", "x"])

    return run


def _is_in(values: np.ndarray, rising: np.ndarray) -> np.ndarray:
    if not len(rising):
        return np.zeros(len(values), bool)
    return rising[np.minimum(np.searchsorted(rising, values), len(rising) - 1)] == values


def _shared(hot: np.ndarray):
    """Rows (key, id, m, first) of keys with several ids in a part: m of them, the smallest is ``first``; all rows of hot keys."""

    def out(chunks):
        e = np.frombuffer(b"".join(chunks), np.int64).reshape(-1, 2)
        # most keys have one entry: these go before the entries are sorted by id, too
        order = np.argsort(e[:, 0])
        key = e[order, 0]
        several, same = _is_in(key, hot), key[1:] == key[:-1]
        several[1:] |= same
        several[:-1] |= same
        e = e[order[several]]
        e = e[np.lexsort((e[:, 1], e[:, 0]))]
        new = np.ones(len(e), bool)
        new[1:] = (e[1:] != e[:-1]).any(axis=1)
        e = e[new]
        start = np.flatnonzero(np.concatenate([[True], e[1:, 0] != e[:-1, 0]])[: len(e)])
        m = np.diff(np.concatenate([start, [len(e)]]))
        keep = np.repeat((m > 1) | _is_in(e[start, 0], hot), m)
        return pa.RecordBatch.from_arrays([pa.array(e[keep, 0]), pa.array(e[keep, 1]), pa.array(np.repeat(m, m)[keep])], ["key", "id", "m"])

    def run(batches):
        now, chunks = None, []
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != now and chunks:
                    yield out(chunks)
                    chunks = []
                now = p
                chunks.append(x.as_buffer())
        if chunks:
            yield out(chunks)

    return run


def _hot_keys(sigs: DataFrame, rows: int) -> np.ndarray:
    """Keys that a share of about ``HOT_SHARE`` of all ids have, found in one of 64 ids by hash: 1 / HOT_SHARE a band at most.

    A key that is missed, or found in vain, is dealt with in another way and to the same result.
    """
    some = sigs.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(64)) == 0).select("id", "bands").dropDuplicates(["id"])
    least = max(64, int(rows / 64 * HOT_SHARE))
    found = some.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["key"] for r in found.collect()], np.int64))


def _arrays(table: pa.Table):
    ids = table["id"].to_numpy()
    raw = b"".join(table["sketch"].to_pylist())
    sketch = np.frombuffer(raw, np.uint64).reshape(len(ids), -1)
    cut = _cuts(table)
    return ids, sketch, np.array([0, *cut]), np.array([*cut, len(ids)])


def _cuts(table: pa.Table) -> list[int]:
    """Where a new (key, sub) begins, but for the first."""
    key, sub = table["key"].to_numpy(), table["sub"].to_numpy()
    return (np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1).tolist()


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of every sketch of x and of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


def _forest(d: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest; entries of FAR or more are no edges."""
    m, edges = len(d), []
    if m <= 16:
        d, left, near, to = d.tolist(), list(range(m)), [FAR] * m, [0] * m
        for _ in range(m):
            j = min(left, key=near.__getitem__)
            if near[j] < FAR:
                edges.append((to[j], j))
            left.remove(j)
            for k, x in enumerate(d[j]):
                if x < near[k]:
                    near[k], to[k] = x, j
        return edges
    free = np.ones(m, bool)
    best, via = np.full(m, FAR), np.zeros(m, np.int64)
    for _ in range(m):
        j = int(np.argmin(np.where(free, best, FAR + 1)))
        if best[j] < FAR:
            edges.append((int(via[j]), j))
        free[j] = False
        better = d[j] < best
        best[better] = d[j][better]
        via[better] = j
    return edges


def _first_edges(limit: int):
    """The spanning forest of likely links of every block."""

    def run(batches):
        for table in _grouped(batches, ("key", "sub")):
            ids, sketch, lo, hi = _arrays(table)
            a, b = [], []
            two = lo[hi - lo == 2]
            if len(two):
                near = np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1) <= limit
                a.append(ids[two[near]])
                b.append(ids[two[near] + 1])
            for s, e in zip(lo[hi - lo > 2].tolist(), hi[hi - lo > 2].tolist(), strict=True):
                d = _apart(sketch[s:e], sketch[s:e])
                d[d > limit] = FAR
                edges = _forest(d)
                if edges:
                    pair = np.array(edges) + s
                    a.append(ids[pair[:, 0]])
                    b.append(ids[pair[:, 1]])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return run


def _partners(limit: int):
    """Rows (key, sub, id, c) of those ids that a likely link joins to another component in their pair of blocks.

    A pair of ids that share several keys counts in the first of their bands only.
    """

    def run(batches):
        for table in _grouped(batches, ("key", "sub")):
            ids, sketch, lo, hi = _arrays(table)
            comp, key = table["c"].to_numpy(), table["key"].to_numpy()
            bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            some = np.zeros(len(ids), bool)
            for s, e in zip(lo.tolist(), hi.tolist(), strict=True):
                i, j = np.nonzero(np.triu(_apart(sketch[s:e], sketch[s:e]) <= limit, 1) & (comp[s:e, None] != comp[None, s:e]))
                for k in range(0, len(i), 1 << 16):
                    x, y = i[k : k + (1 << 16)] + s, j[k : k + (1 << 16)] + s
                    same = bands[x] == bands[y]
                    own = bands[x, same.argmax(axis=1)] == key[s]
                    some[x[own]] = some[y[own]] = True
            if some.any():
                yield from table.select(["key", "sub", "id", "c"]).filter(pa.array(some)).combine_chunks().to_batches()

    return run


def hash_runs(values: list[bytes]) -> list[np.ndarray]:
    """Sets stored as runs of rising 64-bit hashes."""
    return [np.frombuffer(x, np.uint64) for x in values]


def _similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether sets 0 and 1, 2 and 3, ..., as rising hashes, have 100 * intersection >= percent * union."""
    n = np.array([len(s) for s in sets], np.int64)
    n = n[::2] + n[1::2]
    at = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate(sets)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        flat[a:b].sort()
    twice = np.zeros(len(flat), bool)
    twice[1:] = flat[1:] == flat[:-1]
    twice[at[:-1][n > 0]] = False
    both = np.diff(np.concatenate([[0], np.cumsum(twice)])[at])
    return 100 * both >= percent * (n - both)


def _confirm(percent: int, expand):
    """Exact check of pairs of sets."""

    def run(batches):
        for batch in batches:
            s, t = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.zeros(len(s), bool)
            for i, j in spans(np.cumsum([0, *(len(x) + len(y) for x, y in zip(s, t, strict=True))]), RUN):
                ok[i:j] = _similar(expand([x for pair in zip(s[i:j], t[i:j], strict=True) for x in pair]), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "ok"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(where, minlength=len(values)) > 1
    rank = np.cumsum(shared) - 1
    use = shared[where]
    owner, col = owner[use], rank[where[use]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((n, n), np.float32)
    total = int(shared.sum())
    width = min(8192, total)
    for lo in range(0, total, 8192):
        i, j = np.searchsorted(col, [lo, lo + width])
        dense = np.zeros((n, width), np.float32)
        dense[owner[i:j], col[i:j] - lo] = 1
        out += dense @ dense.T
    return out


def _block_links(percent: int, expand):
    """Links that join components, of every pair of blocks: exact similarities by sparse matrix products."""

    def run(batches):
        for table in _grouped(batches, ("key", "sub")):
            ids, comp = table["id"].to_numpy(), table["c"].to_numpy()
            raw = table["s"].to_pylist()
            cut = _cuts(table)
            lo, hi = np.array([0, *cut]), np.array([*cut, len(ids)])
            root: dict[int, int] = {}

            def find(x, root=root):
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            a, b = [], []
            held = np.cumsum([0, *map(len, raw)])
            for u, v in spans(held[np.append(lo, len(ids))], RUN):
                # an id stands in several blocks, but its set is made once
                base = lo[u]
                _, first, place = np.unique(ids[base : hi[v - 1]], return_index=True, return_inverse=True)
                made = expand([raw[k] for k in (base + first).tolist()])
                two = lo[u:v][hi[u:v] - lo[u:v] == 2]
                two = two[comp[two] != comp[two + 1]]
                some, hits = [np.stack([two, two + 1])], []
                for s, e in zip(lo[u:v].tolist(), hi[u:v].tolist(), strict=True):
                    if e - s < 3:
                        continue
                    i, j = np.nonzero(comp[s:e, None] != comp[None, s:e])
                    i, j = i[i < j], j[i < j]
                    if len(i) <= 2 * (e - s):
                        some.append(np.stack([i, j]) + s)
                        continue
                    sets = [made[k] for k in place[s - base : e - base].tolist()]
                    size = np.array([len(x) for x in sets])
                    both = _common(sets).astype(np.int64)[i, j]
                    hit = 100 * both >= percent * (size[i] + size[j] - both)
                    hits.append(np.stack([i[hit], j[hit]]) + s)
                pairs = np.concatenate(some, axis=1)
                size = np.array([len(x) for x in made])[place]
                for s, e in spans(np.concatenate([[0], np.cumsum(size[pairs - base].sum(axis=0))]), RUN):
                    part = pairs[:, s:e]
                    hits.append(part[:, _similar([made[k] for k in place[part.T.ravel() - base].tolist()], percent)])
                for x, y in np.concatenate(hits, axis=1).T.tolist() if hits else []:
                    p, q = find(comp[x]), find(comp[y])
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        a.append(min(ids[x], ids[y]))
                        b.append(max(ids[x], ids[y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def link_components(sigs: DataFrame, limit: int, percent: int, fetch: Callable[[DataFrame], DataFrame], expand: Callable[[list[bytes]], list[np.ndarray]] = hash_runs, block: int = 256) -> DataFrame:
    """(id, component) of the ids in components of two or more.

    sigs: id long, bands array<long>, sketch binary; rows of one id are equal.  fetch: (id) -> (id, s), s the set in a
    form that ``expand`` turns into rising 64-bit hashes.  Candidates share a band key and differ in at most ``limit`` sketch bits; a link has
    100 * intersection >= percent * union of the full sets.

    1. Each key's candidates give a spanning forest, most similar first, whose edges are checked on full sets: a group
       of m copies costs about m checks and not m * m / 2.  A key of over ``block`` ids is dealt over blocks.
    2. Keys whose ids are in one component are done.  In every other key, blocks of ids outside its largest component meet
       each other and the blocks of that component, by pairs of blocks.  Sketches tell which ids have a likely link to
       another component there; these are compared exactly, and only links that join components leave a block.

    So no candidate pair that could join two components stays unchecked, no cap drops one, and a task holds two blocks.
    Keys that very many ids share are found in a sample and their entries spread before they are grouped.
    """
    tables: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        tables.append(stored(df, name))
        return tables[-1]

    try:
        return _linked(sigs, limit, percent, fetch, expand, block, keep)
    finally:
        for table in tables:
            discard(table)


def _linked(sigs, limit, percent, fetch, expand, block, keep) -> DataFrame:
    """What ``link_components`` returns; ``keep`` writes a table that is deleted afterwards."""
    rows = sigs.count()
    hot = _hot_keys(sigs, rows)
    count = max(int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts(rows, PART_IDS))
    # one part at a time: hashed, several would meet in a partition, whose rows may reach Python in one batch
    dealt = sigs.select("id", "bands").mapInArrow(tidy(_deal(count, hot)), "p int, x binary").repartitionById(count, "p").sortWithinPartitions("p")
    shared = dealt.mapInArrow(tidy(_shared(hot)), "key long, id long, m long").coalesce(max(TASKS, parts(rows, PART_IDS)))
    shared = keep(shared, "links-shared")
    few = lambda df, n: df.coalesce(max(TASKS, parts(n, PART_ROWS)))
    if len(hot):
        wide = shared.sparkSession.createDataFrame([(int(k),) for k in hot], "key long")
        wide = shared.join(F.broadcast(wide), "key").groupBy("key").agg(F.count("*").alias("all"))
        shared = shared.join(F.broadcast(wide), "key", "left").select("key", "id", F.coalesce("all", "m").alias("m")).where("m > 1")
    n = shared.count()
    if not n:
        return components(shared.select(F.col("key").alias("a"), F.col("id").alias("b")))
    one = sigs.select("id", "bands", "sketch").join(maybe_broadcast(shared.select("id").distinct()), "id", "left_semi").dropDuplicates(["id"])
    one = keep(few(one, n), "links-sketch")
    cand = keep(few(shared.join(one.select("id", "sketch"), "id"), n), "links-cand")
    dealt = cand.withColumn("sub", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / block)).cast("int")).select("key", "sub", "id", "sketch")
    edges = dealt.repartition("key", "sub").sortWithinPartitions("key", "sub", "id").mapInArrow(tidy(_first_edges(limit)), EDGE)
    edges = keep(few(edges.distinct(), n), "links-edges")

    need = keep(few(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), n), "links-need")
    sets = keep(fetch(need), "links-set")
    pairs = edges.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    good = pairs.select("a", "b", "sa", "sb").mapInArrow(tidy(_confirm(percent, expand)), "a long, b long, ok boolean").where("ok").select("a", "b")
    good = keep(few(good, n), "links-good")
    comp = components(good)

    rows = cand.where("m > 2").drop("sketch").join(maybe_broadcast(comp), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    rows = keep(few(rows, n), "links-rows")
    several = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    rows = keep(few(rows.join(maybe_broadcast(keep(few(several, n), "links-keys")), "key"), n), "links-several")
    if rows.isEmpty():
        return comp
    per = rows.groupBy("key", "c").agg(F.count("*").alias("n"))
    keys = per.groupBy("key").agg(F.sum("n").alias("k"), F.max(F.struct("n", "c")).alias("top"))
    keys = keys.select("key", "k", F.col("top.c").alias("major"), F.ceil(F.col("top.n") / block).alias("nb"), F.ceil((F.col("k") - F.col("top.n")) / block).alias("nm"))
    rows = rows.join(maybe_broadcast(keep(few(keys, n), "links-keys")), "key")
    # blocks of the largest component are numbered from 0, the others from nb; a pair of blocks is one number
    inside, total = F.col("c") == F.col("major"), F.col("nb") + F.col("nm")
    own = F.when(inside, F.pmod(F.xxhash64("id"), F.col("nb"))).otherwise(F.col("nb") + F.pmod(F.xxhash64("id"), F.col("nm")))
    met = F.when(inside, F.sequence(F.col("nb"), total - 1)).otherwise(F.sequence(F.lit(0).cast("long"), total - 1))
    rows = rows.select("key", "id", "c", "k", own.alias("own"), total.alias("total"), met.alias("met"))
    rows = rows.select("key", "id", "c", F.explode(F.when(F.col("k") <= block, F.array(F.lit(0).cast("long"))).otherwise(F.transform("met", lambda x: F.least("own", x) * F.col("total") + F.greatest("own", x)))).alias("sub"))
    blocks = rows.join(one, "id").select("key", "sub", "id", "c", "bands", "sketch").repartition("key", "sub").sortWithinPartitions("key", "sub", "id")
    rows = keep(blocks.mapInArrow(tidy(_partners(limit)), "key long, sub long, id long, c long"), "links-partners")
    if rows.isEmpty():
        return comp
    late = keep(few(rows.select("id").distinct().join(need, "id", "left_anti"), n), "links-late")
    if not late.isEmpty():  # ids without an edge yet
        sets = sets.unionByName(keep(fetch(late), "links-set"))
    blocks = rows.join(sets, "id").select("key", "sub", "id", "c", "s").repartition("key", "sub").sortWithinPartitions("key", "sub", "id")
    more = keep(blocks.mapInArrow(tidy(_block_links(percent, expand)), EDGE).distinct(), "links-more")
    return comp if more.isEmpty() else components(good.unionByName(more))
