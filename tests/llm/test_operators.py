import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meanfield.llm import ann, line_dedup, lm_scoring, media, minhash_dedup, mixing, packing, queries, token_output, toxicity, warc
from meanfield.llm._graph import components
from meanfield.llm._tokens import encoder

DOC = "doc_id long, text string, source string, n_lines int, epoch string, score string"
TEXT = "the quick brown fox jumps over the lazy dog and then runs away from the very angry bear in the dark forest"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
EDGES = [(1, None, "a"), (2, "", "a"), (3, TEXT, "b"), (3, TEXT, "b"), (4, TEXT, None), (None, TEXT, "b"), (5, LONG, "a"), (6, "é" * 5000, "c"), (7, " \n\t ", "c"), (8, "x", "c")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, "e", "s") for i, t, s in rows], DOC)


def ids_of(text):
    return np.append(encoder("byte_bpe_50k.json").ids(text), np.uint32(2))


@pytest.mark.parametrize("rows", [[], EDGES])
def test_packing(spark, rows):
    out = packing.pack(docs(spark, rows)).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = ids_of(t)
        first = len(ids) % 1024
        cuts = ([0] if first else []) + list(range(first, len(ids), 1024))
        for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 1024


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=60, deadline=None)
def test_bounds(sizes):
    bins, offs, n = packing.best_fit(np.array(sizes, np.int64), 64)
    assert packing.lower_bound(np.array(sizes, np.int64), 64) <= n
    assert all(sum(s for s, b in zip(sizes, bins, strict=True) if b == k) <= 64 for k in range(n))
    groups = token_output.pack_block(sizes, 64)
    assert len(groups) == n and sorted(k for g in groups for k in g) == list(range(len(sizes)))


def test_repeated_rows_are_packed_in_groups(spark):
    """Copies of one row are dealt over groups like other rows."""
    out = packing.pack(docs(spark, [(1, "a b c", "s")] * 500), group=50).collect()
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert len(out) == 500 and max(fill.values()) <= 1024 and len(fill) <= 10


def test_exchange_saves_sequences(spark):
    rows = [(i, "a " * n, "s") for i, n in enumerate([600, 400] * 40)]
    whole = packing.pack(docs(spark, rows)).select("sequence_id").distinct().count()
    split = packing.pack(docs(spark, rows), group=3).select("sequence_id").distinct().count()
    assert whole == 40 and split <= 60


@pytest.mark.parametrize("alphabet", [st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), st.sampled_from(" \n\t'sl019.,-–…“abcé'ß"), st.sampled_from("aB ")])
def test_token_ids(alphabet):
    """The fast encoder, which takes texts of these characters, against the tokenizers library."""
    e = encoder("byte_bpe_50k.json")
    fast = []

    @given(st.text(alphabet, min_size=4, max_size=300))
    @settings(max_examples=300, deadline=None)
    def same(text):
        got = e.fast.encode_to_numpy(text, disallowed_special=()).tolist()
        assert e.ids(text).tolist() == got == e.tokenizer().encode(text, add_special_tokens=False).ids
        fast.append(text)

    same()
    assert len(fast) >= 100


@pytest.mark.parametrize("rows", [[], EDGES])
def test_token_output(spark, rows):
    out = token_output.packed_rows(docs(spark, rows), seq_len=256, block_tokens=5000).collect()
    parts = {}
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == 256 and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == 50256).all()
        assert token_output.position_ids(r["resets"], r["n_tokens"]).tolist() == [p for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False) for p in range(b - a)]
        for d, p, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.setdefault((d, p), []).append(ids[a:b].tolist())
    for i, t, _ in rows:
        want = [*encoder("byte_bpe_50k.json").ids(t).tolist(), 50256]
        pieces = sorted((p, x[0]) for (d, p), x in parts.items() if d == i)
        assert [v for _, x in pieces for v in x] == want


def weights_of(tokens, x):
    raw = {k: v**x for k, v in tokens.items()}
    return {k: v / sum(raw.values()) for k, v in raw.items()}


def entropy_of(w):
    return -sum(v * np.log(v) for v in w.values())


def flattest(tokens, fits):
    """The smallest exponent in [0, 1] that fits, by plain bisection."""
    lo, hi = 0.0, 1.0
    if fits(weights_of(tokens, lo)):
        return lo
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(weights_of(tokens, mid)) else (mid, hi)
    return hi


def words(column="text"):
    return F.size(F.filter(F.split(F.coalesce(F.col(column), F.lit("")), " "), lambda x: x != ""))


@pytest.mark.parametrize("budget", ["cover", 9000.0])
def test_mixing(spark, budget):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else ("mid" if i % 2 else None)) for i in range(3000)]
    have = Counter()
    for _, t, s in rows:
        have[s] += len(t.split())
    size = lambda w: max(have[k] / w[k] for k in have) if budget == "cover" else budget
    x = flattest(have, lambda w: max(size(w) * w[k] / have[k] for k in have) <= 1.5)
    w = weights_of(have, x)
    out = mixing.mix(docs(spark, rows), max_repeat=1.5, budget=budget, block_rows=16, tokens=words()).collect()
    got, times = Counter(), {}
    for r in out:
        got[r["source"]] += r["tokens"]
        times.setdefault(r["doc_id"], []).append(r["epoch"])
        assert r["tokens"] == len(r["text"].split()) and r["n_lines"] == 9 and r["score"] == "s"
    for s in have:
        assert abs(got[s] - size(w) * w[s]) <= 7
    for i, _, s in rows:
        reads = size(w) * w[s] / have[s]
        assert sorted(times.get(i, [])) in ([*range(int(reads + 1e-6))], [*range(int(reads + 1e-6) + 1)])
    # a source's rows of one reading come block by block, in an order of their own in each reading
    for s in have:
        for e in (0, 1):
            keys = Counter(r["mix_key"] for r in out if r["source"] == s and r["epoch"] == e)
            assert all(n < 60 for n in keys.values())


def test_mixing_targets(spark):
    have = {"a": 5000, "b": 900, "c": 100, "d": 0}
    table = spark.createDataFrame(list(have.items()), "s string, t long")
    some = {k: v for k, v in have.items() if v}
    for e in (0.1, 0.2, entropy_of(weights_of(some, 1)), 0.9, 1.05):
        assert entropy_of(weights_of(some, mixing.find_exponent(table, e, None, 1.0))) == pytest.approx(e, abs=1e-8)
    assert mixing.find_exponent(table, 2.0, None, None) == 0
    for e, most, budget in ((None, 0.5, 6000.0), (-1.0, None, None), (0.2, 1.1, 6000.0)):
        with pytest.raises(ValueError):
            mixing.find_exponent(table, e, most, budget)
    tied = spark.createDataFrame([("a", 5), ("b", 5)], "s string, t long")
    assert mixing.find_exponent(tied, 0.7, None, None) == 0
    with pytest.raises(ValueError):
        mixing.find_exponent(tied, 0.1, None, None)


def test_mixing_edges(spark):
    names = ["row", "s", "u", "need", "block", "at", "last", "cut", "whole", "reads", "blocks", "left", "_source", "_need", "_u", "_block", "t"]
    wide = docs(spark, EDGES).select("*", *(F.lit(n).alias(n) for n in names))
    out = mixing.mix(wide, budget="cover").collect()
    assert all(r[n] == n for r in out for n in names) and {r["doc_id"] for r in out} == {i for i, _, _ in EDGES}
    assert {r["tokens"] for r in out if r["doc_id"] == 5} == {len(encoder("byte_bpe_50k.json").ids(LONG))} and {r["tokens"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert len({sum(r["doc_id"] == i for r in out) for i in (3,)} & {2, 4}) == 1
    assert mixing.mix(docs(spark, [])).count() == 0
    no_tokens = mixing.mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted(r["doc_id"] for r in no_tokens) == [1, 2]


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(401, None, 0), (402, [0.0] * 8, 0), (403, [1.0, None] * 4, 0), (404, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (420, [1.0, 2.0], 0), (421, [], 0), (422, [2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out = {}
    for r in ann.nearest(df, shard_rows=100).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    s = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    for q in range(0, 400, 20):
        want = sorted((-s[q, j], j) for j in range(400) if j != q)[:20]
        got = sorted(out[q])
        assert [k for k, _, _ in got] == list(range(1, 21))
        hits += len({j for _, j in want} & {j for _, j, _ in got})
    assert hits >= 0.9 * 400
    assert out[420] == [(1, 422, 4.0)] and set(out) == {*range(0, 400, 20), 420}
    for got in out.values():
        assert [(-v, j) for _, j, v in sorted(got)] == sorted((-v, j) for _, j, v in got)
    assert ann.nearest(df.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rows = [(5, [1.0, 2.0])] * 30 + [(i, [1.0, 2.0]) for i in range(6, 46)]
    for df in (rows, [*rows, (20, [3.0, 0.5])]):
        out = {}
        for r in ann.nearest(spark.createDataFrame(df, "vec_id long, embedding array<float>")).collect():
            out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(out) == {20, 40}
        # 20 has two vectors in the second case and takes the nearest rows of both; so does a candidate
        best = {q: sorted({(-max(np.dot(v, w) for k, v in df if k == q), j) if len(df) == len(rows) else (-float(np.dot(v, w)), j) for k, v in df if k == q for j, w in df if j != q})[:20] for q in out}
        for q, got in out.items():
            assert [(-s, j) for _, j, s in sorted(got)] == best[q] and [r for r, _, _ in sorted(got)] == list(range(1, 21))


def test_neighbours_in_several_blocks(spark):
    x = np.random.default_rng(4).normal(size=(300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.build_index(df, k=5, shard_rows=60)
    queries_ = ann.valid_vectors(df, "vec_id", "embedding")
    one = sorted(map(tuple, ann.search_index(index, queries_, k=5).collect()))
    assert sorted(map(tuple, ann.search_index(index, queries_, k=5, block=16, each=40).collect())) == one and len(one) == 1500


def test_backoff(spark):
    rows = [(1, "abab", "s"), (2, "abc", "s"), (3, None, "s")]
    got = {r["doc_id"]: r["log_prob"] for r in lm_scoring.score(docs(spark, rows), order=2, min_count=2, unit="bytes").collect()}
    sym = {"a": 3, "b": 4, "c": 5}
    seqs = [[0, *(sym[c] for c in t)] for _, t, _ in rows if t]
    two = Counter(p for s in seqs for p in zip(s, s[1:], strict=False))
    ctx, one = Counter(), Counter()
    for (a, b), n in two.items():
        ctx[a] += n
        one[b] += n
    total = sum(one.values())
    for (i, _, _), s in zip(rows, seqs, strict=False):
        want = sum(np.log(two[p] / ctx[p[0]]) if two[p] >= 2 else np.log(0.4 * one[p[1]] / total) for p in zip(s, s[1:], strict=False))
        assert got[i] == pytest.approx(want, rel=1e-5)
    assert got[3] == 0
    assert lm_scoring.score(docs(spark, EDGES)).count() == len(EDGES)
    assert lm_scoring.score(docs(spark, [])).count() == 0


@pytest.mark.parametrize("batch", [100, 1 << 24])
def test_word_backoff(spark, tmp_path, monkeypatch, batch):
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", batch)
    rng = np.random.default_rng(8)
    texts = ["the cat sat on the mat", "The cat sat down", "кот сидит", "пёс сидит сидит", "the cat sat on the mat", None, " ", *(" ".join(f"w{rng.integers(9)}" for _ in range(rng.integers(40))) for _ in range(30))]
    docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op4_backoff_scores(spark, str(tmp_path)).collect()}
    seqs = [["^", "^", "^", *(t or "").lower().split()] for t in texts]
    count, ctx = Counter(), Counter()
    for s in seqs:
        for i in range(3, len(s)):
            for k in (1, 2, 3):
                count[tuple(s[i - k + 1 : i + 1])] += 1
                ctx[k, tuple(s[i - k + 1 : i])] += 1
    for d, s in enumerate(seqs):
        want = 0
        for i in range(3, len(s)):
            k = next(k for k in (3, 2, 1) if count[tuple(s[i - k + 1 : i + 1])] >= 2 or k == 1)
            want += np.log(0.4 ** (3 - k) * count[tuple(s[i - k + 1 : i + 1])] / ctx[k, tuple(s[i - k + 1 : i])])
        assert got[d]["n_symbols"] == len(s) - 3 and got[d]["log_prob"] == pytest.approx(want)


def plain_hash(image):
    """The cosine hash by definition: means over bins, a sum for each frequency, signs against the median without the first."""
    up = np.kron(image.astype(float), np.ones((-(-32 // image.shape[0]) if image.shape[0] < 32 else 1, -(-32 // image.shape[1]) if image.shape[1] < 32 else 1)))
    h, w = up.shape
    edge = lambda n: [i * n // 32 for i in range(33)]
    small = [[up[a:b, c:d].mean() for c, d in zip(edge(w), edge(w)[1:], strict=False)] for a, b in zip(edge(h), edge(h)[1:], strict=False)]
    cos = [[np.cos(np.pi / 32 * u * (x + 0.5)) for x in range(32)] for u in range(8)]
    low = [sum(cos[u][y] * cos[v][x] * small[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = np.median(low[1:])
    return low, middle


@pytest.mark.parametrize("rows", [[], EDGES])
def test_media(spark, rows, tmp_path):
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op6_media_columns(spark, str(tmp_path)).collect()
    want = Counter()
    for i, t, _ in rows:
        raw = (t or "").encode()
        p = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        image = np.frombuffer(p, np.uint8).reshape(-1, 64)
        png = media.encode_png(image, level=1)
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(png), hashlib.sha256(png).hexdigest(), media.cosine_hash(image))] += 1
        low, middle = plain_hash(image)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(image)), np.uint8))
        assert all(b == (v > middle) or abs(v - middle) < 1e-6 for b, v in zip(bits, low, strict=True))
    assert Counter(tuple(r) for r in out) == want


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    x = np.random.default_rng(kind).integers(0, 256, (7, 13), dtype=np.uint8)
    png = media.encode_png(x, filters=(kind,))
    assert np.array_equal(media.decode_png(png), x)
    with pytest.raises(ValueError):
        media.decode_png(png[:-20] + b"\0" + png[-19:])
    mixed = np.array([kind, 0, 1, 2, 3, 4, kind], np.uint8)
    rest = np.stack([media._filtered(x, int(k))[y] for y, k in enumerate(mixed)])
    assert np.array_equal(media._unfiltered(mixed, rest), x)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def classes(items, near):
    root = {i: i for i in items}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in items:
        for b in items:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.integers(len(out))] = f"new{rng.integers(10**6)}"
    return out


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    rows, k = [], 10
    for _ in range(6):
        base = [f"w{rng.integers(400)}" for _ in range(120)]
        for n in (0, 0, 1, 2, 4, 8, 20):
            rows.append((k, " ".join(edited(base, rng, n)), "s"))
            k += 1
    return rows


def test_near_duplicates(spark):
    rows = corpus()
    sets = {}
    for i, t, _ in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
    want = classes(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(sets[i]) for i, r in got.items())


def test_near_duplicate_edges(spark):
    out = minhash_dedup.near_duplicates(docs(spark, EDGES)).collect()
    assert len(out) == len(EDGES)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["component_id"] == 1 and by[2]["kept"] and by[7]["component_id"] == 7 and by[8]["n_shingles"] == 1
    assert by[4]["component_id"] == 3 and not by[4]["kept"] and not by[None]["kept"]
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    # of the rows with TEXT one stays; rows without words all stay
    assert Counter(r["doc_id"] for r in minhash_dedup.keep_one(docs(spark, EDGES)).collect()) == Counter([1, 2, 3, 5, 6, 7, 8])
    twice = [(1, TEXT, "a"), (7, TEXT, "a"), (7, LONG, "b"), (None, TEXT, "a"), (None, "x y z", "c"), (9, " ", "a"), (9, " ", "a")]
    clash = docs(spark, twice).select("*", *(F.lit(n).alias(n) for n in ("row", "id", "th", "_gone", "_text", "_again", "blank", "n_shingles", "kept")))
    left = minhash_dedup.keep_one(clash).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter([(1, TEXT), (7, LONG), (None, "x y z"), (9, " "), (9, " ")])
    assert all(r[n] == n for r in left for n in ("row", "id", "th", "_gone", "kept"))


def test_blocks_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(400)}" for _ in range(60)]
    rows = [(i, " ".join(edited(base, rng, 2)), "s") for i in range(700)]
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(58)} for i, t, _ in rows}
    want = classes(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == want


def test_hot_keys_are_spread(spark, monkeypatch):
    """The same groups when every key that a few ids share is dealt as a hot one, in small blocks."""
    from meanfield.llm import _links

    rng = np.random.default_rng(6)
    base = [f"w{rng.integers(400)}" for _ in range(60)]
    rows = [(i, " ".join(edited(base, rng, 3)), "s") for i in range(200)]
    want = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    found = []

    def every_key(sigs, rows):
        keys = sigs.select(F.explode("bands").alias("key")).groupBy("key").count().where("count > 5").collect()
        found.extend(keys)
        return np.sort(np.array([r["key"] for r in keys], np.int64))

    monkeypatch.setattr(_links, "_hot_keys", every_key)
    linked = _links.link_components
    monkeypatch.setattr(minhash_dedup, "link_components", lambda *a: linked(*a, block=16))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == want and len(set(got.values())) > 1 and found


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1050)]
    ids = {v for e in edges for v in e}
    link = {frozenset(e) for e in edges}
    want = classes(sorted(ids), lambda a, b: frozenset((a, b)) in link)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    rng = np.random.default_rng(2)
    lines = [" ".join(f"w{rng.integers(500)}" for _ in range(30)) for _ in range(20)]
    rows = []
    for i in range(30):
        mine = [lines[rng.integers(20)] for _ in range(4)]
        mine = [" ".join(edited(x.split(), rng, int(rng.integers(0, 4)))) for x in mine]
        rows.append((i, "\n".join([*mine, f"short {i % 3}"]), "s"))
    at = {(i, k): x.encode() for i, t, _ in rows for k, x in enumerate(t.split("\n"))}
    sets = {p: {x[j : j + 9] for j in range(len(x) - 8)} or {x} for p, x in at.items()}
    want = classes(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.85)
    for r in line_dedup.dedup_lines(docs(spark, rows)).collect():
        gone = sorted(k for (i, k), c in want.items() if i == r["doc_id"] and c != (i, k))
        assert r["removed"] == gone
        assert r["text"].split("\n") == [x for k, x in enumerate(rows[r["doc_id"]][1].split("\n")) if k not in gone]
        assert r["n_lines"] == 5 and r["score"] == "s"


def test_line_dedup_edges(spark):
    out = line_dedup.dedup_lines(docs(spark, EDGES)).collect()
    assert len(out) == len(EDGES)
    assert [r["text"] for r in out if r["doc_id"] == 1] == [None] and [r["removed"] for r in out if r["doc_id"] == 4] == [[0]]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize("largest", [-1, 3])
def test_without_broadcasts(spark, monkeypatch, largest):
    """The joins that shuffle give what the broadcast ones give."""
    from meanfield.llm import _common

    rows = [(i, t + f"\nline {i % 5}\nall of them have this one", f"s{i % 2}") for i, t, _ in corpus()] + EDGES[:5]
    run = [
        lambda df: line_dedup.dedup_lines(df).select("doc_id", "removed", "text"),
        lambda df: minhash_dedup.near_duplicates(df, shingle=2, percent=60),
        lambda df: minhash_dedup.keep_one(df, shingle=2, percent=60).select("doc_id", "text"),
        lambda df: mixing.mix(df, tokens=words(), block_rows=8).select("doc_id", "epoch", "mix_key"),
    ]
    want = [Counter(str(r) for r in f(docs(spark, rows)).collect()) for f in run]
    monkeypatch.setattr(_common, "BROADCAST_ROWS", largest)
    assert [Counter(str(r) for r in f(docs(spark, rows)).collect()) for f in run] == want


def test_line_columns_and_nulls(spark):
    names = ["row", "th", "left", "gone", "id", "more", "_id", "_th", "_d", "_t", "_gone", "_new"]
    rows = [(None, "one line of text\nof its own", "s"), (4, "one line of text", "s"), (3, "x\none line of text", "s"), (3, "x\none line of text", "s")]
    wide = docs(spark, rows).select("*", *(F.lit(n).alias(n) for n in names))
    out = line_dedup.dedup_lines(wide).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == [("3", "x\none line of text")] * 2 + [("4", ""), ("None", "of its own")]
    assert all(r[n] == n for r in out for n in names)


def test_prints_that_share_a_half(spark, monkeypatch):
    """Lines whose ids clash are still different lines."""
    from meanfield.llm import line_dedup as ld

    rows = [(1, "alpha line of text\nbeta line of words", "s"), (2, "beta line of words\ngamma", "s"), (3, "gamma\ndelta, something else", "s")]
    want = {r["doc_id"]: r["removed"] for r in ld.dedup_lines(docs(spark, rows)).collect()}
    true = ld._line_prints

    def clashing(data, starts, ends):
        out = true(data, starts, ends).copy()
        out[:, 0] = 7
        return out

    monkeypatch.setattr(ld, "_line_prints", clashing)
    assert {r["doc_id"]: r["removed"] for r in ld.dedup_lines(docs(spark, rows)).collect()} == want == {1: [], 2: [0], 3: [0]}


def test_short_lines(spark, tmp_path):
    near = "all rights are reserved by the owner"
    rows = [(1, "Ok.\nfirst text\n\n" + near, "s"), (2, "Ok.\n\n" + near + "s\nsecond text", "s"), (3, " Ok. \r\nNo.\n \nfirst texts", "s"), (4, "No.\n" + "a" * 9 + "\n" + "a" * 12, "s")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["removed"] for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 2], 3: [0], 4: [0, 2]}


def test_warc(spark):
    big, other = "x" * 1200, "é" * 700
    rows = [(1, "http://a", big), (5, "http://b c", big), (3, None, big), (2, "http://d", "small"), (4, "http://e", "small"), (6, "u", None), (7, "u", other), (7, "u", other), (None, "u", big), (8, "u", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, frame int")
    out = warc.read_bundles(warc.bundle_pages(df, frame_bytes=2000, bundle_bytes=3000)).collect()
    assert len(out) == len(rows)
    for r in out:
        html = next(h for p, _, h in rows if p == r["page_id"]) or ""
        assert r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest() and r["payload_bytes"] == len(html.encode())
        again = html == big and r["page_id"] != 5
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if again else ("response", None))
    assert warc.read_bundles(warc.bundle_pages(df.limit(0))).count() == 0


def test_seek_table():
    import zstandard

    frames = [zstandard.ZstdCompressor().compress(x) for x in (b"one", b"two" * 100)]
    table = [(len(f), n, warc._checksum(x)) for f, n, x in zip(frames, (3, 300), (b"one", b"two" * 100), strict=True)]
    data = b"".join(frames) + warc.seek_table(table)
    got = warc.read_seek_table(data)
    assert warc.read_frame(data, got, 1) == b"two" * 100
    with pytest.raises(ValueError):
        warc.read_seek_table(data[:-1] + b"\0")


def test_character_model_counts_every_document(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 2)
    texts = [None, "", "Ab ab 12 cé", "ab " * 500, "x" * 30, "last ÉTÉ", "word_s 𝒜b² x1y٣z", "é" * 700_000, "ab\nc " * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            w = f"^^{re.sub('[^a-z]', '?', w)}$"
            want.update(w[i : i + 3] for i in range(len(w) - 2))
    assert toxicity.character_model(df).counts == dict(want)
    assert toxicity.character_model(df.limit(0)).counts == {}


WORDS = ["idiot", "stupid", "loser", "trash", "clown", "moron", "hello", "letter", "good", "morning", "you", "are", "é"]


def character_model():
    return toxicity.CharModel(Counter(g for w in WORDS * 50 for g in toxicity.CharModel.grams(w)))


def test_restore():
    m = character_model()
    for token, want in {"1d10t": "idiot", "id10t": "idiot", "stup!d": "stupid", "!diot": "idiot", "l0s3r": "loser", "t r a s h": "trash", "c.l.o.w.n": "clown", "i . d . i . o . t": "idiot", "1 d i 0 t": "idiot", "looooser": "loser", "hellllo": "hello", "l3tt3r": "letter", "y o u   i d i o t": "you idiot", "y o u a r e": "you are"}.items():
        assert toxicity.restore(token, m) == want
        assert want in toxicity.restored_words(f"you {token}, there!", m, {})
    # a token is decoded whole, however long
    assert toxicity.restore("111ddd111" + "0" * 40 + "t", m) == toxicity.restore("11dd1100t", m) == "idiot"
    assert toxicity.disguised("plain words, 1234 and more!! of% the*** (letters) - 5. | a table | we're a 1 2 3") == []


def test_every_disguised_word_is_restored():
    m = character_model()
    for text, want in {"1d10t m0r0n l0s3r s t u p i d": {"idiot", "moron", "loser", "stupid"}, "s t u p i d m0r0n": {"stupid", "moron"}, "é s.t.u.p.i.d é l0s3r": {"stupid", "loser"}, " ".join("good" * 25) + " m0r0n": {"good", "moron"}, "x" * 500 + "/l0s3r": {"loser"}}.items():
        assert want <= {w for x in toxicity.restored_words(text, m, {}) for w in x.split()}


@given(st.lists(st.sampled_from(["1", "0", "3", "l", "s", "ee", "ooo", ".", "r", "d"]), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_restoring_is_exact(parts):
    """Against every path through the lattice."""
    m, token = character_model(), "".join(parts)
    paths = [("", 0.0)]
    for arcs in toxicity._lattice(token):
        paths = [(w + x, c + y) for w, c in paths for x, y in arcs if x != " " or (w and w[-1] != " ")]

    def cost(word, c):
        return c + sum(m.log_prob(f"^^{w}$"[i : i + 3]) for w in word.split(" ") for i in range(len(w) + 1))

    best = max(cost(w, c) for w, c in paths)
    got = toxicity.restore(token, m)
    assert max(cost(w, c) for w, c in paths if w == got) == pytest.approx(best)


def test_cover_by_definition():
    """The lexicon against a plain greedy search that weighs every feature anew at each step."""
    rng = np.random.default_rng(0)
    names = [f"=w{i}" for i in range(12)] + ["abcd", "abcde"]
    for _ in range(20):
        cases = [{n for n in names if rng.random() < 0.25} for _ in range(40)]
        groups = rng.integers(0, 12, 40).tolist()
        seen = {n: (sum(n in c for c in cases), int(rng.integers(0, 2))) for n in names}
        need, want, left = [3] * 40, {}, {n for n in names if seen[n][0]}
        while left:
            gain = {n: sum(n in c and need[i] > 0 for i, c in enumerate(cases)) for n in left}
            n = min(left, key=lambda n: (20 * seen[n][1] - gain[n], -seen[n][0], -len(n), n))
            left.discard(n)
            bare = n.lstrip("=")
            if gain[n] < 3 or any(k.startswith(bare) or bare.startswith(k) for k in (x.lstrip("=") for x in want)):
                continue
            at = [i for i, c in enumerate(cases) if n in c and need[i]]
            if sum(need[i] == 3 for i in at) >= 3 or len({groups[i] for i in at}) >= 5:
                want[n] = (seen[n][0] + 1) / (sum(seen[n]) + 2)
                for i in at:
                    need[i] -= 1
        assert toxicity.cover(cases, groups, seen, 3) == want


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    bad = ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(900):
        w = [f"w{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}" for _ in range(20)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.integers(20)] = bad[i // 5 % 3] if i % 2 else bad[i // 5 % 3].replace("i", "1").replace("o", "0")
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic)))
    df = docs(spark, [*rows, *EDGES[:2]])
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    out = toxicity.score(df, model).collect()
    assert len(out) == 902
    wrong = [r["doc_id"] for r in out if r["doc_id"] >= 10 and r["predicted"] != int(r["doc_id"] % 5 == 0)]
    assert len(wrong) <= 9
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    # the score by its formula, from the words of the text and of its restored forms
    for r in out[:200]:
        low = (next(t for i, t, _ in rows if i == r["doc_id"]) if r["doc_id"] >= 10 else "").lower()
        if r["doc_id"] >= 10:
            seen = {m for w in [low, *toxicity.restored_words(low, model.chars, {})] for x in w.split() for m in model.lexicon if (x == m[1:] if m[0] == "=" else x.startswith(m))}
            assert r["score"] == pytest.approx(1 - (1 - model.rest) * np.prod([1 - model.lexicon[m] for m in seen]))
    kept = toxicity.reject(docs(spark, [*rows, *EDGES]).select("score", "text", "doc_id", "epoch"), model)
    assert kept.columns == ["score", "text", "doc_id", "epoch"]
    assert Counter(r["doc_id"] for r in kept.collect() if (r["doc_id"] or 0) >= 10) == Counter(r["doc_id"] for r in out if r["doc_id"] >= 10 and not r["predicted"])
    assert toxicity.score(docs(spark, EDGES), model).count() == len(EDGES)
    assert toxicity.score(docs(spark, []), model).count() == 0
    none = toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(df, none).collect()} == {0}


def test_line_stage_keeps_what_is_left(spark):
    import corpus_pipeline

    shared = " ".join(f"shared{i}" for i in range(60))
    rows = [(1, shared, "en", "a", 9), (2, shared + "\nits own line", "en", "a", 9), (3, shared + "\n \n", "en", "a", 9), (4, "", "en", "a", 0), (5, None, "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}
    assert got == {1: shared, 2: "its own line", 4: "", 5: None}


@pytest.mark.parametrize("rows", [[], EDGES])
def test_pipeline_of_edges(spark, tmp_path, rows):
    """Nulls, empty, long, equal and repeated texts through every stage; extra columns whose names clash pass through."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, epoch string, row string, kept string"
    spark.createDataFrame([(i, t, "en", s, 0, "e", "r", "k") for i, t, s in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (None, 0, 1), (3, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs_ = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, str(tmp_path))
        assert docs_.schema.names == schema.replace(",", "").split()[::2], name
        path = str(tmp_path / name)
        docs_.write.parquet(path)
        docs_ = spark.read.parquet(path)
        left.append(Counter(r["doc_id"] for r in docs_.collect()))
    if not rows:
        assert left == [Counter()] * 4 and corpus_pipeline.run(spark, str(tmp_path)).count() == 0
        return
    assert left[0] == Counter(i for i, _, _ in rows)
    # documents 4 and null hold the same line as 3, which stays with all its copies; of these one stays in the next stage
    assert left[1] == Counter([1, 2, 3, 3, 5, 6, 7, 8]) and left[2] == Counter([1, 2, 3, 5, 6, 7, 8])
    assert set(left[3]) == set(left[2]) and max(left[3].values()) <= 2
    out = corpus_pipeline.pack(spark, docs_, str(tmp_path)).collect()
    tokens = {i: len(ids_of(t)) for i, t, _ in rows}
    assert Counter(r["doc_id"] for r in out for _ in range(r["length"])) == Counter({i: n * tokens[i] for i, n in left[3].items()})


def test_mixture_is_written_in_order(spark):
    import corpus_pipeline

    rows = [(i, f"text {i}", "en", f"s{i % 2}", 6) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [r["doc_id"] for r in mixing.mix(df, max_repeat=1.25, budget="cover", block_rows=1024).orderBy("mix_key").collect()]
    got = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, df, "").collect()]
    source = {i: s for i, _, _, s, _ in rows}
    assert Counter(got) == Counter(want) and [source[i] for i in got] == [source[i] for i in want]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    table = [(i, t if i % 11 else t + " you idiot", "en", f"s{i % 3}", len(t)) for i, t, _ in rows]
    table += [(500 + i, f"plain text number {i} " + " ".join(f"z{i}y{j}" for j in range(30)) + (" idiot" if i % 4 == 0 else ""), "en", "s0", 9) for i in range(80)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(500 + i, 0, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = [(i, t) for i, t, *_ in table if not re.search(r"\bidiot\b", t)]
    lines = {i: {t.encode()[j : j + 9] for j in range(len(t.encode()) - 8)} for i, t in clean}
    first = classes([i for i, _ in clean], lambda a, b: jaccard(lines[a], lines[b]) >= 0.85)
    left = [(i, t) for i, t in clean if first[i] == i]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in left}
    near = classes(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert got == {i for i in near if near[i] == i}
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_a_document_is_split_once(spark):
    """Each joined text has one split, outside the function that takes its lines: that would run it for each line."""
    lines = [f"{i // 2:07d}" for i in range(200)]
    out = line_dedup.dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_join(") == plan.count("split(") > 0
    (row,) = out.collect()
    assert row["text"].split("\n") == lines[::2] and row["removed"] == list(range(1, 200, 2)) and row["n_lines"] == 200


def test_link_work_is_done_once(monkeypatch):
    """Only entries of shared keys are sorted by id, and a line in several blocks has its set made once."""
    import pyarrow as pa

    from meanfield.llm import _links

    sorts, made, lexsort = [], [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(len(keys[0])) or lexsort(keys))
    entries = [(k, k + 1) for k in range(1000)] + [(5000, 2), (5000, 1), (5000, 2), (6000, 3), (6000, 3)]
    batch = pa.RecordBatch.from_pydict({"p": pa.array([0], pa.int32()), "x": [np.array(entries, np.int64).tobytes()]})
    (out,) = _links._shared(np.zeros(0, np.int64))(iter([batch]))
    assert out.to_pydict() == {"key": [5000, 5000], "id": [1, 2], "m": [2, 2]} and sorts == [5]

    def expand(raw):
        made.extend(raw)
        return _links.hash_runs(raw)

    s = {i: np.arange(lo, lo + 20, dtype=np.uint64).tobytes() for i, lo in ((1, 0), (2, 1), (3, 100))}
    rows = [(7, 1), (7, 2), (7, 3), (8, 1), (8, 2), (9, 1), (9, 3)]  # the last key comes in a table of its own
    batch = pa.RecordBatch.from_pydict({"key": [k for k, _ in rows], "sub": [0] * 7, "id": [i for _, i in rows], "c": [i for _, i in rows], "s": [s[i] for _, i in rows]})
    (out,) = _links._block_links(85, expand)(iter([batch]))
    assert out.to_pydict() == {"a": [1], "b": [2]} and len(made) == 3 + 2


def test_lines_are_trimmed():
    texts = [b"a b", b"  a ", b" " * 50 + b"x" + b"\t" * 50, b" " * 40, b"", b"\r\v\fz"]
    for use in (texts, texts[:2] + texts[4:]):  # far and near
        ends = np.cumsum([len(x) for x in use])
        data = b"".join(use)
        lo, hi = line_dedup._trimmed(np.frombuffer(data, np.uint8), ends - [len(x) for x in use], ends)
        assert [data[a:b] for a, b in zip(lo, hi, strict=True)] == [x.strip(b" \t\n\r\v\f") for x in use]


def test_a_task_gets_one_part(spark, monkeypatch):
    """No task takes rows of several parts at once, and the ids of shared keys go to the sketches, so that these needn't move."""
    from meanfield.llm import _links

    shared, stored, plans = _links._shared, _links.stored, {}

    def one_part(hot):
        def run(batches):
            batches = list(batches)
            assert len({p for b in batches for p in b.column(0).to_pylist()}) <= 1
            yield from shared(hot)(iter(batches))

        return run

    def noted(df, name, *rest):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name, *rest)

    monkeypatch.setattr(_links, "_shared", one_part)
    monkeypatch.setattr(_links, "stored", noted)
    rows = [(i, f"{TEXT} {i // 2}\n{TEXT[::-1]} {i // 3}", "s") for i in range(40)]
    assert [r["removed"] for r in line_dedup.dedup_lines(docs(spark, rows)).where("doc_id > 0").select("removed").distinct().collect()] == [[0, 1]]
    assert "strategy=broadcast" in plans["links-sketch"]
