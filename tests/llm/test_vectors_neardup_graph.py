import random

import numpy as np
from pyspark.sql import functions as F

from foliomill.llm import graph, neardup, vectors


def brute(rows, k):
    out = {}
    for i, d, v in rows:
        sims = []
        for j, e, w in rows:
            if i != j and d == e:
                a, b = np.array(v, float), np.array(w, float)
                a, b = a / abs(a).max(), b / abs(b).max()
                sims.append((-(a @ b / np.linalg.norm(a) / np.linalg.norm(b) + 1) / 2, j))
        out[i] = [(j, -s) for s, j in sorted(sims)[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 8 if i % 3 else 5, rng.normal(size=8 if i % 3 else 5).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000, 3, [1.0, 2.0, 3.0])] + [(2000 + i, 8, [1e-20 * x for x in rows[1][2]]) for i in range(1)]
    df = spark.createDataFrame(rows, "record_id bigint, dim int, v array<float>")
    got = {}
    for r in vectors.top_neighbours(df, 5, all_tiles=True, tile=16).orderBy("record_id", "rank").collect():
        got.setdefault(r.record_id, []).append((r.neighbour_id, r.similarity))
    want = {k: v for k, v in brute(rows, 5).items() if v}
    assert set(got) == set(want)
    for i in want:
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=1e-7)
    assert sum({j for j, _ in got[i]} == {j for j, _ in want[i]} for i in want) >= len(want) - 2


def test_neighbours_of_copies(spark):
    rng = np.random.default_rng(4)
    one = rng.normal(size=4).tolist()
    rows = [(i, 4, one) for i in range(40)] + [(100 + i, 4, rng.normal(size=4).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "record_id bigint, dim int, v array<float>")
    got = {}
    for r in vectors.top_neighbours(df, 3, all_tiles=True).collect():
        got.setdefault(r.record_id, set()).add(r.neighbour_id)
    for i in range(40):
        assert got[i] == set([j for j in range(40) if j != i][:3])
    assert all(len(got[100 + i]) == 3 for i in range(5))


def test_recall_by_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    rows = [(i, 16, (centres[i % 60] + 0.2 * rng.normal(size=16)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "record_id bigint, dim int, v array<float>")
    got = {(r.record_id, r.neighbour_id) for r in vectors.top_neighbours(df).collect()}
    x = np.array([r[2] for r in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(1200) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) / len(want) >= 0.95


def test_usable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "d", "ok", [1.0, 2.0]), (1, "d", "ok", [1.0, 2.0]), (2, "d", "failed", [1.0, 2.0]), (3, "d", "ok", [1.0]), (4, "d", "ok", [nan, 1.0]), (5, "d", "ok", [inf, 1.0]), (6, "d", "ok", [0.0, 0.0]), (7, "d", "ok", None), (8, "d", "ok", []), (9, "x", "ok", [1.0, 2.0]), (10, None, "ok", [1.0, 2.0]), (None, "d", "ok", [1.0, 2.0]), (11, "d", "ok", [None, 1.0]), (12, "d", None, [1.0, 2.0]), (13, "d", "ok", [-0.5, 0.0])]
    df = spark.createDataFrame(rows, "record_id bigint, document_id string, status string, embedding array<float>").withColumn("dim", F.lit("clash"))
    jobs = spark.createDataFrame([("d", 1), ("d", 1)], "document_id string, config_id int")
    configs = spark.createDataFrame([(1, 2), (2, 3)], "config_id int, embedding_dimension int")
    u = vectors.usable(df, jobs, configs)
    assert sorted(r.record_id for r in u.collect()) == [1, 13]
    assert vectors.top_neighbours(u.limit(0)).count() == 0
    assert [tuple(r) for r in vectors.neighbour_pairs(vectors.top_neighbours(u)).collect()] == [(1, 13)]


def test_bound_of_quantisation():
    rng = np.random.default_rng(6)
    q, r = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(50, 32)), rng.normal(size=(70, 32))))
    a, s, e = vectors.quantise(q)
    b, t, f = vectors.quantise(r)
    off = np.abs((a @ b.T) * s[:, None] * t[None] - q @ r.T)
    assert (off <= e[:, None] * (1 + f[None]) + f[None] + 1e-12).all()


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def text(rnd, n):
    return [f"w{rnd.randint(0, 4000)}" for _ in range(n)]


def test_near_duplicates(spark):
    rnd, rows, i = random.Random(8), [], 0
    for _ in range(150):
        base = text(rnd, rnd.randint(30, 120))
        for _ in range(rnd.randint(1, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, 12)):
                at = rnd.randrange(len(copy))
                rnd.choice([lambda: copy.pop(at), lambda: copy.insert(at, "new"), lambda: copy.__setitem__(at, f"x{rnd.randint(0, 99)}")])()
            rows.append((i, rnd.choice([" ", ", ", "\n"]).join(copy)))
            i += 1
    long = " ".join(text(rnd, 30_000))
    rows += [(900, None), (901, ""), (902, long), (903, long.upper()), (904, "same " * 50), (905, "same " * 60), (906, "a " * 39), rows[0]]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("h", F.lit("clash")).withColumn("runs", F.lit(1))
    links, members = neardup.near_duplicate_classes(df, "id", "t")
    got = {tuple(r) for r in neardup.pairs(links, members, "id").collect()}
    import re

    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= 40:
            sets[k] = set(zip(w, w[1:], w[2:]))
    want = {(a, b) for a in sets for b in sets if a < b and 3 * len(sets[a] & sets[b]) >= len(sets[a]) + len(sets[b])}
    assert got <= want and len(want - got) <= 0.01 * len(want) and len(want) > 100
    assert (902, 903) in got and (904, 905) in got
    links, members = neardup.near_duplicate_classes(df.limit(0), "id", "t")
    assert links.count() == 0 and members.count() == 0


def test_many_copies_are_one_class(spark):
    rnd = random.Random(9)
    hot, other = " ".join(text(rnd, 60)), [" ".join(text(rnd, 60)) for _ in range(200)]
    df = spark.createDataFrame([(i, hot) for i in range(3000)] + [(5000 + i, t) for i, t in enumerate(other)], "id int, t string")
    links, members = neardup.near_duplicate_classes(df, "id", "t")
    assert links.count() == 0
    assert members.groupBy("h").count().agg(F.max("count")).first()[0] == 3000


def test_a_common_text_is_paired_with_texts_that_hold_it(spark):
    notice = [f"n{j}" for j in range(102)]
    # a third of all rows are the notice or hold it beside 70 % of own text; the rest has nothing in common with it
    rows = [(i, " ".join(notice)) for i in range(60)] + [(100 + i, " ".join(notice + [f"own{i}x{j}" for j in range(70)])) for i in range(40)]
    rows += [(1000 + i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(200)]
    # of 100 runs each, 50 common ones and 17 rare ones are shared
    rows += [(2000 + i, " ".join(notice[:52] + ["rare"] + [f"rare{j}" for j in range(16)] + [f"tail{i}x{j}" for j in range(33)])) for i in range(2)]
    links, members = neardup.near_duplicate_classes(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    got = {tuple(r) for r in neardup.pairs(links, members, "id").collect()}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60)} | {(a, 100 + b) for a in range(60) for b in range(40)}
    assert want <= got and (2000, 2001) in got


def test_entries_of_one_variant_are_compared_in_tiles(spark, monkeypatch):
    rnd = random.Random(10)
    base = text(rnd, 60)
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(50)] + [(100 + i, " ".join(text(rnd, 60))) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, t string")
    st = neardup.sets(df, "id", "t").cache()
    whole = {tuple(r) for r in neardup.candidates(st, 100).collect()}
    # groups of one variant in tiles, within the process so that the size is seen
    kind, h = neardup.entry_type(4), st.toPandas()
    _, e = neardup.entries(h["h"].to_numpy(), np.concatenate(h["runs"]).astype(np.int32), h["runs"].map(len).to_numpy(), np.stack([np.asarray(b) for b in h["bits"]]).view(np.uint64), range(16), 4)
    monkeypatch.setattr(neardup, "TILE", 8)
    tiles, pairs = 0, set()
    for f in neardup.matches(e, 4, 0.5):
        for a, b, x, y in f.itertuples(index=False):
            if x is None:
                pairs.add((a, b))
            else:
                tiles += 1
                both = np.frombuffer(x + y, dtype=kind)
                n = len(x) // kind.itemsize
                i, j = np.triu_indices(n, 1) if x == y else (g.ravel() for g in np.meshgrid(np.arange(n), np.arange(n, len(both)), indexing="ij"))
                pairs |= {tuple(r) for r in neardup._pairs_of(both, i, j, 0.5).itertuples(index=False)}
    assert tiles and {p for p in pairs if p[0] < p[1]} == whole and len(whole) >= 1225


def test_segments_get_wider_with_the_collection():
    for total, width in ((1000, 4), (10**7, 5), (10**9, 7)):
        count, w = neardup.shape(total)
        assert w == width and (1 - (w + 1) / 2**w) ** count <= neardup.MISSED


def test_bitmaps_bound_the_overlap_from_above():
    rng = np.random.default_rng(11)
    for _ in range(50):
        a = rng.choice(5000, rng.integers(38, 200), replace=False)
        b = np.r_[rng.choice(a, rng.integers(1, len(a)), replace=False), 5000 + rng.choice(5000, 40, replace=False)]
        e = np.zeros(2, dtype=neardup.entry_type(4))
        for k, x in enumerate((a, b)):
            m = np.zeros(neardup.BITS, dtype=bool)
            m[x % neardup.BITS] = True
            e["bits"][k], e["n"][k] = np.packbits(m).view(np.uint64), len(x)
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert true < 0.5 or neardup._possible(e, np.array([0]), np.array([1]), 0.5)[0]
