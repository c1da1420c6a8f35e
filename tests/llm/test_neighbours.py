import numpy as np

from loamdex.llm import neighbours as N


def planted(n=900, dim=24, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    x = centres[r.integers(0, 12, n)] * 0.5 + r.normal(size=(n, dim))
    for i in range(0, n, 9):
        x[i + 1] = x[i] * 3 + r.normal(size=dim) * 0.12
    return x.astype(np.float32)


def frame(spark, x, extra=()):
    rows = [(f"v{i:04}", row.tolist(), x.shape[1]) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, dim int")


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)  # long files are cut into blocks
    x = planted()
    s = cosines(x)
    want = {(f"v{i:04}", f"v{j:04}") for i, j in zip(*np.where(np.triu(s >= 0.94, 1)))}
    bad = [("bad1", [1.0] * 23, 24), ("bad2", [0.0] * 24, 24), ("bad3", [None] * 24, 24), ("bad4", [float("nan")] * 24, 24), ("bad5", None, 24), ("v0000", x[0].tolist(), 24), (None, x[0].tolist(), 24), ("other", [1.0, 2.0], 2), ("other2", [1.0, 2.0], 2), ("lone", [1.0], 1)]
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in N.similar_pairs(frame(spark, x, bad), 0.94).collect()}
    assert got == want | {("other", "other2")}


def hot(copies=450, near=90, seed=3):
    """A third of the rows are copies of one vector, and others lie close to it."""
    x = planted()
    r = np.random.default_rng(seed)
    noise = r.normal(size=(near, x.shape[1]))
    noise *= np.linalg.norm(x[7]) / np.linalg.norm(noise, axis=1, keepdims=True)
    return np.concatenate([x, np.repeat(x[7:8], copies, 0), x[7] + noise * r.uniform(0.1, 0.3, (near, 1))]).astype(np.float32)


def test_pairs_around_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    x = hot()
    s = cosines(x.astype(np.float64))
    want = {(f"v{i:04}", f"v{j:04}") for i, j in zip(*np.where(np.triu(s >= 0.94, 1)))}
    rows = N.similar_pairs(frame(spark, x), 0.94).collect()
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in rows}
    assert len(rows) == len(got) and got <= want and len(got) / len(want) >= 0.999


def test_pairs_in_a_dense_cluster(spark):
    x = planted()
    x[:300] = x[7] + np.random.default_rng(1).normal(size=(300, x.shape[1])) * 0.01
    s = cosines(x.astype(np.float64))
    got = N.similar_pairs(frame(spark, x), 0.94).count()
    assert got / np.triu(s >= 0.94, 1).sum() >= 0.999


def test_nearest_of_copies(spark):
    x = hot()
    s = np.round(cosines(x.astype(np.float64)), 3)
    hit = total = 0
    found = {}
    for r in N.nearest(frame(spark, x), 10).collect():
        found.setdefault(r["chunk_id"], []).append((r["rank"], r["neighbour"], r["cosine"]))
    for i, row in enumerate(s):
        mine = sorted(found[f"v{i:04}"])
        assert [m[0] for m in mine] == list(range(1, 11)) and f"v{i:04}" not in {m[1] for m in mine}
        hit += sum(c >= np.sort(row)[-10] - 0.003 for _, _, c in mine)
        total += 10
    assert hit / total >= 0.9
    copies = [f"v{i:04}" for i in [7, *range(900, 1350)]]
    assert [m[1] for m in sorted(found["v1000"])] == copies[:10] and [m[1] for m in sorted(found["v0007"])] == copies[1:11]


def test_nearest_recall(spark):
    x = planted()
    s = cosines(x)
    want = np.argsort(-s, axis=1)[:, :10]
    rows = N.nearest(frame(spark, x), 10).collect()
    found = {}
    for r in rows:
        found.setdefault(r["chunk_id"], set()).add(r["neighbour"])
    hit = sum(len(found.get(f"v{i:04}", set()) & {f"v{j:04}" for j in w}) for i, w in enumerate(want))
    assert hit / want.size >= 0.9
    assert all(abs(r["cosine"] - s[int(r["chunk_id"][1:]), int(r["neighbour"][1:])]) < 0.005 for r in rows)


def test_recall_on_the_given_vectors(spark, sf):
    import pandas as pd

    v = pd.read_parquet(f"{sf.replace('0.001', '0.01')}/chunk_vectors.parquet").drop_duplicates("chunk_id")
    v = v[v["embedding"].map(lambda e: e is not None and len(e) == 64 and not np.isnan(np.asarray(e, float)).any() and np.any(np.asarray(e, float)))]
    x = np.stack(v["embedding"].to_numpy()).astype(np.float32)
    names = v["chunk_id"].to_numpy()
    want = np.argsort(-cosines(x), axis=1)[:, :10]
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/chunk_vectors.parquet").where("dim = 64")
    found = {}
    for r in N.nearest(df, 10).collect():
        found.setdefault(r["chunk_id"], set()).add(r["neighbour"])
    hit = sum(len(found.get(names[i], set()) & set(names[w])) for i, w in enumerate(want))
    print("recall", hit / want.size)
    assert hit / want.size >= 0.9


def test_footrule():
    r = np.random.default_rng(1)
    a, b = (np.stack([r.permutation(30)[:6] for _ in range(n)]).astype(np.int16) for n in (7, 9))
    place = lambda v, row: next((i for i, x in enumerate(row) if x == v), 6)
    want = [[sum(abs(place(v, x) - place(v, y)) for v in {*x, *y}) for x in a.tolist()] for y in b.tolist()]
    far = N.Footrule(a)
    assert (42 - 2 * far(b).astype(int)).tolist() == want
    assert all(((far(b) >= far.least(c)) == (np.array(want) <= c * 42 + 1e-6)).all() for c in (0.2, 0.5, 0.75, 1.0))


def test_exact_mode_finds_every_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_PIVOTS", 8)
    for x in (planted(seed=11), hot(copies=60, near=40)):
        s = cosines(x.astype(np.float64))
        want = {(f"v{i:04}", f"v{j:04}") for i, j in zip(*np.where(np.triu(s >= 0.8, 1)))}
        assert {(r["chunk_id_a"], r["chunk_id_b"]) for r in N.similar_pairs(frame(spark, x), 0.8, exact=True).collect()} == want


def test_codes_stay_within_their_error():
    x = N._unit(np.random.default_rng(2).normal(size=(50, 24)))
    for encode, kind in ((N._as_bytes, np.int8), (N._as_halves, np.float16)):
        code, scale, err = encode(x)
        back = np.frombuffer(b"".join(code), kind).reshape(50, -1).astype(np.float32) * scale[:, None]
        assert (np.linalg.norm(back - x, axis=1) <= err + 1e-6).all() and err.max() < 0.03


def test_brute_force(spark):
    x = planted()
    s = cosines(x)
    got = {r["chunk_id"]: r["kth"] for r in N.brute_force(frame(spark, x), 10, every=7).collect()}
    assert 60 < len(got) < 220 and all(abs(v - np.sort(s[int(c[1:])])[-10]) < 0.003 for c, v in got.items())


def test_empty(spark):
    assert N.similar_pairs(frame(spark, np.zeros((0, 4), np.float32)), 0.94).count() == 0
    assert N.nearest(frame(spark, np.zeros((0, 4), np.float32))).count() == 0
