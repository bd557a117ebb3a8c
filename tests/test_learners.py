"""Learners, decompositions and images: planted models, closed forms and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import decompose, images, learn
from larkspur.operators.batches import map_vectors, reduce_batches, sum_batches


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    a, w, b = rng.normal(size=(128, 5)), rng.normal(size=(5, 2)), np.array([1.0, -2.0])
    y = a @ w + b
    df = spark.createDataFrame([(i, a[i].tolist(), y[i].tolist(), int(i % 3)) for i in range(128)], "id int, a array<double>, y array<double>, c int").repartition(4)
    return df, a, y, w, b


def test_solvers_find_the_model(planted):
    df, a, y, w, _ = planted
    x, t = F.col("a"), F.col("y")
    for m in (
        learn.least_squares(df, x, t, 5, 2), learn.block_least_squares(df, x, t, 5, 2, 2, 60), learn.local_least_squares(a, y, 1e-9),
        learn.lbfgs_least_squares(df, x, t, 5, 2, rounds=80, tolerance=1e-12),
    ):
        assert np.allclose(m.weights, w, atol=1e-3) and np.allclose(m.of(a), y, atol=1e-3)


def test_block_solver_needs_no_whole_product(planted):
    df, a, y, w, _ = planted
    whole = learn.block_least_squares(df, F.col("a"), F.col("y"), 5, 2, 2, 4, 0.5)
    parts = learn.block_least_squares(df, F.col("a"), F.col("y"), 5, 2, 2, 4, 0.5, gram_bytes=0)
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.of(a), parts.of(a))


def test_reductions_run_side_by_side(spark):
    import time

    def slow(s, x):
        time.sleep(1)
        return s + len(x)

    df = spark.range(400).repartition(4)
    spark.range(4).repartition(4).mapInArrow(lambda b: b, "id long").collect()  # workers are there
    began = time.time()
    total = reduce_batches(df, [F.col("id")], slow, np.add, np.zeros(1))
    assert total[0] == 400 and time.time() - began < 3.5
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert sum_batches(spark.range(0, 5000, 1, 200), [F.col("id")], lambda x: np.array([x.sum()]), (1,))[0] == 4999 * 2500
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) <= 4


def test_weighted_solvers_agree_with_their_definition(planted):
    df, a, *_ = planted
    c = np.arange(128) % 3
    direct = learn.class_weighted_least_squares(df, F.col("a"), F.col("c"), 5, 3, 0.1, 0.3)
    assert np.allclose(direct.weights, learn.class_weighted_least_squares(df, F.col("a"), F.col("c"), 5, 3, 0.1, 0.3, gram_bytes=200).weights)
    whole, parts = (learn.class_weighted_least_squares(df, F.col("a"), F.col("c"), 5, 3, 0.1, 0.3, 2, 3, gram_bytes=g) for g in (1 << 20, 40))
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.intercept, parts.intercept)
    block = learn.class_weighted_least_squares(df, F.col("a"), F.col("c"), 5, 3, 0.1, 0.3, 2, 200)
    assert np.allclose(direct.weights, block.weights, atol=1e-6)
    for k in range(3):
        u = 0.7 / 128 + 0.3 * (c == k) / (c == k).sum()
        t = np.where(c == k, 1.0, -1.0)
        ma, mt = u @ a / u.sum(), u @ t / u.sum()
        want = np.linalg.solve((a - ma).T @ ((a - ma) * u[:, None]) + 0.1 * np.eye(5), (a - ma).T @ (u * (t - mt)))
        assert np.allclose(direct.weights[:, k], want)


def test_solver_choice():
    assert learn.choose_solver(10**6, 1000, 1000, 1.0, 16) == "exact"
    assert learn.choose_solver(10**6, 10**4, 1000, 1.0, 16) == "block"
    assert learn.choose_solver(10**6, 10**4, 2, 0.01, 16) == "sparse_lbfgs"
    assert {decompose.choose_pca(100, 10, 4), decompose.choose_pca(10**9, 10, 4)} == {"local", "distributed"} or decompose.choose_pca(10**9, 10, 4) == "distributed"


def test_sparse_lbfgs(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8)) * (rng.random((60, 8)) < 0.5)
    w = rng.normal(size=8)
    e = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(60) for j in range(8) if m[i, j]], "row int, idx int, value double")
    got, b = learn.sparse_lbfgs_least_squares(e, spark.createDataFrame([(i, float(m[i] @ w + 3)) for i in range(60)], "row int, y double"), 8, rounds=120, tolerance=1e-12)
    assert np.allclose(got, w, atol=1e-2) and abs(b - 3) < 1e-2


def test_kernel_ridge(spark):
    x = np.array([[1.0, 1], [1, -1], [-1, 1], [-1, -1]])
    y = np.array([[1.0, -1], [-1, 1], [-1, 1], [1, -1]])
    train = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>")
    m = learn.kernel_ridge(train, F.col("x"), F.col("y"), 2, 2, 10, 1e-6, 2, 2)
    df = spark.createDataFrame([(0, [-1.0, 1.0]), (1, [1.0, 1.0])], "i int, v array<double>")
    assert [int(np.argmax(r.scores)) for r in m.scores(df, F.col("v")).orderBy("i").collect()] == [1, 0]
    # All rows, in any number of blocks, with weights written now and then: the direct solution.
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(23, 3)), rng.normal(size=(23, 2))
    train = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(3)
    want = learn.gaussian_kernel(x, x, 0.5) @ np.linalg.solve(learn.gaussian_kernel(x, x, 0.5) + 2 * np.eye(23), y)
    test = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "i int, v array<double>")
    for block, every, seed in ((12, 3, 1), (50, 16, None)):
        m = learn.kernel_ridge(train, F.col("x"), F.col("y"), 3, 2, 0.5, 2.0, block, 8, seed, every)
        assert np.allclose([r.scores for r in m.scores(test, F.col("v")).orderBy("i").collect()], want, atol=1e-3)
    none = learn.kernel_ridge(train.limit(0), F.col("x"), F.col("y"), 3, 2, 0.5, 2.0, 4, 2)
    assert [r.scores for r in none.scores(df, F.col("v")).collect()] == [[0, 0], [0, 0]]


def test_scaler_and_reductions(spark, planted):
    df, a, *_ = planted
    s = learn.standard_scaler(df, F.col("a"), 5)
    z = np.array([r[0] for r in df.orderBy("id").select(s.apply(F.col("a"))).collect()])
    assert np.allclose(z.mean(0), 0) and np.allclose(z.std(0, ddof=1), 1) and np.allclose(z, (a - a.mean(0)) / a.std(0, ddof=1))
    local, by_gram, by_qr = decompose.pca_local(a, 3), decompose.pca(df, F.col("a"), 5, 3), decompose.pca_tall_skinny(df, F.col("a"), 5, 3)
    assert np.allclose(local, by_gram, atol=1e-8) and np.allclose(local, by_qr, atol=1e-8)
    assert np.allclose(decompose.pca_approximate(a - a.mean(0), 2), local[:, :2], atol=1e-2)
    white = decompose.zca(a, 1e-12)
    assert np.allclose(np.cov(white.of(a).T), np.eye(5), atol=1e-6)
    assert decompose.discriminants(df, F.col("a"), F.col("c"), 5, 3, 2).weights.shape == (5, 2)


def test_clusters_and_mixtures(spark):
    pts = np.array([[1.0, 2, 6], [1, 3, 0], [1, 4, 6], [1, 1, 0]])
    assert sorted(decompose.kmeans_local(pts, 2, 10).tolist()) == [[1, 2, 0], [1, 3, 6]]
    df = spark.createDataFrame([(p.tolist(),) for p in pts], "v array<double>")
    assert sorted(decompose.kmeans(df, F.col("v"), 3, pts[:2], 10).tolist()) == [[1, 2, 0], [1, 3, 6]]
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-5, 1, 300), rng.normal(5, 1, 300)])[:, None]
    m = decompose.gaussian_mixture(spark.createDataFrame([(p.tolist(),) for p in x], "v array<double>"), F.col("v"), 1, np.array([[-3.0], [3.0]]), tolerance=1e-9)
    assert np.allclose(np.sort(m.means[:, 0]), [-5, 5], atol=0.3) and np.allclose(m.posteriors(x).sum(1), 1) and m.fisher(x).shape == (1, 4)


def test_column_operators(spark):
    rng = np.random.default_rng(4)
    m = [rng.normal(size=(rng.integers(1, 6), 4)) * [4, 3, 2, 1] for _ in range(40)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(40, [])], "i int, m array<array<double>>")
    flat = np.vstack(m)
    for how in ("local", "distributed"):
        assert np.allclose(decompose.column_pca(df, F.col("m"), 4, 2, how), decompose.pca_local(flat, 2), atol=1e-6)
    p = decompose.pca_local(flat, 2)
    got = [r[0] for r in df.orderBy("i").select(decompose.project_columns(F.col("m"), p)).collect()]
    assert got[40] == [] and all(np.allclose(g, x @ p) for g, x in zip(got, m))
    s = df.select("m", decompose.column_sample(F.col("m"), 3, 1).alias("s")).collect()
    assert all(len(r.s) == (3 if r.m else 0) and all(c in r.m for c in r.s) for r in s)
    v = decompose.columns_of(df, F.col("m"))
    assert np.allclose(decompose.zca_of(v, F.col("v"), 4, 0.1).matrix, decompose.zca(flat, 0.1).matrix)
    assert np.allclose(decompose.pca_approximate_of(v, F.col("v"), 4, 2), decompose.pca_approximate(flat, 2), atol=1e-2)
    pts = np.repeat(np.eye(4) * 100, 5, axis=0)
    far = spark.createDataFrame([(x.tolist(),) for x in pts], "v array<double>").repartition(3)
    seeds = decompose.kmeans_seeds(far, F.col("v"), 4, 4, 2)
    assert sorted(seeds.argmax(1).tolist()) == [0, 1, 2, 3]
    mix = decompose.mixture_of(far, F.col("v"), 4, 2, rounds=3, least_mass=1)
    assert mix.means.shape == (2, 4) and decompose.mixture_of(far, F.col("v"), 4, 2, "random", rounds=1, least_mass=1).weights.sum() > 0.99
    fv = df.select(decompose.fisher_vectors(F.col("m"), mix)).first()[0]
    assert np.allclose(fv, mix.fisher(m[0]).T.ravel())


def test_naive_bayes(spark):
    e = spark.createDataFrame([(0, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (2, "z", 5.0)], "row int, term string, value double")
    lab = spark.createDataFrame([(0, "x"), (1, "y")], "row int, class string")
    pi, theta = learn.naive_bayes_fit(e.where("row < 2"), lab)
    got = {(r["row"], r["class"]): r.score for r in learn.naive_bayes_scores(e, spark.createDataFrame([(2,), (3,)], "row int"), pi, theta).collect()}
    assert np.isclose(got[2, "x"], np.log(0.5) + np.log(3 / 4)) and np.isclose(got[2, "y"], np.log(0.5) + np.log(1 / 3)) and np.isclose(got[3, "x"], np.log(0.5))


def test_images(spark):
    img = np.arange(16.0).reshape(4, 4, 1)
    assert np.array_equal(images.unpack(**{"x_dim": 4, "y_dim": 4, "channels": 1, "data": images.pack(img)["data"]}), img)
    for layout in images.LAYOUTS:
        flat = np.transpose(np.arange(24.0).reshape(2, 3, 4), images.LAYOUTS[layout]).ravel()
        assert np.array_equal(images.from_layout(flat, 2, 3, 4, layout), np.arange(24.0).reshape(2, 3, 4))
    assert images.pool(img, 2, 2, how="max")[:, :, 0].tolist() == [[5, 7], [13, 15]]
    assert len(images.windows(img, 1, 2)) == 9 and images.windows(img, 2, 2)[1][0, 0, 0] == 2
    assert len(images.center_corner_patches(img, 2, 2, True)) == 10
    f = np.zeros((1, 4))
    f[0, 0] = 1
    assert np.array_equal(images.convolve(img, f, 2, normalize=False)[:, :, 0], img[:3, :3, 0])
    assert np.array_equal(images.conv2d(img, np.array([0.0, 1, 0]), np.array([0.0, 1, 0])), img)
    assert np.array_equal(images.random_patches(img, 3, 2, 2, 5)[1], images.random_patches(img, 3, 2, 2, 5)[1])
    df = spark.createDataFrame([(4, 4, 1, img.ravel().tolist())], "x_dim int, y_dim int, num_channels int, data array<double>").select(F.struct("*").alias("i"))
    both = df.select(images.rectify(F.col("i"), 0.0, 1.0).alias("r")).first().r
    assert both.num_channels == 2 and both.data[:4] == [0, 0, 0, 0] and both.data[-2:] == [14, 0]
    assert images.portable_pixmap(img).startswith(b"P6 4 4 255")
    big = np.random.default_rng(0).random((48, 48, 3))
    assert images.hog(big, 8).shape == (32, 16) and images.daisy(big).shape[0] == 200 and images.local_color_statistics(big, 6, 8, 3).shape[0] == 96 and images.dense_sift(big).shape[0] == 128


def test_descriptors_by_their_definition():
    rng = np.random.default_rng(5)
    img = rng.random((40, 44, 1))

    def blur(a, f, g):
        out, x, y = np.zeros_like(a), len(f), len(g)
        for i in range(a.shape[0]):
            for j in range(a.shape[1]):
                for p in range(x):
                    for q in range(y):
                        u, v = i + (x - 1 - (x - 1) // 2) - p, j + (y - 1 - (y - 1) // 2) - q
                        if 0 <= u < a.shape[0] and 0 <= v < a.shape[1]:
                            out[i, j] += a[u, v] * f[p] * g[q]
        return out

    small = rng.random((7, 6))
    for n in (2, 3, 4, 5):
        f, g = rng.random(n), rng.random(3)
        assert np.allclose(images.conv2d(small[:, :, None], f, g)[:, :, 0], blur(small, f, g))
    # DAISY of a keypoint: rings of layers, each blurred by what its variance has over the last one's.
    d, m = np.array([1.0, 0, -1]), np.array([1.0, 2, 1])
    gx, gy = (images.conv2d(img, *p)[:, :, 0] for p in ((d, m), (m, d)))
    got = images.daisy(img)
    assert got.shape == (200, 2 * 3)
    for key, (x, y) in enumerate([(i, j) for i in (16, 20) for j in (16, 20, 24)]):
        hist = {}
        for o in range(8):
            a = np.maximum(np.cos(2 * np.pi * o / 8) * gx + np.sin(2 * np.pi * o / 8) * gy, 0)[:, :, None]
            for ring in range(3):
                var = (7 * (ring + 1) / 6) ** 2 - (7 * ring / 6) ** 2
                n = int(np.ceil(np.sqrt(-2 * var * np.log(1e-6) - var * np.log(2 * np.pi * var))))
                f = np.array([np.exp(-k * k / (2 * var)) / np.sqrt(2 * np.pi * var) for k in range(-n, n + 1)])
                a = images.conv2d(a, f, f)
                hist[ring, o] = a[:, :, 0]
        want = [[hist[0, o][x, y] for o in range(8)]]
        for t in range(8):
            for ring in range(3):
                turn, far = 2 * np.pi * (t - 1) / 8, 7 * (ring + 1) / 3
                i, j = x + int(np.floor(far * np.sin(turn) + 0.5)), y + int(np.floor(far * np.cos(turn) + 0.5))
                want.append([hist[ring, o][i, j] for o in range(8)])
        want = np.concatenate([np.array(v) / np.linalg.norm(v) for v in want])
        assert np.allclose(got[:, key], want, atol=1e-5)
    # Whitened filters: on normalised, centred patches the answer is that of whitened patches on whitened filters.
    train = rng.normal(size=(50, 9))
    white = decompose.zca(train, 0.1)
    filters = [rng.random((3, 3, 1)) for _ in range(2)]
    packed = images.pack_filters(filters, white)
    out = images.convolve(img, packed, 3, white)
    p = images.normalize_rows(images.patches_of(img, 3), 10.0)
    want = white.of(p) @ white.of(np.stack([f.transpose(1, 0, 2).ravel() for f in filters])).T
    assert np.allclose(out.transpose(1, 0, 2).reshape(-1, 2), want)
    assert np.array_equal(images.pack_filters(filters, flipped=True)[0], images.pack_filters(filters)[0][::-1])
    # Pools by hand, sizes even and odd.
    for stride, size, how in ((3, 4, "sum"), (2, 5, "max"), (4, 4, "mean")):
        got = images.pool(img, stride, size, "square", how)
        h = size // 2
        for a, i in enumerate(range(h, 40, stride)):
            for b, j in enumerate(range(h, 44, stride)):
                part = img[max(i - h, 0) : i + h, max(j - h, 0) : j + h, 0].ravel() ** 2
                full = np.append(part, np.zeros(size * size - len(part)))
                assert np.isclose(got[a, b, 0], {"sum": full.sum(), "max": full.max(), "mean": full.mean()}[how])


def test_map_of_no_rows(spark):
    df = spark.createDataFrame([], "v array<double>")
    assert df.select(map_vectors(lambda m: m, F.col("v"))).collect() == []
