"""Degradations against plain matrices, the sampler with a model that knows, patches, letterboxes and similarity."""

import numpy as np
import pytest

from pageflow.operators import degradation as dg
from pageflow.operators import image_quality, restoration

RNG = np.random.default_rng(5)
KERNEL = np.array([0.2, 0.3, 0.3, 0.2])


def matrix(made):
    return made.apply(np.eye(made.size)).T


def bands(size, taps):
    """The matrix of a blur, written out place by place."""
    out = np.zeros((size, size))
    for i in range(size):
        for k, w in enumerate(taps):
            if 0 <= i + k - 2 < size:
                out[i, i + k - 2] = w
    return out


CASES = {
    "dense": (lambda: dg.Dense(RNG.normal(size=(5, 12))), None),
    "inpainting": (lambda: dg.Picked(4, 3, lost=[0, 1, 2, 9, 10, 11]), None),
    "stain": (lambda: dg.Picked(4, 3, lost=[3], weak=[6, 7, 8], strength=dg.STAIN), None),
    "denoising": (lambda: dg.Unchanged(48), np.eye(48)),
    "smaller": (lambda: dg.block_means(4, 2, 2), None),
    "grey": (lambda: dg.greyed(4), np.kron(np.array(dg.GREY), np.eye(16))),
    "sensing": (lambda: dg.HadamardSensing(4, 2, 4, RNG.permutation(16)), None),
    "blur": (lambda: dg.blurred(KERNEL, 6, 2), np.kron(np.eye(2), np.kron(bands(6, KERNEL), bands(6, KERNEL)))),
    "blur of two kernels": (lambda: dg.blurred(KERNEL, 6, 1, np.array([0.1, 0.4, 0.4, 0.1])), np.kron(bands(6, KERNEL), bands(6, [0.1, 0.4, 0.4, 0.1]))),
    "shrunk": (lambda: dg.shrunk(KERNEL, 8, 2, 2), None),
}


@pytest.mark.parametrize("name", list(CASES))
def test_degradation(name):
    make, want = CASES[name]
    made = make()
    m = matrix(made)
    if want is not None and name.startswith("blur"):
        assert np.abs(m - want).max() < dg.ZERO
    elif want is not None:
        assert np.allclose(m, want)
    x, y = RNG.normal(size=(3, made.size)), RNG.normal(size=(3, len(m)))
    assert np.allclose(made.unturn(made.turn(x)), x) and np.allclose(made.turn(made.unturn(x)), x)
    assert np.allclose(made.apply(x), x @ m.T)
    assert np.allclose(made.transposed(y[:, : len(m)]), y @ m)
    assert np.allclose(made.inverted(y), y @ np.linalg.pinv(m, 1e-9).T)
    assert np.allclose(np.sort(made.singulars)[::-1], np.linalg.svd(m, compute_uv=False)[: len(made.singulars)])


def test_block_means_and_places():
    x = RNG.normal(size=(1, 2 * 16))
    got = dg.block_means(4, 2, 2).apply(x)
    assert np.allclose(got, x.reshape(2, 2, 2, 2, 2).mean((2, 4)).reshape(1, -1))
    kept = dg.Picked(2, 3, lost=[0, 1, 2])
    image = np.arange(12.0).reshape(1, 12)
    assert 0 not in kept.apply(image) and 4 not in kept.apply(image) and 8 not in kept.apply(image)
    assert np.allclose(dg.walsh_hadamard(np.eye(4)) * 2, [[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])


@pytest.mark.parametrize("sigma", [0.0, 0.05])
def test_sampler_finds_what_the_model_knows(sigma):
    truth = RNG.normal(size=(2, 48))
    alphas = np.cumprod(1 - np.linspace(1e-4, 0.02, 1000))
    made = dg.Picked(4, 3, lost=range(12))
    model = lambda x, t: (x - np.sqrt(alphas[t]) * truth) / np.sqrt(1 - alphas[t])
    y = made.apply(truth)
    start = RNG.normal(size=truth.shape)
    again = [dg.sampled(model, made, y, start, alphas, list(range(0, 1000, 100)), sigma) for _ in range(2)]
    assert np.allclose(again[0], truth, atol=1e-6) and np.array_equal(*again)


def test_sampler_keeps_what_was_measured():
    """A model without knowledge: measured places come back as they are, the others don't."""
    truth = RNG.normal(size=(1, 48))
    alphas = np.cumprod(1 - np.linspace(1e-4, 0.02, 1000))
    made = dg.Picked(4, 3, lost=range(12))
    blind = lambda x, t: x * np.sqrt(1 - alphas[t])
    got = dg.sampled(blind, made, made.apply(truth), RNG.normal(size=truth.shape), alphas, list(range(0, 1000, 50)), 0.0)
    measured, lost = made.places[:36], made.places[36:]
    assert np.corrcoef(got[0, measured], truth[0, measured])[0, 1] > 0.99
    assert abs(np.corrcoef(got[0, lost], truth[0, lost])[0, 1]) < 0.9


def rows(spark, images):
    out = []
    for k, a in images.items():
        out += [(k, int(y), int(x), *map(int, a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    names = ["r", "g", "b", "m"][: next(iter(images.values())).shape[2]]
    return spark.createDataFrame(out, "image int, y int, x int, " + ", ".join(f"{n} int" for n in names))


def grid(df, k, names=("r", "g", "b")):
    got = [r for r in df.collect() if r["image"] == k]
    out = np.zeros((max(r["y"] for r in got) + 1, max(r["x"] for r in got) + 1, len(names)))
    for r in got:
        out[r["y"], r["x"]] = [r[n] for n in names]
    return out


def load_place():
    """Each pixel gets its place in the patch, so patches disagree and weights show."""

    def model(image, mask):
        y, x = np.mgrid[: image.shape[0], : image.shape[1]]
        return np.stack((y * 10.0, x * 10.0, mask * 100.0), 2)

    return model


def test_patches_are_blended_by_their_weights(spark):
    h, w, size, overlap = 7, 10, 4, 2
    image = RNG.integers(0, 256, (h, w, 4))
    image[..., 3] %= 2
    got = grid(restoration.restored_by_patches(rows(spark, {1: image}), "place", load_place, size, overlap), 1)
    total, weights = np.zeros((h, w, 3)), np.zeros((h, w, 1))

    def weight(n, before, after):
        sigma = max(min(overlap, before), min(overlap, after), 1) / 2
        e = np.array([np.exp(-0.5 * ((i - (n - 1) / 2) / sigma) ** 2) for i in range(n)])
        return e / e.max()

    for y in range(0, h, size - overlap):
        for x in range(0, w, size - overlap):
            ph, pw = min(size, h - y), min(size, w - x)
            mask = np.zeros((size, size))
            mask[:ph, :pw] = image[y : y + ph, x : x + pw, 3]
            out = load_place()(np.zeros((size, size, 3)), mask)[:ph, :pw]
            own = np.maximum(weight(ph, y, h - y - ph)[:, None] * weight(pw, x, w - x - pw)[None], 1e-6) * (1 + 0.25 * mask[:ph, :pw])
            total[y : y + ph, x : x + pw] += out * own[..., None]
            weights[y : y + ph, x : x + pw, 0] += own
    assert np.array_equal(got, np.floor(total / weights + 1e-9))


def test_letterbox_on_median(spark):
    flat = np.full((4, 8, 3), 50)
    flat[0, :, 0] = 90
    got = grid(restoration.letterboxed_on_median(rows(spark, {1: flat, 2: flat + 7}), 4, 8, 6), 1)
    assert got.shape == (6, 6, 3)
    assert (got[0] == 50).all() and (got[5] == 50).all()  # three lines of six in the middle, on the median
    assert (got[1, :, 0] > 50).all() and (got[..., 1:] == 50).all()


def test_cuts_beyond_the_image_and_empty_boxes(spark):
    image = rows(spark, {1: np.arange(4 * 4 * 3).reshape(4, 4, 3)})
    boxes = spark.createDataFrame([(1, 0, 3, 3, 9, 9), (1, 1, 2, 2, 2, 3), (2, 2, 0, 0, 2, 2)], "image int, idx int, x1 int, y1 int, x2 int, y2 int")
    got = restoration.cropped(image, boxes).collect()
    assert [(r["idx"], r["y"], r["x"]) for r in got] == [(0, 0, 0)]


def similarity(a, b, kernel, peak, spread=1.0):
    """Straight from the definition, at every place, edges repeat."""
    half = [n // 2 for n in kernel.shape]
    wide = [np.pad(x, [(h, h) for h in half], mode="edge") for x in (a, b)]
    out = np.zeros(a.shape)
    for at in np.ndindex(a.shape):
        p, q = (x[tuple(slice(i, i + n) for i, n in zip(at, kernel.shape))] for x in wide)
        mp, mq = (p * kernel).sum(), (q * kernel).sum()
        vp, vq, c = (spread * ((u * v * kernel).sum() - mu * mv) for u, v, mu, mv in ((p, p, mp, mp), (q, q, mq, mq), (p, q, mp, mq)))
        c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
        out[at] = (2 * mp * mq + c1) * (2 * c + c2) / ((mp**2 + mq**2 + c1) * (vp + vq + c2))
    return out


def test_kinds_of_similarity(spark):
    a = RNG.integers(0, 256, (14, 15, 3)).astype(float)
    b = np.clip(a + RNG.integers(-40, 40, a.shape), 0, 255)
    g = np.exp(-((np.arange(11) - 5) ** 2) / 4.5)
    g /= g.sum()
    flat = np.full((7, 7), 1 / 49)
    plane = g[:, None] * g
    want = {
        "volume": similarity(a, b, plane[..., None] * g, 255).mean(),
        "planes": np.mean([similarity(a[..., c], b[..., c], plane, 255)[5:-5, 5:-5].mean() for c in range(3)]),
        "library": np.mean([similarity(a[..., c], b[..., c], flat, 255, 49 / 48)[3:-3, 3:-3].mean() for c in range(3)]),
        "luma": similarity(*(x @ np.array([65.481, 128.553, 24.966]) / 255 + 16 for x in (a, b)), plane, 255).mean(),
    }
    for kind, value in want.items():
        assert image_quality.ssim_colour_of(a, b, kind) == pytest.approx(value, abs=1e-9)
    got = image_quality.ssim_colour(rows(spark, {1: a}), rows(spark, {1: b}), "planes", left=1, border=1).first()["ssim"]
    assert got == pytest.approx(image_quality.ssim_colour_of(a[1:-1, 1:-1], b[1:-1, 1:-1], "planes"))
    with pytest.raises(ValueError):
        image_quality.ssim_colour_of(a, b, "other")


def test_psnr_of_two_views_small_images_and_masks(spark):
    from pyspark.sql import functions as F

    a, b = RNG.integers(0, 256, (6, 7, 3)), RNG.integers(0, 256, (6, 7, 3))
    wide = lambda x: rows(spark, {1: x}).withColumns({"r2": F.col("b"), "g2": F.col("r"), "b2": F.col("r")})
    left, right = a - b, a[..., [2, 0, 0]] - b[..., [2, 0, 0]]
    db = lambda d: 20 * np.log10(255 / np.sqrt((d.astype(float) ** 2).mean()))
    got = image_quality.psnr_colour(wide(a), wide(b), halves=(("r", "g", "b"), ("r2", "g2", "b2"))).first()["psnr"]
    assert got == pytest.approx((db(left) + db(right)) / 2)
    small, other = rows(spark, {1: a % 2}), rows(spark, {1: b % 2})
    assert image_quality.psnr_colour(small, other).first()["psnr"] == pytest.approx(db(a % 2 - b % 2) - 20 * np.log10(255))
    m = RNG.integers(0, 256, (6, 7))
    masked = rows(spark, {1: np.dstack((a, m))})
    error = ((left * (m / 255)[..., None]) ** 2).sum() / (3 * (m / 255).sum())
    assert image_quality.psnr_colour(masked, rows(spark, {1: b}), masked=True).first()["psnr"] == pytest.approx(20 * np.log10(255 / np.sqrt(error)))
    assert image_quality.psnr_colour(masked.withColumn("m", F.lit(0)), rows(spark, {1: b}), masked=True).first()["psnr"] == float("inf")


def test_pages_through_a_square_and_red_text(spark):
    flat = np.full((4, 6, 3), 100)
    red = spark.createDataFrame([(1, 0, 0, 255), (1, 3, 5, 255)], "image int, y int, x int, m int")
    load = lambda: lambda planes: planes * 0.5
    got = grid(restoration.page_restored(rows(spark, {1: flat}), red, 4, 6, 8, "half", load), 1)
    want = np.full((4, 6, 3), 50)
    want[0, 0] = want[3, 5] = 100
    assert np.array_equal(got, want)
    assert (grid(restoration.page_restored(rows(spark, {1: flat}), None, 4, 6, 8, "half", load), 1) == 50).all()


def test_gram_and_perceptual_loss():
    a, b = RNG.normal(size=(3, 4, 5)), RNG.normal(size=(3, 4, 5))
    want = [[sum(a[i, y, x] * a[j, y, x] for y in range(4) for x in range(5)) / 60 for j in range(3)] for i in range(3)]
    assert np.allclose(image_quality.gram(a), want)
    seen, style = image_quality.perceptual_loss({"l": a}, {"l": b}, {"l": 2.0}, 0.5, 3.0)
    assert seen == pytest.approx(np.abs(a - b).mean()) and style == pytest.approx(6 * np.abs(image_quality.gram(a) - image_quality.gram(b)).mean())
    assert image_quality.perceptual_loss({"l": a}, {"l": a}, {"l": 1.0}, 0) == (None, None)


def test_unknown_metric_and_missing_source(spark, tmp_path):
    from pageflow.sources import sinks

    image = rows(spark, {1: np.zeros((2, 2, 3), int)})
    with pytest.raises(KeyError):
        image_quality.measured(image, image, {"other": {}})
    members = spark.createDataFrame([("a", "train"), ("b", "val")], "path string, split string")
    with pytest.raises(FileNotFoundError):
        sinks.materialise_split(members, str(tmp_path / "s"), sources=members.where("path = 'a'"))
    assert not (tmp_path / "s").exists()
