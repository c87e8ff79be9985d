"""Ratios, logits, colour and schedules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is not positive."""
    return F.when(whole > 0, part / F.nullif(whole, whole * 0)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_logit(a: Column, b: Column, scale: float = 16.0) -> Column:
    return F.lit(scale) * dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def margin_logit(cosine: Column, margin: float = 0.3, scale: float = 16.0) -> Column:
    """For the true class in training: the angle is widened by the margin."""
    inside = F.least(F.greatest(cosine, F.lit(-1 + 1e-7)), F.lit(1 - 1e-7))
    return F.lit(scale) * F.cos(F.acos(inside) + F.lit(margin))


def let(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``. The variable is computed once; written out, ``value`` would be computed
    anew for every element of a lambda that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_softmax(scores: Column) -> Column:
    """Of an array of scores, shifted by the largest."""

    def shifted(s: Column, top: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return let(top + F.log(total), lambda off: F.transform(s, lambda x: x - off))

    return let(scores, lambda s: let(F.array_max(s), lambda top: shifted(s, top)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def gamma(v: Column, g: float = 1.5) -> Column:
    return F.floor(F.pow(v / 255.0, F.lit(1 / g)) * 255.0).cast("int")


# The studio-swing transform of ITU-R BT.601, for colours of 0 to 255.
Y_ROW, _CB, _CR = (65.481, 128.553, 24.966), (-37.797, -74.203, 112.0), (112.0, -93.786, -18.214)


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    row = lambda k, off: (k[0] * r + k[1] * g + k[2] * b) / 255.0 + off
    return row(Y_ROW, 16.0), row(_CB, 128.0), row(_CR, 128.0)


# The way back, for colours of 0 to 255.
_BACK = {"r": (0.00456621, 0.0, 0.00625893, -222.921), "g": (0.00456621, -0.00153632, -0.00318811, 135.576), "b": (0.00456621, 0.00791071, 0.0, -276.836)}


def rgb_of_ycbcr(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return tuple((k[0] * y + k[1] * cb + k[2] * cr) * 255.0 + k[3] for k in _BACK.values())


def as_byte(v: Column) -> Column:
    """Rounded half to even, from 0 to 255."""
    return F.least(F.greatest(F.bround(v), F.lit(0.0)), F.lit(255.0)).cast("int")


def reduced(loss: Column, weight: Column | None = None, how: str = "mean") -> Column:
    """A loss of all elements: itself, its sum, or its mean; with weights, the mean is over the weights."""
    own = loss if weight is None else loss * weight
    if how == "none":
        return own
    if how == "sum":
        return F.sum(own)
    if how != "mean":
        raise ValueError(f"not a reduction: {how}")
    return F.avg(own) if weight is None else F.try_divide(F.sum(own).cast("double"), F.sum(weight).cast("double"))


def quantise(x: Column, low: float, high: float, levels: int) -> Column:
    clipped = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.least(F.floor(levels * (clipped - low) / (high - low)), F.lit(levels - 1)).cast("int")


def dequantise(q: Column, low: float, high: float, levels: int) -> Column:
    return (q + 0.5) * (high - low) / levels + low


def cubic(x: Column) -> Column:
    """Bicubic kernel with a = -0.5."""
    d = F.abs(x)
    return F.when(d <= 1, 1.5 * d * d * d - 2.5 * d * d + 1).when(d <= 2, -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2).otherwise(F.lit(0.0))


def feather(x: Column, size: int, overlap: int) -> Column:
    """Gaussian weight of a patch along one axis, highest in its centre."""
    sigma = max(overlap, 1) / 2
    return F.exp(-0.5 * F.pow((x - (size - 1) / 2) / sigma, F.lit(2.0)))


def cosine_ramp(x: Column, width: int) -> Column:
    return 0.5 - 0.5 * F.cos(F.lit(math.pi) * x / width)


def text_boost(weight: Column, mask: Column, gain: float = 0.25) -> Column:
    return weight * (1 + gain * mask)


def linear_betas(first: float, last: float, steps: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: F.lit(first) + (last - first) * t / max(steps - 1, 1))


def cumulative_alphas(betas: Column) -> Column:
    """Running products of 1 - beta."""
    return F.transform(F.sequence(F.lit(1), F.size(betas)), lambda k: F.aggregate(F.slice(betas, F.lit(1), k), F.lit(1.0), lambda p, b: p * (1 - b)))


def q_sample(x: Column, noise: Column, alpha: Column) -> Column:
    return F.sqrt(alpha) * x + F.sqrt(1 - alpha) * noise


def multistep_rate(step: Column, base: float, milestones: list[int], factor: float = 0.1) -> Column:
    passed = sum(((step >= m).cast("int") for m in milestones), F.lit(0))
    return base * F.pow(F.lit(factor), passed)


def linear_rate(step: Column, base: float, total: int) -> Column:
    return base * (1 - step / total)


def cosine_restart_rate(step: Column, base: float, periods: list[int], weights: list[float], floor: float) -> Column:
    """Cosine decay anew in every period; the period is the first whose end the step doesn't pass."""
    out, end = None, sum(periods)
    for p, w in reversed(list(zip(periods, weights, strict=True))):
        start = end - p
        rate = F.lit(floor) + w * 0.5 * (base - floor) * (1 + F.cos(F.lit(math.pi) * (step - start) / p))
        out = rate if out is None else F.when(step <= end, rate).otherwise(out)
        end = start
    return out


def warmup_cosine_rate(step: Column, base: float, warmup: int, total: int, floor: float = 0.0) -> Column:
    decay = floor + 0.5 * (base - floor) * (1 + F.cos(F.lit(math.pi) * (step - warmup) / max(total - warmup, 1)))
    return F.when(step < warmup, base * (step + 1) / max(warmup, 1)).otherwise(decay)


def charbonnier(d: Column, eps: float = 1e-3) -> Column:
    return F.sqrt(d * d + eps * eps)


def edge_colour(greedy_ok: Column, final_ok: Column) -> Column:
    """How an annotation is drawn: a mended, spoilt, wrong or right character."""
    return F.when(~greedy_ok & final_ok, "green").when(greedy_ok & ~final_ok, "red").when(~greedy_ok & ~final_ok, "yellow").otherwise("grey")


def multistep_restart_rate(step: Column, base: float, milestones: list[int], factor: float, restarts: list[int], weights: list[float]) -> Column:
    """A restart sets the rate to its weight times the base; a milestone after it (both are absolute steps) multiplies it
    by the factor, once for each time it is listed."""
    if len(restarts) != len(weights):
        raise ValueError("a weight for each restart")
    out = F.lit(None).cast("double")
    for start, weight in sorted({0: 1.0, **dict(zip(restarts, weights, strict=True))}.items()):
        later = [m for m in milestones if m > start or (m == start and start not in restarts)]
        out = F.when(step >= start, weight * multistep_rate(step, base, later, factor)).otherwise(out)
    return out


def vibrate_rate(step: Column, base: float, total: int) -> Column:
    """A triangle of 80 periods under an envelope that falls to 0 over three eighths of the steps, stands at 0.2 for two
    eighths and at 0.1 from there on; in the first half period the rate is a tenth of the base at least."""
    period = total // 80
    half = period // 2
    if half < 1:
        raise ValueError("at least 160 steps")
    done = step / total
    envelope = F.when(done < 3 / 8, 1 - done * 8 / 3).when(done < 5 / 8, 0.2).otherwise(0.1)
    at = F.pmod(step, F.lit(period))
    rate = envelope * F.when(at < half, at / half).otherwise(2 - at / half)
    return base * F.when(step < half, F.greatest(rate, F.lit(0.1))).otherwise(rate)


def quantised_flow(d: Column, size: Column, max_value: float = 0.02, levels: int = 255) -> Column:
    """A flow component relative to the image's size, in levels."""
    return quantise(d / size, -max_value, max_value, levels)


def dequantised_flow(q: Column, size: Column, max_value: float = 0.02, levels: int = 255) -> Column:
    return dequantise(q, -max_value, max_value, levels) * size


def soft_mask(score: Column) -> Column:
    """A network's output as a mask of 0 to 255, truncated."""
    return F.floor(255.0 / (1 + F.exp(-score))).cast("int")


def weighted_loss(loss):
    """Gives an elementwise loss of (prediction, target) a ``weight`` and a reduction ``how``, as :func:`reduced` has them."""
    import functools

    @functools.wraps(loss)
    def run(pred: Column, target: Column, weight: Column | None = None, how: str = "mean", **settings) -> Column:
        return reduced(loss(pred, target, **settings), weight, how)

    return run


@weighted_loss
def absolute_loss(pred: Column, target: Column) -> Column:
    return F.abs(pred - target)


@weighted_loss
def squared_loss(pred: Column, target: Column) -> Column:
    return (pred - target) * (pred - target)


@weighted_loss
def charbonnier_loss(pred: Column, target: Column, eps: float = 1e-12) -> Column:
    """The root's offset is ``eps`` itself here, not its square."""
    return F.sqrt((pred - target) * (pred - target) + eps)
