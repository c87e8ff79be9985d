"""Linear degradations of images by their singular value decompositions, and a diffusion sampler that inverts them.

A degradation takes vectors (rows: square images, channels first) to measurements. It is held as orthogonal turns of both
spaces and the singular values, so its transpose and pseudo-inverse come with it. All of it is numpy, for models that run on
batches of patches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# The singular value of a stained place, of a place that is kept or filled in part, the row that mixes
# colours to grey, and the singular value of a one-dimensional blur below which it counts as zero.
STAIN, PARTIAL, GREY, ZERO = 0.998, 0.8, (0.3333, 0.3334, 0.3333), 3e-2


class Degradation:
    """``singulars`` belong to the first places of the turned vectors; what comes after them is lost."""

    singulars: np.ndarray

    def turn(self, x: np.ndarray) -> np.ndarray:
        """Images in the basis of the right singular vectors."""
        raise NotImplementedError

    def unturn(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def turn_measured(self, y: np.ndarray) -> np.ndarray:
        """Measurements in the basis of the left singular vectors."""
        return y

    def unturn_measured(self, y: np.ndarray) -> np.ndarray:
        return y

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.unturn_measured(self.singulars * self.turn(x)[:, : len(self.singulars)])

    def _back(self, y: np.ndarray, factor: np.ndarray, size: int) -> np.ndarray:
        full = np.zeros((len(y), size))
        full[:, : len(factor)] = self.turn_measured(y)[:, : len(factor)] * factor
        return self.unturn(full)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        return self._back(y, self.singulars, self.size)

    def inverted(self, y: np.ndarray) -> np.ndarray:
        """The pseudo-inverse: 0 wherever the singular value is."""
        s = self.singulars
        return self._back(y, np.divide(1.0, s, out=np.zeros_like(s), where=s != 0), self.size)


class Dense(Degradation):
    """Any matrix."""

    def __init__(self, matrix: np.ndarray):
        self.u, self.singulars, self.vt = np.linalg.svd(matrix, full_matrices=True)
        self.size = matrix.shape[1]

    def turn(self, x):
        return x @ self.vt.T

    def unturn(self, x):
        return x @ self.vt

    def turn_measured(self, y):
        return y @ self.u

    def unturn_measured(self, y):
        full = np.zeros((len(y), len(self.u)))
        full[:, : y.shape[1]] = y
        return full @ self.u.T


class Picked(Degradation):
    """Places are kept, weakened or lost. Places count pixel by pixel, a pixel's channels together. Without ``weak`` this is
    inpainting; ``strength`` is STAIN or PARTIAL. Measurements are in the order of ``places``."""

    def __init__(self, side: int, channels: int, lost=(), weak=(), strength: float = PARTIAL):
        self.size = channels * side * side
        lost, weak = np.unique(np.asarray(lost, np.int64)), np.asarray(weak, np.int64)
        weak = np.setdiff1d(weak, lost)
        kept = np.setdiff1d(np.arange(self.size), np.concatenate((lost, weak)))
        order = np.concatenate((kept, weak, lost))
        self.places = order % channels * side * side + order // channels  # where they are with channels first
        self.singulars = np.concatenate((np.ones(len(kept)), np.full(len(weak), strength)))

    def turn(self, x):
        return x[:, self.places]

    def unturn(self, x):
        out = np.empty_like(x)
        out[:, self.places] = x
        return out


class Unchanged(Degradation):
    """Images as they are, but for noise."""

    def __init__(self, size: int):
        self.size, self.singulars = size, np.ones(size)

    def turn(self, x):
        return x

    unturn = turn


class Rows(Degradation):
    """One row vector for each group of places: the mean of square blocks, or the mix of a pixel's colours."""

    def __init__(self, groups: np.ndarray, row: np.ndarray):
        """``groups``: for each measurement, its places."""
        self.groups, self.size = groups, groups.size
        u, s, self.vt = np.linalg.svd(np.asarray(row, float).reshape(1, -1), full_matrices=True)
        self.sign = u[0, 0]
        self.singulars = np.full(len(groups), s[0])

    def turn(self, x):
        return (x[:, self.groups] @ self.vt.T).transpose(0, 2, 1).reshape(len(x), -1)

    def unturn(self, x):
        out = np.empty((len(x), self.size))
        out[:, self.groups] = x.reshape(len(x), -1, len(self.groups)).transpose(0, 2, 1) @ self.vt
        return out

    def turn_measured(self, y):
        return y * self.sign

    unturn_measured = turn_measured


def block_means(side: int, channels: int, ratio: int) -> Rows:
    """Images shrunk by a whole ratio."""
    at = np.arange(channels * side * side).reshape(channels, side // ratio, ratio, side // ratio, ratio)
    return Rows(at.transpose(0, 1, 3, 2, 4).reshape(-1, ratio * ratio), np.full(ratio * ratio, 1 / ratio**2))


def greyed(side: int) -> Rows:
    return Rows(np.arange(3 * side * side).reshape(3, -1).T, np.array(GREY))


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal and its own inverse; along the last axis, whose length is a power of two."""
    n, width = x.shape[-1], 1
    out = x.astype(float)
    while width < n:
        pair = out.reshape(*x.shape[:-1], n // (2 * width), 2, width)
        out = np.stack((pair[..., 0, :] + pair[..., 1, :], pair[..., 0, :] - pair[..., 1, :]), -2).reshape(x.shape)
        width *= 2
    return out / np.sqrt(n)


class HadamardSensing(Degradation):
    """The first 1/ratio of the permuted Walsh-Hadamard coefficients of each channel."""

    def __init__(self, side: int, channels: int, ratio: int, order: np.ndarray):
        self.size, self.channels, self.order = channels * side * side, channels, order
        self.singulars = np.ones(self.size // ratio)

    def turn(self, x):
        return walsh_hadamard(x.reshape(len(x), self.channels, -1))[:, :, self.order].transpose(0, 2, 1).reshape(len(x), -1)

    def unturn(self, x):
        out = np.empty((len(x), self.channels, self.size // self.channels))
        out[:, :, self.order] = x.reshape(len(x), -1, self.channels).transpose(0, 2, 1)
        return walsh_hadamard(out).reshape(len(x), -1)


class Separable(Degradation):
    """A matrix along columns and one along rows of each channel. Singular values fall; those of a factor below ``zero`` are 0."""

    def __init__(self, down: np.ndarray, across: np.ndarray, channels: int, zero: float = ZERO):
        (self.u1, s1, self.v1), (self.u2, s2, self.v2) = (np.linalg.svd(m, full_matrices=True) for m in (down, across))
        s1, s2 = np.where(s1 < zero, 0, s1), np.where(s2 < zero, 0, s2)
        self.shape, self.out, self.channels = (down.shape[1], across.shape[1]), (down.shape[0], across.shape[0]), channels
        self.size = channels * self.shape[0] * self.shape[1]
        grid = np.outer(s1, s2)
        first = np.argsort(-grid, axis=None, kind="stable")
        i, j = np.unravel_index(first, grid.shape)
        inside = np.zeros(self.shape, bool)
        inside[: len(s1), : len(s2)] = True
        self.order = np.concatenate((i * self.shape[1] + j, np.flatnonzero(~inside)))
        self.order_out = i * self.out[1] + j
        self.singulars = np.repeat(grid.ravel()[first], channels)

    def _ordered(self, z, order):
        return z.reshape(len(z), self.channels, -1)[:, :, order].transpose(0, 2, 1).reshape(len(z), -1)

    def _placed(self, x, order, shape):
        out = np.empty((len(x), self.channels, shape[0] * shape[1]))
        out[:, :, order] = x.reshape(len(x), -1, self.channels).transpose(0, 2, 1)
        return out.reshape(len(x), self.channels, *shape)

    def turn(self, x):
        return self._ordered(self.v1 @ x.reshape(len(x), self.channels, *self.shape) @ self.v2.T, self.order)

    def unturn(self, x):
        return (self.v1.T @ self._placed(x, self.order, self.shape) @ self.v2).reshape(len(x), -1)

    def turn_measured(self, y):
        return self._ordered(self.u1.T @ y.reshape(len(y), self.channels, *self.out) @ self.u2, self.order_out)

    def unturn_measured(self, y):
        return (self.u1 @ self._placed(y, self.order_out, self.out) @ self.u2.T).reshape(len(y), -1)


def kernel_matrix(kernel: np.ndarray, size: int, stride: int = 1, mirror: bool = False) -> np.ndarray:
    """A one-dimensional convolution. Taps go from half the kernel before a place to one less than half after it, so the
    last tap of an odd kernel has no part; beyond the edges there is nothing, or the mirrored line."""
    half = len(kernel) // 2
    out = np.zeros((size // stride, size))
    for row in range(size // stride):
        for tap in range(2 * half):
            at = row * stride + stride // 2 + tap - half
            if mirror:
                at = -at - 1 if at < 0 else 2 * size - 1 - at if at >= size else at
            if 0 <= at < size:
                out[row, at] += kernel[tap]
    return out


def blurred(kernel: np.ndarray, side: int, channels: int, across: np.ndarray | None = None) -> Separable:
    """Blur by a kernel, or by one for columns and one for rows."""
    return Separable(kernel_matrix(kernel, side), kernel_matrix(kernel if across is None else across, side), channels)


def shrunk(kernel: np.ndarray, side: int, channels: int, stride: int) -> Separable:
    """Blur and keep every ``stride``-th place."""
    one = kernel_matrix(kernel, side, stride, mirror=True)
    return Separable(one, one, channels)


def sampled(model: Callable[[np.ndarray, int], np.ndarray], made: Degradation, y: np.ndarray, start: np.ndarray, alphas: np.ndarray, steps: list[int], sigma: float, eta: float = 0.85, eta_noisy: float = 1.0, seed: int = 0, mask: np.ndarray | None = None, mask_until: int = 0) -> np.ndarray:
    """Denoising diffusion restoration: images (n, places) that look like the model's and give ``y`` (noise ``sigma``).

    ``model`` tells the noise of images at a step; ``alphas`` are the running products of 1 - beta; ``steps`` rise. In the
    turned basis a place is drawn towards the measurement where that is less noisy than the step (``eta_noisy``), by part
    of the step's noise where it is noisier, and freely where nothing was measured. With a mask (0: text), its places are
    blanked down to step ``mask_until``."""
    draw = np.random.default_rng(seed)
    level = lambda t: float(np.sqrt((1 - a) / a)) if (a := alphas[t] if t >= 0 else 1.0) else np.inf
    s, k = made.singulars, len(made.singulars)
    measured = made.turn_measured(y)[:, :k]
    clean = np.divide(measured, s, out=np.zeros_like(measured), where=s != 0)
    relative = np.divide(sigma, s, out=np.full(k, np.inf), where=s != 0)  # the measurement's own noise at each place
    top = level(steps[-1])
    x, spread = np.zeros_like(start), np.full(start.shape[1], top)
    known = np.flatnonzero(relative < top)
    x[:, known] = clean[:, known]
    spread[known] = np.sqrt(top**2 - relative[known] ** 2)
    x = made.unturn((x + spread * start) / top)
    for t, after in zip(reversed(steps), [*reversed(steps[:-1]), -1], strict=True):
        if mask is not None and t >= mask_until:
            x = x * mask
        a = alphas[t]
        noise = model(x, t)
        guess = (x - noise * np.sqrt(1 - a)) / np.sqrt(a)
        now, turned, step = level(after), made.turn(guess), level(after) * eta
        rest = np.sqrt(max(now**2 - step**2, 0.0))
        out = turned + rest * made.turn(noise) + step * draw.standard_normal(turned.shape)
        noisier, better = np.flatnonzero(relative > now), np.flatnonzero(relative < now)
        noisier = noisier[s[noisier] != 0]
        if sigma > 0 and len(noisier):
            gap = (measured - s * turned[:, :k]) / sigma
            out[:, noisier] = turned[:, noisier] + rest * gap[:, noisier] + step * draw.standard_normal((len(x), len(noisier)))
        own = np.sqrt(np.clip(now**2 - (relative[better] * eta_noisy) ** 2, 0, None))
        out[:, better] = clean[:, better] * eta_noisy + (1 - eta_noisy) * turned[:, better] + own * draw.standard_normal((len(x), len(better)))
        x = (np.sqrt(alphas[after]) if after >= 0 else 1.0) * made.unturn(out)
    return x
