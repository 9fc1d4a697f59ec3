"""Pixel kernels in numpy, for whole batches of patches at once.

A patch is a two-dimensional uint8 array. What a kernel needs of its
neighbourhood is taken by shifted views; nothing loops over pixels. The
registry at the end names the kernels; those marked ``stego`` compare a patch
with its embedded version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def pad(x: np.ndarray, n: int) -> np.ndarray:
    """Mirrored borders without repeating the edge."""
    return np.pad(x, n, mode="reflect")


def correlate(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    n = kernel.shape[0] // 2
    views = np.lib.stride_tricks.sliding_window_view(pad(x, n), kernel.shape)
    return np.einsum("ijkl,kl->ij", views, kernel)


def entropy(g: np.ndarray) -> float:
    p = np.bincount(g.ravel(), minlength=256) / g.size
    p = p[p > 0]
    return float(max(0.0, -(p * np.log2(p)).sum()))


def variance(g: np.ndarray) -> float:
    return float(np.var(g / 255.0))


#: The second derivative for aperture 1, and the diagonal form for 3 (fixed values).
LAPLACE = {1: np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]]), 3: np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]])}


def laplacian_variance(g: np.ndarray, aperture: int = 3) -> float:
    x = g.astype(np.float32) / np.float32(255)
    return float(np.var(correlate(x, LAPLACE[aperture].astype(np.float32)).astype(np.float64)))


def edges(g: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Canny edges: Sobel gradients, thinning along the gradient, two thresholds joined by hysteresis."""
    x = np.pad(g.astype(np.int32), 1, mode="edge")
    dx = (x[:-2, 2:] + 2 * x[1:-1, 2:] + x[2:, 2:]) - (x[:-2, :-2] + 2 * x[1:-1, :-2] + x[2:, :-2])
    dy = (x[2:, :-2] + 2 * x[2:, 1:-1] + x[2:, 2:]) - (x[:-2, :-2] + 2 * x[:-2, 1:-1] + x[:-2, 2:])
    size = np.hypot(dx, dy)
    around = np.pad(size, 1)
    at = lambda i, j: around[1 + i : 1 + i + g.shape[0], 1 + j : 1 + j + g.shape[1]]
    ax, ay = np.abs(dx), np.abs(dy)
    flat, steep = ay < ax * np.tan(np.pi / 8), ay > ax * np.tan(3 * np.pi / 8)
    same = (dx * dy) >= 0
    ahead = np.select([flat, steep, same], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    back = np.select([flat, steep, same], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    ridge = (size > back) & (size >= ahead)
    weak, strong = ridge & (size > low), ridge & (size > high)
    while True:
        grown = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for i in range(3):
            for j in range(3):
                near |= grown[i : i + g.shape[0], j : j + g.shape[1]]
        more = near & weak | strong
        if (more == strong).all():
            return strong
        strong = more


def edge_density(g: np.ndarray, low: float = 100, high: float = 200) -> float:
    return float(edges(g, low, high).mean())


def lbp_codes(g: np.ndarray, points: int = 8, radius: int = 1) -> np.ndarray:
    """Uniform local binary patterns of the pixels whose circle lies inside.

    The code is the number of neighbours at least as bright if the circle has
    two changes at most, else ``points`` + 1. Neighbours off the lattice are
    interpolated.
    """
    n = int(np.ceil(radius))
    h, w = g.shape
    if h <= 2 * n or w <= 2 * n:
        raise ValueError("the patch is too small for this radius")
    x, core = g.astype(np.float64), g[n : h - n, n : w - n]
    bits = []
    for k in range(points):
        angle = 2 * np.pi * k / points
        dy, dx = np.round(-radius * np.sin(angle), 5), np.round(radius * np.cos(angle), 5)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y0, dx - x0
        value = np.zeros(core.shape)
        for i, wy in ((0, 1 - fy), (1, fy)):
            for j, wx in ((0, 1 - fx), (1, fx)):
                if wy * wx:
                    value += wy * wx * x[n + y0 + i : h - n + y0 + i, n + x0 + j : w - n + x0 + j]
        bits.append(value >= core - 1e-9)
    b = np.stack(bits)
    changes = (b != np.roll(b, 1, axis=0)).sum(axis=0)
    return np.where(changes <= 2, b.sum(axis=0), points + 1)


def lbp_entropy(g: np.ndarray, points: int = 8, radius: int = 1) -> float:
    """Entropy of the codes as a share of the most that their number allows."""
    codes = lbp_codes(g, points, radius)
    p = np.bincount(codes.ravel(), minlength=points + 2) / codes.size
    p = p[p > 0]
    return float(np.clip(-(p * np.log2(p)).sum() / np.log2(points + 2), 0, 1))


def lbp_non_uniform_ratio(g: np.ndarray, points: int = 8, radius: int = 1) -> float:
    return float((lbp_codes(g, points, radius) == points + 1).mean())


@dataclass(frozen=True)
class Embedded:
    stego: np.ndarray
    selected: int
    changed: int

    @property
    def changed_fraction(self) -> float:
        return self.changed / self.stego.size


def embed(g: np.ndarray, rate: float, seed: int) -> Embedded:
    """Random bits in the lowest bits of a seeded choice of pixels.

    The generator's draws, in this order, are part of the contract: positions
    without replacement, then one bit for each.
    """
    if not 0 <= rate <= 1:
        raise ValueError("the payload rate lies between zero and one")
    n = int(round(rate * g.size))
    stego = g.copy().reshape(-1)
    if not n:
        return Embedded(stego.reshape(g.shape), 0, 0)
    rng = np.random.default_rng(seed)
    where = rng.choice(g.size, size=n, replace=False)
    bits = rng.integers(0, 2, size=n, dtype=np.uint8)
    before = stego[where]
    stego[where] = before & np.uint8(254) | bits
    return Embedded(stego.reshape(g.shape), n, int((before != stego[where]).sum()))


def mse(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean((a.astype(np.float64) - b) ** 2))


def psnr(a: np.ndarray, b: np.ndarray, most: float = 100.0) -> float:
    e = mse(a, b)
    return most if e == 0 else float(min(10 * np.log10(255.0**2 / e), most))


#: Constants of the similarity index for 8-bit data (fixed values).
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def ssim_window(shape: tuple[int, ...]) -> int:
    n = min(7, *shape)
    n -= n % 2 == 0
    if n < 3:
        raise ValueError("the patch is too small for structural similarity")
    return n


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity with a flat window and sample covariances, borders left out."""
    n = ssim_window(a.shape)
    views = [np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), (n, n)) for x in (a, b)]
    ma, mb = (v.mean(axis=(2, 3)) for v in views)
    scale = n * n / (n * n - 1)
    va, vb = (scale * ((v**2).mean(axis=(2, 3)) - m**2) for v, m in zip(views, (ma, mb), strict=True))
    cov = scale * ((views[0] * views[1]).mean(axis=(2, 3)) - ma * mb)
    out = (2 * ma * mb + C1) * (2 * cov + C2) / ((ma**2 + mb**2 + C1) * (va + vb + C2))
    return float(out.mean())


def _bell(n: int, sigma: float) -> np.ndarray:
    x = np.exp(-((np.arange(n) - n // 2) ** 2) / (2 * sigma**2))
    return np.outer(x, x) / x.sum() ** 2


def ssim_parts(a: np.ndarray, b: np.ndarray, n: int = 11, sigma: float = 1.5) -> tuple[float, float]:
    """(mean luminance, mean contrast-structure) with a Gaussian window."""
    k = _bell(n, sigma)
    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb, aa, bb, ab = (correlate(x, k) for x in (a, b, a * a, b * b, a * b))
    va, vb = np.maximum(aa - ma * ma, 0), np.maximum(bb - mb * mb, 0)
    light = (2 * ma * mb + C1) / (ma * ma + mb * mb + C1)
    form = (2 * (ab - ma * mb) + C2) / (va + vb + C2)
    e = n // 2
    if min(a.shape) > 2 * e:
        light, form = light[e:-e, e:-e], form[e:-e, e:-e]
    return float(light.mean()), float(form.mean())


#: Fixed values of the configuration: the weight of each scale, finest first, and the window's side.
MS_WEIGHTS, MS_WINDOW = (0.10, 0.30, 0.60), 11


def ms_ssim(
    a: np.ndarray, b: np.ndarray, weights: tuple[float, ...] = MS_WEIGHTS, n: int = MS_WINDOW, sigma: float = 1.5
) -> float:
    """Similarity over scales: contrast-structure at each, luminance at the last."""
    w = np.array(weights) / sum(weights)
    out = 1.0
    a, b = a.astype(np.float64), b.astype(np.float64)
    for k, x in enumerate(w):
        if min(a.shape) < 8:
            raise ValueError("the patch is too small for so many scales")
        side = min(n, *a.shape)
        light, form = ssim_parts(a, b, side - (side % 2 == 0), sigma)
        out *= max(form, 1e-12) ** x
        if k == len(w) - 1:
            out *= max(light, 1e-12) ** x
        else:
            h, v = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
            a, b = (y[:h, :v].reshape(h // 2, 2, v // 2, 2).mean(axis=(1, 3)) for y in (a, b))
    return float(np.clip(out, 0, 1))


@dataclass(frozen=True)
class Measure:
    name: str
    run: Callable
    stego: bool = False


MEASURES = {
    m.name: m
    for m in (
        Measure("entropy", entropy),
        Measure("variance", variance),
        Measure("edge_density", edge_density),
        Measure("lbp_non_uniform_ratio", lbp_non_uniform_ratio),
        Measure("lbp_entropy", lbp_entropy),
        Measure("laplacian_variance", laplacian_variance),
        Measure("mse", mse, True),
        Measure("psnr", psnr, True),
        Measure("ssim", ssim, True),
        Measure("ms_ssim", ms_ssim, True),
    )
}


def measured(g: np.ndarray, names: tuple[str, ...], rate: float = 0.4, seed: int = 0) -> list[float]:
    """The named measures of a patch; the embedded version is made once, if one needs it."""
    unknown = [n for n in names if n not in MEASURES]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    if g.dtype != np.uint8 or g.ndim != 2 or min(g.shape) < 8:
        raise ValueError("a patch has unsigned bytes, two dimensions and 8 pixels a side at least")
    stego = embed(g, rate, seed).stego if any(MEASURES[n].stego for n in names) else None
    out = [MEASURES[n].run(g, stego) if MEASURES[n].stego else MEASURES[n].run(g) for n in names]
    if not np.isfinite(out).all():
        raise ValueError("a feature is not finite")
    return out


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of BGR bytes (height, width, 3); two dimensions pass through."""
    if pixels.ndim == 2:
        return pixels
    b, g, r = (pixels[..., k].astype(np.int64) for k in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14).astype(np.uint8)
