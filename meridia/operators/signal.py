"""Whole-signal transforms in numpy: spectra, wavelets, mode decomposition, analytic signals, images.

Array kernels only; meridia.plans applies them per channel or run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import lru_cache
from math import isfinite

import numpy as np
import pandas as pd

FS, F_MIN, F_MAX, SCALES, OMEGA = 1.25, 0.010, 0.250, 224, 6.0
#: Signals up to this length are transformed by one matrix product (15 MB of matrices at 224 scales), longer ones by FFT.
DIRECT = 64
#: Values that a block of wavelet power holds: 8 MB.
CWT_VALUES = 1 << 20
#: Digits enough for any double.
_EXACT = Context(prec=400)


def cwt_grid(n: int = SCALES) -> np.ndarray:
    """Frequencies of the scales, log-spaced from F_MAX down to F_MIN."""
    return F_MAX * (F_MIN / F_MAX) ** (np.arange(n) / (n - 1))


def psd(x: np.ndarray) -> np.ndarray:
    """One-sided power |FFT|^2 / n of rows."""
    return np.abs(np.fft.rfft(x, axis=-1)) ** 2 / x.shape[-1]


def cwt_power(x: np.ndarray, freqs: np.ndarray, fs: float = FS) -> np.ndarray:
    """(rows, scales, time) squared magnitude of the Morlet transform, zero boundary.

    The kernel at scale s is pi^-1/4 s^-1/2 exp(i OMEGA u) exp(-u^2 / 2), u = t / s in samples,
    cut at |u| <= 4; frequencies map to scales by s = OMEGA fs / (2 pi f).
    """
    n = x.shape[-1]
    if n <= DIRECT:
        re, im = _morlet_matrices(n, np.asarray(freqs, float).tobytes(), fs)
        out, other = x @ re, x @ im
        out *= out
        other *= other
        out += other
        return out.reshape(*x.shape[:-1], len(freqs), n)
    out = np.empty((*x.shape[:-1], len(freqs), n))
    for k, f in enumerate(freqs):
        kernel, half = _morlet(n, f, fs)
        size = 1 << int(n + 2 * half).bit_length()
        full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(kernel, size))
        out[..., k, :] = np.abs(full[..., half : half + n]) ** 2
    return out


def _morlet(n: int, f: float, fs: float) -> tuple[np.ndarray, int]:
    """The kernel at frequency f for n samples, and the index of its middle."""
    s = OMEGA * fs / (2 * np.pi * f)
    half = int(min(np.floor(4 * s), n - 1))
    u = np.arange(-half, half + 1) / s
    return np.pi**-0.25 / np.sqrt(s) * np.exp(1j * OMEGA * u - u * u / 2), half


@lru_cache(4)
def _morlet_matrices(n: int, freqs: bytes, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(n, scales * n) real and imaginary part of the transform of n samples."""
    freqs = np.frombuffer(freqs)
    out = np.zeros((n, len(freqs), n), complex)
    gap = np.arange(n) - np.arange(n)[:, None]
    for k, f in enumerate(freqs):
        kernel, half = _morlet(n, f, fs)
        out[:, k] = np.where(np.abs(gap) <= half, kernel[np.clip(gap + half, 0, 2 * half)], 0)
    out = out.reshape(n, -1)
    return out.real.copy(), out.imag.copy()


def cwt_blocks(x: np.ndarray, freqs: np.ndarray, normalised: bool = False, limit: int = CWT_VALUES) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """cwt_power of rows in blocks of about limit values: which rows, which scales, power.

    normalised: divided by the largest power of the row at all scales (0 stays 0). A row beyond limit values comes
    in several blocks of scales, at one scale at least; its largest power is then found in a pass before.
    """
    n = x.shape[-1]
    rows, scales = max(1, limit // (n * len(freqs))), min(len(freqs), max(1, limit // n))
    parts = [slice(k, min(k + scales, len(freqs))) for k in range(0, len(freqs), scales)]
    for i in range(0, len(x), rows):
        own = slice(i, min(i + rows, len(x)))
        top = np.max([cwt_power(x[own], freqs[part]).max((-2, -1)) for part in parts], 0) if normalised and len(parts) > 1 else None
        for part in parts:
            power = cwt_power(x[own], freqs[part])
            if normalised:
                most = power.max((-2, -1)) if top is None else top
                power /= np.where(most > 0, most, 1)[:, None, None]
            yield own, part, power


def round_half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Spark's round(x, digits) + 0.0: half up on the decimal number that x prints as."""
    out = np.empty(x.shape)
    given, made, factor = x.reshape(-1), out.reshape(-1), 10.0**digits
    for i in range(0, len(given), 1 << 15):  # parts that stay in a core's cache
        part = given[i : i + (1 << 15)]
        with np.errstate(over="ignore", invalid="ignore"):
            y = part * factor
            k = np.rint(y)
            now = np.divide(k, factor, out=made[i : i + len(part)])
            now += 0.0
            y -= k
            # where this fails the product does not tell on which side of a half the number lies
            sure = np.abs(y, out=y) < 0.499999 - np.abs(k, out=k) * 1e-15
        for at in np.flatnonzero(~sure).tolist():
            v = float(part[at])
            now[at] = float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, _EXACT)) + 0.0 if isfinite(v) else v
    return out


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal of rows by the FFT."""
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(analytic(x))


def inst_freq(x: np.ndarray, fs: float = FS) -> np.ndarray:
    """Phase steps times fs / 2 pi; the first sample repeats the second; under two samples 0."""
    z = analytic(x)
    out = np.zeros(x.shape)
    if x.shape[-1] > 1:
        out[..., 1:] = np.angle(z[..., 1:] * np.conj(z[..., :-1])) * fs / (2 * np.pi)
        out[..., 0] = out[..., 1]
    return out


def start_frequencies(k: int, kind: str = "exponential", custom: np.ndarray | None = None) -> np.ndarray:
    if kind == "custom":
        return np.asarray(custom, float)
    if kind == "zero":
        return np.zeros(k)
    if kind == "linear":
        return 0.5 * np.arange(k) / k
    return 0.5 * 10 ** (-3 + 3 * np.arange(k) / max(1, k - 1))


def mvmd(x: np.ndarray, modes: int = 10, alpha: float = 1000.0, tol: float = 1e-8, tau: float = 1e-3, most: int = 500, init: str | np.ndarray = "exponential", fs: float = FS, noise: int = 0, noise_std: float = 0.8, seed: int = 417) -> tuple[np.ndarray, np.ndarray, int]:
    """Multivariate variational mode decomposition of channels x time.

    Returns modes (K, C, T) by rising centre frequency, centre frequencies in Hz and the number of
    iterations. noise > 0 gives the noise-assisted variant: channels get unit variance, that many white
    noise channels are added for the iteration and dropped from the result, and centres subtract the
    flat spectrum of the noise. init: how the centres begin, or their values.
    """
    channels, t = x.shape
    scale = np.ones(channels)
    if noise:
        sd = x.std(1, ddof=1)
        scale = np.where(sd > np.finfo(float).eps, sd, 1)
        rng = np.random.default_rng(seed)
        x = np.concatenate([x / scale[:, None], rng.normal(0, noise_std, (noise, t))])
    left = t // 2
    padded = np.concatenate([x[:, :left][:, ::-1], x, x[:, left:][:, ::-1]], axis=1)
    target = np.fft.fft(padded, axis=1)[:, : t + 1]
    f = 0.5 * np.arange(t + 1) / t
    omega, u = start_frequencies(modes, init) if isinstance(init, str) else start_frequencies(modes, "custom", init), np.zeros((modes, *target.shape), complex)
    dual, total = np.zeros_like(target), np.zeros_like(target)
    change, n = np.inf, 0
    while n < most and change > tol:
        change, following = 0.0, omega.copy()
        for k in range(modes):
            new = (target - (total - u[k]) - dual / 2) / (1 + alpha * (f - omega[k]) ** 2)
            step = new - u[k]
            total += step
            change += float((np.abs(step) ** 2).sum())
            u[k] = new
            power = np.abs(new) ** 2
            top, mass = (power * f).sum(), power.sum()
            if noise:
                top, mass = top - f.sum(), mass - len(f)
            if mass > 0:
                following[k] = top / mass
        omega = following
        dual += tau * (total - target)
        n += 1
        change /= t
    order = np.argsort(omega, kind="stable")
    u = u[order][:, :channels]
    full = np.zeros((modes, channels, 2 * t), complex)
    full[..., :t] = u[..., :t]
    full[..., t + 1 :] = np.conj(u[..., 1:t][..., ::-1])
    full[..., t] = np.conj(u[..., t])
    out = np.fft.ifft(full, axis=2).real[..., left : left + t]
    return out * scale[:, None], omega[order] * fs, n


def run_modes(pdf: pd.DataFrame) -> pd.DataFrame:
    """One run's channels (run, channel, x) to its modes: run, mode, freq_hz, channel, x."""
    pdf = pdf.sort_values("channel")
    u, freqs, _ = mvmd(np.stack(pdf["x"].to_numpy()).astype(float))
    k, c, _ = u.shape
    return pd.DataFrame({"run": pdf["run"].iloc[0], "mode": np.repeat(np.arange(k), c), "freq_hz": np.repeat(freqs, c), "channel": np.tile(pdf["channel"].to_numpy(), k), "x": list(u.reshape(k * c, -1))})


def resize_weights(source: int, target: int, a: float = -0.75) -> np.ndarray:
    """(target, source) weights of bicubic interpolation, corners not aligned, edges repeated."""
    at = (np.arange(target) + 0.5) * source / target - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((target, source))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        near, far = (a + 2) * d**3 - (a + 3) * d**2 + 1, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
        np.add.at(out, (np.arange(target), np.clip(base + k, 0, source - 1)), np.where(d <= 1, near, np.where(d < 2, far, 0)))
    return out


def resize(image: np.ndarray, height: int = 224, width: int = 224) -> np.ndarray:
    """Separable bicubic resize of the last two axes."""
    return resize_weights(image.shape[-2], height) @ image @ resize_weights(image.shape[-1], width).T


#: Channel means and deviations that image networks are trained with.
MEAN, STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def to_rgb(image: np.ndarray) -> np.ndarray:
    """(3, h, w) normalised copies of a single-channel image."""
    return (image[None] - MEAN[:, None, None]) / STD[:, None, None]


def conv2d(x: np.ndarray, w: np.ndarray, stride: int = 1, pad: int = 0) -> np.ndarray:
    """Convolution of (c, h, w) by (o, c, k, k) as one matrix product."""
    x = np.pad(x, ((0, 0), (pad, pad), (pad, pad)))
    view = np.lib.stride_tricks.sliding_window_view(x, w.shape[2:], axis=(1, 2))[:, ::stride, ::stride]
    c, h, wd = view.shape[:3]
    return (w.reshape(len(w), -1) @ view.transpose(0, 3, 4, 1, 2).reshape(-1, h * wd)).reshape(-1, h, wd)


def _pool(x: np.ndarray, k: int, stride: int, how) -> np.ndarray:
    return how(np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(1, 2))[:, ::stride, ::stride], axis=(3, 4))


class DenseNet:
    """Densely connected network in numpy; DenseNet-201 by default (1920 features).

    weights(name, shape) supplies each tensor: from a file, or seeded random ones.
    """

    def __init__(self, weights, blocks: tuple[int, ...] = (6, 12, 48, 32), growth: int = 32, start: int = 64) -> None:
        self.w, self.blocks, self.growth, self.start = weights, blocks, growth, start

    def _norm_relu(self, x: np.ndarray, name: str) -> np.ndarray:
        c = len(x)
        mean, var, gain, bias = (self.w(f"{name}.{k}", (c,)) for k in ("running_mean", "running_var", "weight", "bias"))
        y = (x - mean[:, None, None]) / np.sqrt(var + 1e-5)[:, None, None] * gain[:, None, None] + bias[:, None, None]
        return np.maximum(y, 0)

    def features(self, image: np.ndarray) -> np.ndarray:
        x = conv2d(image, self.w("features.conv0.weight", (self.start, 3, 7, 7)), 2, 3)
        x = self._norm_relu(x, "features.norm0")
        x = _pool(np.pad(x, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf), 3, 2, np.max)
        for b, layers in enumerate(self.blocks, 1):
            for k in range(1, layers + 1):
                name = f"features.denseblock{b}.denselayer{k}"
                y = conv2d(self._norm_relu(x, f"{name}.norm1"), self.w(f"{name}.conv1.weight", (4 * self.growth, len(x), 1, 1)))
                y = conv2d(self._norm_relu(y, f"{name}.norm2"), self.w(f"{name}.conv2.weight", (self.growth, 4 * self.growth, 3, 3)), 1, 1)
                x = np.concatenate([x, y])
            if b < len(self.blocks):
                name = f"features.transition{b}"
                x = conv2d(self._norm_relu(x, f"{name}.norm"), self.w(f"{name}.conv.weight", (len(x) // 2, len(x), 1, 1)))
                x = _pool(x, 2, 2, np.mean)
        return self._norm_relu(x, "features.norm5").mean((1, 2))


def random_weights(seed: int):
    """Seeded weights: scaled normal kernels, neutral norms."""

    def supply(name: str, shape: tuple[int, ...]) -> np.ndarray:
        if len(shape) == 1:
            return np.zeros(shape) if name.endswith(("mean", "bias")) else np.ones(shape)
        rng = np.random.default_rng([seed, *name.encode()])
        return rng.normal(0, np.sqrt(2 / np.prod(shape[1:])), shape)

    return supply
