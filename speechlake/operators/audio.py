"""Per-clip signal work as vectorized helpers over clips(clip_id, sample_rate, samples) (G1-G7). No shuffles."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import rms, share


def quality(x: Column) -> list[Column]:
    """frames, peak, rms, clipping_fraction (>= 0.999), silence_fraction (<= 1e-4) as plain expressions."""
    return [
        F.size(x).cast("long").alias("frames"), F.round(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))), 6).alias("peak"), F.round(rms(x), 6).alias("rms"),
        F.round(share(x, lambda v: F.abs(v.cast("double")) >= 0.999), 6).alias("clipping_fraction"), F.round(share(x, lambda v: F.abs(v.cast("double")) <= 1e-4), 6).alias("silence_fraction"),
    ]


def resample(x: np.ndarray, rate: int, to: int, half: int = 16) -> np.ndarray:
    """Windowed-sinc resampling."""
    if rate == to or not len(x):
        return x
    at = np.arange(int(np.ceil(len(x) * to / rate))) * rate / to
    scale = min(1.0, to / rate)
    k = np.arange(-int(half / scale), int(half / scale) + 1)
    near = np.floor(at).astype(int)[:, None] + k
    d = (at[:, None] - near) * scale
    kernel = scale * np.sinc(d) * np.where(np.abs(d) <= half, 0.5 + 0.5 * np.cos(np.pi * d / half), 0)
    return (np.where((near >= 0) & (near < len(x)), x[np.clip(near, 0, len(x) - 1)], 0) * kernel).sum(axis=1)


def decibels(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """RMS of each frame in dB."""
    n = max(1, 1 + (len(x) - size) // hop)
    frames = [x[i * hop : i * hop + size] for i in range(n)]
    return np.array([20 * np.log10(max(1e-10, float(np.sqrt(np.mean(np.square(f)))))) if len(f) else -200.0 for f in frames])


def slices(x: np.ndarray, rate: int, threshold: float = -40.0, min_length: float = 5.0, min_interval: float = 0.3, hop_s: float = 0.02, max_silence: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) samples of the parts between silences of at least min_interval seconds, each at least
    min_length long, with up to max_silence kept at its edges."""
    hop = max(1, int(rate * hop_s))
    quiet = decibels(x, hop, hop) < threshold
    edges = np.flatnonzero(np.diff(np.r_[0, quiet.astype(int), 0]))
    gaps = [(a, b) for a, b in edges.reshape(-1, 2) if (b - a) * hop_s >= min_interval]
    keep, out, start = int(max_silence / hop_s), [], 0
    for a, b in gaps:
        lo, hi = min(b, a + keep), max(a, b - keep)
        if a == 0:
            start = hi
        elif (lo - start) * hop_s >= min_length or b == len(quiet):
            out.append((start * hop, min(len(x), lo * hop)))
            start = hi
    if start < len(quiet) and not (gaps and gaps[-1][1] == len(quiet)):
        out.append((start * hop, len(x)))
    return out


def trimmed(x: np.ndarray, rate: int, below_peak: float = 40.0, pad: float = 0.05, gap: float = 0.3, hop_s: float = 0.01) -> tuple[np.ndarray, float]:
    """Silence (peak - 40 dB) cut at the edges and inside, where longer than gap; (signal, seconds cut)."""
    hop = max(1, int(rate * hop_s))
    level = decibels(x, hop, hop)
    voiced = level >= level.max() - below_peak if len(x) else np.zeros(0, dtype=bool)
    if not len(x) or level.max() <= -150 or voiced.all():
        return x, 0.0
    at = np.flatnonzero(voiced)
    edge, most = int(pad * rate), int(gap * rate)
    keep = [[max(0, at[0] * hop - edge), min(len(x), (at[0] + 1) * hop + edge)]]
    for i in at[1:]:
        lo, hi = i * hop, (i + 1) * hop
        if lo - (keep[-1][1] - edge) <= most:
            keep[-1][1] = min(len(x), hi + edge)
        else:
            end = keep[-1][1] - edge
            keep[-1][1] = end + most // 2
            keep.append([lo - most // 2, min(len(x), hi + edge)])
    out = np.concatenate([x[a:b] for a, b in keep])
    return out, (len(x) - len(out)) / rate


def mel_bank(rate: int = 24000, n_fft: int = 1024, bands: int = 100) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (bins - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    down = (points[2:, None] - bins) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, rate: int = 24000, n_fft: int = 1024, hop: int = 256, bands: int = 100, centred: bool = True) -> np.ndarray:
    """(bands, frames): log of mel magnitudes, at least 1e-5. centred pads n_fft / 2, else (n_fft - hop) / 2."""
    pad = n_fft // 2 if centred else (n_fft - hop) // 2
    y = np.pad(x, pad, mode="reflect") if len(x) > pad else np.pad(x, pad)
    y = np.pad(y, (0, max(0, n_fft - len(y))))
    frames = np.lib.stride_tricks.sliding_window_view(y, n_fft)[::hop] * np.hanning(n_fft + 1)[:-1]
    return np.log(np.maximum(mel_bank(rate, n_fft, bands) @ np.abs(np.fft.rfft(frames, axis=1)).T, 1e-5))


def crossfade(parts: list[np.ndarray], rate: int, seconds: float = 0.15) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        n = min(int(seconds * rate), len(out), len(p))
        fade = np.linspace(0, 1, n) if n else np.zeros(0)
        out = np.concatenate([out[: len(out) - n], out[len(out) - n :] * (1 - fade) + p[:n] * fade, p[n:]])
    return out


#: A table of at most so many cells is held as a whole.
_CELLS = 4096


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cost of the cheapest path from the first cell to each cell of the last row, over unit vectors.

    The cells of an anti-diagonal i + j = d depend on the two before it only, so three of them are held."""
    n, m = len(a), len(b)
    out, before, last = np.empty(m), np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(d, n - 1) + 1
        i = np.arange(lo, hi)
        cost = 1 - np.einsum("ij,ij->i", a[i], b[d - i])
        now = np.full(n + 1, np.inf)
        # Places are shifted by one: before[i] is the cell above and left of (i, d - i).
        now[i + 1] = cost + (np.minimum(before[i], np.minimum(last[i], last[i + 1])) if d else 0.0)
        if hi == n:
            out[d - n + 1] = now[n]
        before, last = last, now
    return out


def _whole_path(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    cost = 1 - a @ b.T
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    total[0, 0] = 0
    for d in range(len(a) + len(b) - 1):
        i = np.arange(max(0, d - len(b) + 1), min(d, len(a) - 1) + 1)
        j = d - i
        total[i + 1, j + 1] = cost[i, j] + np.minimum(total[i, j], np.minimum(total[i, j + 1], total[i + 1, j]))
    i, j, path = len(a), len(b), []
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: total[p])
    return path[::-1]


def dtw(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest monotone path over cosine distances of two feature sequences (frames x dims).

    Memory is linear: the middle row's cell on the path is where the costs from the first cell and to the last one add up
    to the least; the path is that of the two parts, and so on, until a part's table is small."""
    a, b, path = _unit(a), _unit(b), []
    parts = [(0, len(a), 0, len(b))] if len(a) and len(b) else []
    while parts:
        lo, hi, left, right = parts.pop()
        if (hi - lo) * (right - left) <= _CELLS or hi - lo < 3:
            path += [(lo + i, left + j) for i, j in _whole_path(a[lo:hi], b[left:right])]
            continue
        mid = (lo + hi) // 2
        there, back = _last_row(a[lo : mid + 1], b[left:right]), _last_row(a[mid:hi][::-1], b[left:right][::-1])[::-1]
        at = left + int((there + back - (1 - b[left:right] @ a[mid])).argmin())
        # Both parts hold the cell; it counts once.
        parts += [(mid, hi, at, right), (lo, mid + 1, left, at + 1)]
    return [p for k, p in enumerate(path) if not k or p != path[k - 1]]


def path_cost(a: np.ndarray, b: np.ndarray, path: list[tuple[int, int]]) -> float:
    i, j = np.array(path).T
    return float((1 - np.einsum("ij,ij->i", _unit(a)[i], _unit(b)[j])).sum())


def aligned(a: np.ndarray, b: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences on a common time line along the path; alpha is the weight of a's timing. With a sequence of fewer
    than two frames there is nothing to align: both are stretched evenly."""
    if min(len(a), len(b)) < 2:
        n = max(1, round(alpha * len(a) + (1 - alpha) * len(b)))
        even = lambda x: x[np.round(np.linspace(0, len(x) - 1, n)).astype(int)] if len(x) else np.zeros((n, x.shape[1]))
        return even(a), even(b)
    path = np.array(dtw(a, b))
    n = max(1, round(alpha * len(a) + (1 - alpha) * len(b)))
    at = np.linspace(0, len(path) - 1, n)
    pick = lambda x, k: np.stack([np.interp(np.interp(at, np.arange(len(path)), path[:, k]), np.arange(len(x)), x[:, d]) for d in range(x.shape[1])], axis=1)
    return pick(a, 0), pick(b, 1)


def read_wav(data: bytes) -> tuple[np.ndarray, int] | None:
    """(channels x samples in -1..1, rate) of a PCM WAV; None for a file that cannot be decoded."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, raw = w.getsampwidth(), w.readframes(w.getnframes())
            x = np.frombuffer(raw, dtype={1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(float)
            x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
            return x.reshape(-1, w.getnchannels()).T, w.getframerate()
    except (wave.Error, EOFError, KeyError, ValueError):
        return None


def write_wav(x: np.ndarray, rate: int) -> bytes:
    """16-bit PCM WAV of samples in -1..1 (one channel, or channels x samples)."""
    out, channels = io.BytesIO(), np.atleast_2d(x)
    with wave.open(out, "wb") as w:
        w.setnchannels(len(channels))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(np.clip(channels, -1, 1) * 32767).astype("<i2").T.tobytes())
    return out.getvalue()


def per_clip(clips: DataFrame, schema: str, f, samples: str = "samples", rows: int = 256) -> DataFrame:
    """f(clip_id, samples, sample_rate) -> rows of schema; batches of ``rows`` clips bound the memory."""

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), rows):
                out = [r for i, x, s in pdf.iloc[lo : lo + rows][["clip_id", samples, "sample_rate"]].itertuples(index=False) for r in f(i, np.asarray(x, dtype=float), int(s))]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return clips.select("clip_id", samples, "sample_rate").mapInPandas(run, schema)


def edit_mask(keep_to: list[tuple[float, float]], replaced: list[float], total: float, rate: int = 24000, hop: int = 256) -> list[bool]:
    """Frames kept (True) or regenerated (False): second ranges are cut out and stand for parts of other lengths."""
    frame = lambda s: round(s * rate / hop)
    out, at = [], 0
    for (lo, hi), length in zip(keep_to, replaced, strict=True):
        out += [True] * (frame(lo) - at) + [False] * frame(length)
        at = frame(hi)
    return out + [True] * max(0, frame(total) - at)
