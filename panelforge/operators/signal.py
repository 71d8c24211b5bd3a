"""Waveform windows: spectral and amplitude features of one window, coherence of two."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = ((0.5, 2.0), (2.0, 8.0), (8.0, 20.0))
FEATURES = ("rms", "peak", "crest", "zero_rate", "kurtosis", "centroid_hz", "dominant_hz", "entropy", "band_low", "band_mid", "band_high", "sta_lta_max")


def window_features(x: np.ndarray, rate: float, sta: float = 5.0, lta: float = 30.0, bands: tuple[tuple[float, float], ...] = BANDS) -> list[float]:
    """The FEATURES of one window; zeros for one without energy."""
    y = x - x.mean() if len(x) else x
    power = float((y**2).mean()) if len(y) else 0.0
    if power <= 0:
        return [0.0] * len(FEATURES)
    rms, peak = power**0.5, float(np.abs(y).max())
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y)))) ** 2
    freq = np.fft.rfftfreq(len(y), 1 / rate)
    share = spectrum / spectrum.sum()
    entropy = float(-(share[share > 0] * np.log(share[share > 0])).sum() / np.log(len(share)))
    energy = np.concatenate([[0.0], np.cumsum(y**2)])
    mean = lambda w: (energy[np.arange(1, len(y) + 1)] - energy[np.maximum(0, np.arange(1, len(y) + 1) - w)]) / np.minimum(np.arange(1, len(y) + 1), w)
    short, long = mean(max(1, int(sta * rate))), mean(max(1, int(lta * rate)))
    ratio = float((short / np.maximum(long, 1e-30))[min(len(y) - 1, int(sta * rate)) :].max())
    in_band = [float(share[(freq >= a) & (freq < b)].sum()) for a, b in bands]
    return [rms, peak, peak / rms, float((np.diff(np.signbit(y).astype(int)) != 0).mean()), float((y**4).mean() / power**2 - 3), float((freq * share).sum()), float(freq[spectrum.argmax()]), entropy, *in_band, ratio]


def featured(windows: DataFrame, keys: list[str], samples: str, rate: str) -> DataFrame:
    """(keys, FEATURES) of rows that hold one window each, as array<double> with its sampling rate."""
    kinds = dict(windows.dtypes)

    def run(batches):
        for b in batches:
            rows = [window_features(np.asarray(x, float), float(r)) for x, r in zip(b[samples], b[rate], strict=True)]
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(rows, columns=list(FEATURES), dtype=float)], axis=1)

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{f} double" for f in FEATURES])
    return windows.select(*keys, samples, rate).mapInPandas(run, schema)


def coherence(a: np.ndarray, b: np.ndarray, rate: float, parts: int = 8, bands: tuple[tuple[float, float], ...] = BANDS) -> list[float]:
    """Mean magnitude-squared coherence by band over `parts` half-overlapping segments."""
    n = 2 * min(len(a), len(b)) // (parts + 1)
    if n < 4:
        return [0.0] * len(bands)
    cut = lambda x: np.stack([np.fft.rfft((s - s.mean()) * np.hanning(n)) for s in (x[i * n // 2 : i * n // 2 + n] for i in range(parts))])
    fa, fb = cut(a), cut(b)
    cross, pa, pb = (fa * fb.conj()).mean(0), (np.abs(fa) ** 2).mean(0), (np.abs(fb) ** 2).mean(0)
    msc = np.where(pa * pb > 0, np.abs(cross) ** 2 / np.maximum(pa * pb, 1e-300), 0)
    freq = np.fft.rfftfreq(n, 1 / rate)
    return [float(msc[(freq >= lo) & (freq < hi)].mean()) if ((freq >= lo) & (freq < hi)).any() else 0.0 for lo, hi in bands]


def tiles(samples: DataFrame, key: str, ts: str, value: str, seconds: int, per_window: int) -> DataFrame:
    """(key, start, samples, covered): complete tumbling windows of a long table of samples; a partial one is dropped."""
    w = samples.groupBy(key, F.window(ts, f"{seconds} seconds").getField("start").alias("start")).agg(F.array_sort(F.collect_list(F.struct(ts, value))).alias("s"), F.count(value).alias("covered"))
    return w.filter(F.col("covered") == per_window).select(key, "start", F.transform("s", lambda x: x[value]).alias("samples"), "covered")


def coherent(pairs: DataFrame, keys: list[str], a: str, b: str, rate: float, parts: int = 8) -> DataFrame:
    """(keys, low, mid, high): coherence by band of rows that hold two windows each, as array<double>."""
    kinds = dict(pairs.dtypes)

    def run(batches):
        for batch in batches:
            rows = [coherence(np.asarray(x, float), np.asarray(y, float), rate, parts) for x, y in zip(batch[a], batch[b], strict=True)]
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(rows, columns=["low", "mid", "high"], dtype=float)], axis=1)

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["low double", "mid double", "high double"])
    return pairs.select(*keys, a, b).mapInPandas(run, schema)
