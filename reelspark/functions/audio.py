"""Levels, pans, delivery targets and gain curves as column expressions; PCM codecs and filters in numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delivery targets (loudness in LUFS, tolerance or none, true peak limit in dBTP).
TARGETS = [
    ("netflix", -27.0, 2.0, -2.0),
    ("amazon", -24.0, 2.0, -2.0),
    ("appletv", -24.0, 2.0, -1.0),
    ("youtube", -14.0, None, -1.0),
    ("spotify", -14.0, None, -1.0),
    ("applepodcasts", -16.0, 1.0, -1.0),
    ("ebu", -23.0, 0.5, -1.0),
    ("atsc", -24.0, 2.0, -2.0),
]
OFFSET = -0.691
FADER_OFF = -60.05


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, "platform string, lufs double, tolerance double, peak double")


def loudness(power: Column) -> Column:
    """LUFS of a mean power; null for silence."""
    return F.when(power > 0, F.lit(OFFSET) + 10 * F.log10(power))


def verdict_ok(lufs: Column, peak: Column, target: Column, tolerance: Column, limit: Column, lra: Column | None = None, most_lra: Column | None = None) -> Column:
    """False if unmeasured, off the target by more than its tolerance (if it has one), over the peak limit,
    or of a wider range than is allowed (if there is a limit)."""
    level = tolerance.isNull() | (F.abs(lufs - target) <= tolerance + 1e-9)
    ok = level & F.coalesce(peak <= limit + 1e-9, F.lit(True))
    if lra is not None and most_lra is not None:
        ok = ok & F.coalesce(lra <= most_lra, F.lit(True))
    return F.coalesce(ok, F.lit(False))


def verdict_messages(lufs: Column, peak: Column, target: Column, tolerance: Column, limit: Column, lra: Column | None = None, most_lra: Column | None = None) -> Column:
    """Why a measurement fails, in order; platforms without a tolerance give notes alone."""
    off = F.round(lufs - target, 1)
    said = F.array(
        F.when(lufs.isNull(), "could not be measured"),
        F.when(tolerance.isNotNull() & (F.abs(lufs - target) > tolerance + 1e-9), F.format_string("%.1f LU off the target", off)),
        F.when(tolerance.isNull() & (F.abs(lufs - target) > 1), F.format_string("note: %.1f LU off the level it is played at", off)),
        F.when(peak > limit + 1e-9, F.format_string("true peak %.1f over %.1f", peak, limit)),
        F.when(lra > most_lra, F.format_string("range of %.1f LU over %.1f", lra, most_lra)) if lra is not None and most_lra is not None else F.lit(None).cast("string"),
    )
    return F.array_compact(said)


def db_to_gain(db: Column) -> Column:
    return F.when(db < FADER_OFF, 0.0).otherwise(F.pow(F.lit(10.0), db / 20))


def gain_to_db(gain: Column) -> Column:
    return F.when(gain > 0, 20 * F.log10(gain)).otherwise(F.lit(float("-inf")))


def level(value: Column) -> Column:
    """-60 to 0 dB as 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (20 * F.log10(F.greatest(value, F.lit(1e-9))) + 60) / 60))


def pan_gains(pan: Column) -> tuple[Column, Column]:
    """Constant power, unity in the centre."""
    a = (pan + 1) * (math.pi / 4)
    return F.cos(a) * math.sqrt(2), F.sin(a) * math.sqrt(2)


def compressor_gain(level_db: Column, threshold: float, ratio: float, knee: float) -> Column:
    """Gain in dB above the threshold, with a quadratic knee."""
    over, slope = level_db - threshold, 1 / ratio - 1
    if knee <= 0:
        return F.when(over > 0, over * slope).otherwise(0.0)
    bent = slope * F.pow(over + knee / 2, F.lit(2)) / (2 * knee)
    return F.when(over <= -knee / 2, 0.0).when(over < knee / 2, bent).otherwise(over * slope)


def expander_gain(level_db: Column, threshold: float, ratio: float, knee: float, range_db: float) -> Column:
    """Gain in dB below the threshold, with a quadratic knee, never under -range."""
    under, slope = level_db - threshold, ratio - 1
    bent = -slope * F.pow(under - knee / 2, F.lit(2)) / (2 * knee) if knee > 0 else F.lit(0.0)
    return F.greatest(F.lit(-range_db), F.when(under >= knee / 2, 0.0).when(under > -knee / 2, bent).otherwise(under * slope))


# --- numpy kernels


def decode_pcm(raw: bytes, bits: int, channels: int, is_float: bool = False) -> np.ndarray:
    """float32 (frames, channels) of little-endian PCM; a partial frame at the end is dropped and what isn't finite replaced."""
    width = bits // 8 * channels
    raw = raw[: len(raw) // width * width]
    if is_float:
        x = np.nan_to_num(np.frombuffer(raw, f"<f{bits // 8}").astype(np.float32), nan=0.0, posinf=1.0, neginf=-1.0)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.reshape(-1).view("<i4").astype(np.float32) / 2.0**31
    else:
        x = np.frombuffer(raw, f"<i{bits // 8}").astype(np.float32) / 2.0 ** (bits - 1)
    return x.reshape(-1, channels)


def encode_pcm(x: np.ndarray, bits: int, is_float: bool = False, dither: np.random.Generator | None = None) -> bytes:
    """Little-endian PCM, clipped and rounded; a generator adds triangular dither."""
    if is_float:
        return x.astype(f"<f{bits // 8}").tobytes()
    top = 2.0 ** (bits - 1)
    y = x.astype(np.float64) * top
    if dither is not None:
        y = y + dither.random(y.shape) - dither.random(y.shape)
    y = np.clip(np.rint(y), -top, top - 1).astype(np.int64)
    if bits == 8:
        return (y + 128).astype(np.uint8).tobytes()
    if bits == 24:
        return (y << 8).astype("<i4").reshape(-1, 1).view(np.uint8)[:, 1:].tobytes()
    return y.astype(f"<i{bits // 8}").tobytes()


#: Analog prototypes H(s) of the audio cookbook, as coefficients of 1, s and s squared over
#: those of 1, s / Q and s squared; A is the root of the gain.
PROTOTYPES = {
    "lowpass": lambda a, q: ((1, 0, 0), (1, 1 / q, 1)),
    "highpass": lambda a, q: ((0, 0, 1), (1, 1 / q, 1)),
    "bandpass": lambda a, q: ((0, 1 / q, 0), (1, 1 / q, 1)),
    "notch": lambda a, q: ((1, 0, 1), (1, 1 / q, 1)),
    "bell": lambda a, q: ((1, a / q, 1), (1, 1 / (a * q), 1)),
    "lowshelf": lambda a, q: ((a * a, a * math.sqrt(a) / q, a), (1, math.sqrt(a) / q, a)),
    "highshelf": lambda a, q: ((a, a * math.sqrt(a) / q, a * a), (a, math.sqrt(a) / q, 1)),
}


def bilinear(analog: tuple[tuple[float, ...], tuple[float, ...]], k: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator in z of an analog section in s, with s = (1 - 1/z) / (1 + 1/z) / k."""
    # 1, s and s squared, times (1 + 1/z) squared and k squared, as polynomials in 1/z.
    basis = np.array([[1, 2, 1], [1, 0, -1], [1, -2, 1]]) * np.array([k * k, k, 1.0])[:, None]
    top, bottom = (np.asarray(x, float) @ basis for x in analog)
    return top / bottom[0], bottom / bottom[0]


def rbj_biquad(kind: str, freq: float, rate: float, gain_db: float = 0.0, q: float = 0.7071) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a second-order section at freq (kept below the Nyquist frequency)."""
    return bilinear(PROTOTYPES[kind](10 ** (gain_db / 40), q), math.tan(math.pi * min(freq / rate, 0.49)))


def butterworth_qs(order: int) -> list[float]:
    """Qs of the sections of a Butterworth filter: its poles lie evenly on the left half circle."""
    poles = np.exp(1j * np.pi * (0.5 + (np.arange(order // 2) + 0.5) / order))
    return (-0.5 / poles.real)[::-1].tolist()


def highpass_linear(freq: float, rate: float) -> np.ndarray:
    """Taps of a linear-phase high-pass: a whole sample less a Blackman-windowed low-pass (four periods a side)."""
    half = max(1, int(4 * rate / freq))
    low = np.sinc(2 * freq / rate * np.arange(-half, half + 1)) * np.blackman(2 * half + 1)
    taps = -low / low.sum()
    taps[half] += 1
    return taps


def k_weighting(rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two sections of the loudness weighting (published parameters): a shelf of nearly 4 dB and a high-pass."""
    # Frequency, Q and gain of the shelf, the exponent of its band gain; frequency and Q of the high-pass.
    shelf_hz, shelf_q, shelf_db, band = 1681.974450955533, 0.7071752369554196, 3.999843853973347, 0.4996667741545416
    high_hz, high_q = 38.13547087602444, 0.5003270373238773
    high = 10 ** (shelf_db / 20)
    shelf = bilinear(((1, high**band / shelf_q, high), (1, 1 / shelf_q, 1)), math.tan(math.pi * shelf_hz / rate))
    b, a = bilinear(((0, 0, 1), (1, 1 / high_q, 1)), math.tan(math.pi * high_hz / rate))
    return [shelf, (b / b[0], a)]


def response_db(sections: list[tuple[np.ndarray, np.ndarray]], freq: np.ndarray, rate: float) -> np.ndarray:
    z = np.exp(-2j * np.pi * np.asarray(freq, float) / rate)
    powers = np.stack([np.ones_like(z), z, z * z])
    h = np.ones_like(z)
    for b, a in sections:
        h = h * (b @ powers) / (a @ powers)
    return 20 * np.log10(np.maximum(np.abs(h), 1e-12))


def impulse(sections: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The sections' impulse response, n samples long, from their frequency response (n past the decay)."""
    size = 1 << (2 * n - 1).bit_length()
    z = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)
    powers = np.stack([np.ones_like(z), z, z * z])
    h = np.ones_like(z)
    for b, a in sections:
        h = h * (b @ powers) / (a @ powers)
    return np.fft.irfft(h, size)[:n]


def convolve(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """x filtered by the taps, as long as x."""
    size = 1 << (len(x) + len(taps) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[: len(x)]


def between(rate: float, taps: int = 48) -> list[np.ndarray]:
    """Windowed-sinc taps that give the points between samples (three, one or none, by the rate), taps / 2 samples late."""
    over = 4 if rate < 96_000 else 2 if rate < 192_000 else 1
    k, window = np.arange(-taps // 2 + 1, taps // 2 + 1), np.kaiser(taps + 2, 8.0)[1:-1]
    made = [np.sinc(k - phase / over) * window for phase in range(1, over)]
    return [h / h.sum() for h in made]


def true_peak(x: np.ndarray, rate: float, taps: int = 48) -> float:
    """Largest absolute value between the samples too."""
    if not len(x):
        return 0.0
    longer = np.concatenate([x, np.zeros(taps)])
    return max([float(np.abs(x).max()), *(float(np.abs(convolve(longer, h)).max()) for h in between(rate, taps))])
