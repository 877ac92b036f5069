"""Signals as rows (track, at, value): envelopes, loudness and gains in windows and aggregates; kernels by track where state is carried."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from reelspark.functions import audio
from reelspark.functions.timecode import div
from reelspark.operators.prefix import LENGTH, in_order, neighbours, positions, ranged, running, scanned
from reelspark.session import checkpoint_dir

#: Stretches of items between free moments that are packed in one go.
TOGETHER = 1024


def envelope(df: DataFrame, by: list[str], at: str, total: str, value: str, buckets: int) -> DataFrame:
    """Peak and RMS (no more than the peak) in each bucket of each track; bucket k holds at * buckets div total = k."""
    bucket = div(F.col(at) * buckets, F.col(total)).alias("bucket")
    g = df.groupBy(*by, bucket).agg(F.max(F.abs(value)).alias("peak"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return g.withColumn("rms", F.least("rms", "peak"))


def column_levels(df: DataFrame, by: list[str], bucket: str, value: str, buckets: int, width: int) -> DataFrame:
    """An envelope at another width: the largest of the buckets in a column, or on a line between buckets."""
    if width <= buckets:
        return df.groupBy(*by, div(F.col(bucket) * width, buckets).alias("column")).agg(F.max(value).alias(value))
    w = Window.partitionBy(*by).orderBy(bucket)
    place = lambda b: b.cast("double") * (width - 1) / (buckets - 1)
    d = df.withColumn("_next", F.lead(value).over(w))
    first = F.ceil(place(F.col(bucket))).cast("long")
    last = F.when(F.col("_next").isNull(), F.lit(width - 1)).otherwise(F.ceil(place(F.col(bucket) + 1)).cast("long") - 1)
    each = d.withColumn("column", F.explode(F.sequence(first, F.greatest(first, last)))).where((F.col("column") <= last))
    share = F.col("column").cast("double") * (buckets - 1) / (width - 1) - F.col(bucket)
    return each.select(*by, "column", (F.col(value) + F.coalesce(F.col("_next") - F.col(value), F.lit(0)) * share).alias(value))


def window_powers(df: DataFrame, by: list[str], at: str, power: str, width: int, length: int = LENGTH) -> DataFrame:
    """Mean power over `width` consecutive blocks, complete windows alone; at numbers the blocks of a track."""
    back = lambda spec: spec.rowsBetween(-(width - 1), 0)
    d = neighbours(df.select(*by, at, power), by, at, width - 1, 0, length, mean_power=lambda w: F.avg(power).over(back(w)), _n=lambda w: F.count("*").over(back(w)))
    return d.where(f"_n = {width}").select(*by, at, "mean_power")


def gated_loudness(windows: DataFrame, by: list[str], gate: float = -70.0, relative: float = -10.0) -> DataFrame:
    """Integrated loudness: the mean of windows over the gate and over their own mean plus the relative gate."""
    loud = windows.withColumn("_l", audio.loudness(F.col("mean_power"))).where(F.col("_l") > gate)
    rel = loud.groupBy(*by).agg((audio.loudness(F.avg("mean_power")) + relative).alias("_rel"))
    return loud.join(rel, by).where("_l > _rel").groupBy(*by).agg(audio.loudness(F.avg("mean_power")).alias("lufs"))


def loudness_range(windows: DataFrame, by: list[str], gate: float = -70.0, relative: float = -20.0) -> DataFrame:
    """P95 less P10 of the windows over both gates; null for fewer than two."""
    loud = windows.withColumn("_l", audio.loudness(F.col("mean_power"))).where(F.col("_l") > gate)
    rel = loud.groupBy(*by).agg((audio.loudness(F.avg("mean_power")) + relative).alias("_rel"))
    kept = loud.join(rel, by).where("_l > _rel").select(*by, "_l")
    p = percentiles(kept, by, "_l", [0.1, 0.95])
    return p.select(*by, F.when(F.col("n") > 1, F.col("p")[1] - F.col("p")[0]).alias("lra"))


#: A group of so many values is gathered by an aggregate; a larger one is ranked where its values lie.
GATHERED = 1_000_000


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], gathered: int | None = None) -> DataFrame:
    """by, n and p, the exact percentiles (between two values on a line) of each group's values that aren't null.

    Values of a large group are dealt by ranges, so their order is that of the tasks, and a value's rank is its place
    in its task and what the tasks before it hold: no task and no buffer holds the group."""
    checkpoint_dir(df.sparkSession)
    values = df.where(F.col(value).isNotNull()).select(*by, value).checkpoint()
    n = F.count("*").alias("n")
    large = values.groupBy(*by).agg(n).where(F.col("n") > (GATHERED if gathered is None else gathered)).select(*by).checkpoint()
    if large.isEmpty():
        return values.groupBy(*by).agg(n, F.percentile(value, shares).alias("p"))
    match = [F.col(f"v.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by]
    few = values.alias("v").join(large.alias("l"), match, "left_anti").groupBy(*by).agg(n, F.percentile(value, shares).alias("p"))
    order = ranged(values.alias("v").join(large.alias("l"), match, "left_semi"), [*by, value])
    placed = positions(order, by, F.shiftright("_pos", 16), ["_pos"])
    at = [F.lit(s) * (F.col("total") - 1) for s in shares]
    near = placed.where(F.array_contains(F.array(*(f(a).cast("long") for a in at for f in (F.floor, F.ceil))), F.col("pos")))
    ends = [F.max(F.when(F.col("pos") == f(a), F.col(value))) for a in at for f in (F.floor, F.ceil)]
    between = [low + (high - low) * F.max(a - F.floor(a)) for a, low, high in zip(at, ends[::2], ends[1::2])]
    return few.unionByName(near.groupBy(*by).agg(F.max("total").alias("n"), F.array(*between).alias("p")))


def maxima(blocks: DataFrame, by: list[str], at: str, power: str, momentary: int = 4, short_term: int = 30) -> DataFrame:
    """The loudest window of 400 ms and of 3 s of each track, from the powers of 100 ms; null where there is none."""
    most = lambda n, name: window_powers(blocks, by, at, power, n).groupBy(*by).agg(audio.loudness(F.max("mean_power")).alias(name))
    return most(momentary, "max_momentary").join(most(short_term, "max_short_term"), by, "left")


def programme(blocks: DataFrame, by: list[str], at: str, power: str) -> DataFrame:
    """Powers of the tracks of a programme (by) measured together: their sum at each moment."""
    return blocks.groupBy(*by, at).agg(F.sum(power).alias(power))


def gain_to_target(blocks: DataFrame, by: list[str], at: str, power: str, target: float, steps: int = 6, near: float = 0.001) -> DataFrame:
    """Gain in dB that brings a track's integrated loudness to the target; gating moves with the gain, so it
    is solved by steps. Each step is an aggregate of the windows, so no track is gathered."""
    checkpoint_dir(blocks.sparkSession)
    w = window_powers(blocks, by, at, power, 4)
    state = blocks.select(*by).distinct().withColumn("gain_db", F.lit(None).cast("double")).withColumn("_done", F.lit(False))
    for k in range(steps + 1):
        g = F.when(F.col("gain_db").isNull(), F.lit(1.0)).otherwise(F.pow(F.lit(10.0), F.col("gain_db") / 10)) if k else F.lit(1.0)
        now = gated_loudness(w.join(state, by).select(*by, (F.col("mean_power") * g).alias("mean_power")), by)
        state = state.join(now, by, "left")
        off = F.lit(target) - F.col("lufs")
        if not k:
            state = state.select(*by, off.alias("gain_db"), F.lit(False).alias("_done"))
        else:
            stop = F.col("_done") | F.col("lufs").isNull() | (F.abs(off) <= near)
            state = state.select(*by, F.when(stop, F.col("gain_db")).otherwise(F.col("gain_db") + off).alias("gain_db"), stop.alias("_done"))
            state = state.checkpoint()
            if state.where("not _done").isEmpty():
                break
    return state.drop("_done")


def solved_gain(p: np.ndarray, target: float, steps: int = 6, near: float = 0.001) -> float | None:
    """As gain_to_target, of one track's powers."""
    return _solve(p, target, steps, near)


def _integrated(p: np.ndarray) -> float | None:
    if len(p) < 4:
        return None
    w = np.convolve(p, np.ones(4) / 4, "valid")
    level = audio.OFFSET + 10 * np.log10(np.maximum(w, 1e-30))
    kept = w[level > -70]
    if not len(kept):
        return None
    floor = audio.OFFSET + 10 * np.log10(kept.mean()) - 10
    kept = w[(level > -70) & (level > floor)]
    return float(audio.OFFSET + 10 * np.log10(kept.mean())) if len(kept) else None


def _solve(p: np.ndarray, target: float, steps: int, near: float) -> float | None:
    now = _integrated(p)
    if now is None:
        return None
    gain = target - now
    for _ in range(steps):
        now = _integrated(p * 10 ** (gain / 10))
        if now is None or abs(target - now) <= near:
            break
        gain += target - now
    return gain


def noise_profile(df: DataFrame, by: list[str], frame: str, energy: str, spectrum: str, quietest: int) -> DataFrame:
    """by, bin and mean of the quietest frames' spectra (array columns)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(energy, frame)) if by else None
    low = df.withColumn("_n", rank).where(F.col("_n") <= quietest) if by else df.orderBy(energy, frame).limit(quietest)
    return low.select(*by, F.posexplode(spectrum).alias("bin", "power")).groupBy(*by, "bin").agg(F.avg("power").alias("power"))


def running_min(value: str, width: int) -> Callable[[WindowSpec], Column]:
    """For neighbours(): the smallest of the row and the width - 1 that follow."""
    return lambda spec: F.min(value).over(spec.rowsBetween(0, width - 1))


def level_db(df: DataFrame, by: list[str], at: str, value: str, width: int, length: int = LENGTH) -> DataFrame:
    """df with peak_db of each row and power_db, the mean power of the row and the width - 1 before it (null until
    there are as many); at numbers the rows of a track."""
    back = lambda spec: spec.rowsBetween(-(width - 1), 0)
    power = lambda w: F.when(F.count("*").over(back(w)) == width, 10 * F.log10(F.greatest(F.avg(F.col(value) * F.col(value)).over(back(w)), F.lit(1e-20))))
    d = neighbours(df, by, at, width - 1, 0, length, power_db=power)
    return d.select(*df.columns, (20 * F.log10(F.greatest(F.abs(value), F.lit(1e-10)))).alias("peak_db"), "power_db")


def box(value: str, reach: int) -> Callable[[WindowSpec], Column]:
    """For neighbours(): the mean of the rows up to `reach` away, of those that exist."""
    return lambda spec: F.avg(value).over(spec.rowsBetween(-reach, reach))


def mixdown(df: DataFrame, frame: list[str], value: Column, gain_db: Column, pan: Column, muted: Column, master_db: float = 0.0) -> DataFrame:
    """left and right of each frame: gains and pans, over the root of the number of sounding channels, clipped."""
    left, right = audio.pan_gains(pan)
    sounding = F.count_if(~muted)
    gain = F.when(muted, 0.0).otherwise(audio.db_to_gain(gain_db))
    trim = 10 ** (master_db / 20) / F.sqrt(F.greatest(sounding, F.lit(1)))
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return df.groupBy(*frame).agg(clip(F.sum(value * gain * left) * trim).alias("left"), clip(F.sum(value * gain * right) * trim).alias("right"), sounding.alias("sounding"))


def reduction_db(df: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    a, b = F.avg(F.col(before) * F.col(before)), F.avg(F.col(after) * F.col(after))
    return df.groupBy(*by).agg(F.when((a > 0) & (b > 0), 10 * F.log10(a / b)).otherwise(0.0).alias("reduction_db"))


def _with(df: DataFrame, column: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + f", {column}"


def _pole(targets: np.ndarray, low: float, high: float, attack: float, release: float, attack_below: bool) -> list[float]:
    """One-pole smoothing over the targets as a function of the gain before, between low and high: a rising
    line with bends, as its places and then its values. A target bends it only where it falls within what
    is left of its range, which shrinks with every target."""
    xs, ys = [low, high], [low, high]
    for t in targets.tolist():
        if ys[0] < t < ys[-1]:
            k = bisect_left(ys, t)
            if ys[k] != t:
                xs.insert(k, xs[k - 1] + (t - ys[k - 1]) * (xs[k] - xs[k - 1]) / (ys[k] - ys[k - 1]))
                ys.insert(k, t)
        ys = [t + (y - t) * (attack if (t < y) == attack_below else release) for y in ys]
        if len(ys) > 1 and ys[0] == ys[-1]:
            xs, ys = xs[:1], ys[:1]
    return [*xs, *ys]


def smoothed_gain(df: DataFrame, by: list[str], at: str, target: str, attack: float, release: float, attack_below: bool = True, length: int = LENGTH) -> DataFrame:
    """df with gain_db: one-pole smoothing of target gains within each track (attack where the target falls, or rises), from 0 on.

    at numbers the rows of a track. A segment is a line with bends in the gain that comes in; the lines are followed from one to the next."""

    def run(pdf: pd.DataFrame, state: list[float]) -> tuple[np.ndarray, list[float]]:
        out, g = np.empty(len(pdf)), state[0]
        for k, t in enumerate(pdf[target].to_numpy(float)):
            g = t + (g - t) * (attack if (t < g) == attack_below and t != g else release)
            out[k] = g
        return out, [g]

    function = lambda pdf, b: _pole(pdf[target].to_numpy(float), min(0.0, b["low"]), max(0.0, b["high"]), attack, release, attack_below)
    follow = lambda g, f: [float(np.interp(g[0], f[: len(f) // 2], f[len(f) // 2 :]))]
    return scanned(df, by, at, "gain_db", "double", [0.0], function, follow, run, {"low": F.min(target), "high": F.max(target)}, length)


def gated(df: DataFrame, by: list[str], at: str, level: str, threshold: float, hysteresis: float, hold: int, length: int = LENGTH) -> DataFrame:
    """df with open (0 or 1): a gate opens at the threshold and closes after `hold` rows below it less the hysteresis.

    at numbers the rows of a track. The state is how many low rows have come since the gate was opened last (infinity
    before it); a segment adds its own, or starts from its last opening."""

    def lows_since(pdf: pd.DataFrame, before: float) -> np.ndarray:
        x = pdf[level].to_numpy(float)
        up, lows = x >= threshold, np.cumsum((x < threshold - hysteresis) & ~(x >= threshold))
        opened = np.maximum.accumulate(np.where(up, np.arange(1, len(x) + 1), 0))
        return np.where(opened > 0, lows - lows[opened - 1], before + lows)

    def run(pdf: pd.DataFrame, state: list[float]) -> tuple[np.ndarray, list[float]]:
        if not len(pdf):
            return np.zeros(0, np.int64), state
        since = lows_since(pdf, state[0])
        return (since <= hold).astype(np.int64), [float(since[-1])]

    def function(pdf: pd.DataFrame, _: dict[str, float]) -> list[float]:
        from_start, from_never = lows_since(pdf, 0.0)[-1], lows_since(pdf, np.inf)[-1]
        return [float(np.isinf(from_never)), float(from_start)]  # adds to what came before, or doesn't; how many

    follow = lambda state, f: [state[0] + f[1] if f[0] else f[1]]
    return scanned(df, by, at, "open", "long", [np.inf], function, follow, run, length=length)


def lanes(df: DataFrame, by: list[str], start: str, end: str, name: str, width: int = 86_400) -> DataFrame:
    """df with lane: each item takes the first lane that is free at its start, in order of start and name.

    Where an item starts at or after all ends before it, every lane is free, so what lies between such moments may be packed
    apart. They are found by a running maximum of ends over spans of `width`; TOGETHER of them make a task's share."""
    span = F.floor(F.col(start) / width)
    d = running(df, by, span, [start, name], _past=("max_before", F.col(end)))
    d = running(d, by, span, [start, name], _part=("sum", F.coalesce((F.col(start) >= F.col("_past")).cast("long"), F.lit(1))))
    d = d.withColumn("_part", F.floor(F.col("_part") / TOGETHER))
    columns = df.columns

    def fresh() -> Callable[[pd.DataFrame], pd.DataFrame]:
        ends: list[int] = []

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            got = []
            for a, b in zip(pdf[start].tolist(), pdf[end].tolist()):
                lane = next((k for k, e in enumerate(ends) if e <= a), len(ends))
                ends[lane : lane + 1] = [b]
                got.append(lane)
            return pdf[columns].assign(lane=got)

        return step

    return in_order(d.drop("_past"), [*by, "_part"], [start, name], fresh, _with(df, "lane long"))


# --- blocks of samples: rows (track…, block, samples array<float>), blocks of one size


def spectral_reduction(samples: np.ndarray, noise: np.ndarray, size: int = 1024, threshold_db: float = 6.0, floor_db: float = -12.0) -> np.ndarray:
    """Overlap-add noise reduction of one channel; noise: mean power by bin of frames of `size` samples."""
    hop, window = size // 4, np.hanning(size + 1)[:-1]
    padded = np.concatenate([np.zeros(size), samples, np.zeros(2 * size)])
    at = np.arange(0, len(padded) - size + 1, hop)
    spec = np.fft.rfft(padded[at[:, None] + np.arange(size)] * window, axis=1)
    power = np.maximum(np.abs(spec) ** 2, 1e-20)
    clean = np.sqrt(np.clip(1 - noise * 10 ** (threshold_db / 10) / power, 0, 1))
    clean = _boxed(_boxed(clean, 2, 0), 2, 1)
    floor = 10 ** (floor_db / 20)
    frames = np.fft.irfft(spec * (floor + (1 - floor) * clean), size, axis=1) * window
    out, norm = np.zeros(len(padded)), np.zeros(len(padded))
    for k, a in enumerate(at):
        out[a : a + size] += frames[k]
        norm[a : a + size] += window * window
    return (out / np.maximum(norm, 1e-9))[size : size + len(samples)]


def _boxed(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Moving mean over 2 * reach + 1; edges average what exists."""
    total = np.cumsum(np.insert(x, 0, 0, axis=axis), axis=axis)
    n = x.shape[axis]
    a, b = np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n)
    span = (b - a).reshape([-1 if k == axis else 1 for k in range(x.ndim)])
    return (np.take(total, b, axis) - np.take(total, a, axis)) / span


def process_tracks(blocks: DataFrame, by: list[str], at: str, samples: str, kernel) -> DataFrame:
    """Runs kernel(samples of a whole track) on each track's blocks in order; blocks keep their sizes.

    A track is one group, as filters carry state through it; tracks run in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        sizes = [len(x) for x in pdf[samples]]
        out = np.asarray(kernel(np.concatenate([np.asarray(x, float) for x in pdf[samples]])), np.float32)
        ends = np.cumsum([0, *sizes])
        return pdf.assign(**{samples: [out[a:b] for a, b in zip(ends, ends[1:])]})

    return blocks.groupBy(*by).applyInPandas(run, blocks.schema)


def block_powers(blocks: DataFrame, by: list[str], at: str, samples: str, rate: int) -> DataFrame:
    """(by, q, power, peak): K-weighted mean power and true peak of every complete 100 ms of each track.

    The filters' tails are carried from block to block, so a track of any length streams by."""
    from reelspark.functions.effects import Fir, Peaks

    taps, step = audio.impulse(audio.k_weighting(rate), max(64, rate // 4)), rate // 10

    def fresh() -> Callable[[pd.DataFrame], pd.DataFrame]:
        weigh, peaks, state = Fir(taps), Peaks(rate), {"power": np.zeros(0), "peak": np.zeros(0), "q": 0}

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.concatenate([np.asarray(s, float) for s in pdf[samples]])
            power, peak = np.concatenate([state["power"], weigh(x) ** 2]), np.concatenate([state["peak"], peaks(x)])
            n = len(power) // step
            state["power"], state["peak"], first = power[n * step :], peak[n * step :], state["q"]
            state["q"] += n
            head = {c: pdf[c].iloc[0] for c in by}
            return pd.DataFrame({**head, "q": np.arange(first, first + n), "power": power[: n * step].reshape(n, step).mean(axis=1), "peak": peak[: n * step].reshape(n, step).max(axis=1)})

        return run

    schema = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in by) + ", q long, power double, peak double"
    return in_order(blocks.select(*by, at, samples), by, [at], fresh, schema)


def stitched(x: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray], rate: int, block: float = 300.0, preroll: float = 10.0, fade: float = 0.02) -> np.ndarray:
    """A model's output over a long track: blocks of some minutes, each begun earlier so that the model
    settles, and faded into the one before. With one block it is the kernel's own output."""
    size, early, over = int(block * rate), int(preroll * rate), max(1, int(fade * rate))
    out = np.zeros(len(x), np.float32)
    rise = (np.arange(over) + 0.5) / over
    for low in range(0, max(len(x), 1), size):
        begun, high = max(0, low - early), min(len(x), low + size + over)
        y = np.asarray(kernel(x[begun:high]), np.float32)
        if len(y) != high - begun:
            raise ValueError("the model changed the length")
        y = y[low - begun :]
        if low:
            n = min(over, len(y))
            y[:n] = out[low : low + n] * (1 - rise[:n]) + y[:n] * rise[:n]
        out[low:high] = y
    return out


def register_processor(name: str, kernel):
    """A user's kernel (float array to float array) as a function of an array<float> column."""

    @F.pandas_udf("array<float>")
    def udf(x: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in x:
            yield s.map(lambda a: None if a is None else np.asarray(kernel(np.asarray(a, np.float32)), np.float32))

    udf.__name__ = name
    return udf


def limiter(x: np.ndarray, ceiling_db: float, rate: float, lookahead: float = 0.005, release: float = 0.1, true_peak: bool = False) -> np.ndarray:
    """A whole track through the chain's limiter."""
    from reelspark.functions.effects import run_chain

    params = {"ceiling": ceiling_db, "lookahead": 1000 * lookahead, "release": 1000 * release, "true_peak": float(true_peak)}
    return run_chain(x, [{"type": "limiter", "bypass": False, "params": params}], rate)
