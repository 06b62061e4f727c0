"""Sample by sample transforms: Column to Column, so Catalyst fuses any chain of them into one projection."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def max_value(bits: int) -> int:
    """Largest sample; ranges are symmetric."""
    return 2 ** (bits - 1) - 1


def clip(x: Column, most: float) -> Column:
    return F.least(F.greatest(x, F.lit(-most)), F.lit(most))


def truncate(x: Column) -> Column:
    """Towards zero, as an integer sample."""
    return x.cast("int")


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero at that many digits, by a whole multiple: round() goes by a double's shortest decimal text, which may be a tie where the double itself is none."""
    return F.round(x * 10.0**digits) / 10.0**digits


def scale(x: Column, factor: float, offset: float = 0, most: float = 32767) -> Column:
    """The offset is added before the factor applies."""
    return truncate(clip((x + offset) * F.lit(float(factor)), float(most)))


def invert(x: Column) -> Column:
    return -x


def to_unsigned_dac(x: Column) -> Column:
    return F.pmod(x + 32768, F.lit(65536))


def convert_bits(x: Column, from_bits: int, to_bits: int, gain: float = 1.0) -> Column:
    """Between the ranges of two bit depths; equal depths without gain leave the plan alone."""
    if from_bits == to_bits and gain == 1.0:
        return x
    top = float(max_value(to_bits))
    return clip(x.cast("double") * gain * top / float(max_value(from_bits)), top).cast("long" if to_bits > 31 else "int")


def to_float(x: Column, bits: int = 16) -> Column:
    return x / F.lit(float(max_value(bits)))


def from_float(x: Column, bits: int = 16) -> Column:
    return truncate(clip(x * float(max_value(bits)), float(max_value(bits))))


#: Volume curves: what a dial value of 0..1 does to the amplitude.
def linear_curve(v: float) -> float:
    return min(max(v, 0.0), 1.0)


def logarithmic_curve(v: float, middle: float = 0.1) -> float:
    b = (1 / middle - 1) ** 2
    a = 1 / (b - 1)
    return a * b**v - a


def exponential_curve(v: float) -> float:
    return 2**v - 1


def pot_curve(v: float, x: float = 0.5, y: float = 0.1) -> float:
    return v * y / x if v <= x else y + (v - x) * (1 - y) / (1 - x)


def volume(x: Column, dial: float, curve: Callable[[float], float] = pot_curve, boost: bool = False, most: float = 32767) -> Column:
    """The dial is taken to two decimals; with boost it may exceed 1, is linear and isn't clipped."""
    dial = round(dial, 2)
    factor = dial if boost else curve(linear_curve(dial))
    y = x * F.lit(float(factor))
    return truncate(y if boost else clip(y, float(most)))


def boost(x: Column, factor: float, most: float = 32767) -> Column:
    return truncate(clip(x * F.lit(float(factor)), float(most)))


def distortion(x: Column, threshold: int = 4990, most: int = 6500) -> Column:
    return F.when(x > threshold, most).when(x < -threshold, -most).otherwise(x)


def fuzz(x: Column, effect: float = 6.5, most: int = 300) -> Column:
    """Clipped after the first gain, gained again and mapped onto -most..most."""
    y = clip(x * F.lit(float(effect)), 32767.0) * float(effect)
    return truncate((y + 32768.0) * float(2 * most) / 65536.0 - float(most))


def triangle(frame_no: Column, half: int) -> Column:
    """0, 1, ..., half, half - 1, ..., 0, 1, ..."""
    at = F.pmod(frame_no, F.lit(2 * half))
    return F.when(at <= half, at).otherwise(2 * half - at)


def tremolo(x: Column, frame_no: Column, rate: int, ms: int = 2000, depth: float = 0.5) -> Column:
    """A triangle between 1 - depth and 1, in closed form, so that no state is needed."""
    half = max(1, rate * ms // 1000 // 2)
    return truncate(x * (F.lit(1 - depth) + F.lit(depth / half) * triangle(frame_no, half)))


def fade_in(x: Column, frame_no: Column, frames: int) -> Column:
    return truncate(x * F.least(F.lit(1.0), frame_no / F.lit(float(frames))))


def smooth_start(x: Column, frame_no: Column, step: float = 0.01) -> Column:
    """Frames are weighed by k * step until that reaches 0.8."""
    factor = frame_no * F.lit(step)
    return truncate(F.when(factor < 0.8, x * factor).otherwise(x.cast("double")))


def map_range(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """x of the range low..high at the same place of the range to_low..to_high; what lies outside stays outside."""
    if low == high:
        raise ValueError("the range has no length")
    return (x - F.lit(float(low))) * F.lit(float(to_high - to_low)) / F.lit(float(high - low)) + F.lit(float(to_low))


def decibel(ratio: Column) -> Column:
    """-1000 for silence."""
    return F.when(ratio > 0, 20 * F.log10(ratio)).otherwise(-1000.0)


def midi_to_hz(note: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (note - 69) / 12.0)


def hz_to_midi(hz: Column) -> Column:
    return F.when(hz > 0, F.round(69 + 12 * F.log2(hz / 440.0)).cast("int"))


def to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1 + hz / 700.0)


def affine_quantise(x: Column, scale_: float, zero: int) -> Column:
    return F.least(F.greatest(F.round(x / scale_).cast("int") + zero, F.lit(-128)), F.lit(127))


#: Cosine windows as their terms: a0 - a1 cos(t) + a2 cos(2t) - a3 cos(3t). The results depend on these fixed values.
COSINE_WINDOWS = {
    "hamming": (0.54, 0.46),
    "hann": (0.54, 0.54),
    "blackman": (0.42323, 0.49755, 0.07922),
    "nuttall": (0.355768, 0.487396, 0.144232, 0.012604),
    "blackman_nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flat_top": (0.2810639, 0.5208972, 0.1980399),
}


def window_factor(name: str, i: Column, n: int) -> Column:
    """Weight of sample i of n; the second half mirrors the first, and no weight exceeds 1."""
    k = F.when(i <= n // 2, i).otherwise(n - i - 1).cast("double")
    if name == "rectangle":
        y = F.lit(1.0)
    elif name == "triangle":
        y = 1 - F.abs((k - 1 - (n - 1) / 2.0) / ((n - 1) / 2.0))
    elif name == "welch":
        y = 1 - F.pow((k - 1 - (n - 1) / 2.0) / ((n - 1) / 2.0), 2)
    else:
        t = k * (2 * math.pi / (n - 1))
        y = F.lit(0.0)
        for m, a in enumerate(COSINE_WINDOWS[name]):
            y = y + F.lit((-1) ** m * a) * F.cos(t * m)
    return F.least(y, F.lit(1.0))


#: Names of the notes of an octave (fixed values).
NOTES = ("C", "CS", "D", "DS", "E", "F", "FS", "G", "GS", "A", "AS", "B")


def note_name(hz: Column) -> Column:
    """Name and octave (0 to 8) of the note whose frequency is nearest; of two equally near ones the lower."""
    low = F.least(F.greatest(F.floor(12 * F.log2(hz / 440.0) + 57), F.lit(0)), F.lit(107))
    high = F.least(low + 1, F.lit(107))
    pitch = lambda k: 440.0 * F.pow(F.lit(2.0), (k - 57) / 12.0)
    best = F.when(pitch(high) - hz < F.abs(hz - pitch(low)), high).otherwise(low)
    name = F.get(F.array(*map(F.lit, NOTES)), F.pmod(best, F.lit(12)).cast("int"))
    return F.when(hz > 0, F.concat(name, F.floor(best / 12).cast("string")))


def scaled_parameter(value: Column, low: float, high: float) -> Column:
    """A parameter moved by low * (high - low)."""
    return value + F.lit(low * (high - low))


#: Harmonics of the modulation shapes: number, and the weight of the k-th (fixed values).
SHAPES = {
    "triangle": [(2 * j + 1, (-1.0) ** j / (2 * j + 1)) for j in range(35)],
    "square": [(2 * j + 1, 1.0 / (2 * j + 1)) for j in range(35)],
    "saw": [(j, (-1.0) ** j / j) for j in range(1, 11)],
    "sine": [(1, 1.0)],
}


def lfo(kind: str, frame_no: Column, hz: int, rate: int) -> Column:
    """A modulation signal as a sum of harmonics; `off_sine` lies in 0..1, `ramp` rises from 0 to 1, `one` is constant."""
    i = F.pmod(frame_no * hz, F.lit(rate))
    if kind == "one":
        return F.lit(1.0)
    if kind == "ramp":
        return i / F.lit(float(rate))
    if kind == "off_sine":
        return (lfo("sine", frame_no, hz, rate) + 1) * 0.5
    t = i * F.lit(2 * math.pi / rate)
    return sum((F.lit(a) * F.sin(t * n) for n, a in SHAPES[kind]), F.lit(0.0))


def affine_dequantise(q: Column, scale_: float, zero: int) -> Column:
    """What affine_quantise() gave, but for its rounding."""
    return (q - zero) * F.lit(float(scale_))
