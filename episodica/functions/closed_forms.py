"""Closed forms: rotations, grippers, embeddings, schedules, guidance weights, parsing of settings, cost models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of booleans.
TRUE_WORDS, FALSE_WORDS = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")


def axis_angle(x: Column, y: Column, z: Column, w: Column) -> Column:
    """array(3) of a quaternion's rotation; zeros where the rotation is none."""
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w))
    den = F.sqrt(1 - w * w)
    scale = F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(2 * F.acos(w), den))
    return F.array(x * scale, y * scale, z * scale)


def negative_log(p: Column) -> Column:
    """-ln p: infinite for 0 and not a number below it, where Spark's log is null and a mean would pass over the row."""
    return F.when(p == 0, F.lit(float("inf"))).when(p < 0, F.lit(float("nan"))).otherwise(-F.log(p))


def gripper(x: Column, low: float = 0.0, high: float = 1.0, binary: bool = True, invert: bool = False) -> Column:
    """Rescaled from [low, high] to [-1, 1], maybe to its sign, maybe turned round."""
    out = 2 * (x - low) / (high - low) - 1
    out = F.signum(out) if binary else out
    return -out if invert else out


def sinusoid(pos: Column, size: int, least: float, greatest: float) -> Column:
    """sin of size / 2 geometric periods between least and greatest, then their cos."""
    if size % 2:
        raise ValueError("size must be even")
    half = size // 2
    frac = lambda i: i.cast("double") / max(half - 1, 1)
    angle = lambda i: pos * (2 * math.pi) / (F.lit(least) * F.pow(F.lit(greatest / least), frac(i)))
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(steps, lambda i: F.sin(angle(i))), F.transform(steps, lambda i: F.cos(angle(i))))


def truth(s: Column) -> Column:
    """A boolean by the accepted spellings; null for others."""
    low = F.lower(s)
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def typed(s: Column) -> Column:
    """struct(as_bool, as_long, as_double, as_text): true and false in any case, digits, digits with one dot; others are text."""
    whole, dotted = s.rlike("^[0-9]+$"), s.rlike("^(?:[0-9]+[.][0-9]*|[.][0-9]+)$")
    flag = F.lower(s).isin("true", "false")
    return F.struct(F.when(flag, F.lower(s) == "true").alias("as_bool"), F.when(whole, s.try_cast("long")).alias("as_long"), F.when(dotted, s.try_cast("double")).alias("as_double"), F.when(~flag & ~whole & ~dotted, s).alias("as_text"))


def html_escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def slug(s: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(s), r"[ \n.]", "_"), 1, 50)


def shifted_sigma(sigma: Column, shift: float) -> Column:
    return shift * sigma / (1 + (shift - 1) * sigma)


def prefix_weight(i: Column, start: int, end: int, total: int, schedule: str = "exp") -> Column:
    """Weight of place i of a chunk of total places: 1 before start, falling to 0 at end."""
    end = max(0, min(end, total))
    start = min(max(0, start), end)
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (start - 1 - i) / F.lit(float(end - start + 1)) + 1))
    kinds = {
        "zeros": F.when(i < start, 1.0).otherwise(0.0),
        "ones": F.lit(1.0),
        "linear": c,
        "exp": c * F.expm1(c) / F.lit(math.e - 1),
    }
    if schedule not in kinds:
        raise ValueError(f"unknown schedule {schedule}")
    return F.when(i >= end, F.lit(0.0)).otherwise(kinds[schedule])


def guidance(tau: Column, most: float) -> Column:
    """min(most, (1 - tau) / tau * ((1 - tau)^2 + tau^2) / (1 - tau)^2); most at 0, and 0 at 1, where the first factor is 0."""
    q = (1 - tau) * (1 - tau)
    return F.when(tau == 1, F.lit(0.0)).otherwise(F.least(F.lit(most), F.coalesce(F.try_divide((1 - tau), tau) * F.try_divide(q + tau * tau, q), F.lit(most))))


def learning_rate(step: Column, kind: str, peak: float, warmup: int, total: int, floor: float = 1e-7, start: float = 0.0, drop: float = 0.2) -> Column:
    """Linear warm-up from start to peak, then: constant; linear to 0 at total, but not below floor; half a cosine to floor at total, floor after
    it; or two stages, peak and from total on drop * peak.
    """
    up = start + (peak - start) * step / F.lit(float(max(warmup, 1)))
    frac = (step - warmup) / F.lit(float(max(total - warmup, 1)))
    down = {
        "constant": F.lit(peak),
        "linear": F.greatest(F.lit(floor), peak * (total - step) / F.lit(float(max(total - warmup, 1)))),
        "cosine": F.when(step > total, F.lit(floor)).otherwise(floor + (peak - floor) * 0.5 * (1 + F.cos(frac * math.pi))),
        "two_stage": F.when(step >= total, F.lit(drop * peak)).otherwise(F.lit(peak)),
    }
    if kind not in down:
        raise ValueError(f"unknown schedule {kind}")
    return F.when(step < warmup, up).otherwise(down[kind])


def batch_plan(micro: int, max_len: int, global_batch: int, ranks: int) -> tuple[int, int]:
    """Tokens of a micro-batch and micro-batches of a step."""
    return micro * max_len, global_batch // (micro * ranks)


def train_steps(n_samples: int, global_batch: int, epochs: int) -> int:
    return n_samples // global_batch * epochs


def flops(sum_len: Column, sum_len2: Column, parameters: float, layers: int, heads: int, head_dim: int) -> Column:
    """6 N tokens + 12 layers heads head_dim sum(len^2)."""
    return 6.0 * parameters * sum_len + F.lit(12.0 * layers * heads * head_dim) * sum_len2


def warmed_budget(step: Column, target: int, warmup: int, start: int) -> Column:
    """Token budget that grows to target in warmup steps, by whole numbers."""
    grown = F.call_function("div", (target - start) * step.cast("long"), F.lit(max(warmup, 1)).cast("long")) + start
    return F.when((step <= warmup) & F.lit(warmup > 0), grown).otherwise(F.lit(target).cast("long"))


def wildcard(pattern: str) -> str:
    """A dotted name pattern, * for a number, as an anchored regular expression."""
    import re

    return "^" + re.escape(pattern).replace(r"\*", "([0-9]+)") + "$"


def matching_index(name: Column, patterns: Sequence[str]) -> Column:
    """The first pattern that matches, from 0; -1 for none."""
    out = F.lit(-1)
    for i in reversed(range(len(patterns))):
        out = F.when(name.rlike(wildcard(patterns[i])), F.lit(i)).otherwise(out)
    return out


def resize_plan(height: Column, width: Column, to_height: int, to_width: int, centred: bool = False) -> Column:
    """struct(height, width, top, left) of an image scaled to fit, its ratio kept, and where padding puts it: at the end, or centred."""
    ratio = F.greatest(width / F.lit(float(to_width)), height / F.lit(float(to_height)))
    h, w = F.floor(height / ratio).cast("int"), F.floor(width / ratio).cast("int")
    top, left = F.lit(to_height) - h, F.lit(to_width) - w
    if centred:
        top, left = F.floor(top / 2).cast("int"), F.floor(left / 2).cast("int")
    return F.struct(h.alias("height"), w.alias("width"), top.alias("top"), left.alias("left"))
