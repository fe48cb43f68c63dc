"""Feature mapping: a declared plan is compiled to column expressions, and back.

A feature is either a renamed origin vector or slices of origin vectors in order. Actions may be relative to the state (deltas). States and
actions are padded joint by joint to fixed sizes with masks of what is real.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions import normalize as N
from episodica.functions import vectors as V
from episodica.functions.normalize import Scaling, normalized, unnormalized

#: Columns that pass through every mapping where present.
ALWAYS_KEPT = ("timestamp", "frame_index", "episode_index", "task_index", "task", "action_is_pad")
#: Joints whose actions are never relative.
NEVER_RELATIVE = ("end.position", "effector.position")


@dataclass(frozen=True)
class Piece:
    """origin[start:end]."""

    origin: str
    start: int
    end: int


@dataclass(frozen=True)
class Feature:
    """A target vector: of a whole origin column (a name) or of pieces, in order."""

    target: str
    source: str | tuple[Piece, ...]
    relative_to: str | None = None

    def __post_init__(self) -> None:
        if self.relative_to and self.target.removeprefix("action.") in NEVER_RELATIVE:
            raise ValueError(f"{self.target} can't be relative")

    def origins(self) -> list[str]:
        return [self.source] if isinstance(self.source, str) else [p.origin for p in self.source]


@dataclass(frozen=True)
class FeatureMap:
    """Features, in the order in which they were declared."""

    features: tuple[Feature, ...]
    sizes: Mapping[str, int] = field(default_factory=dict)

    def check(self, declared: Sequence[str]) -> None:
        """Every target must be declared."""
        if unknown := [f.target for f in self.features if f.target not in declared]:
            raise ValueError(f"not declared: {unknown}")

    def forward(self, df: DataFrame) -> DataFrame:
        """The mapped features whose origins exist, and the columns that always stay."""
        have = set(df.columns)
        out = [F.col(c) for c in ALWAYS_KEPT if c in have]
        for f in self.features:
            if not set(f.origins()) <= have:
                continue
            x = F.col(f"`{f.source}`") if isinstance(f.source, str) else V.cut_concat([(F.col(f"`{p.origin}`"), p.start, p.end) for p in f.source])
            out.append(x.alias(f.target))
        return df.select(*out)

    def backward(self, df: DataFrame, origins: Sequence[str]) -> DataFrame:
        """Origin vectors again, from the slices of the targets in the order of their places in the origin."""
        parts: dict[str, list[tuple[int, str, int, int]]] = {o: [] for o in origins}
        whole: dict[str, str] = {}
        for f in self.features:
            if isinstance(f.source, str):
                whole[f.source] = f.target
                continue
            at = 0
            for p in f.source:
                if p.origin not in parts:
                    raise ValueError(f"unknown target {p.origin}")
                parts[p.origin].append((p.end, f.target, at, at + p.end - p.start))
                at += p.end - p.start
        cols = [F.col(f"`{whole[o]}`").alias(o) if o in whole else V.cut_concat([(F.col(f"`{t}`"), a, b) for _, t, a, b in sorted(parts[o])]).alias(o) for o in origins if o in whole or parts[o]]
        return df.select(*(F.col(c) for c in ALWAYS_KEPT if c in df.columns), *cols)


def from_config(rows: Sequence[Mapping[str, object]]) -> tuple[FeatureMap, dict[str, bool]]:
    """A feature map and which targets are relative, from rows of target, origin, start, end, position, subtract_state.

    Rows of one target are its pieces in the order of position; a row without start is the whole origin. Targets keep the order in which they
    first appear; an origin may be used any number of times.
    """
    pieces: dict[str, list[Mapping[str, object]]] = {}
    for r in rows:
        pieces.setdefault(str(r["target"]), []).append(r)
    features, relative = [], {}
    for target, own in pieces.items():
        own = sorted(own, key=lambda r: int(r.get("position") or 0))  # type: ignore[call-overload]
        flags = {bool(r.get("subtract_state")) for r in own}
        if len(flags) > 1:
            raise ValueError(f"{target} is relative in part")
        relative[target] = flags.pop()
        whole = own[0].get("start") is None
        if whole and len(own) > 1:
            raise ValueError(f"{target} has a whole origin among pieces")
        source = str(own[0]["origin"]) if whole else tuple(Piece(str(r["origin"]), int(r["start"]), int(r["end"])) for r in own)  # type: ignore[call-overload]
        features.append(Feature(target, source, "state" if relative[target] else None))
    return FeatureMap(tuple(features)), relative


def to_delta(chunk: Column, state: Column, horizon: int | None = None, size: int = 0) -> Column:
    """Each action of a chunk less the state. Chunks of `horizon` actions of `size` components come from generated code."""
    out = F.transform(chunk, lambda a: V.subtract(a, state))
    if not horizon:
        return out
    return F.when(_sized(state, chunk, size, horizon), _unrolled(state, chunk, size, horizon, lambda a, b: [x - y for x, y in zip(a, b, strict=True)])).otherwise(out)


def from_delta(chunk: Column, state: Column) -> Column:
    return F.transform(chunk, lambda a: V.add(a, state))


def joined_joints(joints: Sequence[tuple[Column | None, int]]) -> Column:
    """Joint vectors in order, each padded with zeros to its greatest size; an absent joint (None) is zeros. Size 0 drops a joint."""
    zero = F.lit(0.0)
    return F.concat(*(F.array_repeat(zero, n) if x is None else V.pad_right(x, n, zero) for x, n in joints if n))


def joint_mask(joints: Sequence[tuple[int, int]]) -> Column:
    """true for the real places of joints of (real size, greatest size)."""
    return F.array(*(F.lit(i < real) for real, n in joints for i in range(n)))


def split_joints(x: Column, mask: Column, sizes: Sequence[int]) -> list[Column]:
    """The real places of a padded vector, cut into joints."""
    real, out, at = V.keep_masked(x, mask), [], 0
    for n in sizes:
        out.append(V.cut(real, at, at + n))
        at += n
    return out


def _sized(state: Column, chunk: Column, size: int, horizon: int, at_least: bool = False) -> Column:
    """Whether a chunk has `horizon` actions, and they and the state the size (or at least that)."""
    enough = lambda v: F.size(v) >= size if at_least else F.size(v) == size
    out = (F.size(chunk) == horizon) & enough(state)
    for h in range(horizon):
        out = out & enough(F.get(chunk, F.lit(h)))
    return out


def _unrolled(state: Column, chunk: Column, size: int, horizon: int, one: Callable[[list[Column], list[Column]], list[Column]]) -> Column:
    """one(components of an action, components of the state) of each action, without a lambda."""
    parts = lambda v: [F.get(v, F.lit(i)) for i in range(size)]
    return F.array(*(F.array(*one(parts(F.get(chunk, F.lit(h))), parts(state))) for h in range(horizon)))


def apply(state: Column, chunk: Column, scalings: Mapping[str, Scaling], greatest: int, relative: bool, horizon: int | None = None) -> tuple[Column, Column, Column]:
    """State, action chunk and mask as a model takes them: relative to the state, normalized, padded with zeros.

    Of chunks of `horizon` actions of the statistics' size the results are the same, but come from generated code.
    """
    s, pad = scalings["action"], lambda v: V.bound(v, lambda w: V.pad_right(w, greatest, F.lit(0.0)))
    acts = F.transform(to_delta(chunk, state) if relative else chunk, lambda a: pad(normalized(a, s)))
    if horizon and s.stats:
        n = len(next(iter(s.stats.values())))
        one = lambda a, b: N.each([x - y for x, y in zip(a, b, strict=True)] if relative else a, s) + [F.lit(0.0)] * (greatest - n)
        acts = F.when(_sized(state, chunk, n, horizon), _unrolled(state, chunk, n, horizon, one)).otherwise(acts)
    return pad(normalized(state, scalings["state"])), acts, F.transform(F.sequence(F.lit(0), F.lit(greatest - 1)), lambda i: i < F.size(state))


def unapply(state: Column, acts: Column, scalings: Mapping[str, Scaling], size: int, relative: bool, horizon: int | None = None) -> tuple[Column, Column]:
    """The inverse of apply. As there, chunks of `horizon` actions come from generated code."""
    s = V.bound(V.cut(state, 0, size), lambda v: unnormalized(v, scalings["state"]))
    one = lambda v: V.bound(V.cut(v, 0, size), lambda w: unnormalized(w, scalings["action"]))
    back = V.bound(s, lambda b: F.transform(acts, lambda v: V.add(one(v), b))) if relative else F.transform(acts, one)
    if horizon and scalings["action"].stats and size == len(next(iter(scalings["action"].stats.values()))):
        def both(a, b):
            a, b = N.each(a, scalings["action"], True), N.each(b, scalings["state"], True)
            return [x + y for x, y in zip(a, b, strict=True)] if relative else a

        back = F.when(_sized(state, acts, size, horizon, True), _unrolled(state, acts, size, horizon, both)).otherwise(back)
    return s, back
