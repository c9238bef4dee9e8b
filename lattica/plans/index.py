"""Index algebra of N-d arrays: shapes, strides and basic indexing, on the driver.

NumPy semantics throughout: ``...`` and ``None`` work everywhere, an integer below -N is out of
range, and an empty major slice keeps the other axes' lengths.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from math import prod


def shape_of(shape) -> tuple[int, ...]:
    """An integer or a sequence of integers as a tuple."""
    try:
        return (operator.index(shape),)
    except TypeError:
        out = tuple(operator.index(n) for n in shape)
    if any(n < 0 for n in out):
        raise ValueError("negative dimensions are not allowed")
    return out


def strides_of(shape: tuple[int, ...], order: str = "C") -> tuple[int, ...]:
    """In items."""
    if order == "C":
        return tuple(prod(shape[i + 1 :]) for i in range(len(shape)))
    if order == "F":
        return tuple(prod(shape[:i]) for i in range(len(shape)))
    raise NotImplementedError(f"order {order!r}")


def major_axis(shape: tuple[int, ...], order: str = "C") -> int:
    """The axis that grows: the first in C order, the last in F order."""
    strides_of(shape, order)
    return 0 if order == "C" else len(shape) - 1


@dataclass(frozen=True)
class Axis:
    """One axis of a slice: items start, start + step, ... (n of them); ``axis`` is None for a new one."""

    axis: int | None
    start: int
    step: int
    n: int
    kept: bool = True


def normalised(idx, shape: tuple[int, ...]) -> tuple[Axis, ...]:
    idx = list(idx) if isinstance(idx, tuple) else [idx]
    if sum(i is Ellipsis for i in idx) > 1:
        raise IndexError("an index can only have a single ellipsis")
    named = sum(i is not None and i is not Ellipsis for i in idx)
    if named > len(shape):
        raise IndexError(f"too many indices for array: {named} for {len(shape)} dimensions")
    if not any(i is Ellipsis for i in idx):
        idx.append(Ellipsis)
    at = next(k for k, i in enumerate(idx) if i is Ellipsis)
    idx[at : at + 1] = [slice(None)] * (len(shape) - named)
    out, axis = [], 0
    for i in idx:
        if i is None:
            out.append(Axis(None, 0, 1, 1))
            continue
        n = shape[axis]
        if isinstance(i, slice):
            start, stop, step = i.indices(n)
            out.append(Axis(axis, start, step, len(range(start, stop, step))))
        else:
            try:
                k = operator.index(i)
            except TypeError:
                raise TypeError(f"only integers, slices, None and ... are valid indices, not {type(i).__name__}") from None
            if not -n <= k < n:
                raise IndexError(f"index {k} is out of bounds for axis {axis} with size {n}")
            out.append(Axis(axis, k % n, 1, 1, False))
        axis += 1
    return tuple(out)


def shape_after(axes: tuple[Axis, ...]) -> tuple[int, ...]:
    return tuple(a.n for a in axes if a.kept)


def refined(axes: tuple[Axis, ...], idx) -> tuple[Axis, ...]:
    """The slice ``idx`` of a slice."""
    kept = [a for a in axes if a.kept]
    out = [a for a in axes if not a.kept]
    for i in normalised(idx, tuple(a.n for a in kept)):
        if i.axis is None:
            out.append(i)
            continue
        old = kept[i.axis]
        out.append(Axis(old.axis, old.start + i.start * old.step, old.step * i.step, i.n, i.kept))
    return tuple(out)


def permuted(axes: tuple[Axis, ...], order: tuple[int, ...]) -> tuple[Axis, ...]:
    """The kept axes in another order."""
    kept = [a for a in axes if a.kept]
    if sorted(order) != list(range(len(kept))):
        raise ValueError("axes don't match array")
    return tuple(a for a in axes if not a.kept) + tuple(kept[i] for i in order)


def broadcast_axes(shape: tuple[int, ...], to: tuple[int, ...]) -> tuple[int, ...]:
    """For each axis of ``to``, the C-order stride of ``shape`` stretched over it (0 where it repeats)."""
    lead = len(shape) - len(to)
    if any(n != 1 for n in shape[: max(0, lead)]):
        raise ValueError(f"could not broadcast input array from shape {shape} into shape {to}")
    own = (1,) * max(0, -lead) + shape[max(0, lead) :]
    if any(n not in (1, m) for n, m in zip(own, to, strict=True)):
        raise ValueError(f"could not broadcast input array from shape {shape} into shape {to}")
    strides = strides_of(own)
    return tuple(s if n != 1 else 0 for n, s in zip(own, strides, strict=True))
