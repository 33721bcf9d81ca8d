"""N-U1 / N-U2: detectors and surrogates supplied by a user, named in the rule document."""

from __future__ import annotations

DETECTORS: dict = {}
SURROGATES: dict = {}


def register_detector(name: str, fn) -> None:
    """``fn(text: Column, params: dict) -> Column`` of sorted ``array<struct<start,end,label>>``.

    The function may use built-in expressions or wrap a pandas UDF; the engine does the
    overlap test, numbering and splicing.
    """
    DETECTORS[name.lower()] = fn


def register_surrogate(name: str, fn) -> None:
    """``fn(draw, params: dict) -> Column`` where ``draw(slot, n)`` is a number below n."""
    SURROGATES[name.lower()] = fn
