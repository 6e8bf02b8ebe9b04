"""Decoders of the three published compressions of peak arrays: linear prediction, positive integers, short logarithms."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Terms of the compressions, without and with zlib around them.
TERMS = {"MS:1002312": "linear", "MS:1002313": "integer", "MS:1002314": "logarithm", "MS:1002746": "linear", "MS:1002747": "integer", "MS:1002748": "logarithm"}
ZIPPED = {"MS:1002746", "MS:1002747", "MS:1002748"}


def integers(raw: bytes) -> Iterator[int]:
    """Signed integers of half bytes: the first tells how many leading ones are all 0 (up to 8) or all F (above), the
    others follow from the lowest. A last half byte of 0 only fills the byte."""
    halves = [h for b in raw for h in (b >> 4, b & 15)]
    at = 0
    while at < len(halves):
        head = halves[at]
        if at == len(halves) - 1 and head == 0:
            return
        left = head if head <= 8 else head - 8
        own = halves[at + 1 : at + 9 - left]
        value = sum(h << (4 * i) for i, h in enumerate(own))
        if head > 8:
            value -= 1 << (4 * len(own))
        at += 1 + len(own)
        yield value


def linear(raw: bytes) -> list[float]:
    """Two values as they are, then differences from the line through the last two; all over a fixed point."""
    if len(raw) < 12:
        return []
    point = struct.unpack(">d", raw[:8])[0]
    out = [struct.unpack("<I", raw[k : k + 4])[0] for k in range(8, min(len(raw), 16), 4)]
    for d in integers(raw[16:]):
        out.append(2 * out[-1] - out[-2] + d)
    return [v / point for v in out]


def logarithm(raw: bytes) -> list[float]:
    point = struct.unpack(">d", raw[:8])[0] if len(raw) >= 8 else 1.0
    return (np.expm1(np.frombuffer(raw[8 : len(raw) - len(raw) % 2], "<u2") / point)).tolist()


def decode(raw: bytes, terms: set[str]) -> list[float] | None:
    """Values of an array with these terms; None if none of them is a compression of this kind."""
    kind = next((TERMS[t] for t in sorted(terms) if t in TERMS), None)
    if kind is None:
        return None
    raw = zlib.decompress(raw) if terms & ZIPPED or "MS:1000574" in terms else raw
    return {"linear": linear, "logarithm": logarithm, "integer": lambda r: [float(v) for v in integers(r)]}[kind](raw)
