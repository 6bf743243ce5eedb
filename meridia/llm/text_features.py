"""Counts of characters and words that the classifiers build their features from."""

from __future__ import annotations

import numpy as np

#: Classes of bytes; bytes of 128 and more are letters for these purposes.
CLASSES = ("upper", "lower", "digit", "space", "line", "bang", "symbol", "bar", "point", "other")


def _table() -> np.ndarray:
    at = {c: k for k, c in enumerate(CLASSES)}
    table = np.full(256, at["other"], np.uint8)
    for chars, name in (
        (range(ord("A"), ord("Z") + 1), "upper"),
        (range(ord("a"), ord("z") + 1), "lower"),
        (range(128, 256), "lower"),
        (range(ord("0"), ord("9") + 1), "digit"),
        (b" \t\r\x0b\x0c", "space"),
        (b"\n", "line"),
        (b"!", "bang"),
        (b"$%&#*@^~", "symbol"),
        (b"|", "bar"),
        (b".,;:?'\"()-", "point"),
    ):
        table[list(chars)] = at[name]
    return table


_TABLE = _table()


def byte_classes(raw: bytes) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES)).astype(float)
