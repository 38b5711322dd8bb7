"""Brackets of many strings at a time: their characters stand in one array, with the number of each one's string."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters, the number of each one's text, and each text's first place; with the end behind the last."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.repeat(np.arange(len(texts)), sizes), first


def steps(chars: np.ndarray, opening: str, closing: str) -> np.ndarray:
    """1 where a bracket opens, -1 where one closes, else 0."""
    among = lambda kinds: np.isin(chars, np.array([ord(c) for c in kinds], np.uint32))
    return among(opening).astype(np.int64) - among(closing)


def surplus(step: np.ndarray, of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a bracket closes where nothing of its text is open: the depth falls under 0 and under all before it."""
    depth = np.cumsum(step)
    depth -= np.concatenate([[0], depth])[first[of]]
    apart = 2 * int(np.diff(first).max(initial=0)) + 2  # each text's depths lie under those of all texts before
    low = np.minimum.accumulate(np.minimum(depth, 0) - of * apart) + of * apart
    before = np.concatenate([[0], low[:-1]])
    before[first[:-1][np.diff(first) > 0]] = 0
    return (step < 0) & (depth < np.minimum(before, 0))


def alone(step: np.ndarray, of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a bracket has no partner."""
    n = len(first) - 2
    return surplus(step, of, first) | surplus(-step[::-1], n - of[::-1], len(step) - first[::-1])[::-1]


def pairs(step: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of brackets that all have partners, the places of both ends of each pair, by text and by level."""
    at = np.flatnonzero(step)
    level = np.cumsum(step)[at] + (step[at] < 0)
    order = at[np.lexsort((level, of[at]))]  # stable: on a level brackets open and close in turns
    return order[::2], order[1::2]


def balanced_pairs(texts: list[str], opening: str, closing: str) -> tuple[np.ndarray, ...]:
    """Of the texts in which all brackets have partners: step, first places, and the pairs' texts and both places."""
    chars, of, first = characters(texts)
    step = steps(chars, opening, closing)
    bad = np.zeros(len(texts), bool)
    bad[of[alone(step, of, first)]] = True
    step[bad[of]] = 0
    i, j = pairs(step, of)
    return step, first, of[i], i, j, bad


def ascii_strings(chars: np.ndarray, first: np.ndarray) -> pa.Array:
    """Strings of ASCII characters that stand in one array."""
    return pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(chars.astype(np.uint8)))
