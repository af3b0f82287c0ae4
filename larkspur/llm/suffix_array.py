"""Suffix arrays in numpy: Larsson-Sadakane refinement, common prefixes after Kasai, and runs of equal windows."""

from __future__ import annotations

import numpy as np

_LANE = 256


def words_at(raw: np.ndarray) -> np.ndarray:
    """For every byte the 8 bytes from there on as one big-endian number, as if zeros followed the text."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    view = np.ndarray((len(raw),), ">u8", padded.tobytes(), 0, (1,))
    return view.astype(np.uint64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. Byte 255, which UTF-8 never has, stands behind the text and ends comparisons.

    Larsson and Sadakane's refinement: suffixes that agree in d bytes form a group; only groups of several are
    sorted again, by the group of the suffix d bytes on, so each round doubles d.
    """
    raw = np.append(text, np.uint8(255))
    n = len(raw)
    first = words_at(raw)
    order = np.argsort(first, kind="stable")
    key = first[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    d = 8
    while d < n:
        single = head & np.append(head[1:], True)
        open_at = np.nonzero(~single)[0]
        if not len(open_at):
            break
        members = order[open_at]
        after = members + d
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[members]
        by = np.argsort(group * (n + 1) + second, kind="stable")
        members, second, group = members[by], second[by], group[by]
        order[open_at] = members
        split = np.ones(len(members), bool)
        split[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        head[open_at] = split
        rank[members] = np.maximum.accumulate(np.where(split, open_at, 0))
        d *= 2
    return order[order < len(text)]


def common_prefixes(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order, up to most.

    Kasai's rule, that the next position in the text shares at least one byte less, in many lanes at once: each lane
    walks through its own stretch of the text.
    """
    n = len(raw)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    words = words_at(raw)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    starts = np.arange(0, n, _LANE)
    have = np.zeros(len(starts), np.int64)
    by_text = np.zeros(n, np.int64)
    for t in range(min(_LANE, n)):
        here = starts + t
        if here[-1] >= n:
            starts, have, here = starts[:-1], have[:-1], here[:-1]
        there = before[here]
        have = np.maximum(have - 1, 0)
        have[there < 0] = 0
        open_at = np.nonzero((there >= 0) & (have < most))[0]
        while len(open_at):
            x, y = here[open_at] + have[open_at], there[open_at] + have[open_at]
            inside = np.minimum(n - np.maximum(x, y), 8)
            differ = words[np.minimum(x, n - 1)] ^ words[np.minimum(y, n - 1)]
            top = np.zeros(len(differ), np.int64)
            some = differ > 0
            top[some] = (np.frexp(differ[some].astype(np.float64))[1] + 7) // 8
            equal = np.minimum(np.where(some, 8 - np.minimum(top, 8), 8), np.maximum(inside, 0))
            have[open_at] += equal
            open_at = open_at[(equal == 8) & (have[open_at] < most)]
        by_text[here] = np.minimum(have, most)
    out[1:] = by_text[order[1:]]
    return out


def window_groups(raw: np.ndarray, valid: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid starts in suffix order, and for each the number of its group of equal windows of span bytes."""
    order = suffix_array(raw)
    shared = common_prefixes(raw, order, span)
    group = np.cumsum(shared < span)
    keep = valid[order]
    return order[keep], group[keep]
