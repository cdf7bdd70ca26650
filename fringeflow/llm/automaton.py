"""A finite automaton over the bytes of many texts at once, by transition functions of short cells.

It tells tokens ``[A-Za-z]+|[^A-Za-z]`` and the markers ``<P>``, ``<S>``, ``<M>`` of UTF-8. A cell of bytes is summed up by a function: for each state
the automaton may be in before it, the state after it and what it counts. Functions compose associatively, so cells, and chunks of one text in different
tasks, are scanned without knowing what stands before them.
"""

from __future__ import annotations

import numpy as np

#: Outside a run of letters; in one; after ``<``; after ``<`` and P, S or M, which is in a run of letters too.
OUT, RUN, OPEN, NAMED = range(4)
_SAME, _LETTER, _NAME, _LESS, _MORE, _OTHER = range(6)
CELL = 64
#: What a marker adds to a cell's count, so that tokens and markers are counted in one number.
_MARK = 1 << 8


def _classes() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[0x80:0xC0] = _SAME  # the later bytes of a code point
    for first in b"Aa":
        kinds[first : first + 26] = _LETTER
    kinds[list(b"PSM")] = _NAME
    kinds[ord("<")], kinds[ord(">")] = _LESS, _MORE
    return kinds


def _step(state: int, kind: int) -> tuple[int, int]:
    """The state after a byte, and what it counts."""
    in_run = state in (RUN, NAMED)
    if kind == _SAME:
        return state, 0
    if kind in (_LETTER, _NAME):
        return (NAMED if kind == _NAME and state == OPEN else RUN), int(not in_run)
    return (OPEN if kind == _LESS else OUT), 1 + _MARK * (kind == _MORE and state == NAMED)


KINDS = _classes()
NEXT = np.array([[_step(s, k)[0] for k in range(6)] for s in range(4)], np.uint8).ravel()
COUNT = np.array([[_step(s, k)[1] for k in range(6)] for s in range(4)], np.uint16).ravel()


class Scan:
    """Texts (bytes), each in whole cells of its own: their functions, and where a token starts in them."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        cells = np.maximum(-(-lengths // CELL), 1)
        self.first = np.cumsum(cells) - cells
        padded = np.zeros(int(cells.sum()) * CELL, np.uint8)  # what pads a cell is of the kind that changes nothing
        begin = np.cumsum(lengths) - lengths
        padded[np.arange(lengths.sum()) + np.repeat(self.first * CELL - begin, lengths)] = KINDS[np.frombuffer(b"".join(texts), np.uint8)]
        self.lengths, self.cells, self.kinds = lengths, cells, padded.reshape(-1, CELL)
        state, count = np.tile(np.arange(4, dtype=np.uint8), (len(self.kinds), 1)), np.zeros((len(self.kinds), 4), np.uint16)
        for kind in np.ascontiguousarray(self.kinds.T):
            at = state * np.uint8(6) + kind[:, None]
            count += COUNT[at]
            state = NEXT[at]
        own = np.arange(len(self.kinds)) - np.repeat(self.first, cells)
        self.end, self.tokens, self.marks = compose(state, (count % _MARK).astype(np.int64), (count // _MARK).astype(np.int64), own)

    def functions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text and each state before it: the state after it, tokens started, markers ended."""
        last = self.first + self.cells - 1
        return self.end[last], self.tokens[last], self.marks[last]

    def locate(self, which: np.ndarray, state: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """The byte at which token ``skip`` (from 0) of the texts ``which`` starts, entered in ``state``; the text's length where it has no such token."""
        out = self.lengths[which].copy()
        if not len(which):
            return out
        total = self.tokens[self.first + self.cells - 1]
        live = np.flatnonzero(skip < total[which, state])
        text, state, skip = which[live], state[live], skip[live]
        # all texts' cells as they are entered in each state, made to grow from text to text, so that one search serves all
        found = np.empty(len(live), np.int64)
        for s in range(4):
            own = np.flatnonzero(state == s)
            if len(own):
                base = np.cumsum(total[:, s]) - total[:, s]
                until = self.tokens[:, s] + np.repeat(base, self.cells)
                found[own] = np.searchsorted(until, base[text[own]] + skip[own], side="right")
        inside = found > self.first[text]
        before = np.where(inside, found - 1, found)
        left = skip - np.where(inside, self.tokens[before, state], 0)
        now = np.where(inside, self.end[before, state], state).astype(np.uint8)
        at = np.zeros(len(live), np.int64)
        seen = np.zeros(len(live), np.int64)
        for j, kind in enumerate(np.ascontiguousarray(self.kinds[found].T)):
            step = now * np.uint8(6) + kind
            starts = COUNT[step] % _MARK > 0
            at[starts & (seen == left)] = j
            seen += starts
            now = NEXT[step]
        out[live] = (found - self.first[text]) * CELL + at
        return out


def compose(end: np.ndarray, tokens: np.ndarray, marks: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Functions of everything from a group's first piece to each piece, ``before`` telling how many pieces of its group stand before it; pieces are in order."""
    reach, far = 1, int(before.max(initial=0))
    while reach <= far:
        at = np.flatnonzero(before >= reach)
        left = end[at - reach]
        tokens, marks, end = tokens.copy(), marks.copy(), end.copy()
        new = [(a[at - reach] + np.take_along_axis(a[at], left.astype(np.int64), 1)) for a in (tokens, marks)]
        new_end = np.take_along_axis(end[at], left.astype(np.int64), 1)
        tokens[at], marks[at], end[at] = new[0], new[1], new_end
        reach *= 2
    return end, tokens, marks
