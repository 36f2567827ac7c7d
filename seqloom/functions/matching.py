"""The ratio of matching characters by longest blocks, for many first texts against one second text.

The blocks of two texts are the longest common one, which begins earliest in the first text and then earliest in
the second, and those of what lies left and right of it in both; the ratio is twice their length over that of the
texts. In second texts of 200 characters and more, characters that make up over one in a hundred begin no block
and only prolong one.

A second text is indexed once: a suffix automaton, whose states know the earliest end of their strings, finds the
longest block with a first text in one walk over it. Parts of the second text have automata of their own, made when
a first text asks for them and kept for the others.
"""

from __future__ import annotations

from collections import Counter

#: From this length on frequent characters begin no block; frequent are those above one in so many.
LONG, FREQUENT = 200, 100
#: Automata that a text keeps.
_KEPT = 256


class _Automaton:
    """Of text[low:high], without strings that hold a barred character."""

    __slots__ = ("first", "length", "link", "step")

    def __init__(self, text: str, low: int, high: int, barred: set[str]):
        self.step, self.link, self.length, self.first = [{}], [-1], [0], [-1]
        last = 0
        for at in range(low, high):
            last = 0 if text[at] in barred else self._extended(last, text[at], at)

    def _state(self, length: int, first: int, step: dict, link: int) -> int:
        self.length.append(length)
        self.first.append(first)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _parted(self, p: int, q: int, c: str) -> int:
        """The state of p's strings with c, split from q if that holds longer ones too."""
        if self.length[p] + 1 == self.length[q]:
            return q
        part = self._state(self.length[p] + 1, self.first[q], dict(self.step[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = part
            p = self.link[p]
        return part

    def _extended(self, last: int, c: str, at: int) -> int:
        known = self.step[last].get(c)
        if known is not None:  # only after a barred character: the string was there before
            return self._parted(last, known, c)
        new, p = self._state(self.length[last] + 1, at, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._parted(p, self.step[p][c], c)
        return new

    def longest(self, text: str, low: int, high: int) -> tuple[int, int, int]:
        """Start in text, start here and length of the longest common string, the earliest of equals."""
        best, state, n = (low, -1, 0), 0, 0
        step, link, length = self.step, self.link, self.length
        for at in range(low, high):
            c = text[at]
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            if c in step[state]:
                state, n = step[state][c], n + 1
                if n > best[2]:
                    best = (at - n + 1, self.first[state] - n + 1, n)
            else:
                n = 0
        return best


class SecondText:
    """A second text with what is found out about it."""

    def __init__(self, text: str):
        self.text, self._parts = text, {}
        most = len(text) // FREQUENT + 1
        self._frequent = {c for c, n in Counter(text).items() if n > most} if len(text) >= LONG else set()

    def _block(self, first: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        part = self._parts.get((blo, bhi))
        if part is None:
            if len(self._parts) >= _KEPT:
                self._parts.clear()
            part = self._parts[blo, bhi] = _Automaton(self.text, blo, bhi, self._frequent)
        i, j, n = part.longest(first, alo, ahi)
        if not n:
            i, j = alo, blo
        if self._frequent:
            while i > alo and j > blo and first[i - 1] == self.text[j - 1]:
                i, j, n = i - 1, j - 1, n + 1
            while i + n < ahi and j + n < bhi and first[i + n] == self.text[j + n]:
                n += 1
        return i, j, n

    def matching(self, first: str) -> int:
        """Characters in blocks."""
        total, ahead = 0, [(0, len(first), 0, len(self.text))]
        while ahead:
            alo, ahi, blo, bhi = ahead.pop()
            i, j, n = self._block(first, alo, ahi, blo, bhi)
            if n:
                total += n
                if alo < i and blo < j:
                    ahead.append((alo, i, blo, j))
                if i + n < ahi and j + n < bhi:
                    ahead.append((i + n, ahi, j + n, bhi))
        return total

    def ratio(self, first: str) -> float:
        length = len(first) + len(self.text)
        return 2.0 * self.matching(first) / length if length else 1.0
