"""Generalised suffix automata over words, with the smallest or all owners of each state's string."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence

import numpy as np


class SuffixAutomaton:
    """All substrings of some sequences. State 0 is the empty string.

    length[v] is the longest string of v, length[link[v]] + 1 the shortest; all of them end at the same
    places. next[v] has the states that a further word leads to.
    """

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, next_: dict[Hashable, int], link: int) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def add(self, word: Hashable, last: int) -> int:
        """The state of the sequence so far, extended by a word; last is the state before, 0 at a sequence's start."""
        next_, link, length = self.next, self.link, self.length
        q = next_[last].get(word)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._split(last, word, q)
        cur = self._state(length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in next_[p]:
            next_[p][word] = cur
            p = link[p]
        if p != -1:
            q = next_[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return cur

    def _split(self, p: int, word: Hashable, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def insert(self, words: Iterable[Hashable]) -> list[int]:
        """Adds a sequence; the state after each word. As add() word by word, with its common case in line."""
        next_, link, length = self.next, self.link, self.length
        last, out = 0, []
        for word in words:
            if word in next_[last]:
                last = self.add(word, last)
            else:
                cur = len(link)
                next_.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p != -1:
                    to = next_[p]
                    if word in to:
                        q = to[word]
                        link[cur] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                        break
                    to[word] = cur
                    p = link[p]
                last = cur
            out.append(last)
        return out

    def by_length(self) -> list[int]:
        """States from the longest to the shortest, without state 0: a state before its link."""
        return (np.argsort(-np.array(self.length[1:], np.int64), kind="stable") + 1).tolist()

    def smallest(self, ends: Iterable[tuple[int, int]]) -> list[int | None]:
        """For each state the smallest owner of a sequence that holds its strings; ends: (state, owner) of every prefix."""
        out: list[int | None] = [None] * len(self.link)
        for v, owner in ends:
            if out[v] is None or owner < out[v]:
                out[v] = owner
        for v in self.by_length():
            p, x = self.link[v], out[v]
            if x is not None and p > 0 and (out[p] is None or x < out[p]):
                out[p] = x
        return out

    def owners(self, ends: Iterable[tuple[int, int]], least: int) -> dict[int, frozenset[int]]:
        """As smallest(), but all owners, of the states with a string of `least` words."""
        found: dict[int, set[int]] = {}
        for v, owner in ends:
            if self.length[v] >= least:
                found.setdefault(v, set()).add(owner)
        for v in self.by_length():
            if v in found and self.length[p := self.link[v]] >= least:
                found.setdefault(p, set()).update(found[v])
        return {v: frozenset(x) for v, x in found.items()}

    def cut(self, k: int) -> list[int]:
        """For each state that has strings of k words or more, the state of their last k words; else -1."""
        link, length = self.link, self.length
        out = [-1] * len(link)
        for v in reversed(self.by_length()):
            if length[v] >= k:
                out[v] = v if length[link[v]] < k else out[link[v]]
        return out

    def stream(self, words: Sequence[Hashable]) -> Iterable[tuple[int, int]]:
        """Matching statistics: for each word the state and length of the longest match that ends there."""
        next_, link, length = self.next, self.link, self.length
        v = n = 0
        for w in words:
            while v and w not in next_[v]:
                v = link[v]
                n = length[v]
            q = next_[v].get(w)
            if q is not None:
                v, n = q, n + 1
            yield v, n
