"""Matching and cover density over the postings of many chunks at once, in array operations.

A ``Plan`` holds what a set of queries asks for; ``Postings`` the wanted postings of
some chunks, whole chunks only. Terms are numbered codes on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Weight of a title (A) and of a body (B) occurrence.
WEIGHTS = {"A": 1.0, "B": 0.4}
CELLS = 1 << 21  # numbers held at once


def expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``counts`` places from ``starts`` on: the run of each place, and the place."""
    ends = np.cumsum(counts)
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


@dataclass(frozen=True)
class Lists:
    """Lists of numbers, one after the other."""

    starts: np.ndarray  # one more than lists
    values: np.ndarray

    @classmethod
    def of(cls, lists: list[list]) -> "Lists":
        sizes = np.array([len(x) for x in lists], np.int64)
        return cls(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array([v for x in lists for v in x], np.int64))

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the given lists: the place in ``which`` of each value, the value, and its place among all values."""
        run, at = expand(self.starts[which], self.starts[which + 1] - self.starts[which])
        return run, self.values[at], at


@dataclass(frozen=True)
class Plan:
    """Groups of terms that must all be there, numbered over all queries.

    ``terms`` are the codes of a group, ``rare`` its rarest one. ``pieces`` lists the
    adjacent or excluded pieces of a group, ``parts`` the codes of a piece, ``offs``
    (parallel to the values of ``parts``) their places in it.
    """

    n_codes: int
    query: np.ndarray  # of each group
    terms: Lists
    by_rare: Lists  # code -> groups
    pieces: Lists
    parts: Lists
    offs: np.ndarray
    excluded: np.ndarray  # piece: chunks that hold it are out
    adjacent: np.ndarray  # piece: its parts stand side by side


class Postings:
    """Postings sorted by chunk and code: positions ascending, the first ``titled`` of them in the title."""

    def __init__(self, plan: Plan, ids: np.ndarray, codes: np.ndarray, starts: np.ndarray, positions: np.ndarray, titled: np.ndarray):
        self.ids, self.chunk = np.unique(ids, return_inverse=True)
        self.plan, self.codes, self.starts, self.positions, self.titled = plan, codes, starts, positions, titled
        self.keys = self.chunk * plan.n_codes + codes
        self.counts = np.diff(starts)

    def find(self, chunk: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The row of each (chunk, code), or -1."""
        key = chunk * self.plan.n_codes + code
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, at, -1) if len(self.keys) else np.full(len(key), -1)

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, group) of all matches: candidates by the rarest term, then the other terms, then the pieces."""
        row, group, _ = self.plan.by_rare.take(self.codes)
        chunk = self.chunk[row]
        run, code, _ = self.plan.terms.take(group)
        lacks = np.bincount(run, self.find(chunk[run], code) < 0, len(group)) > 0
        chunk, group = chunk[~lacks], group[~lacks]
        if len(self.plan.pieces.values) and len(group):
            out = self._fails(chunk, group)
            chunk, group = chunk[~out], group[~out]
        return chunk, group

    def _fails(self, chunk: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which candidates lack an adjacent piece or hold an excluded one."""
        plan = self.plan
        pair, piece, _ = plan.pieces.take(group)
        case, code, place = plan.parts.take(piece)
        found = self.find(chunk[pair][case], code)
        n = np.diff(plan.parts.starts)[piece]
        holds = np.bincount(case, found >= 0, len(piece)) == n
        close = np.flatnonzero(plan.adjacent[piece] & holds)
        if len(close):
            mine = np.isin(case, close)
            run, at = expand(self.starts[found[mine]], self.counts[found[mine]])
            base = case[mine][run]
            begin = self.positions[at] - plan.offs[place[mine]][run]
            low = int(begin.min(initial=0))
            key, times = np.unique(base * (int(begin.max(initial=0)) - low + 1) + begin - low, return_counts=True)
            where = key // (int(begin.max(initial=0)) - low + 1)
            together = np.zeros(len(piece), bool)
            together[where[times == n[where]]] = True
            holds &= ~plan.adjacent[piece] | together
        wrong = holds == plan.excluded[piece]
        return np.bincount(pair, wrong, len(group)) > 0

    def _rows(self, chunk: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each term of each match: the match, the number of the term in its group, the row."""
        run, code, place = self.plan.terms.take(group)
        return run, place - self.plan.terms.starts[group][run], self.find(chunk[run], code)

    def occurrences(self, chunk: np.ndarray, group: np.ndarray) -> np.ndarray:
        run, _, row = self._rows(chunk, group)
        return np.bincount(run, self.counts[row], len(group)).astype(np.int64)

    def ceilings(self, chunk: np.ndarray, group: np.ndarray) -> np.ndarray:
        """No match scores more: a cover starts at another occurrence of each term than the next
        cover, and adds at most the weight of its best occurrence."""
        run, _, row = self._rows(chunk, group)
        fewest = np.full(len(group), np.iinfo(np.int64).max)
        np.minimum.at(fewest, run, self.counts[row])
        title = np.bincount(run, self.titled[row], len(group)) > 0
        return fewest * np.where(title, WEIGHTS["A"], WEIGHTS["B"])

    def scores(self, chunk: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Cover density (Clarke, Cormack & Tudhope 2000) of each match.

        A cover is a shortest span of positions holding every term of the group. It
        adds ``(m / sum(1/weight)) / (1 + noise)`` over its ``m`` occurrences, where
        noise counts the positions in between.
        """
        out = np.zeros(len(group))
        size = self.plan.terms.sizes()[group]
        lone = np.flatnonzero(size == 1)  # a lone term is its own cover wherever it stands
        _, _, row = self._rows(chunk[lone], group[lone])
        out[lone] = self.titled[row] * WEIGHTS["A"] + (self.counts[row] - self.titled[row]) * WEIGHTS["B"]
        for n in np.unique(size[size > 1]).tolist():
            same = np.flatnonzero(size == n)
            weight = self.occurrences(chunk[same], group[same])
            cut = np.searchsorted(np.cumsum(weight), np.arange(0, weight.sum(), max(1, CELLS // n)))
            for lo, hi in zip(cut, [*cut[1:], len(same)]):
                some = same[lo:hi]
                if len(some):
                    out[some] = self._covers(chunk[some], group[some], n)
        return out

    def _covers(self, chunk: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
        """Scores of matches of groups of ``n`` terms, two at least."""
        run, term, row = self._rows(chunk, group)
        part, at = expand(self.starts[row], self.counts[row])
        match, term, pos = run[part], term[part], self.positions[at]
        title = at - self.starts[row][part] < self.titled[row][part]
        order = np.lexsort((pos, match))
        match, term, pos, title = match[order], term[order], pos[order], title[order]
        # the last place of each term so far; a place of an earlier match counts as none
        last = np.full((len(match), n), -1, np.int64)
        last[np.arange(len(match)), term] = np.arange(len(match))
        np.maximum.accumulate(last, axis=0, out=last)
        first = np.searchsorted(match, np.arange(len(group)))
        begin = last.min(axis=1)
        ends = begin >= first[match]
        # of the covers that begin at one place only the one that ends first counts
        new = np.concatenate([[True], begin[1:] != begin[:-1]]) if len(begin) else ends
        end = np.flatnonzero(ends & new)
        begin = begin[end]
        in_title = np.concatenate([[0], np.cumsum(title)])
        a, m = in_title[end + 1] - in_title[begin], end - begin + 1
        inverse = a / WEIGHTS["A"] + (m - a) / WEIGHTS["B"]
        noise = pos[end] - pos[begin] - (m - 1)
        return np.bincount(match[end], (m / inverse) / (1 + noise), len(group))
