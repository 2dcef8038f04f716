"""Common-prefix interval trees over enhanced suffix arrays.

Contexts are byte strings seen from an anchor: ``right`` bytes from it on and
``left`` bytes before it, each padded with zeros. (No text holds the byte 0xFF
in UTF-8; a real zero byte is stored as that.)
"""

from __future__ import annotations

import numpy as np

from linkloom.llm.blocks import groups_of


def match_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of the rows of two matrices."""
    out = np.empty(len(a), np.int64)
    width = a.shape[1]
    for i in range(0, len(a), 50_000):
        differ = a[i : i + 50_000] != b[i : i + 50_000]
        first = differ.argmax(axis=1)
        first[~differ.any(axis=1)] = width
        out[i : i + 50_000] = first
    return out


def row_order(rows: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix."""
    if not len(rows) or not rows.shape[1]:
        return np.arange(len(rows))
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel().argsort(kind="stable")


def lcp_intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """All intervals of an LCP array with a common prefix of ``least`` or more.

    lcp[i] is the common prefix of suffixes i and i + 1. Rows: length of the
    prefix, first and last suffix, and the parent interval's length (or least - 1).
    One scan with a stack; children come before parents.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []  # length, first suffix
    values = np.where(lcp >= least, lcp, 0).tolist()
    values.append(0)
    for i, v in enumerate(values):
        begin = i
        while stack and stack[-1][0] > v:
            length, begin = stack.pop()
            parent = max(v, stack[-1][0] if stack else 0, least - 1)
            out.append((length, begin, i, parent))
        if v and (not stack or stack[-1][0] < v):
            stack.append((v, begin))
    return np.array(out, np.int64).reshape(-1, 4)


class RepeatTree:
    """The interval tree of the right contexts, with the left contexts of every interval's members."""

    def __init__(self, right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, least: int) -> None:
        """left: the nearest byte first."""
        self.left, self.n_left = left, n_left
        self.order = row_order(right)
        s = right[self.order]
        r = n_right[self.order]
        lcp = np.minimum(match_lengths(s[1:], s[:-1]), np.minimum(r[1:], r[:-1])) if len(s) > 1 else np.empty(0, np.int64)
        self.intervals = lcp_intervals(lcp, least)
        self.lowest = [lcp]  # least values of 1, 2, 4 ... neighbours
        while len(lcp) > 2 * (k := 1 << (len(self.lowest) - 1)):
            low = self.lowest[-1]
            self.lowest.append(np.minimum(low[:-k], low[k:]))
        self.place = np.empty(len(left), np.int64)
        self.place[self.order] = np.arange(len(left))
        rank = np.empty(len(left), np.int64)
        rank[row_order(left)] = np.arange(len(left))
        self.left_rank = rank

    def parts(self, most: int = 400_000):
        """Runs of intervals of bounded total size: (intervals, interval of each member, members by left context, their left matches).

        The left match of a member is with the one before it, and -1 for the
        first of an interval.
        """
        iv = self.intervals
        sizes = iv[:, 2] - iv[:, 1] + 1
        upto = np.cumsum(sizes)
        at = 0
        while at < len(iv):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            part, n = iv[at:stop], sizes[at:stop]
            owner = np.repeat(np.arange(len(part)), n)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            member = self.order[part[owner, 1] + within]
            member = member[np.lexsort((self.left_rank[member], owner))]
            match = np.full(len(member), -1, np.int64)
            same = np.nonzero(owner[1:] == owner[:-1])[0] + 1
            a, b = member[same], member[same - 1]
            for i in range(0, len(same), 50_000):
                x, y = a[i : i + 50_000], b[i : i + 50_000]
                match[same[i : i + 50_000]] = np.minimum(match_lengths(self.left[x], self.left[y]), np.minimum(self.n_left[x], self.n_left[y]))
            yield part, owner, member, match
            at = stop

    def _common(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The common prefix of all suffixes from first to last (first < last)."""
        n = last - first
        level = np.frexp(n.astype(np.float64))[1] - 1
        out = np.empty(len(n), np.int64)
        for k in np.unique(level).tolist():
            i = np.nonzero(level == k)[0]
            low = self.lowest[k]
            out[i] = np.minimum(low[first[i]], low[last[i] - (1 << k)])
        return out

    def maximal_repeats(self, size: int, most: int = 1_000_000):
        """Groups of maximal repeats of ``size`` bytes or more, in runs: left and right lengths from the anchor, where each group's members begin, and the members.

        The right contexts' intervals come from a stack scan of the suffix array;
        in each, a scan of the left contexts, in order, finds how far members
        extend to the left together, down to where their left extensions differ.
        A group whose members have more in common to the right belongs to a
        narrower interval and is left out there. So every group differs on both
        sides, and has all members with its string.
        """
        for part, owner, member, match in self.parts():
            inner = lcp_intervals(match[1:], 1)
            begins = groups_of(owner)
            ends = np.append(begins[1:], len(owner)) - 1
            differ = np.minimum.reduceat(np.where(match < 0, 1 << 30, match), begins) == 0
            wide = np.stack([np.zeros_like(begins), begins, ends], axis=1)[differ]
            every = np.concatenate([inner[:, :3], wide])
            right = part[owner[every[:, 1]], 0]
            keep = every[:, 0] + right >= size
            every, right = every[keep], right[keep]
            n = every[:, 2] - every[:, 1] + 1
            upto = np.cumsum(n)
            at = 0
            while at < len(every):
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
                own, size_of = every[at:stop], n[at:stop]
                starts = np.cumsum(size_of) - size_of
                members = member[np.repeat(own[:, 1] - starts, size_of) + np.arange(int(size_of.sum()))]
                place = self.place[members]
                maximal = self._common(np.minimum.reduceat(place, starts), np.maximum.reduceat(place, starts)) == right[at:stop]
                members = members[np.repeat(maximal, size_of)]
                size_of = size_of[maximal]
                if len(size_of):
                    yield own[maximal, 0], right[at:stop][maximal], np.cumsum(size_of) - size_of, members
                at = stop

    def repeated_windows(self, size: int, rank: np.ndarray) -> np.ndarray:
        """For each member and each offset o: does the window of ``size`` bytes from o before the anchor on also occur at a member of lower rank?

        In a group of a maximal repeat, all members but the one of lowest rank
        have every window of the repeat's string again.
        """
        widest = self.left.shape[1]
        steps = np.zeros((len(self.left_rank), widest + 2), np.int32)
        for left, right, starts, members in self.maximal_repeats(size):
            ranks = rank[members]
            group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(members)))
            later = ranks > np.minimum.reduceat(ranks, starts)[group]
            m, g = members[later], group[later]
            np.add.at(steps, (m, np.maximum(size - right, 0)[g]), 1)
            np.add.at(steps, (m, np.minimum(left, widest)[g] + 1), -1)
        return np.cumsum(steps[:, :-1], axis=1) > 0
