"""Links within a family: sets that are all related to one leader, compared by how they differ from it.

A set x that leaves out r of its leader's shingles and adds others shares with another such set y

    |leader| - r(x) - r(y) + c,  c: what x and y both leave out or both add.

So whether x and y are linked follows from a weight of each and from c: the leader's answers are computed once, and those
of its relatives are derived from them by the differences alone. Where two weights add up to nothing, the sets are linked
whatever c is; where even the smaller difference can't make c large enough, they are not. Whole stretches of sets in
order of weight are decided that way. For the others c is counted, for many sets at once, by multiplying matrices of
what is left out and added. Only numbers of links and the links that join components leave.
"""

from __future__ import annotations

import numpy as np

#: Similarity as a fraction: a link needs DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 75, 100
_BOTH = NUMERATOR + DENOMINATOR
#: Sets that are compared with so many others at once.
ROWS, COLUMNS = 256, 1024
#: Differences that more sets share are multiplied as matrices, others are paired one by one.
FEW = 6
#: Columns of such a matrix at once.
WIDTH = 2048


def weight(leader: int, size: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Of sets of these sizes that leave out so many of a leader's shingles: a link needs 2 * _BOTH * c >= the sum of two."""
    return 2 * NUMERATOR * size + 2 * _BOTH * gone - _BOTH * leader


def difference(of: np.ndarray, leader: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the leader's sorted set that a sorted set leaves out, and what it adds."""
    at = np.searchsorted(leader, of)
    at[at == len(leader)] = 0
    shared = leader[at] == of if len(leader) else np.zeros(len(of), bool)
    out = np.ones(len(leader), bool)
    out[at[shared]] = False
    return np.flatnonzero(out).astype(np.uint32), of[~shared]


class Members:
    """Sets of one family, some of them on the left, some on the right, or all on both sides."""

    def __init__(self, leader: int, sizes, rows, left, gone: list[np.ndarray], more: list[np.ndarray]):
        self.rows, self.left = np.asarray(rows, np.int64), np.asarray(left, bool)
        n_gone, n_more = (np.array([len(x) for x in c], np.int64) for c in (gone, more))
        self.weight = weight(leader, np.asarray(sizes, np.int64), n_gone)
        self.differences = n_gone + n_more
        #: linked to the leader: its difference to itself is nothing
        self.anchored = self.weight + weight(leader, np.array(leader), np.array(0)) <= 0
        self.one_side = bool(self.left.all())
        owner = np.concatenate([np.repeat(np.arange(len(gone)), n_gone), np.repeat(np.arange(len(more)), n_more)])
        code = np.concatenate([*gone, np.empty(0, np.uint32)]).astype(np.int64)
        added, add_code = np.unique(np.concatenate([*more, np.empty(0, np.uint64)]), return_inverse=True)
        code = np.concatenate([code, add_code.astype(np.int64) + leader])
        times = np.bincount(code, minlength=leader + len(added))
        common = times[code] > FEW
        self._few(owner, code, (times[code] > 1) & ~common)
        new = np.cumsum(times > FEW) - 1
        order = np.argsort(owner[common], kind="stable")
        self.owner, self.code = owner[common][order], new[code[common][order]]
        self.width = int((times > FEW).sum())
        self.begins = np.searchsorted(self.owner, np.arange(len(gone) + 1))

    def _few(self, owner: np.ndarray, code: np.ndarray, which: np.ndarray) -> None:
        """All pairs of sets that share a difference that few have, sorted by the first."""
        order = np.argsort(code[which], kind="stable")
        own, own_code = owner[which][order], code[which][order]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(1, FEW):
            same = np.flatnonzero(own_code[k:] == own_code[:-k])
            a += [own[same], own[same + k]]
            b += [own[same + k], own[same]]
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.argsort(a, kind="stable")
        self.few_a, self.few_b = a[order], b[order]

    def _matrix(self, sets: np.ndarray, begin: int) -> np.ndarray:
        width = min(WIDTH, self.width - begin)
        out = np.zeros((len(sets), width), np.float32)
        for k, s in enumerate(sets.tolist()):
            own = self.code[self.begins[s] : self.begins[s + 1]]
            out[k, own[(own >= begin) & (own < begin + width)] - begin] = 1
        return out

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many differences each of these sets has in common with each of those."""
        out = np.zeros((len(a), len(b)), np.float32)
        for begin in range(0, self.width, WIDTH):
            out += self._matrix(a, begin) @ self._matrix(b, begin).T
        if len(self.few_a):
            place = np.full(len(self.rows), -1, np.int64)
            place[b] = np.arange(len(b))
            low, high = np.searchsorted(self.few_a, a), np.searchsorted(self.few_a, a, side="right")
            for k in np.flatnonzero(high > low).tolist():
                at = place[self.few_b[low[k] : high[k]]]
                out[k] += np.bincount(at[at >= 0], minlength=len(b))
        return out

    def _linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """Which of these sets are linked to which of those; None: none."""
        wa, wb = self.weight[a], self.weight[b]
        if wa.max() + wb.max() <= 0:
            return np.ones((len(a), len(b)), bool)
        if 2 * _BOTH * min(self.differences[a].max(), self.differences[b].max()) < wa.min() + wb.min():
            return None
        return 2 * _BOTH * self._shared(a, b) >= wa[:, None] + wb[None, :]

    def links(self, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Of each set the rows of the sets on the other side that it is linked to, and whom its component joins here.

        The latter is -2: nobody; -1: the leader; else a set's index. Sets linked to the leader itself join nobody here.
        Unless links are `counted`, pairs of sets that are both linked to the leader aren't looked at.
        """
        order = np.argsort(self.weight, kind="stable")
        a_side = order if self.one_side else order[self.left[order]]
        b_side = order if self.one_side else order[~self.left[order]]
        total = np.zeros(len(self.rows), np.int64)
        label = np.where(self.anchored, 0, np.arange(1, len(self.rows) + 1))
        for i in range(0, len(a_side), ROWS):
            a = a_side[i : i + ROWS]
            for j in range(0, len(b_side), COLUMNS):
                b = b_side[j : j + COLUMNS]
                if not counted and self.anchored[a].all() and self.anchored[b].all():
                    continue
                linked = self._linked(a, b)
                if linked is None:
                    continue
                if self.one_side:
                    linked &= a[:, None] != b[None, :]
                if counted:
                    total[a] += linked @ self.rows[b]
                    if not self.one_side:
                        total[b] += self.rows[a] @ linked
                self._join(label, a, b, linked)
                if not self.one_side:
                    self._join(label, b, a, linked.T)
        joined = np.where(self.anchored | (label == np.arange(1, len(label) + 1)), -2, label - 1)
        return total, joined

    def _join(self, label: np.ndarray, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """Give all that is linked the smallest of their labels; 0 is the leader's."""
        for k in np.flatnonzero(~self.anchored[a]).tolist():
            met = np.unique(label[b[linked[k]]])
            own = label[a[k]]
            met = met[met != own]
            if len(met):
                least = min(own, met[0])
                label[np.isin(label, np.append(met, own)) & ~self.anchored] = least
