"""The exact Jaccard join of one region in memory: document pivots, Voronoi cells, triangle-inequality windows."""

from __future__ import annotations

import numpy as np

#: Up to so many documents are compared pair by pair.
HANDFUL = 4
#: Document pivots of one region.
PIVOTS = 8
#: A split must leave no cell with more than this share of the region's documents.
SHRINKS = 0.75


class Region:
    """Documents as sorted sets of codes; ``links`` are pairs of positions that connect what the join connects."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.radius = percent, 1 - percent / 100
        self.size = np.array([len(s) for s in sets], np.int64)
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        self.codes = codes.astype(np.int32)
        self.mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
        self.label = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def _of(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] : self.ends[i + 1]]

    def _gathered(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members' codes one after the other, and where each begins."""
        size = self.size[members]
        starts = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(starts - self.ends[members], size)
        return self.codes[at], starts

    def _common(self, i: int, gathered: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        codes, starts = gathered
        self.mark[self._of(i)] = True
        shared = np.add.reduceat(self.mark[codes], starts, dtype=np.int64)
        self.mark[self._of(i)] = False
        return shared

    def _link(self, i: int, others: np.ndarray, common: np.ndarray) -> None:
        near = common * 100 >= (self.size[i] + self.size[others] - common) * self.percent
        for j in others[near].tolist():
            if self.label[j] != self.label[i]:
                self.links.append((i, j))
                self.label[self.label == self.label[j]] = self.label[i]

    def _distance(self, i: int, members: np.ndarray, gathered: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Jaccard distances of the members to document i; members within the radius are linked to it."""
        common = self._common(i, gathered)
        self._link(i, members, common)
        return 1 - common / (self.size[i] + self.size[members] - common)

    def _fits(self, i: int, members: np.ndarray) -> np.ndarray:
        a, b = self.size[i], self.size[members]
        return (np.minimum(a, b) * 100 >= np.maximum(a, b) * self.percent) & (self.label[members] != self.label[i])

    def _pairs(self, members: np.ndarray) -> None:
        for k, i in enumerate(members.tolist()):
            rest = members[k + 1 :]
            rest = rest[self._fits(i, rest)]
            if len(rest):
                self._link(i, rest, self._common(i, self._gathered(rest)))

    def join(self) -> list[tuple[int, int]]:
        """All pairs of the region that the threshold links are connected by the links returned."""
        open_ = [np.arange(len(self.size))]
        while open_:
            members = open_.pop()
            if len(members) < 2 or (self.label[members] == self.label[members[0]]).all():
                continue
            if len(members) <= HANDFUL:
                self._pairs(members)
                continue
            # Farthest-first pivots: each new one is the document farthest from those before it.
            gathered, pivots, distances = self._gathered(members), [0], []
            for _ in range(PIVOTS):
                distances.append(self._distance(int(members[pivots[-1]]), members, gathered))
                nearest = np.min(distances, axis=0)
                if len(distances) == PIVOTS or nearest.max() <= self.radius:
                    break
                pivots.append(int(nearest.argmax()))
            rest = np.ones(len(members), bool)
            rest[pivots[: len(distances)]] = False  # pivots have met everyone
            members, distance = members[rest], np.array(distances)[:, rest]
            if len(members) < 2 or (self.label[members] == self.label[members[0]]).all():
                continue
            # x at home with pivot p and y within r of x: d(y, p) <= d(y, home of y) + 2 r. So y goes there too.
            within = distance <= distance.min(axis=0) + 2 * self.radius + 1e-9
            if within.sum(axis=1).max() <= SHRINKS * len(members):
                open_ += [members[row] for row in within]
            else:
                self._rings(members, distance)
        return self.links

    def _rings(self, members: np.ndarray, distance: np.ndarray) -> None:
        """Regions that pivots don't split: each document meets those in its ring around every pivot.

        The largest component needs no turn of its own, since all others meet its documents.
        """
        names, counts = np.unique(self.label[members], return_counts=True)
        turn = np.flatnonzero(self.label[members] != names[counts.argmax()])
        met = np.zeros(len(members), bool)
        for k in turn.tolist():
            i = int(members[k])
            met[k] = True
            near = np.abs(distance - distance[:, k : k + 1]).max(axis=0) <= self.radius + 1e-9
            rest = members[near & ~met & self._fits(i, members)]
            if len(rest):
                self._link(i, rest, self._common(i, self._gathered(rest)))
