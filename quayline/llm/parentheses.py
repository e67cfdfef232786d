"""A trie as balanced parentheses, with range minima of the excess.

A node is an opening parenthesis, its subtree what stands between it and its
closing one. The excess (openings minus closings so far) is kept at the start of
every block of 64 parentheses, and its minimum per block, per pair of blocks, and
so on: ``findclose`` scans the node's block, climbs to the first range whose
minimum is low enough and descends into it, for all nodes at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    def __init__(self, opens: np.ndarray):
        n = len(opens)
        self.n = n
        self.opens = opens.astype(bool)
        blocks = max(1, -(-n // BLOCK))
        steps = np.zeros(blocks * BLOCK, np.int32)
        steps[:n] = np.where(self.opens, 1, -1)
        excess = np.cumsum(steps, dtype=np.int64).reshape(blocks, BLOCK)
        self.steps = steps.astype(np.int8)
        self.before = np.concatenate(([0], excess[:-1, -1]))  # excess at the start of a block
        self.low = [excess.min(axis=1)]
        while len(self.low[-1]) > 1:
            level = self.low[-1]
            if len(level) % 2:
                level = np.append(level, level[-1])
            self.low.append(np.minimum(level[::2], level[1::2]))
        self.rank = np.concatenate(([0], np.cumsum(self.opens)))
        pairs = np.zeros(n, bool)
        pairs[:-1] = self.opens[:-1] & ~self.opens[1:]
        self.leaf_rank = np.concatenate(([0], np.cumsum(pairs)))

    def excess_at(self, at: np.ndarray) -> np.ndarray:
        """Excess after each position."""
        return 2 * self.rank[at + 1] - (at + 1)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        at = np.asarray(at, np.int64)
        excess = self.excess_at(at)
        goal = excess - 1
        out = np.full(len(at), -1, np.int64)
        who, after = self._scan(np.arange(len(at)), at + 1, excess, goal, out, to_edge=True)
        if len(who):
            block = self._first_low(after // BLOCK, goal[who])
            self._scan(who, block * BLOCK, self.before[block], goal, out, to_edge=False)
        return out

    def _scan(self, who, at, excess, goal, out, to_edge: bool):
        """Walk right until the excess is as low as the goal; with ``to_edge`` give up at the next block.

        Returns who gave up, and where.
        """
        left, places = [who[:0]], [at[:0]]
        while len(who):
            if to_edge:
                edge = at % BLOCK == 0
                left.append(who[edge])
                places.append(at[edge])
                who, at, excess = who[~edge], at[~edge], excess[~edge]
            excess = excess + self.steps[at]
            done = excess == goal[who]
            out[who[done]] = at[done]
            who, at, excess = who[~done], at[~done] + 1, excess[~done]
        return np.concatenate(left), np.concatenate(places)

    def _first_low(self, block: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first block from ``block`` on whose minimal excess is at most ``goal``."""
        node, level = block.copy(), np.full(len(block), -1, np.int64)
        for depth, low in enumerate(self.low):  # climb: what was looked at lies left of all that a parent adds
            on = (level < 0) & (node < len(low))
            hit = np.zeros(len(node), bool)
            hit[on] = low[node[on]] <= goal[on]
            level[hit] = depth
            node = np.where(level < 0, (node + 1) // 2, node)
        for depth in range(len(self.low) - 1, 0, -1):  # descend: the left child if it is low enough
            on = level == depth
            child = 2 * node[on]
            node[on] = np.where(self.low[depth - 1][child] <= goal[on], child, child + 1)
            level[on] = depth - 1
        return node
