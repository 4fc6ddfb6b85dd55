"""An Aho-Corasick automaton over byte strings, as arrays."""

import numpy as np


class Automaton:
    """``longest[state]`` is the state of the longest pattern that ends in ``state``, ``shorter[state]`` that of the next
    shorter one, ``pattern[state]`` its number; 0 is the root and ends a chain. States without children share the moves of
    their failure state, so moves take a row for each inner state only."""

    def __init__(self, patterns: list[bytes], numbers: np.ndarray):
        sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
        depth_of_all = int(sizes.max(initial=0))
        data = np.array(patterns, dtype=f"S{max(1, depth_of_all)}").view(np.uint8).reshape(len(patterns), -1)
        at, levels, n = np.zeros(len(patterns), np.int64), [], 1
        for depth in range(depth_of_all):
            live = sizes > depth
            steps, which = np.unique(at[live] << 8 | data[live, depth], return_inverse=True)
            levels.append((steps >> 8, steps & 255, np.arange(n, n + len(steps))))
            at[live] = n + which
            n += len(steps)
        self.pattern = np.full(n, -1, np.int32)
        self.pattern[at] = numbers
        inner = np.zeros(n, bool)
        inner[0] = True
        for above, _, _ in levels:
            inner[above] = True
        self.row = np.where(inner, np.cumsum(inner) - 1, 0).astype(np.int32)
        self.moves = np.zeros((int(inner.sum()), 256), np.int32)
        fail, self.shorter = np.zeros(n, np.int64), np.zeros(n, np.int32)
        for depth, (above, byte, state) in enumerate(levels):
            if depth:
                fail[state] = self.moves[self.row[fail[above]], byte]
            self.moves[self.row[above], byte] = state
            back = fail[state]
            own = inner[state]
            self.moves[self.row[state[own]]] = self.moves[self.row[back[own]]]
            self.row[state[~own]] = self.row[back[~own]]
            self.shorter[state] = np.where(self.pattern[back] >= 0, back, self.shorter[back])
        self.longest = np.where(self.pattern >= 0, np.arange(n), self.shorter).astype(np.int32)
