"""Many strings in many texts at once: a trie with failure links, as sorted arrays, that texts run through in lanes."""

import numpy as np

#: Code points are below this.
_CHARS = 1 << 21
#: Characters of a text that one lane reports, at least. Lanes move together, a character a step.
LANE = 1024
LANES = 1 << 14


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one behind another, and where each text starts and the last ends."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return data, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


class Automaton:
    """Built level by level: the nodes of a depth are the distinct (parent, character) pairs, so their keys come out sorted, and
    the failure link of each is where its parent's links lead by that character."""

    def __init__(self, patterns: list[str]):
        """patterns: distinct, not empty."""
        data, starts = code_points(patterns)
        self.lengths = np.diff(starts)
        self.longest = int(self.lengths.max(initial=0))
        keys, parents, letters, ends = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, -1, np.int64)]
        at, alive, size, self.depths = np.zeros(len(patterns), np.int64), np.arange(len(patterns)), 1, [0, 1]
        for depth in range(self.longest):
            key = at[alive] * _CHARS + data[starts[alive] + depth]
            own, place = np.unique(key, return_inverse=True)
            at[alive] = size + place
            end = np.full(len(own), -1, np.int64)
            done = alive[self.lengths[alive] == depth + 1]
            end[at[done] - size] = done
            keys.append(own)
            parents.append(own // _CHARS)
            letters.append(own % _CHARS)
            ends.append(end)
            size += len(own)
            self.depths.append(size)
            alive = alive[self.lengths[alive] > depth + 1]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.pattern = np.concatenate(ends)
        self.fail = np.zeros(size, np.int64)
        #: The nearest node along the failure links, itself included, at which a pattern ends, or -1; and the next one behind.
        self.ending = np.where(self.pattern >= 0, np.arange(size), -1)
        self.next_ending = np.full(size, -1, np.int64)
        for depth in range(1, len(self.depths) - 1):
            level = slice(self.depths[depth], self.depths[depth + 1])
            if depth > 1:
                self.fail[level] = self.step(self.fail[parents[depth]], letters[depth])
            self.next_ending[level] = self.ending[self.fail[level]]
            self.ending[level] = np.where(self.ending[level] >= 0, self.ending[level], self.next_ending[level])

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Where each node leads by its letter: along failure links until one has it, else the root, 0."""
        out = np.zeros(len(nodes), np.int64)
        if not len(self.keys):
            return out
        open_, at = np.arange(len(nodes)), nodes.copy()
        while len(open_):
            key = at[open_] * _CHARS + letters[open_]
            place = np.searchsorted(self.keys, key)
            found = self.keys[np.minimum(place, len(self.keys) - 1)] == key
            out[open_[found]] = place[found] + 1
            open_ = open_[~found & (at[open_] != 0)]
            at[open_] = self.fail[at[open_]]
        return out

    def find(self, texts: list[str], whole_words: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (text, pattern) where the pattern is anywhere in the text, or only without a letter or digit next to it.

        A lane reads as many characters before those it reports as the longest pattern has, so cutting a text loses nothing.
        """
        data, starts = code_points(texts)
        warm, width = max(0, self.longest - 1), max(LANE, 4 * self.longest)
        count = -(-np.diff(starts) // width)
        text = np.repeat(np.arange(len(texts)), count)
        begin = starts[text] + width * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        end, begin = np.minimum(begin + width, starts[text + 1]), np.maximum(begin - warm, starts[text])
        if whole_words:
            seen, place = np.unique(data, return_inverse=True)
            inside = np.array([chr(c).isalnum() for c in seen], bool)[place] if len(seen) else np.zeros(0, bool)
        order, pairs = np.argsort(begin - end, kind="stable"), [np.zeros(0, np.int64)]
        for a in range(0, len(order), LANES):
            lanes = order[a : a + LANES]
            t, at, length = text[lanes], begin[lanes], (end - begin)[lanes]
            node, held = np.zeros(len(lanes), np.int64), 0
            for i in range(int(length[0])):
                n = int(np.searchsorted(-length, -i, "left"))
                node = self.step(node[:n], data[at[:n] + i])
                hit = self.ending[node]
                who = np.flatnonzero(hit >= 0)
                hit = hit[who]
                while len(who):
                    good = np.ones(len(who), bool)
                    if whole_words:
                        last = at[who] + i
                        first = last - self.lengths[self.pattern[hit]]
                        good = ~((first >= starts[t[who]]) & inside[first]) & ~((last + 1 < starts[t[who] + 1]) & inside[np.minimum(last + 1, len(data) - 1)])
                    pairs.append(t[who[good]] * len(self.lengths) + self.pattern[hit[good]])
                    held += len(pairs[-1])
                    hit = self.next_ending[hit]
                    who, hit = who[hit >= 0], hit[hit >= 0]
                if held > 1 << 20:
                    pairs, held = [np.unique(np.concatenate(pairs))], 0
        found = np.unique(np.concatenate(pairs))
        return found // max(1, len(self.lengths)), found % max(1, len(self.lengths))
