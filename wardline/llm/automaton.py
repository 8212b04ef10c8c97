"""A lexicon trie and the Levenshtein automata of its entries, run on all words of a batch in step.

The trie's nodes with their numbers of edits are the states of a nondeterministic automaton that accepts what lies within an
entry's allowed edits (insertion, deletion, substitution, exchange of neighbours). It is made deterministic once; a word then
costs one table look-up per character and most words are dropped after a few. The lexicon has a bounded number of entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BMP = 1 << 16
DEAD, HIT = 0, 1
#: Simple lower case of the basic plane; characters whose lower case is longer stay.
LOWER_CHARS = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(BMP)], np.uint32)
IS_WORD = np.array([chr(c).isalnum() for c in range(BMP)], bool)


def allowed_edits(entry: str) -> int:
    """Edits by length; a stem (ending in ``*``) must be met exactly and may go on in any way."""
    if entry.endswith("*"):
        return 0
    return 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2


@dataclass
class Automaton:
    classes: np.ndarray  # character to alphabet class; 0 is any other character
    table: np.ndarray  # state x class to state
    distance: np.ndarray  # of each state at the end of a word: edits of the nearest entry, or -1

    def run(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Edits of the nearest entry for each word, -1 where none is near."""
        out = np.full(len(starts), -1, np.int8)
        alive = np.arange(len(starts))
        at = starts.copy()
        state = np.full(len(starts), len(self.table) - 1)
        while len(alive):
            state = self.table[state, self.classes[np.minimum(chars[at], BMP - 1)]]
            at = at + 1
            done = at == ends[alive]
            met = state == HIT
            finished = done | met
            out[alive[finished]] = self.distance[state[finished]]
            keep = ~finished & (state != DEAD)
            alive, at, state = alive[keep], at[keep], state[keep]
        return out


def build(entries: list[str]) -> Automaton:
    """The deterministic automaton of a lexicon."""
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]  # allowed edits of the entry that ends at a node
    reach: list[int] = [0]  # most edits allowed below a node
    stems: set[int] = set()
    for entry in entries:
        k, node = allowed_edits(entry), 0
        reach[0] = max(reach[0], k)
        for c in entry.rstrip("*"):
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
                reach.append(0)
            node = children[node][c]
            reach[node] = max(reach[node], k)
        ends[node] = max(ends[node], k)
        if entry.endswith("*"):
            stems.add(node)
    alphabet = {c: i + 1 for i, c in enumerate(sorted({c for e in entries for c in e.rstrip("*")}))}
    letters: list[str | None] = [None, *alphabet]

    def closure(states: set) -> frozenset:
        todo = list(states)
        while todo:
            node, e, want = todo.pop()
            if want is None:
                for child in children[node].values():
                    new = (child, e + 1, None)
                    if e < reach[child] and new not in states:
                        states.add(new)
                        todo.append(new)
        return frozenset(states)

    def step(states: frozenset, c: str | None) -> frozenset:
        out = set()
        for node, e, want in states:
            if want is not None:
                if c == want:
                    out.add((node, e, None))
                continue
            if c in children[node]:
                out.add((children[node][c], e, None))
            if e < reach[node]:
                out.add((node, e + 1, None))
            for d, child in children[node].items():
                if e < reach[child]:
                    out.add((child, e + 1, None))
                    if c in children[child] and c != d:
                        out.add((children[child][c], e + 1, d))
        return closure({s for s in out if s[1] <= reach[s[0]]})

    def best(states: frozenset) -> int:
        found = [e for node, e, want in states if want is None and ends[node] >= e]
        return min(found, default=-1)

    first = closure({(0, 0, None)})
    number: dict[frozenset, int] = {first: 2}
    order, rows = [first], []
    distance = [-1, 0]
    while len(rows) < len(order):
        states = order[len(rows)]
        distance.append(best(states) if states is not first else -1)
        row = []
        for c in letters:
            nxt = step(states, c)
            if any(node in stems and e == 0 and want is None for node, e, want in nxt):
                row.append(HIT)
            elif not nxt:
                row.append(DEAD)
            else:
                if nxt not in number:
                    number[nxt] = len(order) + 2
                    order.append(nxt)
                row.append(number[nxt])
        rows.append(row)
    width = len(letters)
    table = np.array([[DEAD] * width, [HIT] * width, *rows], np.int32)
    # the start state goes last, where run() looks for it
    table = np.vstack([table, table[2:3]])
    distance.append(-1)
    classes = np.zeros(BMP, np.int32)
    for c, i in alphabet.items():
        if ord(c) < BMP:
            classes[ord(c)] = i
    return Automaton(classes, table, np.array(distance, np.int8))
