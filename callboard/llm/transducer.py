"""Minimal acyclic transducers: sorted words on arcs that add up to each word's number.

Words that end alike share their final states, so the automaton is the smallest that
accepts exactly the given words. An arc's output is the number of accepted words that sort
before every word over this arc and after its source state; the outputs along a word's path
sum to its rank, which addresses the word's ids in a flat table.
"""

from __future__ import annotations

import numpy as np


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the automaton of distinct words in ascending byte order.

    ``keys`` holds state * 256 + byte for every arc in ascending order, ``targets`` and
    ``outputs`` go with it, ``final`` marks accepting states; the start state is ``root``.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []

    def settle(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        if shape not in register:
            register[shape] = len(finals)
            finals.append(node[0])
            arcs.append(shape[1])
        return register[shape]

    path: list[list] = [[False, []]]  # open states along the last word: [final, arcs]
    last = b""
    for word in words:
        shared = 0
        for x, y in zip(last, word):
            if x != y:
                break
            shared += 1
        while len(path) - 1 > shared:
            child = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], child))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        child = settle(path.pop())
        path[-1][1].append((last[len(path) - 1], child))
    root = settle(path[0])
    below = np.zeros(len(finals), np.int64)
    keys, targets, outputs = [], [], []
    for state, out in enumerate(arcs):  # children are settled before their parents
        count = int(finals[state])
        for label, child in out:
            keys.append(state * 256 + label)
            targets.append(child)
            outputs.append(count)
            count += int(below[child])
        below[state] = count
    return {
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int32),
        "outputs": np.array(outputs, np.int32),
        "final": np.array(finals, np.uint8),
        "root": np.array([root], np.int32),
    }


def ranks(automaton: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The rank of each word, -1 where the automaton doesn't accept it; all words step together."""
    found = np.full(len(words), -1, np.int64)
    keys = automaton["keys"]
    if not words or not len(keys):
        if words and automaton["final"][automaton["root"][0]]:
            found[[i for i, w in enumerate(words) if not w]] = 0
        return found
    text = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.cumsum(sizes) - sizes
    alive = np.arange(len(words))
    state = np.full(len(words), automaton["root"][0], np.int64)
    total = np.zeros(len(words), np.int64)
    step = 0
    while len(alive):
        ended = sizes[alive] == step
        done = alive[ended]
        good = done[automaton["final"][state[ended]] == 1]
        found[good] = total[good]
        alive, state = alive[~ended], state[~ended]
        wanted = state * 256 + text[at[alive] + step]
        arc = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        there = keys[arc] == wanted
        alive, arc = alive[there], arc[there]
        total[alive] += automaton["outputs"][arc]
        state = automaton["targets"][arc].astype(np.int64)
        step += 1
    return found
