"""Pre-tokenisation without regular expressions.

The pattern of byte-level BPE files splits text into contractions, runs of letters, of numbers, of
other signs (each with one blank before it) and white space. Here every code point is given a
class by one table lookup; the classes drive a small automaton. What an automaton does over a
stretch of text is a function from states to states, and composing such functions is associative:
the automaton's functions form a small monoid whose multiplication is a table. Text is therefore
scanned in many blocks at once (products of functions inside each block, then over blocks, then
the states), and a boundary lies wherever (state, class) says so.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

# Classes of code points.
LETTER, NUMBER, OTHER, ONE, TWO, SPACE, BLANK, LAST, END = range(9)
# ONE, TWO: an apostrophe before a contraction of one or two letters. BLANK: the blank that a word
# takes along. LAST: another white space right before a word. END: between two texts.

# States: what the last code point belonged to.
IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, AT_BLANK, ONE_LEFT, TWO_LEFT, SUFFIX_END, AT_END = range(9)
STATES = 9

# The white space of the pattern's \s (Unicode White_Space).
WHITE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


def _step(state: int, kind: int) -> int:
    if kind == LETTER:
        return {ONE_LEFT: SUFFIX_END, TWO_LEFT: ONE_LEFT}.get(state, IN_LETTER)
    if kind == NUMBER:
        return IN_NUMBER
    if kind in (ONE, TWO) and state not in (IN_OTHER, AT_BLANK):
        return ONE_LEFT if kind == ONE else TWO_LEFT
    if kind in (OTHER, ONE, TWO):
        return IN_OTHER
    return {SPACE: IN_SPACE, LAST: AT_END, BLANK: AT_BLANK, END: AT_END}[kind]


def _starts(state: int, kind: int) -> bool:
    """Whether a code point of this class starts a token after that state."""
    if kind == LETTER:
        return state not in (IN_LETTER, AT_BLANK, ONE_LEFT, TWO_LEFT)
    if kind == NUMBER:
        return state not in (IN_NUMBER, AT_BLANK)
    if kind in (OTHER, ONE, TWO):
        return state not in (IN_OTHER, AT_BLANK)
    if kind == SPACE:
        return state != IN_SPACE
    return True


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, multiplication table, state after each element, boundary table)."""
    elements = [tuple(range(STATES))]
    known = {elements[0]: 0}
    generators = [tuple(_step(s, k) for s in range(STATES)) for k in range(9)]
    for e in elements:  # grows while it is read
        for g in generators:
            made = tuple(g[s] for s in e)
            if made not in known:
                known[made] = len(elements)
                elements.append(made)
    product = np.array(
        [[known[tuple(second[s] for s in first)] for second in elements] for first in elements],
        dtype=np.uint8,
    )
    start = np.array([[_starts(s, k) for k in range(9)] for s in range(STATES)], dtype=bool)
    return (
        np.array([known[g] for g in generators], dtype=np.uint8),
        product,
        np.array(elements, dtype=np.uint8),
        start,
    )


@cache
def _contractions() -> tuple[np.ndarray, np.ndarray]:
    """Marks of letters after an apostrophe: bit 1 ends a contraction, others begin one of two."""
    first, second = np.zeros(128, dtype=np.uint8), np.zeros(128, dtype=np.uint8)
    for letter in "stmd":
        first[ord(letter)] = 1
    for pair, bit in (("re", 2), ("ve", 2), ("ll", 4)):
        first[ord(pair[0])] |= bit
        second[ord(pair[1])] |= bit
    return first, second


def class_table(matching: Callable[[str, str], str]) -> np.ndarray:
    """Class of every code point. matching(property, text): the code points of text that have it.

    The tokenizer library itself is asked, because versions of Unicode differ between libraries.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        found = matching(name, every).encode("utf-32-le")
        classes[np.frombuffer(found, dtype=np.uint32)] = kind
    classes[WHITE] = SPACE
    return classes


def boundaries(points: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions at which tokens start, in ascending order.

    points: code points of the texts, each text followed by one extra code point at `ends`, which
    belongs to no token and is reported as a boundary too.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kinds = classes[points]
    kinds[ends] = END
    # White space: what it does depends on whether a word follows.
    space = kinds == SPACE
    before_word = np.zeros(n, dtype=bool)
    before_word[:-1] = space[:-1] & (kinds[1:] != SPACE) & (kinds[1:] != END)
    blank = points == 0x20
    kinds[before_word & blank] = BLANK
    kinds[before_word & ~blank] = LAST
    # Apostrophes before the letters of a contraction.
    at = np.flatnonzero(points == 0x27)
    at = at[kinds[at] == OTHER]
    if len(at):
        first, second = _contractions()
        padded = np.append(points, [0, 0])
        a = first[np.where(padded[at + 1] < 128, padded[at + 1], 0)]
        b = second[np.where(padded[at + 2] < 128, padded[at + 2], 0)]
        kinds[at[(a & b) > 1]] = TWO
        kinds[at[(a & 1) == 1]] = ONE
    return np.flatnonzero(_scan(kinds))


def _scan(kinds: np.ndarray) -> np.ndarray:
    generator, product, after, starts = _monoid()
    n, size = len(kinds), len(product)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    padded = np.full(rows * width, END, dtype=np.uint8)
    padded[:n] = kinds
    # One column per block, so that each step is contiguous.
    steps = np.ascontiguousarray(generator[padded].reshape(rows, width).T)
    flat = product.ravel()
    prefix = np.empty_like(steps)
    so_far = np.zeros(rows, dtype=np.uint8)
    for i in range(width):
        prefix[i] = so_far  # of what lies before the code point
        so_far = flat[so_far.astype(np.intp) * size + steps[i]]
    # The same product over whole blocks, by doubling.
    reach = 1
    while reach < rows:
        later = so_far.copy()
        later[reach:] = flat[so_far[:-reach].astype(np.intp) * size + so_far[reach:]]
        so_far, reach = later, reach * 2
    entry = np.full(rows, AT_END, dtype=np.intp)
    entry[1:] = after[so_far[:-1], AT_END]
    states = after[prefix, entry[None, :]].T.ravel()[:n]
    return starts[states, kinds]
