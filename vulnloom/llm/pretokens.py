"""Boundaries of pre-tokens, found without regular expressions.

The split is that of byte-level vocabularies: contractions, then runs of letters, numbers or other
characters with at most one space before them, then white space, of which the last character
before a word stands alone. A finite automaton with eight states describes it. Every code point,
with what its successors tell about it, is a symbol, and every symbol is a function from states to
states. Functions compose associatively, and the automaton has few distinct compositions, so each
gets a number and a table gives the number of any two in a row. The state before each character
then comes from a blocked scan over these numbers; texts lie one behind the other, and the first
symbol of a text is a constant function.
"""

from __future__ import annotations

import numpy as np

from vulnloom.llm.common import process_cache

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# Symbols: the classes, with white space told apart by what follows and apostrophes by the
# contraction they open.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE_THEN, S_WHITE_THEN, S_WHITE_RUN, S_SHORT, S_LONG = range(8)
N_SYMBOLS = 8
# States: what an open token may still take.
NOTHING, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
N_STATES = 8

BLOCK = 64


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """For (state, symbol): the next state, and whether a token starts at the symbol."""
    after = np.zeros((N_STATES, N_SYMBOLS), np.uint8)
    starts = np.ones((N_STATES, N_SYMBOLS), bool)
    fresh = [IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, NOTHING, IN_WHITE, ONE_LEFT, TWO_LEFT]
    after[:] = fresh
    joins = [
        (IN_LETTERS, S_LETTER, IN_LETTERS), (AFTER_SPACE, S_LETTER, IN_LETTERS),
        (ONE_LEFT, S_LETTER, NOTHING), (TWO_LEFT, S_LETTER, ONE_LEFT),
        (IN_NUMBERS, S_NUMBER, IN_NUMBERS), (AFTER_SPACE, S_NUMBER, IN_NUMBERS),
        (IN_WHITE, S_WHITE_RUN, IN_WHITE),
    ]
    for symbol in (S_OTHER, S_SHORT, S_LONG):
        joins += [(IN_OTHERS, symbol, IN_OTHERS), (AFTER_SPACE, symbol, IN_OTHERS)]
    for state, symbol, then in joins:
        after[state, symbol], starts[state, symbol] = then, False
    return after, starts


class Scanner:
    """The automaton's tables, and the classes of all code points."""

    def __init__(self) -> None:
        after, self.starts = _steps()
        symbols = [tuple(int(x) for x in after[:, s]) for s in range(N_SYMBOLS)]
        symbols += [(f[NOTHING],) * N_STATES for f in symbols]  # the same at the start of a text
        identity = tuple(range(N_STATES))
        known = {identity: 0}
        todo = [identity]
        while todo:
            f = todo.pop()
            for g in symbols:
                if (h := tuple(g[x] for x in f)) not in known:
                    known[h] = len(known)
                    todo.append(h)
        n = len(known)
        assert n <= 256
        # Row f, column g: the number of "f, then g".
        self.then = np.zeros((n, n), np.uint8)
        for f, i in known.items():
            for g, j in known.items():
                self.then[i, j] = known[tuple(g[x] for x in f)]
        self.flat = self.then.ravel()
        self.width = n
        self.apply = np.array(list(known), np.uint8)
        self.number = np.array([known[f] for f in symbols], np.uint8)
        self.classes = _classes()

    def _scan(self, functions: np.ndarray) -> np.ndarray:
        """Number of the composition of all functions up to each place, that place included."""
        n = len(functions)
        if n <= BLOCK:
            out = np.empty(n, np.uint8)
            acc = 0
            for i, f in enumerate(functions.tolist()):
                acc = int(self.then[acc, f])
                out[i] = acc
            return out
        blocks = -(-n // BLOCK)
        padded = np.zeros(blocks * BLOCK, np.uint8)
        padded[:n] = functions
        columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
        for i in range(1, BLOCK):
            columns[i] = self.flat[columns[i - 1].astype(np.int32) * self.width + columns[i]]
        before = np.zeros(blocks, np.uint8)
        before[1:] = self._scan(columns[-1])[:-1]
        for i in range(BLOCK):
            columns[i] = self.flat[before.astype(np.int32) * self.width + columns[i]]
        return columns.T.reshape(-1)[:n]

    def starts_of(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Places in `points` (code points of non-empty texts in a row) where a token starts.

        `firsts` are the places where a text starts.
        """
        n = len(points)
        classes = self.classes[points]
        white = classes >= SPACE
        first = np.zeros(n + 1, bool)
        first[firsts] = True
        first[n] = True
        ends_here = first[1:]  # the next place belongs to another text
        word_next = np.zeros(n, bool)
        word_next[:-1] = ~white[1:]
        word_next &= ~ends_here
        symbols = classes.copy()
        symbols[white] = S_WHITE_RUN
        symbols[(classes == SPACE) & word_next] = S_SPACE_THEN
        symbols[(classes == WHITE) & word_next] = S_WHITE_THEN
        quotes = np.flatnonzero((points == 0x27) & word_next)
        if len(quotes):
            one = points[quotes + 1]
            symbols[quotes[np.isin(one, np.frombuffer(b"stmd", np.uint8))]] = S_SHORT
            inside = np.flatnonzero(~ends_here[quotes + 1])
            two, one = points[quotes[inside] + 2], one[inside]
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            symbols[quotes[inside[long]]] = S_LONG
        composed = self._scan(self.number[symbols + N_SYMBOLS * first[:n]])
        states = np.zeros(n, np.uint8)
        states[1:] = self.apply[composed[:-1], NOTHING]
        return np.flatnonzero(self.starts[states, symbols] | first[:n])


def _classes() -> np.ndarray:
    """Class of each code point, by the Unicode tables of the tokenizer library."""
    import tiktoken

    single_bytes = {bytes([i]): i for i in range(256)}
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    text = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        found = tiktoken.Encoding(kind, pat_str=pattern, mergeable_ranks=single_bytes, special_tokens={})
        members = bytes(found.encode_ordinary(text)).decode("utf-8")
        out[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    out[0x20] = SPACE
    return out


def scanner() -> Scanner:
    return process_cache("scanner", Scanner)


def pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Pre-tokens of all texts in a row, and for each text the number of pre-tokens up to its end."""
    joined = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not joined:
        return [], np.zeros(len(texts), np.int64)
    if joined.isascii():
        points = np.frombuffer(joined, np.uint8)
        offsets = None
    else:
        points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32)
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.zeros(len(points) + 1, np.int64)
        np.cumsum(widths, out=offsets[1:])
    ends = np.cumsum(sizes)
    firsts = (ends - sizes)[sizes > 0]
    at = firsts if offsets is None else np.searchsorted(offsets, firsts)
    starts = scanner().starts_of(points, at)
    if offsets is not None:
        starts = offsets[starts]
    cuts = [*starts.tolist(), len(joined)]
    return [joined[a:b] for a, b in zip(cuts, cuts[1:])], np.searchsorted(starts, ends)
