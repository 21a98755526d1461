"""Approximate search of many patterns at once: the tree of their letters is followed through each text, and left where no place
of the text is near enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The longest text (its places are the bits of a long), the longest pattern and the most edits.
LONGEST_TEXT, LONGEST, MOST = 63, 40, 8
#: Texts that are searched together, nodes that are followed at a time (their arrays fit a processor's cache), and places or
#: matches beyond which fewer texts are taken.
TEXTS, AT_ONCE, MANY = 512, 1 << 14, 1 << 21


class _Tree:
    """Levels of the tree of sorted rows of letters (numbered from 1), from depth ``top`` on; row r ends at depth ``ends[r]``.  The children of node n are
    the nodes of the next level from ``first[level][n]`` to before ``first[level][n + 1]``."""

    def __init__(self, rows: np.ndarray, ends: np.ndarray, top: int = 0) -> None:
        new = np.zeros(len(rows), bool)
        new[0] = True
        new[1:] |= (rows[1:, :top] != rows[:-1, :top]).any(axis=1)
        self.at = np.cumsum(new) - 1  # the node at which each row ends, when all levels are done
        self.tops, self.first, self.letter = np.flatnonzero(new), [], []
        nodes = len(self.tops)
        for depth in range(top, int(ends.max())):
            here = np.flatnonzero(ends > depth)
            above, letter = self.at[here], rows[here, depth]
            new = np.ones(len(here), bool)
            new[1:] = (above[1:] != above[:-1]) | (letter[1:] != letter[:-1])
            self.at[here] = np.cumsum(new) - 1
            self.first.append(np.searchsorted(above[new], np.arange(nodes + 1)))
            self.letter.append(letter[new].astype(np.intp) - 1)
            nodes = len(self.letter[-1])


class _Piece:
    """Patterns (sorted ``rows`` of letters) whose first ``ends`` letters are within ``edits`` edits of a part of a text, and the whole row
    within ``allowed``: one tree of all first pieces, and at its nodes trees of what follows, one for each ``kind``.  All rows of a kind
    have one size, one end and one number of edits."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, ends: np.ndarray, allowed: np.ndarray, kind: np.ndarray, number: np.ndarray, edits: int) -> None:
        self.edits, self.head, self.rest = edits, _Tree(rows, ends), {}
        for m in np.unique(kind).tolist():
            own = np.flatnonzero(kind == m)
            depth = int(ends[own[0]])
            tree = _Tree(rows[own], size[own], depth)
            follows = np.full(len(self.head.letter[depth - 1]), -1)
            follows[self.head.at[own][tree.tops]] = np.arange(len(tree.tops))
            patterns = np.searchsorted(tree.at, np.arange(len(tree.letter[-1]) + 1))  # as first, of the last level
            k = int(allowed[own[0]])
            self.rest.setdefault(depth, []).append((int(size[own[0]]) - k, k, tree, follows, patterns, number[own]))
        self.least = min(r[0] for rest in self.rest.values() for r in rest)  # letters that a text must have


def _children(first: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position in ``node``, child), some nodes at a time."""
    count = first[node + 1] - first[node]
    stop = np.cumsum(count)
    begin = first[node] - stop + count
    low = 0
    while low < len(node):
        done = stop[low] - count[low]
        high = max(int(np.searchsorted(stop, done + AT_ONCE, "right")), low + 1)
        parent = np.repeat(np.arange(low, high), count[low:high])
        child = np.arange(done, stop[high - 1])
        child += begin.take(parent)
        yield parent, child
        low = high


def _after(words: list[np.ndarray], equal: np.ndarray) -> list[np.ndarray]:
    """A letter more.  Bit j of word e says that the letters so far are within e edits of a part of the text that ends before place j;
    ``equal`` has the places after each occurrence of the letter."""
    left = words[0] << 1
    out = [left & equal]
    for before, word in zip(words, words[1:]):
        moved = word << 1
        near = moved & equal
        near |= left
        near |= before
        near |= out[-1] << 1
        out.append(near)
        left = moved
    return out


def _followed(first: np.ndarray, letter: np.ndarray, equal: np.ndarray, base: np.ndarray, node: np.ndarray, words: list[np.ndarray]):
    """The next level of what is still near: texts (``base``, where their letters begin in ``equal``), nodes and words."""
    out = []
    for parent, child in _children(first, node):
        text = base.take(parent)
        place = letter.take(child)
        place += text
        after = _after([w.take(parent) for w in words], equal.take(place))
        near = np.flatnonzero(after[-1])
        out.append([c.take(near) for c in (text, child, *after)])
    base, node, *words = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (base, node, *words)
    return base, node, words


class Patterns:
    """Patterns (rows of ``letters``, numbers from 0 to below ``alphabet``, one after the other from ``at``) of 2 to LONGEST letters, each
    with the edits it allows, from one to MOST and fewer than its letters; those of one size allow as many.

    Of k edits in all, up to three, k // 2 at most are in a pattern's first piece or k - 1 - k // 2 at most in its last.  Of more than
    three, one at most is in the first of three pieces, or in the last, or else two or more are in each of these; then the middle
    piece has k - 4 at most, and k - 2 with the last.  So trees of first pieces, backwards of last pieces, and of middle pieces find
    every pattern; what is found by the middle is compared as a whole."""

    def __init__(self, letters: np.ndarray, at: np.ndarray, size: np.ndarray, edits: np.ndarray, alphabet: int) -> None:
        self.letters, self.at, self.size, self.edits = letters, at, size, edits
        self.n, self.alphabet, self.pieces = len(size), alphabet, []
        few = edits < 4
        front, back = np.where(few, edits // 2, 1), np.where(few, edits - 1 - edits // 2, 1)
        middle = np.where(few, -1.5, edits - 4)
        share = size / (front + back + middle + 4.5)  # a piece with an edit more is a letter's share longer
        first = np.clip(np.round((front + 1.5) * share).astype(np.int64), 1, size - np.where(few, 1, 2))
        last = np.where(few, size - first, np.clip(np.round((back + 1.5) * share).astype(np.int64), 1, size - first - 1))
        no = np.zeros_like(size)
        self._add(False, no, first, front, edits, slice(None), False)
        self._add(True, no, last, back, edits, slice(None), False)
        self._add(False, first, size - first - last, edits - 4, edits - 2, ~few, True)

    def _add(self, backwards: bool, skipped: np.ndarray, ends: np.ndarray, most: np.ndarray, allowed: np.ndarray, which, part: bool) -> None:
        number = np.arange(self.n)[which]
        if not len(number):
            return
        at, size = (self.at + skipped)[number], (self.size - skipped)[number]
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        rows = np.zeros((len(size), int(size.max())), ">i4" if self.alphabet > 254 else np.uint8)
        rows[row, place] = self.letters[at[row] + (size[row] - 1 - place if backwards else place)] + 1
        order = np.argsort(rows.view(f"S{rows.shape[1] * rows.itemsize}").ravel(), kind="stable")
        rows, number = rows[order], number[order]
        for e in np.unique(most[number]).tolist():
            if e >= 0:
                own = np.flatnonzero(most[number] == e)
                n = number[own]
                self.pieces.append((backwards, part, _Piece(rows[own], size[order][own], ends[n], allowed[n], self.size[n], n, e)))

    def _whole(self, equal: np.ndarray, base: np.ndarray, everywhere: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """Whether each pattern, all of one size, is within its edits of a part of its text."""
        words = [everywhere] * (int(self.edits[pattern[0]]) + 1)
        for letter in range(int(self.size[pattern[0]])):
            words = _after(words, equal.take(base + self.letters[self.at[pattern] + letter]))
        return words[-1] != 0

    def _equal(self, letters: np.ndarray, owner: np.ndarray, place: np.ndarray, texts: int, word: type) -> np.ndarray:
        equal = np.zeros(texts * self.alphabet, word)
        np.bitwise_or.at(equal, owner * self.alphabet + letters, word(1) << (place + 1).astype(word))
        return equal

    def _matches(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Each (pattern, text) once; None if there were too many for so many texts."""
        texts = len(size)
        word = np.uint32 if size.max() < 32 else np.uint64
        owner = np.repeat(np.arange(texts), size)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
        everywhere = ((np.uint64(2) << size.astype(np.uint64)) - np.uint64(1)).astype(word)
        found, many = [np.zeros(0, np.int64)], 0
        longest = int(size.max())
        for backwards, part, piece in self.pieces:
            if longest < piece.least:
                continue
            equal = self._equal(letters, owner, size[owner] - 1 - place if backwards else place, texts, word)
            base, node, words = np.arange(texts) * self.alphabet, np.zeros(texts, np.int64), [everywhere] * (piece.edits + 1)
            for depth, (first, letter) in enumerate(zip(piece.head.first, piece.head.letter, strict=True), 1):
                base, node, words = _followed(first, letter, equal, base, node, words)
                if len(base) > MANY and texts > 1:
                    return None
                for least, k, tree, follows, patterns, number in piece.rest.get(depth, ()):
                    if longest < least:
                        continue
                    top = follows[node]
                    own = np.flatnonzero(top >= 0)
                    b, n, w = base[own], top[own], [x[own] for x in words]
                    while len(w) <= k:
                        w.append(w[-1] | w[-1] << 1)
                    for level in zip(tree.first, tree.letter, strict=True):
                        if len(b):
                            b, n, w = _followed(*level, equal, b, n, w)
                    for parent, child in _children(patterns, n):
                        text, pattern = b[parent], number[child]
                        if part:
                            right = self._whole(equal, text, everywhere[text // self.alphabet], pattern)
                            text, pattern = text[right], pattern[right]
                        found.append(text // self.alphabet * self.n + pattern)
                        many += len(pattern)
                        if many > MANY and texts > 1:
                            return None
        text, pattern = np.divmod(np.unique(np.concatenate(found)), max(1, self.n))
        return pattern, text

    def within(self, letters: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pattern, text) for each text of 1 to LONGEST_TEXT letters, some texts at a time, where the pattern is within its edits of some part of
        the text."""
        order = np.argsort(size, kind="stable")
        todo = [order[k : k + TEXTS] for k in range(0, len(order), TEXTS)][::-1] if self.n else []
        while todo:
            own = todo.pop()
            length = size[own]
            place = np.repeat(at[own] - np.cumsum(length) + length, length) + np.arange(length.sum())
            if (some := self._matches(letters[place], length)) is None:
                todo += [own[len(own) // 2 :], own[: len(own) // 2]]
            else:
                yield some[0], own[some[1]]
