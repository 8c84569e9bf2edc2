"""Byte-pair segmentation of every prefix of a word, by dynamic programming.

The segmentation of a prefix ends in exactly one piece, and what stands before that piece is
the segmentation of the shorter prefix. Two pieces may stand side by side exactly if merging
their joined symbols leaves them as they are. So walking through a word once, with the last
piece known for each prefix, gives the exact number of pieces of every prefix: a piece that
ends here is taken if it stays apart from the last piece of the prefix before it.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable


# Words with the same first symbols share the walk over them.
HEAD = 7


class PrefixBpe:
    """``pieces``: strings or bytes that may be produced. ``rank(a, b)``: how early two
    neighbouring symbols merge (lower first), None if never. Symbols are single items."""

    def __init__(self, pieces, rank: Callable[[Hashable, Hashable], int | None], cache: int = 400_000) -> None:
        self.rank = rank
        # Pieces read from their end: a node is [next symbols, the piece that is complete here].
        self.tree: list = [{}, None]
        for piece in pieces:
            node = self.tree
            for symbol in reversed(piece):
                node = node[0].setdefault(symbol, [{}, None])
            node[1] = piece
        self._follow: dict = {None: {}}  # for each piece (None: a word's start), what may come next
        self._known, self._cache = 0, cache
        self._heads: dict = {}

    def merge(self, word) -> list:
        """Plain merging, earliest rank first and leftmost among equals. For short strings."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def whole(self, piece) -> bool:
        """Whether merging ever yields this piece."""
        return self.merge(piece) == [piece]

    def apart(self, a, b) -> bool:
        """Whether merging leaves these two neighbours as they are."""
        return self.merge(a + b) == [a, b]

    def prefixes(self, word) -> tuple[list[int], list]:
        """(pieces in the first i symbols, last piece of the first i symbols) for i = 0..n.
        A symbol outside the vocabulary is a piece of its own that merges with nothing."""
        n = len(word)
        if n <= HEAD:
            return self._walk(word, [0], [None])
        head = word[:HEAD]
        found = self._heads.get(head)
        if found is None:
            found = self._walk(head, [0], [None])
            if len(self._heads) >= self._cache // 4:
                self._heads.clear()
            self._heads[head] = found
        return self._walk(word, found[0][:], found[1][:])

    def _walk(self, word, counts: list[int], last: list) -> tuple[list[int], list]:
        """Go on from the prefixes that ``counts`` and ``last`` have, in place."""
        if self._known > self._cache:
            self._follow, self._known = {None: {}}, 0
        follow, tree = self._follow, self.tree
        for i in range(len(counts), len(word) + 1):
            node, j = tree, i
            while j:
                j -= 1
                node = node[0].get(word[j])
                if node is None:
                    break
                piece = node[1]
                if piece is None:
                    continue
                before = last[j]
                after = follow.get(before)
                if after is None:
                    after = follow[before] = {}
                fits = after.get(piece)
                if fits is None:
                    fits = after[piece] = self.whole(piece) if before is None else self.apart(before, piece)
                    self._known += 1
                if fits:
                    last.append(piece)
                    counts.append(counts[j] + 1)
                    break
            if len(last) == i:
                last.append(word[i - 1 : i])
                counts.append(counts[i - 1] + 1)
        return counts, last

    def segment(self, word) -> list:
        last = self.prefixes(word)[1]
        parts, i = [], len(word)
        while i:
            parts.append(last[i])
            i -= len(last[i])
        return parts[::-1]
