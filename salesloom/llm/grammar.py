"""Re-Pair: the most frequent pair of neighbouring symbols becomes a rule, until no pair occurs twice."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

_END = -1


def re_pair(sequences: Sequence[Sequence[int]], terminals: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules and the sequences written with them; symbol ``terminals + k`` stands for rule ``k``.

    One grammar for all sequences, no rule crosses the end of one.  Of pairs that are equally
    frequent the smallest comes first, so equal input has an equal grammar.
    """
    symbols: list[int] = []
    for s in sequences:
        symbols.extend(s)
        symbols.append(_END)
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(len(symbols) - 1):
        if symbols[i] != _END and symbols[i + 1] != _END:
            places[symbols[i], symbols[i + 1]].add(i)
    queue = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(queue)
    rules: list[tuple[int, int]] = []

    def forget(i: int) -> None:
        if i >= 0 and after[i] < len(symbols):
            places.get((symbols[i], symbols[after[i]]), set()).discard(i)

    while queue:
        count, pair = heapq.heappop(queue)
        found = places.get(pair, ())
        if len(found) < 2:
            continue
        if len(found) != -count:
            heapq.heappush(queue, (-len(found), pair))
            continue
        made, done, touched = terminals + len(rules), 0, set()
        for i in sorted(found):
            j = after[i]
            # an earlier replacement of this round may have taken one of the two
            if symbols[i] != pair[0] or j >= len(symbols) or symbols[j] != pair[1] or i not in places[pair]:
                continue
            left, right = before[i], after[j]
            forget(left)
            forget(i)
            forget(j)
            symbols[i], symbols[j] = made, _END
            after[i] = right
            if right < len(symbols):
                before[right] = i
            done += 1
            if left >= 0 and symbols[left] != _END:
                places[symbols[left], made].add(left)
                touched.add((symbols[left], made))
            if right < len(symbols) and symbols[right] != _END:
                places[made, symbols[right]].add(i)
                touched.add((made, symbols[right]))
        places.pop(pair, None)
        if done:
            rules.append(pair)
        for t in touched:
            if len(places.get(t, ())) > 1:
                heapq.heappush(queue, (-len(places[t]), t))

    written, at = [], 0
    for s in sequences:
        out, i, end = [], at, at + len(s)
        while i < end:
            out.append(symbols[i])
            i = after[i]
        written.append(out)
        at = end + 1
    return rules, written


class Rope:
    """A text put together from shared halves; compared without being written out."""

    __slots__ = ("left", "right", "text", "size", "mark")
    _BASE, _PRIME = 1_000_003, (1 << 61) - 1

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.size, self.mark = len(text), 0
            for c in text:
                self.mark = (self.mark * self._BASE + ord(c)) % self._PRIME
        else:
            self.size = left.size + right.size
            self.mark = (left.mark * pow(self._BASE, right.size, self._PRIME) + right.mark) % self._PRIME

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope("", self, other)

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            rope = stack.pop()
            if rope.left is None:
                out.append(rope.text)
            else:
                stack += (rope.right, rope.left)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """Order of the texts; equal halves are passed over as a whole."""
        one, two = [self], [other]
        while one and two:
            a, b = one.pop(), two.pop()
            if a is b or a.size == b.size and a.mark == b.mark:
                continue
            if a.left is not None and (a.size >= b.size or b.left is None):
                one += (a.right, a.left)
                two.append(b)
            elif b.left is not None:
                two += (b.right, b.left)
                one.append(a)
            else:
                common = min(a.size, b.size)
                if a.text[:common] != b.text[:common]:
                    return a.text < b.text
                if a.size > common:
                    one.append(Rope(a.text[common:]))
                if b.size > common:
                    two.append(Rope(b.text[common:]))
        return not one and bool(two)
