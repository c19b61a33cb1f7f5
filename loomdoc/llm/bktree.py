"""BK-tree over 64-bit fingerprints."""

from __future__ import annotations


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent; a search follows only the edges within the radius
    of its own distance. Equal values share a node."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.items: list[list[int]] = []

    def add(self, value: int, item: int) -> None:
        if not self.values:
            self._new(value, item)
            return
        at = 0
        while True:
            distance = (self.values[at] ^ value).bit_count()
            if not distance:
                self.items[at].append(item)
                return
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = len(self.values)
                self._new(value, item)
                return
            at = below

    def _new(self, value: int, item: int) -> None:
        self.values.append(value)
        self.children.append({})
        self.items.append([item])

    def near(self, value: int, radius: int) -> list[tuple[int, int]]:
        """``(distance, item)`` of all items within ``radius``."""
        out, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                out += [(distance, item) for item in self.items[at]]
            low, high = distance - radius, distance + radius
            todo += [below for edge, below in self.children[at].items() if low <= edge <= high]
        return out
