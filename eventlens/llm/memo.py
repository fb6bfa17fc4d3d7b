"""A memory of computed values, bounded by bytes, kept by each Python worker."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: Text is worked on in slices of about so many code points.
SLICE = 4_000_000


#: Words of more code points are only remembered until ``PASSING`` code points of such came by.
LONGEST, PASSING = 64, 1_000_000


class Memo(dict):
    """Values of words. Holds at most two generations: when the young one is full it becomes
    the old one, and words still in use move back. A generation is full by the length of its
    words (``limit`` is about the bytes of their keys), so few long words count like many short
    ones; words beyond ``LONGEST`` stand apart and turn no generation."""

    def __init__(self, limit: int = 32_000_000):
        self.limit = limit
        self.old: dict = {}
        self.held = 0
        self.passing: dict = {}
        self.passed = 0

    def compute(self, words: list[str]) -> Iterable:
        """Values of ``words``, which are sorted and distinct."""
        raise NotImplementedError

    def turn(self) -> None:
        if self.held >= self.limit:
            self.old = dict(self)
            self.held = 0
            self.clear()

    def learn(self, words: Iterable[str]) -> None:
        """Make ``self[word]`` known for all of ``words`` that aren't long, computing what is
        new in one go."""
        self.turn()
        new = [word for word in set(words).difference(self) if len(word) <= LONGEST]
        unknown = []
        for word in new:
            value = self.old.get(word)
            if value is None:
                unknown.append(word)
            else:
                self[word] = value
        unknown.sort()
        self.update(zip(unknown, self.compute(unknown), strict=True))
        self.held += 4 * sum(map(len, new)) + 32 * len(new)

    def long(self, word: str):
        value = self.passing.get(word)
        if value is None:
            (value,) = self.compute([word])
            if self.passed + len(word) > PASSING:
                self.passing, self.passed = {}, 0
            if len(word) <= PASSING:
                self.passing[word] = value
                self.passed += len(word)
        return value

    def __missing__(self, word: str):
        if len(word) > LONGEST:
            return self.long(word)
        self.turn()
        value = self.old.get(word)
        if value is None:
            (value,) = self.compute([word])
        self[word] = value
        self.held += 4 * len(word) + 32
        return value


def slices(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in runs of about ``SLICE`` code points; a longer text stands alone."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > SLICE:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run
