"""A bounded memory of computed values for the words of texts."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """``memo(words)`` lists the value of each word; ``make`` computes those of a list of unknown words.

    At most two generations of ``size`` words are held.  A full generation
    becomes the old one and words met again move to the new one, so what is
    frequent stays and memory is bounded whatever the texts hold.
    """

    def __init__(self, make: Callable[[list[str]], list], size: int = 300_000, longest: int = 48) -> None:
        self.make, self.size, self.longest, self.young, self.old = make, size, longest, {}, {}

    def __call__(self, words: list[str]) -> list:
        out = list(map(self.young.get, words))
        if None not in out:
            return out
        lacking = dict.fromkeys(w for w, v in zip(words, out, strict=True) if v is None)
        found = {w: v for w in lacking if (v := self.old.get(w)) is not None}
        if unknown := [w for w in lacking if w not in found]:
            found.update(zip(unknown, self.make(unknown), strict=True))
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young.update((w, v) for w, v in found.items() if len(w) <= self.longest)
        return [found[w] if v is None else v for w, v in zip(words, out, strict=True)]
