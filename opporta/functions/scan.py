"""One pass over a text for many words at once: an automaton finds every listed word, small rules read what stands around them.

The time a text takes grows with its length and with what is found in it, not with the number of words looked for. `Words` is
the automaton; `TenderText` reads owner, deadline, requirements and place of one text with it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

import ahocorasick

_BLANKS = re.compile(r"\s+")


def lowered(text: str) -> str:
    """Lower case, character by character, so that places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_" or unicodedata.combining(char) != 0


def squeezed(text: str) -> str:
    return _BLANKS.sub(" ", text).strip(" ")


class Words:
    """Finds the words of several lists in one pass."""

    def __init__(self, lists: Mapping[str, Iterable[str]]):
        kinds: dict[str, list[tuple[str, int]]] = {}
        for kind, words in lists.items():
            for place, word in enumerate(words):
                kinds.setdefault(word.lower(), []).append((kind, place))
        self.names, self.automaton = list(lists), ahocorasick.Automaton()
        for word, own in kinds.items():
            self.automaton.add_word(word, (len(word), own))
        self.automaton.make_automaton()

    def found(self, low: str) -> dict[str, list[tuple[int, int, int]]]:
        """`start, end, place in the list` of every occurrence, for each list, in the order of the ends."""
        out: dict[str, list[tuple[int, int, int]]] = {name: [] for name in self.names}
        for last, (size, own) in self.automaton.iter(low):
            for kind, place in own:
                out[kind].append((last + 1 - size, last + 1, place))
        return out


def whole_words(hits: Iterable[tuple[int, int, int]], text: str) -> list[tuple[int, int, int]]:
    """Hits with no word character on either side, from left to right, the longest of those at one place first."""
    kept = [h for h in hits if not (h[0] and is_word(text[h[0] - 1])) and not (h[1] < len(text) and is_word(text[h[1]]))]
    return sorted(kept, key=lambda h: (h[0], -h[1]))


def apart(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The first of hits that overlap."""
    out: list[tuple[int, int, int]] = []
    for h in hits:
        if not out or h[0] >= out[-1][1]:
            out.append(h)
    return out


def spans(text: str, marks: str) -> list[tuple[int, int]]:
    """Start and end of the pieces between characters of `marks`."""
    out, at = [], 0
    for m in re.finditer(f"[{marks}]", text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def holding(pieces: list[tuple[int, int]], hits: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """The pieces that hold a whole hit, with their hits."""
    out, k, waiting = [], 0, sorted(hits)
    for a, z in pieces:
        own = []
        while k < len(waiting) and waiting[k][0] < z:
            if waiting[k][0] >= a and waiting[k][1] <= z:
                own.append(waiting[k])
            k += 1
        if own:
            out.append((a, z, own))
    return out


def cut_before(text: str, start: int, end: int, hits: Iterable[tuple[int, int, int]]) -> int:
    """Where the white space before the first of the hits begins that follow white space in `text[start:end]`; else `end`."""
    for a, z, _ in hits:
        if start < a and z <= end and text[a - 1].isspace():
            at = a - 1
            while at > start and text[at - 1].isspace():
                at -= 1
            return at
    return end
