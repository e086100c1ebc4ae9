"""Counts of index tokens in Arrow batches: what text.tokenize gives, for a stated set of terms, without an array of tokens in the row."""

from __future__ import annotations

import re
from collections import Counter

_TOKEN = re.compile(rb"[a-zA-Z][a-zA-Z0-9_-]*")
_BEFORE_LAST = re.compile(rb"([A-Z]+)([A-Z][a-z])")
_PARTS = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def terms_of(token: bytes) -> list[bytes]:
    """The token lower-cased and, of a compound, its parts."""
    parts = _PARTS.findall(_BEFORE_LAST.sub(rb"\1_\2", token))
    return [token.lower(), *(p.lower() for p in parts)] if len(parts) > 1 else [token.lower()]


class TermCounter:
    """Tokens of a text, and how often each of the terms comes (by its number). What tokens give is remembered for `limit` of them."""

    def __init__(self, numbers: dict[bytes, int], limit: int = 200_000):
        self.numbers, self.limit, self.known = numbers, limit, {}

    def of(self, text: bytes | None) -> tuple[int, Counter]:
        n, hits, known = 0, Counter(), self.known
        for token, times in Counter(_TOKEN.findall(text)).items() if text else ():
            found = known.get(token)
            if found is None:
                if len(known) >= self.limit:
                    known.clear()
                terms = terms_of(token)
                found = known[token] = (len(terms), [self.numbers[t] for t in terms if t in self.numbers])
            n += times * found[0]
            for number in found[1]:
                hits[number] += times
        return n, hits
