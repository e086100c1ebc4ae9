"""Token ids of a public byte-level BPE vocabulary, word by word with a memo.

The vocabulary's pattern always starts a new piece at a single space between two other characters,
a single newline there is a piece of its own, and merges never cross pieces. So a text cut at these
places has the ids of its cuts in a row, and the ids of a cut are remembered: most cuts are common
words. Texts with runs of white space or rarer white space are encoded as a whole. `JointIds` does so for several
vocabularies of one pattern at once.

Added tokens (strings with an id of their own, as the vocabulary's file lists them) are cut out of a text first, the longest
where several begin; without any their strings are ordinary text.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from functools import lru_cache
from itertools import repeat

import numpy as np

#: White space other than space and newline, and the separator used below.
_ODD = re.compile("[\0\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def cuts_of(text: str) -> list[str] | None:
    """The cuts of a text; None if it has to be encoded as a whole."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _ODD.search(text):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class Ids(dict):
    """cut of a text -> its ids; stops learning when full."""

    def __init__(self, ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = (), limit: int = 400_000):
        import tiktoken

        super().__init__()
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_to_numpy
        self.limit, self.newline = limit, self.ranks[b"\n"]
        self |= {"": b"", "\n": struct.pack("<I", self.newline)}
        self.added = {token: struct.pack("<I", i) for token, i in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split

    def of(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(token in text for token in self.added):
            return b"".join(self.added.get(x) or self._ordinary(x) for x in self.cut(text))
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        cuts = cuts_of(text)
        if cuts is None:
            return self._encode(text)
        found = list(map(self.get, cuts))
        if None in found:
            # Unknown cuts are encoded together, parted by newlines, which are pieces of their own.
            missing = [i for i, x in enumerate(found) if x is None]
            ids = self.encode("\n".join([cuts[i] for i in missing])).astype("<u4", copy=False)
            raw, at = ids.tobytes(), 0
            for i, end in zip(missing, [*(np.flatnonzero(ids == self.newline) * 4).tolist(), len(raw)]):
                found[i] = raw[at:end]
                at = end + 4
                if len(self) < self.limit and len(cuts[i]) < 64:
                    self[cuts[i]] = found[i]
        return b"".join(found)

    def _encode(self, text: str) -> bytes:
        return self.encode(text).astype("<u4", copy=False).tobytes()


class JointIds(dict):
    """cut of a text -> its ids by each of several vocabularies without added tokens, those of the i-th moved up by
    starts[i], so that no two share an id: one split, one lookup and one join for all of them. Stops learning when full."""

    def __init__(self, vocabularies: tuple[Ids, ...], limit: int = 800_000):
        super().__init__()
        self.vocabularies, self.limit = vocabularies, limit
        self.starts = np.cumsum([0, *(max(v.ranks.values()) + 1 for v in vocabularies[:-1])]).tolist()
        self |= {c: b"".join(struct.pack("<I", v.newline + s) for v, s in zip(vocabularies, self.starts)) if c else b"" for c in ("", "\n")}

    def of(self, text: str | None) -> np.ndarray:
        """The ids of a whole text by all vocabularies; each one's are in the order of the text."""
        if not text:
            return np.empty(0, "<u4")
        cuts = cuts_of(text)
        if cuts is None:
            return np.concatenate([v.encode(text).astype("<u4", copy=False) + np.uint32(s) for v, s in zip(self.vocabularies, self.starts)])
        found = list(map(self.get, cuts))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            unknown = [cuts[i] for i in missing]
            for i, cut, *raw in zip(missing, unknown, *map(self._parts, repeat(unknown), self.vocabularies, self.starts)):
                found[i] = b"".join(raw)
                if len(self) < self.limit and len(cut) < 64:
                    self[cut] = found[i]
        return np.frombuffer(b"".join(found), "<u4")

    @staticmethod
    def _parts(cuts: list[str], vocab: Ids, start: int) -> list[bytes]:
        """The ids of each cut, moved up, encoded together as in Ids."""
        ids = vocab.encode("\n".join(cuts)).astype("<u4", copy=False)
        ends = (np.flatnonzero(ids == vocab.newline) * 4).tolist()
        raw = (ids + np.uint32(start)).tobytes()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)])]


@lru_cache(maxsize=4)
def vocabulary(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Ids:
    """One memo for each worker and vocabulary."""
    return Ids(ranks_path, pattern, added)


@lru_cache(maxsize=4)
def joint(ranks_paths: tuple[str, ...], pattern: str) -> JointIds:
    """One memo for each worker and set of vocabularies."""
    return JointIds(tuple(vocabulary(p, pattern) for p in ranks_paths))


def added_tokens(json_path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a tokenizer file. Those that take in space beside them or need word borders aren't supported."""
    with open(json_path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens with lstrip, rstrip or single_word")
    return tuple((t["content"], t["id"]) for t in found)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
