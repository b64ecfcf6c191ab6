"""Encoding by pieces: a text is cut at places that are also boundaries of the byte-level split pattern.

In that pattern a space belongs to what follows it, a line feed between characters that aren't white space is
a match of its own, and no match holds a character that isn't white space followed by white space. So a text whose
white space is single spaces and single line feeds, none at the end, can be cut before each. Other texts are
encoded whole.

Pieces repeat, and a piece often is a known one with a comma or a full stop. Each worker process remembers recent
pieces, and pre-tokens of the rarer kinds, over its tasks, in bounded memory, so most are encoded once.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

# Fixed value: the split pattern of byte-level vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER_SPACE = re.compile(r"[^\S \n]")
ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: Longer strings aren't remembered.
LONGEST = 64


def pieces(text: str) -> list[str] | None:
    """The first piece as it is; others without their space, or with their line feed. None if the text can't be cut."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[-1:] in (" ", "\n") or text[:1] == "\n":
        return None
    if any(c in text for c in ASCII_SPACE) if text.isascii() else OTHER_SPACE.search(text):
        return None
    return text.replace("\n", " \n").split(" ")


class Recent:
    """What the last ``limit`` to ``2 * limit`` new strings stand for."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, s: str) -> bytes | None:
        v = self.young.get(s)
        return self.old.get(s) if v is None else v

    def keep(self, values: dict[str, bytes]) -> None:
        if len(self.young) + len(values) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update(values if max(map(len, values), default=0) <= LONGEST else {s: v for s, v in values.items() if len(s) <= LONGEST})


class PieceEncoder:
    def __init__(self, encode: Callable[[list[str]], list[bytes]], split: Callable[[str], list[str]],
                 whole: Callable[[list[str]], list[bytes]] | None = None, limit: int = 500_000, tokens: int = 100_000):
        """encode: ids of each pre-token, as bytes; split: pre-tokens of a text by the byte-level pattern; whole: ids of
        texts that can't be cut (by default those of their pre-tokens)."""
        self.encode, self.split, self.whole = encode, split, whole or self._of_tokens
        self.first, self.rest, self.tokens = Recent(tokens), Recent(limit), Recent(tokens)
        gc.set_threshold(200_000, 20, 20)  # many small strings and no cycles: looking for garbage often is wasted
        self.ends = dict(zip(".,", encode([".", ","])))

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [pieces(t) for t in texts]
        get, get_first = self.rest.young.get, self.first.young.get
        found: list[list | None] = []
        new_first, new_rest, holes = set(), set(), []
        for p in cut:
            if p is None:
                found.append(None)
                continue
            f = list(map(get, p))
            f[0] = get_first(p[0])
            found.append(f)
            if None in f:
                miss = [i for i, v in enumerate(f) if v is None]
                holes.append((p, f, miss))
                if not miss[0]:
                    new_first.add(p[0])
                    new_rest.update([p[i] for i in miss[1:]])
                else:
                    new_rest.update([p[i] for i in miss])
        of_first = self._learn_first(new_first)
        of_rest = self._learn_rest(new_rest)
        for p, f, miss in holes:
            for i in miss:
                f[i] = of_rest[p[i]] if i else of_first[p[0]]
        whole = iter(self.whole([t for t, p in zip(texts, cut) if p is None]))
        return [next(whole) if f is None else b"".join(f) for f in found]

    def _learn_first(self, new: set[str]) -> dict[str, bytes]:
        out = dict(zip(new, self._of_tokens(list(new))))
        self.first.keep(out)
        return out

    def _learn_rest(self, new: set[str]) -> dict[str, bytes]:
        get, old = self.rest.get, self.rest.old.get
        out: dict[str, bytes] = {}
        words: dict[str, bytes | None] = {}
        ended, other = [], []
        for p in new:
            v = old(p)
            if v is not None:
                out[p] = v
            elif p.isalpha():
                words[p] = None
            elif p[-1:] in self.ends and (w := p[:-1]).isalpha():
                ended.append(p)
                if w not in words and get(w) is None:
                    words[w] = None
            else:
                other.append(p)
        words.update(zip(words, self.encode([" " + w for w in words])))
        out.update(words)
        for p in ended:
            out[p] = (out.get(p[:-1]) or get(p[:-1])) + self.ends[p[-1]]
        out.update(zip(other, self._of_tokens([p if p[:1] == "\n" else " " + p for p in other])))
        self.rest.keep(out)
        return out

    def _of_tokens(self, texts: list[str]) -> list[bytes]:
        split, get = [self.split(t) for t in texts], self.tokens.get
        new = list({t for s in split for t in s if get(t) is None})
        made = dict(zip(new, self.encode(new)))
        out = [b"".join([made[t] if t in made else get(t) for t in s]) for s in split]
        self.tokens.keep(made)
        return out
