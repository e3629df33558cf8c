"""Token ids of the public tokenizers, with a bounded cache of the parts between single spaces.

A text's ids are the ids of its parts one after another wherever no token can cross the cut, so the
frequent parts are encoded once per Python worker. ``encode`` gives what the library gives for the
whole text.
"""

from __future__ import annotations

import os
import re
from struct import pack

import numpy as np
import public_tokenizers

from mnemograph.llm.common import take_over
from mnemograph.llm.token_counts import byte_symbols

#: Where one of these stands, cuts at single spaces and newlines can change byte-level tokens.
ODD_SPACE = ("  ", "\n\n", "\n ", " \n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
WIDE_SPACE = re.compile("[\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Marks that always make tokens of their own after a letter.
MARKS = ".,!?;:"
#: Its lower case is two characters, and the second joins a mark that follows.
ODD_LETTER = "\u0130"
SEPARATOR = "<|endoftext|>"


class CachedTokenizer:
    """``encode(text)`` returns the ids as little-endian unsigned 32-bit integers in bytes, as the library
    gives them with ``add_special_tokens=False`` and no other switch: the strings of special tokens
    in a text are those tokens.

    ``spaces``: "dropped" if the tokenizer drops white space, "joined" if a word's token holds the
    space before it. ``most_bytes``: what the caches may hold, about. They have two generations: when the
    younger is full it becomes the older, and what is met again moves back, so frequent words stay.
    """

    def __init__(self, name: str, spaces: str, most_bytes: int = 240 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        self.model = self.plain.model
        self.separator = self.plain.token_to_id(SEPARATOR)
        self.joined, self.most, self.held = spaces == "joined", most_bytes // 2, 0
        self.cache, self.cores, self.tails, self.heads = {}, ({}, {}), {}, {}
        self.old_cache, self.old_cores = {}, ({}, {})
        self.symbols, self.newline = byte_symbols(), self.whole("\n") if spaces == "joined" else b""

    def whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _put(self, words: list[str]) -> None:
        """Encode ``words`` in one call, told apart by the separator, into the cache."""
        pieces = [w if w[0] == "\n" or not self.joined else " " + w for w in words]
        ids = np.array(self.plain.encode_batch_fast([SEPARATOR.join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.separator)
        if len(cuts) != len(words) - 1:  # a part that the library reads together with the separator
            self.cache.update((w, self.whole(p)) for w, p in zip(words, pieces, strict=True))
            return
        raw, at = ids.tobytes(), 0
        for w, cut in zip(words, [*cuts.tolist(), len(ids)], strict=True):
            self.cache[w] = raw[4 * at : 4 * cut]
            at = cut + 1

    def _learn(self, words: list[str]) -> None:
        if self.held > self.most:
            self.old_cache, self.old_cores, self.held = self.cache, self.cores, 0
            self.cache, self.cores, self.tails, self.heads = {}, ({}, {}), {}, {}
        cache, old, alone = self.cache, self.old_cache, []
        for w in {w for w in words if w not in cache}:
            self.held += 160 + 2 * len(w)
            if w in old:
                cache[w] = old[w]
                continue
            core = w.rstrip(MARKS)
            tail, start = w[len(core) :], core[:1] == "\n"
            core = core[1:] if start else core
            if core.isalpha() and (core.isascii() or max(core) < "\u0300" and ODD_LETTER not in core):
                # letters that normal forms leave alone: one part, which the model takes as it is
                ids = self.cores[start].get(core)
                if ids is None:
                    ids = self.old_cores[start].get(core)
                    ids = self.cores[start][core] = self._part(core, start) if ids is None else ids
                    self.held += 160 + 2 * len(core)
                if tail not in self.tails:
                    self.tails[tail] = self.whole(tail) if tail else b""
                cache[w] = ids + self.tails[tail]
            elif not w:
                cache[w] = self.whole(" " if self.joined else "")
            else:
                alone.append(w)
        if alone:
            self._put(alone)

    def _part(self, letters: str, line_start: bool) -> bytes:
        """Ids of one word of letters; with ``line_start`` after a newline instead of a space."""
        if self.joined:
            lead = "" if line_start else self.symbols[32]
        else:
            lead, letters = "", letters.lower()
        if not letters.isascii():
            letters = "".join(map(self.symbols.__getitem__, letters.encode()))
        part = self.model.tokenize(lead + letters)
        ids = pack(f"<{len(part)}I", *[t.id for t in part])
        return self.newline + ids if line_start else ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:  # a special token's string, or what may become one
            return self.whole(text)
        head = b""
        if self.joined:
            if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ODD_SPACE) or WIDE_SPACE.search(text):
                return self.whole(text)
            # "\nWord" stands for itself; every other word has a space before it, but for the first
            words = text.replace("\n", " \n").split(" ")
            first = words.pop(0)
            if first not in self.heads:
                self.heads[first] = self.whole(first)
                self.held += 160 + 2 * len(first)
            head = self.heads[first]
        else:
            words = text.replace("\n", " ").split(" ")
        out = []
        for i in range(0, len(words), 200_000):
            part = words[i : i + 200_000]
            try:
                out.append(b"".join(map(self.cache.__getitem__, part)))
            except KeyError:
                self._learn(part)
                out.append(b"".join(map(self.cache.__getitem__, part)))
        return head + b"".join(out)


_made: dict[tuple[str, str], CachedTokenizer] = {}


def cached(name: str, spaces: str, most_bytes: int) -> CachedTokenizer:
    """The Python worker's tokenizer; it holds one at a time."""
    take_over("tokens", _made.clear)
    if (name, spaces) not in _made:
        _made.clear()
        _made[name, spaces] = CachedTokenizer(name, spaces)
    _made[name, spaces].most = most_bytes // 2
    return _made[name, spaces]
