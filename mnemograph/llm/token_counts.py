"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's strings (word-end marks taken off) form a trie over the byte alphabet of the
vocabulary file. Each node has a failure link and the number of pieces that following it pops, both
computed once, so a word's piece count takes one pass over its symbols and no piece is built. Words
repeat, so each worker keeps counts of words it has met in a bounded cache.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8 bytes. Every byte is
in the vocabulary, so no word is unknown; with a vocabulary that lacks one, a word that can't be
matched counts as one piece (the unknown piece).

Defined cases: null or empty texts have no words and no tokens; null and repeated ids give a row
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemograph.llm.common import take_over, two


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others numbered upward from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in kept else extra))
        extra += b not in kept
    return out


class LongestMatch:
    """Counts the pieces of greedy longest-match-first over ``vocabulary`` in linear time."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][b]
            final[node] = node > 0
        # fail[v]: where matching goes on after popping pops[v] pieces; -1: no match is possible
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in self.next[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and b not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][b], popped

    def count(self, word: bytes) -> int:
        node, n, step = 0, 0, self.next
        for b in word:
            while b not in step[node]:
                n += self.pops[node]
                node = self.fail[node]
                if node < 0:
                    return 1
            node = step[node][b]
        while node:
            n += self.pops[node]
            node = self.fail[node]
            if node < 0:
                return 1
        return n


def vocabulary(name: str) -> list[bytes]:
    with open(name if os.path.isabs(name) else public_tokenizers.path(name), encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    back = {c: b for b, c in enumerate(byte_symbols())}
    plain = (t.removesuffix("</w>") for t in spec["model"]["vocab"] if t not in special)
    return sorted({bytes(back[c] for c in t) for t in plain if t and all(c in back for c in t)})


_made: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def count_tokens(df: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", cache_words: int = 1_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("token_counts", _made.clear)
        if tokenizer not in _made:
            _made[tokenizer] = LongestMatch(vocabulary(tokenizer)), {}
        automaton, known = _made[tokenizer]
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                words = raw.lower().split()  # of bytes: A-Z only, and ASCII white space only
                try:
                    n = sum(map(known.__getitem__, words))
                except KeyError:
                    if len(known) > cache_words:
                        known.clear()
                    for w in {*words}:
                        if w not in known:
                            known[w] = automaton.count(w)
                    n = sum(map(known.__getitem__, words))
                rows.append((len(raw), len(words), n))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    return two(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
