"""Token counts by greedy longest match, without building the tokens.

The vocabulary is a prefix tree over bytes. Each state has a failure link: where matching goes on once the
longest tokens at the start of what has been read are taken off, and how many tokens that takes off. A word is
then one pass over its bytes that adds up those numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, keyed_text, text_chunks

#: Symbol after the last byte of a word, so that tokens which end a word are entries like any other.
END = 256
#: Words whose counts a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

_automata: dict[int, "LongestMatch"] = {}


class LongestMatch:
    """Automaton over ``tokens``: pairs of (bytes, ends the word)."""

    def __init__(self, tokens: Iterable[tuple[bytes, bool]]):
        self.next: list[dict[int, int]] = [{}]
        accepts = [False]
        for token, ends in tokens:
            at = 0
            for symbol in [*token, END] if ends else token:
                to = self.next[at].get(symbol)
                if to is None:
                    to = self.next[at][symbol] = len(self.next)
                    self.next.append({})
                    accepts.append(False)
                at = to
            accepts[at] = at > 0
        self.fail, self.popped = [-1] * len(accepts), [0] * len(accepts)
        level = [0]
        while level:  # breadth first: links only point to shorter strings
            below = []
            for state in level:
                for symbol, child in self.next[state].items():
                    below.append(child)
                    if accepts[child]:
                        self.fail[child], self.popped[child] = 0, 1
                        continue
                    to, n = self.fail[state], self.popped[state]
                    while to >= 0 and symbol not in self.next[to]:
                        n += self.popped[to]
                        to = self.fail[to]
                    if to >= 0:
                        self.fail[child], self.popped[child] = self.next[to][symbol], n
            level = below
        # a bare end mark is no token: a word that is used up before it has been read is complete as well
        self.words: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Tokens of one word; 0 if some part of it matches none (the word is then one unknown token)."""
        state, n = 0, 0
        for symbol in [*word, END]:
            follow = self.next[state]
            while symbol not in follow:
                if symbol == END and state == 0:
                    return n
                n += self.popped[state]
                state = self.fail[state]
                if state < 0:
                    return 0
                follow = self.next[state]
            state = follow[symbol]
        while state > 0:
            n += self.popped[state]
            state = self.fail[state]
        return n if state == 0 else 0

    def count_words(self, words: list[bytes]) -> tuple[int, int]:
        """Tokens of all words, unknown words counted as one, and the number of unknown words."""
        known = self.words
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.count(w)
        counts = list(map(known.__getitem__, words))
        unknown = counts.count(0)
        return sum(counts) + unknown, unknown


def read_vocabulary(path: str, end_mark: str = "</w>") -> list[tuple[bytes, bool]]:
    """Tokens of a byte-level tokenizer file (JSON) whose word-final tokens carry ``end_mark``."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that stand for themselves
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    out = []
    for name in names:
        ends = name.endswith(end_mark)
        stem = name.removesuffix(end_mark)
        if stem and all(c in byte_of for c in stem):
            out.append((bytes(byte_of[c] for c in stem), ends))
    return out


def count_tokens(docs: DataFrame, vocabulary: list[tuple[bytes, bool]], id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens, n_unknown.

    A-Z are lower-cased; words end at ASCII white space. A word is split into the longest tokens from the left;
    a token that ends a word fits only there. If that fails at some point, the whole word is one unknown token.
    Null and empty texts have no words. Equal rows give equal rows, null ids stay null, other columns are left
    out. The vocabulary is broadcast: its size does not depend on the data.
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(vocabulary), hash(tuple(vocabulary))

    def run(batches):
        if key not in _automata:
            _automata.clear()
            _automata[key] = LongestMatch(shared.value)
        automaton = _automata[key]
        for rows, texts in text_chunks(batches):
            n_words, n_tokens, n_unknown = [], [], []
            for text in texts:
                words = text.lower().split()
                tokens, unknown = automaton.count_words(words)
                n_words.append(len(words))
                n_tokens.append(tokens)
                n_unknown.append(unknown)
            yield batch_of(OUT, doc_id=rows.column("id"), n_words=n_words, n_tokens=n_tokens, n_unknown=n_unknown)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
