"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut where no piece can span (before each run of spaces, around line ends); each part is merged by an agenda of
adjacent pairs, best score first, leftmost on ties, and repeated parts are merged once per worker. Parts met
for the first time are compared, a batch at a time, with the sentencepiece library, and a difference fails
the task, so a finished result is the library's.
"""

from __future__ import annotations

import heapq
import re
from operator import add
from struct import pack

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import batch_of, keyed_text, memory, text_chunks

SPACE = "▁"
#: Bytes of parts that a worker remembers, about: so many of recent ones, and as many of those before.
REMEMBERED = 96 << 20
OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

LOW = (1 << 32) - 1
#: Symbols of a part whose agenda is a list; and the rank of a pair that is no piece.
SHORT, NONE = 48, 1 << 62
_models: dict[bytes, "Merger"] = memory()


class Merger:
    """Encoder and decoder over the pieces and scores of a model."""

    def __init__(self, model: bytes):
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        plain = [i for i in range(len(names)) if not (
            lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        if any(lib.is_unused(i) for i in range(len(names))):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.ids = {names[i]: i for i in plain}
        place = {c: k for k, c in enumerate(sorted({-lib.get_score(i) for i in plain}))}
        #: Higher scores merge first; equal ones from the left.
        self.rank = {names[i]: place[-lib.get_score(i)] << 32 for i in plain}
        self.bytes = {int(names[i][3:5], 16): i for i in range(len(names)) if lib.is_byte(i)}
        self.unknown, self.bos, self.eos = lib.unk_id(), lib.bos_id(), lib.eos_id()
        probe = "  a ﬁ Ａ\n b "
        if lib.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models with an identity normaliser and a leading space are supported")
        # no merge crosses the start of a run of spaces unless a piece holds a space after another character,
        # nor a control character that is in no longer piece
        long = set("".join(p for p in self.ids if len(p) > 1))
        alone = re.escape("".join(c for c in map(chr, range(32)) if c not in long))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) or "\n" in long:
            raise ValueError("vocabularies whose pieces span words or lines are not supported")
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[{alone}]|[^{SPACE}{alone}]+")
        self.held = 0
        self.before: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        #: What the ids of a part show, for the parts of ``before`` and ``known``.
        self.raw_before: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        shown = {i: names[i].replace(SPACE, " ").encode() for i in plain}
        self.shown = [shown.get(i, b"") for i in range(len(names))]
        self.shown[self.unknown] = " ⁇ ".encode()
        self.byte_of = {i: b for b, i in self.bytes.items()}
        for i, b in self.byte_of.items():
            self.shown[i] = bytes([b])

    def merge(self, part: str) -> list[int]:
        """Ids of one part: pop the best adjacent pair until none is a piece."""
        symbols = self._short(part) if len(part) <= SHORT else self._long(part)
        out, ids, byte = [], self.ids, self.bytes
        for s in symbols:
            if s:
                i = ids.get(s)
                if i is not None:
                    out.append(i)
                elif byte:
                    out += [byte[b] for b in s.encode()]
                elif not out or out[-1] != self.unknown:  # neighbours that are unknown share one id
                    out.append(self.unknown)
        return out

    def _short(self, part: str) -> list[str]:
        """The agenda as a list in the order of the text: the least rank, leftmost on ties, is taken from it."""
        get, symbols = self.rank.get, list(part)
        agenda = [get(pair, NONE) for pair in map(add, symbols, symbols[1:])]
        while agenda and (rank := min(agenda)) != NONE:
            i = agenda.index(rank)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], NONE)
        return symbols

    def _long(self, part: str) -> list[str]:
        """The agenda as a heap, for parts that a list would take too long for; merged symbols leave empty ones."""
        get, symbols, n = self.rank.get, list(part), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is one number: the rank of the pair above the place of its left symbol.
        agenda = [r | i for i, pair in enumerate(map(add, symbols, symbols[1:])) if (r := get(pair)) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & LOW
            j, left = after[i], symbols[i]
            if not left or j >= n:
                continue
            pair = left + symbols[j]
            if get(pair) != entry - i:
                continue  # one side has been merged since
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(pair + symbols[k])) is not None:
                    heapq.heappush(agenda, r | i)
            if (h := before[i]) >= 0 and (r := get(symbols[h] + pair)) is not None:
                heapq.heappush(agenda, r | h)
        return symbols

    def learn(self, parts: set[str]) -> None:
        """Merge the parts that are new, and hold them against the library, led by a line end that merges with nothing."""
        if self.held > REMEMBERED:
            self.held = 0
            self.before, self.known = self.known, {}
            self.raw_before, self.raw = self.raw, {}
        new, size = [], len(self.known)
        for p in parts:
            if p not in self.known:
                if (ids := self.before.get(p)) is not None:
                    self.known[p], self.raw[p] = ids, self.raw_before[p]
                else:
                    new.append(p)
        ours = [self.merge(p) for p in new]
        lead = len(self.lib.encode("\n"))
        theirs = self.lib.encode(["\n" + p for p in new], num_threads=1)
        if any(a != b[lead:] for a, b in zip(ours, theirs)):
            raise RuntimeError("merging differs from the sentencepiece library")
        for p, ids in zip(new, ours):
            self.known[p] = pack(f"<{len(ids)}I", *ids)
            self.raw[p] = b"".join(map(self.shown.__getitem__, ids))
        # two entries of two dictionaries, and the part, its ids and its bytes as objects
        self.held += 350 * (len(self.known) - size) + 8 * sum(map(len, new))

    def encode_and_decode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids with begin and end, and what they decode to. The bytes of a part are remembered with its ids; only where they do
        not make a text, or do not begin with the piece of a space, the ids are decoded one by one."""
        cut = [self.parts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(set().union(*cut))
        bos, eos = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        ids, raw = self.known.__getitem__, self.raw.__getitem__
        packed = [b"".join([bos, *map(ids, c), eos]) for c in cut]
        decoded = []
        for c, own in zip(cut, packed):
            # A text starts with the mark of a space, which is a piece or the start of one, never bytes.
            text = b"".join(map(raw, c))
            try:
                decoded.append(text[1:].decode() if text[:1] == b" " and self.spaced(own[4:8]) else "" if not c else self.decode(own))
            except UnicodeDecodeError:
                decoded.append(self.decode(own))
        return packed, decoded

    def spaced(self, first: bytes) -> bool:
        """Whether the first id of a text is a piece of its own that starts with a space."""
        i = int.from_bytes(first, "little")
        return i not in self.byte_of and i != self.unknown and self.shown[i][:1] == b" "

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: spaces restored, the leading one dropped, byte pieces joined."""
        seq = np.frombuffer(ids, "<u4").tolist()
        seq = seq[seq[:1] == [self.bos]:len(seq) - (seq[-1:] == [self.eos])]
        raw = b"".join(map(self.shown.__getitem__, seq))
        first = next((i for i in seq if self.shown[i]), None)
        skip = first is not None and first not in self.byte_of and first != self.unknown and raw[:1] == b" "
        if self.bos not in seq and self.eos not in seq:
            try:
                return raw[skip:].decode()
            except UnicodeDecodeError:
                pass
        out, run = [], b""  # a run of byte pieces ends at any other; its bytes that form no character count alone
        for i in [*seq, self.eos]:
            if i in self.byte_of:
                run += self.shown[i]
                continue
            while run:
                n = next((n for n in (1, 2, 3, 4) if _is_utf8(run[:n])), 0)
                out.append(run[:n].decode() if n else "�")
                run = run[max(n, 1):]
            out.append(self.shown[i].decode())
        return "".join(out)[skip:]


def _is_utf8(raw: bytes) -> bool:
    try:
        return bool(raw.decode())
    except UnicodeDecodeError:
        return False


def merger(model: bytes) -> Merger:
    if model not in _models:
        _models[model] = Merger(model)
    return _models[model]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (packed unsigned 32-bit, begin and end included), decoded.

    A null or empty text has the two ids begin and end and decodes to the empty text. Equal rows give equal
    rows, null ids stay null, no text is cut, other columns are left out. The model file is read on the driver
    and sent along; its size does not depend on the data.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        m = merger(model.value)
        for rows, texts in text_chunks(batches):
            ids, decoded = m.encode_and_decode([t.decode() for t in texts])
            yield batch_of(OUT, doc_id=rows.column("id"), ids=ids, decoded=decoded)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


@F.udf(ArrayType(LongType()), useArrow=True)
def unpack_ids(ids):
    """Packed ids as integers."""
    return None if ids is None else np.frombuffer(ids, "<u4").tolist()
