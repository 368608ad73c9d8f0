"""Duplicate passages of bytes: every byte in a string of ``width`` bytes that an earlier document has too.

Strings that are equal contain the same anchor, a ``GRAM``-byte string that has the least hash of a
window, so places that may be equal are found by their anchors. Anchors of several documents are
kept; where all their surroundings are equal, the smallest document id settles the matter; the other surroundings,
each once, are put together per shard and their common prefixes are derived from a Burrows-Wheeler transform:
intervals of strings are extended backward breadth first, so boundaries appear by increasing length of the
common prefix, and nothing is done beyond ``width``. What is left between boundaries are the equal strings. An anchor
with very many surroundings is dealt into pieces that share more of them, so what is sorted at a time stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..session import small_batches
from . import exchange, logbloom
from .common import MULTIPLIER, between, concat, covered, mix, ragged, rolling
from .exchange import Chunks

WIDTH, GRAM = 50, 26
#: Bytes of text per chunk, and per shard of the key space.
CHUNK, SHARD = 1 << 20, 8 << 20
#: Bytes that are sorted at a time; equal keys stay together up to twice as many.
BATCH = 384 << 10
#: Intervals up to this many rows are extended row by row, larger ones symbol by symbol.
NARROW = 256
KEY_BYTES, AROUND_BYTES = 5, 6
UNSHARED, SETTLED, OPEN = 0, 1, 2

KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary()), ("carried", pa.string())])
KEPT_DDL = ("doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary, "
            "carried string")

_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours."""
    length = 1
    while length * 2 <= width:
        x = pick(x[:-length], x[length:])
        length *= 2
    return pick(x[:len(x) - (width - length)], x[width - length:]) if width > length else x


class Anchors:
    """Anchors of the texts of a chunk: place, document, key, surroundings [low, high) and their hash."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        data, starts = concat(texts)
        self.data, self.starts = data, starts
        window = width - gram + 1
        if len(data) < width:
            self.at = np.zeros(0, np.int64)
            self.doc = self.low = self.high = self.at
            self.key = self.around = np.zeros(0, np.uint64)
            return
        h = rolling(_byte[data], gram)
        least = _sliding(h, window, np.minimum)[:len(data) - width + 1]
        across = between(np.clip(starts[1:] - width + 1, 0, len(least)), np.minimum(starts[1:], len(least)), len(least))
        wanted = np.zeros(len(h) + window - 1, np.uint64)
        wanted[window - 1:window - 1 + len(least)] = np.where(across, 0, least)
        del least, across
        # an anchor has the least hash of a window that lies in one text
        self.at = np.flatnonzero(_sliding(wanted, window, np.maximum)[:len(h)] == h)
        self.doc = np.searchsorted(starts, self.at, "right") - 1
        inside = self.at + gram <= starts[self.doc + 1]
        self.at, self.doc = self.at[inside], self.doc[inside]
        # least hashes lie near 0, so they are mixed again to fall into all shards alike
        self.key = mix(h[self.at])
        self.low = np.maximum(self.at + gram - width, starts[self.doc])
        self.high = np.minimum(self.at + width, starts[self.doc + 1])
        powers = np.cumprod(np.full(len(data) + 1, MULTIPLIER, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte[data] * powers[:-1])])
        del powers
        # the same bytes at other places differ by a power only; it is brought to the same one
        back = np.cumprod(np.full(len(data) + 1, pow(MULTIPLIER, -1, 1 << 64), np.uint64))
        shape = ((self.at - self.low) << 8 | (self.high - self.at)).astype(np.uint64)
        self.around = mix((sums[self.high] - sums[self.low]) * back[self.low] + shape * _byte[7])


class Entries:
    """Distinct (key, surroundings) of some anchors, sorted, with the smallest document id that has each."""

    def __init__(self, a: Anchors, ids: np.ndarray, which: np.ndarray):
        order = which[np.lexsort((ids[a.doc[which]], a.around[which], a.key[which]))]
        key, around, doc = a.key[order], a.around[order], ids[a.doc[order]]
        new_key = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        new = new_key | np.concatenate([[True], around[1:] != around[:-1]]) if len(key) else new_key
        self.first = np.flatnonzero(new)
        self.anchor, self.of = order, np.cumsum(new) - 1
        self.key, self.around, self.smallest = key[self.first], around[self.first], doc[self.first]
        self.example = order[self.first]
        self.key_first = np.flatnonzero(new_key[self.first])
        last = np.append(np.flatnonzero(new_key)[1:], len(key)) - 1 if len(key) else np.zeros(0, int)
        begin = np.flatnonzero(new_key)
        self.many_docs = np.maximum.reduceat(doc, begin) != np.minimum.reduceat(doc, begin) if len(key) else new_key
        self.many_around = around[begin] != around[last] if len(key) else new_key


def _numbers(ids: list) -> np.ndarray:
    """Ids as numbers; a null id is larger than any other."""
    return np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)


def _ask_keys(row: dict, shards: int, width: int, gram: int):
    a = Anchors(row["texts"], width, gram)
    e = Entries(a, _numbers(row["ids"]), np.arange(len(a.at)))
    keys = e.key[e.key_first]
    around = e.around[e.key_first] >> np.uint64(18) << np.uint64(2)
    around |= e.many_docs.astype(np.uint64) | e.many_around.astype(np.uint64) << np.uint64(1)
    yield from exchange.ask(row, ((s, [exchange.planes(exchange.within(keys[i:j], shards), KEY_BYTES), exchange.planes(around[i:j], AROUND_BYTES)])
                                  for s, i, j in logbloom.slices(keys, shards)))


def _tell_keys(bodies: list[list[bytes]]) -> list[bytes]:
    """Per key: not in several documents; in several, with equal surroundings; or with others."""
    size = [len(b[0]) // KEY_BYTES for b in bodies]
    key = np.concatenate([exchange.from_planes(b[0], KEY_BYTES) for b in bodies])
    around = np.concatenate([exchange.from_planes(b[1], AROUND_BYTES) for b in bodies])
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    count = np.diff(np.append(first, len(key)))
    flags, plain = around[order] & np.uint64(3), around[order] >> np.uint64(2)
    seen = np.bitwise_or.reduceat(flags, first)
    same = np.minimum.reduceat(plain, first) == np.maximum.reduceat(plain, first)
    code = np.where((count == 1) & (seen & np.uint64(1) == 0), UNSHARED, np.where(same & (seen < 2), SETTLED, OPEN))
    out = np.empty(len(key), np.uint8)
    out[order] = np.repeat(code, count)
    return [x.tobytes() for x in np.split(out, np.cumsum(size)[:-1])]


def _shared(row: dict, answers: list[bytes] | None, width: int, gram: int):
    """The anchors of a chunk and its entries whose keys several documents have, with the keys' codes."""
    a = Anchors(row["texts"], width, gram)
    ids = _numbers(row["ids"])
    code = np.frombuffer(b"".join(answers or []), np.uint8)
    keys = np.sort(a.key)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    own = code[np.searchsorted(keys, a.key)] if len(keys) else np.zeros(0, np.uint8)
    e = Entries(a, ids, np.flatnonzero(own != UNSHARED))
    return a, ids, e, own[e.example] if len(e.example) else np.zeros(0, np.uint8)


def _ask_around(row: dict, shards: int, width: int, gram: int):
    a, _, e, code = _shared(row, row["answer"], width, gram)
    open_ = code == OPEN
    low, high, at = a.low[e.example], a.high[e.example], a.at[e.example]

    def parts():
        for s, i, j in logbloom.slices(e.key, shards):
            which = np.flatnonzero(open_[i:j]) + i
            text, _ = ragged(low[which], high[which])
            yield s, [e.key[i:j].tobytes(), e.smallest[i:j].tobytes(), code[i:j].tobytes(), e.around[which].tobytes(),
                      (at - low)[which].astype(np.uint8).tobytes(), (high - low)[which].astype(np.uint8).tobytes(), a.data[text].tobytes()]

    yield from exchange.ask(row, parts())


def _tell_around(bodies: list[list[bytes]], width: int) -> list[bytes]:
    """Per entry, 64 bits: which of its strings some smaller document has. Bit i: the one that starts at its i-th byte."""
    size = [len(b[0]) // 8 for b in bodies]
    join = lambda i, t: np.frombuffer(b"".join(b[i] for b in bodies), t)
    key, smallest, code = join(0, np.uint64), join(1, np.int64), join(2, np.uint8)
    mask = np.zeros(len(key), np.uint64)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    least = np.empty(len(key), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(smallest[order], first), np.diff(np.append(first, len(key))))
    mask[(code == SETTLED) & (least < smallest)] = ~np.uint64(0)
    which = np.flatnonzero(code == OPEN)
    if len(which):
        around, before, length, text = join(3, np.uint64), join(4, np.uint8).astype(np.int64), join(5, np.uint8).astype(np.int64), join(6, np.uint8)
        begin = np.cumsum(length) - length
        order = np.lexsort((smallest[which], around, key[which]))
        k, r = key[which][order], around[order]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]))
        one, ends = order[first], np.append(first[1:], len(order))
        for i, j in _batches(k[first], np.concatenate([[0], np.cumsum(length[one])])):
            own, rows = one[i:j], order[first[i]:ends[j - 1]]
            low = least_owners(text, begin[own], length[own], before[own], smallest[which[own]], width)
            of = np.repeat(np.arange(j - i), ends[i:j] - first[i:j])
            for n in range(low.shape[1]):
                mask[which[rows]] |= (low[of, n] < smallest[which[rows]]).astype(np.uint64) << np.uint64(n)
    return [x.tobytes() for x in np.split(mask, np.cumsum(size)[:-1])]


def least_owners(text: np.ndarray, begin: np.ndarray, size: np.ndarray, before: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """[i, n]: the least owner of a piece that has the ``width`` bytes of piece i from its n-th on, around its own anchor; the
    largest number where fewer are left. A piece has ``size`` bytes from ``begin`` on, ``before`` of them before its anchor.

    Pieces of more than ``BATCH`` bytes are dealt by what strings with almost as many bytes before the anchor have in common, and
    those bytes are more and more; when they are the whole string, nothing is left to sort.
    """
    none = np.iinfo(np.int64).max
    out = np.full((len(begin), max(0, int((size - width).max()) + 1)), none)

    def put(which: np.ndarray, least: np.ndarray, few: int, many: int) -> None:
        """``least``: by byte of the pieces ``which``, one after the other; of strings with ``few`` to ``many`` bytes before the anchor."""
        first = np.cumsum(size[which]) - size[which]
        for n in range(out.shape[1]):
            has = np.flatnonzero((size[which] - width >= n) & (before[which] - n >= few) & (before[which] - n <= many))
            out[which[has], n] = least[first[has] + n]

    def sort(which: np.ndarray, few: int, many: int) -> None:
        place, _ = ragged(begin[which], begin[which] + size[which])
        put(which, smallest_with(text[place], np.concatenate([[0], np.cumsum(size[which])]), owner[which], width), few, many)

    def deal(which: np.ndarray, few: int, many: int) -> None:
        middle = (few + many) // 2
        for a, b in ((few, middle), (middle + 1, many)):
            # strings with a to b bytes before the anchor all hold the bytes from the a-th before it to this one behind its start
            own = which[(before[which] >= a) & (size[which] - before[which] >= width - b)]
            if not len(own):
                continue
            common = text[(begin + before)[own][:, None] + np.arange(-a, width - b)]
            _, group = np.unique(np.ascontiguousarray(common).view(f"V{common.shape[1]}")[:, 0], return_inverse=True)
            own, group = own[np.argsort(group, kind="stable")], np.sort(group)
            if a == b:  # each group has one string
                out[own, before[own] - a] = np.minimum.reduceat(owner[own], np.flatnonzero(np.diff(group, prepend=-1)))[group]
                continue
            for i, j in _batches(group, np.concatenate([[0], np.cumsum(size[own])])):
                (sort if size[own[i:j]].sum() <= 2 * BATCH else deal)(own[i:j], a, b)

    every = np.arange(len(begin))
    (sort if size.sum() <= 2 * BATCH else deal)(every, 0, int(before.max()))
    return out


def _batches(keys: np.ndarray, starts: np.ndarray):
    """Ranges of pieces with about ``BATCH`` bytes that do not part equal keys; equal strings have equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(first[1:], len(keys))
    at = 0
    while at < len(keys):
        to = int(ends[min(np.searchsorted(starts[ends], starts[at] + BATCH), len(ends) - 1)])
        yield at, to
        at = to


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first ``depth`` symbols or more, by doubling."""
    n, length = len(text), 8
    padded = np.concatenate([text.astype(np.uint64), np.zeros(length, np.uint64)])
    word = padded[:n].copy()
    for i in range(1, length):
        word <<= np.uint64(8)
        word |= padded[i:i + n]
    while True:
        order = np.argsort(word)
        if length >= depth:
            return order
        ordered = word[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        word = rank << np.uint64(32)
        word[:n - length] |= rank[length:]
        length *= 2


def boundaries(last: np.ndarray, depth: int) -> np.ndarray:
    """Where, in suffix order, neighbours have a common prefix below ``depth``, from the Burrows-Wheeler transform.

    Interval expansion, breadth first: the interval of a string is extended by each symbol before it; if the end of
    the new interval has no boundary yet, the common prefix there is as long as the string, and the interval goes on.
    """
    n = len(last)
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    by_symbol = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    ordered = last[by_symbol]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[by_symbol] = np.where(new, -1, np.concatenate([[-1], by_symbol[:-1]]))
    after[by_symbol] = np.where(np.append(new[1:], True), n, np.append(by_symbol[1:], n))
    symbols = np.append(np.flatnonzero(new), n)
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        wide = high - low > NARROW
        row, of = ragged(low[~wide], high[~wide])
        lows = [np.sort(step[row[before[row] < low[~wide][of]]])]
        highs = [np.sort(step[row[after[row] >= high[~wide][of]]]) + 1]
        if wide.any():
            for a, b in zip(symbols[:-1].tolist(), symbols[1:].tolist()):
                i, j = np.searchsorted(by_symbol[a:b], low[wide]), np.searchsorted(by_symbol[a:b], high[wide])
                lows.append(a + i[j > i])
                highs.append(a + j[j > i])
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = ~bound[high]
        low, high = low[fresh], high[fresh]
        bound[high] = True
        if not len(low):
            break
    return bound


def smallest_with(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For each byte of the pieces [starts[i], starts[i + 1]): the least owner of a piece that has the ``width``
    bytes from there on; the largest number where fewer are left in the piece."""
    size = np.diff(starts)
    used = np.zeros(256, bool)
    used[data] = True
    code = (np.cumsum(used) + 1).astype(np.uint16)  # 0: end of all, 1: end of a piece
    if used.all():
        raise ValueError("text of valid UTF-8 does not use every byte value")
    piece = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data)) + piece
    text = np.ones(len(data) + len(size) + 1, np.uint8)
    text[at] = code[data]
    text[-1] = 0
    order = suffix_order(text, width)
    bound = boundaries(text[order - 1], width)
    whose = np.full(len(text), -1, np.int64)
    left = starts[1:][piece] - np.arange(len(data))
    whose[at[left >= width]] = piece[left >= width]
    rows = np.flatnonzero(whose[order] >= 0)
    out = np.full(len(text), np.iinfo(np.int64).max)
    if len(rows):
        group = np.cumsum(bound[:-1])[rows]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(owner[whose[order[rows]]], first)
        out[order[rows]] = np.repeat(least, np.diff(np.append(first, len(rows))))
    return out[at]


def _kept(row: dict, shards: int, width: int, gram: int):
    keys, masks = exchange.split_turns(row["answer"])
    a, ids, e, _ = _shared(row, keys, width, gram)
    mask = np.frombuffer(b"".join(masks), np.uint64)
    starts = np.zeros(len(a.data), bool)
    if len(e.anchor):
        # all documents of a chunk that have an entry, but the smallest, have a smaller one: that
        bits = np.where(ids[a.doc[e.anchor]] > e.smallest[e.of], ~np.uint64(0), mask[e.of])
        some = np.flatnonzero(bits)
        bits, low, strings = bits[some], a.low[e.anchor[some]], (a.high - a.low)[e.anchor[some]] - width + 1
        for i in range(width - gram + 1):
            starts[(low + i)[(strings > i) & (bits >> np.uint64(i) & np.uint64(1) == 1)]] = True
    gone = covered(np.flatnonzero(starts), width, len(a.data))
    out = {f.name: [] for f in KEPT}
    for i, (doc_id, text, carried) in enumerate(zip(row["ids"], row["texts"], row["carried"])):
        own = gone[a.starts[i]:a.starts[i + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2)
        kept = np.frombuffer(text, np.uint8)[~own].tobytes() if len(edge) else text
        for name, value in zip(out, (doc_id, len(text), int(own.sum()), [{"start": x, "stop": y} for x, y in edge.tolist()], kept, carried)):
            out[name].append(value)
    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in KEPT], schema=KEPT)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                   carry: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (bytes), and
    what ``carry`` gave for the row as ``carried``.

    A byte goes if a string of ``width`` bytes over it, in its document, also starts in a document with a smaller id.
    Strings are those of the input texts, do not cross texts, and may overlap. Rows with the same id count as one
    document, null ids as larger than all others; null and empty texts have nothing to remove.
    """
    if not 0 < width - gram < 64 or width > 127:
        raise ValueError("width must exceed gram by at most 63 and be below 128")
    chunks = Chunks(docs, CHUNK, id_col, text_col, carry)
    shards = chunks.shards(SHARD)
    with small_batches(chunks.spark):
        asked = chunks.map(chunks.table, lambda row: _ask_keys(row, shards, width, gram), exchange.ASK_DDL)
        codes = exchange.answered(asked, _tell_keys, "codes")
        asked = chunks.map(chunks.with_answers(codes), lambda row: _ask_around(row, shards, width, gram), exchange.ASK_DDL)
        masks = exchange.answered(asked, lambda bodies: _tell_around(bodies, width), "masks")
    both = exchange.in_turn(codes, masks, shards)
    return chunks.map(chunks.with_answers(both), lambda row: _kept(row, shards, width, gram), KEPT_DDL)
