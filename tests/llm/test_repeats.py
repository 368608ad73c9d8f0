"""Passages that repeat, and near duplicates, against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from llm_rows import same
from tidewire.llm import blocks, simhash, suffix

NULL = 1 << 63


def raw(text):
    return (text or "").encode()


def byte_repeats(rows, width):
    first = {}
    for i, text, *_ in rows:
        t, i = raw(text), NULL if i is None else i
        for p in range(len(t) - width + 1):
            first[t[p:p + width]] = min(first.get(t[p:p + width], NULL), i)
    for i, text, *_ in rows:
        t, gone = raw(text), np.zeros(len(raw(text)), bool)
        for p in range(len(t) - width + 1):
            if first[t[p:p + width]] < (NULL if i is None else i):
                gone[p:p + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield i, len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("width,gram", [(50, 26), (20, 8)])
def test_byte_passages(docs, no_docs, rows, width, gram, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 20_000)
    monkeypatch.setattr(suffix, "SHARD", 50_000)
    monkeypatch.setattr(suffix, "BATCH", 3_000)
    out = suffix.remove_repeats(docs, width, gram).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out], byte_repeats(rows, width))
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in out)
    assert any(r.n_removed for r in out)
    assert suffix.remove_repeats(no_docs, width, gram).count() == 0


def test_intervals_against_sorted_strings():
    rng = np.random.default_rng(0)
    for _ in range(150):
        k, width = int(rng.integers(1, 12)), int(rng.integers(2, 9))
        pieces = [bytes(rng.choice([97, 98, 99], rng.integers(0, 30)).astype(np.uint8)) for _ in range(k)]
        owner, best = rng.permutation(k), {}
        for p, o in zip(pieces, owner):
            for i in range(len(p) - width + 1):
                best[p[i:i + width]] = min(best.get(p[i:i + width], NULL - 1), o)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        if len(data):
            starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(int)
            want = [best.get(p[i:i + width], NULL - 1) if i + width <= len(p) else NULL - 1 for p in pieces for i in range(len(p))]
            assert suffix.smallest_with(data, starts, owner, width).tolist() == want


def test_wide_intervals(monkeypatch):
    """Rows of an interval and symbols of an interval give the same boundaries."""
    text = np.random.default_rng(1).integers(1, 4, 3000).astype(np.uint8)
    text[-1] = 0
    last = text[suffix.suffix_order(text, 20) - 1]
    narrow = suffix.boundaries(last, 20)
    monkeypatch.setattr(suffix, "NARROW", 2)
    assert (suffix.boundaries(last, 20) == narrow).all()


def word_repeats(rows, width):
    lists = [raw(t).split() for _, t, *_ in rows]
    count = Counter(tuple(w[p:p + width]) for w in lists for p in range(len(w) - width + 1))
    for (i, *_), w in zip(rows, lists):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - width + 1):
            if count[tuple(w[p:p + width])] > 1:
                gone[p:p + width] = True
        yield i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()


@pytest.mark.parametrize("width", [35, 12, 5])
def test_word_passages(docs, no_docs, rows, width, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 20_000)
    monkeypatch.setattr(blocks, "SHARD", 50_000)
    out = blocks.remove_repeats(docs, width).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out], word_repeats(rows, width))
    assert any(r.n_removed for r in out)
    assert blocks.remove_repeats(no_docs, width).count() == 0


def fingerprint(text, width=4):
    words = raw(text).lower().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    votes = Counter(b for s in shingles for b in range(64) if xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in votes if votes[b] * 2 > len(shingles))


def groups(ids, fps, distance):
    """Smallest id reachable from each row."""
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    least = defaultdict(lambda: NULL)
    for i, k in zip(ids, range(len(fps))):
        least[root(k)] = min(least[root(k)], NULL if i is None else i)
    return [None if least[root(k)] == NULL else least[root(k)] for k in range(len(fps))]


def test_near_duplicates(docs, no_docs, rows):
    fps = [fingerprint(t) for _, t, *_ in rows]
    want = [(r[0], f, c) for r, f, c in zip(rows, fps, groups([r[0] for r in rows], fps, 4))]
    out = simhash.near_duplicates(docs).collect()
    same([(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in out], want)
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("block", [4096, 8])
@pytest.mark.parametrize("n", [1, 700])
def test_links_find_every_pair(spark, n, block, monkeypatch):
    """Clouds of fingerprints around centres, with bits that go together; small blocks cut the buckets."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 62, 30).astype(np.uint64)
    fps = set()
    for _ in range(n):
        f = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            f ^= 1 << int(b)
        fps.add((f & ~0xFF00) | (0xFF00 if f & 1 else 0))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64)
    found = simhash.links(spark.createDataFrame([(int(f),) for f in signed], "fp long"), 4).collect()
    edges = list(range(len(fps)))
    at = {int(f): i for i, f in enumerate(signed)}

    def root(x):
        while edges[x] != x:
            x = edges[x]
        return x

    for e in found:
        x, y = sorted((root(at[e.node]), root(at[e.root])))
        edges[y] = x
    want = groups(range(len(fps)), fps, 4)
    least = defaultdict(lambda: NULL)
    for i in range(len(fps)):
        least[root(i)] = min(least[root(i)], i)
    assert [least[root(i)] for i in range(len(fps))] == want


def test_thresholds_add_up():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 62, 500)
    for m in (2, 3, 4, 5):
        parts = simhash.deal_bits(np.full((64, 64), 100), 400, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        cuts = [[p[i:i + simhash.TABLE_BITS] for i in range(0, len(p), simhash.TABLE_BITS)] for p in parts]
        tables = [[np.bincount(simhash.gather_bits(fp, c), minlength=1 << len(c)) for c in cs] for cs in cuts]
        plan = simhash.Plan(len(fp), parts, tables, 4)
        assert (plan.thresholds(fp).sum(axis=1) == 4 - m + 1).all()


def test_anchor_keys_fall_into_all_shards_alike():
    rng = np.random.default_rng(3)
    keys = suffix.Anchors([rng.integers(97, 123, 200_000).astype(np.uint8).tobytes()], 50, 26).key
    count = np.bincount(suffix.logbloom.segment_of(keys, 16), minlength=16)
    assert count.max() < 1.5 * count.mean() and count.min() > 0.5 * count.mean()


@pytest.mark.parametrize("batch", [1 << 20, 2000, 100])
def test_surroundings_of_one_anchor_are_dealt(monkeypatch, batch):
    rng, sorted_at_once, sort = np.random.default_rng(5), [], suffix.smallest_with
    monkeypatch.setattr(suffix, "BATCH", batch)
    monkeypatch.setattr(suffix, "smallest_with", lambda data, *x: sorted_at_once.append(len(data)) or sort(data, *x))
    gram, some = b"0123456789ABCDEFGHIJKLMNOP", lambda n, of: rng.choice(list(of), n).astype(np.uint8).tobytes()
    ends = [some(9, b"xy") for _ in range(3)]
    pieces = [(some(int(rng.choice([24, 24, 24, 7, 0])), b"ab"), ends[rng.integers(0, 3)] + some(15, b"abc")) for _ in range(400)]
    pieces = [(a, a + gram + b[:24 if len(a) < 24 else int(rng.choice([24, 24, 11, 0]))]) for a, b in pieces]
    before, size = (np.array([len(p[i]) for p in pieces]) for i in (0, 1))
    owner, best = rng.permutation(400), {}
    for (a, p), o in zip(pieces, owner):
        for n in range(len(p) - 49):
            best[p[n:n + 50]] = min(best.get(p[n:n + 50], NULL - 1), o)
    text = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    got = suffix.least_owners(text, np.cumsum(size) - size, size, before, owner, 50)
    assert got.tolist() == [[best.get(p[n:n + 50], NULL - 1) if n <= len(p) - 50 else NULL - 1 for n in range(25)] for _, p in pieces]
    assert max(sorted_at_once, default=0) <= 2 * batch


def test_chunks_are_read_in_small_pieces(spark):
    """A task's chunks are several row groups: none has to be held whole."""
    import pyarrow.parquet as pq
    from tidewire.llm import exchange
    rng = np.random.default_rng(8)
    texts = [(i, rng.integers(97, 123, 1 << 20).astype(np.uint8).tobytes().decode()) for i in range(9)]
    table = exchange.Chunks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), 1 << 20).table
    sizes = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in table.inputFiles()]
    groups = [m.row_group(i).num_rows for m in sizes for i in range(m.num_row_groups)]
    assert sum(groups) == table.count() >= 9 and max(groups) <= 6
