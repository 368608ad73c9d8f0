"""Source divergence, line dedup and the conversation trie against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import numpy as np
import pytest

from llm_rows import same
from tidewire.llm import divergence, lines, trie


# source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def audited(rows, least, terms):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        sources = sorted({s for _, s, _ in own}, key=str.encode)
        df = Counter(t for _, _, ts in own for t in set(ts))
        kept = [t for t, n in df.items() if n >= least]
        count = {s: Counter(t for _, x, ts in own if x == s for t in ts) for s in sources}
        everything = sum(count.values(), Counter())

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        ps, q = {s: p(count[s]) for s in sources}, p(everything)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pair = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(ps[s][t], q[t])) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(found if part == "pair" else found[:terms], 1):
                    yield lang, s, part, item, value, rank


@pytest.mark.parametrize("block,held,pairs", [(128, 400_000, 1 << 19), (2, 3, 4)])
def test_audit(spark, monkeypatch, block, held, pairs):
    for name, value in (("BLOCK", block), ("HELD", held), ("PAIRS", pairs), ("LEAST_DOCUMENTS", 3)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(5)
    words = ["Alpha", "beta", "Été", "zoo", "ÉTÉ", "gamma", "x", "日本"]
    texts = [" ".join(rng.choice([*words, f"rare{'abcdefgh'[rng.randint(0, 7)] * rng.randint(1, 9)}"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    rows = [(rng.choice(texts), rng.choice(["a", "b"]), f"s{rng.randint(0, 6)}") for _ in range(150)]
    rows += [(None, "a", "s1"), ("", "a", "none"), (None, None, None), ("beta", "", ""), ("word " * 40_000, "b", "s1"), ("only", "lone", "one"), ("5 %", "c", "s1"), ("5 %", "c", None)]
    rows += rows[:20] + [("beta gamma", "a", "s9")] * 40
    df = spark.createDataFrame([(i % 7, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(4)
    same(divergence.audit(df).collect(), audited(rows, 3, 10))


def test_audit_of_nothing(no_docs):
    assert divergence.audit(no_docs).count() == 0


# line dedup

def deduped(rows):
    ids = lambda i: lines.LAST if i is None else i
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, lines.LAST), ids(i))
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or first[key(x)] >= ids(i)]
        yield i, len(own), len(own) - len(kept), "\n".join(kept).encode()


@pytest.mark.parametrize("held,segment", [(1 << 20, 1 << 22), (3, 5)])
def test_lines(spark, docs, no_docs, rows, monkeypatch, held, segment):
    monkeypatch.setattr(lines, "HELD", held)
    monkeypatch.setattr(lines, "SEGMENT", segment)
    got = lines.drop_repeats(docs).collect()
    same([(*r[:3], bytes(r[3])) for r in got], deduped([r[:2] for r in rows]))
    rng = random.Random(3)
    pool = ["A common line.", "  a COMMON line.\r", "short", "neuf cents éé", "éééééééééé", "Ééééééééé", "x" * 50, "", "0123456789", "\x0b0123456789\x0c", "012345678", "\x1f0123456789"]
    more = [(rng.choice([None, *range(40)]), "\n".join(rng.choice(pool + [f"line number {rng.randint(0, 400)}"]) for _ in range(rng.randint(1, 12)))) for _ in range(120)]
    more += [(50, None), (51, ""), (52, "\n"), (53, "one and the same line\n" * 3), (54, "x" * 50 + "\n" + "w " * 200_000)] + more[:5]
    df = spark.createDataFrame([(*r, 1, "h") for r in more], "doc_id long, text string, part int, key string").repartition(5)
    got = lines.drop_repeats(df).collect()
    same([(*r[:3], bytes(r[3])) for r in got], deduped(more))
    assert lines.drop_repeats(no_docs).count() == 0


def test_filters_never_miss():
    rng = np.random.default_rng(1)
    h = rng.integers(-2 ** 62, 2 ** 62, 50_000)
    h[40_000:] = h[rng.integers(0, 40_000, 10_000)]
    found = lines.twice_seen(np.array_split(h, 7))
    often = np.isin(h, [x for x, n in Counter(h.tolist()).items() if n > 1])
    assert found[often].all() and found[~often].mean() < 0.02


# conversation trie

def nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
            leaves[k[:d]] += not kids[k]
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(paths[c]) == len(k))
        yield m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha256(ends.encode()).hexdigest()


SCHEMA = "conv_id long, turn long, role string, text string, block int, n string"


@pytest.mark.parametrize("band,block", [(64, 2048), (2, 3), (1, 1)])
def test_trie(spark, monkeypatch, band, block):
    monkeypatch.setattr(trie, "BAND", band)
    monkeypatch.setattr(trie, "BLOCK", block)
    rng = random.Random(9)
    rows = []
    for c in [*range(90), 200, 201, 219, 1000, 1013, 10 ** 12 + 7]:
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # a conversation whose base is absent
        for t in range(rng.choice([1, 1, 2, 3, 4, 7])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["hello there", "hello there", "a b  c", "", None, "é\tü"])))
    rows += [(300 + c, t, "user", f"turn {t}") for c in range(6) for t in range(9 - c % 3)]  # copies and prefixes
    rows += [(500, t, "user", "again") for t in range(150)] + [(501, t, "user", "again") for t in range(140)]
    rows += [(400, None, "a", "null first"), (400, 1, "b", "x"), (400, 1, "a", "y"), (400, 1, "a", "z"), (None, 1, "a", "z"), (401, 5, "r", "w " * 100_000)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA).repartition(4)
    same(trie.prefix_trie(df).collect(), nodes(rows))


def test_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
