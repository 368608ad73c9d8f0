"""Operators that look at each text by itself, or at counts over all of them."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from llm_rows import same

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidewire.llm import contamination, langid, lm, logbloom, pieces, quality, tokens  # noqa: E402


def raw(text):
    return (text or "").encode()


# token counts

def greedy(vocabulary, word):
    n = i = 0
    while i < len(word):
        for j in range(len(word), i, -1):
            if (word[i:j], False) in vocabulary or j == len(word) and (word[i:j], True) in vocabulary:
                break
        else:
            return 0
        n, i = n + 1, j
    return n


def test_longest_match_equals_greedy():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        some = [(bytes(rng.choice([97, 98, 99], rng.integers(1, 5)).astype(np.uint8)), bool(rng.random() < 0.4)) for _ in range(rng.integers(1, 8))]
        word = bytes(rng.choice([97, 98, 99], rng.integers(1, 10)).astype(np.uint8))
        assert tokens.LongestMatch(some).count(word) == greedy(set(some), word)


def test_token_counts(docs, no_docs, rows):
    vocabulary = [(b"a", False), (b"ab", False), (b"b", True), (b"c", False), (b"d", False), ("é".encode(), False), (b"cd", True)]
    want = []
    for i, text, _ in rows:
        counts = [greedy(set(vocabulary), w) for w in raw(text).lower().split()]
        want.append((i, len(counts), sum(counts) + counts.count(0), counts.count(0)))
    same(tokens.count_tokens(docs, vocabulary).collect(), want)
    assert tokens.count_tokens(no_docs, vocabulary).count() == 0


def test_vocabulary_file_covers_all_bytes():
    automaton = tokens.LongestMatch(tokens.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    assert all(automaton.count(bytes([b])) == 1 for b in range(256))
    assert automaton.count(b"the") == 1


# SentencePiece

def test_pieces_equal_the_library(docs, no_docs, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, text, _ in rows:
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, np.array(ids, "<u4").tobytes(), lib.decode(ids)))
    got = pieces.encode_documents(docs, path)
    same([(r[0], bytes(r[1]), r[2]) for r in got.collect()], want)
    assert pieces.encode_documents(no_docs, path).count() == 0
    one = got.filter("doc_id = 101").select(pieces.unpack_ids("ids").alias("ids")).first()
    assert one.ids == [1, 2]


def test_any_ids_decode_as_in_the_library():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        merger = pieces.Merger(f.read())
    rng = np.random.default_rng(4)
    for _ in range(2000):
        ids = rng.choice([0, 1, 2, 5, 131, 198, 200, 227, 259, 300, 400], rng.integers(0, 8)).tolist()
        assert merger.decode(np.array(ids, "<u4").tobytes()) == merger.lib.decode(ids), ids
    assert merger.encode_and_decode(["x" * 5000])[0][0] == np.array(merger.lib.encode("x" * 5000, add_bos=True, add_eos=True), "<u4").tobytes()


# decontamination

def terms(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(rows, items, width):
    windows = defaultdict(set)
    for name, text in items:
        w = terms(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k:k + width])].add(name)
    lengths = {len(w) for w in windows}
    for i, text, _ in rows:
        w, hit, found = terms(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= names - {None}
        yield i, len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items(spark, rows):
    some = [("7", " ".join((rows[k][1] or "").split()[2:25])) for k in (5, 9, 14)] + [
        ("a", (rows[11][1] or "") + " tail"), ("a", "ab"), (None, rows[20][1]), ("e", ""), ("n", None), ("zz", "12")]
    return some, spark.createDataFrame([(a, b, 1) for a, b in some], "item_id string, text string, doc_id int")


def test_phrases(docs, no_docs, rows, items, monkeypatch):
    want = [(i, n, h, f) for i, n, h, f in hits(rows, items[0], 10)]
    index = contamination.build_index(docs)
    for limit in (contamination.ITEM_BYTES, 50):  # the second takes several passes
        monkeypatch.setattr(contamination, "ITEM_BYTES", limit)
        got = contamination.phrase_matches(index, items[1]).collect()
        same([(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got], want)
        assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in got)
    none = contamination.phrase_matches(index, items[1].limit(0))
    assert none.filter("n_hit > 0").count() == 0 and none.count() == len(rows)
    assert contamination.phrase_matches(contamination.build_index(no_docs), items[1]).count() == 0


def test_proximity(spark, docs, rows):
    asked = [("p", "aa b"), ("q", "c d é"), ("r", "nowhere a")]
    got = contamination.proximity_matches(contamination.build_index(docs), spark.createDataFrame(asked, "item_id string, text string"), 4)
    want = []
    for i, text, _ in rows:
        w = terms(text)
        want.append((i, sorted(n for n, t in asked if any(set(terms(t)) <= set(w[k:k + 4]) for k in range(len(w))))))
    same([(r.doc_id, sorted(r["items"])) for r in got.collect()], want)


# language-model scores

def test_filter_never_counts_low():
    rng = np.random.default_rng(0)
    keys, counts = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.integers(1, 50, 20_000)
    keys, first = np.unique(keys, return_index=True)
    counts = counts[first]
    parts = [(s, logbloom.build(keys[a:b], counts[a:b])) for s, a, b in logbloom.slices(keys, 7)]
    found = logbloom.Filter(7, parts)
    asked = found.ask(keys)
    assert (asked >= logbloom.quantised(counts)).all() and (asked == logbloom.quantised(counts)).mean() > 0.98
    other = found.ask(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert (other > 0).mean() < 0.02
    assert (logbloom.Filter(7, []).ask(keys) == 0).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(docs, rows, order):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    token = {k: raw(t).lower().split() + [b""] for k, (_, t, _) in enumerate(rows)}
    training = [token[k] for k, r in enumerate(rows) if not held(r[0])]
    counts = Counter(w for t in training for w in t)
    total, distinct = sum(counts.values()), len(counts)
    got = lm.score_documents(docs, langid.remainder("doc_id", 5) == 1, order=order)
    want = [(i, held(i), len(token[k]), sum(counts[w] > 0 for w in token[k]), total,
             round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in token[k]), 5)) for k, (i, _, _) in enumerate(rows)]
    out = got.collect()
    same([(*r[:5], round(r[5], 5)) for r in out], want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    far = lm.score_documents(docs, langid.remainder("doc_id", 5) == 1, order=order, broadcast_bytes=-1).collect()
    same([(r[0], round(r[6], 6)) for r in far], [(r[0], round(r[6], 6)) for r in out])
    if order > 1:
        known = [r for r in out if not r.held_out]
        assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_words_are_numbered_as_split():
    texts = [b"", b"  ", b"A a\x0bB\x0c\x1cc\x00 \xc2\xa0d\x85", b"b", "\tÄ ä\r\n".encode(), b"", b"a"]
    words, number, size = lm._numbered(texts)
    want = [t.lower().split() + [b""] for t in texts]
    assert [words[i] for i in number] == [w for t in want for w in t] and size.tolist() == [len(t) for t in want]
    assert words[0] == b"" and len(set(words)) == len(words)


def test_filter_is_put_together_once(docs, monkeypatch):
    made, put_together = [], logbloom.Filter.__init__
    monkeypatch.setattr(logbloom.Filter, "__init__", lambda self, *args: made.append(1) or put_together(self, *args))
    assert lm.score_documents(docs, F.lit(False)).count() == docs.count()
    assert made == [1]  # by the driver: workers get it whole


def test_tail_words(docs, monkeypatch):
    from tidewire.llm import sums
    whole = lm.score_documents(docs, F.lit(False)).collect()
    monkeypatch.setattr(sums, "HEAD", 3)
    same([(r[0], r[3], round(r[5], 6)) for r in lm.score_documents(docs, F.lit(False)).collect()], [(r[0], r[3], round(r[5], 6)) for r in whole])


def test_nothing_to_learn(docs, no_docs, rows):
    out = lm.score_documents(docs, F.lit(True)).collect()
    assert len(out) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in out)
    assert lm.score_documents(no_docs, F.lit(False)).count() == 0


# quality

def kneser_ney(texts, order):
    grams = lambda t: [(b"\0" * (order - 1) + t + b"\3")[i:i + order] for i in range(len(t) + 1)]
    tables = {order: Counter(g for t in texts for g in grams(t))}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    off, context = {}, {}
    for n, table in tables.items():
        c = Counter(table.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0
        off[n] = [min(max(i - (i + 1) * y * c[i + 1] / c[i], 0.1), i - 0.1) if c[i] and c[i + 1] else 0.5 * i for i in (1, 2, 3)]
        context[n] = defaultdict(lambda: [0, 0.0])
        for g, v in table.items():
            context[n][g[:-1]][0] += v
            context[n][g[:-1]][1] += off[n][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        n, lower = len(g), p(g[1:])
        if g[:-1] not in context[n]:
            return lower
        total, mass = context[n][g[:-1]]
        v = tables[n].get(g, 0)
        return ((v - off[n][min(v, 3) - 1] if v else 0) + mass * lower) / total

    return lambda t: 10 ** (-sum(math.log10(p(g)) for g in grams(t)) / (len(t) + 1))


def test_quality(spark, docs, no_docs, rows):
    trusted = [i for i in range(0, 40, 2)]
    ids = spark.createDataFrame([(i,) for i in [*trusted, 4, None]], "doc_id long")
    model = kneser_ney([raw(t) for i, t, _ in rows if i in trusted], 4)
    got = quality.classify(docs, ids, 0.9, 4)
    out = got.collect()
    assert len(out) == len(rows)
    same([(r.doc_id, r.lang, round(r.perplexity, 6)) for r in out if r.n_bytes < 2000],
         [(i, lang, round(model(raw(t)), 6)) for i, t, lang in rows if len(raw(t)) < 2000])
    for lang in ("xx", "yy", None):
        own = [r for r in out if r.lang == lang]
        good = [r for r in own if r.doc_id in trusted]
        assert len({r.threshold for r in own}) == 1 and 0.9 <= np.mean([r.keep for r in good])
        assert all(r.keep == (math.log10(r.perplexity) <= math.log10(r.threshold) + 1e-9) for r in own)
    far = quality.classify(docs, ids, 0.9, 4, broadcast_bytes=0)
    same([(r[0], r[1], r[2], round(r[3], 9), r[5]) for r in far.collect()], [(r[0], r[1], r[2], round(r[3], 9), r[5]) for r in out])
    assert quality.classify(no_docs, ids).count() == 0
    untrusted = quality.classify(docs, ids.limit(0)).collect()
    assert all(r.keep and r.threshold is None for r in untrusted) and len(untrusted) == len(rows)


def test_clean_texts_outside_the_trusted_are_kept(spark):
    rng = np.random.default_rng(8)
    out = []
    for lang, letters, n in (("xx", "aeioulmnrst", 14), ("yy", "abdefgkopvz", 60)):
        vocabulary = ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(1500)]
        for k in range(n + 50):
            out.append((len(out), " ".join(rng.choice(vocabulary, 60)), lang, "trusted" if k < n else "clean"))
        for _ in range(20):
            out.append((len(out), "".join(rng.choice(list("QWXYZ#@%&0123456789"), 300)), lang, "junk"))
    df = spark.createDataFrame([r[:3] for r in out], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(r[0],) for r in out if r[3] == "trusted"], "doc_id long")
    keep = {r.doc_id: r.keep for r in quality.classify(df, ids).collect()}
    for lang in ("xx", "yy"):
        assert np.mean([keep[i] for i, _, of, kind in out if (of, kind) == (lang, "clean")]) >= 0.9
        assert not any(keep[i] for i, _, of, kind in out if (of, kind) == (lang, "junk"))


# language

def test_gradients_are_right():
    net = langid.Network.new(["a", "b", "c"], 1)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    symbols, label = rng.integers(0, langid.SYMBOLS, (7, 5)), rng.integers(0, 3, 5)
    _, gradient = net.gradients(symbols, label)
    for name, weight in net.weights.items():
        at = np.unravel_index(np.abs(gradient[name]).argmax(), weight.shape)
        weight[at] += 1e-4
        up = net.gradients(symbols, label)[0]
        weight[at] -= 2e-4
        down = net.gradients(symbols, label)[0]
        weight[at] += 1e-4
        assert gradient[name][at] == pytest.approx((up - down) / 2e-4, rel=1e-2, abs=1e-6)


def test_pooling_covers_every_byte_once():
    net = langid.Network.new(["a", "b"], 3)
    texts = [bytes(range(1, n + 1)) * k for n, k in ((5, 1), (96, 1), (97, 1), (60, 9), (1, 1))] + [b""]
    pooled = net.pooled(texts)
    assert pooled[:-1].sum(axis=1) == pytest.approx(1, abs=1e-5) and pooled[-1].sum() == 0
    assert net.pooled(texts[3:4])[0] == pytest.approx(pooled[3], abs=1e-5)


def test_language_edges(docs, no_docs, rows):
    net = langid.fit(docs, per_language=20, steps=5)
    assert net.languages == ["xx", "yy"]
    out = langid.identify(docs, net).collect()
    assert len(out) == len(rows)
    letters = {i: any(map(str.isalpha, t or "")) for i, t, _ in rows if i not in (None, 3)}
    assert all((r.lang_pred == "und") != letters[r.doc_id] for r in out if r.doc_id in letters)
    assert all(0 <= r.score <= 1 for r in out)
    nothing = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(no_docs, net).count() == 0


def test_language_held_out(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = langid.remainder("doc_id", 4) == 2
    found = langid.identify(documents.filter(held_out), langid.fit(documents.filter(~held_out)))
    right = found.join(documents, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_far_texts_send_their_grams_once(docs, monkeypatch):
    """Without a broadcast filter neither it nor what scoring needs is stored: n-grams travel once, answers come back."""
    from tidewire.llm import exchange
    stored, store, answered, sent = [], lm.materialize, exchange.answered, []
    monkeypatch.setattr(lm, "materialize", lambda df, name="step": stored.append(name) or store(df, name))
    monkeypatch.setattr(exchange, "answered", lambda asked, fn, name: sent.append(name) or answered(asked, fn, name))
    monkeypatch.setattr(lm, "SEGMENT_KEYS", 1000)
    got = lm.score_documents(docs, langid.remainder("doc_id", 5) == 1, broadcast_bytes=-1)
    assert got.count() == docs.count() and stored == ["words", "scores"] and sent == ["codes"]
