"""The stages against brute force, each on its own input."""

import random

import pytest

import corpus_pipeline
from llm_rows import same
from test_repeats import byte_repeats
from test_texts import hits
from tidewire.llm import near, queries

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark, docs, rows, tmp_path_factory):
    """What each stage makes of its predecessor's rows, and the benchmark that they read."""
    folder = str(tmp_path_factory.mktemp("bench"))
    long = [t for _, t, _ in rows if t and len(t.split()) > 20]
    items = [("1", " ".join(long[3].split()[3:18])), ("2", None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    seen, now = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder).cache()
        seen.append(now)
    return seen, items


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(stages):
    for df in stages[0][1:-1]:
        assert df.columns == COLUMNS


def test_language(stages):
    same(rows_of(stages[0][1]), [r for r in rows_of(stages[0][0]) if any(map(str.isalpha, r[1] or ""))])
    assert stages[0][1].filter("lang IS NULL").count() == 0


def test_one_of_each_group(stages):
    before, after = rows_of(stages[0][1]), rows_of(stages[0][2])
    named = [r for r in before if r[0] is not None]
    labels = jaccard_groups([t for _, t in named])
    # Two texts share the id 3: each stands for its own component.
    want = [min(i for (i, _), x in zip(named, labels) if x == c) for c in set(labels)]
    assert sorted(i for i, _ in after if i is not None) == sorted(want)
    same([r for r in after if r[0] is None], [r for r in before if r[0] is None])
    assert all(r in before for r in after)


def test_passages(stages):
    want = []
    for i, _, _, _, kept in byte_repeats(rows_of(stages[0][2]), 50):
        text = kept.decode(errors="ignore")
        if text:
            want.append((i, text))
    same([(i, t.replace("�", "")) for i, t in rows_of(stages[0][3])], [(i, t.replace("�", "")) for i, t in want])


def test_contaminated_go(stages):
    before = rows_of(stages[0][3])
    same(rows_of(stages[0][4]), [r for r, (_, _, n, _) in zip(before, hits([(*r, "") for r in before], stages[1], 10)) if not n])


def test_ids_give_the_text_back(stages):
    same(rows_of(stages[0][5]), rows_of(stages[0][4]))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_twin(spark, sf_dir, name):
    from oracle_check import connect, rows_of
    cur = connect(sf_dir).execute(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, sf_dir)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_run_and_queries(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len(queries.QUERIES) == 13 and not set(queries.ORACLES) - set(queries.QUERIES)


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard_groups(texts):
    """A number per text, equal for texts connected by pairs of Jaccard 0.8 or more."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return label


@pytest.fixture(scope="module")
def near_rows():
    """Texts with a few changed words, chains of them, copies, and others that only share a passage."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared, out = [word() for _ in range(60)], []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([30, 80, 300]))]
        for _ in range(5):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(max(1, len(base) // rng.choice([40, 60, 90]))):
                base[rng.randrange(len(base))] = word()
        out.append(" ".join(base[:20] + shared))
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i, out[k], "en", "s", len(out[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [2048, 3])
def test_near_copies_are_those_of_jaccard(spark, near_rows, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "PAIRS_HELD", block)
    df = spark.createDataFrame(near_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    label = jaccard_groups([r[1] for r in near_rows])
    want = {min(r[0] for r, x in zip(near_rows, label) if x == c) for c in set(label)}
    assert 40 < len(want) < len(near_rows) - 60
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == sorted(want)


def test_near_copies_of_odd_rows(spark, docs, no_docs, rows):
    """Nulls, empty and long texts, repeated rows: equal shingle sets are one component; texts without words are alike."""
    got = near.near_copies(docs).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i, _, _ in rows)
    empty = {r.component for r in got if r.doc_id in (100, 101, 102)}
    assert len(empty) == 1 and len({r.component for r in got if r.doc_id == 103}) == 1
    assert near.near_copies(no_docs).count() == 0


def test_near_duplicates_store_little(spark, monkeypatch):
    stored = {}

    def kept(module):
        store = module.materialize

        def keep(df, name="step"):
            stored[name] = store(df, name)
            return stored[name]

        monkeypatch.setattr(module, "materialize", keep)

    kept(near)
    kept(corpus_pipeline)
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (2, long + " more"), (3, "one of a kind and no other"), (4, "told twice with one id"), (4, "told twice with one id"), (None, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, None)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, long), rows[2], rows[3], (0, long)])
    # Shingle sets pass to the chunks unstored; the rows that stay once are not sought among the texts again.
    assert "sets" not in stored and "links" in stored
    assert stored["rejected"].count() == 2 and stored["repeated"].count() == 1


def test_workers_forget_the_pieces_before_chunks():
    import public_tokenizers
    from tidewire.llm import common, pieces
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        pieces.merger(f.read())
    assert pieces._models
    common.forget()  # as the first step of every chunk table does
    assert not pieces._models
