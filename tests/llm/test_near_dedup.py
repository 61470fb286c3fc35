"""Near-duplicates against all pairs by brute force, at given edit similarities and in crowded buckets."""

import numpy as np
import pytest

from tallymark.llm import near_dedup


def word(n):
    return "w" + "".join(chr(97 + int(d)) for d in str(n))


def classes(spark, docs):
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: r.class_id for r in rows}


def by_brute_force(docs):
    """Components of all pairs of word edit similarity 0.8 or more."""
    tokens = {i: np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint32) for i, t in docs}
    label = {i: i for i in tokens}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(tokens)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if root(a) != root(b) and near_dedup.similar(tokens[a], tokens[b]):
                a_, b_ = root(a), root(b)
                label[max(a_, b_)] = min(a_, b_)
    return {i: root(i) for i in ids}


def test_recall_by_edit_similarity(spark):
    rng = np.random.default_rng(5)
    docs, pairs = [], {}
    for similarity in (0.8, 0.85, 0.9, 0.95):
        for _ in range(60):
            i = len(docs)
            a = rng.integers(0, 10**9, 300)
            b = a.copy()
            b[rng.choice(300, round(300 * (1 - similarity)), replace=False)] = rng.integers(0, 10**9, round(300 * (1 - similarity)))
            docs += [(i, " ".join(map(word, a))), (i + 1, " ".join(map(word, b)))]
            pairs.setdefault(similarity, []).append((i, i + 1))
    got, want = classes(spark, docs), by_brute_force(docs)
    assert all(want[a] == want[b] for own in pairs.values() for a, b in own)
    for similarity, own in pairs.items():
        assert np.mean([got[a] == got[b] for a, b in own]) >= (0.85 if similarity == 0.8 else 0.9), similarity
    assert all(want[i] == want[c] for i, c in got.items())


@pytest.mark.parametrize("similarity", [0.9, 0.867, 0.83])
def test_recall_with_a_passage_that_all_share(spark, similarity):
    """720 texts of 300 words, 210 of them the same in all; in each of 360 pairs the other words are edited."""
    rng = np.random.default_rng(8)
    passage = " ".join(map(word, rng.integers(0, 10**9, 210)))
    docs = []
    for _ in range(360):
        a = rng.integers(0, 10**9, 90)
        b = a.copy()
        edits = round(300 * (1 - similarity))
        b[rng.choice(90, edits, replace=False)] = rng.integers(0, 10**9, edits)
        docs += [(len(docs) + k, passage + " " + " ".join(map(word, own))) for k, own in enumerate((a, b))]
    got = classes(spark, docs)
    assert np.mean([got[k] == got[k + 1] == k for k in range(0, 720, 2)]) >= 0.95
    assert all(got[k] in (k, k - k % 2) for k in got)


def test_rest_of_a_text():
    from tallymark.llm.words import U, Words, shingles

    a, b = np.arange(20, dtype=np.uint32), np.array([50, 3, 4, 5, 6, 7, 8, 51, 9, 10, 11, 12, 52], np.uint32)
    known = np.unique(shingles(Words(a.astype(U), np.array([0, 20])), 5).hashes)
    assert near_dedup.rest(known, b).tolist() == [50, 51, 9, 10, 11, 12, 52]
    assert near_dedup.rest(known, a[:3]).tolist() == [0, 1, 2] and near_dedup.rest(known, a).tolist() == []


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Many texts share one passage, some of them are near copies of each other, with crowds cut at two members."""
    monkeypatch.setattr(near_dedup, "CROWD", 2)
    monkeypatch.setattr(near_dedup, "TURN", 3)
    rng = np.random.default_rng(6)
    passage = " ".join(map(word, rng.integers(0, 10**9, 60)))
    docs = []
    for _ in range(40):
        own = rng.integers(0, 10**9, 50)
        docs.append((len(docs), passage + " " + " ".join(map(word, own))))
        if len(docs) % 3 == 0:
            for _ in range(3):
                other = own.copy()
                other[rng.choice(50, 5, replace=False)] = rng.integers(0, 10**9, 5)
                docs.append((len(docs), passage + " " + " ".join(map(word, other))))
    template = rng.integers(0, 10**9, 100)
    for _ in range(30):
        own = template.copy()
        own[rng.choice(100, 11, replace=False)] = rng.integers(0, 10**9, 11)
        docs.append((len(docs), " ".join(map(word, own))))
    assert classes(spark, docs) == by_brute_force(docs)


def test_repeated_ids_long_texts_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    long = [word(x) for x in rng.integers(0, 10**9, 20_000)]
    changed = [w if k % 50 else "changed" for k, w in enumerate(long)]
    docs = [(1, " ".join(long)), (2, " ".join(changed)), (3, "short text"), (4, "Short, text!"), (4, "Short, text!"), (5, None), (6, ""), (None, "short text"), (7, " ".join(long[:200])), (7, "another text of this id with some words"), (8, "another text of this id with some words")]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), (r.class_id or 0), r.kept) for r in got) == [(0, 0, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (4, 3, False), (5, 5, True), (6, 6, True), (7, 7, True), (7, 7, True), (8, 7, False)]


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (5, 4)], [(k, k + 1) for k in range(40)], [(9, k) for k in range(9)] + [(20, 30), (30, 9)]])
def test_components(spark, links):
    got = {r.id: r.to for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {i: i for e in links for i in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_no_pair_of_a_crowded_bucket_is_left_out(spark):
    """240 texts of 300 words share 210; pairs are just similar, so that the rest has few words in common: orders of whole texts and rests missed some."""
    rng = np.random.default_rng(9)
    passage = " ".join(map(word, rng.integers(0, 10**9, 210)))
    docs = []
    for _ in range(120):
        a = rng.integers(0, 10**9, 90)
        b = a.copy()
        b[rng.choice(90, 60, replace=False)] = rng.integers(0, 10**9, 60)
        docs += [(len(docs) + k, passage + " " + " ".join(map(word, own))) for k, own in enumerate((a, b))]
    got = classes(spark, docs)
    assert all(got[k] == k - k % 2 for k in got)


def test_pairs_meet_once_at_frequent_words(spark, monkeypatch):
    from tallymark.llm import near_dedup

    rng = np.random.default_rng(4)
    texts = {i: rng.permutation(60)[:30].tolist() for i in range(40)}  # in order of the word, as all texts share one order
    rows = [(k, i, i // 20 * 20 if i % 2 else i, 100, 0, p) for i, t in texts.items() for p, k in enumerate(sorted(t))]
    sizes = {k: [r for r in rows if r[0] == k] for k in range(60)}
    table = []
    for k, own in sizes.items():
        labels = [r[2] for r in own]
        main = max(sorted(set(labels)), key=labels.count) if own else None
        table += [(*r, main, sum(x != main for x in labels), len(own)) for r in own]
    df = spark.createDataFrame(table, "key long, id long, label long, n_words long, text long, place int, main long, outside long, n long")
    label = {r[1]: r[2] for r in rows}
    want = {(i, j) for i in texts for j in texts if i < j and label[i] != label[j] and set(texts[i]) & set(texts[j])}
    for listed, once in ((128, True), (3, False)):
        monkeypatch.setattr(near_dedup, "LISTED", listed)
        monkeypatch.setattr(near_dedup, "TURN", 4)
        got = [(min(r.id_i, r.id_j), max(r.id_i, r.id_j)) for r in near_dedup._meetings(df).collect()]
        assert set(got) == want
        assert (len(got) == len(want)) == once


def test_signatures_drop_no_similar_pair_and_most_others(spark):
    """Texts with occurrences of words repeated: the differing bits, whole and folded, are no more than the words that the other text lacks."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    docs = []
    for n in (5, 40, 120, 700):
        a = rng.integers(0, 10**4, n)
        a[: n // 3] = a[0]
        for edits in (0, n // 40, n // 20, n // 12, n // 2, n):
            b = a.copy()
            b[rng.choice(n, edits, replace=False)] = rng.integers(0, 10**4, edits)
            docs.append((len(docs), " ".join(map(word, np.delete(b, rng.choice(n, edits // 4, replace=False))))))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    near_dedup.small_batches(spark)
    signed = rows.mapInArrow(near_dedup._token_task, "id long, tokens binary, n_words long, signature array<long>").withColumn("folded", near_dedup._folded("signature"))
    of = lambda c: signed.select(*(F.col(x).alias(f"{x}_{c}") for x in signed.columns))
    able = [near_dedup._alike(f"{x}_a", f"{x}_b", "n_words_a", "n_words_b", bits) for x, bits in (("signature", near_dedup.SIGNATURE), ("folded", near_dedup.FOLDED))]
    got = of("a").crossJoin(of("b")).where("id_a < id_b").select("tokens_a", "tokens_b", able[0].alias("whole"), able[1].alias("folded")).collect()
    same = [near_dedup.similar(np.frombuffer(r.tokens_a, "<u4"), np.frombuffer(r.tokens_b, "<u4")) for r in got]
    assert sum(same) >= 10 and all(r.whole and r.folded for r, x in zip(got, same) if x)
    assert all(r.folded for r in got if r.whole) and sum(r.whole for r in got) <= 2 * sum(same)


def test_few_unlike_texts_of_a_crowd_are_aligned(spark, monkeypatch):
    """60 texts share 60 of 100 words, and many of the others in part: before there were signatures, each met most others."""
    rng = np.random.default_rng(12)
    passage = " ".join(map(word, rng.integers(0, 10**9, 60)))
    docs = [(k, passage + " " + " ".join(map(word, rng.choice(400, 40, replace=False)))) for k in range(60)]
    docs += [(60 + k, docs[k][1].rsplit(" ", 10)[0] + " at the end other words") for k in range(5)]
    aligned, verified = [], near_dedup.verified

    def counted(*args):
        found = verified(*args)
        aligned.append(found.count())
        return found

    monkeypatch.setattr(near_dedup, "verified", counted)
    assert classes(spark, docs) == by_brute_force(docs)
    assert sum(aligned) <= 100
