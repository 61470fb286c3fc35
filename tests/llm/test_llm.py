import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import exact_dedup, language_id, mixing, near_dedup, nearest, packing, pii, sharding, token_files, toxicity
from tallymark.llm.tokens import encoder
from tallymark.llm.words import shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "lambda", "zeta"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) + WORD[rng.integers(10)] for _ in range(n))


ODD = [(1, None, None, None, 0), (2, "", "en", "s", 0), (3, "Hello, World", "en", "s", 12), (4, "hello, world", None, None, 12), (4, "hello, world", None, None, 12), (None, "HELLO, WORLD", "de", "t", 12), (5, "x" * 50_000, "de", "t", 1), (6, "  a  \n b ", "en", "s", 3), (7, prose(1, 5000), "en", "t", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, r[2]) for r in ODD], SCHEMA + ", size string").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sf(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def test_every_operator_on_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 1), (4, None, 0), (99, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for made in (language_id.language_report, near_dedup.near_duplicates, lambda d: toxicity.toxicity_report(d, labels), pii.pii_report, exact_dedup.exact_duplicates, mixing.mix_digest, sharding.shard_digest, lambda d: token_files.round_trip_digest(spark, d)):
        assert made(odd).count() == len(ODD)
        assert made(empty).count() == 0
    assert packing.packed_digest(empty).count() == 0


def test_words_and_shingles():
    w = words(pa.array(["One, TWO one", None, "", "Été été", "a b c d e f"]))
    assert w.counts.tolist() == [3, 0, 0, 2, 6]
    assert w.hashes[0] == w.hashes[2] and w.hashes[3] == w.hashes[4]
    assert shingles(w).counts.tolist() == [1, 0, 0, 1, 2]


def test_language(spark, sf):
    rows = language_id.language_report(sf).join(sf.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out and n > 200").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_without_letters(odd):
    rows = language_id.language_report(odd).where("doc_id <= 2").collect()
    assert [r.lang_pred for r in rows] == ["und", "und"] and all(r.rejected for r in rows)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_is_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(150):
        a = rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint32)
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 4))) if rng.random() < 0.7 else rng.integers(0, 6, 30).astype(np.uint32)
        b = np.insert(b, rng.integers(0, len(b) + 1), rng.integers(0, 6)).astype(np.uint32)
        d = edit_distance(a.tolist(), b.tolist())
        for limit in (d - 1, d, d + 3):
            if limit >= 0:
                assert near_dedup.within(a, b, limit) == (d <= limit)
                assert near_dedup._banded(a.tolist(), b.tolist(), limit) == (d <= limit)


def test_near_duplicates_against_brute_force(spark):
    docs, changed = [], 0
    for k in range(12):
        base = prose(k, 120).split()
        docs.append((k * 10, " ".join(base)))
        for c in range(1, 4):
            own = list(base)
            for at in np.random.default_rng(k * 10 + c).integers(0, 120, c):
                own[at] = f"changed{k}{c}{at}"
            docs.append((k * 10 + c, " ".join(own)))
    passage = prose(999, 30)
    docs += [(1000 + k, passage + " " + prose(2000 + k, 60)) for k in range(20)]
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: r.class_id for r in rows}
    texts = {i: t.split() for i, t in docs}
    for a in texts:
        for b in texts:
            if a < b and a // 10 == b // 10 and a < 1000:
                assert got[a] == got[b]
    assert all(got[1000 + k] == 1000 + k for k in range(20))
    assert sum(r.kept for r in rows) == 12 + 20


def test_toxicity(spark):
    docs = [(k, prose(k, 40) + (" badword nasty" if k % 4 == 0 else "")) for k in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_report(d, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in rows if r.held_out]) > 0.95


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_pii_against_brute_force(spark, sf):
    rng = np.random.default_rng(3)
    odd = ["".join(rng.choice(list("a.b@-1 2+9(")) for _ in range(rng.integers(0, 60))) for _ in range(300)]
    odd += ["a@b.c_d@e.f", "é😀 x@y.zz 4111 1111 1111 1111 +1 (555) 123-4567 1.2.3.4.5.6.7.8", "9" * 30_000, "a" * 30_000 + "@", "+1" + "(" * 9000]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").unionByName(sf.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.pii_report(docs).collect():
        spans = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_exact_duplicates(spark, odd, sf):
    for docs in (odd, sf):
        groups = {}
        for r in docs.collect():
            groups.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""), []).append(r.doc_id)
        rows = exact_dedup.exact_duplicates(docs).collect()
        want = Counter((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
        assert sum(r.kept for r in rows) == len(groups)


def test_encoder_is_the_library():
    rng = np.random.default_rng(4)
    texts = ["", " ", "a", "a  b", "x.\ny z", "it's o'clock", "É ü ß. été!\nça", "日本 語", "\n \n", "<|endoftext|>", "x\x1cy \x1c z"]
    texts += ["".join(rng.choice(list(" \n\t.,'!sté1a<"), rng.integers(0, 30))) for _ in range(2000)]
    e = encoder("byte_bpe_50k.json")
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(odd):
    rows = packing.pack(odd).collect()
    e = encoder("byte_bpe_50k.json")
    want = Counter((i, e.encode([t])[0] + np.array([1], "<u4").tobytes()) for i, t, *_ in ODD)
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert sum(len(ids) for own in docs.values() for _, ids in own) == sum(len(k[1]) * n for k, n in want.items())
    for (i, n), own in docs.items():
        whole = b"".join(ids for _, ids in sorted(own))
        assert any(k[0] == i and k[1] in whole for k in want)


def test_mixing_near_targets(spark, odd):
    docs = spark.createDataFrame([(k, prose(k, 10 + k % 7), "en", f"s{k % 5}" if k % 3 else "hot", 1) for k in range(600)], SCHEMA)
    rows = mixing.mix_digest(docs).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert r.taken in (0, r.size, 2 * r.size)
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert all(abs(sum(r.taken for r in own) - t) <= 16 for (_, t), own in by.items())
    assert mixing.take(docs).count() == sum(r.taken // r.size for r in rows)
    assert set(mixing.mix(odd).columns) >= {"size", "size_", "taken"}


def test_sharding(spark):
    docs = spark.range(0, 1003, numPartitions=7).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("Slot"))
    rows = sharding.shard(docs).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot_)
    assert sorted(len(s) for s in slots.values()) == [62] * 5 + [63] * 11
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.doc_id for r in rows}) == 1003
    matrix = sharding.draw_matrix([10, 0, 7, 30], 4, 1)
    assert matrix.sum(1).tolist() == [10, 0, 7, 30] and matrix.sum(0).tolist() == [12, 12, 12, 11]


def test_nearest_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    odd = spark.createDataFrame([(10_000, None, 1), (10_020, [0.0] * 64, 1), (10_040, [float("nan")] * 64, 1)], e.schema)
    rows = nearest.nearest(e.unionByName(odd)).collect()
    data = sorted((r.vec_id, r.embedding) for r in e.collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], np.float64)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    recall = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -9
        best = ids[np.lexsort((ids, -s))[:20]]
        recall.append(len(set(best.tolist()) & got[ids[k]].keys()) / 20)
        assert all(v == pytest.approx(s[np.searchsorted(ids, i)]) for i, v in got[ids[k]].items())
    assert np.mean(recall) >= 0.9 and set(got) == {int(i) for i in ids if i % 20 == 0}


def test_token_files(spark, odd):
    rows = token_files.round_trip_digest(spark, odd).orderBy("start").collect()
    e = encoder("byte_bpe_50k.json")
    want = sorted(((i is not None, i or 0), zlib.crc32(e.encode([t])[0] + bytes(4))) for i, t, *_ in ODD)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids_crc32) for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert ids == sorted(ids)


def test_damaged_frames_are_found():
    out = io.BytesIO()
    w = token_files.FrameWriter(out)
    for k in range(3):
        w.add(k if k else None, np.arange(100 * k + 1, dtype="<u4").tobytes())
    w.close()
    reader = token_files.FrameReader(io.BytesIO(out.getvalue()))
    assert reader.doc_ids == [None, 1, 2] and len(reader.read(2)) == 804
    body = bytearray(out.getvalue())
    body[int(reader.at[1]) + 20] ^= 255
    with pytest.raises(Exception):
        token_files.FrameReader(io.BytesIO(bytes(body))).read(1)


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "")
        assert made.columns == docs.columns, name
        if name == "exact_dedup":
            assert made.count() == docs.select(F.translate("text", exact_dedup.UPPER, exact_dedup.LOWER)).distinct().count()
        docs = corpus_pipeline.settle(made, name)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").agg(F.sum("length")).first()[0] == packing.pack(docs).agg(F.sum("length")).first()[0]


def test_languages_are_learned_from_training_rows_only(spark):
    """600 languages that only held-out rows have change nothing: dictionaries are those of the rest."""
    held = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 4 == 2][:600]
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, ["the house of the river and the tree", "das haus an dem fluss und der baum"][i % 2] + f" {i}", ["en", "de"][i % 2], "s", 1) for i in free]
    plain = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    assert set(plain) == {"en", "de"} and plain == language_id.fit(spark.createDataFrame(rows + [(i, f"text {i}", f"x{k:03d}", "s", 1) for k, i in enumerate(held) for _ in range(2)], SCHEMA))
