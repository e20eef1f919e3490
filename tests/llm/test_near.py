"""Fingerprints and near duplicates against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from motefield.llm import minhash, queries, simhash
from motefield.llm import components as graph
from motefield.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(texts):
    """Components by comparing every two documents."""
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(texts):
        if doc_id is not None and (find(i) not in least or doc_id < least[find(i)]):
            least[find(i)] = doc_id
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(texts)), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    """Chains, stars and copies of texts, from nearly equal to just apart."""
    rng = random.Random(8)
    texts, at = [], 0
    for size, length in ((40, 150), (12, 60), (25, 400), (6, 9), (5, 5), (4, 2)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for k in range(size):
            words = base if k % 3 else (texts[-1][1].split() if texts and k else base)
            texts.append((at, edited(rng, words, rng.choice([0, 0, 1, 2, 3, 4]))))
            at += 1
    rng.shuffle(texts)
    return [(i, t) for i, (_, t) in enumerate(texts)]


@pytest.mark.parametrize("block", [512, 7])
def test_components_equal_brute_force(spark, families, monkeypatch, block):
    """Groups in one block and groups cut into many give the same components."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    assert rows_of(minhash.near_duplicates(docs)) == expected(families)


def test_large_buckets_are_tied_whole(spark, families, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 5)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 10)
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    assert rows_of(minhash.near_duplicates(docs)) == expected(families)


def test_stage_links_from_four_fifths_on(spark):
    """Pairs of similarity 0.80 to 0.85, some just under 0.80: the pipeline's stage against brute force; op10 keeps them apart."""
    rng = random.Random(80)
    texts, similar = [], []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(base)
        for k in range(rng.choice([3, 4, 4, 5])):
            other[20 + 40 * k] = f"e{rng.randrange(10**6)}"
        texts += [(len(texts), " ".join(base)), (len(texts) + 1, " ".join(other))]
        a, b = (shingles(t) for _, t in texts[-2:])
        similar.append(len(a & b) / len(a | b))
    assert sum(0.8 <= s < 0.85 for s in similar) > 15 and min(similar) < 0.8
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    gone = {2 * k + 1 for k, s in enumerate(similar) if s >= 0.8}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == {i for i, _ in texts} - gone
    assert {r.doc_id for r in minhash.near_duplicates(docs, link=85).where("not kept").collect()} == {2 * k + 1 for k, s in enumerate(similar) if s >= 0.85}
    assert minhash.least_estimate(85) == 0.68 and minhash.least_estimate(80) in (0.6, 0.61)


def test_test_tables(small):
    texts = [(r.doc_id, r.text) for r in small.collect()]
    assert rows_of(minhash.near_duplicates(small)) == expected(texts)


def test_odd_rows(odd, none, odd_texts):
    got = minhash.near_duplicates(odd).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(odd_texts)
    assert [(r.component_id, r.kept) for r in by_id[3] + by_id[4]] == [(3, True), (3, False)]
    assert all(r.component_id == i and r.kept and r.n_shingles == 0 for i in (0, 1, 2) for r in by_id[i])
    assert {(r.component_id, r.n_shingles) for r in by_id[9]} == {(9, 3)} and len(by_id[9]) == 2
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_texts) - 1


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.7, 0.85, 0.95):
        n = 2000
        common = int(n * 2 * share / (1 + share))
        values = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.sort(values[:n]), np.sort(np.concatenate([values[n - common : n], values[n : 2 * n - common]]))
        one, two = (np.frombuffer(minhash.packed(minhash.minima(x)), np.uint64) for x in (a, b))
        assert abs(minhash.estimates(one, two[None, :])[0] - share) < 0.16


@pytest.mark.parametrize("part", [200_000, 40])
def test_components_of_a_graph(spark, monkeypatch, part):
    """Edges in one partition and edges in many give the same components."""
    monkeypatch.setattr(graph, "PART_EDGES", part)
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def neighbour_rows(texts):
    ordered = sorted(texts, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        out[i] = t, after, t[: len(t) - half] + after[:half]
    return out


def test_neighbours_in_ranges(small, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_BYTES", 20_000)
    got = {r.doc_id: r for r in simhash.neighbour_likeness(small).collect()}
    want = neighbour_rows([(r.doc_id, r.text) for r in small.collect()])
    assert set(got) == set(want)
    for i, (text, after, changed) in want.items():
        a, b, c = simhash.fingerprints(pa.array([text, after, changed]))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == simhash.hex_of(np.array([a, c]))
        for other, found in ((c, r.near_edited), (b, r.near_next)):
            apart = sum(bin(x ^ y).count("1") for x, y in zip(a.tolist(), other.tolist()))
            assert abs(found - max(0.0, math.cos(math.pi * apart / 128))) < 1e-6
    assert np.mean([r.near_edited - r.near_next for r in got.values()]) > 0.3


def test_ranges_of_several_slices_that_begin_with_no_text(spark):
    """The last document is followed by the first one, whose text is empty, though the range has further slices."""
    docs = [(9, None), *[(i, f"only {i} " + f"w{i} x{i} y{i} z{i} " * 60_000) for i in range(4)]]
    got = {r.doc_id: r for r in simhash.neighbour_likeness(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    for i, (text, after, changed) in neighbour_rows([(i, t or "") for i, t in docs]).items():
        a, b = simhash.fingerprints(pa.array([text, changed]))
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert [got[i].fingerprint, got[i].edited_fingerprint] == simhash.hex_of(np.array([a, b]))


def test_fingerprint_votes():
    """A bit is set where the term hashes that have it outweigh those that have not."""
    text = "a b c d e f a b c a b c"
    terms = minhash.shingle_hashes(*simhash.word_hashes(*simhash.text_bytes(pa.array([text]))), simhash.TERM_WORDS)[0]
    assert len(terms) == 10 and len(set(terms.tolist())) < 10
    found = simhash.fingerprints(pa.array([text, "", None, text]))
    assert found[0].tolist() == found[3].tolist() and found[1].tolist() == found[2].tolist() == [0, 0]
    votes = simhash.mixed(terms + np.uint64(0)).tolist()
    for bit in range(64):
        assert (int(found[0][0]) >> bit & 1) == (2 * sum(v >> bit & 1 for v in votes) > len(votes))


@pytest.mark.parametrize("radius", [0, 1, 3, 7, 16])
def test_search_within_a_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(40)]
    every = base + [b ^ sum(1 << p for p in rng.sample(range(128), rng.randint(0, 9 if radius < 16 else 20))) for b in base for _ in range(6)]
    prints = spark.createDataFrame([(f"{v:032x}",) for v in every], "fingerprint string")
    asked = spark.createDataFrame([(f"{v:032x}",) for v in base[:15]], "fingerprint string")
    got = {(r.query, r.fingerprint, r.distance) for r in simhash.within_radius(asked, prints, radius).collect()}
    want = {(f"{a:032x}", f"{b:032x}", bin(a ^ b).count("1")) for a in base[:15] for b in every if bin(a ^ b).count("1") <= radius}
    assert got == want


def test_odd_fingerprints(odd, none, odd_texts):
    got = simhash.neighbour_likeness(odd).collect()
    assert len(got) == len(odd_texts)
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"0" * 32}
    assert len({r.fingerprint for r in got if r.doc_id in (3, 4)}) == 1
    assert simhash.neighbour_likeness(none).count() == 0
    alone = simhash.neighbour_likeness(odd.where("doc_id = 9").limit(1)).first()
    assert alone.near_next == 1.0


def test_search_of_the_report_with_repeated_ids(spark, tmp_path):
    """One row for each row of the table; every asked row is told all other rows near it."""
    rows = [(100, "a b c d"), (100, "a b c d"), (100, "w x y z"), (7, "a b c d"), (200, None), (None, "a b c d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_simhash(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_near) for r in got), key=repr) == sorted([(100, 3), (100, 3), (100, 0), (7, None), (200, 0), (None, None)], key=repr)


def test_near_copies_are_found_within_the_radius(spark):
    """Of planted copies with a likeness of 0.8 or more on five-word shingles nine tenths at least; of other texts none."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, pairs = [], []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(150, 500))]
        copy = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 60))):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        a, b = shingles(" ".join(words)), shingles(" ".join(copy))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(copy)]
    hexed = simhash.hex_of(simhash.fingerprints(pa.array(texts)))
    prints = spark.createDataFrame([(h,) for h in hexed], "fingerprint string")
    found = {(r.query, r.fingerprint) for r in simhash.within_radius(prints, prints).collect()}
    assert len(pairs) > 60 and np.mean([(hexed[a], hexed[b]) in found for a, b in pairs]) >= 0.9
    number = {h: i // 2 for i, h in enumerate(hexed)}
    assert all(number[a] == number[b] for a, b in found)
