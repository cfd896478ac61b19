"""Closed syncmers, Merkle manifest and hard negatives against brute force, and on awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pluvia.llm import bond_negatives, merkle_manifest, queries, syncmers

FOLDER = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, block int, value long, tree string, idx long, digest string, path string, place int")


def text_of(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(3)
    same = text_of(rng, 60)
    texts = [(1, same), (6, same), (6, same), (6, text_of(rng, 40)), (None, same), (None, same), (None, text_of(rng, 40)),
             (2, None), (3, ""), (4, " \n\t "), (5, text_of(rng, 60_000)), (7, "word"), (8, "Ünïcode 中文 😀 \x1c\x85 end" * 3),
             (9, "#" * 200 + " " + "x" * 500), (10, "a"), (11, "😀" * 30), (-12, "least"), (2**62, same[:23])]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), rng.choice([None, len(t or "")]),
             "k", 1, 2, "t", 3, "d", "p", 4) for i, t in texts]
    rows += [(40, "alone", "lonely", "a", 5, "k", 1, 2, "t", 3, "d", "p", 4), (41, "no lang", "", None, 7, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11 ----


def hash_of(text):
    return xxhash.xxh64(text.encode("utf-32-be"), seed=42).intdigest()


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_anchors(text, k=syncmers.K, s=syncmers.S):
    """(place, hash) of the closed syncmers by the definition."""
    out = []
    for i in range(len(text) - k + 1):
        inner = [signed(hash_of(text[j:j + s])) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, hash_of(text[i:i + k]) & 0xFFFFFFFF))
    return out or ([(0, hash_of(text) & 0xFFFFFFFF)] if text else [])


def brute_compare(rows):
    """The expected result from (doc_id, text), in descending order of ids."""
    key = lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest())
    rows = sorted(rows, key=key)
    out = []
    for at, (i, text) in enumerate(rows):
        text, after = text or "", rows[(at + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edit = text[:len(text) - half] + after[:half]
        marks = [brute_anchors(t) for t in (text, edit, after)]
        sets = [{h for _, h in m} for m in marks]
        near = [1.0 if not sets[0] and not x else 2 * len(sets[0] & x) / (len(sets[0]) + len(x)) for x in sets[1:]]
        prints = ["".join(f"{h:08x}" for _, h in m) for m in marks[:2]]
        out.append((i, len(text), hashlib.sha256(edit.encode()).hexdigest(), *prints, *near,
                    len(set(marks[0]) & set(marks[1])), len(set(marks[0]) & set(marks[2]))))
    return sorted(out, key=str)


def test_fingerprints_against_brute_force(spark, awkward, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where(F.char_length("text") < 3000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").limit(60).collect()]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (some, awkward.where("doc_id is null or doc_id <> 5")):
        plain = [tuple(r) for r in df.select("doc_id", "text").collect()]
        want = brute_compare(plain)
        for got in (syncmers.compare(df), syncmers.compare(df.repartition(3))):
            assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert syncmers.compare(none).count() == 0
    one = spark.createDataFrame([(3, "just one text")], "doc_id long, text string")
    assert [tuple(r) for r in syncmers.compare(one).collect()] == brute_compare([(3, "just one text")])


def test_whole_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    texts = [(1, text_of(rng, 2500, "abcä中😀")), (2, "ab" * 3000), (3, text_of(rng, 2500))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    whole = {i: [(a >> 32, a & syncmers.LOW) for a in v] for i, v in df.select(
        "doc_id", syncmers.anchors(F.col("text"))).collect()}
    assert whole == {i: brute_anchors(t) for i, t in texts}
    monkeypatch.setattr(syncmers, "PIECE", 100)
    pieces = {i: [(a >> 32, a & syncmers.LOW) for a in v] for i, v in df.select(
        "doc_id", syncmers.anchors(F.col("text"))).collect()}
    assert pieces == whole


def test_anchors_are_context_free_and_everywhere(spark):
    rng = random.Random(2)
    passage = text_of(rng, 100)
    around = [text_of(rng, 30) for _ in range(4)]
    texts = [(1, around[0] + passage + around[1]), (2, around[2] + passage + around[3])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    marks = {r["doc_id"]: r for r in syncmers.fingerprints(df).collect()}
    inside = []
    for i, t in texts:
        at = t.index(passage)
        hashes = [marks[i]["fingerprint"][j:j + 8] for j in range(0, len(marks[i]["fingerprint"]), 8)]
        inside.append([(p - at, h) for p, h in zip(marks[i]["places"], hashes, strict=True)
                       if at <= p <= at + len(passage) - syncmers.K])
        assert max(np.diff([-1, *marks[i]["places"]])) <= syncmers.K - syncmers.S
    assert inside[0] == inside[1] and len(inside[0]) > 20


def test_rows_of_one_id_spread(spark):
    rows = [(7, f"text number {i} of the one id that all rows have") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = syncmers.with_successor(df, syncmers.anchors, blocks=16)
    pairs = dict(got.select("text", "next_text").collect())
    assert len(pairs) == 300 and len(set(pairs.values())) == 300
    at, seen = rows[0][1], set()
    while at not in seen:  # one ring through all rows
        seen.add(at)
        at = pairs[at]
    assert len(seen) == 300


# ---- 12 ----


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity=2):
    """The expected result from (doc_id, source, lang, n_chars, text)."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r: H(*map(told, r))

    def tree(leaves):
        paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
        while len(level) > 1:
            for i, own in enumerate(at):
                run = own // arity * arity
                paths[i].append((own - run, [x for j, x in enumerate(level[run:run + arity]) if run + j != own]))
            level = [H(*level[i:i + arity]) for i in range(0, len(level), arity)]
            at = [x // arity for x in at]
        return level[0], paths

    def fold(digest, path):
        for slot, others in path:
            digest = H(*others[:slot], digest, *others[slot:])
        return digest

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = []
    for name in order:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built.append((own, *tree([leaf_of(r) for r in own])))
    root, above = tree([b[1] for b in built])
    out = []
    for (own, subroot, paths), up in zip(built, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            start = leaf_of((*r[:3], r[3] + 1, r[4])) if bad else leaf_of(r)
            found = fold(start, path + up)
            proof = H(*(x for _, others in path + up for x in others))
            assert fold(leaf_of(r), path + up) == root
            out.append((r[0], leaf_of(r), subroot, root, proof, found, found == root))
            assert (found == root) != bad
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_against_brute_force(spark, awkward, none, arity):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 70 and lang is not null")
    lone = docs.where("doc_id = 7")
    for df in (docs, awkward, lone):
        plain = [tuple(r) for r in df.select(*merkle_manifest.FIELDS).collect()]
        got = merkle_manifest.verified(merkle_manifest.build(df, arity=arity))
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(plain, arity)
    if arity == 2:
        assert merkle_manifest.verified(merkle_manifest.build(none)).count() == 0
        with pytest.raises(ValueError):
            merkle_manifest.build(docs, arity=1)


# ---- 13 ----


def brute_negatives(rows, scale=256):
    """The expected rows from (vec_id, embedding, label), with Python integers."""
    use = []
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            if all(math.isfinite(x * scale) for x in v):
                use.append((i, lab, [math.floor(x * scale) for x in v]))
    score = lambda a, b: max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    anchors = {}
    for i, lab, v in use:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        scored = sorted(((-score(v, w), i, m == lab) for i, m, w in use if i != a))
        for s, p, _ in [x for x in scored if x[2]][:5]:
            s = -s
            inside = [x for x in scored if not x[2] and 50 * s <= 100 * -x[0] <= 95 * s][:3]
            out += [(a, p, r + 1, n, s, -t) for r, (t, n, _) in enumerate(inside)]
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in bond_negatives.mine(df, F.col("vec_id") % 50 == 0, **how).collect())


def test_negatives_on_awkward_vectors(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [round(rng.gauss(0.1, 0.3), 2) for _ in range(rng.choice([3, 5, 8]))], rng.randrange(3)) for i in range(250)]
    rows += [(50, [0.5, 0.5, 0.5], 1), (3, [0.5] * 8, 2), (3, [0.5] * 8, 2), (3, [0.5] * 8, 0)]  # repeated ids
    rows += [(300, [], 0), (301, None, 0), (302, [None, 1.0], 0), (303, [math.nan], 1), (350, [math.inf], 1),
             (304, [1.0, 2.0], None), (None, [1.0], 1), (400, [0.0] * 8, 1), (305, [1e308], 1), (450, [0.2] * 8, 99)]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("parts", "score", "place", "part", "rank")})
    want = brute_negatives(rows)
    assert mined(df) == want and len(want) > 50
    monkeypatch.setattr(bond_negatives, "TILE", 7)
    assert mined(df, block=2) == want
    none = spark.createDataFrame([], schema)
    assert mined(none) == []


def test_negatives_with_large_numbers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e4, 3e7, 1e12, 1e17]) * rng.gauss(0.3, 1) for _ in range(6)], rng.randrange(2)) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df) == brute_negatives(rows)


def test_bitmaps_shrink():
    """Far fewer cells are read than all, once there are bars, and nothing is lost."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(4000, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    ids = np.arange(4000)
    tile = bond_negatives.Tile(4000, 64, ids.astype("<i8").tobytes(), np.zeros(4000, "<i8").tobytes(),
                               np.ascontiguousarray(vectors.T).tobytes())
    total = 0
    for i in range(40):
        scores = (vectors @ vectors[i]).astype(np.int64)
        low, high = np.sort(scores)[-40], np.sort(scores)[-3]
        got, found, read = bond_negatives.scan(bond_negatives.Anchor(i, 0, vectors[i]), tile, tile.every, low, high)
        want = np.flatnonzero((scores >= low) & (scores <= high))
        assert np.array_equal(got, want) and np.array_equal(found, scores[want])
        total += read
    assert total < 0.6 * 40 * vectors.size


def test_query_mines_the_given_table(spark):
    got = queries.op13(spark, FOLDER).toPandas()
    assert len(got) and (got["negative_score"] * 100 <= 95 * got["positive_score"]).all()
    assert (got.groupby(["anchor_id", "positive_id"]).size() <= 3).all()
