"""Training-data operators against brute force, and on awkward rows."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as public
import pytest
import tiktoken
import tokenizers
from compare import difference, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from pluvia.llm import (
    chunks, collinear_dedup, components, extendible_sharding, id_store, minhash_dedup, oracle, order_sampling, prefix_bpe, queries,
    robust_quality, segment_topk, toxicity, url_reputation, words,
)

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score double, value long, part int, node long, kept string, rule string, seed long")


def text_of(rng, n, size=400):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return docs.toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(3)
    same, long = text_of(rng, 60), text_of(rng, 30_000)
    texts = [(1, same), (6, same), (6, same), (None, same), (None, text_of(rng, 40)), (2, None), (3, ""), (4, " \n\t "),
             (5, long), (7, "word"), (8, "Ünïcode 中文 😀 \x1c\x85 end"), (9, "#" * 200 + " " + "x" * 5000), (10, same.upper())]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), None if t is None else len(t),
             0.5, 7, 1, 2, "no", "net/", 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, by="doc_id"):
    return df.toPandas().sort_values([by], na_position="first").reset_index(drop=True)


# ---- words ----


def test_word_hashes_agree_with_words(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", "  ", "a", text_of(rng, 5000), "x" * 300, "a b a b", "ü ü\x0b\x0cü"]
    want = [WORD.findall(t or "") for t in texts]
    monkeypatch.setattr(words, "SEGMENT", 64)
    small = list(words.word_hashes(None if t is None else t.encode() for t in texts))
    monkeypatch.setattr(words, "SEGMENT", 1 << 20)
    large = list(words.word_hashes(None if t is None else t.encode() for t in texts))
    number: dict = {}
    for a, b, w in zip(small, large, want, strict=True):
        assert len(a) == len(w) and np.array_equal(a, b)
        for h, x in zip(a.tolist(), w, strict=True):
            assert number.setdefault(x, h) == h
    assert len(set(number.values())) == len(number)


# ---- 1 ----


def brute_passages(texts, n):
    """Pairs (later, earlier) of documents that share a run of n words."""
    seen, out = {}, set()
    for i, t in sorted(texts.items()):
        w = WORD.findall(t.translate(LOWER))
        for j in range(len(w) - n + 1):
            key = tuple(w[j:j + n])
            first = seen.setdefault(key, i)
            if first != i:
                out.add((i, first))
    return out


def test_repeated_passages_finds_planted_ones(spark):
    rng = random.Random(5)
    passage = [text_of(rng, 60).split() for _ in range(3)]
    texts = {}
    for i in range(40):
        body = text_of(rng, 150).split()
        own = list(passage[i % 3])
        if i % 2:
            own[20] = own[45] = "changed"  # fuzzy copies
        at = rng.randrange(len(body))
        texts[i] = " ".join(body[:at] + own + body[at:]) if i < 30 else " ".join(body)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = collinear_dedup.repeated_passages(df).toPandas()
    assert set(got["doc_id"]) == set(range(3, 30))  # 0, 1 and 2 are first, 30 to 39 clean
    assert set(got["src_doc_id"]) <= set(range(30))
    for _, r in got.iterrows():
        assert 55 <= r["n_words"] <= 66 and r["identity"] > 0.9
    assert {d for d, _ in brute_passages(texts, 50)} <= set(got["doc_id"])
    cut = rows_of(collinear_dedup.without_passages(df, collinear_dedup.repeated_passages(df)))
    left = dict(zip(cut["doc_id"], cut["text"], strict=True))
    assert all(left[i] == texts[i] for i in [0, 1, 2, *range(30, 40)])
    assert all(len(left[i].split()) <= 156 for i in range(3, 30))


def test_repeated_words_are_passages_too(spark):
    rows = [(1, "The " * 80 + "end one."), (2, text_of(random.Random(1), 30) + " The" * 70), (3, "the " * 40), (4, "a b c " * 30), (5, "a b c " * 25)]
    got = collinear_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(zip(got["doc_id"], got["src_doc_id"], strict=True)) == {(2, 1), (5, 4)}
    assert got.groupby("doc_id")["n_words"].max().to_dict() == {2: 70, 5: 75}


def test_passages_whose_parts_come_first_elsewhere(spark):
    rng = random.Random(11)
    p = text_of(rng, 85).split()
    lines = [text_of(rng, 15) for _ in range(4)]
    texts = {1: p[:45], 2: p[40:], 5: p, 7: p[:45], 8: p[40:], 9: p}
    rows = [(i, " ".join([text_of(rng, 40), *x, text_of(rng, 40)])) for i, x in texts.items()]
    rows += [(20 + i, f"{text_of(rng, 40)} {x} {text_of(rng, 40)}") for i, x in enumerate(lines * 3)]
    rows += [(i, " ".join([text_of(rng, 40), *lines, text_of(rng, 40)])) for i in (50, 60, 70)]
    got = collinear_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    pairs = set(zip(got["doc_id"], got["src_doc_id"], strict=True))
    assert {(9, 5), (60, 50)} <= pairs <= {(9, 5), (60, 50), (70, 50), (70, 60)} and set(got["doc_id"]) == {9, 60, 70}
    assert got.groupby("doc_id")["n_words"].max().to_dict() == {9: 85, 60: 60, 70: 60}


def steps_of(monkeypatch, module):
    """The tables that ``module`` writes from here on, in order: (name, table)."""
    steps, write = [], module.materialise

    def noted(df, name):
        steps.append((name, write(df, name)))
        return steps[-1][1]

    monkeypatch.setattr(module, "materialise", noted)
    return steps


def test_rounds_read_the_open_seeds_only(spark, monkeypatch):
    rng = random.Random(17)
    lines = [text_of(rng, 15) for _ in range(4)]
    rows = [(20 + i, f"{text_of(rng, 40)} {x} {text_of(rng, 40)}") for i, x in enumerate(lines * 3)]
    rows += [(i, " ".join([text_of(rng, 40), *lines, text_of(rng, 40)])) for i in (50, 60)]
    rows += [(i, text_of(random.Random(5), 90)) for i in (1, 2)]  # a passage found at once leaves no open seed
    steps = steps_of(monkeypatch, collinear_dedup)
    got = collinear_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {(60, 50), (2, 1)} == set(zip(got["doc_id"], got["src_doc_id"], strict=True))
    written = dict(reversed(steps))
    assert 0 < written["open-seed-hits"].count() < written["seed-hits"].count()
    assert not {1, 2} & {r["doc_id"] for r in written["open-seed-hits"].collect()}
    for name, table in steps:
        if name == "wanted-spans":  # a text is joined once, not once for each of its spans
            assert table.groupBy("doc_id").count().where("count > 1").count() == 0


def test_seeds_cross_once_and_packed(spark, monkeypatch):
    rng = random.Random(23)
    line = text_of(rng, 9)
    rows = [(i % 17, " ".join([text_of(rng, rng.randrange(30)), *[line] * rng.randrange(4), text_of(rng, 5)])) for i in range(40)]
    rows += [(None, line), (3, None), (4, ""), (-(1 << 62), line), (1 << 62, line), (5, "a b c d a b c d a b c d"), (6, "x a b c d a b c d")]
    want, first = [], collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            h, p = collinear_dedup.minimizers(next(iter(words.word_hashes([(t or "").lower().encode()]))), 4, 1)
            want += [(s, i, q, n) for s, q, n in zip(h.astype(np.int64).tolist(), p.tolist(), collinear_dedup.running_numbers(h).tolist(), strict=True)]
    docs_of = collections.defaultdict(set)
    for s, i, _, _ in want:
        docs_of[s].add(i)
    for s, i, q, n in sorted(want):
        if i == min(docs_of[s]):
            first[s, n].append(q)
    most = {s: max(n for x, n in first if x == s) for s, _ in first}
    want = sorted((s, min(docs_of[s]), i, q, n, min(first[s, min(n, most[s])])) for s, i, q, n in want if len(docs_of[s]) > 1)
    plans, write = [], collinear_dedup.materialise
    monkeypatch.setattr(collinear_dedup, "materialise", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (collinear_dedup.PART_BYTES, 100):
        monkeypatch.setattr(collinear_dedup, "PART_BYTES", size)
        got = collinear_dedup.seed_hits(df, 4, 1).select("seed", "src", "doc_id", "place", "turn", "src_place")
        assert sorted(tuple(r) for r in got.collect()) == want
        plan = plans.pop()
        assert not plans and "Join" not in plan and plan.count("Exchange") == 2  # repartition(3) and one of packed rows


def test_words_of_spans_are_deleted_once_aligned(spark, monkeypatch):
    rows = [(i, text_of(random.Random(5), 90)) for i in (1, 2)]
    paths, noted = {}, collinear_dedup.materialise
    monkeypatch.setattr(collinear_dedup, "materialise", lambda df, name: paths.setdefault(name, noted(df, name)))
    passages = collinear_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert passages.count() == 1
    for name in ("chains", "spans"):
        with pytest.raises(Exception, match="(?i)exist|not found"):
            paths[name].collect()


def has_passage(equal, n=50, share=0.8):
    """Whether n words and more from an equal word to an equal word are equal enough, by trying all."""
    upto = np.concatenate([[0], np.cumsum(equal)])
    return any(equal[i] and equal[j - 1] and upto[j] - upto[i] >= share * (j - i)
               for i in range(len(equal)) for j in range(i + n, len(equal) + 1))


@pytest.mark.parametrize("share", [0.8, 0.85, 0.9])
def test_recall_of_changed_passages(spark, share):
    rng = random.Random(int(share * 100))
    rows, want, n_docs = [], set(), 120
    for i in range(n_docs):
        p = text_of(rng, rng.randrange(50, 71)).split()
        n = len(p)
        changed = range(5, n, 6) if i < 10 else rng.sample(range(n), int(n * (1 - share) + 1e-9))
        q = [f"new{i}x{j}" if j in changed else w for j, w in enumerate(p)]
        rows += [(d, " ".join([text_of(rng, 40), *x, text_of(rng, 40)])) for d, x in ((i, p), (1000 + i, q))]
        if has_passage([x == y for x, y in zip(p, q, strict=True)]):
            want.add(1000 + i)
    got = collinear_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    found = set(got["doc_id"])
    print(f"recall at {share}: {len(want & found)} of {len(want)}; every sixth word: "
          f"{len([d for d in want & found if d < 1010])} of {len([d for d in want if d < 1010])}")
    assert len(want) > n_docs / 4 and len(want & found) >= 0.95 * len(want)
    assert {d for d in want if d < 1010} <= found


def test_rows_of_matches_chain_like_single_ones():
    rng = np.random.default_rng(4)
    for _ in range(40):
        keep = np.flatnonzero(rng.random(200) < 0.8)
        shift = np.cumsum(rng.random(len(keep)) < 0.05) * 3
        got = collinear_dedup.passages_of(np.full(len(keep), 7), keep, keep + shift, 4, 24, 2)
        a, b = keep.tolist(), (keep + shift).tolist()
        best = collinear_dedup.chain(a, b)[0]
        assert (got[0]["start"], got[0]["stop"], got[0]["seeds"]) == (a[best[0]], a[best[-1]] + 4, len(best))
        assert (got[0]["src_start"], got[0]["src_stop"]) == (b[best[0]], b[best[-1]] + 4)


def test_other_blanks_are_no_word_ends(spark):
    rng = random.Random(12)
    p = text_of(rng, 60).split()
    for i, blank in zip(range(3, 60, 5), "\u00a0\u3000\x85\u2028\x1c\x1f" * 2):
        p[i] = f"{p[i]}{blank}!"
    rest = text_of(rng, 40)
    rows = [(1, " ".join([text_of(rng, 20), *p, text_of(rng, 20)])), (2, " ".join([text_of(rng, 20), *p, rest])),
            (3, " ".join([text_of(rng, 20), *p[:45], text_of(rng, 40)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    passages = collinear_dedup.repeated_passages(df)
    got = passages.toPandas()
    assert got[["doc_id", "src_doc_id", "start_word", "stop_word", "n_words"]].values.tolist() == [[2, 1, 20, 80, 60]]
    left = rows_of(collinear_dedup.without_passages(df, passages)).set_index("doc_id")["text"]
    assert left[2].endswith(rest) and len(WORD.findall(left[2])) == 60 and left[3] == rows[2][1]


def test_key_places_hit_every_stretch():
    rng = np.random.default_rng(3)
    for _ in range(50):
        places = np.flatnonzero(rng.random(300) < 0.5)
        ranks = rng.integers(2, 9, len(places))
        keys = collinear_dedup.key_places(places, ranks, 4, 24, 40)
        assert not collinear_dedup.open_places(places[~keys], [], 4, 24, 40).any() and keys.any()


def test_chain_equals_quadratic_search():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 25)
        pts = sorted((rng.randrange(60), rng.randrange(60)) for _ in range(n))
        a, b = [p for p, _ in pts], [q for _, q in pts]
        score = []
        for i in range(n):
            score.append(1 + max([0.0] + [score[j] - 0.02 * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if a[j] < a[i] and b[j] < b[i]]))
        chains = collinear_dedup.chain(a, b)
        assert sorted(x for c in chains for x in c) == list(range(n))
        best = chains[0]
        own = len(best) - 0.02 * (a[best[-1]] - a[best[0]] + b[best[-1]] - b[best[0]])
        assert own == pytest.approx(max(score))
        for c in chains:
            assert all(a[x] < a[y] and b[x] < b[y] for x, y in itertools.pairwise(c))


def test_repeated_passages_on_awkward_rows(awkward, none):
    got = collinear_dedup.repeated_passages(awkward).toPandas()
    assert set(zip(got["doc_id"], got["src_doc_id"], strict=True)) == {(6, 1), (10, 1)}
    assert collinear_dedup.repeated_passages(none).count() == 0
    cut = collinear_dedup.without_passages(awkward, collinear_dedup.repeated_passages(awkward))
    assert cut.columns == awkward.columns
    assert sorted(cut.toPandas()["doc_id"].dropna()) == [1, 2, 3, 4, 5, 7, 8, 9]


# ---- 2, 4, 6, 9: SQL ----


@pytest.mark.parametrize("name", sorted(oracle.S))
def test_matches_sql(spark, name):
    got = queries.Q[name](spark, FOLDER).toPandas()
    assert difference(got, duck(FOLDER).execute(oracle.S[name]).df()) == ""


def test_entry_has_every_operator():
    names = set(entry.queries())
    assert set(queries.Q) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.Q} == {f"op{i}" for i in range(1, 14)}
    assert set(oracle.S) <= set(entry.oracle_sql())


def test_urls(spark):
    urls = [None, "", "nothing", "http://A.Example.NET/en/x?q#f", "https://x.example.com/de/1", "http://a.org/fr/", "http://a.net", "x://net/",
            "http://notnet.xyz/", "ftp://B.CO.UK/a#b?c"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(8, 1), (8, 1), (9, 0), (9, 0), (9, None), (99, 1), (None, 1)], "page_id long, good int")
    got = rows_of(url_reputation.judge(pages, outcomes, queries.RULES, min_good=0.4), "page_id")
    assert list(got["host"]) == ["", "", "", "a.example.net", "x.example.com", "a.org", "a.net", "net", "notnet.xyz", "b.co.uk"]
    assert list(got["path"]) == ["", "", "", "/en/x", "/de/1", "/fr/", "", "/", "/", "/a"]
    assert [r if isinstance(r, str) else None for r in got["rule"]] == [
        None, None, None, "example.net/en/", "example.com/de/", "org/fr/", None, "net/", None, None]
    assert list(got["verdict"][[3, 4, 5, 7]]) == ["allow", "block", "allow", "block"]
    rate = dict(zip(got["host"], got["good_rate"], strict=True))
    assert rate["notnet.xyz"] > rate["a.net"] > rate["b.co.uk"]  # shrunk to either side of the prior
    assert url_reputation.judge(pages.limit(0), outcomes, queries.RULES).count() == 0
    assert url_reputation.judge(pages, outcomes.limit(0), queries.RULES).count() == len(urls)


def test_mix_meets_targets(awkward, none, docs):
    got = order_sampling.mix(docs, [5, 2, 1]).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["most"] / 2 + 1e-6).all()
    assert by["target"].sum() == pytest.approx(1.5 * got["size"].sum())
    again = order_sampling.mix(docs.repartition(7), [5, 2, 1]).toPandas()
    assert difference(got, again) == ""
    assert len(order_sampling.mix(awkward, [5, 2, 1]).toPandas()) == awkward.count()
    assert order_sampling.mix(none, [5, 2, 1]).count() == 0 and order_sampling.mixed(none, [5, 2, 1]).count() == 0
    copies = order_sampling.mixed(docs, [5, 2, 1]).groupBy("doc_id").count().toPandas()
    want = got[got["copies"] > 0].set_index("doc_id")["copies"]
    assert copies.set_index("doc_id")["count"].sort_index().equals(want.sort_index().rename("count"))


def test_mix_ends_between_repeated_rows(spark):
    rows = [(1, " ".join(["ten"] * 10), "s", i) for i in range(40)] + [(2, "one two three", "s", 40)]
    rows += [(3, "five words are in it", None, i) for i in range(9)] + [(i, "some more words", "t", i) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    for share in (0.3, 0.7, 1.5):
        got = order_sampling.mix(df, [5, 2, 1], share=share).toPandas()
        by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
        assert ((by["taken"] - by["target"]).abs() <= by["most"] / 2 + 1e-6).all()
        assert (got["taken"] <= 2 * got["size"]).all()
        again = order_sampling.mix(df.repartition(3), [5, 2, 1], share=share).toPandas()
        assert difference(got, again) == ""
        mixed = order_sampling.mixed(df, [5, 2, 1], share=share)
        assert mixed.columns == df.columns and mixed.count() == got["copies"].sum()


def test_pareto_sampling_keeps_inclusion_odds(spark):
    """Over many seeds documents are taken about as often as they are due."""
    df = spark.createDataFrame([(i, " ".join("w" * (1 + i % 2 * 9)), "s") for i in range(60)], "doc_id long, text string, source string")
    counts = collections.Counter()
    for seed in range(6):
        counts.update({r["doc_id"]: r["copies"] for r in order_sampling.mix(df, [1], share=0.5, seed=seed).collect()})
    long, short = (np.mean([counts[i] for i in range(60) if i % 2 == k]) for k in (1, 0))
    assert long > short


def test_shards_fit(spark, awkward, none, docs, tmp_path):
    got = rows_of(extendible_sharding.shard(docs, 20_000))
    sums = got.groupby("shard")["bytes"].sum()
    shown = got.drop_duplicates("shard").set_index("shard").loc[sums.index]
    assert (shown["shard_bytes"] == sums).all()
    assert ((sums <= 20_000) | shown["oversized"]).all()
    assert (got[got["oversized"]].groupby("shard").size() == 1).all()
    names = sorted(sums.index)
    assert not any(b.startswith(a) for a, b in itertools.pairwise(names))  # prefixes part the space
    odd = rows_of(extendible_sharding.shard(awkward, 10))
    assert len(odd) == 13 and odd["shard"].notna().all()
    assert extendible_sharding.shard(none, 10).count() == 0
    with pytest.raises(ValueError):
        extendible_sharding.shard(docs, 0)
    extendible_sharding.write_shards(docs, 200_000, f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == docs.count()


def test_topk_on_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(None, [1.0] * 8), (300, None), (301, [None] + [1.0] * 7), (302, [float("nan")] * 8), (303, [float("inf")] * 8),
             (304, []), (305, [1.0, 2.0]), (5, rows[5][1]), (100, rows[100][1]), (306, [1e30] * 8), (307, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = segment_topk.top_k(df, F.col("vec_id") % 100 == 0, k=10, block=2)
    got = got.toPandas().sort_values(["query_id", "rank"])
    use = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = {}
    for n, (i, v) in enumerate(use):
        ints[n] = (i, [int(np.floor(1024 * x)) if abs(x) < 1e20 else int(x) * 1024 for x in v] + [0] * (8 - len(v)))
    for q in (0, 100, 200):
        own = next(v for i, v in ints.values() if i == q)
        all_ = sorted(((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(own, v, strict=True)))), i) for i, v in ints.values() if i != q))[:10]
        mine = got[got["query_id"] == q]
        assert list(zip(-mine["score"], mine["vec_id"], strict=True)) == all_
        assert list(mine["rank"]) == list(range(1, 11))
    assert segment_topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# ---- 3 ----


def test_swap_penalty_frees_neutral_mentions():
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        base = {rng.choice("abcdefgh") * rng.randrange(3, 6) for _ in range(12)}
        toxic = i % 4 == 0
        named = rng.random() < (0.9 if toxic else 0.2)
        texts.append(" ".join(sorted(base | ({"awful", "nasty"} if toxic and rng.random() < 0.9 else set()) | ({"women"} if named else set()))))
        labels.append(float(toxic))
    labels = np.array(labels)

    def gap(penalty):
        names, w, _ = toxicity.fit(texts, labels, swap_penalty=penalty)
        weight = dict(zip(names, w, strict=True))
        return sum(weight.get(f, 0) for f in toxicity.features_of("women")) - sum(weight.get(f, 0) for f in toxicity.features_of("men"))

    assert gap(0.0) > 0.5 and abs(gap(50.0)) < 0.2 * gap(0.0)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op3(spark, folder).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    both = got[got["held_out"]].merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    ranks = both["score"].rank().to_numpy()
    toxic = both["toxic"].to_numpy() == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95
    assert both["predicted"][toxic].mean() > 0.85 and both["predicted"][~toxic].mean() < 0.03


def test_toxicity_on_awkward_rows(spark, awkward, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (5, 0), (7, 0), (8, 2)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    assert toxicity.score(awkward, model).count() == awkward.count()
    assert toxicity.accepted(awkward, model, 2.0).toPandas().shape == awkward.toPandas().shape
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.train(awkward, labels.limit(0))
    assert toxicity.score(awkward, empty).agg(F.max("score")).first()[0] < 1e-6


# ---- 5 and 8 ----


@pytest.fixture(scope="module")
def library():
    with open(queries.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_digests(docs, plain, awkward, none, library):
    for df, texts in ((docs, plain), (awkward, rows_of(awkward.select("doc_id", "text")))):
        got = prefix_bpe.digests(df, queries.RANKS, public.PATTERN).toPandas()
        ids = [library.encode_ordinary(t or "") for t in texts["text"]]
        want = pd.DataFrame({
            "doc_id": texts["doc_id"], "n_tokens": [len(i) for i in ids],
            "ids_sha256": [hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256((t or "").encode()).hexdigest() for t in texts["text"]]})
        assert difference(got, want) == ""
    assert prefix_bpe.digests(none, queries.RANKS, public.PATTERN).count() == 0
    back = prefix_bpe.decoded(prefix_bpe.encoded(docs, queries.RANKS, public.PATTERN), queries.RANKS)
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in back.collect()} == dict(zip(plain["doc_id"], plain["text"], strict=True))


def test_bpe_random_texts_and_edits(library):
    rng = random.Random(7)
    letters = "ab  \n\t'sllé ü1234,.!?\u3000\x1c\x85\u200b中😀Aá²½\xa0<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for t, ids in zip(texts, prefix_bpe.encode_texts(texts, queries.RANKS, public.PATTERN), strict=True):
        assert ids.tolist() == library.encode_ordinary(t)
    coder = prefix_bpe.coder(queries.RANKS)
    for _ in range(100):
        s = bytes(rng.choice(b"abcdeinthe") for _ in range(rng.randrange(1, 300)))
        own = prefix_bpe.Growing(coder, s[:20])
        own.append(s[20:])
        assert own.tokens() == coder.merged(s) or s in coder.ranks
        lo = rng.randrange(len(s) + 1)
        hi = rng.randrange(lo, len(s) + 1)
        done = own.replace(lo, hi, b"xyz")
        assert own.last == coder.prefixes(s[:lo] + b"xyz" + s[hi:])
        assert done <= 3 + len(s) - hi


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_agree_in_polynomial_hashes(spark, library):
    """Words in Thue-Morse order and their mirrors have equal polynomials modulo 2^64."""
    own = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    for n in (1024, 2048, 8192):
        texts = [thue_morse(n), thue_morse(n, "ba"), thue_morse(n), f"so {thue_morse(n, 'ba')} it is"]
        for t, ids in zip(texts, prefix_bpe.encode_texts(texts, queries.RANKS, public.PATTERN), strict=True):
            assert ids.tolist() == library.encode_ordinary(t)
        for t, ids in zip(texts, id_store.encode_texts(texts, queries.VOCABULARY), strict=True):
            assert ids.tolist() == own.encode(t, add_special_tokens=False).ids
        a, b, c, d = words.word_hashes([t.encode() for t in texts])
        assert a[0] == c[0] != b[0] == d[1]
    df = spark.createDataFrame([(1, thue_morse(4096)), (2, thue_morse(4096, "ba"))], "doc_id long, text string")
    assert [r["component_id"] for r in minhash_dedup.near_duplicates(df).orderBy("doc_id").collect()] == [1, 2]


def test_parts_with_equal_hashes_are_compared(monkeypatch, library):
    """With hashes of three bits nearly all parts clash; the table stays small enough to be emptied."""
    monkeypatch.setattr(chunks, "mixed", lambda x: x & np.uint64(7))
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bc", "the", "word, is", "ünd\n"]) * rng.randrange(1, 4) for _ in range(30)) for _ in range(60)]
    memory = chunks.Memory(lambda parts: (np.array(library.encode_ordinary(p), np.uint32) for p in parts), entries=4)
    for _ in range(3):
        for t, ids in zip(texts, memory.encoded(texts), strict=True):
            assert ids.tolist() == library.encode_ordinary(t)


def test_texts_of_more_than_a_megabyte(library):
    rng = random.Random(11)
    some = ["some", "words", "that", "repeat,", "and\n", "x" * 40, "été", "1234"]
    text = " ".join(rng.choice(some) + str(rng.randrange(50)) for _ in range(230_000))
    assert len(text) > 2 << 20
    own = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    assert next(prefix_bpe.encode_texts([text], queries.RANKS, public.PATTERN)).tolist() == library.encode_ordinary(text)
    assert next(id_store.encode_texts([text], queries.VOCABULARY)).tolist() == own.encode(text, add_special_tokens=False).ids
    whole = next(words.word_hashes([text.encode()]))
    parts = [h for w in words.word_hashes([w.encode() for w in text.split()]) for h in w]
    assert whole.tolist() == parts


def test_id_store(spark, docs, plain, awkward, none, library):
    for df, texts in ((docs, plain), (awkward, rows_of(awkward.select("doc_id", "text")))):
        got = id_store.write(df, queries.VOCABULARY, 2).read(df).toPandas().sort_values("start").reset_index(drop=True)
        # ties of doc_id are in order of the text
        order = texts.sort_values(["doc_id", "text"], na_position="first")
        ids = [np.array([*library.encode_ordinary(t or ""), 2], "<u4") for t in order["text"]]
        sizes = np.array([len(i) for i in ids])
        assert list(got["n_tokens"]) == list(sizes) and list(got["start"]) == list(np.cumsum(sizes) - sizes)
        assert list(got["ids_crc32"]) == [zlib.crc32(i.tobytes()) for i in ids]
    assert id_store.write(none, queries.VOCABULARY, 2).read(none).count() == 0
    store = id_store.write(docs, queries.VOCABULARY, 2)
    missing = spark.createDataFrame([(10**12,), (None,), (3,)], "doc_id long")
    assert [r["doc_id"] for r in store.read(missing).collect()] == [3]


def test_key_index_is_minimal_and_rejects_strangers():
    keys = np.arange(-3, 20_000)
    hashes = id_store.key_hashes(keys, keys == -3)
    index = id_store.KeyIndex(id_store.build_index(hashes, [keys + 3, 2 * (keys + 3), np.ones(len(keys), int)]))
    there, (shard, record, _) = index.find(hashes)
    assert there.all() and (shard == keys + 3).all() and (record == 2 * shard).all() and index.n == len(keys)
    others = np.arange(10**6, 10**6 + 50_000)
    assert not index.find(id_store.key_hashes(others, others < 0))[0].any()
    empty = id_store.KeyIndex(id_store.build_index(hashes[:0], [keys[:0]] * 3))
    assert not empty.find(hashes[:5])[0].any()


# ---- 7 ----


def brute_components(texts, k, percent):
    """texts: {id: text}; id -> least id reachable over links of the shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("pair_limit", [64, 2])
def test_near_duplicates(spark, plain, pair_limit):
    rng = random.Random(9)
    texts = dict(zip(plain["doc_id"].tolist(), plain["text"], strict=True))
    at = 10_000
    for _ in range(3):  # chains of changed copies, some near, some too far
        base = text_of(rng, 120).split()
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(1, 9)):
                own[rng.randrange(len(own))] = "other"
            texts[at] = " ".join(own)
            at += 1
            base = own if rng.random() < 0.3 else base
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df, k=4, pair_limit=pair_limit).toPandas().set_index("doc_id")
    want, sizes = brute_components(texts, 4, 80)
    assert got["component_id"].to_dict() == want and got["n_shingles"].to_dict() == sizes
    assert (got["kept"] == (got.index == got["component_id"])).all()


def test_near_duplicates_write_open_sets_once(spark, monkeypatch):
    rng = random.Random(23)
    shared = [text_of(rng, 72) for _ in range(6)]  # long passages: a bucket in common, but not near enough
    texts = {i: f"{x} {text_of(rng, 10)}" for i, x in enumerate(shared * 8)}
    texts |= {100 + i: texts[i] + " end" for i in range(0, 48, 5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    steps = steps_of(monkeypatch, minhash_dedup)
    got = minhash_dedup.near_duplicates(df, k=4).toPandas().set_index("doc_id")
    assert got["component_id"].to_dict() == brute_components(texts, 4, 80)[0]
    small = dict(steps)["small-groups"].toPandas()
    assert len(small) and all(max(pre, default=shingle - 1) < shingle for pre, shingle in zip(small["pre"], small["shingle"], strict=True))
    assert [name for name, _ in steps].count("sets") == 1


def test_near_duplicates_on_awkward_rows(awkward, none):
    got = minhash_dedup.near_duplicates(awkward).toPandas()
    comp = got.dropna(subset=["doc_id"]).set_index("doc_id")["component_id"]
    assert set(comp.loc[6]) == {1} and comp[10] == 1 and all(comp[i] == i for i in (1, 2, 3, 4, 5, 7, 8, 9))
    lone = got[got["doc_id"].isna()]
    assert sorted(lone["component_id"].fillna(-1)) == [-1, 1]
    assert minhash_dedup.near_duplicates(none).count() == 0
    left = minhash_dedup.deduplicated(awkward)
    assert left.columns == awkward.columns
    # one of the rows without id is a copy of document 1
    assert sorted(left.toPandas()["doc_id"].fillna(-1)) == [-1, 1, 2, 3, 4, 5, 7, 8, 9]


def test_deduplicated_tells_texts_under_one_id_apart(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(80)) for _ in range(3))
    rows = [(2, a), (1, a), (2, b), (2, b), (None, c), (None, c), (5, c + " more"), (7, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in minhash_dedup.deduplicated(df).collect()}
    assert got == {(1, a), (2, b), (5, c + " more"), (7, ""), (7, None)}


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(30)] + [(1000, 1000 + i) for i in range(200)] + [
        (rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(5, 5), (None, 3), (7, 6), (7, 6)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    root: dict = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert dict(zip(got["node"], got["root"], strict=True)) == {i: find(i) for i in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 10 ----


def brute_counts(text):
    w = WORD.findall(text)
    seen, covered = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, plain, awkward, none):
    for df, texts in ((docs, plain), (awkward, rows_of(awkward.select("doc_id", "text")))):
        got = robust_quality.judge(df).toPandas()
        want = pd.DataFrame([brute_counts(t or "") for t in texts["text"]], columns=list(robust_quality.COUNTS))
        want["doc_id"] = texts["doc_id"]
        want["base_failed"] = (want["n_words"] < 10) | (100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert difference(got[want.columns], want) == ""
        assert not got["kept"][got["base_failed"]].any()
    assert robust_quality.judge(none).count() == 0


def test_quality_rejects_outliers_among_many(spark):
    rng = random.Random(6)
    rows = [(i, text_of(rng, rng.randrange(80, 200)), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join("#$%" * 5 + "ab" for _ in range(100)) + f" {text_of(rng, 30)}", "en", "s") for i in range(60)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    got = robust_quality.judge(df).toPandas().set_index("doc_id")
    assert got.loc[list(range(300)), "kept"].all()
    assert not got.loc[[1000 + i for i in range(60)], "kept"].any()


# ---- pipeline ----


def test_pipeline_stage_by_stage(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas().set_index("doc_id")
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        after = docs.toPandas()
        if i < 4:
            assert docs.columns == columns
        if name == "toxicity":
            labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id")["toxic"]
            kept = labels.reindex(after["doc_id"]).dropna()
            assert (kept == 0).sum() >= 0.98 * (labels == 0).sum() and (kept == 1).sum() <= 0.3 * (labels == 1).sum()
        elif name == "near_duplicates":
            want, _ = brute_components(before["text"].to_dict(), 5, 80)
            assert set(after["doc_id"]) == set(want.values())
        elif name == "repeated_passages":
            assert set(after["doc_id"]) <= set(before.index)
            assert (after["n_chars"] == after["text"].str.len()).all()
            assert len(brute_passages(dict(zip(after["doc_id"], after["text"], strict=True)), 50)) == 0
        elif name == "mix":
            sizes = {i: len(WORD.findall(t)) for i, t in before["text"].items()}
            taken = after["doc_id"].map(sizes).sum()
            assert taken == pytest.approx(1.5 * sum(sizes.values()), rel=0.02)
            assert after.groupby("doc_id").size().max() <= 2
        else:
            assert sorted(after["doc_id"]) == sorted(before.index)
            hashes = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in before["text"].items()}
            assert (after["decoded_sha256"] == after["doc_id"].map(hashes)).all()


def test_pipeline_on_awkward_rows(spark, awkward, none, tmp_path):
    labels = spark.createDataFrame([(1, 0), (5, 0), (7, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for df in (awkward, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, f"file://{tmp_path}")
            assert df.columns == awkward.columns
        assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == df.count()
