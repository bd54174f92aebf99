"""Exact and near duplicates and the pipeline, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import exact_dedup, jaccard_join, near_vectors, signature_tree
from skein.llm.common import scratch
from skein.llm.components import components
from skein.llm.shingles import Bands, bitmap, shingle_sets

SF = "/root/testdata/sf0.01"


def groups(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_links(sets):
    return [(i, j) for i, a in enumerate(sets) for j in range(i) if a and (b := sets[j]) and 100 * len(a & b) >= 75 * len(a | b)]


# --- exact -----------------------------------------------------------------

TEXTS = [(9, "a  b"), (3, "a\t\nb"), (4, "a b"), (5, None), (6, ""), (7, "a b"), (None, "a b"), (8, "z" * 200_000), (10, "z" * 200_000), (11, "u"), (11, "u"), (12, " ")]


def test_exact_dedup(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, kept int")
    index = exact_dedup.DigestIndex(spark, scratch(spark, "t"), buckets=4)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.deduplicate(df, index).collect()]
    norm = [(i, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()) for i, t in TEXTS]
    size = Counter(h for _, h in norm)
    least = {h: min(i for i, g in norm if g == h and i is not None) for h in size}
    assert sorted(map(repr, got)) == sorted(repr((i, least[h], size[h], i == least[h], h)) for i, h in norm)


def test_index_remembers_and_repeats(spark):
    df = spark.createDataFrame([(5, "x"), (6, "y"), (7, "y")], "doc_id long, text string")
    later = spark.createDataFrame([(1, "x"), (2, "new")], "doc_id long, text string")
    path = scratch(spark, "t")
    first = lambda d: sorted((r["doc_id"], r["keep_id"]) for r in exact_dedup.deduplicate(d, exact_dedup.DigestIndex(spark, path, buckets=4)).collect())
    assert first(df) == [(5, 5), (6, 6), (7, 6)] == first(df)
    exact_dedup.DigestIndex(spark, path, buckets=4).forget()
    assert first(df) == [(5, 5), (6, 6), (7, 6)]
    assert first(later) == [(1, 5), (2, 2)]
    assert exact_dedup.DigestIndex(spark, path, buckets=4).read().count() == 3
    assert first(df.limit(0)) == []


def test_drop_copies_keeps_columns_and_one_row(spark):
    df = spark.createDataFrame([(1, "a", "k"), (2, "a", "k"), (3, "b", None), (3, "b", None), (3, "c", "q"), (None, "d", "k")], "doc_id long, text string, digest string")
    got = exact_dedup.drop_copies(df, exact_dedup.DigestIndex(spark, scratch(spark, "t"), buckets=2))
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "a", "k"), (3, "b", None), (3, "c", "q"), (None, "d", "k")]))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_plan_is_native(spark, monkeypatch):
    plans = []
    write = exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda df, path: (plans.append(plan_of(df)), write(df, path))[1])
    df = spark.range(5).selectExpr("id as doc_id", "cast(id % 3 as string) as text")
    out = exact_dedup.drop_copies(df, exact_dedup.DigestIndex(spark, scratch(spark, "t")))
    assert out.count() == 3 and len(plans) >= 4
    assert not re.search("Python|Pandas|Arrow", "".join([*plans, plan_of(out)]))


def test_index_is_read_without_sort_or_shuffle_after_many_batches(spark):
    path = scratch(spark, "t")
    index = exact_dedup.DigestIndex(spark, path, buckets=4, most_runs=3)
    for n in range(12):
        df = spark.createDataFrame([(100 * n + k, f"t{n * 5 + k}") for k in range(9)], "doc_id long, text string")
        got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.deduplicate(df, index).collect()}
        assert got == {100 * n + k: (100 * (n - 1) + k + 5 if n and k < 4 else 100 * n + k) for k in range(9)}
    assert len(index.runs()) == 3 and index.read().count() == 11 * 5 + 9
    before = spark.conf.get(exact_dedup._ORDERED, "false")
    groups = spark.range(3).selectExpr("unhex(sha2(cast(id as string), 256)) as digest", "id as keep_id")
    with exact_dedup._sorted_scans(spark):
        plan = plan_of(index.unknown(groups, index.runs()))
    assert spark.conf.get(exact_dedup._ORDERED, "false") == before
    assert plan.count("SortMergeJoin") == len(index.runs()) and plan.count("Exchange") == plan.count("Sort ") == 1
    dead = index.runs()[-1]
    exact_dedup.remove(spark, f"{index._folder(dead)}/_SUCCESS")
    assert dead not in index.runs()


def test_buckets_follow_rows():
    assert [exact_dedup.buckets_for(n) for n in (0, 1, 32_000_000, 32_000_001, 10**10)] == [16, 16, 16, 32, 8192]


@pytest.mark.parametrize("drop", ["exact", "near"])
def test_clashing_names_and_any_type(spark, drop):
    names = ["_kept", "_id", "_sha", "_digest", "_k", "row", "id", "digest", "kept_id", "node", "salt", "component_id", "n", "a.b", "back`tick"]
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a  b"), (3, None), (4, "c")], "doc_id long, text string")
    for k, c in enumerate(names):
        df = df.withColumn(c, F.lit(k))
    df = df.withColumn("m", F.create_map(F.lit("x"), F.col("doc_id"))).withColumn("s", F.struct(F.lit(1).alias("row")))
    run = {"exact": lambda: exact_dedup.drop_copies(df, exact_dedup.DigestIndex(spark, scratch(spark, "t"))), "near": lambda: jaccard_join.drop_near_copies(df)}[drop]
    got = run()
    assert got.schema.simpleString() == df.schema.simpleString()
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == ([1, 3, 4] if drop == "exact" else [1, 1, 3, 4])
    assert all(r["m"] == {"x": r["doc_id"]} and [r[c] for c in names] == list(range(len(names))) for r in rows)


def test_drop_copies_of_an_id_with_a_text_that_stays_and_one_that_goes(spark):
    df = spark.createDataFrame([(1, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "a"), (5, "z"), (None, "z"), (None, "q")], "doc_id long, text string")
    got = exact_dedup.drop_copies(df, exact_dedup.DigestIndex(spark, scratch(spark, "t")))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "a"), (3, "b"), (5, "z"), (None, "q")]))


# --- near ------------------------------------------------------------------


def test_shingle_sets_equal_brute_force():
    texts = ["", " ", "a", "A b", "a b c d e", "a b c d e f a b c d e f", "é É x\x0by", "w" * 70_000, "word " * 30_000, "a\x1cb c", None]
    sets = shingle_sets([t or "" for t in texts])
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def random_sets(rng, n, most):
    base = rng.integers(0, 1 << 62, (6, most)).astype("u8")
    return [np.unique(np.concatenate([base[k % 6][: rng.integers(most // 3, most)], rng.integers(0, 1 << 62, rng.integers(0, most // 5)).astype("u8")])) for k in range(n)]


@pytest.mark.parametrize("most", [20, 200, 20_000])
def test_signature_tree_loses_no_pair(most):
    rng = np.random.default_rng(3)
    sets = random_sets(rng, 90, most)
    truth = {(i, j) for i in range(90) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - c)}
    sizes, own = np.array([len(s) for s in sets]), np.arange(90)
    maps = [bitmap(s) for s in sets]
    got = {(max(p), min(p)) for p in signature_tree.candidates(maps, sizes, own, 75)}
    assert truth and truth <= got and len(got) < 90 * 89 / 2
    forest = signature_tree.spanning(maps, sizes, own, 75)
    assert groups(90, forest) == groups(90, got)
    halves = np.arange(90) % 2
    assert {p for p in truth if halves[p[0]] != halves[p[1]]} <= {(max(p), min(p)) for p in signature_tree.candidates(maps, sizes, halves, 75)}


@pytest.mark.parametrize("size", [400, 2_000, 6_000, 20_000])
def test_signature_tree_prunes_disjoint_sets_of_any_size(size):
    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(0, 1 << 62, size).astype("u8")) for _ in range(40)]
    assert signature_tree.candidates([bitmap(s) for s in sets], np.array([len(s) for s in sets]), np.arange(40), 75) == []


def test_bands_miss_no_pair_at_the_threshold():
    """Recall at the threshold itself: 20,000 pairs of similarity 0.75 to 0.76."""
    rng = np.random.default_rng(9)
    bands = Bands(jaccard_join.BANDS, jaccard_join.ROWS)
    missed = 0
    for _ in range(40):
        pool = rng.integers(0, 1 << 63, (500, 140)).astype("u8")
        a, b = bands.keys(list(pool[:, :120])), bands.keys(list(pool[:, 20:]))  # 100 common of 140
        c, d = bands.keys(list(pool[:, :123])), bands.keys(list(pool[:, 17:]))  # 106 of 140: 0.757
        missed += int((~(c == d).any(1)).sum())
        assert (a == b).any(1).mean() > 0.99
    assert missed == 0


def near_rows(rng):
    words = [f"w{n}" for n in range(400)]
    rows, passage = [], " ".join(rng.choice(words, 60))
    for g in range(8):
        text = rng.choice(words, rng.integers(6, 200)).tolist()
        for _ in range(rng.integers(1, 14)):
            edited = [w if rng.random() > 0.012 else str(rng.choice(words)) for w in text]
            rows.append(" ".join(edited))
    rows += [passage + " " + " ".join(rng.choice(words, rng.integers(1, 200))) for _ in range(12)]
    return rows + ["", None, " \t", "one", "ONE", "a b", "A  b", "a b c", rows[0], rows[0].upper(), "w " * 30_000]


@pytest.mark.parametrize(("chunk", "node_bits"), [(jaccard_join.CHUNK, 64), (4, 64), (64, 4)])
def test_jaccard_groups_equal_brute_force(spark, chunk, node_bits):
    texts = near_rows(np.random.default_rng(chunk))
    ids = [int(x) for x in np.random.default_rng(1).permutation(len(texts)) * 7]
    order = np.argsort(ids)
    sets = [shingles(texts[k]) for k in order]
    of = groups(len(texts), near_links(sets))
    want = {ids[k]: (len(sets[n]), ids[order[of[n]]]) for n, k in enumerate(order)}
    df = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(df, chunk=chunk, node_bits=node_bits).collect()}
    assert got == want
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_on_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s"), (2, "Q  r S"), (None, "a b c d e f"), (None, "x")], "doc_id long, text string")
    got = sorted(map(repr, map(tuple, jaccard_join.jaccard_groups(df).collect())))
    assert got == sorted(map(repr, [(1, 2, 1), (1, 2, 1), (1, 1, 1), (2, 1, 1), (None, 2, 1), (None, 1, None)]))
    assert jaccard_join.jaccard_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components_of_random_links(spark, one_task):
    rng = np.random.default_rng(2)
    links = [tuple(map(int, p)) for p in rng.integers(0, 120, (90, 2))] + [(200, n) for n in range(201, 260)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["component"] for r in components(df, one_task=one_task).collect()}
    of = groups(260, [p for p in links if p[0] != p[1]])
    assert got == {n: of[n] for n in range(260) if of[n] != n}
    assert components(df.limit(0), one_task=one_task).count() == 0


# --- vectors ---------------------------------------------------------------


@pytest.mark.parametrize("tile", [7, 2048])
def test_vectors_equal_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(10, 16))
    vectors = [(base[k % 10] + rng.normal(scale=0.04, size=16)).astype("f4").tolist() for k in range(120)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]], [0.0] * 16, None, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], []]
    ids = [int(x) for x in rng.permutation(len(vectors)) * 3]
    labels = [None if k == 5 else int(k % 3 == 0) for k in range(len(vectors))]
    rows = list(zip(ids, vectors, labels, strict=True))
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = []
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            w = vectors[j]
            if good[i] and good[j] and label is not None and label == labels[j] and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links.append((i, j))
    n = Counter(x for p in links for x in p)
    of = groups(len(rows), links)
    least = {}
    for k, g in enumerate(of):
        least[g] = min(least.get(g, 1 << 60), ids[k])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(df, tile_rows=tile).collect()}
    assert links and got == {ids[k]: (n[k], least[of[k]], ids[k] == least[of[k]]) for k in range(len(rows))}
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "labels"), [("double", [0.5, 0.7, 0.5, -0.0, 0.0, None]), ("string", ["x", "1", "x", "01", "01", None]), ("boolean", [True, False, True, False, False, None])])
def test_vector_labels_of_any_type(spark, kind, labels):
    df = spark.createDataFrame([(i, [1.0, 2.0], v) for i, v in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}").withColumn("node", F.lit(1)).withColumn("check", F.lit(1))
    got = {r["vec_id"]: r["component_id"] for r in near_vectors.near_duplicates(df).collect()}
    want = {i: min(j for j, v in enumerate(labels) if v is not None and v == label) if label is not None else i for i, label in enumerate(labels)}
    assert got == want


def test_very_large_and_very_small_vectors_link(spark):
    df = spark.createDataFrame([(k, [x * s, 2 * x * s], 1) for k, (x, s) in enumerate([(1.0, 1.0), (1.01, 1e200), (1.0, 1e-200), (3.0, 1e300), (1.0, 5e-324)])] + [(9, [2e200, -1e200], 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in near_vectors.near_duplicates(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9}


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == columns
            path = scratch(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    exact = after["toxicity"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for i in sorted(exact):
        first.setdefault(norm(exact[i]), i)
    assert set(after["exact dedup"]) == set(first.values())
    ids = sorted(after["exact dedup"])
    sets = [shingles(after["exact dedup"][i]) for i in ids]
    of = groups(len(ids), near_links(sets))
    assert set(after["n-gram Jaccard join"]) == {i for k, i in enumerate(ids) if of[k] == k}
    packed = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in packed} == set(after["n-gram Jaccard join"]) and all(r["n"] == r["t"] for r in packed)


def test_pipeline_on_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label int"
    odd = spark.createDataFrame([(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, "a b", "en", "s", 3, None), (3, "a b", "en", "s", 3, None), (None, "word " * 40_000, "en", "s", 1, 1)], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            path = scratch(spark, "stage")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
    assert docs.count() == 0
    assert public_tokenizers.path(corpus_pipeline.TOKENIZER)
