"""Toxicity, quality, licences, tokenisers, packing, chat and counts on small tables, against brute force."""

import base64
import hashlib
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import byte_bpe, chat, licenses, packing, pretokens, quality, token_counts, toxicity
from skein.llm import queries as llm_queries
from skein.llm.labelled import logistic, sample

SF = "/root/testdata/sf0.01"
JSON, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "wörd " * 20_000), (5, "again"), (None, "no id"), (6, "x" * 50_000), (7, "\x00 　 ok"), (8, "a"), (8, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "l", 1) for i, t in ODD], "doc_id long, text string, label string, score int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def held_out_rates(spark, df, label, sf):
    """Recall of the rare class, the share of the other class that is taken for it, and rows."""
    got = df.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    rare = int(got[label].mean() < 0.5)
    said, true = got["predicted"] == rare, got[label] == rare
    return said[true].mean(), said[~true].mean(), len(got)


# --- classifiers -----------------------------------------------------------


@pytest.mark.parametrize(("operator", "label", "least", "most"), [(toxicity, "toxic", 0.85, 0.02), (quality, "quality", 0.9, 0.02)])
def test_held_out_recall_and_false_positives(spark, operator, label, least, most):
    sf = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    recall, wrong, n = held_out_rates(spark, operator.score(docs, operator.fit(docs, labels)), label, sf)
    assert n > 500 and recall > least and wrong < most, (recall, wrong, n)


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.range(4000).selectExpr("id % 4 as doc_id", "concat('t', id) as text")
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, toxic int")
    got = sample(docs, labels, "toxic", 4, 9, rows=3).collect()
    assert len(got) == 3 and all(r["text"] == min(f"t{k}" for k in range(r["doc_id"], 4000, 4)) for r in got)


_ENTRIES = (("ab", 1.0), ("abc", 2.0), ("b ", 3.0), ("cab ", 4.0), ("a", 0.5))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "abc", "cab", "cabs", "bc"]), max_size=12), st.sets(st.sampled_from(["ab bc", "b", "a b ab", "cab", "bc cab a"])))
def test_matches_equal_a_naive_scan(words, exceptions):
    folded = toxicity.fold(" ".join(words))
    spans = [(i, i + len(x)) for x in (" " + e for e in exceptions) for i in range(len(folded)) if folded.startswith(x, i)]
    want = {}
    for i in range(len(folded)):
        for k, (entry, weight) in enumerate(_ENTRIES):
            if folded.startswith(" " + entry, i) and (i not in want or len(entry) >= want[i][0] - i):
                want[i] = (i + len(entry), k, weight)
    want = {i: v for i, v in want.items() if not any(a <= i and v[0] < b for a, b in spans)}
    assert {(s, *rest) for s, *rest in toxicity.Lexicon(_ENTRIES, tuple(exceptions)).hits(folded)} == {(i, *v) for i, v in want.items()}


def test_many_exceptions_take_linear_time():
    lexicon = toxicity.Lexicon((("idiot", 3.0), ("trash ", 3.0)))
    began = time.perf_counter()
    assert toxicity.features("trash can idiot x " * 100_000, lexicon)[0] > 0
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("text", ["a pigeon", "pigment", "prickly pear", "jerky", "crape", "une douchette", "filtho", "trashcan"])
def test_words_that_begin_like_whole_word_entries_are_clean(text):
    assert toxicity.features(text, toxicity.Lexicon(tuple((w, 3.0) for w in toxicity.SEED))) == [0, 0, 0, 0]


@pytest.mark.parametrize("text", ["one  word\n\nOne word!!", "", " ", "ÄÖ 12 34 | | x, y. z", "same same same same", "l\nl\nl\nm"])
def test_statistics_equal_naive_counts(text):
    got, data, words = quality.statistics(text), text.encode(), text.split()
    arc = lambda k, of: float(np.arcsin(np.sqrt(min(1.0, k / of))))
    n, m, lines = len(data) or 1, len(words) or 1, [x for x in text.split("\n") if x.strip()]
    letters = [c for c in data if chr(c).isascii() and chr(c).isalpha()]
    pairs = list(zip(words, words[1:], strict=False))
    want = {
        0: np.log1p(len(data)),
        1: np.log1p(len(words)),
        2: np.log1p(np.mean([len(w) for w in words]) if words else 0),
        4: arc(sum(chr(c).isupper() for c in letters), max(len(letters), 1)),
        5: arc(sum(48 <= c <= 57 for c in data), n),
        8: arc(text.count("|"), m),
        9: arc(text.count("!"), n),
        10: arc(len(data) - len(text), n),
        12: np.log(len(set(words)) + 1) / np.log(m + 1.5),
        13: arc(max((words.count(w) for w in words), default=0), m),
        14: arc(sum(a == b for a, b in pairs), m),
        15: arc(max((pairs.count(p) for p in pairs), default=0), m),
        16: arc(len(lines) - len(set(lines)), len(lines) or 1),
    }
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


@pytest.mark.parametrize("text", ["you IDIOT!", "1d10t", "іdіоt", "ｉｄｉｏｔ", "i.d.i.o.t", "id​iot", "ídíot"])
def test_disguised_words_match(text):
    lexicon = toxicity.Lexicon((("idiot", 3.0),))
    assert toxicity.features(text, lexicon)[1] > 0


@pytest.mark.parametrize("text", ["an idiot proof plan", "clown fish", "idio tic", "", "a1 b2 c3", "scunthorpe"])
def test_exceptions_and_clean_texts_do_not(text):
    lexicon = toxicity.Lexicon((("idiot", 3.0), ("clown", 3.0), ("cunt", 3.0)))
    assert toxicity.features(text, lexicon) == [0, 0, 0, 0]


def test_longer_texts_weigh_a_match_less():
    lexicon = toxicity.Lexicon((("idiot", 3.0),))
    assert toxicity.features("idiot " + "word " * 30, lexicon)[1] > toxicity.features("idiot " + "word " * 300, lexicon)[1]


@pytest.mark.parametrize("text", ["shi7", "1d107", "455hole", "bullsh17", "cun7", "mierd@", "a$$h0l3", "well!idiot", "$$$bitch now", "$h17!", "한 enculé", "한 ïdiót", "한 CRÁP 1"])
def test_toxicity_of_digits_anywhere_and_accents_beside_hangul(text):
    lexicon = toxicity.Lexicon(tuple((w, 3.0) for w in toxicity.SEED))
    assert toxicity.features(text, lexicon)[0] == pytest.approx(np.log1p(3.0))


def test_toxicity_reads_a_word_once_and_exceptions_in_disguise():
    lexicon = toxicity.Lexicon((("idiot", 3.0), ("clown", 3.0)))
    assert toxicity.features("1d10t idiot2 idiot!", lexicon)[0] == pytest.approx(np.log1p(9.0))
    assert toxicity.features("clown f1sh, 1d 10 7, 2024", lexicon) == [0, 0, 0, 0]


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, odd, empty, operator):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = operator.fit(odd, none)
    got = operator.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    by = [r["score"] for r in got if r["doc_id"] in (1, 2)]
    assert by[0] == by[1]
    assert operator.score(empty, model).count() == 0
    assert odd.filter(operator.score_column(model)(F.col("text")) >= 0).columns == odd.columns


def test_log_densities_equal_the_direct_formula():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (80, 3)), rng.normal(1, 2, (60, 3))])
    y = np.repeat([0.0, 1.0], [80, 60])
    means, covariances = quality.shrunk(x, y, 0.2, 0.1)
    model = quality.Discriminant(np.zeros(3), np.ones(3), means, covariances)
    direct = [-0.5 * (np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + np.log(np.linalg.det(c))) for m, c in zip(means, covariances, strict=True)]
    assert np.allclose(model.difference(x), direct[1] - direct[0])
    assert ((quality.fit_arrays(x, y).score(x) >= 0.5) == y).mean() > 0.75


def test_logistic_separates():
    x = np.linspace(-3, 3, 50)[:, None]
    w = logistic(x, (x[:, 0] > 0).astype(float))
    assert w[0] > 1 and abs(w[1]) < 0.5


# --- licences --------------------------------------------------------------


def test_license_inheritance(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "a/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (3, "a/b/c.txt", "plain words"), (4, "d/e.txt", "plain"), (5, "a/b/own.txt", "intro\nThis work is licensed under the GNU General Public License, version 3.\nmore text that goes on and on " + "x " * 80), (6, "a/n.txt", None), (7, None, "")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["MIT", "Apache-2.0", "Apache-2.0", "MIT", "GPL-3.0", "Apache-2.0", "MIT"]
    assert (got[3]["origin"], got[3]["licensed_by"]) == ("inherited", "a/LICENSE.txt")
    assert got[5]["origin"] == "own" and got[5]["cosine"] > 0.9
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_licenses_by_spdx_header(spark):
    texts = ["// SPDX-License-Identifier: MIT\ncode", "# SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later WITH MIT-exception", "SPDX-License-Identifier: (Foo OR BSD-3-Clause)", "SPDX-License-Identifier: Foo-1.0"]
    rows = [(i, f"d{i}/x.c", t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(5)] == ["MIT", "Apache-2.0", "GPL-2.0", "BSD-3-Clause", None]


def test_license_terms_are_counted_over_all_texts(spark):
    texts = ["Plain words, plain words and more", "words and 2.0 words", None, "", "more plain\nwords and"] * 7
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {"words", "and", "plain", "plain words", "words and", "2.0", "never"}
    got = {r["term"]: r["n"] for r in licenses.document_counts(files, spark.createDataFrame([(t,) for t in sorted(wanted)], "term string")).collect()}
    assert {t: got.get(t, 0) for t in wanted} == {t: sum(t in licenses.terms(x or "") for x in texts) for t in wanted}


def test_license_notice_among_ordinary_words(spark):
    plain = "this project is see the file for details and under the words of it is a project for this see file details "
    rows = [(i, f"p{i}/a.txt", plain + str(i)) for i in range(60)] + [(99, "q/README", "This project is licensed under the MIT License - see the LICENSE file for details.")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).filter("origin = 'own'").collect()}
    assert got == {99: "MIT"}


def test_whole_license_texts(spark):
    texts = licenses.TEXTS
    bsd = texts["BSD-3-Clause"].replace("<year> <owner>", "2021 Some One")
    header = "\n".join(f" * {line}" for line in bsd.split("\n"))
    rows = [(i, f"d{i}/LICENSE", texts[name]) for i, name in enumerate(sorted(texts))] + [(100, "x/LICENSE", bsd), (101, "x/y/z.c", "int a;"), (102, "y/a.c", f"/*\n{header}\n */\nint main(void) {{ return 0; }}\n")]
    rows += [(103, "z/LICENSE", texts["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL")), (104, "w/LICENSE", texts["CC-BY-SA-4.0"].replace("-ShareAlike", "").replace("ShareAlike", ""))]
    rows += [(105, "v/LICENSE", "\n".join(bsd.split("\n")[2:7]) + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i]["license"] for i in range(len(texts))] == sorted(texts)
    assert [got[i]["license"] for i in range(100, 106)] == ["BSD-3-Clause", "BSD-3-Clause", "BSD-3-Clause", "AGPL-3.0", "CC-BY-4.0", "BSD-3-Clause"]
    assert (got[101]["origin"], got[101]["licensed_by"]) == ("inherited", "x/LICENSE")


@pytest.mark.parametrize(("file", "name"), [("Artistic", None), ("GFDL-1.2", None), ("GFDL-1.3", None), ("GPL-1", None), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2", None), ("LGPL-2.1", None), ("LGPL-3", "LGPL-3.0"), ("MPL-1.1", None), ("MPL-2.0", "MPL-2.0"), ("BSD", "BSD-3-Clause"), ("CC0-1.0", "CC0-1.0"), ("Apache-2.0", "Apache-2.0")])
def test_whole_texts_are_named_right_or_not_at_all(file, name):
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("the system has no such text")
    weights = licenses.Weights(1000, {}, 1.0)
    for named in (True, False):
        assert licenses.best_match(licenses.passages(path.read_text(errors="replace"), named), {}, weights)[0] == name


@pytest.mark.parametrize(("line", "name"), [("Licensed under the GNU Lesser General Public License, version 2.1", None), ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"), ("under the Apache License, Version 1.1", None), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-SA 3.0.", None), ("Released under the MIT License.", "MIT")])
def test_notices_of_other_versions_do_not_count(line, name):
    assert licenses.best_match(licenses.passages(line), {}, licenses.Weights(1000, {}, 1.0))[0] == name


def test_scan_equals_naive_cosines_and_a_naive_walk(spark):
    rng = np.random.default_rng(5)
    words = "licensed under the mit license apache version code plain of this work public released x y z".split()
    notices = [n for texts in licenses.TEMPLATES.values() for n in texts]
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(words, rng.integers(1, 12)).tolist())
        if k % 4 == 0:
            text += "\n" + notices[int(rng.integers(len(notices)))] + (" " + " ".join(rng.choice(words, 3).tolist()) if k % 8 else "")
        folder = "/".join(rng.choice(["a", "b"], rng.integers(0, 4)).tolist())
        name = "LICENSE" if k % 5 == 0 else f"f{k}\nx"
        rows.append((k, f"{folder}/{name}{k}" if folder else f"{name}{k}" if k % 5 else f"LICENSE-{k}", text if k % 7 else None))
    rows = [(i, p.replace("LICENSE", "LICENSE.") if "LICENSE" in p and "LICENSE-" not in p else p, t) for i, p, t in rows]
    n = len(rows)
    df = {}
    for _, _, t in rows:
        for term in set(licenses.terms(t or "")):
            df[term] = df.get(term, 0) + 1
    idf = lambda t: 1.0 + np.log((n + 1) / (df.get(t, 0) + 1)) / np.log(n + 2)

    def cosine(x, y):
        a, b = ({t: licenses.terms(z).count(t) * idf(t) for t in licenses.terms(z)} for z in (x, y))
        return sum(v * b.get(t, 0) for t, v in a.items()) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5

    own, dirs = {}, {}
    for i, p, t in rows:
        best = None
        for passage in licenses.passages(t or "", bool(re.search(licenses.LICENSE_FILE, p))):
            for name, texts in licenses.TEMPLATES.items():
                for k, y in enumerate(texts):
                    c = cosine(passage, y)
                    if c >= licenses.THRESHOLD and licenses.same_version(name, passage) and (best is None or (-round(c, 12), name, -len(passage)) < best[0]):
                        best = (-round(c, 12), name, -len(passage)), c
        if best:
            own[i] = best[0][1], best[1]
            if re.search(licenses.LICENSE_FILE, p) or -2 * best[0][2] >= len(t):
                at = p.rpartition("/")[0]
                dirs[at] = min(dirs.get(at, (0.0, "", "")), (-round(best[1], 9), p, best[0][1]))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit(1)).withColumn("key", F.lit(2))).collect()
    assert len(got) == n and len(own) > 8 and len(dirs) > 2
    for r in got:
        i, p, _ = rows[r["doc_id"]]
        assert r["path"] == p
        if i in own:
            assert (r["license"], r["origin"], r["licensed_by"]) == (own[i][0], "own", p) and r["cosine"] == pytest.approx(own[i][1], abs=1e-6)
            continue
        at, want = p.rpartition("/")[0], None
        while want is None:
            want = dirs.get(at)
            if not at:
                break
            at = at.rpartition("/")[0]
        assert (r["license"], r["origin"], r["licensed_by"]) == ((want[2], "inherited", want[1]) if want else (None, "none", None))


def test_every_license_line_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = F.concat(F.lit("x/"), F.col("doc_id").cast("string"))
    got = {r["doc_id"] for r in licenses.scan(docs.select("doc_id", path.alias("path"), "text")).filter("origin = 'own'").collect()}
    assert got == {r["doc_id"] for r in docs.filter("lower(text) LIKE '%licen%'").collect()}


# --- tokens ----------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn"))))
def test_byte_bpe_equals_the_reference_library(text):
    ranks = test_byte_bpe_equals_the_reference_library.__dict__.setdefault("ranks", {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))})
    encoding = test_byte_bpe_equals_the_reference_library.__dict__.setdefault("encoding", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    packed = byte_bpe.codec(RANKS).encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(text)
    assert byte_bpe.codec(RANKS).decode(packed) == text.encode()
    assert "".join(pretokens.split(text)) == text


def test_round_trip_of_odd_rows(odd, empty, reference):
    got = byte_bpe.round_trip(odd, RANKS).collect()
    assert len(got) == len(ODD)
    want = sorted((len(reference.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in ODD)
    assert sorted((r["n_tokens"], r["decoded_sha256"]) for r in got) == want
    assert byte_bpe.round_trip(empty, RANKS).count() == 0


def test_cache_that_overflows_loses_nothing():
    cache = pretokens.PieceCache(str.upper, limit=3)
    for text in ("a b c", "d e f g h", "a b", "x" * 100):
        assert "".join(cache.values_of(text)) == text.upper() and len(cache) <= 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_decreasing(lengths):
    n = np.array(lengths, "i8")
    numbers, offsets = packing.best_fit_decreasing(n, 64)
    want = {}
    for length in sorted(lengths, reverse=True):
        fits = [w for w, used in want.items() if used + length <= 64]
        best = max(fits, key=lambda w: want[w]) if fits else len(want)
        want[best] = want.get(best, 0) + length
    got = {}
    for w, o, length in sorted(zip(numbers.tolist(), offsets.tolist(), lengths, strict=True)):
        assert o == got.get(w, 0)
        got[w] = o + length
    assert sorted(got.values()) == sorted(want.values())


def test_packing_keeps_every_id(spark, odd, empty, reference):
    got = packing.pack(odd.filter("doc_id != 8 AND doc_id != 5 OR text = 'again'"), JSON).toPandas()
    texts = {i: t or "" for i, t in ODD if i != 5} | {5: "again"}
    for doc_id, pieces in got.dropna(subset=["doc_id"]).groupby("doc_id"):
        ids = np.array([*reference.encode_ordinary(texts[doc_id]), 0], "<u4")
        pieces = pieces.sort_values("start")
        assert pieces["start"].tolist() == [0, *np.cumsum(pieces["length"])[:-1]]
        assert (pieces["doc_tokens"] == len(ids)).all() and pieces["length"].sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(pieces["start"], pieces["length"], strict=True)] == pieces["ids_crc32"].tolist()
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 1024
    assert packing.pack(empty, JSON).count() == 0


def test_special_strings_are_read_as_the_library_reads_them(spark):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|> hi", "a<|endoftext|>b<|endoftext|>", "<|endof text|>", "<|endoftext", "plain"]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON).collect()
    library = Tokenizer.from_file(JSON)
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == {i: zlib.crc32(b) for i, b in want.items()}
    assert got[0]["doc_tokens"] == 3


def test_padding_is_little(spark):
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), JSON).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()["n"]
    assert (1024 - got).sum() / got.sum() < 0.02


# --- chat ------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a [/ROLE] b"]), st.lists(st.sampled_from(["<s>", "</s>", "[INST]", " [/INST]", "[OUT]", "<<SYS>>", "<</SYS>>", "\\", "[", "<", "x", "\n", "<|image|>", "é"]), max_size=8).map("".join)), max_size=6))
def test_conversations_read_back(turns):
    whole = "".join(chat.format_turn(r, [{"kind": "text", "text": t, "ref": None, "tokens": 0}])[0] for r, t in turns)
    assert chat.read_conversation(whole) == turns


_CUT = st.lists(st.sampled_from(["<s>", "</s>", "<", "s>", "[IN", "ST]", "/", "[OUT]", "<<SYS>>", "\\", "|image|>", "<|aud", "io|>", "x", ""]), max_size=4).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.lists(st.one_of(_CUT, st.sampled_from([("image",), ("audio",), ("document",)])), max_size=6)), max_size=4))
def test_control_strings_cut_across_parts_read_back(turns):
    whole, want = "", []
    for role, given_parts in turns:
        parts = [{"kind": "text", "text": p, "ref": None, "tokens": 0} if isinstance(p, str) else {"kind": p[0], "text": None, "ref": "r", "tokens": 1} for p in given_parts]
        text, start, end, got = chat.format_turn(role, parts)
        whole += text
        merged = []
        for p in parts:
            if p["kind"] != "text":
                merged.append((p["kind"], ""))
            elif p["text"]:
                if merged and merged[-1][0] == "text":
                    merged[-1] = ("text", merged[-1][1] + p["text"])
                else:
                    merged.append(("text", p["text"]))
        assert chat.read_parts(text) == (role, merged)
        assert [(a["kind"], text[a["offset"] :].startswith(chat.PLACEHOLDERS[a["kind"]])) for a in got.attachments] == [(k, True) for k, _ in merged if k != "text"]
        want.append((role, "".join(t if k == "text" else chat.PLACEHOLDERS[k] for k, t in merged)))
    assert chat.read_conversation(whole) == want


def test_turns_are_found_by_their_marks(spark):
    turns = [("user", "a <s> b"), ("assistant", "c</s>"), ("tool", "d")]
    pieces = [chat.format_turn(r, [{"kind": "text", "text": t, "ref": None, "tokens": 0}])[0] for r, t in turns]
    rows = [(1, 0, "user", pieces[0] + pieces[1], 0, 0), (1, 1, "tool", pieces[2], 0, 0)]
    got = chat.read_back(spark.createDataFrame(rows, "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long")).first()
    assert (got["n_turns"], got["turns_sha256"]) == (3, hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
    with pytest.raises(ValueError):
        chat.read_conversation("no mark")


def test_parts_become_placeholders():
    parts = [{"kind": "text", "text": "see <|image|> ", "ref": None, "tokens": 0}, {"kind": "image", "text": None, "ref": "a.png", "tokens": 256}, {"kind": "document", "text": None, "ref": "b.pdf", "tokens": 900}]
    text, start, end, got = chat.format_turn("user", parts)
    assert chat._MARK.findall(text) == ["<|image|>", "<|document|>"] and got.tokens == 1156
    assert all(text[a["offset"] :].startswith(chat.PLACEHOLDERS[a["kind"]]) for a in got.attachments)
    assert [a["ref"] for a in got.attachments] == ["a.png", "b.pdf"] and 0 < start < end < len(text)


def test_read_back_equals_brute_force(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a [OUT] b</s>"), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "system", "s"), (3, 0, "tool", "t " * 9_000), (3, 0, "tool", "t " * 9_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(df.select("conv_id", "turn", "role", chat.as_parts("text").alias("parts")))
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    said = {}
    for c, n, r, t in rows:
        said.setdefault(c, []).append((-1 if n is None else n, r or "", chat.escape(t or ""), t or ""))
    for c, turns in said.items():
        turns.sort()
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, _, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, _, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), digest)
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r["conv_id"]: r["formatted"] for r in chat.conversations(formatted).collect()}
    assert all(len(whole[c]) == got[c]["formatted_chars"] for c in said)
    assert chat.read_back(chat.format_turns(df.limit(0).select("conv_id", "turn", "role", chat.as_parts("text").alias("parts")))).count() == 0


# --- counts ----------------------------------------------------------------


def test_ledger(spark, tmp_path, reference):
    docs = spark.createDataFrame([(1, "en", "a", "one two"), (2, "en", "a", None), (3, None, "b", "x y z"), (3, None, "b", "x y z")], "doc_id long, lang string, source string, text string")
    ledger = token_counts.Ledger(spark, f"file:{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    version = token_counts.tokenizer_version(RANKS)
    n = lambda t: len(reference.encode_ordinary(t))
    totals = lambda: {tuple(r) for r in ledger.totals().collect()}
    assert ledger.commit("b1", token_counts.inserts(docs, RANKS))
    first = {("a", "en", version, 2, n("one two")), ("b", None, version, 2, 2 * n("x y z"))}
    assert totals() == first
    assert not ledger.commit("b1", token_counts.inserts(docs, RANKS)) and totals() == first
    revised = spark.createDataFrame([("a", "en", "one two", "one two three")], "source string, lang string, old_text string, new_text string")
    ledger.commit("b2", token_counts.revisions(revised, RANKS))
    ledger.commit("b3", token_counts.deletes(docs.filter("source = 'b'"), RANKS))
    assert totals() == {("a", "en", version, 2, n("one two three"))}
    assert not ledger.commit("b1", token_counts.inserts(docs, RANKS)) and not ledger.commit("b2", token_counts.deletes(docs, RANKS))
    (tmp_path / "ledger" / "batch=dead").mkdir()
    (tmp_path / "ledger" / "totals=99").mkdir()
    assert totals() == {("a", "en", version, 2, n("one two three"))} and "dead" not in ledger.batches()
    assert ledger.commit("empty", token_counts.inserts(docs.limit(0), RANKS))
    assert ledger.batches() == ["b1", "b2", "b3", "empty"]
    # a run that died after the batch's commit and before the totals moved on
    late = token_counts._sums(token_counts.inserts(docs, RANKS)).withColumn("batch", F.lit(None).cast("string"))
    late.write.parquet(f"file:{tmp_path}/ledger/batch=late")
    after = {("a", "en", version, 4, n("one two three") + n("one two")), ("b", None, version, 2, 2 * n("x y z"))}
    assert totals() == after and not ledger.commit("late", token_counts.inserts(docs, RANKS))
    ledger.fold()
    assert totals() == after and ledger.batches() == ["b1", "b2", "b3", "empty", "late"] and not list((tmp_path / "ledger").glob("batch=*/part*"))


def test_counts_equal_the_reference_library(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in llm_queries.QUERIES["op10_token_counts"](spark, SF).collect()}
    want: dict = {}
    for r in docs.collect():
        n, t = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = n + 1, t + len(reference.encode_ordinary(r["text"] or ""))
    assert got == want
