"""Operator 1: toxicity by a weighted lexicon.

Texts are folded (lower case, compatibility forms, look-alike letters, invisible characters, digits and signs that
stand for letters) and matched in one pass of an Aho-Corasick automaton.  An entry matches at the start of a word, or a
whole word where it ends in a space.  Matches inside an exception phrase do not count.  The weights' sum, that sum
normalised by length, the number of distinct entries and the heaviest entry go through a logistic function.

Entries are a fixed seed list and at most ``LEARNED`` word beginnings learned from a bounded sample of labelled rows, the
heaviest first; the weights are the log odds of the entry in toxic against other documents of that sample.  With no usable
labels the seed weights and a fixed logistic function hold.

Defined cases: null and empty texts match nothing and get the score of a text without matches.  Each row is scored, rows
that repeat alike; a null doc_id is not held out.  Columns beside doc_id and text are not read, whatever their names.  An
empty table gives no rows.  Time is linear in a text's length, however many matches and exceptions it has.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_text, release, remove, scratch, written
from .labelled import SAMPLE_ROWS, logistic, sample, sigmoid

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Seed entries and the weight they start with.
SEED_WEIGHT = 3.0
#: Beginnings of words.
SEED_BEGINNINGS = (
    "asshole bastard bitch bullshit cretin cunt degenerate despicable dickhead disgusting douchebag dumbass "
    "faggot fuck hideous idiot imbecile loser lowlife moron motherfucker nigger pathetic pervert retard "
    "scumbag shit stupid vermin whore worthless "
    "abschaum arschloch dummkopf hurensohn missgeburt schlampe vollidiot wichser "
    "abruti bouffon connard connasse crétin débile enculé ordure pourriture salope "
    "basura cabrón escoria estúpido gilipollas imbécil mierda pendejo zorra"
).split()
#: Whole words: other words begin alike.
SEED_WORDS = "clown clowns crap crappy douche douches dumb dumber fag fags filth filthy freak freaks jerk jerks pig pigs prick pricks scum slut sluts trash trashy twat twats ugly".split()
SEED = [*SEED_BEGINNINGS, *(w + " " for w in SEED_WORDS)]
EXCEPTIONS = ("class clown", "circus clown", "clown fish", "clownfish", "idiot proof", "trash can", "trash bin", "trash collection", "guinea pig", "pig iron", "dumbbell", "dumb terminal", "scrap", "shitake", "scunthorpe", "jerk chicken", "jerk seasoning", "ugly duckling", "loser bracket", "retardant")

#: Look-alike letters of other scripts, folded after lower case.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "г": "r", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "σ": "o", "ς": "s",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ѡ": "w", "ʏ": "y", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴏ": "o", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

_TABLE = str.maketrans(LOOKALIKES | dict.fromkeys(INVISIBLE))
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_ODD = re.compile(r"[^\x00-\u024f]")
#: A word with digits or signs in it; at its end ! and | are punctuation.
_MIXED = re.compile(r"(?<![^\W_])(?<![@$!|€])(?=[^\W\d_]*+[\d@$!|€])(?:[!|]*(?:[^\W_]|[@$€]))+")
_LETTER = re.compile(r"[^\W\d_]")
_SPELT = re.compile(r"(?<!\w)[^\W\d_](?:[ .*_-][^\W\d_](?!\w)){3,}")
_APART = re.compile(r"[^\w]+|_+")
_WORD = re.compile(r"[^\W_]+")


class _Bare(dict):
    """Code points without accents; those that would become none or several stay, so that positions hold."""

    def __missing__(self, c: int) -> str:
        bare = [x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x)]
        self[c] = bare[0] if len(bare) == 1 else chr(c)
        return self[c]


_BARE = _Bare()


def _unmasked(text: str) -> str:
    """Lower case, without look-alikes, invisible characters and letters set apart."""
    text = text.lower()
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", text).lower().translate(_TABLE)
    elif "\u00ad" in text:
        text = text.replace("\u00ad", "")
    return _SPELT.sub(lambda m: m[0][::2], text)


def _undisguised(text: str) -> str:
    """Digits and signs of each word that has letters too are read as letters; the length stays."""
    return _MIXED.sub(lambda m: m[0].translate(_SUBSTITUTE) if _LETTER.search(m[0]) else m[0], text)


def _spaced(text: str) -> str:
    return " " + _APART.sub(" ", text).strip() + " "


def fold(text: str) -> str:
    """Words of letters and digits, each after one space, with a space at the end."""
    return _spaced(_undisguised(_unmasked(text)))


def plain(folded: str) -> str:
    """The folded text without accents, each character at its place."""
    return folded.translate(_BARE)


class Lexicon:
    """(entry, weight) pairs and exception phrases in one automaton."""

    def __init__(self, entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton, self.size = ahocorasick.Automaton(), len(entries)
        patterns: dict[str, list] = {}
        for n, (entry, weight) in enumerate(entries):
            patterns.setdefault(" " + entry, [n, weight, False])
        for phrase in exceptions:
            patterns.setdefault(" " + fold(phrase).strip(), [-1, 0.0, True])[2] = True
        for pattern, (n, weight, excepted) in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), n, weight, excepted))
        self.automaton.make_automaton()

    @staticmethod
    def _outside(best: dict, spans: list[tuple[int, int]]) -> dict:
        """The matches inside no span: a span that starts no later reaches as far as the furthest one does."""
        out, at, furthest = {}, 0, -1
        for start in sorted(best):
            while at < len(spans) and spans[at][0] <= start:
                furthest = max(furthest, spans[at][1])
                at += 1
            if best[start][0] > furthest:
                out[start] = best[start]
        return out

    def hits(self, folded: str) -> list[tuple[int, int, int, float]]:
        """(start, end, entry, weight) of each counted match: at one place the longest, none inside an exception."""
        best: dict[int, tuple[int, int, float]] = {}
        excepted: dict[int, int] = {}
        for end, (length, n, weight, exception) in self.automaton.iter(folded):
            start = end - length + 1
            if exception:
                excepted[start] = end  # of one start the longest comes last
            if n >= 0:
                best[start] = (end, n, weight)
        if excepted and best:
            best = self._outside(best, sorted(excepted.items()))
        return [(s, *v) for s, v in best.items()]


@lru_cache(maxsize=4)
def _lexicon(entries: tuple[tuple[str, float], ...]) -> Lexicon:
    return Lexicon(entries)


def _found(folded: str, lexicon: Lexicon) -> list[tuple[int, int, int, float]]:
    found = lexicon.hits(folded)
    if not folded.isascii():
        at = {s for s, *_ in found}
        found += [h for h in lexicon.hits(plain(folded)) if h[0] not in at]
    return found


def _only_raw(raw: str, read: str, lexicon: Lexicon) -> list[tuple[int, int, int, float]]:
    """Matches in the text as it stands at words that start inside a word of the text as read."""
    found = _found(_spaced(raw), lexicon)
    if not found:
        return []
    starts, at, place = {m.start() for m in _WORD.finditer(read)}, {}, 0
    for m in _WORD.finditer(raw):
        at[place] = m.start()
        place += len(m[0]) + 1
    return [h for h in found if at[h[0]] not in starts]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """log of the weights' sum, the sum a hundred words, distinct entries, the heaviest entry."""
    raw = _unmasked(text)
    read = _undisguised(raw)
    folded = _spaced(read)
    found = _found(folded, lexicon)
    if read != raw:
        found += _only_raw(raw, read, lexicon)
    if not found:
        return [0.0, 0.0, 0.0, 0.0]
    total, words = sum(h[3] for h in found), folded.count(" ") - 1
    return [float(np.log1p(max(total, 0.0))), min(100.0 * total / max(words, 20), 50.0), float(np.log1p(len({h[2] for h in found}))), max(h[3] for h in found)]


#: Word beginnings that are learned at most.
LEARNED = 400


def learn_entries(rows: DataFrame, most: int = LEARNED, least_docs: int = 4, least_weight: float = 2.0) -> tuple[tuple[str, float], ...]:
    """Seed entries with learned weights, and learned word beginnings of 5 to 12 letters.

    Document counts of beginnings are summed in Spark; at most ``20 * most`` and the seeds come back.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("begins", pa.list_(pa.string()))])

    def begins(ids: list, texts: list[str]) -> list:
        out = []
        for text in texts:
            raw = _unmasked(text)
            words = {*_spaced(raw).split(), *_spaced(_undisguised(raw)).split()}
            out.append(sorted({w[:n] for w in words if w.isalpha() for n in range(5, min(len(w), 12) + 1)}))
        return [ids, out]

    counts = rows.groupBy("label").count().collect()
    by = {r["label"]: r["count"] for r in counts}
    if min(by.get(0, 0), by.get(1, 0)) < 5:
        return tuple((w, SEED_WEIGHT) for w in SEED)
    found = map_text(rows, begins, "doc_id long, begins array<string>", arrow).join(F.broadcast(rows.select("doc_id", "label").distinct()), "doc_id")
    odds = F.log((F.col("bad") + 0.3) / (by[1] + 1)) - F.log((F.col("good") + 0.3) / (by[0] + 1))
    grouped = (
        found.select("label", F.explode("begins").alias("entry"))
        .groupBy("entry")
        .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        .withColumn("weight", odds)
    )
    seed = F.col("entry").isin(SEED)
    strong = (F.col("bad") >= least_docs) & (F.col("weight") >= least_weight)
    chosen = grouped.filter(seed | strong).withColumns({"seed": seed, "strong": strong})
    got = chosen.orderBy(F.desc("seed"), (F.col("weight") * F.sqrt("bad")).desc(), "entry").limit(20 * most + len(SEED)).collect()
    seeds = {r["entry"]: r["weight"] for r in got if r["seed"]}
    entries = {w: max(seeds.get(w, SEED_WEIGHT), 0.5) for w in SEED}
    best = {r["entry"]: (r["weight"], r["bad"]) for r in got if r["strong"]}
    for entry in sorted(best, key=lambda e: (len(e), e)):
        shorter = [entry[:n] for n in range(5, len(entry)) if entry[:n] in entries]
        if any(entries[s] >= best[entry][0] - 0.7 for s in shorter):
            continue
        if any(seed.startswith(entry) or entry.startswith(seed) for seed in SEED):
            continue
        if entry not in entries and len(entries) < most + len(SEED):
            entries[entry] = best[entry][0]
    return tuple(sorted((e, round(float(w), 4)) for e, w in entries.items()))


class Model:
    def __init__(self, entries: tuple[tuple[str, float], ...], weights: list[float]):
        self.entries, self.weights = entries, weights

    def json(self) -> str:
        return json.dumps({"entries": self.entries, "weights": self.weights})

    def scores(self, texts: list[str]) -> np.ndarray:
        lexicon = _lexicon(self.entries)
        x = np.array([features(t, lexicon) for t in texts], float).reshape(-1, 4)
        w = np.asarray(self.weights)
        return sigmoid(x @ w[:-1] + w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and logistic weights from at most ``rows`` labelled documents."""
    spark = docs.sparkSession
    chosen = written(sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows), path := scratch(spark, "toxic-sample"))
    try:
        entries = learn_entries(chosen)
        arrow = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
        measured = map_text(chosen, lambda ids, texts: [ids, [features(t, _lexicon(entries)) for t in texts]], "doc_id long, x array<double>", arrow)
        got = measured.join(F.broadcast(chosen.select("doc_id", "label").distinct()), "doc_id").orderBy("doc_id").collect()
    finally:
        remove(spark, path)
    y = np.array([r["label"] for r in got], float)
    if len(y) == 0 or min(y.sum(), (1 - y).sum()) < 5:
        return Model(entries, [1.0, 0.2, 0.5, 0.3, -3.0])
    x = np.array([list(r["x"]) for r in got], float)
    return Model(entries, [round(float(v), 6) for v in logistic(x, y)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    out = map_text(docs, lambda ids, texts: [ids, model.scores(texts)], "doc_id long, score double", arrow)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_column(model):
    """The score as a function of a text column, for filters that keep all other columns where they are."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = model.scores([t or "" for t in texts])
        release()
        return pd.Series(out, index=texts.index, dtype=float)

    return scored
