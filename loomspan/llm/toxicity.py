"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed lexicon and of one learned from labelled text, proximity to the second person, capitals,
punctuation and obfuscation rates. Labelled documents train it; they are a bounded sample (``max_train``), split by hash into
five parts: each part is described by a lexicon learned without it and calibrates on trees grown without it. Labels, language, source and id are
never features. Every whole text is scored.

Defined results: null and empty texts get the score of a text without words; documents without labels are scored alike;
several labels of one document count as toxic if any is; with no usable labels every score is 0; repeated rows are scored each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, isotonic
from .common import cut, releasing, texts_in

# Common insults, and second-person words, in English, German, French and Spanish.
INSULTS = frozenset(
    "arsehole ass asshole bastard bitch clown creep cretin crap degenerate disgusting dumb dumbass fool freak garbage hate hag "
    "idiot idiotic imbecile jerk kill liar loser lunatic maggot miserable moron moronic nasty parasite pathetic pig psycho rat "
    "retard rubbish scum scumbag shit shut skank slut stupid sucker trash ugly useless vermin vile weasel whore worthless "
    "abschaum arschloch blödmann dreck dumm dummkopf hurensohn idioten schlampe schwein trottel versager wertlos "
    "connard crétin dégueulasse imbécile merde minable nul ordure pourri salaud salope stupide "
    "asqueroso basura cabrón estúpido gilipollas imbécil inútil mierda perdedor puta tonto".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros os vuestro".split()
)
_LEET = str.maketrans("013457@$!|", "oieastasil")
_PUNCT = ".,;:!?\"'()[]{}<>*#%&$~_-|/\\«»“”‘’…¡¿"
_FLAGS = 8
_STRETCHED = re.compile(r"([^\W\d_])\1\1").search
_STEMS = (4, 5)  # lengths of the word beginnings the learned lexicon may hold, marked by an asterisk


class Tokens(dict):
    """Raw token to row of a feature table: insult, lexicon weight, second person, capitals, obfuscated, stretched, marks,
    stem weight. New tokens wait in a list and enter the table once per chunk of texts."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.rows: list[tuple] = []
        self.table = np.empty((0, _FLAGS), np.float32)

    def __missing__(self, token: str) -> int:
        core = token.strip(_PUNCT)
        word = core.lower()
        if word.isalpha():
            plain, mixed, marks = word, False, len(token) - len(core)
        else:
            plain = word.translate(_LEET)
            mixed = any(c.isdigit() or c in "@$!*|" for c in core) and any(c.isalpha() for c in core)
            marks = sum(c in _PUNCT for c in token)
        lexicon = self.lexicon
        weight = lexicon.get(word, 0.0) or lexicon.get(plain, 0.0)
        stem = max(lexicon.get(plain[: _STEMS[0]] + "*", 0.0), lexicon.get(plain[: _STEMS[1]] + "*", 0.0))
        stretched = _STRETCHED(word) is not None
        self.rows.append((plain in INSULTS, weight, word in SECOND_PERSON, len(core) > 1 and core.isupper(), mixed, stretched, marks, stem))
        index = self[token] = len(self)
        return index

    def of(self, tokens: list[str]) -> np.ndarray:
        """Feature rows of many tokens."""
        if len(self) > 150_000:
            self.clear()
            self.table = np.empty((0, _FLAGS), np.float32)
        index = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows, np.float32)])
            self.rows = []
        return self.table[index]


FEATURES = 20
_CHUNK_CHARS = 1 << 20


def _chunk_features(texts: list[str], tokens: Tokens) -> np.ndarray:
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    out = np.zeros((len(texts), FEATURES))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = [w for ws in split for w in ws]
    t = tokens.of(flat)
    starts = (np.cumsum(sizes) - sizes)[full]
    n = sizes[full].astype(float)
    flags = t.copy()
    flags[:, 1] = t[:, 1] > 0
    flags[:, 7] = t[:, 7] > 0
    sums = np.add.reduceat(flags, starts, axis=0, dtype=np.float64)
    weight, stem = (np.add.reduceat(t[:, k], starts, dtype=np.float64) for k in (1, 7))
    top_w, top_s = (np.maximum.reduceat(t[:, k], starts) for k in (1, 7))
    hits = (t[:, 0] > 0) | (t[:, 1] > 0) | (t[:, 7] > 0)
    found = np.add.reduceat(hits, starts, dtype=np.int64)
    near, distinct = np.zeros(len(full)), np.zeros(len(full))
    for i in np.flatnonzero(found).tolist():
        a, b = int(starts[i]), int(starts[i] + n[i])
        at = np.flatnonzero(hits[a:b])
        distinct[i] = len({flat[a + k].strip(_PUNCT).lower() for k in at.tolist()})
        second = np.flatnonzero(t[a:b, 2])
        if len(second):
            k = np.searchsorted(second, at)
            left = np.abs(at - second[np.maximum(k - 1, 0)])
            right = np.abs(second[np.minimum(k, len(second) - 1)] - at)
            near[i] = (np.minimum(left, right) <= 4).sum()
    shouts = np.array([texts[i].count("!") for i in full.tolist()], float)
    out[full] = np.stack(
        [
            np.log1p(n), sums[:, 0], sums[:, 0] / n * 100, sums[:, 1], sums[:, 1] / n * 100, weight, top_w, distinct / n * 100, near, near / n * 100,
            sums[:, 3] / n * 100, sums[:, 6] / n, shouts / n, sums[:, 4] / n * 100, sums[:, 5] / n * 100,
            sums[:, 7], sums[:, 7] / n * 100, stem, stem / n * 100, top_s,
        ],
        1,
    )
    return out


def features(texts: Iterable[str | None], tokens: Tokens) -> np.ndarray:
    """Dense features of whole texts, one row each, computed in chunks of about ``_CHUNK_CHARS``."""
    parts, chunk, chars = [np.empty((0, FEATURES))], [], 0
    for text in texts:
        chunk.append(text or "")
        chars += len(chunk[-1])
        if chars > _CHUNK_CHARS:
            parts.append(_chunk_features(chunk, tokens))
            chunk, chars = [], 0
    if chunk:
        parts.append(_chunk_features(chunk, tokens))
    return np.concatenate(parts)


def _featured(lexicons: list[dict[str, float]]):
    """(text, toxic, part) to (features, toxic, part); a row is described by its part's lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [Tokens(lexicon) for lexicon in lexicons]
        for batch in batches:
            part = batch.column(2).to_numpy()
            for p in np.unique(part).tolist():
                own = batch.filter(pa.array(part == p))
                x = features(texts_in(own.column(0)), tokens[p])
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), own.column(1), own.column(2)], ["x", "toxic", "part"])

    return run


def _odds(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float, most: int) -> np.ndarray:
    """Smoothed log odds of document frequencies where they surely speak for toxicity (the ``most`` surest), else 0."""
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    sure = odds / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    fit = (odds > 1) & (sure > 2.5) & (bad >= max(2.0, 0.01 * n_bad))
    fit[np.argsort(-np.where(fit, sure, -np.inf), kind="stable")[most:]] = False
    return np.where(fit, odds, 0.0)


def _learn_lexicons(sample: DataFrame, parts: int, most: int) -> list[dict[str, float]]:
    """Words and word beginnings that mark toxic texts: for each part those learned without it, then those of the whole."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}0-9@$]+", " "), " "), lambda w: F.length(w) > 1))
    stems = [F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))) for k in _STEMS]  # noqa: B023
    once = sample.dropDuplicates(["h"])
    sums = [F.sum(F.when((F.col("part") == p) & (F.col("toxic") == t), 1).otherwise(0)).alias(f"n{t}_{p}") for p in range(parts) for t in (0, 1)]
    size = once.agg(*sums).first()
    bad_all = sum(F.col(f"n1_{p}") for p in range(parts))
    good_all = sum(F.col(f"n0_{p}") for p in range(parts))
    totals = {t: np.array([float(size[f"n{t}_{p}"] or 0) for p in range(parts)]) for t in (0, 1)}
    n_bad, n_good = totals[1].sum(), totals[0].sum()
    odds = F.log((bad_all + 0.5) / (n_bad + 1)) - F.log((good_all + 0.5) / (n_good + 1))
    rows = (
        once.select("toxic", "part", F.explode(F.concat(words, *stems)).alias("word")).groupBy("word").agg(*sums)
        .filter((bad_all >= max(2.0, 0.01 * n_bad)) & (odds > 0.7)).orderBy(F.desc(odds / F.sqrt(1 / (bad_all + 0.5) + 1 / (good_all + 0.5))), "word").limit(2 * most).collect()
    )
    names = [r["word"] for r in rows]
    bad = np.array([[r[f"n1_{p}"] for p in range(parts)] for r in rows], float).reshape(-1, parts)
    good = np.array([[r[f"n0_{p}"] for p in range(parts)] for r in rows], float).reshape(-1, parts)
    out = []
    for p in [*range(parts), None]:
        used = np.arange(parts) != p if p is not None else np.ones(parts, bool)
        w = _odds(bad[:, used].sum(1), good[:, used].sum(1), totals[1][used].sum(), totals[0][used].sum(), most)
        out.append({n: float(v) for n, v in zip(names, w) if v > 0})
    return out


class ToxicityModel:
    """What training leaves: the lexicon, the trees and the calibration knots."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.zeros(len(x))
        raw = self.trees.raw(x)
        even = np.interp(raw, *self.knots) if self.knots is not None and len(self.knots[0]) else raw
        return np.clip(0.995 * even + 0.005 * raw, 0, 1)  # the raw share only parts ties


def train_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, max_train: int = 24_000) -> ToxicityModel:
    """Fit on at most about ``max_train`` labelled documents whose fold is not ``held_out`` (crc32 of the id, mod ``folds``)."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    known = (
        labels.filter("doc_id is not null and toxic is not null").filter(fold != held_out)
        .groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    n = known.count()
    if not n:
        return ToxicityModel({}, None, None)
    pick = F.pmod(F.xxhash64(F.lit(5), "l_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_train / n))
    parts = 5
    sample = cut(
        docs.select("doc_id", "text").join(F.broadcast(known.filter(pick)), F.col("doc_id").cast("long") == F.col("l_id"))
        .select(F.coalesce("text", F.lit("")).alias("text"), "toxic").withColumn("h", F.xxhash64("text")).withColumn("part", F.pmod(F.xxhash64(F.lit(9), "h"), F.lit(parts)).cast("int")),
        "tox-sample",
    )
    lexicons = _learn_lexicons(sample, parts, most=2000)
    rows = sample.select("text", "toxic", "part").mapInArrow(releasing(_featured(lexicons)), "x array<double>, toxic int, part int").collect()
    if not rows:
        return ToxicityModel(lexicons[-1], None, None)
    rows.sort(key=lambda r: (r["part"], r["toxic"], r["x"]))
    x, y, part = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows]), np.array([r["part"] for r in rows])
    make = lambda: BoostedTrees(trees=60, depth=3, rate=0.15, least=min(5.0, max(0.5, 0.002 * len(y))))
    apart = np.zeros(len(y))
    for p in range(parts):
        own = part == p
        if own.any() and not own.all():
            apart[own] = make().fit(x[~own], y[~own]).raw(x[own])
    trees = make().fit(x, y)
    return ToxicityModel(lexicons[-1], trees, isotonic(apart, y) if len(set(part.tolist())) > 1 else None)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` columns it keeps: doc_id; adds score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model.lexicon)
        for batch in batches:
            s = model.scores(features(texts_in(batch.column(1)), tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(run), "doc_id long, score double, predicted int")


def reject_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents scored at or above the threshold, all columns kept."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model.lexicon)
        for batch in batches:
            x = features(texts_in(batch.column(at)), tokens)
            yield batch.filter(pa.array(model.scores(x) < threshold))

    return docs.mapInArrow(releasing(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = score_toxicity(docs, train_toxicity(docs, labels), threshold)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
