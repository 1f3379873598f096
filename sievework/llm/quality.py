"""Quality rules under weak supervision.

Rules vote good, bad or abstain on each document. Expectation-maximisation over the counts of vote
patterns estimates how each rule votes on good and on bad documents, and the posterior probability
of "good" decides. A pattern table holds all there is to know of the corpus for this, and its size is
bounded by 3^rules at any number of documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrowtext import Texts, covered, hashes, inside, lines_of, mix, slices, sums, texts_of, windows, words_of

_U = np.uint64
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_SPELT = _LETTER.copy()
_SPELT[0x80:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[list(b"!?")] = True

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_marked", "n_bare", "n_upper", "n_letters", "n_ends", "n_bangs", "n_distinct_words", "n_lines"]


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether another element of the same document has the same hash."""
    key = mix(h + doc.astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.zeros(len(k), dtype=bool)
    out[order] = same[:-1] | same[1:]
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each of n documents."""
    key = mix(h + doc.astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    first = np.ones(len(k), dtype=bool)
    first[1:] = k[1:] != k[:-1]
    return np.bincount(doc[order[first]], minlength=n)


def statistics(t: Texts) -> dict[str, np.ndarray]:
    """BASE and MORE of each document."""
    w = words_of(t)
    n, h, doc = len(t), hashes(t, w), w.doc()
    chars = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
    line = lines_of(t)
    has = np.searchsorted(w.start, line.end) > np.searchsorted(w.start, line.start)
    line_doc = line.doc()[has]
    line_hash = hashes(t, line)[has]
    g = windows(h, 3)
    twice = np.zeros(len(h), dtype=bool)
    if len(g):
        ok = np.flatnonzero(inside(w, 3))
        twice = covered(ok[_repeated(doc[ok], g[ok])], 3, len(h))
    count = lambda mask: sums(mask[t.buf], t.offsets)
    within = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[t.buf])])[np.stack([w.start, w.end])], axis=0)[0]
    return {
        "n_words": w.counts(),
        "word_chars": sums(chars[w.end] - chars[w.start], w.first),
        "n_symbols": count(_SYMBOL),
        "n_dup_lines": np.bincount(line_doc, minlength=n) - _distinct(line_doc, line_hash, n),
        "n_repeat_words": sums(twice, w.first),
        "n_marked": sums((within(_SYMBOL) > 0) & (within(_SPELT) > 0), w.first),
        "n_bare": sums(within(_SPELT) == 0, w.first),
        "n_upper": count(_UPPER),
        "n_letters": count(_LETTER),
        "n_ends": count(_STOP),
        "n_bangs": count(_BANG),
        "n_distinct_words": _distinct(doc, h, n),
        "n_lines": np.bincount(line_doc, minlength=n),
    }


@dataclass(frozen=True)
class Rule:
    """A ratio votes good up to `good` and bad from `bad` on; between them, and where its base is 0, it abstains. good > bad: the other way round."""

    name: str
    over: str
    under: str
    good: float
    bad: float

    def votes(self, s: dict[str, np.ndarray]) -> np.ndarray:
        """1 good, 2 bad, 0 abstains."""
        base = np.maximum(s[self.under], 1)
        x = np.where(s[self.under] > 0, s[self.over] / base, np.nan)
        if self.good < self.bad:
            return np.where(x <= self.good, 1, np.where(x >= self.bad, 2, 0))
        return np.where(x >= self.good, 1, np.where(x <= self.bad, 2, 0))


#: Rules overlap on purpose: symbols in words, in place of words, and long words are signs of the same junk, and
#: from their agreement EM learns which rules can be trusted. Limits are those of weak rules: each errs alone.
RULES = (
    Rule("marked words", "n_marked", "n_words", 0.02, 0.2),
    Rule("words without letters", "n_bare", "n_words", 0.1, 0.3),
    Rule("symbols", "n_symbols", "word_chars", 0.01, 0.05),
    Rule("capitals", "n_upper", "n_letters", 0.03, 0.05),
    Rule("shouting", "n_bangs", "n_words", 0.05, 0.3),
    Rule("repeated words", "n_repeat_words", "n_words", 0.05, 0.2),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.05, 0.15),
    Rule("long words", "word_chars", "n_words", 6.5, 7.5),
    Rule("short words", "word_chars", "n_words", 4.5, 4.2),
    Rule("sentences", "n_ends", "n_words", 0.05, 0.04),
    Rule("variety", "n_distinct_words", "n_words", 0.7, 0.6),
)

#: First guess of "good" where no rule objects, one does, more do.
FIRST = (0.95, 0.5, 0.05)


def patterns(s: dict[str, np.ndarray], rules: tuple[Rule, ...]) -> np.ndarray:
    """Votes as one number, a base-3 digit for each rule."""
    out = np.zeros(len(s["n_words"]), np.int64)
    for r in rules:
        out = out * 3 + r.votes(s)
    return out


@dataclass(frozen=True)
class Fit:
    """posterior: of "good", for each pattern. good, bad: for each rule, the probabilities that it abstains, votes good, votes bad on such documents."""

    posterior: dict[int, float]
    prior: float
    good: np.ndarray
    bad: np.ndarray

    def accuracies(self, rules: tuple[Rule, ...]) -> dict[str, float]:
        """How often each rule is right where it votes, by the estimate."""
        right = self.prior * self.good[:, 1] + (1 - self.prior) * self.bad[:, 2]
        votes = self.prior * self.good[:, 1:].sum(1) + (1 - self.prior) * self.bad[:, 1:].sum(1)
        return {r.name: float(x) for r, x in zip(rules, right / votes, strict=True)}


def fit(counts: dict[int, int], rules: int, rounds: int = 100) -> Fit:
    """Expectation-maximisation over the documents that are in question: counts may be 0 for patterns of others, which get a posterior too.

    A rule has three outcomes (abstains, good, bad) with probabilities of their own on good and on bad
    documents. It starts from how many rules object (FIRST). How often a rule is mistaken is learned, from
    how the others vote on what it objects to: one that the others contradict gets little weight. A rule
    may not object more often to good documents than to bad ones, so that the classes keep their names.
    Patterns are taken in order: the result doesn't depend on how the table was gathered.
    """
    keys = sorted(counts)
    if not keys:
        return Fit({}, 0.5, np.full((rules, 3), 1 / 3), np.full((rules, 3), 1 / 3))
    n = np.array([counts[k] for k in keys], float)
    digits = np.array([[k // 3 ** (rules - 1 - j) % 3 for j in range(rules)] for k in keys])
    votes = np.stack([digits == v for v in range(3)], 2).astype(float)
    p = np.array(FIRST)[np.minimum((digits == 2).sum(1), 2)]
    every = (n @ votes.reshape(len(keys), -1) + 1e-9).reshape(rules, 3) / (n.sum() + 3e-9)
    for _ in range(rounds):
        a, b = n * p, n * (1 - p)
        # smoothed by two documents that vote as the whole corpus does
        good = ((a @ votes.reshape(len(keys), -1)).reshape(rules, 3) + 2 * every + 1e-3) / (a.sum() + 2 + 3e-3)
        bad = ((b @ votes.reshape(len(keys), -1)).reshape(rules, 3) + 2 * every + 1e-3) / (b.sum() + 2 + 3e-3)
        wrong = good[:, 2] > bad[:, 2]
        good[wrong] = bad[wrong] = every[wrong] + 1e-9
        prior = float(np.clip((a.sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        odds = math.log(prior / (1 - prior)) + np.einsum("krv,rv->k", votes, np.log(good / bad))
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return Fit(dict(zip(keys, p.tolist(), strict=True)), prior, good, bad)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, BASE, MORE and pattern of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [*BASE, *MORE, "pattern"]

    def scan(batches):
        for whole in batches:
            for b in slices(whole):
                s = statistics(texts_of(b.column(1)))
                s["pattern"] = patterns(s, rules)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[n], pa.int64()) for n in names)], names=["doc_id", *names])

    return rows.mapInArrow(scan, StructType([rows.schema[0], *(StructField(n, LongType()) for n in names)]))


def fitted(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> Fit:
    """From (pattern, passes) of all documents. Those that fail the base limits go whatever the rules say, so the two classes are those of the others."""
    counts = {r["pattern"]: r["n"] for r in measures.groupBy("pattern").agg(F.sum(F.col("passes").cast("long")).alias("n")).collect()}
    return fit(counts, len(rules))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """doc_id, BASE, MORE, base_failed, p_good and kept of every row.

    kept: not base_failed, and the posterior is `least` or more. A null text has no words and fails the
    base, as does an empty one; texts of any length are measured whole; repeated rows count and are judged
    each; documents of equal votes share a verdict; an empty table gives none. Other columns are not read.
    """
    from .tables import written

    m = written(measured(docs, id_col, text_col, rules), "quality")
    table = docs.sparkSession.createDataFrame(sorted(fitted(m.select("pattern", (~base_failed()).alias("passes")), rules).posterior.items()), "_pattern long, p_good double")
    out = m.join(F.broadcast(table), F.col("pattern") == F.col("_pattern")).withColumn("base_failed", base_failed())
    return out.select("doc_id", *BASE, *MORE, "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= least)).alias("kept"))


def kept_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """The rows of docs that judged() keeps, with its treatment of nulls, empty, long and repeated texts; an empty table stays empty.

    Texts are measured for the counts of votes, and again where they are judged: that costs less than a
    second copy of all texts on disk. Columns of docs keep their names and values.
    """
    at = docs.columns.index(text_col)
    votes = measured(docs.select(F.lit(0).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), rules=rules)
    known = fitted(votes.select("pattern", (~base_failed()).alias("passes")), rules).posterior

    def scan(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                s = statistics(texts_of(b.column(at)))
                p = np.array([known.get(k, 0.0) for k in patterns(s, rules).tolist()])
                yield b.filter(pa.array((p >= least) & (s["n_words"] >= 50) & (100 * s["n_repeat_words"] <= 50 * s["n_words"])))

    return docs.mapInArrow(scan, docs.schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return judged(table(spark, sf_dir, "documents")).drop(*MORE)
