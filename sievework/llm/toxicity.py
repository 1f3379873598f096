"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause word by word and are composed into one: insults and threats come from
a lexicon whose weights are learned from labels, targets, negations and reported speech are closed word
lists. A composed path ends with the mark of what surrounds an insult or threat (aimed, negated,
reported); its weight is learned as well. Documents are scored by the clauses that match, never by
isolated words of a bag.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .arrowtext import Texts, Words, slices, spans_of, texts_of

TARGETS = frozenset("you your yours yourself he him she her they them tu toi vous ils elles du dich dir ihr euch sie él ella usted ustedes ellos".split())
NEGATIONS = frozenset("not no never nobody isn aren wasn don doesn ne pas jamais nicht kein keine nie nunca jamás".split())
REPORTS = frozenset("said says say wrote writes quoted quote called reported dit écrit sagte schrieb dijo escribió".split())
#: Threats that the labels need not show; their weight is `SEED` until labels say more.
THREATS = frozenset("kill murder strangle stab shoot burn hurt destroy".split())
SEED = 1.0

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
_CLAUSE = np.ones(256, dtype=bool)
_CLAUSE[list(b".!?;\n")] = False


@dataclass
class Transducer:
    """step(state, symbol) gives (state, symbol out, weight); start is the first state."""

    start: object
    step: Callable[[object, str], tuple[object, str, float]]


def compose(*parts: Transducer) -> Transducer:
    """Each part reads what the part before it writes; weights add up. Steps are remembered, so a composition is a table in the end."""
    known: dict[tuple[object, str], tuple[object, str, float]] = {}

    def step(state, symbol):
        key = (state, symbol)
        if key not in known:
            out, total, states = symbol, 0.0, []
            for part, s in zip(parts, state, strict=True):
                s, out, w = part.step(s, out)
                states.append(s)
                total += w
            known[key] = (tuple(states), out, total)
        return known[key]

    return Transducer(tuple(p.start for p in parts), step)


def targets() -> Transducer:
    """After a target, a match is aimed: `+` is added to it."""

    def step(state, symbol):
        if symbol == "target":
            return True, symbol, 0.0
        return state, symbol + "+" * (symbol in ("insult", "threat") and state), 0.0

    return Transducer(False, step)


def negation(reach: int = 2) -> Transducer:
    """A negation marks a match up to `reach` words after it with `-`."""

    def step(state, symbol):
        if symbol == "not":
            return reach, symbol, 0.0
        return max(0, state - 1), symbol + "-" * (symbol.startswith(("insult", "threat")) and state > 0), 0.0

    return Transducer(0, step)


def reports() -> Transducer:
    """A report marks all matches after it in the clause with `"`."""

    def step(state, symbol):
        if symbol == "report":
            return True, symbol, 0.0
        return state, symbol + '"' * (symbol.startswith(("insult", "threat")) and state), 0.0

    return Transducer(False, step)


def marks(weights: dict[str, float]) -> Transducer:
    """Ends the composition: the weight of a match is that of its marks."""
    return Transducer(0, lambda state, symbol: (0, symbol, weights.get(symbol, 0.0)))


@dataclass
class Model:
    """words and prefixes: weights of the lexicon; paths: of marks; beta: of a document's features, the last is the constant."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    paths: dict[str, float] = field(default_factory=dict)
    beta: tuple[float, ...] = (2.0, 2.0, 0.5, -4.0)

    def __post_init__(self):
        self.grammar = compose(targets(), negation(), reports(), marks(self.paths))
        self.sizes = sorted({len(p) for p in self.prefixes})
        self.starts = np.zeros(1 << 16, dtype=bool)
        for entry in (*self.words, *self.prefixes, *THREATS):
            raw = (entry.encode() + b"\0\0\0\0")[:4]
            k = 3 if len(entry.encode()) < 4 else 4
            self.starts[_slot(np.frombuffer(raw, np.uint8)[None, :k])] = True

    def lexical(self, word: str) -> float:
        """The weight of a word as an insult or threat; 0 is neither."""
        w = self.words.get(word, SEED if word in THREATS else 0.0)
        for n in self.sizes:
            if n < len(word):
                w = max(w, self.prefixes.get(word[:n], 0.0))
        return w

    def symbol(self, word: str) -> tuple[str, float]:
        if w := self.lexical(word):
            return ("threat" if word in THREATS else "insult"), w
        return ("target" if word in TARGETS else "not" if word in NEGATIONS else "report" if word in REPORTS else "word"), 0.0

    def clause(self, words: Iterable[str]) -> list[tuple[str, float]]:
        """(marks, weight) of each match in a clause."""
        state, out = self.grammar.start, []
        for word in words:
            symbol, w = self.symbol(word)
            state, symbol, more = self.grammar.step(state, symbol)
            if w:
                out.append((symbol, w + more))
        return out


def _slot(first: np.ndarray) -> np.ndarray:
    """A slot for the first three or four bytes of words; words of three bytes use three."""
    x = np.zeros(len(first), np.uint32)
    for j in range(first.shape[1]):
        x = x * np.uint32(0x01000193) ^ first[:, j]
    return ((x ^ (x >> np.uint32(15))) & np.uint32(0xFFFF)).astype(np.int64)


def lowered(column: pa.Array) -> Texts:
    return texts_of(pc.utf8_lower(pc.fill_null(column, "")))


def features(model: Model, t: Texts) -> tuple[np.ndarray, list[list[tuple[str, float]]]]:
    """Features of each document, and its matches: how much matched in all, how dense, how strong at most."""
    w = spans_of(_LETTERS[t.buf], t)
    out = np.zeros((len(t), 4))
    out[:, 3] = 1
    matches: list[list[tuple[str, float]]] = [[] for _ in range(len(t))]
    if not len(w.start):
        return out, matches
    size = w.end - w.start
    padded = np.concatenate([t.buf, np.zeros(4, np.uint8)])
    candidate = np.zeros(len(size), dtype=bool)
    for k, own in ((3, size >= 3), (4, size >= 4)):
        i = np.flatnonzero(own)
        candidate[i] |= model.starts[_slot(padded[w.start[i][:, None] + np.arange(k)])]
    hit = [i for i in np.flatnonzero(candidate).tolist() if model.lexical(t.buf[w.start[i] : w.end[i]].tobytes().decode())]
    if not hit:
        return out, matches
    c = spans_of(_CLAUSE[t.buf], t)
    where = np.unique(np.searchsorted(c.start, w.start[hit], side="right") - 1)
    docs = np.searchsorted(c.first, where, side="right") - 1
    low, high = np.searchsorted(w.start, c.start[where]), np.searchsorted(w.start, c.end[where])
    for d, a, b in zip(docs.tolist(), low.tolist(), high.tolist(), strict=True):
        matches[d] += model.clause(t.buf[w.start[i] : w.end[i]].tobytes().decode() for i in range(a, b))
    words = np.diff(w.first)
    for d, found in enumerate(matches):
        if found:
            total = sum(max(0.0, x) for _, x in found)
            out[d, :3] = np.log1p(total), np.log1p(1000 * len(found) / max(1, words[d])), max(x for _, x in found)
    return out, matches


def learn_lexicon(texts: Texts, toxic: np.ndarray, least: int = 8, strength: float = 3.0, sizes: range = range(4, 9)) -> tuple[dict[str, float], dict[str, float]]:
    """Words and prefixes whose rate in toxic texts is e^strength times that in others, in `least` different surroundings.

    Surroundings (the words before and after) are counted instead of occurrences or documents, so that
    copies of one passage count once.
    """
    w: Words = spans_of(_LETTERS[texts.buf], texts)
    seen: tuple[dict[str, set[int]], ...] = ({}, {})
    pre: tuple[dict[str, set[int]], ...] = ({}, {})
    total = [0, 0]
    for d in range(len(texts)):
        a, b = int(w.first[d]), int(w.first[d + 1])
        words = [texts.buf[i:j].tobytes().decode() for i, j in zip(w.start[a:b], w.end[a:b], strict=True)]
        y = int(toxic[d])
        total[y] += len(words)
        for i, word in enumerate(words):
            if len(word) >= 3:
                near = zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode())
                seen[y].setdefault(word, set()).add(near)
                for n in sizes:
                    if n < len(word):
                        pre[y].setdefault(word[:n], set()).add(near)

    def strong(counts) -> dict[str, float]:
        out = {}
        for x, own in counts[1].items():
            if len(own) >= least:
                s = np.log((len(own) + 0.5) / (total[1] + 1)) - np.log((len(counts[0].get(x, ())) + 0.5) / (total[0] + 1))
                if s >= strength:
                    out[x] = float(s)
        return out

    words, prefixes = strong(seen), strong(pre)
    # a prefix that a listed word explains alone adds nothing
    prefixes = {p: s for p, s in prefixes.items() if len({x for x in seen[1] if x.startswith(p) and len(x) > len(p)}) > 2}
    return words, prefixes


def learn_paths(model: Model, matches: list[list[tuple[str, float]]], toxic: np.ndarray, prior: float = 20.0) -> dict[str, float]:
    """For each combination of marks the log of its share among matches in toxic texts over that in others, smoothed to 0."""
    counts: dict[str, list[float]] = {}
    for found, y in zip(matches, toxic.tolist(), strict=True):
        for mark, _ in found:
            counts.setdefault(mark, [0.0, 0.0])[int(y)] += 1
    all0, all1 = (sum(c[y] for c in counts.values()) for y in (0, 1))
    rate0, rate1 = all0 / max(1.0, all0 + all1), all1 / max(1.0, all0 + all1)
    out = {}
    for mark, (n, p) in sorted(counts.items()):
        a, b = (p + prior * rate1 + 0.5) / (prior * rate1 + all1 + 0.5), (n + prior * rate0 + 0.5) / (prior * rate0 + all0 + 0.5)
        share = ((p + n) + prior) / (all0 + all1 + prior)
        out[mark] = float(np.clip(np.log(a / b) if share > 0.02 else 0.0, -2, 2))
    return out


def fit_scores(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by iterated least squares."""
    beta = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - keep * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (1_200, 2_400), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The grammar's weights from labelled rows that aren't held out.

    most: so many toxic and other labelled rows at most are learned from, those of the lowest hash of
    their id; the share of toxic rows is counted over all of them. Without toxic rows only seeds count.
    """
    from .tables import small_batches

    small_batches(docs.sparkSession)
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).where(~held_out("_id"))
    share = own.agg(F.avg("_y"), F.count("_y")).first()
    if not share[1] or not share[0]:
        return Model()
    some = [own.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, most[0]), (0, most[1]))]
    some_of = some[0].unionByName(some[1]).groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).join(F.broadcast(some_of), F.col("_d") == F.col("_id")).select("_d", "_t", "_y").toArrow()
    rows = rows.sort_by([("_d", "ascending"), ("_t", "ascending")])
    y = rows.column("_y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model()
    t = lowered(rows.column("_t").combine_chunks())
    words, prefixes = learn_lexicon(t, y)
    model = Model(words, prefixes)
    model = Model(words, prefixes, learn_paths(model, features(model, t)[1], y))
    x, _ = features(model, t)
    weight = np.where(y == 1, share[0] / y.mean(), (1 - share[0]) / (1 - y.mean()))
    return Model(words, prefixes, model.paths, fit_scores(x, y, weight))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and n_matches of every row.

    A null or empty text scores as a text without a match does; a null id is not held out; repeated rows
    score alike; an empty table gives none. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    lexicon = (model.words, model.prefixes, model.paths, model.beta)

    def scan(batches):
        own = Model(*lexicon)
        for whole in batches:
            for b in slices(whole):
                x, matches = features(own, lowered(b.column(2)))
                score = 1 / (1 + np.exp(-np.clip(x @ np.array(own.beta), -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= limit).astype(np.int32)), pa.array([len(m) for m in matches], pa.int64())], names=["doc_id", "held_out", "score", "predicted", "n_matches"])

    schema = StructType([rows.schema[0], StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("n_matches", LongType())])
    return rows.mapInArrow(scan, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
