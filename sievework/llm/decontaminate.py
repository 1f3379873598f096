"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

Training texts stream through the automaton as hashed words; where the longest match that ends at a
word has 13 words or more, or ends a whole shorter item, the words under it are hit. Runs of words
none of whose short grams stands in an item reset the automaton without being walked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .arrowtext import ALNUM_WORDS, LOWER, Texts, Words, covered, hashes, inside, slices, sums, texts_of, windows, words_of
from .automaton import SuffixAutomaton

WINDOW = 13
#: Words of test items in one automaton; more items are cut into shards, each broadcast alone.
SHARD_WORDS = 400_000
#: Bytes of text for which the automata of several shards are built once.
TOGETHER = 32 << 20
#: Words of all items together, of 8 bytes each, that are sent to every executor; larger benchmarks are refused.
MOST_ITEM_WORDS = 16_000_000


def normal_words(t: Texts) -> tuple[Texts, Words, np.ndarray]:
    t = Texts(LOWER[t.buf], t.offsets)
    w = words_of(t, ALNUM_WORDS)
    return t, w, hashes(t, w)


class Matcher:
    """The automaton of some items, each a list of word hashes."""

    def __init__(self, items: list[tuple[int, list[int] | np.ndarray]], window: int = WINDOW):
        items = [(i, list(map(int, words))) for i, words in items if len(words)]
        self.window = window
        self.least = min([window, *(len(words) for _, words in items)])
        self.gram = max(1, min(4, self.least))
        self.sam = sam = SuffixAutomaton()
        ends: list[tuple[int, int]] = []
        short: dict[tuple[int, ...], list[int]] = {}
        for i, words in items:
            ends += [(v, i) for v in sam.insert(words)]
            if len(words) < window:
                short.setdefault(tuple(words), []).append(i)
        self.cut = sam.cut(window)
        self.owners = sam.owners(ends, window)
        marks: dict[int, list[tuple[int, list[int]]]] = {}
        for words, own in short.items():
            v = 0
            for w in words:
                v = sam.next[v][w]
            marks.setdefault(v, []).append((len(words), own))
        self.marks = marks
        self.up = [-1] * len(sam.link)
        for v in reversed(sam.by_length()):
            self.up[v] = v if v in marks else self.up[sam.link[v]]
        grams: set[int] = set()
        for _, words in items:
            grams.update(windows(np.array(words, np.uint64), self.gram).tolist())
        self.bits = np.zeros(1 << 22, dtype=bool)
        if grams:
            self.bits[np.fromiter(grams, np.uint64, len(grams)) & np.uint64(len(self.bits) - 1)] = True

    def candidates(self, w: Words, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, first word, word after the last) of runs in which every gram may stand in an item."""
        k = self.gram
        g = windows(h, k)
        if not len(g):
            return
        known = np.zeros(len(h) + 1, dtype=bool)
        known[: len(g)] = self.bits[g & np.uint64(len(self.bits) - 1)] & inside(w, k)
        edge = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = stop - start >= self.least - k + 1
        start, stop = start[long], stop[long] + k - 1
        doc = np.searchsorted(w.first, start, side="right") - 1
        for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True):
            # no gram crosses a border, but runs of two documents may touch
            while (end := int(w.first[d + 1])) < b:
                yield d, a, end
                d, a = int(np.searchsorted(w.first, end, side="right")) - 1, end
            yield d, a, b

    def hits(self, w: Words, h: np.ndarray) -> list[tuple[int, int, int, frozenset[int] | list[int]]]:
        """(document, first word, words, items) of every window that occurs."""
        out, window, length, link = [], self.window, self.sam.length, self.sam.link
        for d, a, b in self.candidates(w, h):
            for i, (v, n) in enumerate(self.sam.stream(h[a:b].tolist()), a):
                if n >= window:
                    u = self.cut[v]
                    out.append((d, i - window + 1, window, self.owners[u]))
                u = self.up[v]
                while u > 0:
                    for size, own in self.marks[u]:
                        if size <= (n if u == v else length[u]):
                            out.append((d, i - size + 1, size, own))
                    u = self.up[link[u]]
        return out


def _shards(benchmark: DataFrame) -> tuple[list[str], list[list[tuple[int, np.ndarray]]]]:
    """Item ids as strings, and items by shard: (position of the id, hashes of its words)."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where(F.col("text").isNotNull())
    ids: list[str] = []
    shards: list[list[tuple[int, np.ndarray]]] = [[]]
    size = total = 0
    for r in rows.toLocalIterator():
        _, _, h = normal_words(texts_of(pa.array([r[1]])))
        if len(h):
            if size + len(h) > SHARD_WORDS and shards[-1]:
                shards.append([])
                size = 0
            shards[-1].append((len(ids), h))
            size, total = size + len(h), total + len(h)
            ids.append(r[0] or "")
            if total > MOST_ITEM_WORDS:
                raise ValueError(f"the benchmark has more than {MOST_ITEM_WORDS} words; decontaminate against parts of it in turn")
    return ids, shards


def _groups(batches: Iterator[pa.RecordBatch], text_col: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of texts, as many at once as hold `most` bytes."""
    group, size = [], 0
    for whole in batches:
        for b in slices(whole, text_col):
            group.append(b)
            size += b.nbytes
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def _scan(docs: DataFrame, benchmark: DataFrame, text_col: str, schema: StructType, emit) -> DataFrame:
    """One pass over docs: emit(batch, words, hit marks, items of each row, item ids) makes the batch that comes out."""
    from .tables import small_batches

    spark = docs.sparkSession
    small_batches(spark)
    ids, shards = _shards(benchmark)
    # what is sent is the items' hashes, within MOST_ITEM_WORDS; a worker holds one shard's automaton at a time
    sent, names = [spark.sparkContext.broadcast(s) for s in shards], spark.sparkContext.broadcast(ids)
    at = docs.columns.index(text_col)

    def scan(batches):
        one = Matcher(sent[0].value) if len(sent) == 1 else None
        for group in _groups(batches, text_col, 0 if one else TOGETHER):
            parts = [normal_words(texts_of(b.column(at)))[1:] for b in group]
            found = [([], [], [set() for _ in range(b.num_rows)]) for b in group]
            for s in sent:
                matcher = one or Matcher(s.value)
                for (w, h), (start, size, items) in zip(parts, found, strict=True):
                    for d, a, k, own in matcher.hits(w, h):
                        start.append(a)
                        size.append(k)
                        items[d].update(own)
            for b, (w, h), (start, size, items) in zip(group, parts, found, strict=True):
                hit = np.zeros(len(h), dtype=bool)
                first, many = np.array(start, np.int64), np.array(size, np.int64)
                for k in np.unique(many).tolist():
                    hit |= covered(first[many == k], k, len(h))
                yield emit(b, w, hit, items, names.value)

    return docs.mapInArrow(scan, schema)


def _contaminated(n_hit: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _runs(w: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of runs of hit words within documents, and the words after them."""
    edge = np.zeros(len(hit) + 1, dtype=bool)
    edge[w.first] = True
    begin = np.flatnonzero(hit & (~np.concatenate([[False], hit[:-1]]) | edge[:-1]))
    end = np.flatnonzero(hit & (~np.concatenate([hit[1:], [False]]) | edge[1:])) + 1
    return begin, end


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (first word, words, of each in turn) of every row of docs.

    Null texts and texts without words have no words and aren't contaminated; items without words match
    nothing; a null item id counts as "". Texts are read whole, whatever their length; repeated rows are
    judged each; equal item ids with different texts count once. An empty benchmark hits nothing, an empty
    table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))

    def emit(b, w, hit, items, ids):
        n_words, n_hit = w.counts(), sums(hit, w.first)
        of = [sorted({ids[i] for i in x}) for x in items]
        begin, end = _runs(w, hit)
        by = np.searchsorted(begin, w.first)
        spans = [np.stack([begin[i:j] - f, end[i:j] - begin[i:j]], 1).ravel().tolist() for i, j, f in zip(by[:-1].tolist(), by[1:].tolist(), w.first.tolist(), strict=False)]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in of], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in of], pa.string()), pa.array(_contaminated(n_hit, n_words)), pa.array(spans, pa.list_(pa.int64()))],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
        )

    schema = StructType([rows.schema[0], *(StructField(n, LongType()) for n in ("n_words", "n_hit", "n_items")), StructField("items_sha256", StringType()), StructField("contaminated", BooleanType()), StructField("spans", ArrayType(LongType()))])
    return _scan(rows, items, "text", schema, emit)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without contaminated documents (hit words a twentieth of all or more) and, in the others, without hit spans.

    A span goes from its first word to its last, with what stands between them; documents without hits, null
    and empty texts and all other columns are unchanged. Rows are judged each by itself, repeated ones
    too; an empty table stays empty, an empty benchmark changes nothing.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def emit(b, w, hit, items, ids):
        n_hit = sums(hit, w.first)
        keep = ~_contaminated(n_hit, w.counts())
        texts = b.column(at)
        if (cut := np.flatnonzero(keep & (n_hit > 0))).size:
            begin, end = _runs(w, hit)
            by = np.searchsorted(begin, w.first)
            t, out = texts_of(texts), texts.to_pylist()
            for d in cut.tolist():
                last, kept = t.offsets[d], []
                for i in range(by[d], by[d + 1]):
                    kept.append(t.buf[last : w.start[begin[i]]].tobytes())
                    last = w.end[end[i] - 1]
                out[d] = b"".join([*kept, t.buf[last : t.offsets[d + 1]].tobytes()]).decode()
            texts = pa.array(out, texts.type)
        return pa.RecordBatch.from_arrays([texts if i == at else b.column(i) for i in range(len(names))], names=names).filter(pa.array(keep))

    return _scan(docs, benchmark.select("item_id", "text"), text_col, docs.schema, emit)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
