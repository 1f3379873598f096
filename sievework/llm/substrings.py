"""Substring deduplication by suffix automata of reference shards.

Every window of 13 words has an anchor: the least of its 4-grams by hash. Equal windows have equal anchors,
so the corpus as its own reference is cut into shards by anchor, and a document's words need to visit
only the shards of their own anchors, instead of all shards going to all documents. Anchors of one
document alone are left out first. A shard is a suffix automaton of its segments (the words under all
windows of an anchor) whose states know the smallest document that holds them; the state of a segment's
last 13 words gives, at each word, the smallest holder of that window, and maximal spans covered by
windows of smaller documents are removed. Three kinds of windows don't need the automaton: those of whole
copies, of segments that no other one shares an anchor with, and of anchors that very many documents share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .arrowtext import Texts, Words, covered, hashes, inside, mix, slices, sums, texts_of, windows, words_of
from .automaton import SuffixAutomaton
from .tables import small_batches, written

_U = np.uint64
GRAM = 4
#: Bytes of text that a task looks at together.
PART = 1 << 20
#: Words of distinct segments in one automaton, about; a shard is closed at the next anchor.
SHARD_WORDS = 20_000
#: One document in SAMPLE is looked at for anchors that very many documents share: those with HOT or more there.
SAMPLE, HOT, MOST_HOT = 32, 64, 50_000


def anchors(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows' first words, their anchors' words, hashes of all grams): the leftmost least gram of each window."""
    n, span = len(h) - window + 1, window - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    g = windows(h, GRAM)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        c = g[j : j + n]
        less = c < best
        best[less] = c[less]
        at[less] = j
    start = np.flatnonzero(inside(w, window))
    return start, start + at[start], g


def joined(t: Texts, w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each document joined by single spaces, and the documents' borders in them."""
    word = np.zeros(len(t.buf) + 1, np.int64)
    np.add.at(word, w.start[keep], 1)
    np.add.at(word, w.end[keep], -1)
    take = np.cumsum(word[:-1]) > 0
    doc = w.doc()[keep]
    later = np.ones(len(doc), dtype=bool)
    later[1:] = doc[1:] == doc[:-1]
    later[:1] = False
    gap = w.start[keep][later] - 1
    out = t.buf.copy()
    out[gap] = 0x20
    take[gap] = True
    return out[take], np.concatenate([[0], np.cumsum(take)])[t.offsets]


def _digests(t: Texts, w: Words, keep: np.ndarray) -> list[str]:
    raw, border = joined(t, w, keep)
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(border[:-1], border[1:], strict=True)]


def _base(rows: DataFrame) -> DataFrame:
    """doc_id, crc (of the text), n_words and sha (of the words joined by spaces) of every row."""

    def scan(batches):
        for whole in batches:
            for b in slices(whole, most=PART):
                t = texts_of(b.column(1))
                w = words_of(t)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(w.counts(), pa.int64()), pa.array(_digests(t, w, np.ones(len(w.start), dtype=bool)))], names=["doc_id", "crc", "n_words", "sha"])

    return rows.mapInArrow(scan, StructType([rows.schema[0], StructField("crc", LongType()), StructField("n_words", LongType()), StructField("sha", StringType())]))


def _anchored(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, h) of each anchor. Within a task a text is left out if a smaller document had it: the smallest of a class is never left out."""

    def scan(batches):
        seen: dict[bytes, int] = {}
        for whole in batches:
            for b in slices(whole, most=PART):
                t = texts_of(b.column(1))
                ids = b.column(0).to_numpy()
                keep = []
                for i, d in enumerate(ids.tolist()):
                    key = hashlib.blake2b(t.raw(i), digest_size=16).digest()
                    if seen.get(key, d + 1) > d:
                        seen[key] = d
                        keep.append(i)
                if len(keep) < len(ids):
                    t = texts_of(b.column(1).take(pa.array(keep, pa.int64())))
                    ids = ids[keep]
                w = words_of(t)
                _, at, g = anchors(w, hashes(t, w), window)
                at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
                doc = np.searchsorted(w.first, at, side="right") - 1
                # an anchor counts once in a document
                own = np.unique(mix(g[at] + doc.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[own]], pa.int64()), pa.array(g[at[own]].view(np.int64))], names=["doc_id", "h"])

    return rows.mapInArrow(scan, "doc_id long, h long")


def _repeated(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, h, hot) of anchors that several documents have.

    Anchors found in HOT or more sampled documents are known to repeat, so their rows need no shuffle;
    all others are few for each anchor and meet in its partition. What is called hot changes no result.
    """
    some = _anchored(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), window).distinct()
    hot = some.groupBy("h").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "h").limit(MOST_HOT)
    hot = written(hot.select(F.col("h").alias("_h")), "hot")
    found = _anchored(rows, window)
    known = found.join(F.broadcast(hot), F.col("h") == F.col("_h"), "left_semi").withColumn("hot", F.lit(True))
    rest = found.join(F.broadcast(hot), F.col("h") == F.col("_h"), "left_anti")
    own = Window.partitionBy("h")
    rest = rest.withColumn("a", F.min("doc_id").over(own)).withColumn("z", F.max("doc_id").over(own)).where("a < z")
    return rest.select("doc_id", "h", F.lit(False).alias("hot")).unionByName(known.select("doc_id", "h", "hot"))


def _segments(rows: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """(key, words, doc_id, crc, first, hot): for each repeated anchor the words under its windows; key is the anchor."""
    of = hits.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("hot"), F.col("h"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("warm")).withColumnRenamed("doc_id", "_id")
    text = rows.join(of, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "crc", "cold", "warm")

    def scan(batches):
        for whole in batches:
            for b in slices(whole, most=PART):
                t = texts_of(b.column(1))
                w = words_of(t)
                h = hashes(t, w)
                start, at, g = anchors(w, h, window)
                ids = b.column(0).to_numpy()
                doc = np.searchsorted(w.first, start, side="right") - 1
                keys, words, docs, crcs, firsts, hots = [], [], [], [], [], []
                crc = b.column(2).to_numpy()
                clean, border = joined(t, w, np.ones(len(h), dtype=bool))
                # where each word begins and ends in the joined bytes
                size, of_word = w.end - w.start, w.doc()
                upto = np.cumsum(size + 1) - (size + 1)
                begin = border[of_word] + upto - upto[w.first[:-1][of_word]]
                end = begin + size
                name = g[at].view(np.int64)
                for n, hot in ((3, False), (4, True)):
                    column = b.column(n)
                    marked = np.zeros(len(start), dtype=bool)
                    flat, of_doc = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
                    if len(flat):
                        owner = np.repeat(np.arange(len(ids)), np.diff(of_doc))
                        want = np.sort(mix(flat.view(_U) + mix(owner.astype(_U))))
                        have = mix(name.view(_U) + mix(doc.astype(_U)))
                        i = np.searchsorted(want, have)
                        marked = (i < len(want)) & (want[np.minimum(i, len(want) - 1)] == have)
                    own = np.flatnonzero(marked)
                    if not len(own):
                        continue
                    # neighbouring windows of one anchor are one segment
                    new = np.ones(len(own), dtype=bool)
                    new[1:] = (at[own][1:] != at[own][:-1]) | (own[1:] != own[:-1] + 1)
                    lead = np.flatnonzero(new)
                    a, z = start[own[lead]], start[own[np.append(lead[1:], len(own)) - 1]] + window - 1
                    key = name[own[lead]]
                    owner = np.searchsorted(w.first, a, side="right") - 1
                    keys.append(key)
                    words += [clean[i:j].tobytes() for i, j in zip(begin[a].tolist(), end[z].tolist(), strict=True)]
                    docs.append(ids[owner])
                    crcs.append(crc[owner])
                    firsts.append(a - w.first[owner])
                    hots.append(np.full(len(a), hot))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(words, pa.binary()), pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(crcs), pa.int64()), pa.array(np.concatenate(firsts), pa.int64()), pa.array(np.concatenate(hots))], names=["key", "words", "doc_id", "crc", "first", "hot"])

    return text.mapInArrow(scan, "key long, words binary, doc_id long, crc long, first long, hot boolean")


def shard_matches(segments: dict[bytes, int], window: int) -> dict[bytes, list[int]]:
    """For each segment and each of its windows the smallest document of the shard that holds the window.

    segments: the smallest document of each.
    """
    sam = SuffixAutomaton()
    walks, ends = {}, []
    for words, doc in segments.items():
        walk = sam.insert(words.split(b" "))
        walks[words] = walk
        ends += [(v, doc) for v in walk[window - 1 :]]
    low, link, length = sam.smallest(ends), sam.link, sam.length
    out = {}
    for words, walk in walks.items():
        lows = []
        for v in walk[window - 1 :]:
            # the state of the last `window` words alone
            while length[link[v]] >= window:
                v = link[v]
            lows.append(low[v])
        out[words] = lows
    return out


def _shards(segments: DataFrame, window: int) -> DataFrame:
    """(doc_id, crc, first, n) of removed words: runs of windows that a smaller document of the shard holds."""
    cold = segments.where("not hot").select("key", "words", "doc_id", "crc", "first")
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = cold.repartition(parts, "key").sortWithinPartitions("key")

    def close(group: list[tuple[int, bytes, int, int, int]]):
        least: dict[bytes, int] = {}
        of: dict[int, set[bytes]] = {}
        for key, words, doc, *_ in group:
            of.setdefault(key, set()).add(words)
            if least.get(words, doc + 1) > doc:
                least[words] = doc
        # anchors don't share windows: a segment alone under its anchor holds nothing of others
        alone = {w for own in of.values() if len(own) == 1 for w in own}
        low = {w: [least[w]] * (w.count(b" ") + 2 - window) for w in alone} | shard_matches({w: d for w, d in least.items() if w not in alone}, window)
        return _spans_batch([x for _, words, doc, crc, first in group for x in _runs(doc, crc, first, low[words], window)])

    def stream(batches):
        group: list[tuple[int, bytes, int, int, int]] = []
        size, last = 0, None
        for b in batches:
            for key, words, doc, crc, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != last and size >= SHARD_WORDS:
                    yield close(group)
                    group, size = [], 0
                last = key
                group.append((key, words, doc, crc, first))
                size += window + 4
        if group:
            yield close(group)

    found = cold.mapInArrow(stream, "doc_id long, crc long, first long, n long")
    return found.unionByName(_hot_spans(segments.where("hot").select("key", "words", "doc_id", "crc", "first"), window))


def _hot_spans(segments: DataFrame, window: int) -> DataFrame:
    """As _shards, of anchors that very many documents share, whose segments may not meet in one task.

    Equal segments are combined before their shuffle, and so are equal windows of those left, by the least
    document that has them: no key gathers more rows than there are tasks. Joins back to rows may be split.
    """
    least = segments.groupBy("key", "words").agg(F.min("doc_id").alias("doc_id"))
    least = written(least.withColumn("seg", F.monotonically_increasing_id()), "hot-segments")

    def part(batches):
        for b in batches:
            seg, no, text, doc = [], [], [], []
            for words, d, s in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("words", "doc_id", "seg")), strict=True):
                own = words.split(b" ")
                for i in range(len(own) - window + 1):
                    seg.append(s)
                    no.append(i)
                    text.append(b" ".join(own[i : i + window]))
                    doc.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int64()), pa.array(no, pa.int32()), pa.array(text, pa.binary()), pa.array(doc, pa.int64())], names=["seg", "no", "window", "doc_id"])

    each = least.mapInArrow(part, "seg long, no int, window binary, doc_id long")
    low = each.groupBy("window").agg(F.min("doc_id").alias("low")).withColumnRenamed("window", "_window")
    lows = each.join(low, F.col("window") == F.col("_window")).groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("no", "low"))).alias("lows"))
    lows = least.join(lows.withColumnRenamed("seg", "_seg"), F.col("seg") == F.col("_seg")).select(F.col("key").alias("_key"), F.col("words").alias("_words"), F.col("lows.low").alias("lows"))
    rows = segments.join(lows, (F.col("key") == F.col("_key")) & (F.col("words") == F.col("_words"))).select("doc_id", "crc", "first", "lows")

    def runs(batches):
        for b in batches:
            out = [x for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in _runs(*row, window)]
            yield _spans_batch(out)

    return rows.mapInArrow(runs, "doc_id long, crc long, first long, n long")


def _runs(doc: int, crc: int, first: int, lows: list[int], window: int):
    """Spans of a segment's windows that a smaller document holds."""
    i, n = 0, len(lows)
    while i < n:
        if lows[i] < doc:
            j = i
            while j + 1 < n and lows[j + 1] < doc:
                j += 1
            yield doc, crc, first + i, j - i + window
            i = j
        i += 1


def _spans_batch(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], [], []))], names=["doc_id", "crc", "first", "n"])


def _cut(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows that lose words, with their spans as _first and _n."""
    of = spans.groupBy(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc")).agg(F.collect_list("first").alias("_first"), F.collect_list("n").alias("_n"))
    return rows.join(of, (F.col("doc_id") == F.col("_id")) & (F.col("crc") == F.col("_crc"))).drop("_id", "_crc")


def _removed_words(w: Words, b: pa.RecordBatch, n_first: int) -> np.ndarray:
    """Marks the removed words of a batch whose columns n_first and n_first + 1 have each row's spans."""
    mark = np.zeros(len(w.start), dtype=bool)
    first, n = b.column(n_first), b.column(n_first + 1)
    owner = np.repeat(np.arange(b.num_rows), np.diff(first.offsets.to_numpy()))
    at, size = first.flatten().to_numpy() + w.first[owner], n.flatten().to_numpy()
    for k in np.unique(size).tolist():
        mark |= covered(at[size == k], k, len(mark))
    return mark


def spans(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, crc, first, n) of removed words of rows (doc_id, text, crc), but for documents left out as copies."""
    small_batches(rows.sparkSession)
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hits = written(_repeated(rows, window), "hits")
    segments = written(_segments(rows, hits, window), "segments")
    return written(_shards(segments, window), "spans")


def deduplicated(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of kept words joined by spaces) of every row.

    A word goes if a window over it also starts in a document of smaller id. A null text has no words; texts
    of any length are read whole. A row of null id neither takes words from others nor loses any; rows
    of one id, repeated or not, don't take each other's; an empty table gives none. ids are whole numbers.
    Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"))
    base = written(_base(rows), "words")
    # copies are told by a cryptographic digest of their words
    low = base.where(f"n_words >= {window}").groupBy(F.col("sha").alias("_sha")).agg(F.min("doc_id").alias("low")).where("low is not null")
    base = base.join(low, F.col("sha") == F.col("_sha"), "left")
    base = base.withColumn("copy", F.coalesce(F.col("low") < F.col("doc_id"), F.lit(False))).select("doc_id", "crc", "n_words", "sha", "copy")
    text = _cut(rows, spans(rows, window)).select("doc_id", "text", "crc", "_first", "_n")

    def scan(batches):
        for whole in batches:
            for b in slices(whole, most=PART):
                t = texts_of(b.column(1))
                w = words_of(t)
                gone = _removed_words(w, b, 3)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sums(gone, w.first), pa.int64()), pa.array(_digests(t, w, ~gone))], names=["_id", "_crc", "_removed", "_kept"])

    cut = text.mapInArrow(scan, "_id long, _crc long, _removed long, _kept string").distinct()
    out = base.join(cut, (F.col("doc_id") == F.col("_id")) & (F.col("crc") == F.col("_crc")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("_kept", "sha")).alias("kept_sha256"),
    )


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return deduplicated(table(spark, sf_dir, "documents"))
