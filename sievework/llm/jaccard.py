"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles of about equal size (a band and the one below it) are within a known Hamming
distance k of each other where their Jaccard similarity reaches the threshold. The feature domain is cut
into first-level parts, each of them into second-level parts, and signatures are the contents of subsets of
second-level parts; two sets within distance k agree on one signature at least. Signatures only find
candidates: sets that share one, directly or through others, are compared exactly, in blocks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..operators.components import components
from .arrowtext import LOWER, SPACE_WORDS, Texts, hashes, inside, mix, slices, texts_of, windows, words_of
from .tables import forget, fresh, small_batches, written

_U = np.uint64
#: Shingles that one comparing task holds of each of two blocks, about.
BLOCK = 1_000_000
#: Bands have so many names.
TAGS = 128
#: Sets that a task remembers, to sign copies once; beyond them it starts anew, which costs work and changes nothing.
SEEN = 1_000_000
#: Signatures that a task packs at once, about, and buckets that it deals them to.
PACK, BUCKETS = 1_000_000, 4096


def shingles(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents (64-bit hashes), one document after the other, and where each document's begin (one entry more than documents)."""
    t = Texts(LOWER[t.buf], t.offsets)
    w = words_of(t, SPACE_WORDS)
    h, counts = hashes(t, w), w.counts()
    doc, at, value = [], [], []
    g = windows(h, k)
    if len(g):
        ok = np.flatnonzero(inside(w, k))
        at.append(ok)
        value.append(g[ok])
    for m in range(1, k):
        whole = w.first[:-1][counts == m]
        if len(whole):
            at.append(whole)
            value.append(windows(h, m)[whole] + _U(m))
    if not at:
        return np.zeros(0, _U), np.zeros(len(t) + 1, np.int64)
    at, value = np.concatenate(at), np.concatenate(value)
    doc = np.searchsorted(w.first, at, side="right") - 1
    order = np.argsort(value)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, value = doc[order], value[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    doc, value = doc[first], value[first]
    return value, np.searchsorted(doc, np.arange(len(t) + 1))


def set_names(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each document's set, as two signed longs: a cryptographic digest of its sorted shingles."""
    raw = b"".join(hashlib.blake2b(value[i:j], digest_size=16).digest() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    hi, lo = np.frombuffer(raw, "<i8").reshape(-1, 2).T
    return np.ascontiguousarray(hi), np.ascontiguousarray(lo)


@dataclass(frozen=True)
class PartEnum:
    """Signatures for sets with 100 x intersection >= percent x union.

    n2: second-level parts of each first-level part; k2: how many of them a signature leaves out.
    """

    percent: int = 85
    n2: int = 3
    k2: int = 1
    rounds: int = 12

    def bands(self, largest: int) -> np.ndarray:
        """The largest size of each band; a set links only within its band, the next and the one before."""
        r = [1]
        while r[-1] < largest:
            r.append(max(r[-1] + 1, r[-1] * 100 // self.percent))
        return np.array(r)

    def distance(self, size: int) -> int:
        """The largest Hamming distance of two linked sets, neither larger than size."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    def layout(self, size: int) -> tuple[int, int, int, int]:
        """(first-level parts, those of them that may be weak, n2, k2) for sets up to size.

        A first-level part whose second-level parts differ in more than k2 takes k2 + 1 differences, so
        k differences leave n1 - k // (k2 + 1) first-level parts in which some n2 - k2 second-level parts
        agree. Sets of few differences have few features to part: they have the first level only, or no parts.
        """
        k = self.distance(size)
        if not k:
            return 1, 0, 1, 0
        n2, k2 = (self.n2, self.k2) if k >= 6 else (1, 0)
        spoilt, spare = k // (k2 + 1), 1
        for _ in range(3):
            # what chance leaves weak in the smallest sets of the band below, and two deviations more
            n1 = spoilt + 1 + spare
            features = size * (self.percent / 100) ** 2 / (n1 * n2)
            weak = n1 * min(1.0, comb(n2, k2) * exp(-features * (n2 - k2)))
            spare = min(1 + int(weak + 2 * sqrt(weak)), 1 + spoilt)
        return spoilt + 1 + spare, spare, n2, k2

    def signatures(self, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, signature) of all documents; a signature's last bits name its band, in which its two sets are compared.

        A subset without features says nothing, so its signature is left out; a first-level part with such
        a subset is weak. That loses no pair: two sets within distance k agree in more first-level parts
        than may be weak, so a pair is missed only if both sets have more weak parts than that. Such sets
        get another round of parts from another seed, and in the last round signatures without features too.
        """
        size = np.diff(first)
        out_doc, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
        top = self.bands(int(size.max(initial=1)))
        band = np.searchsorted(top, size)
        layout = [self.layout(int(r)) for r in self.bands(int(top[-1]) + 1)]
        n1, spare = np.array([x[0] for x in layout]), np.array([x[1] for x in layout])
        levels = [x[2:] for x in layout]
        for n2, k2 in sorted(set(levels)):
            fits = np.array([x == (n2, k2) for x in levels])
            subsets = list(combinations(range(n2), n2 - k2))
            for up in (0, 1):
                own = np.flatnonzero((size > 0) & fits[np.minimum(band + up, len(fits) - 1)])
                for turn in range(self.rounds):
                    if not len(own):
                        break
                    tag = band[own] + up
                    many = n1[tag]
                    base = np.cumsum(many) - many
                    x = mix(value[_pool(first[own], size[own])] + _U(turn * 0x632BE5AB + 1))
                    slot = (np.repeat(base, size[own]) + (x % np.repeat(many, size[own]).astype(_U)).astype(np.int64)) * n2
                    slot += ((x >> _U(40)) % _U(n2)).astype(np.int64)
                    content = np.zeros(int(many.sum()) * n2, _U)
                    np.add.at(content, slot, mix(x))
                    filled = np.zeros(len(content), dtype=bool)
                    filled[slot] = True
                    content, filled = content.reshape(-1, n2), filled.reshape(-1, n2)
                    which = np.repeat(np.arange(len(own)), many)
                    weak = np.bincount(which[filled.sum(1) <= k2], minlength=len(own)) > spare[tag]
                    name = (np.arange(len(which)) - np.repeat(base, many)).astype(_U) + (tag[which].astype(_U) << _U(40)) + (_U(turn) << _U(56))
                    for i, subset in enumerate(subsets):
                        emit = filled[:, subset].any(1)
                        if turn == self.rounds - 1:
                            emit |= weak[which]
                        sig = mix(name[emit] * _U(len(subsets)) + _U(i))
                        for j in subset:
                            sig = mix(sig + content[emit, j])
                        out_doc.append(own[which[emit]])
                        out_sig.append((sig & ~_U(TAGS - 1)) | (tag[which[emit]] % TAGS).astype(_U))
                    own = own[weak]
        return np.concatenate(out_doc), np.concatenate(out_sig)


def _pool(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + size[i] - 1, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def spanning_links(sets: list[np.ndarray], percent: int, many: np.ndarray, band: np.ndarray, own: np.ndarray, tag: int, same: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join all linked sets, a forest of them, and for each set the rows of those it is linked with.

    Each set meets the earlier ones by their common features alone. A pair can meet more than once: it counts
    where the tag is the larger of its bands, and sets of one block only where the block meets itself.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    value = np.concatenate(sets) if n else np.zeros(0)
    _, feature = np.unique(value, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(feature, kind="stable")
    post, start = owner[order], np.searchsorted(feature[order], np.arange(int(feature.max(initial=-1)) + 2))
    first = np.concatenate([[0], np.cumsum(size)])
    groups, out, rows = Union(n), [], np.zeros(n, np.int64)
    for i in range(1, n):
        f = feature[first[i] : first[i + 1]]
        lists = [post[start[x] : start[x + 1]] for x in f.tolist() if start[x + 1] - start[x] > 1]
        if not lists:
            continue
        met = np.concatenate(lists)
        # few postings among very many sets are sorted, many are counted
        near, both = np.unique(met, return_counts=True) if len(met) * 8 < n else (np.arange(n), np.bincount(met, minlength=n))
        hits = near[(near < i) & (both > 0) & (100 * both >= percent * (size[near] + size[i] - both))]
        here = hits[(np.maximum(band[hits], band[i]) % TAGS == tag) & (same | (own[hits] != own[i]))]
        rows[i] += many[here].sum()
        rows[here] += many[i]
        for j in hits.tolist():
            if groups.join(i, j):
                out.append((j, i))
    return out, rows


def measured(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text), n (shingles), hi and lo (the set's name) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))

    def scan(batches):
        for whole in batches:
            for b in slices(whole):
                value, first = shingles(texts_of(b.column(2)), words)
                hi, lo = set_names(value, first)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(first), pa.int64()), pa.array(hi), pa.array(lo)], names=["doc_id", "key", "n", "hi", "lo"])

    return rows.mapInArrow(scan, StructType([rows.schema[0], *(StructField(x, LongType()) for x in ("key", "n", "hi", "lo"))]))


def combined(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, signature) rows that link what the given ones do, with one row of a signature that several nodes share.

    The other nodes are tied to its first node by a signature that the two alone have, once for each pair,
    however many signatures they share. So a hot signature leaves a slice of texts as one row.
    """
    order = np.argsort(sig, kind="stable")
    node, sig = node[order], sig[order]
    lead = np.ones(len(sig), dtype=bool)
    lead[1:] = sig[1:] != sig[:-1]
    of = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    a, b, tag = node[~lead], node[of[~lead]], sig[~lead] & _U(TAGS - 1)
    own = mix(mix(a.view(_U) + mix(b.view(_U))) + tag)
    own, at = np.unique((own & ~_U(TAGS - 1)) | tag, return_index=True)
    return np.concatenate([node[lead], a[at], b[at]]), np.concatenate([sig[lead], own, own])


def packed(node: np.ndarray, sig: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(batch, nodes, buckets, words, where each bucket's words begin) of (node, signature) rows.

    A word is 44 bits of a signature and the place of its node among the batch's; the bucket is 12 more bits. So a
    signature is shuffled as eight bytes. 8 of its 57 bits besides the tag are left out: that finds no pair less, and
    sets that only seem to share a signature are compared exactly like others. A batch is named by its nodes' digest.
    """
    nodes, at = np.unique(node, return_inverse=True)
    word = (sig >> _U(15) << _U(7)) | (sig & _U(TAGS - 1))
    order = np.argsort(word)
    word, at = word[order], at[order].astype(_U)
    buckets, first = np.unique((word >> _U(44)).astype(np.int32), return_index=True)
    batch = int.from_bytes(hashlib.blake2b(nodes.tobytes(), digest_size=8).digest(), "little") >> 21
    return batch, nodes, buckets, (word << _U(20)) | at, np.append(first, len(word))


def signed(docs: DataFrame, words: int, method: PartEnum, text_col: str = "text") -> DataFrame:
    """The signatures of every set, packed: bucket, batch and words, or a batch's nodes; a node is the first half of a set's name. A task gives each set once."""

    def rows(held):
        node, sig = combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if not len(node):
            return
        # places have 20 bits
        for part in np.array_split(np.argsort(node, kind="stable"), 1 + len(node) // (1 << 20)):
            batch, nodes, buckets, word, first = packed(node[part], sig[part])
            data = pa.Array.from_buffers(pa.binary(), len(buckets), [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(word)])
            none = pa.nulls(len(buckets), pa.binary())
            for i in range(0, len(buckets), 500):
                n = len(buckets[i : i + 500])
                yield pa.RecordBatch.from_arrays([pa.array(buckets[i : i + n]), pa.array([batch] * n, pa.int64()), none.slice(i, n), data.slice(i, n)], names=["bucket", "batch", "nodes", "words"])
            yield pa.RecordBatch.from_arrays([pa.array([batch % BUCKETS], pa.int32()), pa.array([batch], pa.int64()), pa.array([nodes.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], names=["bucket", "batch", "nodes", "words"])

    def scan(batches):
        seen: set[int] = set()
        held, many = [], 0
        for whole in batches:
            for b in slices(whole):
                value, first = shingles(texts_of(b.column(0)), words)
                hi, _ = set_names(value, first)
                new = np.zeros(len(hi), dtype=bool)
                for i, x in enumerate(hi.tolist()):
                    if x not in seen:
                        if len(seen) == SEEN:
                            seen.clear()
                        seen.add(x)
                        new[i] = True
                doc, sig = method.signatures(value[np.repeat(new, np.diff(first))], np.concatenate([[0], np.cumsum(np.diff(first)[new])]))
                held.append((hi[new][doc], sig))
                many += len(sig)
                if many >= PACK:
                    yield from rows(held)
                    held, many = [], 0
        if held:
            yield from rows(held)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(scan, "bucket int, batch long, nodes binary, words binary")


def _met(batches):
    """Of packed signatures, bucket by bucket: (a, b, tag) that join the nodes of one signature, as places in batches; and (place, node, -1) of all nodes."""
    held, bucket, pairs = [], None, []

    def meet():
        place = np.concatenate([np.full(len(w), n << 20, np.int64) | (w & _U((1 << 20) - 1)).astype(np.int64) for n, w in held])
        sig = np.concatenate([w >> _U(20) for _, w in held])
        order = np.argsort(sig, kind="stable")
        sig, place = sig[order], place[order]
        lead = np.ones(len(sig), dtype=bool)
        lead[1:] = sig[1:] != sig[:-1]
        if not lead.all():
            of = np.flatnonzero(lead)[np.cumsum(lead) - 1][~lead]
            pairs.append(np.stack([place[~lead], place[of], (sig[~lead] & _U(TAGS - 1)).astype(np.int64)]))

    def out(rows):
        for i in range(0, rows.shape[1], 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 20_000]) for x in rows], names=["a", "b", "tag"])

    for b in batches:
        for k, n, nodes, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            if nodes.is_valid:
                node = np.frombuffer(nodes.as_buffer(), np.int64)
                yield from out(np.stack([(n << 20) + np.arange(len(node)), node, np.full(len(node), -1)]))
                continue
            if k != bucket and held:
                meet()
                held.clear()
                if sum(x.shape[1] for x in pairs) >= PACK:
                    # pairs that share more signatures are found again and again
                    pairs[:] = [np.unique(np.concatenate(pairs, axis=1), axis=1)]
                    if pairs[0].shape[1] >= PACK // 2:
                        yield from out(pairs.pop())
            bucket = k
            held.append((n, np.frombuffer(words.as_buffer(), _U)))
    if held:
        meet()
    if pairs:
        yield from out(np.unique(np.concatenate(pairs, axis=1), axis=1))


def candidates(sigs: DataFrame) -> DataFrame:
    """(a, b, tag) that join all nodes of one signature to one of them; what was shuffled to find them is gone."""
    met = written(sigs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "a long, b long, tag long"), "met")
    node = met.where("tag = -1").select(F.col("a").alias("_place"), F.col("b").alias("_node")).dropDuplicates(["_place"])
    found = met.where("tag >= 0").distinct()
    for c in ("a", "b"):
        # a batch that was made again from other rows would have another name
        found = found.join(node.hint("merge"), F.col(c) == F.col("_place"), "left").withColumn(c, F.coalesce("_node", F.raise_error(F.lit("a batch of signatures changed while it was read")))).drop("_place", "_node")
    out = written(found.where("a <> b").distinct(), "candidates")
    forget(met)
    return out


def turns(sizes: dict[int, int]) -> list[tuple[int, int]]:
    """From and to which distance blocks meet in each turn, for so many shingles (sizes) in groups of so many blocks.

    At distance 0 a set is shuffled once, at others twice; a turn shuffles no more than all sets twice, however many
    blocks a group has. So the disk that comparing takes doesn't grow with a group's square, its time does.
    """
    last = max(sizes, default=1) // 2
    cost = [sum(n * (2 if d else 1) for blocks, n in sizes.items() if blocks // 2 >= d) for d in range(last + 1)]
    out, sum_ = [], 0
    for d, c in enumerate(cost):
        if out and sum_ + c <= 2 * cost[0]:
            out[-1], sum_ = (out[-1][0], d), sum_ + c
        else:
            out, sum_ = [*out, (d, d)], c
    return out


def _judged(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, block: int) -> DataFrame:
    """linked(), with the key of each row's text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(measured(rows, words), "sets")
    # a class is the rows of one set; its number is fixed as it is written, and is what links are between
    classes = sets.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_many"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "hi", "lo", "n", "rep", "_many"), "classes")
    met = candidates(signed(rows, words, PartEnum(percent)))
    # sets are gathered band by band: a set has a node in each of its two bands, so chains over many sizes don't form
    pairs = met.select(F.xxhash64("a", "tag").alias("u"), F.xxhash64("b", "tag").alias("v"), "a", "b", "tag")
    coarse = components(pairs.select("u", "v"))
    nodes = pairs.select(F.col("u").alias("_node"), F.col("a").alias("_hi"), "tag").unionByName(pairs.select(F.col("v").alias("_node"), F.col("b").alias("_hi"), "tag")).distinct()
    # where several sets may link: each class, with the blocks it is compared in
    near = coarse.join(nodes, F.col("node") == F.col("_node")).select("label", "tag", "_hi").distinct()
    near = near.join(classes, F.col("_hi") == F.col("hi")).select("label", "tag", "cid", "rep", "hi", "lo", "n", "_many")
    total = near.groupBy("label").agg(F.greatest(F.ceil(F.sum("n") / block), F.lit(1)).alias("blocks")).withColumnRenamed("label", "_label")
    near = near.join(total, F.col("label") == F.col("_label"))
    near = written(near.groupBy("cid", "rep", "n", F.col("hi").alias("_hi"), F.col("lo").alias("_lo")).agg(F.collect_list(F.struct("label", "tag", "blocks", F.col("_many").alias("many"))).alias("groups")), "near")
    forget(met)
    # near grows with the corpus: it is never broadcast
    features = _sets_of(rows.join(near.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep"))), words)
    # texts were shuffled to be read: that is gone before sets are
    features = written(features.select("cid", "groups", "features"), "features")
    sizes = {r.blocks: r.n for r in near.select("n", F.inline("groups")).groupBy("blocks").agg(F.sum("n").alias("n")).collect()}
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    blocks = features.select("cid", "features", F.inline("groups")).withColumn("own", own).withColumn("blocks", F.col("blocks").cast("int"))

    def compare(part: pa.Table) -> pa.Table:
        part = part.sort_by("cid")
        cid = part.column("cid").to_numpy()
        # a row that is repeated brings its set again
        part = part.filter(pa.array(np.concatenate([[True], cid[1:] != cid[:-1]])))
        cid, col = part.column("cid").to_pylist(), lambda n: part.column(n).to_numpy()
        sets = [np.frombuffer(x, np.int64) for x in part.column("features").to_pylist()]
        size = np.array([len(x) for x in sets])
        band = np.searchsorted(PartEnum(percent).bands(int(size.max())), size)
        found, rows = spanning_links(sets, percent, col("many"), band, col("own"), int(col("tag")[0]), bool(col("a")[0] == col("b")[0]))
        some = np.flatnonzero(rows).tolist()
        u, v = [cid[i] for i, _ in found] + [cid[i] for i in some], [cid[j] for _, j in found] + [None] * len(some)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "rows": pa.array([None] * len(found) + rows[some].tolist(), pa.int64())})

    # a row is a link of the forest (u, v) or says with how many rows u is linked (rows)
    links = []
    for low, high in turns(sizes):
        # blocks stand in a ring, and two of them meet at their distance
        apart = F.sequence(F.lit(low), F.least(F.lit(high), (F.col("blocks") / 2).cast("int")))
        other = F.array_distinct(F.flatten(F.transform(apart, lambda d: F.array(F.pmod(F.col("own") + d, F.col("blocks")), F.pmod(F.col("own") - d, F.col("blocks"))))))
        pairs = blocks.where((F.col("blocks") / 2).cast("int") >= low).withColumn("other", F.explode(other))
        pairs = pairs.select("label", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "tag", "many", "own", "cid", "features")
        links.append(written(pairs.groupBy("label", "a", "b").applyInArrow(compare, "u long, v long, rows long"), "links"))
    links = reduce(DataFrame.unionByName, links)
    forget(near)
    forget(features)
    joined = components(links.where("v is not null").select("u", "v")).select(F.col("node"), F.col("label").alias("_class"))
    low = joined.join(classes.select("cid", "rep"), F.col("node") == F.col("cid")).groupBy(F.col("_class").alias("_low")).agg(F.min("rep").alias("_component"))
    joined = joined.join(low, F.col("_class") == F.col("_low")).select("node", "_component")
    counts = links.where("rows is not null").groupBy(F.col("u").alias("_u")).agg(F.sum("rows").alias("_rows"))
    known = classes.join(counts, F.col("cid") == F.col("_u"), "left").withColumn("_links", F.coalesce("_rows", F.lit(0)) + F.col("_many") - F.lit(1))
    known = known.join(joined, F.col("cid") == F.col("node"), "left").select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("n").alias("_n"), F.coalesce("_component", "rep").alias("_component"), "_links")
    out = sets.join(known, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")) & (F.col("n") == F.col("_n")), "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


def _sets_of(rows: DataFrame, words: int) -> DataFrame:
    """groups, cid and features (the set as bytes) of rows whose text has the set that _hi and _lo name."""

    def scan(batches):
        for whole in batches:
            for b in slices(whole):
                col = lambda n: b.column(b.schema.get_field_index(n))  # noqa: E731, B023
                value, first = shingles(texts_of(col("text")), words)
                hi, lo = set_names(value, first)
                keep = np.flatnonzero((hi == col("_hi").to_numpy()) & (lo == col("_lo").to_numpy()))
                raw = [value[first[i] : first[i + 1]].tobytes() for i in keep.tolist()]
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([col("groups").take(at), col("cid").take(at), pa.array(raw, pa.binary())], names=["groups", "cid", "features"])

    return rows.mapInArrow(scan, StructType([rows.schema["groups"], StructField("cid", LongType()), StructField("features", BinaryType())]))


def linked(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows whose set is linked with its own, directly) of every row.

    component_id is the smallest doc_id that links reach; equal sets are linked, a text without words has
    the empty set and is linked with nothing. A null text is empty; texts of any length are read whole; a row
    of null id takes part, and has the smallest id of its component or null; repeated rows are each returned
    and count as linked with each other; rows of one id with different texts each have the component of their own
    text; ids may be of any type that has an order; an empty table gives none. Other columns are not read.
    """
    return _judged(docs, words, percent, id_col, text_col, block).drop("key")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component.

    Null and empty texts stay, as do rows of a null id whose component has no other id; a null id with a copy that has one goes.
    Of repeated rows of the smallest id all stay; rows of one id with different texts are judged each. An
    empty table stays empty; columns keep their names and values, whatever they are called.
    """
    found = _judged(docs, words, percent, "doc_id", "text", BLOCK)
    own_id, own_key = fresh(docs, "gone_id", "gone_key")
    gone = found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key)), "left_anti")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return linked(table(spark, sf_dir, "documents"))
