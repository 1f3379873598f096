"""Line deduplication by MinHash over character shingles, in DataFrame operations only.

A line's set has the shingles of SHINGLE characters at all of its positions. Distinct lines get
MinHash signatures; lines that agree on a band are candidates, their exact Jaccard similarity decides,
and one line of each component stays: the first of the corpus.

Null texts and lines without a word have no part in it and stay as they are; lines of any length are read
whole; a line shorter than a shingle is its own set; equal lines are one line, and of a tie the smaller
doc_id, then the smaller line number, stays; empty tables give empty tables. Ids are of any type that
can be ordered, negative ones too. Columns of docs other than id and text are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.components import components
from .tables import forget, fresh, written

#: Seven characters are about a word and the start of the next: unlike lines of one vocabulary share a thousandth of them, of five characters a hundredth.
SHINGLE = 7
#: A signature has GROUPS x UNITS x 2 values. Any two units of a group make a band of four values, so a pair of lines
#: is missed only if it agrees on one unit at most in every group: with probability 0.0025 at a similarity of 0.8,
#: 0.0001 at 0.87. At 0.1 it is found with probability 0.002.
GROUPS, UNITS = 3, 4
THRESHOLD = 0.8
#: Words of 64 bits in a candidate's sketch; a power of two.
SKETCH = 32
#: Members of a band that each member meets at first; bands of one more are done with then.
NEAR = 3
#: White space of lines and words: ASCII.
_WORD = "[^\\x20\\x09-\\x0D]"
#: Stands for a null id: one more than the largest.
_NO_ID = str(1 << 63)


def _characters(line: Column) -> Column:
    """A line's characters, four bytes each, so that any of them is reached at once; capitals count as small letters."""
    return F.encode(F.lower(line), "UTF-32")


def _starts(characters: Column) -> Column:
    """Where a line's shingles begin: at every character that SHINGLE - 1 others follow; a shorter line is one shingle."""
    return F.sequence(F.lit(0), F.greatest((F.length(characters) / 4).cast("int") - F.lit(SHINGLE), F.lit(0)))


def _hash(characters: Column, start: Column) -> Column:
    return F.xxhash64(F.substr(characters, start * F.lit(4) + F.lit(1), F.lit(4 * SHINGLE)))


def shingles(line: Column) -> Column:
    """Distinct hashes of a line's shingles."""
    return F.array_distinct(_all_shingles(line))


def _all_shingles(line: Column) -> Column:
    """Hashes of a line's shingles, in their order and with repeats."""
    at = lambda c: F.sequence(F.lit(1), F.greatest(F.length(c) - F.lit(4 * SHINGLE - 1), F.lit(1)), F.lit(4))  # noqa: E731  in bytes
    whole = F.transform(F.array(_characters(line)), lambda c: F.transform(at(c), lambda i: F.xxhash64(F.substr(c, i, F.lit(4 * SHINGLE)))))
    return F.element_at(whole, 1)


def _seeds(n: int) -> list[tuple[int, int]]:
    """Fixed pairs of an odd number below 2^30 and one below 2^32, far from each other."""
    found = [int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "big") for i in range(n)]
    return [(x >> 34 | 1, x & 0xFFFFFFFF) for x in found]


def _is_whole(docs: DataFrame, id_col: str) -> bool:
    return isinstance(docs.select(id_col).schema[0].dataType, IntegralType)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, line) of every line with a word; place orders lines by doc_id (null last) and number.

    Places of ids that are whole numbers are numbers, id x 2^31 + number, which aggregate without sorting; others are structs.
    """
    rows = docs.select(F.col(id_col).alias("_d"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("_no", "line"))
    if _is_whole(docs, id_col):
        of = F.coalesce(F.col("_d").cast("decimal(20,0)"), F.lit(_NO_ID).cast("decimal(20,0)"))
        place = (of * F.lit(1 << 31).cast("decimal(11,0)") + F.col("_no").cast("decimal(10,0)")).cast("decimal(38,0)")
    else:
        place = F.struct(F.col("_d").isNull().alias("nameless"), F.col("_d").alias("doc_id"), F.col("_no").alias("line_no"))
    return rows.select(place.alias("place"), "line").where(F.col("line").rlike(_WORD))


def _taken_apart(kept: DataFrame, whole: bool) -> DataFrame:
    """doc_id and line_no of places; the remainder is never negative, so ids below zero come back too."""
    if not whole:
        return kept.select("place.doc_id", "place.line_no")
    no = F.pmod("place", F.lit(1 << 31).cast("decimal(38,0)"))
    doc = ((F.col("place") - no) / F.lit(1 << 31).cast("decimal(11,0)")).cast("decimal(20,0)")
    return kept.select(F.when(doc < F.lit(_NO_ID).cast("decimal(20,0)"), doc.cast("long")).alias("doc_id"), no.cast("int").alias("line_no"))


def distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node (a number), line and place (of the first) of every distinct line; equal lines of a task are combined before their shuffle."""
    first = lines_of(docs, id_col, text_col).groupBy("line").agg(F.min("place").alias("place"))
    return first.select(F.monotonically_increasing_id().alias("node"), "line", "place")


def signed(lines: DataFrame) -> DataFrame:
    """node and m0, m1 ... (its MinHash values) of every line.

    Each value is the least of a permutation (h x odd + number, modulo 2^32) of the shingles' hashes. The
    leading bits of a product depend on all of h, so values of different permutations are independent.
    A line's shingles stand together in a task, so what is shuffled is one row a line.
    """
    each = lines.select("node", _characters(F.col("line")).alias("c")).select("node", "c", F.explode(_starts(F.col("c"))).alias("i"))
    each = each.select("node", _hash(F.col("c"), F.col("i")).bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"))
    value = lambda a, b: (F.col("h") * F.lit(a).cast("long") + F.lit(b).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    return each.groupBy("node").agg(*(F.min(value(a, b)).alias(f"m{i}") for i, (a, b) in enumerate(_seeds(GROUPS * UNITS * 2))))


def bands(signed: DataFrame) -> DataFrame:
    """(band, node) of every line; bands of different units never meet."""
    keys = []
    for group in range(GROUPS):
        for a, b in combinations(range(group * UNITS, (group + 1) * UNITS), 2):
            keys.append(F.xxhash64(F.lit(len(keys)), f"m{2 * a}", f"m{2 * a + 1}", f"m{2 * b}", f"m{2 * b + 1}"))
    return signed.select(F.col("node"), F.explode(F.array(*keys)).alias("band"))


def grouped(bands: DataFrame) -> DataFrame:
    """(band, node, many, others) of the bands that several lines share: how many they are, and whom a member meets first.

    Those are the band's smallest and the NEAR that follow in an order that differs from band to band. What
    bands are dealt by is read twice, not made or shuffled again.
    """
    dealt = bands.repartition("band")
    low = dealt.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("_high"), F.count(F.lit(1)).alias("many")).where("low < _high")
    met = dealt.join(low.select(F.col("band").alias("_band"), "low", "many").hint("shuffle_hash"), F.col("band") == F.col("_band"))
    order = Window.partitionBy("band").orderBy(F.xxhash64("band", "node"), "node")
    return met.select("band", "node", "many", F.array("low", *(F.lead("node", k).over(order) for k in range(1, NEAR + 1))).alias("others"))


def sketches(lines: DataFrame) -> DataFrame:
    """node, n (how many shingles its set has) and w0, w1 ...: SKETCH words of 64 bits, a bit set for each shingle."""
    each = lines.select("node", shingles(F.col("line")).alias("set")).select("node", F.size("set").cast("long").alias("n"), F.explode("set").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 58).cast("int"))
    each = each.select("node", "n", bit.alias("bit"), F.col("h").bitwiseAND(F.lit(SKETCH - 1)).cast("int").alias("word"))
    # a row a word first: one update a shingle, not one for each word
    each = each.groupBy("node", "n", "word").agg(F.bit_or("bit").alias("bits"))
    words = [F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(SKETCH)]
    return each.groupBy("node", "n").agg(*words)


def _may_reach(threshold: float, own: str, other: str) -> Column:
    """Whether two sketches, whose columns' names begin so, allow the threshold: every bit that differs is a shingle of one set alone.

    Of sets with n and m shingles that reach it, at most (n + m) x (1 - threshold) / (1 + threshold) are in one alone,
    so no pair is lost. n and m are those of the sets: a line that repeats itself has far more positions, and would let
    pairs pass that are not nearly alike. Pairs of very long lines, whose bits are nearly all set, pass.
    """
    differ = sum((F.bit_count(F.col(f"{own}w{k}").bitwiseXOR(F.col(f"{other}w{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col(f"{own}w0").bitwiseXOR(F.col(f"{other}w0"))))
    return differ <= (F.col(f"{own}n") + F.col(f"{other}n")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(0.001)


def _named(table: DataFrame, prefix: str) -> DataFrame:
    return table.select(*(F.col(c).alias(prefix + c) for c in table.columns))


def _possible(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sketches allow the threshold."""
    told = pairs.join(_named(sketches, "_a"), F.col("u") == F.col("_anode"))
    return told.join(_named(sketches, "_b"), (F.col("v") == F.col("_bnode")) & _may_reach(threshold, "_a", "_b")).select("u", "v")


def _alike(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold, exactly. Lines are what is shuffled; their sets are made where a pair meets, once a pair."""
    told = pairs.join(lines.select(F.col("node").alias("_u"), F.col("line").alias("_a")), F.col("u") == F.col("_u"))
    told = told.join(lines.select(F.col("node").alias("_v"), F.col("line").alias("_b")), F.col("v") == F.col("_v"))
    # each explode of a single struct keeps the condition from being moved below what it is made of, which would be worked out once a use
    met = told.select("u", "v", F.explode(F.array(F.struct(_all_shingles(F.col("_a")).alias("a"), _all_shingles(F.col("_b")).alias("b")))).alias("s"))
    sizes = F.struct(F.size(F.array_distinct("s.a")).alias("n"), F.size(F.array_distinct("s.b")).alias("m"), F.size(F.array_intersect("s.a", "s.b")).alias("both"))
    sized = met.select("u", "v", F.explode(F.array(sizes)).alias("s"))
    return sized.where(F.col("s.both") >= F.lit(threshold) * (F.col("s.n") + F.col("s.m") - F.col("s.both"))).select("u", "v")


def _labels(members: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """node and label of every line with a link: its component by the links of all candidate pairs. Rows may repeat.

    First each band's members meet its smallest, which is the same in most bands of a group, and some
    others: that joins nearly all of a group of alike lines, and in small bands it is every pair. Then only
    pairs of a larger band that are still in different components meet: with L members in the band's largest
    component and S in others, S x (L + S) at most, and none where all are joined. They meet by their
    sketches, which only they have; lines are read of those alone that may be alike, and no pair's twice. What these links join is
    components, so only their labels, not all links, are joined again.
    """
    asked = members.select("node", F.explode("others").alias("other")).where("node <> other")
    asked = asked.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
    told = written(asked, "told")
    links = written(_alike(told, lines, threshold), "links")
    label = components(links).withColumnRenamed("node", "_node")
    of = members.where(F.col("many") > F.lit(NEAR + 1)).join(label, F.col("node") == F.col("_node"), "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    of = written(of, "labelled")
    sizes = of.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy(F.col("band").alias("_band")).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    of = written(of.join(open_, F.col("band") == F.col("_band")).select("band", "node", "label", (F.col("label") == F.col("main")).alias("in_main")), "open")
    drawn = written(sketches(lines.join(of.select(F.col("node").alias("_node")).distinct(), F.col("node") == F.col("_node"), "left_semi")), "sketches")
    of = of.join(_named(drawn, "_a"), F.col("node") == F.col("_anode")).drop("_anode")
    small = of.where("not in_main").select(F.col("band").alias("_band"), F.col("node").alias("_node"), F.col("label").alias("_label"), *(F.col(f"_a{c}").alias(f"_b{c}") for c in drawn.columns if c != "node"))
    apart = (F.col("band") == F.col("_band")) & (F.col("label") != F.col("_label")) & (F.col("in_main") | (F.col("node") < F.col("_node")))
    rest = of.join(small, apart & _may_reach(threshold, "_a", "_b"))
    rest = rest.select(F.greatest("node", "_node").alias("u"), F.least("node", "_node").alias("v")).distinct()
    rest = rest.join(told.select(F.col("u").alias("_u"), F.col("v").alias("_v")), (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v")), "left_anti")
    more = written(_alike(rest, lines, threshold), "links")
    for end in ("u", "v"):
        more = more.join(label, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("label", end)).select("u", "v")
    joined = components(more).select(F.col("node").alias("_old"), F.col("label").alias("_new"))
    last = label.join(joined, F.col("label") == F.col("_old"), "left").select(F.col("_node").alias("node"), F.coalesce("_new", "label").alias("label"))
    return last.unionByName(joined.toDF("node", "label"))


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no) of the lines that stay among those with a word: the first of each component. Writing the lines fixes their numbers."""
    distinct = written(distinct_lines(docs, id_col, text_col), "lines")
    places = written(distinct.select("node", "place"), "places")
    members = written(grouped(bands(signed(distinct))), "members")
    # a table of its own: what the bands shuffled is gone before lines are
    some = written(members.select(F.col("node").alias("_node")).distinct(), "some")
    lines = written(distinct.select("node", "line").join(some.hint("shuffle_hash"), F.col("node") == F.col("_node"), "left_semi"), "candidates")
    forget(distinct)
    alike = _labels(members, lines, threshold).withColumnRenamed("node", "_node")
    place = places.join(alike, F.col("node") == F.col("_node"), "left")
    kept = place.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("place").alias("place"))
    return _taken_apart(kept, _is_whole(docs, id_col))


def _kept_numbers(kept: DataFrame) -> DataFrame:
    """doc_id and numbers, the sorted numbers of kept lines; rows of one id share them."""
    return kept.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("numbers"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with lines removed from the text: of similar lines the first of the corpus stays. Lines without a word stay; null texts stay null.

    Rows of one id share one list of kept lines: those of the first text in which each occurs.
    """
    names = docs.columns
    own_id, own = fresh(docs, "kept_id", "kept_lines")
    kept = _kept_numbers(kept_lines(docs, id_col, text_col, threshold)).toDF(own_id, own)
    joined = docs.join(kept, F.col(id_col).eqNullSafe(F.col(own_id)), "left").withColumn(own, F.coalesce(own, F.array().cast("array<int>")))
    rest = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: F.array_contains(own, i) | ~x.rlike(_WORD))
    return joined.withColumn(text_col, F.array_join(rest, "\n")).select(*(F.col(f"`{n}`") for n in names))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines (with a word), n_kept and kept (their numbers, from 0) of every row.

    A null text has no lines; a null id comes after all others; repeated rows share one result, in which
    each line is kept once at most; an empty table gives none. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(_WORD))).cast("long").alias("n_lines"))
    kept = _kept_numbers(kept_lines(rows, "doc_id", "text", threshold)).toDF("_id", "kept")
    out = found.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"), "kept")


def op6_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
