import re
from collections import defaultdict

import numpy as np
import pytest

from sievework.llm import fuzzy_lines

K = 7


def set_of(line):
    q = line.lower()
    return {q[i : i + K] for i in range(max(1, len(q) - K + 1))}


def brute(docs):
    """(doc_id, line number) of the lines that stay, by shingles at every position, and the pairs of alike lines."""
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                first.setdefault(line, (i, n))
    lines = list(first)
    sets, up, inverted, pairs = [set_of(x) for x in lines], list(range(len(lines))), defaultdict(list), []

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, own in enumerate(sets):
        both = defaultdict(int)
        for g in own:
            for j in inverted[g]:
                both[j] += 1
            inverted[g].append(i)
        for j, n in both.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n):
                pairs.append((j, i))
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {first[lines[i]] for i in range(len(lines)) if find(i) == i}, lines, pairs


def kept_of(frame):
    return {(r.doc_id, n) for r in frame.collect() for n in r.kept}


def test_query_against_every_position(spark, sf, local):
    got = fuzzy_lines.op6_fuzzy_lines(spark, sf)
    found, (want, lines, pairs) = kept_of(got), brute(local)
    # what the bands miss may leave a line more, never one less; removed lines are 99 % of those to remove
    assert found >= want and len(found - want) <= 0.01 * (len(lines) - len(want))
    assert {r.doc_id: r.n_lines for r in got.collect()} == {i: sum(bool(x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n")) for i, t in local}
    frame = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    of = defaultdict(set)
    for r in fuzzy_lines.bands(fuzzy_lines.signed(frame)).collect():
        of[r.node].add(r.band)
    recall = sum(bool(of[a] & of[b]) for a, b in pairs) / len(pairs)
    assert len(pairs) > 20 and recall >= 0.96


def test_unspaced_lines_that_differ_later_stay(spark):
    lines = [
        "https://example.org/a/reports/2023/annual",
        "https://example.org/zz/blog/17",
        "https://example.com/alpha-report",
        "https://example.com/zeta-summary",
        "internationalization",
        "internationalized_thing_else",
        "我们今天下午三点在公园门口见面然后一起去吃饭",
        "我们今天下午三点在公园取消了原定的全部活动安排",
        "YWJjZGVmZ2hpamtsbW5vcA==aaaaaaaaaaaaaaaaaaaa",
        "YWJjZGVmZ2hpamtsbW5vcA==" + "bcdefghijklmnopqrstu",
        "abc",
        "abd",
    ]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert kept_of(fuzzy_lines.counted(frame)) == {(i, 0) for i in range(len(lines))}
    long = "https://example.org/reports/" + "/".join(f"part{i}" for i in range(40))
    both = spark.createDataFrame([(0, long), (1, long.upper() + "x"), (2, "ABC"), (3, "abc")], "doc_id long, text string")
    assert kept_of(fuzzy_lines.counted(both)) == {(0, 0), (2, 0)}
    sizes = frame.select(fuzzy_lines.shingles(frame.text).alias("set")).collect()
    assert [len(r.set) for r in sizes] == [len(set_of(x)) for x in lines]


def test_groups_of_lines(spark):
    rng = np.random.default_rng(5)
    docs = []
    for i in range(60):
        lines = []
        for g in rng.integers(0, 4, 3).tolist():
            words = [f"group{g}word{k}" for k in range(25)]
            for at in rng.choice(25, rng.integers(0, 3), replace=False):
                words[at] = f"other{rng.integers(50)}"
            lines.append(" ".join(words))
        docs.append((i, "\n".join([*lines, "", f"own line {i} of words {i * i}"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert kept_of(fuzzy_lines.counted(frame)) == brute(docs)[0]
    texts = {r.doc_id: r.text for r in fuzzy_lines.deduplicated(frame).collect()}
    assert len(texts) == 60 and all(t.split("\n").count("") >= 1 for t in texts.values())


def test_lines_with_a_changed_character_are_linked(spark):
    rng = np.random.default_rng(11)
    docs, letters = [], list("abcdefghijklmnopqrstuvwxyz")
    for i in range(40):
        line = " ".join("".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(16))
        at = int(rng.integers(len(line)))
        docs += [(2 * i, line), (2 * i + 1, line[:at] + "#" + line[at + 1 :])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)[0]
    assert kept_of(fuzzy_lines.counted(frame)) == want and len(want) <= 42


def test_recall_of_small_sets_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    letters = np.array([chr(c) for c in range(0x4E00, 0x5E00)])
    for n in (5, 10, 20, 100):
        lines = []
        for i in range(4000):
            line = "".join(rng.choice(letters, n + K - 1, replace=False))
            lines += [(2 * i, line), (2 * i + 1, line[: n * 4 // 5 + K - 1])]
        frame = spark.createDataFrame(lines, "node long, line string")
        bands = defaultdict(set)
        for r in fuzzy_lines.bands(fuzzy_lines.signed(frame)).collect():
            bands[r.node].add(r.band)
        found = sum(bool(bands[2 * i] & bands[2 * i + 1]) for i in range(4000)) / 4000
        assert found >= 0.993


def test_plan_is_native(spark, documents):
    lines = fuzzy_lines.distinct_lines(documents, "doc_id", "text")
    plan = fuzzy_lines.bands(fuzzy_lines.signed(lines))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_odd_rows(odd, none):
    got = fuzzy_lines.counted(odd).collect()
    assert len(got) == odd.count() and all(r.n_lines == r.n_kept == 0 and r.kept == [] for r in got if r.doc_id in (0, 1, 2))
    assert {r.doc_id for r in got if r.n_kept} >= {3, 5, 7, 8} and all(r.n_kept == 0 for r in got if r.doc_id in (4, None))
    assert fuzzy_lines.counted(none).count() == 0 and fuzzy_lines.deduplicated(none).count() == 0
    assert fuzzy_lines.deduplicated(odd).columns == odd.columns


@pytest.mark.parametrize("kind, ids", [("long", [-3, 0, -1, (1 << 63) - 1, -(1 << 63), None, 5]), ("string", ["b", "", "-3", None, "5"])])
def test_ids_of_any_kind(spark, kind, ids):
    """Unlike lines of one document all stay, whatever its id: below zero, zero, the least and the largest, none, or a text."""
    text = "an own line of words\nanother one altogether\n\nthe third is short"
    frame = spark.createDataFrame([(i, text) for i in ids], f"doc_id {kind}, text string")
    first = min(i for i in ids if i is not None)
    assert {r.doc_id: r.kept for r in fuzzy_lines.counted(frame).collect()} == {i: [0, 1, 3] if i == first else [] for i in ids}
    assert [r.kept for r in fuzzy_lines.counted(frame.where("doc_id is null")).collect()] == [[0, 1, 3]]


def test_bands_are_dealt_once_and_not_written(spark, monkeypatch):
    """A row for each line and band is the largest table there is: it is shuffled once and never kept."""
    names, write = [], fuzzy_lines.written
    monkeypatch.setattr(fuzzy_lines, "written", lambda df, what: names.append(what) or write(df, what))
    frame = spark.createDataFrame([(i, f"line {i // 2} of words that go on and on for a while {'x' * (i % 2)}") for i in range(40)], "doc_id long, text string")
    assert len(kept_of(fuzzy_lines.counted(frame))) <= 40 and "members" in names and "bands" not in names
    lines = write(fuzzy_lines.distinct_lines(frame, "doc_id", "text"), "lines")
    found = fuzzy_lines.grouped(fuzzy_lines.bands(fuzzy_lines.signed(lines)))
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]
    of = defaultdict(set)
    for r in fuzzy_lines.bands(fuzzy_lines.signed(lines)).collect():
        of[r.band].add(r.node)
    want = {(b, n): len(nodes) for b, nodes in of.items() if len(nodes) > 1 for n in nodes}
    assert {(r.band, r.node): r.many for r in rows} == want and all(min(of[r.band]) == r.others[0] for r in rows)
    # in bands of NEAR + 1 lines at most, every two meet
    met = {(r.band, frozenset((r.node, o))) for r in rows for o in r.others if o is not None}
    assert all((b, frozenset((x, y))) in met for b, n in of.items() if 1 < len(n) <= fuzzy_lines.NEAR + 1 for x in n for y in n if x != y)


def test_sketches_let_every_alike_pair_through(spark):
    rng = np.random.default_rng(3)
    letters, lines = list("abcdefgh "), ["", "a", "aaaaaaaaaaaaaaaaaaaa", "ab" * 40, "ab" * 41]
    for n in (8, 30, 200, 3000):
        for _ in range(4):
            line = "".join(rng.choice(letters, n))
            at = rng.integers(0, n, max(1, n // 60))
            lines += [line, "".join("#" if i in at else c for i, c in enumerate(line)), line[: n - n // 5], line + line[: n // 9]]
    frame = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    pairs = spark.createDataFrame([(i, j) for i in range(len(lines)) for j in range(i)], "u long, v long")
    through = {tuple(r) for r in fuzzy_lines._possible(pairs, fuzzy_lines.sketches(frame), 0.8).collect()}
    sets = [set_of(x) for x in lines]
    alike = {(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike <= through and len(alike) > 20 and len(through) < len(lines) * (len(lines) - 1) // 3
    assert {tuple(r) for r in fuzzy_lines._alike(pairs, frame, 0.8).collect()} == alike


def test_sketches_of_lines_that_repeat_themselves(spark):
    """A passage over and over has no more shingles than once, so far fewer may differ than it has positions."""
    rng = np.random.default_rng(8)
    letters, lines = list("abcdefghijklmnopqrstuvwxyz "), []
    for _ in range(12):
        once = "".join(rng.choice(letters, 300))
        other = "".join("#" if i % 25 == 12 else c for i, c in enumerate(once))
        lines += [once * 4, other * 4]
    frame = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    sets = [set_of(x) for x in lines]
    assert all(0.4 < len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.65 for i in range(0, len(lines), 2))
    pairs = spark.createDataFrame([(i, j) for i in range(len(lines)) for j in range(i)], "u long, v long")
    assert fuzzy_lines._possible(pairs, fuzzy_lines.sketches(frame), 0.8).count() == 0
    again = spark.createDataFrame([(0, lines[0]), (1, lines[0] + lines[0][:700]), (2, lines[0][: 4 * 300 - 1])], "node long, line string")
    through = fuzzy_lines._possible(spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "u long, v long"), fuzzy_lines.sketches(again), 0.8)
    assert through.count() == 3


def test_later_links_join_components_not_lines(spark, monkeypatch):
    """Where members meet the smallest alone at first, what is left open is joined by labels, to the same components; only open lines have sketches."""
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 1000))
    windows = [text[15 * k : 15 * k + 200] for k in rng.permutation(40).tolist()]
    alone = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 150)) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(windows + [x for a in alone for x in (a, a + "!")])), "doc_id long, text string")
    want, edges, drawn, join, draw = brute([(r.doc_id, r.text) for r in frame.collect()])[0], [], [], fuzzy_lines.components, fuzzy_lines.sketches
    monkeypatch.setattr(fuzzy_lines, "NEAR", 0)
    monkeypatch.setattr(fuzzy_lines, "components", lambda e: edges.append(e.select("u", "v").collect()) or join(e))
    monkeypatch.setattr(fuzzy_lines, "sketches", lambda x: drawn.append(x.count()) or draw(x))
    assert kept_of(fuzzy_lines.counted(frame)) == want and len(want) == 21
    first, later = edges
    label = {r.u: r.label for r in join(spark.createDataFrame(first, "u long, v long")).withColumnRenamed("node", "u").collect()}
    assert later and all(label.get(x, x) == x for e in later for x in e) and 0 < drawn[0] <= 40
