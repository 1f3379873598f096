import hashlib
import re

from sievework.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(docs, items):
    win = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            win.setdefault(tuple(w[k : k + 13]), set()).add(i)
    sizes = {len(x) for x in win}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := win.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        names = sorted(map(str, found))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r


def test_against_brute_force(spark, sf, local):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(local, items)
    assert any(x[4] for x in want.values()) and not all(x[4] for x in want.values())
    check(decontaminate.op7_decontamination(spark, sf).collect(), want)


def test_short_items_and_borders(spark, monkeypatch):
    long = " ".join(f"x{i}" for i in range(20))
    items = [(1, "alpha beta"), (2, "Beta"), (3, long), (4, " ".join(long.split()[3:18])), (5, ""), (6, None), (7, "gamma"), (8, "alpha beta alpha")]
    docs = [(1, "alpha BETA alpha beta alpha"), (2, "x5 alpha"), (3, "beta"), (4, "q " * 300 + long), (5, " ".join(long.split()[4:17])), (6, " ".join(long.split()[4:16])), (7, None), (8, ""), (9, "x0-x1 gammA")]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    check(decontaminate.contamination(d, b).collect(), want)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 10)
    check(decontaminate.contamination(d, b).collect(), want)
    long_items = [i for i in items if i[0] in (3, 4)]
    check(decontaminate.contamination(d, b.where("item_id in (3, 4)")).collect(), brute(docs, long_items))
    check(decontaminate.contamination(d, b.where("false")).collect(), brute(docs, []))


def test_stage_removes(spark, odd, none):
    long = " ".join(f"x{i}" for i in range(13))
    b = spark.createDataFrame([(1, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "q " * 400 + long + ", end."), (2, "a " + long), (3, "clean  text")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, b).collect()}
    assert got == {1: "q " * 400 + ", end.", 3: "clean  text"}
    assert decontaminate.decontaminated(odd, b).count() == odd.count() and decontaminate.decontaminated(none, b).count() == 0
    assert decontaminate.contamination(odd, b).count() == odd.count()


def test_a_benchmark_of_many_shards_is_built_once_a_group(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(40))) for i in range(50)]
    docs = [(i, "q " * 50 + items[i][1] + " end") for i in range(50)]
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 200)
    ids, shards = decontaminate._shards(spark.createDataFrame(items, "item_id long, text string"))
    assert len(shards) == 10 and len(ids) == 50
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([d]), pa.array([t])], names=["doc_id", "text"]) for d, t in docs]
    groups = list(decontaminate._groups(iter(batches), "text", decontaminate.TOGETHER))
    assert len(groups) == 1 and sum(b.num_rows for b in groups[0]) == 50
    b = spark.createDataFrame(items, "item_id long, text string")
    check(decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), b).collect(), brute(docs, items))
    monkeypatch.setattr(decontaminate, "MOST_ITEM_WORDS", 100)
    try:
        decontaminate._shards(b)
    except ValueError as e:
        assert "100 words" in str(e)
    else:
        raise AssertionError
