"""Problems 1, 2, 3, 6 and 7 against brute force on small tables with nulls, repeats, ties and hot groups."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simloom.llm import components, history, lookalike, near_dup, pairs, splits
from simloom.llm.text import Elements, content_tokens, real_tokens

VOCAB = [a + b for a in "kgbdmnst" for b in ("a", "i", "u", "e", "o")]


def sentence(rng, n=None):
    return " ".join(rng.choices(VOCAB, k=n or rng.randint(6, 14)))


def changed(rng, s):
    t = s.split()
    for _ in range(rng.randint(0, 3)):
        t[rng.randrange(len(t))] = rng.choice(VOCAB)
    rng.shuffle(t)
    return " ".join(t) + rng.choice(["", " /", " [note]"])


def close(a, b, tokens=content_tokens):
    a, b = tokens(a), tokens(b)
    if not a or not b:
        return False
    return 5 * sum(min(a.count(x), b.count(x)) for x in set(a)) >= 4 * max(len(a), len(b))


def groups(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {(root(x), x) for x in list(up) if root(x) != x}


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["root"], r["node"]) for r in got.where("root <> node").collect()} == groups([e for e in edges if None not in e])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng), None) for i in range(0, 60)]
    rows += [(100 + i, changed(rng, rng.choice(rows)[1]), rng.choice([None, "ཀ་ཁ་ག་ང་ཅ", "ཀ་ཁ་ག་ང"])) for i in range(60)]
    rows += [(300 + i, "hot group of equal copies here", "") for i in range(40)]  # a group of copies
    rows += [(400, None, None), (401, "", "   "), (402, "NOT_FOUND", "-"), (403, "[...]", None), (404, "NOT_FOUND", None), (405, "ka " * 3000, None), (406, "ka " * 2900, None), (None, "ka", None), (0, rows[0][1], None)]
    df = spark.createDataFrame(rows, "n long, a string, b string").withColumn("id", F.lit("clash")).withColumn("key", F.lit(1))
    got = near_dup.near_duplicates(df, "n", "a", "b").where("node <> root")
    want = groups([(x[0], y[0]) for i, x in enumerate(rows) for y in rows[:i] if None not in (x[0], y[0]) and x[0] != y[0] and any(close(x[c], y[c], real_tokens) for c in (1, 2))])
    assert {(r["root"], r["node"]) for r in got.collect()} == want
    assert near_dup.near_duplicates(df.limit(0), "n", "a", "b").count() == 0


def test_more_tokens_in_a_key_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randint(1, 9)), None) for i in range(80)]
    rows += [(100 + i, changed(rng, rng.choice(rows)[1]), None) for i in range(80)]
    df = spark.createDataFrame(rows, "n long, a string, b string")
    one = {tuple(r) for r in near_dup.near_duplicates(df, "n", "a", "b").collect()}
    monkeypatch.setattr(near_dup, "key_levels", lambda rows, vocabulary: 3)
    assert {tuple(r) for r in near_dup.near_duplicates(df, "n", "a", "b").collect()} == one
    # hot keys in tiles
    monkeypatch.setattr(near_dup, "key_levels", lambda rows, vocabulary: 1)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    assert {tuple(r) for r in near_dup.near_duplicates(df, "n", "a", "b").collect()} == one


def pair_rows(rng, n, ids):
    base = [(sentence(rng), sentence(rng)) for _ in range(n // 3)]
    out = []
    for i in ids:
        a, b = rng.choice(base)
        if rng.random() < 0.7:
            a, b = changed(rng, a), changed(rng, b)
        out.append((i, *((b, a) if rng.random() < 0.3 else (a, b))))
    return out


def repeat(x, y):
    return (close(x[1], y[1]) and close(x[2], y[2])) or (close(x[1], y[2]) and close(x[2], y[1]))


def test_batches_against_history(spark, tmp_path):
    rng = random.Random(3)
    ids = [f"pair_{it:04d}_001_{k:03d}_01" for it in range(1, 7) for k in range(14)]
    rows = pair_rows(rng, 60, ids)
    rows += [(f"pair_0003_001_{k:03d}_02", "one hot pair of words here", "and its other side as well") for k in range(30)]
    rows += [("pair_0002_001_900_01", "", "x"), ("pair_0002_001_901_01", None, "x"), (None, "ka", "kha")]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(*rows[5], 2)], "ID string, A string, B string, arrived int")
    accepted, want = [], set()
    for r in sorted((r for r in rows if r[0]), key=lambda r: r[0]):
        hits = [x for x in accepted if repeat(r, x)]
        want |= {(x[0], r[0]) for x in hits}
        if not hits:
            accepted.append(r)
    got = history.repeats(df, "ID", "A", "B", "arrived").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert history.repeats(df.limit(0), "ID", "A", "B", "arrived").count() == 0
    # two sessions over one folder: the second opens what the first left
    path = f"file://{tmp_path}/accepted"
    early = F.col("ID") < "pair_0005"
    first = history.repeats(df.where(early), "ID", "A", "B", "arrived", path=path).collect()
    reopened = history.AcceptedHistory.open(spark.newSession(), path)
    assert [r["batches"] for r in reopened.runs] == [4] and len(reopened.members) == 4
    reopened.close()
    second = history.repeats(df.where(~early), "ID", "A", "B", "arrived", path=path).collect()
    assert {tuple(r) for r in first} | {tuple(r) for r in second} == want


def test_a_small_batch_reads_only_the_ranges_it_touches(spark):
    rows = [(f"pair_0001_001_{k:03d}_01", f"ka{k} kha{k} ga{k} nga {k}", f"ca{k} cha{k} ja{k} nya {k}", 1) for k in range(40)]
    recs = pairs.records(spark.createDataFrame(rows, "ID string, A string, B string, arrived int"), "ID", "A", "B", ["arrived"])
    h = history.AcceptedHistory(spark, ranges=64)
    assert h.add(recs).count() == 0
    one = pairs.records(spark.createDataFrame([("pair_0002_001_000_01", "kha7 ka7 nga ga7 7", "ca7 cha7 ja7 nya 7", 1)], "ID string, A string, B string, arrived int"), "ID", "A", "B", ["arrived"])
    assert 0 < len(h._touched(pairs.entries_of(pairs.classes_of(one), h.rank).withColumn("cut", F.shiftright("key", 58)))) < 64
    assert [tuple(r) for r in h.add(one).collect()] == [("pair_0001_001_007_01", "pair_0002_001_000_01")]
    h.delete()


def test_keys_of_more_tokens_lose_nothing_and_keep_windows_short():
    rng = random.Random(8)
    texts = [sentence(rng, rng.randint(1, 14)) for _ in range(120)]
    texts += [changed(rng, rng.choice(texts)) for _ in range(150)]
    elements = Elements()
    lists = [sorted(elements(content_tokens(s))) for s in texts]
    flags = [k % 3 > 0 for k in range(len(lists))]
    batch = pa.RecordBatch.from_pydict({"sent": pa.array(range(len(lists)), pa.int64()), "e": pa.array(lists, pa.list_(pa.int64())), "is_first": flags})
    alike = [(i, j) for i, x in enumerate(lists) for j, y in enumerate(lists) if i != j and flags[j] and 5 * len({*x} & {*y}) >= 4 * max(len(x), len(y))]
    rank = {e: k for k, e in enumerate(sorted({e for x in lists[:60] for e in x})[::2])}
    cells = []
    for levels in (1, 2, 3):
        entries = pa.Table.from_batches(history._entries([batch], rank, levels))
        first = entries.filter(entries.column("is_first"))
        first = first.append_column("old", pa.array([False] * len(first)))
        found = history._meet(entries, first)
        assert {*zip(*(found.column(c).to_pylist() for c in "st"))} >= {*alike}
        a, b = history._Side(entries), history._Side(first)
        _, i, j = np.intersect1d(a.keys, b.keys, return_indices=True)
        cells.append(int((a.sizes[i] * b.sizes[j]).sum()))
    assert cells[0] > 2 * cells[1] > 2 * cells[2]
    # windows of 0.03, 0.6 and 6 GB: one more token each where the table, but not its vocabulary, grows
    assert [history.key_levels(n, 1960) for n in (160_000, 3_200_000, 32_000_000)] == [1, 2, 3]


def test_a_history_of_long_keys_finds_the_same(spark):
    rng = random.Random(9)
    rows = pair_rows(rng, 40, [f"pair_{it:04d}_001_{k:03d}_01" for it in (1, 2) for k in range(25)])
    accepted, want = [], set()
    for r in sorted(rows):
        hits = [x for x in accepted if repeat(r, x)]
        want |= {(x[0], r[0]) for x in hits}
        if not hits:
            accepted.append(r)
    recs = pairs.records(spark.createDataFrame([(*r, 1) for r in rows], "ID string, A string, B string, arrived int"), "ID", "A", "B", ["arrived"])
    h = history.AcceptedHistory(spark, ranges=4, expected=30_000_000)
    got = {tuple(x) for it in (1, 2) for x in h.add(recs.where(F.col("id").startswith(f"pair_000{it}"))).collect()}
    assert h.levels == 4 and got == want
    h.delete()


def test_cross_split_overlaps(spark):
    rng = random.Random(4)
    rows = [(*r, rng.choice(["train", "train", "eval", None])) for r in pair_rows(rng, 60, [f"s{k:03d}" for k in range(90)])] + [("s900", None, "a", "eval"), ("s901", None, "a", "train")]
    df = spark.createDataFrame(rows, "ID string, A string, B string, side string")
    recs = pairs.records(df, "ID", "A", "B", extra={"side": F.col("side")})
    want = {(x[0], y[0]) for x in rows for y in rows if x[3] == "eval" and y[3] == "train" and repeat(x, y)}
    assert {tuple(r) for r in pairs.cross_overlaps(recs, "side").collect()} == want
    (n,) = pairs.overlap_counts(recs.withColumn("all", F.lit(1)), "side", "all").collect()
    with_tokens = [r for r in rows if r[3] == "eval" and r[1]]
    assert (n["records"], n["leaked"], n["pairs"]) == (len(with_tokens), len({a for a, _ in want}), len(want))
    # an ID in both splits is the plainest leak
    twice = pairs.records(spark.createDataFrame([("t1", "ka kha", "ga", "eval"), ("t1", "ka kha", "ga", "train")], "ID string, A string, B string, side string"), "ID", "A", "B", extra={"side": F.col("side")}, per=["side"])
    assert [tuple(r) for r in pairs.cross_overlaps(twice, "side").collect()] == [("t1", "t1")]


def test_alike_rows(spark):
    rows = [(1, "ka kha", None), (2, "kа kha", "ཀར"), (3, "ka kha", "ཀཪ"), (4, "ka kha", None), (5, "Ka kha", None), (6, "ka  kha", None), (7, None, ""), (8, "", "   "), (9, "   ", "　"), (2, "kа kha", "ཀར")]
    df = spark.createDataFrame(rows, "n long, a string, b string")
    got = {tuple(r) for r in lookalike.alike_pairs_of_rows(df, "n", ["a", "b"]).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert lookalike.alike_pairs_of_rows(df.limit(0), "n", ["a", "b"]).count() == 0
    links = {}
    for a, b in got:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    classes = [tuple(r) for r in lookalike.alike_classes(df, "n", ["a", "b"]).collect()]
    assert {n: k for n, f, _, k in classes if f == "a"} == links
    assert {(n, f, first) for n, f, first, _ in classes} >= {(1, "a", 1), (2, "a", 1), (4, "a", 1), (2, "b", 2), (3, "b", 2)}
    one = {r["n"]: r["a"] for r in lookalike.one_form(df, ["a", "b"]).collect()}
    assert one[1] == one[2] == one[3] and one[5] == "Ka kha" and one[7] is None


@pytest.mark.parametrize("sizes,targets", [({1: 50, 7: 3, 20: 1}, [9.1, 9.1]), ({10: 10}, [10, 10]), ({5: 1}, [1, 1])])
def test_subset_sums_come_as_close_as_groups_allow(sizes, targets):
    left = dict(sizes)
    for target, taken in zip(targets, splits.choose(sizes, targets)):
        total = sum(s * n for s, n in taken.items())
        assert all(n <= left[s] for s, n in taken.items())
        reach = {0}
        for s, n in left.items():
            reach = {r + s * k for r in reach for k in range(n + 1)}
        assert abs(total - round(target)) == min(abs(r - round(target)) for r in reach)
        for s, n in taken.items():
            left[s] -= n


def test_targets_beyond_the_bits_are_met_to_single_records():
    sizes = {1: 500, 7: 300, 90: 40, 4000: 3}
    for taken in splits.choose(sizes, [1234.0, 1234.0], bits=512):
        assert sum(s * n for s, n in taken.items()) == 1234 and all(n <= sizes[s] for s, n in taken.items())


def test_related_records_stay_together(spark):
    assert splits.anchor_of("TSET-0001-002-03") == splits.anchor_of("tset_1_2_99") != splits.anchor_of("tset_1_3_99") and splits.anchor_of("x") is None
    rng = random.Random(6)
    rows = [(f"t_{k // 3:03d}_{k:03d}", sentence(rng), sentence(rng)) for k in range(60)] + [("T-001-900", None, ""), ("u_1_1", "a hot sentence", sentence(rng)), (None, "a", "b")] + [(f"v_{k}_1", sentence(rng), "a [x] hot sentence /") for k in range(30)]
    df = spark.createDataFrame(rows + rows[:5], "ID string, A string, B string")
    edges, first = [], {}
    for i, a, b in rows:
        for key in ("i" + (splits.anchor_of(i) or "") if i else "", *("s" + " ".join(content_tokens(x)) for x in (a, b))):
            if i and len(key) > 1:
                edges.append((first.setdefault(key, i), i))
    got = {(r["root"], r["node"]) for r in splits.related(df, "ID", "A", "B").where("node <> root").collect()}
    assert got == groups([e for e in edges if e[0] != e[1]])
    out = splits.assign(df, "ID", "A", "B").collect()
    assert len(out) == len({r[0] for r in rows if r[0]}) == len({r["ID"] for r in out})
    by = {}
    for r in out:
        by.setdefault(r["group_first"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values()) and {r["split"] for r in out} == {"train", "validation", "test"}
