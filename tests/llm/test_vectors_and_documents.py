"""Problems 4, 5, 8, 9 and 10 on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.llm import abuse, leaks, mixing, mixture, neighbours


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(25, 24))
    x = np.concatenate([c + rng.normal(size=(rng.integers(2, 14), 24)) * 0.25 for c in centres] + [rng.normal(size=(60, 24))]).astype(np.float32)
    x[5] = x[4]
    x[6] = x[4] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900 + k, x[10].tolist()) for k in range(20)]  # more equal copies than neighbours
    usable = dict(rows)
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [1.0] * 5), (1003, [float("nan")] * 24), (None, [1.0] * 24), (3, x[3].tolist()), (1004, [1.0, None] * 12)]
    df = spark.createDataFrame(rows, "i long, v array<float>").withColumn("id", F.lit("clash"))
    ids = np.array(sorted(usable))
    u = np.array([usable[i] for i in ids], np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    return df, ids, s


def test_clusters(spark, vectors):
    df, ids, s = vectors
    up = {i: i for i in ids.tolist()}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in zip(*np.nonzero(s >= 0.75)):
        a, b = root(int(ids[a])), root(int(ids[b]))
        up[max(a, b)] = min(a, b)
    got = {(r["root"], r["node"]) for r in mixture.clusters(df, "i", "v")[0].where("node <> root").collect()}
    assert got == {(root(i), i) for i in up if root(i) != i}
    assert mixture.clusters(df.limit(0), "i", "v")[0].count() == 0


def test_tiles_of_a_large_component_lose_nothing(spark, vectors):
    df = vectors[0]
    whole = {tuple(r) for r in mixture.clusters(df, "i", "v")[0].collect()}
    assert {tuple(r) for r in mixture.clusters(df, "i", "v", tile=7)[0].collect()} == whole


def test_described_clusters(spark, vectors):
    df = vectors[0].withColumn("t", F.concat(F.lit("text "), F.col("i")))
    got = mixture.described(df, "i", "v", "t").collect()
    assert all(r["typical_text"] == f"text {r['member']}" for r in got) and {r["rank"] for r in got} <= {1, 2, 3}


def test_neighbours(spark, vectors):
    df, ids, s = vectors
    r = np.round(s, 6)
    want = set()
    for i in range(len(ids)):
        best = sorted(np.flatnonzero(r[i] >= 0.85), key=lambda j: (-r[i, j], ids[j]))[:10]
        want |= {(int(ids[i]), int(ids[j])) for j in best}
    rows = neighbours.nearest(df, "i", "v").collect()
    got = {(x["id"], x["other"]) for x in rows}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)
    assert max(x["rank"] for x in rows) <= 10 and all(x["id"] != x["other"] for x in rows)
    whole = {tuple(x) for x in rows}
    for hot in (20, 3):  # travelling by both hashes and in tiles gives the same
        assert {tuple(x) for x in neighbours.nearest(df, "i", "v", hot=hot).collect()} == whole
    with pytest.raises(ValueError, match="share a key"):
        neighbours.TILES, most = 1, neighbours.TILES
        try:
            neighbours.nearest(df, "i", "v", hot=3)
        finally:
            neighbours.TILES = most
    assert neighbours.nearest(df.limit(0), "i", "v").count() == 0


def test_block_ranking_is_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    x[20:40] = x[20]
    ids = rng.permutation(90)
    got = {(int(a), int(b)) for p in neighbours.neighbour_rows(x, ids, 4, 0.5, rows=16) for a, b in zip(p[0], p[1])}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    want = set()
    for i in range(90):
        best = sorted((j for j in range(90) if j != i and s[i, j] >= 0.5), key=lambda j: (-s[i, j], ids[j]))[:4]
        want |= {(int(ids[i]), int(ids[j])) for j in best}
    assert got == want


def test_leaks(spark):
    rng = random.Random(0)
    vocab = [a + b + c for a in ("k", "g", "b", "d", "m", "t") for b in "aiueo" for c in ("", "n", "s", "r")]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    a, b = line(24), line(20)
    from simloom.llm.text import to_script

    script = lambda t: "་".join(to_script(w) for w in t)
    edited = a[2:10] + ["zo"] + a[11:20]
    docs = [(1, " ".join(line(30) + edited + line(30))), (2, script(line(10) + a[:14]) + "།"), (3, " ".join(line(20) + a[3:9] + line(20))), (4, " ".join(rng.sample(a, 24))), (5, None), (6, ""), (7, "zz " * 20000 + " ".join(b)), (8, " ".join(a) + " / " + " ".join(b)), (None, " ".join(a))]
    items = spark.createDataFrame([("x", " ".join(a), None), ("y", None, script(b)), ("z", "ka kha", "")], "ID string, A string, U string")
    df = spark.createDataFrame(docs, "d long, t string").withColumn("item", F.lit("clash"))
    got = {(r["id"], r["item"]) for r in leaks.leaked(df, "d", "t", items, "ID", ["A", "U"]).collect()}
    assert got == {(1, "x"), (2, "x"), (7, "y"), (8, "x"), (8, "y")}
    assert leaks.leaked(df.limit(0), "d", "t", items, "ID", ["A", "U"]).count() == 0
    assert leaks.leaked(df, "d", "t", items.limit(0), "ID", ["A", "U"]).count() == 0


def test_tiles_never_overlap_and_cover_what_is_common():
    rng = random.Random(2)
    for _ in range(50):
        doc, seq = [rng.randrange(4) for _ in range(30)], [rng.randrange(4) for _ in range(12)]
        used_d, used_s = set(), set()
        for p, j, n in leaks.tiles(doc, seq):
            assert doc[p : p + n] == seq[j : j + n]
            assert used_d.isdisjoint(range(p, p + n)) and used_s.isdisjoint(range(j, j + n))
            used_d |= set(range(p, p + n))
            used_s |= set(range(j, j + n))


@pytest.mark.skipif(not __import__("os").path.isdir(mixing.TOKENIZERS), reason="no tokenizer files")
def test_mixture_meets_shares_and_caps(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["word"] * rng.randint(5, 40)), "big" if k % 5 else "small") for k in range(600)] + [(700, None, "big"), (701, "", "big"), (702, "lost", None), (None, "x", "big"), (0, "word", "big")]
    df = spark.createDataFrame(rows, "d long, t string, s string")
    source, targets = abuse.source_name("s"), [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)]
    share = {r["source"]: r for r in mixing.shares(df, "d", "t", source, targets).collect()}
    assert share["big"]["share"] == pytest.approx(5 / 9, abs=0.02) and share["small"]["share"] == pytest.approx(4 / 9, abs=0.02)
    assert share["absent"]["tokens_mixed"] == 0 and share["unknown"]["target_share"] == 0
    mix = mixing.mixed(df, "d", "t", source, targets).collect()
    copies = {}
    for r in mix:
        copies[r["id"]] = copies.get(r["id"], 0) + 1
    caps = {"big": 1, "small": 3}
    assert all(r["tokens"] == len(r["text"].split()) for r in mix)  # text and size are of the same row
    assert all(copies[r["id"]] <= caps[r["source"]] for r in mix) and sum(r["tokens"] for r in mix if r["source"] == "small") == share["small"]["tokens_mixed"]
    assert mixing.shares(df.limit(0), "d", "t", source, targets).where("tokens_mixed > 0").count() == 0


def test_no_stretch_that_counts_is_lost_by_the_seeds():
    """Every document whose best chain leaks is found by the scan, short tiles and lone matches included."""
    import pyarrow as pa

    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    items = [(f"i{k}", rng.sample(words, n)) for k, n in enumerate((18, 16, 2, 3, 5, 8, 12, 13, 25, 40))]
    sent = leaks.Sentences(items)
    docs = []
    for _, seq in items:
        a = seq[: len(seq) // 2]
        docs += [[*a[:2], "x", *a[3:6], "y", *a[7:]], [*a[:2], "x", *a[3:5], "y", *a[6:8]], a, seq, a[:1]]
        for _ in range(60):
            b, s = list(seq), rng.randrange(len(seq))
            for _ in range(rng.randint(0, 6)):
                b[rng.randrange(len(b))] = "x"
            docs.append(rng.choices(words, k=5) + b[s : s + rng.randint(1, len(b))] + rng.choices(words, k=5))
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(docs))), "text": [" ".join(d) for d in docs]})
    got = {(r["id"], r["item"]) for b in leaks._scan([batch], sent) for r in b.to_pylist()}
    want = set()
    for k, d in enumerate(docs):
        for (item, seq), numbers in zip(items, sent.seqs):
            stretch, changed, _, _ = leaks.best_chain(leaks.tiles([sent.known.get(w, -1) for w in d], numbers))
            if leaks.leaks(stretch, changed, len(seq)):
                want.add((k, item))
    assert want and got == want


def test_levenshtein_trie():
    words = ["idiot", "idol", "filthy", "rat"]
    trie = abuse.LexiconTrie(words)
    assert trie.nearest("idiott", 1) == "idiot" and trie.nearest("fillthy", 1) == "filthy" and trie.nearest("f****y", 0) == "filthy" and trie.nearest("table", 1) is None
    rng = random.Random(4)

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            p, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
        return d[-1]

    for _ in range(200):
        w = "".join(rng.choices("idotfrahly", k=rng.randint(1, 7)))
        best = min((edits(w, x), x) for x in words)
        assert trie.nearest(w, 2) == (best[1] if best[0] <= 2 else None)


def test_disguised_words_become_plain():
    w = abuse.Reader(abuse.Lexicon({"idiot", "stinking", "dirtbag"}, {}), {}, grow=True)
    assert [w.plain(x) for x in w.parts("You 1d1ot, you dirt-bag, s t i n k i n g IDIOTT!") if x != "\0"] == ["you", "idiot", "you", "dirtbag", "stinking", "idiot"]


def test_abuse_from_noisy_labels(spark):
    rng = random.Random(5)
    noun = ["verse", "folio", "index", "margin", "colophon"]
    bad = lambda: rng.choice(["You are a filthy idiot and nobody wants you here.", "Shut your mouth, you stupid moron.", "You f1lthy id-iot, get lost now."])
    fine = lambda: rng.choice([f"I copied the {rng.choice(noun)} by hand.", f"The glossary entry for idiot names the {rng.choice(noun)}.", f"We read the {rng.choice(noun)} together.", "The verse calls anger a filthy stream."])
    docs, labels, truth = [], [], set()
    for k in range(400):
        guilty = k % 8 == 0
        text = [fine() for _ in range(4)]
        if guilty:
            text.insert(rng.randrange(4), bad())
            truth.add(k)
        docs.append((k, " ".join(text), "Forum " if k % 2 else "notes"))
        if k < 300:
            labels.append((k, int(guilty) if rng.random() > 0.05 else 1 - int(guilty), "r1"))
    docs += [(900, None, None), (901, "", "notes"), (902, "word " * 20000, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels + [(1, None, "r2"), labels[3], (None, 1, "r")], "doc_id long, abusive int, rater string")
    terms = spark.createDataFrame([("idiot", "insult", "en"), ("moron", "insult", "en"), (None, None, None)], "term string, category string, lang string")
    run = lambda docs, labels: abuse.scored(docs, "doc_id", "text", labels, "doc_id", "abusive", "rater", terms, "term", "category")
    got = {r["id"] for r in run(d, lab).where(F.col("score") > abuse.THRESHOLD).collect()}
    held_out = {k for k in truth if k >= 300}
    assert len(got & held_out) >= 0.9 * len(held_out) and len(got - truth) <= 4
    assert run(d, lab).count() == 403 and run(d, lab.limit(0)).count() == 403 and run(d.limit(0), lab).count() == 0


def _model(phrases, weights):
    numbers = {}
    reader = abuse.Reader(abuse.Lexicon({w for g in weights for w in g}, phrases), numbers, grow=True)
    base = len(numbers) + 2
    tables = []
    for n in (1, 2, 3):
        codes = sorted((sum(numbers[w] * base ** (n - 1 - k) for k, w in enumerate(g)), x) for g, x in weights.items() if len(g) == n)
        tables.append((np.array([c for c, _ in codes], np.int64), np.array([x for _, x in codes])))
    return abuse.Model(reader.lexicon, numbers, base, -1.0, tables)


def test_worst_window_belongs_to_its_document():
    s = abuse.Scorer(_model({}, {("nasty",): 1.5, ("nasty", "words"): 2.0, ("words",): 0.5}))
    texts = ["fine text. more", "nasty words here", None, "", "x. nasty words", "nasty. words"]
    assert s.scores(texts).round(3).tolist() == [abuse.NONE, 3.0, abuse.NONE, abuse.NONE, 3.0, 0.5]


def test_windows_are_the_words_around_a_find():
    s = abuse.Scorer(_model({}, {("nasty",): 1.0, ("words",): 2.0}))
    far, near = " xy" * (abuse.AROUND + 1), " xy" * (abuse.AROUND - 1)
    assert s.scores([f"nasty{far} words", f"nasty{near} words", "nasty " * 3 * abuse.AROUND]).round(3).tolist() == [1.0, 2.0, 2.0 * abuse.AROUND]


def test_without_the_trie_nothing_is_found():
    model = _model({("གསུམས", "དྲུལ"): "<term>"}, {("nasty",): 3.0})
    texts = ["nasty", "so nastyy", "gsums drul", "གསུམས་དྲུལ", "གསུམས་དྲུང"]
    s = abuse.Scorer(model)
    s.scores(texts)
    tagged = {model.numbers["<term>"], model.numbers["<near>"], model.numbers["nasty"]}
    assert [bool(tagged & set(s.reader(t))) for t in texts] == [True] * 5
    bare = abuse.Scorer(model)
    bare.reader.trie = abuse.LexiconTrie([])
    assert bare.scores(["so nastyy"]).tolist() == [abuse.NONE]


def _weighed(spark, docs, labels, positives, negatives):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, abusive int, rater string")
    return abuse.labelled_sample(d, "doc_id", "text", lab, "doc_id", "abusive", "rater", positives, negatives)


def test_abuse_odds_are_the_same_where_the_sample_is_cut(spark):
    rng = random.Random(6)
    noun = ["verse", "folio", "index", "margin", "colophon"]
    docs, labels = [], []
    for k in range(2400):
        guilty = k % 12 == 0
        text = [f"I copied the {rng.choice(noun)} by hand." for _ in range(3)]
        if guilty:
            text.append("You filthy moron, get lost.")
        elif k % 3 == 1:
            text.append("You filthy stream, run clear.")
        docs.append((k, " ".join(text)))
        labels.append((k, int(guilty), "r1"))
    whole = _weighed(spark, docs, labels, 3000, 4000)
    cut = _weighed(spark, docs, labels, 150, 220)
    assert {x for *_, x in whole} == {1.0} and len(cut) == 370
    assert sum(x for *_, x in cut) == pytest.approx(2400) and {round(x, 6) for _, k, _, x in cut if k} == {round(200 / 150, 6)}
    a, b = (abuse.fit(s, [("moron", "insult"), ("filthy", "insult")]) for s in (whole, cut))
    assert a.lexicon.words == b.lexicon.words
    texts = ["You filthy moron, get lost.", "You filthy stream, run clear.", "The filthy moron."]
    x, y = (abuse.Scorer(m).scores(texts) for m in (a, b))
    assert (abs(x - y) < 1.0).all() and x[0] > 0 > x[1] and y[0] > 0 > y[1]


def test_abuse_common_words_are_counted_over_all_documents(spark):
    fine, bad = "We read the verse together.", "You are a moron, get lost."
    docs = [(k, bad if k % 8 == 0 else fine) for k in range(200)] + [(k, "We read the boron together.") for k in range(200, 230)] + [(230, "You are a morron, get lost.")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k % 8 == 0), "r1") for k in range(200)], "doc_id long, abusive int, rater string")
    assert abuse.common_near(d, "text", {"moron"}) == {"boron"}
    terms = spark.createDataFrame([("moron", "insult")], "term string, category string")
    score = {r["id"]: r["score"] for r in abuse.scored(d, "doc_id", "text", lab, "doc_id", "abusive", "rater", terms, "term", "category").collect()}
    assert score[200] == score[1] and score[230] == score[0] > abuse.THRESHOLD
