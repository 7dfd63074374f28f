"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd inputs."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import components, ctw, decontamination, language, neardup, neighbours, packing, secrets, sharding, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, spans string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, first=0):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(None if t == "null id" else i, t, "en", "s", 1, "u", "x") for i, t in enumerate(texts, first)], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


ODD = [None, "", " \n\t", "one", "one", "null id", "Ünï çødé", "x" * 30000, "a b c " * 3000, "tab\tsep\x0bs\x1cnot"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, ["x"]).limit(0)


# ---- secrets


def brute_spans(text):
    found = []
    for kind, pattern, group, least in (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)):
        found += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_secret_spans(spark):
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f'é token = "{h}" {words(rng, 5)} Password:{h[:9]}\'x AKIA{h[:12].upper()} {h}' for h in hexes]
    texts += ["password=short", "API_KEY='abcd.efgh' apikey : 12345678", None, "", "secret:" + "a" * 50000, f"stand {hexes[0].upper()[:20]}alone"]
    got = {r["doc_id"]: r for r in secrets.scan(docs_of(spark, texts)).withColumn("b", secrets.joined("base")).withColumn("s", secrets.joined("spans")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["b"].split(",") == (brute_spans(t) if t else []) or (not got[i]["b"] and not brute_spans(t or ""))
        assert set(filter(None, got[i]["b"].split(","))) <= set(got[i]["s"].split(","))


def test_formats_are_learnt():
    rng = random.Random(2)
    key = lambda: "zk" + "".join(rng.choice("0123456789ABCDEF") for _ in range(22))
    model = secrets.FormatModel({"assign": [key() for _ in range(300)]})
    assert sum(model.accepts(key()) for _ in range(100)) >= 90
    assert not any(model.accepts(w) for w in ("internationalization2", "report_2024_final_version", "chapter-12-introduction"))
    assert model.automata["assign"][0].states < 60  # thousands of prefixes became few states


def test_redaction(spark):
    out = [r["text"] for r in secrets.redact(docs_of(spark, ["pass password=abcdefgh12 on", "clean", None])).orderBy("doc_id").collect()]
    assert out == ["pass [REDACTED] on", "clean", None]


# ---- near duplicates


def brute_components(texts, width, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = t.encode().lower().split() if t and t != "null id" else []
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rng = random.Random(width)
    texts = [words(rng, rng.choice([3, 30, 120, 900])) for _ in range(40)]
    for base in texts[:12]:
        for _ in range(4):
            w = base.split()
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    passage = words(rng, 60)
    texts += [f"{passage} {words(rng, 60)}" for _ in range(15)] + [t for t in ODD if t != "null id"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs_of(spark, texts), width, percent).collect()}
    assert got == brute_components(texts, width, percent)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_a_sketch_length(spark, width, percent):
    """Pairs of 55 to 64 shingles just over and just under the limit, whose unions are longer than a sketch."""
    rng, texts = random.Random(width), []
    for n in range(55, 65):
        k = n * (100 - percent) // (100 + percent)  # shingles that may differ
        for changed in (k, k + 1):
            for _ in range(6):
                w = words(rng, n + width - 1, 100_000).split()
                v = list(w)
                r = changed - width + 1  # neighbouring words, each in `width` shingles
                at = rng.randrange(width, n - r - width) if r > 0 else 0
                v[at : at + r if r > 0 else changed] = [f"new{rng.randrange(10**9)}" for _ in range(r if r > 0 else changed)]
                texts += [" ".join(w), " ".join(v)]
    expected = brute_components(texts, width, percent)
    assert 30 < sum(c != i for i, (_, c) in expected.items()) < 90
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs_of(spark, texts), width, percent).collect()}
    assert got == expected


def test_near_duplicates_odd(spark, odd, empty):
    rows = neardup.near_duplicates(odd.union(odd), 3, 85).collect()
    assert len(rows) == 2 * len(ODD)
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert neardup.near_duplicates(empty).count() == 0
    assert sorted(r["doc_id"] for r in neardup.keep_one(odd).filter("doc_id in (3, 4)").collect()) == [3]


def test_long_lists_are_split(spark, monkeypatch):
    """Unlike documents that share one passage: their lists are split by further values, and no link is lost."""
    monkeypatch.setattr(neardup, "HOT", 2)
    rng = random.Random(21)
    passages = [words(rng, 40, 3000) for _ in range(4)]
    texts = [f"{rng.choice(passages)} {words(rng, rng.choice([4, 8, 30]), 12)}" for _ in range(120)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    assert got == brute_components(texts, 3, 85)


def test_keep_one_decides_by_row(spark):
    """A document of an id that another text has too is kept for itself; of repeated rows, one stays."""
    a, b = words(random.Random(1), 30), words(random.Random(2), 30)
    rows = [(5, a), (5, b), (3, b), (3, b), (7, None), (7, None), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "u", "x") for i, t in rows], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in neardup.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (3, b), (7, None), (7, None), (None, a)], key=str)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300, 300 + i) for i in range(1, 60)] + [(400 + i, 401 + i) for i in range(40)]
    parent = {}
    for a, b in links:
        parent.setdefault(a, a), parent.setdefault(b, b)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if any(n in l and l[0] != l[1] for l in links)}


# ---- language


def test_language(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    network = language.train(docs.filter("doc_id % 3 <> 1"))
    found = language.identify(docs.filter("doc_id % 3 = 1").drop("lang"), network).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count()
    rows = language.identify(odd, network).collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert language.train(empty) is None and language.identify(empty, None).count() == 0
    assert language.identify(odd, None).filter("lang_pred <> 'und'").count() == 0


def test_language_slopes():
    network = language.ByteNetwork.fresh(["a", "b"])
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 105, (6, 40), np.uint8), rng.integers(0, 2, 6)
    loss = lambda: -np.log(network.probabilities(x)[np.arange(6), y]).mean()
    slopes = network._slopes(x, y)
    for k in ("out", "filter3", "embedding", "bias2"):
        at = np.unravel_index(np.abs(slopes[k]).argmax(), slopes[k].shape)
        w = network.weights[k]
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        assert math.isclose((up - loss()) / 2e-5, slopes[k][at], rel_tol=1e-3)
        w[at] += 1e-5


# ---- toxicity


def test_toxicity_slopes():
    network = toxicity.GatedNetwork.fresh()
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    rows, gram, first = toxicity.features([b"alpha", b"beta", b"c"])
    at, y = np.array([[0, 1, 2, 3, 0], [2, 2, 1, 0, 3]]), np.array([1, 0])
    p = lambda: network.scores(network.inputs(rows, gram, first), at)
    loss = lambda: -np.log(np.where(y == 1, p(), 1 - p())).mean()
    slopes = network.slopes(rows, gram, first, at, y)
    for k in ("word", "gram", "inf", "recb", "addf", "unit", "pick", "out", "bias"):
        spot = np.unravel_index(np.abs(slopes[k]).argmax(), slopes[k].shape)
        w = network.weights[k]
        w[spot] += 1e-3
        up = loss()
        w[spot] -= 2e-3
        assert math.isclose((up - loss()) / 2e-3, slopes[k][spot], rel_tol=0.03, abs_tol=1e-5), k
        w[spot] += 1e-3


def test_toxicity_memory_of_many_words(monkeypatch):
    rng = np.random.default_rng(0)
    many = [bytes(w) for w in rng.integers(97, 123, (60_000, 9), np.uint8)]
    network = toxicity.GatedNetwork.fresh()
    tracemalloc.start()
    parts = toxicity.features(many)
    found = network.inputs(*parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000  # 111 MB if all words are hashed at once
    monkeypatch.setattr(toxicity, "WORD_BLOCK", 7)
    few = [b"", b"a", *many[:50]]
    cut = toxicity.features(few)
    monkeypatch.undo()
    assert all((a == b).all() for a, b in zip(cut, toxicity.features(few), strict=True))
    assert (network.inputs(*toxicity.features(many[:500]))[:-1] == found[:500]).all()


def test_toxicity(spark, odd, empty):
    rng = random.Random(3)
    make = lambda bad: " ".join([*words(rng, rng.randrange(5, 120)).split(), *(["nasty" + rng.choice(["er", "ly", "s"])] if bad else []), *words(rng, 10).split()])
    y = np.array([i % 3 == 0 for i in range(600)], np.int64)
    texts = [make(b) for b in y]
    network = toxicity.fit(texts[:450], y[:450])
    predicted = toxicity.text_scores(texts[450:], network) >= 0.5
    assert (predicted == y[450:]).mean() >= 0.95
    assert toxicity.score(odd, network).filter("score between 0 and 1").count() == len(ODD)
    assert toxicity.score(empty, network).count() == 0 and toxicity.text_scores(["x"], None).tolist() == [0.0]
    assert toxicity.keep_clean(odd, network).columns == odd.columns


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        covered = {i for s in toxicity.window_starts(n) for i in range(s, s + toxicity.WINDOW)}
        assert set(range(n)) <= covered


# ---- neighbours


def test_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits, total = 0, 0
    found = neighbours.nearest(vectors, lambda v: v % 10 == 0).toPandas()
    for q, g in found.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))][:10]
        hits, total = hits + len(set(best) & set(g["vec_id"])), total + 10
        assert np.allclose(g["score"], [d[ids == v][0] for v in g["vec_id"]], rtol=1e-12)
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 11))
    assert total == 10 * (ids % 10 == 0).sum() and hits / total >= 0.9


def test_more_hashes_keep_recall():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    x = np.repeat(centres, 100, axis=0) + 0.25 * rng.standard_normal((4000, 32))
    hashing = neighbours.CrossPolytope.for_points(4000 * 1000, 32, neighbours.TABLES)
    assert hashing.hashes == 2 and neighbours.CrossPolytope.for_points(50000, 64, 12).hashes == 1
    found = [set() for _ in range(40)]
    for t in range(hashing.tables):
        own, asked = hashing.buckets(x, t, 1)[:, 0], hashing.buckets(x[::100], t, neighbours.PROBES * neighbours.DEEPER)
        for q in range(40):
            found[q] |= set(np.flatnonzero(np.isin(own, asked[q])))
    near = [set(np.argsort(((x - x[100 * q]) ** 2).sum(axis=1))[1:11]) for q in range(40)]
    assert sum(len(a & b) for a, b in zip(found, near, strict=True)) >= 0.9 * 400


def test_recall_of_more_hashes(spark, monkeypatch):
    """Through nearest(), on vectors without clusters, with a table large enough for a second hash."""
    monkeypatch.setattr(neighbours, "BUCKET", 200)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((8000, 16)).astype(np.float32)
    assert neighbours.CrossPolytope.for_points(8000, 16, neighbours.TABLES).hashes == 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, lambda v: v % 100 == 0).toPandas()
    wide, hits = x.astype(np.float64), 0
    for q, g in found.groupby("query_id"):
        d = ((wide - wide[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(g["vec_id"]))
    assert hits >= 0.9 * 800


def test_neighbours_odd(spark):
    same = [(i, [1.0, 2.0, 2.0], 0) for i in range(0, 60)]
    bad = [(100, None, 0), (101, [0.0, 0.0, 0.0], 0), (102, [1.0, None, 1.0], 0), (103, [float("nan"), 1.0, 1.0], 0), (104, [1.0, float("inf"), 1.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame([*same, *bad, (200, [-3.0, 1.0, 0.0], 0), (300, [5.0, 5.0], 0)], "vec_id long, embedding array<float>, label int")
    got = neighbours.nearest(df, lambda v: v % 100 == 0).toPandas()
    zero = got[got["query_id"] == 0].sort_values("rank")
    assert zero["vec_id"].tolist() == list(range(1, 11)) and set(zero["score"]) == {0.0}
    assert got[got["query_id"] == 200].sort_values("rank")["vec_id"].tolist() == list(range(10))  # found by the exact way
    assert set(got["query_id"]) == {0, 200}
    assert neighbours.nearest(df.limit(0), lambda v: v % 100 == 0).count() == 0


# ---- decontamination


def test_windows_hit(spark):
    rng = random.Random(4)
    items = [words(rng, 25, 60), words(rng, 10), "Short item HERE", "x", "", None, words(rng, 40)]
    texts = [words(rng, 80) for _ in range(20)]
    for i in range(10):
        w, source = texts[i].split(), items[(0, 1, 6)[i % 3]].split()
        n = rng.choice([9, 10, 14])
        s = rng.randrange(max(1, len(source) - n + 1))
        texts[i] = " ".join([*w[:30], *source[s : s + n], *w[30:]]).upper()
    texts += ["a short, item: here!", "the x", *[t for t in ODD if t != "null id"], items[0] * 3]
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)], "item_id long, text string, words string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.decontaminate(docs_of(spark, texts), bench).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({i: i + 32 for i in range(65, 91)})) if t else []
    for i, t in enumerate(texts):
        w, hit, named = split(t), set(), set()
        for k, item in enumerate(items):
            v = split(item)
            n = min(10, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit.update(range(j, j + n))
                    named.add(str(k))
        assert got[i] == (len(w), len(hit), sorted(named)), i


def test_decontamination_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, words(random.Random(0), 20))], "item_id long, text string")
    assert decontamination.decontaminate(odd, bench).filter("n_hit = 0").count() == len(ODD)
    assert decontamination.decontaminate(odd, bench.limit(0)).count() == len(ODD)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.clean_documents(odd, bench).columns == odd.columns


# ---- language model


def tree_by_hand(texts, text):
    """log10 probability of text by the recursive definition, from counts of the learnt texts."""
    counts = Counter()

    def contexts(raw):
        for i, b in enumerate(raw):
            past = [ctw._CLASS[raw[i - k]] if i >= k else ctw._CLASS[ctw.END] for k in range(1, ctw.DEPTH + 1)]
            yield b, past

    for t in texts:
        for b, past in contexts(t.encode().lower() + b"\xff"):
            for level in range(8):
                for d in range(ctw.DEPTH + 1):
                    counts[(tuple(past[:d]), level, b >> (8 - level), (b >> (7 - level)) & 1)] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    get = lambda past, node: (counts[(past, *node, 0)], counts[(past, *node, 1)])
    known = {k[:3] for k in counts}

    def weighted(past, node):
        own = kt(*get(past, node))
        if len(past) == ctw.DEPTH:
            return own
        below = sum(weighted((*past, c), node) for c in range(ctw.CLASSES) if ((*past, c), *node) in known)
        return np.logaddexp(own, below) - math.log(2)

    def estimate(past, full, node, parent):
        a, b = get(past, node)
        here = (b + 0.5) / (a + b + 1) if a + b else parent
        if len(past) == ctw.DEPTH:
            return here
        share = math.exp(kt(a, b) - math.log(2) - weighted(past, node))
        return share * here + (1 - share) * estimate(full[: len(past) + 1], full, node, here)

    total = 0.0
    for b, past in contexts(text.encode().lower() + b"\xff"):
        for level in range(8):
            p = estimate((), tuple(past), (level, b >> (8 - level)), 0.5)
            total += math.log10(p if (b >> (7 - level)) & 1 else 1 - p)
    return total


def test_context_tree(spark):
    rng = random.Random(6)
    texts = [words(rng, 12, 20) for _ in range(12)] + ["", None, "Ünï x"]
    rows = {r["doc_id"]: r for r in ctw.score_documents(docs_of(spark, texts), F.col("doc_id") % 3 != 2).collect()}
    learnt = [t or "" for i, t in enumerate(texts) if i % 3 != 2]
    counts = Counter(w for t in learnt for w in [*t.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens = [*(t or "").encode().lower().split(), None]
        assert rows[i]["held_out"] == (i % 3 == 2) and rows[i]["n_tokens"] == len(tokens) and rows[i]["train_tokens"] == n
        assert rows[i]["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert math.isclose(rows[i]["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        if i in (0, 2, 5, 12, 14):
            assert math.isclose(rows[i]["score"], tree_by_hand(learnt, t or ""), rel_tol=1e-3)


def test_context_tree_is_a_distribution():
    rng = np.random.default_rng(0)
    counts = np.zeros((ctw.CONTEXTS, 256), np.int64)
    counts[rng.integers(0, ctw.CONTEXTS, 500), rng.integers(0, 256, 500)] += rng.integers(1, 50, 500)
    assert np.allclose((10.0 ** ctw.weighted_tree(counts)).sum(axis=1), 1, atol=1e-3)


def test_contexts_are_whole_bytes_and_deep(spark):
    """What follows is told by one digit, accented letter or mark, five bytes back; classes of bytes cannot tell."""
    rng = random.Random(11)
    pairs = list(zip("0123456789éèàùß.,;:!", "abcdefghijklmnopqrst", strict=True))
    make = lambda: "".join(a + "wxyz"[: 4 - len(a.encode())] + "-" + b for a, b in rng.choices(pairs, k=60))
    texts = [make() for _ in range(60)]
    rows = ctw.score_documents(docs_of(spark, texts), F.col("doc_id") < 50).filter("held_out").collect()
    assert len(rows) == 10
    for r in rows:  # choosing a pair costs log2(20) = 4.3 bits, all else is known
        assert -r["score"] / math.log10(2) / 60 < 5.5, -r["score"] / math.log10(2) / 60


def test_rare_cells_are_joined(spark, monkeypatch):
    rng = random.Random(12)
    docs = docs_of(spark, [words(rng, 30, 50) for _ in range(12)] + ["", None, "Ünï"])
    score = lambda: {r["doc_id"]: r["score"] for r in ctw.score_documents(docs, F.col("doc_id") % 3 != 2).collect()}
    whole = score()
    monkeypatch.setattr(ctw, "FREQUENT_CELLS", 3)
    joined = score()
    assert whole.keys() == joined.keys() and all(math.isclose(whole[i], joined[i], rel_tol=1e-9) for i in whole)
    nothing = ctw.score_documents(docs, F.lit(False)).filter("doc_id = 14").first()
    assert math.isclose(nothing["score"], 8 * 6 * math.log10(0.5), rel_tol=1e-9)


def test_blocks_of_cells_add_up(monkeypatch):
    import pandas as pd

    rng = random.Random(13)
    cell, n = np.unique(ctw.cells([words(rng, 300, 40).encode()])[0], return_counts=True)
    total = lambda: pd.concat(ctw._weighted(iter([pd.DataFrame({"cell": cell, "n": n})[::-1]]))).groupby(["level", "node"])["value"].sum()
    one = total()
    monkeypatch.setattr(ctw, "BLOCK", 10)
    many = total()
    assert one.index.equals(many.index) and np.allclose(one, many)


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ctw, "FREQUENT", 3)
    rng = random.Random(7)
    texts = [words(rng, 30, 50) for _ in range(10)]
    rows = ctw.score_documents(docs_of(spark, texts), F.col("doc_id") % 2 == 0).collect()
    counts = Counter(w for t in texts[::2] for w in [*t.split(), None])
    for r in rows:
        assert r["n_known"] == sum(counts[w] > 0 for w in [*texts[r["doc_id"]].split(), None])


def test_language_model_odd(spark, odd, empty):
    assert ctw.score_documents(odd, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))).filter("score < 0").count() == len(ODD)
    assert ctw.score_documents(empty, F.lit(True)).count() == 0


# ---- WARC


def test_archives(spark, tmp_path):
    pages = [(i, f"http://x/{i}", h, 5) for i, h in enumerate(["<p>a</p>", "b", "<p>a</p>", None, "", "ü" * 70000, "b", "<p>a</p>"])] + [(None, None, "b", 5), (3, "u\r\nX: y", None, 5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, ordinal int")
    folder = str(tmp_path / "w")
    got = sorted(warc.archive_pages(df, 0, folder).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    payload = lambda h: (h or "").encode()
    by_id = {r["page_id"]: r for r in got}
    assert len(got) == len(pages)
    for i, _, h, _ in pages:
        assert by_id[i]["payload_bytes"] == len(payload(h)) and by_id[i]["payload_digest"] == warc.digest(payload(h))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == warc.digest(b"b")] == [(1, "response", None), (6, "revisit", 1), (None, "revisit", 1)]
    assert sum(r["record_type"] == "response" for r in got if r["payload_bytes"] == 0) == 1
    assert warc.archive_pages(df.limit(0), 0, str(tmp_path / "e")).count() == 0
    archive = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("archive") and p.name.endswith(".gz"))
    import gzip

    heads = [h for h, _ in warc.read_records(gzip.open(archive))]  # all members in a row are a valid stream
    assert len(heads) == len((tmp_path / "w" / f"{archive.name}.idx").read_text().splitlines())


# ---- packing


def test_token_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(8)
    letters = "aBé ß's,.!?12  \x1c\x85İΣς́中<|endoftext|>\n\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)] + ["it's We'll <|endoftext|> DON'T", "École,naïve Straße."]
    plain = Tokenizer.from_file(TOKENIZER)
    ids, sizes = packing.WordEncoder(TOKENIZER).encode(pa.array(texts), 0)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_best_fit_and_bound():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 200))
        bins, offset = packing.best_fit_decreasing(sizes, 100)
        fill = np.bincount(bins, weights=sizes)
        assert fill.max() <= 100 and packing.lower_bound(sizes, 100) <= len(fill)
        for b in range(len(fill)):
            mine = np.flatnonzero(bins == b)
            ends = sorted((offset[i], offset[i] + sizes[i]) for i in mine)
            assert ends[0][0] == 0 and all(x[1] == y[0] for x, y in itertools.pairwise(ends))
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3 and packing.lower_bound(np.array([34] * 4), 100) == 2


def test_packing(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rng = random.Random(9)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(150)] + [t for t in ODD if t != "null id"]
    rows = packing.pack_documents(docs_of(spark, texts), TOKENIZER, 128).toPandas()
    ids, sizes = packing.WordEncoder(TOKENIZER).encode(pa.array([t or "" for t in texts]), 0)
    each = np.split(ids.astype("<u4"), np.cumsum(sizes)[:-1])
    assert rows["length"].sum() == sizes.sum() and rows["length"].max() <= 128
    for r in rows.itertuples():
        assert zlib.crc32(each[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.start == 128 * r.piece and (r.length == 128 or r.start + r.length == sizes[r.doc_id])
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    used = rows["sequence_id"].nunique()
    assert used <= 1.02 * math.ceil(sizes.sum() / 128) + 2 and ordered.groupby("sequence_id")["length"].sum().max() <= 128
    assert packing.pack_documents(odd, TOKENIZER).filter("doc_id is null").count() == 1
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


# ---- sharding


def test_shards(spark, odd, empty):
    rng = random.Random(10)
    texts = ["x" * rng.randrange(400) for _ in range(2000)] + ["same"] * 1000
    rows = sharding.shard_documents(docs_of(spark, texts), 7).toPandas()
    sums = rows.groupby("shard")["size"].sum()
    assert len(sums) == 7 and sums.max() - sums.min() <= 3 * rows["size"].max() + 0.02 * sums.mean()
    assert len(rows) == 3000 and rows["size"].tolist() and set(rows["law"]) == {"bytes"}
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard")["slot"])
    by_id = rows.set_index("doc_id")
    assert all(by_id.loc[i, "size"] == len(t) + 16 and by_id.loc[i, "text_crc32"] == zlib.crc32(t.encode()) for i, t in enumerate(texts[:50]))
    twice = sharding.shard_documents(odd.union(odd), 40).collect()
    assert len(twice) == 2 * len(ODD) and all(0 <= r["shard"] < 40 for r in twice)
    assert sharding.shard_documents(empty).count() == 0


# ---- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        kept = kept.persist()
        assert 0 < kept.count() <= docs.count()
        docs = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not docs.filter(F.col("text").rlike("AKIA[A-Z0-9]{12,}")).count()


