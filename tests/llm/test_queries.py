"""Every numbered query on whole tables, by its contract, against plain versions."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, brute_spans

from tallyforge.llm import decontamination, language, packing, queries, secrets, sharding, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def tables(sf, tmp_path_factory):
    """The smallest tables with a document of two megabytes, null and empty texts, repeated texts, and a clashing column."""
    folder = tmp_path_factory.mktemp("sf")
    for name in ("embeddings", "pages", "benchmark", "labels"):
        (folder / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    top = max(d["doc_id"] for d in docs)
    secret = "token = 0123456789abcdef0123456789abcdef0123456789 "
    long = " ".join(d["text"] or "" for d in docs)[:1_000_000] + secret * 20_000
    more = [long, None, "", " \n", docs[0]["text"], docs[0]["text"], "x"]
    docs += [{**docs[0], "doc_id": top + 1 + i, "text": t} for i, t in enumerate(more)]
    table = pa.Table.from_pylist(docs, pq.read_schema(f"{sf}/documents.parquet"))
    pq.write_table(table.append_column("toxic", pa.array([7] * len(docs))).append_column("uid", pa.array(["u"] * len(docs))), folder / "documents.parquet")
    return str(folder), {d["doc_id"]: d for d in docs}


def run(spark, tables, name, columns):
    rows = queries.QUERIES[name](spark, tables[0])
    assert rows.columns[: len(columns)] == columns
    return [r.asDict() for r in rows.collect()]


def test_op1(spark, tables):
    rows = run(spark, tables, "op1_grammar_secrets", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    assert len(rows) == len(tables[1])
    for r in rows:
        base = brute_spans(tables[1][r["doc_id"]]["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(base) <= set(filter(None, r["spans"].split(",")))


def test_op2(spark, tables):
    texts = {i: d["text"] for i, d in tables[1].items()}
    ids = sorted(texts)
    expected = brute_components([texts[i] for i in ids], 3, 85)
    rows = run(spark, tables, "op2_bottom_k_near_duplicates", ["doc_id", "n_shingles", "component_id", "kept"])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {ids[k]: (n, ids[c]) for k, (n, c) in expected.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def plain_language(network, text):
    """Mean probabilities of a text's windows, by loops over windows, filters and places."""
    raw, w, found = text.encode(), network.weights, []
    for at in range(0, max(1, len(raw)), language.WINDOW):
        x = w["embedding"][np.frombuffer(raw[at : at + language.WINDOW].ljust(language.WINDOW), np.uint8)]
        tops = [max(0, max((x[i : i + n] * w[f"filter{n}"][:, :, f]).sum() for i in range(len(x) - n + 1)) + w[f"bias{n}"][f]) for n in language.WIDTHS for f in range(language.FILTERS)]
        z = np.array(tops) @ w["out"] + w["bias"]
        found.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    return np.mean(found, axis=0)


def test_op3(spark, tables):
    rows = run(spark, tables, "op3_byte_cnn_language", ["doc_id", "held_out", "lang_pred", "score"])
    docs = tables[1]
    network = language.train(spark.read.parquet(f"{tables[0]}/documents.parquet").filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) != 1))
    right = []
    for r in rows:
        text = docs[r["doc_id"]]["text"]
        assert r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not text or not any(map(str.isalpha, text)))
        if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und" and len(text) > 5:
            right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert np.mean(right) >= 0.95
    for r in sorted((r for r in rows if r["lang_pred"] != "und"), key=lambda r: len(docs[r["doc_id"]]["text"]))[::40][:4]:
        p = plain_language(network, docs[r["doc_id"]]["text"][:3000]) if len(docs[r["doc_id"]]["text"]) <= 3000 else None
        assert p is None or (network.languages[p.argmax()] == r["lang_pred"] and math.isclose(p.max(), r["score"], rel_tol=1e-3))


def plain_toxicity(network, text):
    """The highest probability of a text's windows, word by word."""
    words, w = toxicity.words_of(text), network.weights
    sigmoid, s = lambda x: 1 / (1 + np.exp(-x)), toxicity.STATES
    scores = []
    for start in toxicity.window_starts(len(words)):
        inputs = []
        for word in words[start : start + toxicity.WINDOW]:
            row, gram, _ = toxicity.features([word])
            inputs.append(np.concatenate([w["word"][row[0]], w["gram"][gram].mean(axis=0) if len(gram) else np.zeros(toxicity.COLUMNS)]))
        inputs += [np.zeros(2 * toxicity.COLUMNS)] * (toxicity.WINDOW - len(inputs))
        sides = []
        for d, order in (("f", inputs), ("b", inputs[::-1])):
            h, out = np.zeros(s), []
            for x in order:
                a, u = x @ w[f"in{d}"] + w[f"add{d}"], h @ w[f"rec{d}"]
                z, r = sigmoid(a[:s] + u[:s]), sigmoid(a[s : 2 * s] + u[s : 2 * s])
                h = (1 - z) * np.tanh(a[2 * s :] + r * u[2 * s :]) + z * h
                out.append(h)
            sides.append(out if d == "f" else out[::-1])
        states = np.concatenate(sides, axis=1)
        weight = np.exp(np.tanh(states @ w["unit"]) @ w["pick"])
        scores.append(sigmoid((weight / weight.sum()) @ states @ w["out"] + w["bias"][0]))
    return max(scores)


def test_op4(spark, tables):
    rows = run(spark, tables, "op4_gru_toxicity", ["doc_id", "held_out", "score", "predicted"])
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    labels = spark.read.parquet(f"{tables[0]}/labels.parquet").filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) != 0)
    network = toxicity.train(docs, labels)  # docs has a column toxic of its own
    assert len(rows) == len(tables[1])
    for r in rows:
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    some = sorted(rows, key=lambda r: len(tables[1][r["doc_id"]]["text"] or ""))
    for r in [*some[:3], *some[3:120:30]]:
        assert math.isclose(plain_toxicity(network, tables[1][r["doc_id"]]["text"]), r["score"], rel_tol=1e-3, abs_tol=1e-5)


def test_training_spans():
    short, long = "A b, c", " ".join(f"w{i}" for i in range(20_000))
    assert toxicity.training_spans(short) == ["a b c"]
    spans = toxicity.training_spans(long)
    assert len(spans) == toxicity.SPANS and all(len(s.split()) == toxicity.SPAN and s in long for s in spans)
    assert int(spans[-1].split()[0][1:]) > 10_000  # from the whole text


def test_op5(spark, tables):
    rows = run(spark, tables, "op5_cross_polytope_neighbours", ["query_id", "rank", "vec_id", "score"])
    table = pq.read_table(f"{tables[0]}/embeddings.parquet").to_pylist()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], np.float64)
    asked = [i for i in ids.tolist() if i % 100 == 0]
    assert {r["query_id"] for r in rows} == set(asked)
    hits = 0
    for q in asked:
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))][:10]
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(math.isclose(r["score"], d[ids == r["vec_id"]][0], rel_tol=1e-12) for r in mine)
        hits += len(set(best) & {r["vec_id"] for r in mine})
    assert hits >= 9 * len(asked)


def test_op6(spark, tables):
    import re

    rows = run(spark, tables, "op6_winnowing_decontamination", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({i: i + 32 for i in range(65, 91)})) if t else []
    windows = {}
    for item in pq.read_table(f"{tables[0]}/benchmark.parquet").to_pylist():
        v = split(item["text"])
        n = min(10, len(v))
        for j in range(len(v) - n + 1) if n else ():
            windows.setdefault(tuple(v[j : j + n]), set()).add(str(item["item_id"]))
    lengths = {len(w) for w in windows}
    assert len(rows) == len(tables[1])
    for r in rows:
        w, hit, named = split(tables[1][r["doc_id"]]["text"]), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    named |= found
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(named), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()


def test_op7(spark, tables):
    rows = run(spark, tables, "op7_context_tree_weighting", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    tokens = {i: [*(d["text"] or "").encode().lower().split(), None] for i, d in tables[1].items()}
    counts = Counter(w for i, ws in tokens.items() if fold(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    held = [0.0, 0]
    for r in rows:
        mine = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (fold(r["doc_id"], 7) == 2, len(mine), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in mine) and r["score"] < 0
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine), rel_tol=1e-9)
        if r["held_out"] and len(tables[1][r["doc_id"]]["text"] or "") < 10**6:
            held = [held[0] - r["score"] / math.log10(2), held[1] + len((tables[1][r["doc_id"]]["text"] or "").encode()) + 1]
    assert held[0] / held[1] < 4  # bits a byte, of texts that were not learnt


def test_op8(spark, tables):
    rows = run(spark, tables, "op8_monolithic_gzip_warc", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    pages = {p["page_id"]: (p["html"] or "").encode() for p in pq.read_table(f"{tables[0]}/pages.parquet").to_pylist()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in rows:
        payload = pages[r["page_id"]]
        same = first[payload] == r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if same else ("revisit", first[payload]))
    assert len(rows) == len(pages)


def test_op9(spark, tables):
    from tokenizers import Tokenizer

    rows = run(spark, tables, "op9_certified_best_fit", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    plain = Tokenizer.from_file(TOKENIZER)
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == tables[1].keys()
    for i, pieces in by_doc.items():
        ids = np.array([*plain.encode(tables[1][i]["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 2048)))
        for r in pieces:
            assert (r["start"], r["length"]) == (2048 * r["piece"], min(2048, len(ids) - 2048 * r["piece"]))
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for mine in by_bin.values():
        mine.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist() and sum(r["length"] for r in mine) <= 2048
    assert len(by_bin) <= packing.lower_bound(np.array([r["length"] for r in rows]), 2048) + 1


def test_op10(spark, tables):
    rows = run(spark, tables, "op10_kd_tree_sharding", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    sums, slots = Counter(), {}
    for r in rows:
        raw = (tables[1][r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        sums[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(tables[1]) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_ids_of_the_whole_range(spark):
    docs = spark.createDataFrame([(i, "x" * (j % 7)) for j, i in enumerate([-(2**63), 2**63 - 1, 0, None, *range(100, 160)])], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == 64 and {r["shard"] for r in rows} == {0, 1, 2, 3}


def plain_tree(points, shards):
    """Total weight of each leaf, cut at the weighted median along the widest dimension, in memory."""
    span = [max(1, max(p[0][d] for p in points) - min(p[0][d] for p in points)) for d in range(len(points[0][0]))]

    def leaves(cell, k):
        if k == 1:
            return [sum(w for _, w in cell)]
        wide = max(range(len(span)), key=lambda d: (max(p[0][d] for p in cell) - min(p[0][d] for p in cell)) / span[d])
        cell, total, at, below = sorted(cell, key=lambda p: p[0][wide]), sum(w for _, w in cell) * (k // 2) / k, 0, 0
        while at < len(cell) - 1 and below + cell[at][1] <= total:
            below, at = below + cell[at][1], at + 1
        return leaves(cell[:at], k // 2) + leaves(cell[at:], k - k // 2)

    return leaves(points, shards)


def test_tree_against_a_plain_one(spark):
    rng = np.random.default_rng(3)
    points = [((int(a), int(b)), int(w)) for a, b, w in zip(rng.integers(0, 10**6, 3000), rng.integers(0, 1000, 3000), rng.integers(1, 9, 3000), strict=True)]
    rows = spark.createDataFrame([(i, *p, w) for i, (p, w) in enumerate(points)], "uid long, a long, b long, w long")
    found = Counter()
    for r in sharding.kd_tree_shards(rows, ["a", "b"], "w", 8).collect():
        found[r["shard"]] += r["w"]
    assert np.allclose([found[k] for k in range(8)], plain_tree(points, 8), atol=20)


def test_very_long_text_of_keys():
    import time

    text = "password=abcdefgh12345678 abcdefgh12345678zz\n" * 100_000
    began = time.time()
    base = secrets.base_matches(text)
    assert len(base) == 100_000 and len(secrets.candidates(text, base)) == 100_000 and time.time() - began < 30


def test_few_credentials_still_teach():
    model = secrets.FormatModel({"assign": ["zk12ABCD34EF", "zk99AAAA11BB", "zk45CCDD88FF"], "hex": ["0" * 32]})
    assert set(model.automata) == {"assign"} and model.least == 12 and all(math.isfinite(edge) for _, edge in model.automata.values())


def test_repeated_rows_and_clashing_names(spark):
    """Rows of one id and text count as rows, and the operators' own names may be columns."""
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", 3, 4, "k")] * 3 + [(1, "other words", 3, 4, "k")], "doc_id long, text string, mark int, node int, key string")
    bench = spark.createDataFrame([("i", "two three four five six seven eight nine ten eleven"), ("j", "TWO three four five six seven eight nine ten eleven")], "item_id string, text string")
    hit = decontamination.decontaminate(docs, bench).collect()
    assert sorted((r["n_hit"], r["items"]) for r in hit) == [(0, []), (10, ["i", "j"]), (10, ["i", "j"]), (10, ["i", "j"])]
    assert decontamination.clean_documents(docs, bench).count() == 1
    assert secrets.scan(docs).count() == 4 and len({(r["sequence_id"], r["offset"]) for r in packing.pack_documents(docs, TOKENIZER).collect()}) == 4


def test_pipeline_against_plain_stages(spark, tables):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [r.asDict() for r in corpus_pipeline.run(spark, tables[0]).collect()]
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    network = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{tables[0]}/labels.parquet"))
    kept = [d for d in tables[1].values() if len(d["text"] or "") > 10**6 or plain_toxicity(network, d["text"]) < 0.5]
    long = [d for d in kept if len(d["text"] or "") > 10**6]  # too long for loops
    kept = [d for d in kept if d not in long or toxicity.text_scores([d["text"]], network)[0] < 0.5]
    kept.sort(key=lambda d: d["doc_id"])
    groups = brute_components([d["text"] for d in kept], 5, 80)
    kept = [d for k, d in enumerate(kept) if groups[k][1] == k]
    hit = decontamination.decontaminate(spark.createDataFrame([(d["doc_id"], d["text"]) for d in kept], "doc_id long, text string"), spark.read.parquet(f"{tables[0]}/benchmark.parquet"))
    bad = {r["doc_id"] for r in hit.filter("n_hit > 0").collect()}  # held against loops in test_op6
    kept = [d for d in kept if d["doc_id"] not in bad]
    model = secrets.learn_formats(spark.createDataFrame([(d["doc_id"], d["text"]) for d in kept], "doc_id long, text string"))
    plain, found = Tokenizer.from_file(TOKENIZER), {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == {d["doc_id"] for d in kept} and 0 < len(kept) < len(tables[1])
    for d in kept:
        text = d["text"] or ""
        spans = sorted([*(tuple(map(int, s.split(":")[1:])) for s in brute_spans(text)), *model.spans(text, secrets.base_matches(text))])
        out, at = "", 0
        for start, end in spans:
            if start >= at:
                out += text[at:start] + "[REDACTED]"
            at = max(at, end)
        ids = np.array([*plain.encode(out + text[at:], add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(found[d["doc_id"]], key=lambda r: r["piece"])
        assert sum(r["length"] for r in pieces) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
