"""Ranked search, fill-in-middle and chat formatting: against SQL and loops, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat, infill, queries, ranking


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """The smallest tables with odd texts, nulls and clashing columns."""
    folder = tmp_path_factory.mktemp("odd")
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    top = max(d["doc_id"] for d in docs)
    more = ["a <P> b", None, "", "\x1e0\x1f\x1e", "<S", "😀é\n" * 50_000, "THE the The", docs[0]["text"], docs[0]["text"], "!! ?"]
    docs += [{**docs[0], "doc_id": top + 1 + i, "text": t} for i, t in enumerate(more)]
    table = pa.Table.from_pylist(docs, pq.read_schema(f"{sf}/documents.parquet"))
    for name in ("marked", "n", "hash", "terms", "score", "rank"):
        table = table.append_column(name, pa.array(["x"] * len(docs)))
    pq.write_table(table, folder / "documents.parquet")
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist() + [{"item_id": 9001, "text": None}, {"item_id": 9002, "text": "?!"}, {"item_id": 9003, "text": "the THE zzzz"}]
    pq.write_table(pa.Table.from_pylist(items, pq.read_schema(f"{sf}/benchmark.parquet")).append_column("number", pa.array(["x"] * len(items))), folder / "benchmark.parquet")
    talks = pq.read_table(f"{sf}/conversations.parquet").to_pylist()
    extra = [(5001, 0, "to\\n\nol<s>", "[\\INST]\\<|im_start|>"), (5001, None, None, None), (5001, 1, "assistant", ""), (5001, 2, "assistant", "é😀" * 5000), (5001, 2, "assistant", "é😀" * 5000), (None, 0, "user", "x"), (5002, 0, "assistant", "<</s>[/INST]")]
    talks += [dict(zip(("conv_id", "turn", "role", "text"), row, strict=True)) for row in extra]
    pq.write_table(pa.Table.from_pylist(talks, pq.read_schema(f"{sf}/conversations.parquet")).append_column("message", pa.array(["x"] * len(talks))), folder / "conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, odd, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{odd}/{t}.parquet'")
    theirs = con.sql(queries.SQL[name])
    ours = queries.QUERIES[name](spark, odd)
    assert ours.columns == theirs.columns
    rows = [tuple(r) for r in ours.collect()]
    assert Counter(rows) == Counter(theirs.fetchall()) and rows


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert infill.infill(docs).count() == 0
    assert ranking.rank_documents(docs, items).count() == 0
    assert ranking.rank_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def plain_ranks(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 100 - 90 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_search_over_many_blocks_copies_and_groups(spark, monkeypatch):
    """Small blocks, several readings, copies with equal scores, null ids, a term in all documents and a very long term."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(20_000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(600)]
    docs += [(1000 - i, "Common copy, copy") for i in range(200)] + [(None, "common copy copy"), (None, ""), (3, docs[3][1]), (7777, "z" * 50 + " w1 \x00 Éw"), (-5, "w1 w2 w3")]
    items = [(f"i{j}", " ".join(rng.choices(words, k=rng.randint(1, 25)))) for j in range(40)] + [("copies", "copy COMMON"), ("long", "z" * 50), (None, "w1"), ("two", "w2"), ("none", "")]
    monkeypatch.setattr(ranking, "PAIRS", 100)
    monkeypatch.setattr(ranking, "WIDTH", 3)
    found = ranking.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), k=7)
    assert sorted(map(tuple, found.collect()), key=str) == plain_ranks(docs, items, 7)


def test_terms_in_slices(monkeypatch):
    text = ("Aé-b  c" * 99 + "x" * 70 + " y").encode()
    whole = list(ranking.terms_of(text))
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(ranking, "SLICE", size)
        assert list(ranking.terms_of(text)) == whole


def test_treap_walk_scores_few_documents():
    """The walk prunes: of 20,000 documents that share one frequent term it scores a small part."""
    rng = np.random.default_rng(1)
    n, scored = 20_000, []
    rare = rng.choice(n, 50, replace=False)
    term = np.concatenate([np.zeros(n, np.int32), np.ones(50, np.int32)])
    place = np.concatenate([np.arange(n), rare])
    treaps = ranking.Treaps.build(term, place, rng.integers(1, 1000, n + 50), n, 2)
    top, plain = ranking.Best(10), treaps.scores
    treaps.scores = lambda t, w, p: (scored.append(len(p)), plain(t, w, p))[1]
    ranking.search(treaps, np.array([0, 1]), np.array([3, 9000]), np.arange(n), 0, top)
    every = treaps.scores(np.array([0, 1]), np.array([3, 9000]), np.arange(n))
    assert [(-s, i) for s, _, i in top.rows] == sorted(zip(every.tolist(), range(n), strict=True), key=lambda x: (-x[0], x[1]))[:10]
    assert sum(scored) - n < 2000


@pytest.mark.parametrize("unit, pattern", [("character", r"(?s)."), ("word", r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_infill_units(spark, unit, pattern):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab \n\x1e\x1f01é😀<>PSM", k=rng.randint(0, 40))) for _ in range(300)]
    made = infill.infill(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), unit, plain_percent=0)
    forms = Counter()
    for r in made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect():
        text = texts[r["doc_id"]]
        units = re.findall(pattern, text)
        assert r["n"] == len(units) and r["back"] == text
        forms[r["form"]] += 1
        if r["form"] == "plain":
            continue
        h = hashlib.sha256(f"1:{r['doc_id']}".encode()).hexdigest()
        a, b = sorted(int(h[8 * i : 8 * i + 8], 16) % (len(units) + 1) for i in range(2))
        assert (r["prefix"], r["middle"], r["suffix"]) == ("".join(units[:a]), "".join(units[a:b]), "".join(units[b:]))
    assert forms["psm"] > forms["spm"] > 20


def test_overlapping_markers_are_refused():
    assert infill.checked(infill.MARKERS)
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "P<", "M"), ("", "a", "b"), ("<P>x", "<P>", "c")):
        with pytest.raises(ValueError):
            infill.checked(bad)


def test_folding_of_logs(spark):
    log = [
        (1, 0, 0, 0, "open", "user", None), (1, 0, 0, 1, "delta", None, "Hel"), (1, 0, 0, 2, "delta", None, "lo"), (1, 0, 0, 9, "edit", None, "Hi"), (1, 0, 0, 10, "delta", None, "!"),
        (1, 1, 1, 0, "open", "assistant", None), (1, 1, 1, 3, "delta", None, "draft"), (1, 1, 1, 4, "regenerate", None, None), (1, 1, 1, 5, "delta", None, "an"), (1, 1, 1, 6, "delta", None, "swer"), (1, 1, 1, 7, "ping", None, "?"),
        (1, 2, 2, 0, "open", "user", None), (1, 2, 2, 1, "delta", None, "gone"), (1, 2, 2, 2, "delete", None, None),
        (None, None, 5, 1, "delta", None, "no role"),
    ]
    for seed in range(3):
        random.Random(seed).shuffle(log)
        rows = chat.messages(spark.createDataFrame(log, chat.EVENTS)).collect()
        assert {(r["conv_id"], r["role"], r["text"]) for r in rows} == {(1, "user", "Hi!"), (1, "assistant", "answer"), (None, None, "no role")}
    parts = chat.rendered(chat.messages(spark.createDataFrame(log, chat.EVENTS)))
    text = "".join(r["part"] for r in parts.filter("conv_id = 1").orderBy("turn").collect())
    assert text == "<|im_start|>user\nHi!<|im_end|>\n<|im_start|>assistant\nanswer<|im_end|>\n"
    assert [r["part"][r["loss_from"] : r["loss_to"]] for r in parts.filter("loss_from is not null").collect()] == ["answer"]


def test_control_strings_survive(spark):
    """Any mixture of control strings, their pieces and backslashes comes back; no control string is left in a body."""
    rng = random.Random(3)
    bits = [*chat.CONTROLS, "\\", "<", "[", "|im_end|>", "INST]", "/s>", "\n", "x", "n", "b", "é"]
    rows = [(i, 0, "".join(rng.choices(bits, k=3)), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for i in range(400)]
    parts = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).persist()
    back = {r["conv_id"]: (r["role"], r["text"]) for r in chat.read_back(parts).collect()}
    assert back == {i: (role, text) for i, _, role, text in rows}
    for r in parts.collect():
        inner = r["part"][len(chat.OPEN) : -len(chat.CLOSE)]
        assert not any(c in inner for c in chat.CONTROLS)
    parts.unpersist()


def test_blocks_are_joined_and_cut(monkeypatch):
    """Small batches make one block; blocks keep to their postings and rows, and hold every document once, in order."""
    monkeypatch.setattr(ranking, "BLOCK", 10)
    sizes = [3, 0, 4, 3, 12, 1, 1, 0, 0, 9, 2]
    rows = [(i, 1, list(range(n)), [1] * n) for i, n in enumerate(sizes)]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
    for step in (1, 3, 11):
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + step]], schema) for i in range(0, len(rows), step)]
        for most in (100, 2):
            blocks = [b.column(0).to_pylist() for b in ranking._blocks(iter(batches), most)]
            assert [i for b in blocks for i in b] == list(range(len(rows)))
            assert all(len(b) <= most and (sum(sizes[i] for i in b) <= 10 or len(b) == 1) for b in blocks)
        assert [b.column(0).to_pylist() for b in ranking._blocks(iter(batches), 100)] == [[0, 1, 2, 3], [4], [5, 6, 7, 8], [9], [10]]
