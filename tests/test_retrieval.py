"""Ranking, fusion, diversity, packing and vectors against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import fusion as U
from ledgerlens.operators import inverted as IX
from ledgerlens.operators import lexical as LX
from ledgerlens.operators import passages as PK
from ledgerlens.operators import rerank as RR
from ledgerlens.operators import vectors as VX
from tests.conftest import rows_of

WORDS = "alpha beta gamma delta needle hay stack the the the of".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for i in range(60)]


def brute_bm25(corpus, query, k):
    docs = {i: Counter(t.split()) for i, t in corpus}
    n, avg = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    scores = {}
    for term in set(query.split()):
        df = sum(term in c for c in docs.values())
        for i, c in docs.items():
            if term in c:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                scores[i] = scores.get(i, 0) + idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
    return sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]


def index_of(df, doc_id, fields, tmp_path, name="index"):
    IX.publish_index(df, doc_id, fields, str(tmp_path / name), buckets=4)
    return IX.open_index(df.sparkSession, str(tmp_path / name))


@pytest.mark.parametrize("block", [1, 3, 64])
def test_bm25_matches_brute_force(frame, corpus, block, monkeypatch, tmp_path):
    monkeypatch.setattr(IX, "BLOCK_DOCS", block)
    index = index_of(frame(corpus, "id long, text string"), "id", {"text": 1.0}, tmp_path)
    queries = frame([(1, "needle the"), (2, "alpha of gamma"), (3, "unknown words"), (4, None)], "qid int, query string")
    got = IX.bm25_topk(queries, index, 7)
    assert got.where("qid > 2").isEmpty()
    for qid, q in ((1, "needle the"), (2, "alpha of gamma")):
        mine = [(r.doc_id, r.score) for r in got.where(F.col("qid") == qid).orderBy("rank").collect()]
        assert [i for i, _ in mine] == [i for i, _ in brute_bm25(corpus, q, 7)]
        assert [s for _, s in mine] == pytest.approx([s for _, s in brute_bm25(corpus, q, 7)], abs=2e-6)
    even = frame([(i,) for i, _ in corpus if i % 2 == 0], "doc_id long")
    mine = IX.bm25_topk(queries, index, 5, even).where("qid = 1").orderBy("rank").collect()
    assert [r.doc_id for r in mine] == [i for i, _ in brute_bm25(corpus, "needle the", 60) if i % 2 == 0][:5]


def test_search_skips_blocks(frame, tmp_path, monkeypatch):
    """Documents about one word lie together; a query for it reads their blocks and no others of the frequent word."""
    monkeypatch.setattr(IX, "BLOCK_DOCS", 8)
    texts = [(i, "needle needle hay" if 40 <= i < 56 else "hay and more hay than anyone needs for a needle or two") for i in range(400)]
    index = index_of(frame(texts, "id long, text string").coalesce(1), "id", {"text": 1.0}, tmp_path)
    q = frame([(1, "needle hay")], "qid int, query string")
    found = IX.search(q, index, 10, probe=2)
    every, skipped = found.skipped()
    assert every == 50 and skipped >= 40
    best, mine = brute_bm25(texts, "needle hay", 10), IX.bm25_topk(q, index, 10).orderBy("rank").collect()
    assert [r.doc_id for r in mine] == [i for i, _ in best] and [r.score for r in mine] == pytest.approx([s for _, s in best], abs=2e-6)


def test_scan_moves_no_postings(frame, tmp_path):
    """Many queries share frequent words: what leaves the scan is k rows per query and task (and ties), not the postings."""
    texts = [(i, "the of " * (i % 50 + 1) + "and in") for i in range(400)]
    df = frame(texts, "id long, text string").repartition(2)
    IX.publish_index(df, "id", {"text": 1.0}, str(tmp_path / "i"), buckets=4, blocks=False)
    index = IX.open_index(df.sparkSession, str(tmp_path / "i"))
    assert index.blocks is None and not (tmp_path / "i" / "blocks").exists()
    q = frame([(i, "the of and in") for i in range(30)], "qid int, query string")
    found = IX.scan(q, index, 3)
    assert found.count() < 30 * 400 / 4
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    best = [i for i, _ in brute_bm25(texts, "the of and in", 3)]
    for hits in (IX.bm25_topk(q, index, 3), IX.scale.top_per_key(IX.scan(q, index, 3, most_terms=20), ["qid"], [F.desc("score"), F.asc("doc_id")], 3)):
        assert [r.doc_id for r in hits.orderBy("qid", "rank").collect()] == best * 30


def test_task_memory_follows_neither_batch_nor_table(monkeypatch):
    """Words are hashed for a few documents at a time; vectors of words stay right when the kept ones are dropped."""
    monkeypatch.setattr(VX, "KEPT_WORDS", 3)
    known, words = VX._WordVectors(16, VX._md5), [f"w{i % 7}" for i in range(40)] + ["", "a", "é"]
    for i in range(0, len(words), 2):
        pair = list(dict.fromkeys(words[i:i + 2]))
        places = known.rows(pair)
        for word, row in zip(pair, known.table[places]):
            want = [0] * 16
            for feature in [f"token:{word}", *(f"trigram:{f'^{word}$'[j:j + 3]}" for j in range(max(1, len(word))))]:
                d, sign = VX._md5(feature)
                want[d % 16] += 1 if sign & 1 else -1
            assert row.tolist() == want
    assert len(known.place) <= 5 and len(known.table) <= 1024


def test_terms_are_counted_for_many_rows_at_once():
    """One sort of the tokens of some rows gives each row its terms in order, with weights added up from the least."""
    heads, texts = [["b", "b"], [], ["é"]], [["a", "b", "b"], [], ["z", "é", "a", "z"]]
    dl, terms = IX._bags([pa.array(heads, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))], np.array([0.6, 0.1]))
    assert dl.to_pylist() == [5, 0, 5]
    assert terms.to_pylist() == [
        [{"term": "a", "tf": 0.1}, {"term": "b", "tf": 0.1 + 0.1 + 0.6 + 0.6}], [],
        [{"term": "a", "tf": 0.1}, {"term": "z", "tf": 0.1 + 0.1}, {"term": "é", "tf": 0.1 + 0.6}]]


def test_distinct_trigrams_are_hashed_once_for_many_words():
    """Words that share their trigrams cost a digest each, not one per letter."""
    asked = []
    known = VX._WordVectors(16, VX._Digest(lambda f: (asked.append(f), hashlib.md5(f).digest())[1], ">u4"))
    known.rows([f"{'ab' * 30}{i:02}" for i in range(50)])
    assert len(asked) == len(set(asked)) and sum(f.startswith(b"trigram:") for f in asked) < 150


def test_vector_search_hands_on_few_rows(frame):
    """Of one block only rows that may be among the k best groups leave it, ties and not-a-number included."""
    block = pd.DataFrame({"g": [i // 2 for i in range(1000)], "p": [f"{i:04}" for i in range(1000)]})
    scores = np.array([[(i % 500) / 500] for i in range(1000)])
    scores[7, 0] = float("nan")
    floor = np.full(1, -np.inf)
    out = VX._best([5], scores, block, ["p"], 3, "g", floor)
    assert len(out) < 10 and out["g"].is_unique and out["score"].isna().sum() == 1
    assert floor[0] == np.sort(np.where(np.isnan(scores), np.inf, scores).reshape(500, 2).max(axis=1))[-3]
    assert len(VX._best([5], scores - 1, block, ["p"], 3, "g", floor)) <= 1


def test_packing_yields_small_batches(spark):
    """A batch of documents leaves as batches of the chunks of a few documents."""
    rows = [(f"e{i}", "p", "h", 1, "line one\nline two\n\nline three " * 40) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id string, source_path string, heading string, line_start long, content string").coalesce(1)
    sizes = PK.pack_paragraphs(df, size=60).groupBy("event_id").count()
    assert sizes.count() == 300 and sizes.agg(F.min("count"), F.max("count")).first()[0] > 1
    assert PK.ROWS_AT_ONCE < 300


def test_index_tables(frame, tmp_path):
    index = index_of(frame([(1, "b a b", "a"), (2, None, None), (3, "", "c")], "id long, text string, title string"), "id", {"text": 1.0, "title": 0.5}, tmp_path)
    assert rows_of(index.postings(), "doc_id", "dl", "term", "tf") == [(1, 4, "a", 1.5), (1, 4, "b", 2.0), (3, 1, "c", 0.5)]
    assert rows_of(index.terms, "term", "df") == [("a", 1), ("b", 1), ("c", 1)]
    assert (index.corpus.first().n_docs, index.corpus.first().avg_dl) == (3, 5 / 3)


def test_passage_first_against_event_first(frame, tmp_path):
    events = frame([("e1", "plain words", "h", "p1", 1, 1, "2024-01-01"), ("e2", "needle in summary", "h", "p2", 1, 1, "2024-01-01")],
                   "event_id string, summary string, heading string, source_path string, line_start long, line_end long, date string")
    passages = frame([("e1#0", "e1", "needle line", "p1", 1, 1)], "passage_id string, event_id string, content string, path string, start_line long, end_line long")
    q = frame([(1, "needle")], "qid int, query string")
    ei = index_of(events, "event_id", {"summary": 1.0}, tmp_path, "e")
    pi = index_of(passages, "passage_id", {"content": 1.0}, tmp_path, "p")
    first = LX.search_lexical(q, pi, passages, ei, events, 5).orderBy("rank").collect()
    assert [r.event_id for r in first] == ["e1", "e2"]
    assert LX.search_event_first(q, ei, events, 5).first()["event_id"] == "e2"


@pytest.mark.parametrize("query_limit", [2048, 2])  # 2 forces the tiled product
def test_vector_search_matches_brute_force(frame, query_limit, monkeypatch):
    monkeypatch.setattr(VX, "CORPUS_BLOCK", 16)
    rng = np.random.default_rng(2)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    c, q = unit(90), unit(7)
    c[40:70] = c[40]  # a block of copies
    rows = [(f"e{i % 20:02d}", "" if i < 20 else f"p{i:02d}", c[i].tolist()) for i in range(90)]
    got = VX.topk_cosine(frame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, vector array<double>"),
                         frame(rows, "event_id string, passage_id string, vector array<double>"), 5, "event_id", ["passage_id"], query_limit)
    for j in range(7):
        best = {}
        for (e, p, v) in rows:
            key = (-round(float(np.dot(v, q[j])), 6), p)
            best[e] = min(best.get(e, key), key)
        want = sorted(((s, e, p) for e, (s, p) in best.items()))[:5]
        mine = got.where(F.col("qid") == j).orderBy("rank").collect()
        assert [(r.event_id, r.passage_id, r.score) for r in mine] == [(e, p, -s) for s, e, p in want]


def test_embedder_contract(frame):
    df = frame([("a", "x y"), ("b", "z")], "id string, text string")
    ok = VX.embed_with(df, "id", "text", lambda t: [[3.0, 4.0]] * len(t), 2)
    assert ok.first()["vector"] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="wrong shape"):
        VX.embed_with(df, "id", "text", lambda t: [[1.0]] * len(t), 2).collect()


def test_hash_embedding_matches_definition(frame):
    df = frame([("a", "Straße run run_x"), ("b", "!!")], "id string, text string")
    out = {r.doc_id: r.vector for r in VX.embed_blake2b(df, "id", "text", 32).collect()}
    want = np.zeros(32)
    for w in ["strasse", "run", "run", "x"]:
        pad = f"^{w}$"
        for f in [f"token:{w}"] + [f"trigram:{pad[i:i + 3]}" for i in range(max(1, len(pad) - 2))]:
            d = hashlib.blake2b(f.encode(), digest_size=8).digest()
            want[int.from_bytes(d[:4], "little") % 32] += 1 if d[4] & 1 else -1
    assert out["a"] == pytest.approx((want / np.linalg.norm(want)).tolist()) and "b" not in out


def test_rrf_prefers_agreement(frame):
    ddl = "qid int, event_id string, rank int"
    lex, sem = frame([(1, "a", 1), (1, "b", 2), (1, "b", 5)], ddl), frame([(1, "c", 1), (1, "b", 2)], ddl)
    got = U.rrf(lex, sem, 3, (1.0, 1.0)).orderBy("rank").collect()
    assert [r.event_id for r in got] == ["b", "a", "c"] and got[0].lexical_rank == 2
    assert U.rrf(lex, sem, 3, (1.0, 1.0), duplicate="last").where("event_id = 'b'").first()["lexical_rank"] == 5


def test_linear_fusion_keeps_best_passage(frame):
    lex = frame([(1, "evt_one", 0.2), (1, "evt_two", 1.0)], "qid int, event_id string, lexical_score double")
    sem = frame([(1, "evt_one", "psg_best", 0.9), (1, "evt_one", "psg_other", 0.1)], "qid int, event_id string, passage_id string, semantic_score double")
    got = U.fuse_linear(lex, sem, 0.25, 0.75, 3).orderBy("rank").collect()
    assert [(r.event_id, r.passage_id) for r in got] == [("evt_one", "psg_best"), ("evt_two", "")]


def test_route_reasons(frame):
    q = frame([(1, "open tools/run_me.py"), (2, "why did it fail"), (3, "nothing found here")], "qid int, query string")
    ddl = "qid int, event_id string, rank int, score double"
    lex = frame([(i, "l", 1, 1.0) for i in (1, 2, 3)], ddl)
    sem = frame([(1, "s", 1, 1.0), (2, "s", 1, 1.0)], ddl)
    assert rows_of(U.route(q, lex, sem), "qid", "route", "reason") == [
        (1, "lexical", "structural_query_lexical_fast_path"), (2, "semantic", "natural_language_semantic_route"), (3, "lexical", "semantic_empty_lexical_fallback")]
    assert {r.reason for r in U.route(q, lex, sem, False).where("qid > 1").collect()} == {"semantic_unavailable_lexical_fallback"}


@pytest.mark.parametrize("bundles", [False, True])
def test_diversity_matches_sequential_walk(frame, bundles):
    rng = random.Random(3)
    rows = [(q, r, f"e{rng.randint(0, 5)}", rng.choice(["results/a/b/x.json", "results/a/c/y.json", "docs/x/a.txt", "docs/y/b.txt", ""]),
             rng.choice(["Results", "Metadata", "Part"]), rng.random() < 0.2, rng.choice([True, False, False, None])) for q in range(4) for r in range(1, 60)]
    if not bundles:
        rows = [(*r[:6], False) for r in rows]
    given = frame(rows, "qid int, rank int, event_id string, path string, heading string, priority boolean, bundle boolean")
    got = U.diversify(given if bundles else given.drop("bundle"), 12)
    for q in range(4):
        ev, fam, want = Counter(), Counter(), []
        for _, r, e, p, h, pr, whole in [x for x in rows if x[0] == q]:
            if whole and len(want) < 12:
                want.append(r)
                continue
            if whole or not p or h.lower() == "metadata" or len(want) == 12:
                continue
            f = "/".join(p.split("/")[:3]) if p.startswith("results/") else p.rsplit("/", 1)[0]
            if ev[e] < (5 if pr else 4) and fam[f] < (5 if pr else 4 if p.startswith("results/") else 2):
                ev[e] += 1
                fam[f] += 1
                want.append(r)
        assert [r["rank"] for r in got.where(F.col("qid") == q).orderBy("selected_rank").collect()] == want


@pytest.mark.parametrize("size", [5, 40, 3500])
def test_line_packing_keeps_every_character(size):
    text = "first line\n\n" + "x" * 93 + "\nlast\n  \nend"
    chunks = PK.line_chunks(text, 10, size, None)
    assert all(len(t) <= size for _, _, t in chunks)
    assert all(a <= b for a, b, _ in chunks) and [a for a, _, _ in chunks] == sorted(a for a, _, _ in chunks)
    squeeze = lambda t: re.sub(r"\s+", "", t)
    assert squeeze("".join(t for _, _, t in chunks)) == squeeze(text)
    assert len(PK.line_chunks(text, 1, 5, 3)) == 3


def test_paragraph_packing():
    text = "# Title\n\n- item one\nitem two\n\n```\ncode\n```\n" + "y" * 25 + "\ntail"
    chunks = PK.paragraph_chunks(text, 1, 20, None)
    assert chunks[:2] == [(1, 1, "Title"), (3, 4, "item one item two")]
    assert "code" not in " ".join(t for _, _, t in chunks) and "".join(t for _, _, t in chunks).count("y") == 25
    many = "\n\n".join(f"para {i} " + "z" * 15 for i in range(50))
    picked = PK.paragraph_chunks(many, 1, 20, 8)
    whole = PK.paragraph_chunks(many, 1, 20, None)
    assert len(picked) == 8 and picked[0] == whole[0] and picked[-1] == whole[-1]


def test_conflicts_and_coverage(frame):
    ev = frame([(1, "a", 'quality_gate_passed: true'), (1, "b", "it was blocked"), (2, "a", "neutral"), (3, "c", "gate passed but blocked")], "qid int, event_id string, content string")
    assert rows_of(RR.conflicts(ev), "qid", "conflict") == [(1, True), (2, False), (3, True)]
    q = frame([(1, "hash of evt_a1 at 0.25"), (2, "plain")], "qid int, query string")
    ev = frame([(1, "a", "SHA256 of EVT_A1"), (2, "a", "x")], "qid int, event_id string, content string")
    assert rows_of(RR.coverage(q, ev), "qid", "missing", "status") == [(1, "0.25", "possible_retrieval_gap"), (2, "", "no_obvious_query_anchor_gap")]


def test_latest_has_no_cap(frame):
    rows = [(f"evt_{i:03d}", "claim", f"2024-01-{i % 28 + 1:02d}", None, None) for i in range(500)]
    events = frame(rows, "event_id string, event_type string, date string, timestamp_start string, timestamp_end string")
    assert U.latest(events, 500).count() == 500 and U.latest(events, 7).count() == 7


def test_evidence_blocks_keep_order_limit_and_budget(frame):
    ddl = "qid int, event_id string, path string, content string, score double"
    rows = [(1, "b", "p", "aa", 0.5), (1, "a", "p", "bb", 0.5), (1, "c", "p", "cc", 0.9), (1, "d", "p", "dd", 0.1), (1, "e", "x/audit.json", "ééé", 0.2),
            (1, "f", "x/audit.json", "late", 0.1), (2, "a", "p", None, 1.0)]
    got = RR.evidence_blocks(frame(rows, ddl), 3, 12).orderBy("qid", "block").collect()
    assert [(r.qid, r.block, r.event_id, r.used_bytes) for r in got] == [(1, 1, "c", 2), (1, 2, "a", 4), (1, 3, "b", 6), (1, 4, "e", 12), (2, 1, "a", 0)]
    assert got[3].category == "audit" and got[3].text == "ééé"
    assert RR.evidence_blocks(frame([], ddl), 3, 12).isEmpty()
