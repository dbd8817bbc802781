"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, classifier, context_mixing, exact_dedup, mixing, near_dup, sharding, substring_dedup, topk, url_filter

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, h string, rid int, shard int, size int, score double, kept string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


@pytest.fixture()
def odd(spark):
    """Null ids, texts and sources, empty, blank, repeated and long texts, other white space, columns with clashing names."""
    texts = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "a  b\tc d\ne f "), (4, None), (5, ""), (6, " \t\n"), (None, "a b c d e f"),
             (None, None), (7, LONG), (8, LONG), (9, "The"), (10, "na\u00efve \u00a0caf\u00e9 \U0001f600"), (11, "x" * 50_000)]
    rows = [(i, t, None, [None, "s", "t"][k % 3], None, "r", "h", 1, 2, 3, 0.5, "k") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DDL)


def test_bpe(spark, odd, none):
    got = bpe.encode_column(odd, out="row")
    assert got.columns == odd.columns and got.count() == odd.count()
    back = bpe.decode_column(got.withColumn("ids", F.col("row.ids")), "ids", "back")
    assert back.where(F.coalesce("text", F.lit("")) != F.col("back").cast("string")).isEmpty()
    for r in got.collect():
        text = r.text or ""
        assert not r.row.ids or (r.row.starts[0] == 0 and r.row.ends[-1] == len(text))
        assert all(a <= b for a, b in zip(r.row.starts, r.row.starts[1:]))
    assert bpe.encode_column(none).isEmpty() and bpe.encoding_digests(none).isEmpty()


def test_bpe_like_tiktoken_on_mixed_scripts(monkeypatch):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bpe.RANKS)
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 30)
    own = bpe.Codec(bpe.tokenizer_json(path), public_tokenizers.PATTERN, bpe.odd_characters())
    parts = [" ", "  ", "\n", "\t", "\x85", "\xa0", "\u2003", "\x1c", "\x00", "'s", "'", "a", "\u00e9", "Z", "9", "\u0663", "\u00b2", "\u00aa", "\u6c49",
             "\U0001f600", "\u1c8a", "\u0558", "\u088f", "<|endoftext|>", "$$$", "ll"]
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        ids = own.encode(text).tolist()
        assert ids == want.encode_ordinary(text) and own.decode(ids).decode() == text
        k = rng.randint(0, len(ids))
        assert "".join(own.decode_stream([ids[:k], ids[k:]])) == text


def test_odd_characters_take_little_memory():
    """The driver classes all of Unicode; at once that held 340 MB beside its heap."""
    import subprocess
    import sys

    code = ("import resource; from ledgerlens.llm import bpe; peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; before = peak(); "
            "assert bpe.odd_characters(); print(peak() - before)")
    done = subprocess.run([sys.executable, "-c", code], cwd=bpe.__file__.rsplit("/", 3)[0], capture_output=True, text=True, check=True)
    assert int(done.stdout.split()[-1]) < 150_000


def test_context_mixing(spark, odd, none):
    got = context_mixing.score_texts(odd, hot_words=2)
    rows = got.collect()
    assert len(rows) == odd.count() and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert {(r.n_tokens, r.base_score) for r in rows if r.n_tokens == 1} and not next(r for r in rows if r.doc_id is None).held_out
    assert context_mixing.score_texts(none).isEmpty()
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert len(same) == 3 and len({r.score for r in same}) == 1


def test_context_mixing_hears_the_order_of_tokens(spark):
    """Equal words in another order score lower, and equal texts score alike, held out or not."""
    text = "the cat sat on the mat and the dog lay by the door"
    other = "mat the on door lay the and sat by cat the dog the"
    rows = [(i, text) for i in range(40)] + [(1000, other)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in context_mixing.score_texts(docs).collect()}
    assert any(r.held_out for r in got.values()) and got[1000].base_score == pytest.approx(got[0].base_score)
    assert len({round(r.score, 9) for i, r in got.items() if i < 1000}) == 1
    assert got[0].score > got[1000].score + 1


def test_text_codes_sum_to_one():
    """After any earlier tokens the chances of the coded words and of the leaf of all others sum to one; texts do not mix."""
    code = context_mixing.TextCode.of(np.array([9, 5, 4, 1]), 30)
    texts = [[0, 1, 2, 99, 3, 0], [1], [2, 0, 1]]
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array([np.array(t, "<i4").tobytes() for t in texts])], ["ids"])
    both = np.zeros(code.slots * 2, np.uint32)
    for _, e in context_mixing.text_runs(batch(texts), code):
        np.add.at(both, e.slots * 2 + e.bits, np.uint32(1))
    trainer = context_mixing.TextTrainer(both.view(np.uint64), code)
    trainer.learn(batch(texts))
    refined = (trainer.ones + 4) / (trainer.all + 8)
    model = context_mixing.TextModel(both.view(np.uint64), code, trainer.weights, refined)
    for before in ([], [0], [0, 1], [3, 99]):
        ends = [model.log10(batch([[*before, w]]))[-1] for w in (0, 1, 2, 3, 500)]
        assert sum(10**x for x in ends) == pytest.approx(1, abs=1e-5)
    alone = [model.log10(batch([t])) for t in texts]
    assert np.allclose(np.concatenate(alone), model.log10(batch(texts)))


def test_probabilities_sum_to_one():
    """All bit strings of one code tree: the chances of the symbols at a place sum to one."""
    tree = context_mixing.code_tree(np.arange(257))
    zero, one = np.zeros((2, context_mixing.SLOTS), np.float32)
    trainer = context_mixing.Trainer(zero, one, tree)
    trainer.learn([b"ab", b"abc", b""], np.array([5, 1, 9]))
    refined = (trainer.ones + 4) / (trainer.all + 8)
    model = context_mixing.Model(context_mixing.stretched(zero, one), zero + one, trainer.weights, refined, tree)
    assert sum(10 ** model.log10([bytes([b])])[0] for b in range(256)) <= 1
    first, nodes, bits = tree
    assert sum(2.0 ** -(b - a) for a, b in zip(first, first[1:])) == pytest.approx(1) and len(nodes) == len(bits) == first[-1]


def test_url_filter(spark):
    url = ["http://a.Example.ORG/es/x", "http://example.org/en/1?q", "http://x.org", "http://x.org/", "https://y.com/de/a#b", "http://y.com/fr/", "nothing", "", None,
           "http://notexample.org/es/", "http://z.net/p", "http://z.net/p", "u:p@h://[::1]:80", "a://b://c/d", "http://bad.co.uk:81/x"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(url)], "page_id bigint, url string, host string, verdict string")
    outcomes = spark.createDataFrame([("http://bad.co.uk:81/", 1)] * 60 + [("http://z.net/", 0)] * 60 + [(None, 1), ("http://z.net/", None)], "url string, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert len(got) == len(url)
    assert [got[i].rule for i in range(7)] == ["example.org/es/", "example.org/en/1", None, "org/", "com/de/", "com/fr/", None]
    assert [got[i].verdict for i in (0, 1, 3, 4, 5, 10, 14)] == ["block", "block", "allow", "block", "allow", "allow", "block"]
    assert [(got[i].host, got[i].path) for i in (0, 6, 8, 9, 13)] == [("a.example.org", "/es/x"), ("", ""), ("", ""), ("notexample.org", "/es/"), ("b:", "//c/d")]
    assert got[9].rule == "org/"
    assert url_filter.filter_urls(pages.limit(0), outcomes).isEmpty() and url_filter.filter_urls(pages, outcomes.limit(0)).count() == len(url)


def test_near_classes(spark, odd, none):
    rows = near_dup.near_classes(odd).collect()
    assert len(rows) == odd.count()
    by = lambda i: [r for r in rows if r.doc_id == i]
    assert all(r.class_id == 1 and r.class_size == 5 and r.n_copies == 5 for i in (1, 2, 3) for r in by(i))
    assert all(r.class_size == 1 for i in (4, 5, 6, 9) for r in by(i)) and by(8)[0].class_id == 7
    kept = near_dup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id IN (2, 3, 8)").isEmpty()
    assert near_dup.near_classes(none).isEmpty()


def test_large_groups_of_near_copies(spark, monkeypatch):
    """A base text and copies with a changed word each: more than a bucket, every copy is like the base."""
    monkeypatch.setattr(near_dup, "BUCKET", 4)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        words[rng.randrange(120)] = f"changed{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"o{i}_{j}" for j in range(50))) for i in range(20)]
    got = near_dup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.class_id == (0 if r.doc_id < 60 else r.doc_id) for r in got)
    assert sum(r.n_links for r in got) < 60 * 59  # not all pairs


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (50, 60), (50, 61), (62, 60)]
    got = {r.rid: r.label for r in near_dup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and {got[i] for i in (50, 60, 61, 62)} == {50}


def test_shards(spark, odd, none):
    narrow = odd.withColumn("bytes", sharding.text_bytes(F.col("text")))
    got = sharding.assign_shards(narrow, ["doc_id"], "bytes", 4).collect()
    assert len(got) == odd.count() and all(0 <= r.shard < 4 and r.row == "r" for r in got)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(none, ["doc_id"], "size").isEmpty()
    zero = sharding.assign_shards(odd.withColumn("zero", F.lit(None).cast("int")), ["doc_id"], "zero").collect()
    assert {r.shard for r in zero} == {0}


def test_mix(spark, odd, none):
    drawn = mixing.mix(odd, mixing.word_count(F.col("text")), block_words=3, n_shards=4)
    rows = drawn.collect()
    sizes = {(r.source_size, r.target) for r in rows}
    assert sum(r.words for r in rows) == pytest.approx(sum(t for _, t in sizes), abs=3)
    assert all((r["pass"] is None) == (r.words == 0) for r in rows)
    blocks = [r for r in rows if r.words]
    assert {r.shard for r in blocks} <= set(range(4))
    assert mixing.mix(none, F.col("size")).isEmpty()
    whole = mixing.mixed_documents(odd)
    assert whole.columns == odd.columns
    empty = mixing.mix(odd, F.lit(0)).collect()
    assert len(empty) == odd.count() and all(r.words == 0 and r.target == 0 for r in empty)


def test_exact_dedup(spark, odd, none):
    for bits in (exact_dedup.MAX_FILTER_BITS, 32_768):
        rows = exact_dedup.duplicate_groups(odd, max_bits=bits).collect()
        assert len(rows) == odd.count()
        first = [r for r in rows if r.keep_id == 3]
        assert len(first) == 5 and {r.group_size for r in first} == {5} and [r.doc_id for r in first if r.kept] == [3]
        blank = [r for r in rows if r.doc_id in (4, 5, 6)]
        assert {r.keep_id for r in blank} == {6} and {r.group_size for r in blank} == {4}
        assert [r.kept for r in rows if r.doc_id == 8] == [False]
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 9, 10, 11]
    assert exact_dedup.duplicate_groups(none).isEmpty() and exact_dedup.drop_duplicates(none).isEmpty()
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id bigint, text string")
    assert sum(r.kept for r in exact_dedup.duplicate_groups(twice).collect()) == 1 and exact_dedup.drop_duplicates(twice).count() == 1


def test_filter_segments(spark):
    """More rows than one filter holds: the hash range is worked through in segments, with the same result."""
    docs = spark.range(9000).select((F.col("id")).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 7000).cast("string")).alias("text"))
    rows = exact_dedup.duplicate_groups(docs, max_bits=32_768)
    assert rows.where("group_size = 2").count() == 4000 and rows.where("kept").count() == 7000
    singles, maybe = exact_dedup.RepeatFilter(docs, "text", 32_768).split(docs, "text")
    assert singles.count() + maybe.count() == 9000 and maybe.count() < 5000


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i) if i != 7 else None, [float(x) for x in rng.normal(size=8)], 1.0) for i in range(300)]
    rows += [(20, [1.0] * 8, 2.0), (20, [1.0] * 8, 2.0), (500, None, 0.0), (501, [None, 1.0], 0.0), (502, [float("nan")], 0.0), (503, [], 0.0), (504, [2.0] * 3, 0.0), (505, [1e30], 0.0), (520, [-6e5, 2.5], 0.0), (540, [3e9, 7e8], 0.0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score double")
    got = topk.topk(df, "vec_id % 20 = 0", k=15).collect()

    def whole(v):
        return [cut(int(np.floor(64 * x))) for x in v]

    cut = lambda x: max(1 - 2**63, min(2**63 - 1, x))
    sound = [(i, whole(v)) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (q, x) in enumerate(sound):
        if q is not None and q % 20 == 0:
            scores = sorted((-cut(sum(s * t for s, t in zip(x, y))), i if i is not None else 2**63) for b, (i, y) in enumerate(sound) if a != b)[:15]
            want += [(q, r + 1, i if i < 2**63 else None, -s) for r, (s, i) in enumerate(scores)]
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert topk.topk(df.limit(0), "vec_id % 20 = 0").isEmpty()
    few = topk.topk(spark.createDataFrame(rows[:3], df.schema), "vec_id = 0").collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_substring_dedup(spark, odd, none):
    done, candidates = substring_dedup.repeats(odd)
    cleaned = substring_dedup.remove_repeats(candidates)
    assert done.count() + candidates.count() == odd.count()
    rows = {r.doc_id: r for r in cleaned.collect()}
    assert rows[8].n_removed == 60_000 and rows[8].kept == "" and rows[7].n_removed < 60_000
    done, candidates = substring_dedup.repeats(none)
    assert done.isEmpty() and candidates.isEmpty()


def test_substring_dedup_brute_force(spark):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for i in range(40):
        words = [f"d{i}_{j}" for j in range(rng.randint(0, 120))]
        at, a = rng.randint(0, len(words)), rng.randint(0, 40)
        rows.append((rng.choice([i, i, i // 2, None]), " ".join(words[:at] + passage[a : a + rng.randint(20, 80)] + words[at:])))
    rows += [(50, "w " * 200), (51, "w " * 120), (52, " ".join(passage * 3))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    done, candidates = substring_dedup.repeats(df, length=50)
    got = sorted([(r.doc_id is None, r.doc_id or 0, r.n_words, 0) for r in done.collect()]
                 + [(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(candidates).collect()])
    least: dict = {}
    last = 2**63
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            s = tuple(w[k : k + 50])
            least[s] = min(least.get(s, last), last if i is None else i)
    want = []
    for i, t in rows:
        w = t.split()
        gone = {j for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < (last if i is None else i) for j in range(k, k + 50)}
        want.append((i is None, i or 0, len(w), len(gone)))
    assert got == sorted(want) and any(x[3] for x in want)


def test_classifier(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (9, 0), (11, 0), (None, 0), (3, None), (77, 1)], "doc_id bigint, quality int")
    got = classifier.classify(odd, labels, how=classifier.Fit(passes=2))
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and got.columns[: len(odd.columns)] == odd.columns
    assert len({r.score for r in rows if not (r.text or "").strip()}) <= 2 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert classifier.classify(none, labels).isEmpty()
    bare = classifier.classify(odd, labels.limit(0)).collect()
    assert {round(r.score, 3) for r in bare} == {0.5}
    assert classifier.keep_good(odd, labels, how=classifier.Fit(passes=1)).columns == odd.columns


def dense_family():
    """Texts with one body (more than a bucket) that are not alike, with near copies of some among them, and chains X-Y-leader."""
    rng, body = random.Random(5), [f"b{i}" for i in range(200)]
    rows = []
    for i in range(0, 240, 2):
        own = [f"o{i}_{j}" for j in range(30)]
        rows.append((i, " ".join(body + own)))
        rows.append((i + 1, " ".join(body + own[:-2] + [f"p{i}", f"q{i}"] if i % 4 else body[:60] + [f"r{i}"] + body[61:])))
    for i in range(1000, 1060, 3):
        own = [f"c{i}_{j}" for j in range(44)]
        rows += [(i, " ".join(body + own[:12])), (i + 1, " ".join(body + own[:28])), (i + 2, " ".join(body + own))]
    rng.shuffle(rows)
    return rows


def all_links(rows):
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    found, ids = {i: set() for i in sets}, sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            same = len(sets[a] & sets[b])
            if same / (len(sets[a]) + len(sets[b]) - same) >= 0.8:
                found[a].add(b)
                found[b].add(a)
    return found


def class_of(found):
    label = {}
    for i in sorted(found):
        todo = [i] if i not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += found[x]
    return label


def spread_family():
    """Texts of one body that are about 0.66 alike, more than a bucket, with a text 0.82 alike for each."""
    body, rows = [f"b{i}" for i in range(400)], []
    for i in range(0, 240, 2):
        own = [f"o{i}_{j}" for j in range(100)]
        rows += [(i, " ".join(body + own)), (i + 1, " ".join(body + own[:50] + [f"p{i}_{j}" for j in range(50)]))]
    return rows


def test_dense_family_keeps_its_pairs(spark, monkeypatch):
    """Rows that are not linked to each other fill the buckets; the pairs among them stay together."""
    monkeypatch.setattr(near_dup, "BUCKET", 4)
    rows = spread_family()
    want = class_of(all_links(rows))
    got = near_dup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want and len(set(want.values())) == 120


def test_prefix_length_depends_on_recall_only():
    """The chance at the threshold itself reaches the recall, however alike the pairs of the table are."""
    assert near_dup.prefix_length(0.999) == 4
    for recall in (0.99, 0.9999, 0.99999):
        d = near_dup.prefix_length(recall)
        assert 1 - (1 - 0.8**d) ** near_dup.TREES >= recall > 1 - (1 - 0.8 ** (d + 1)) ** near_dup.TREES


def test_all_links_of_a_dense_family(spark):
    rows = dense_family()
    want = all_links(rows)
    got = near_dup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), all_links=True).collect()
    assert {r.doc_id: r.class_id for r in got} == class_of(want)
    assert {r.doc_id: r.n_links for r in got} == {i: len(x) for i, x in want.items()}


def test_classifier_learns_from_6000_rows(spark):
    rows = [(i, f"a{i % 97} b{i % 89} c{i}", i % 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    how = classifier.Fit(passes=1, steps=1)
    got, want = (classifier.train(df, df, how=how, **more) for more in ({}, {"rows": 10_000}))
    assert np.array_equal(got.table, want.table) and np.array_equal(got.bias, want.bias)
    ids, n = classifier.counted(np.frombuffer(b"a b a b", np.uint8))
    assert n.itemsize == 1 and len(ids) == len(n) and len(classifier.counted(np.zeros(0, np.uint8))[0]) == 0


def test_token_lists_are_the_tokens_of_each_text():
    """The tokens cut for many texts at once are those of each text alone, whatever white space and letters it has."""
    letters = random.Random(3)
    texts = [None, "", " ", "\t\n", "A", " A b\x0b\x0cC\r\n", "É ÀB c   d", "x\x1cy\x1fz \x85 \x00", "İ ẞ"]
    texts += ["".join(letters.choice("aB \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85 é") for _ in range(letters.randrange(40))) for _ in range(500)]
    cut = context_mixing.token_lists(pa.array(texts, pa.string())).cast(pa.list_(pa.binary()))
    assert cut.to_pylist() == [context_mixing.tokens_of(t) for t in texts]


def test_text_inputs_leave_out_the_event_itself():
    """Log odds by the table of nodes and bits are those of the counts without the event, in every order."""
    code = context_mixing.TextCode.of(np.array([5, 3, 2]), 20)
    words = np.array([0, 1, 2, 9, 0, 0, 1, 9], np.int64)
    one, two = context_mixing.earlier_tokens(words, np.array([5, 3]))
    e = context_mixing.text_events(words, one, two, code)
    both = np.zeros((code.slots, 2), np.uint32)
    for slots in e.slots:
        np.add.at(both, (slots, e.bits), 1)
    x, g = context_mixing.TextInputs(both.view(np.uint64).ravel(), code.words, own=True).of(e)
    gates = np.zeros(len(e.bits), np.int64)
    for o, slots in enumerate(e.slots):
        zero, one_ = both[slots, 0] - (e.bits == 0), both[slots, 1] - (e.bits == 1)
        assert np.allclose(x[o], np.log((one_ + 0.4) / (zero + 0.4)), atol=1e-5)
        if o:
            total = zero + one_
            gates = gates * 4 + (total >= 1).astype(int) + (total >= 3) + (total >= 16)
    assert (g == gates).all() and e.lengths.sum() == len(e.bits)
