"""Near duplicates: Jaccard join on word shingles with a MinHash LSH forest and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bytetext import U, mixed, pieces, span_hash, window_hashes, word_hashes, words
from ledgerlens.llm.order import packed
from ledgerlens.session import written

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 6
RECALL = 0.999
MARGIN = 0.18  # below the threshold, over four standard deviations of an estimate from all hashes
BUCKET = 64  # buckets up to this size give pairs, larger ones are compared block by block (results do not depend on it)
FEW, COLUMNS = 16, 4096  # of the comparison of blocks: shingles of so many rows go pair by pair; columns of its matrices
BLOCK_SHINGLES = 1 << 21  # of a block of a dense group


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, and where each text's begin.  A text of fewer words is one shingle, of none has none."""
    starts, ends, bounds = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    whole = window_hashes(hashes, SHINGLE)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= SHINGLE:
            sets.append(np.unique(whole[a : b - SHINGLE + 1]))
        else:
            sets.append(span_hash(hashes[a:b], np.array([0]), np.array([b - a])) if b > a else np.zeros(0, U))
    cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), cut


def _signatures(rows: DataFrame) -> DataFrame:
    """Per row: number of shingles, identity of the set (two 64-bit hashes) and its MinHashes (TREES x DEPTH)."""
    n = TREES * DEPTH
    factors = (mixed(np.arange(1, n + 1, dtype=U)) | U(1)).tolist()
    shifts = mixed(np.arange(n + 1, 2 * n + 1, dtype=U)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column("text")):
                sets, cut = shingle_sets(data, offsets)
                some = np.flatnonzero(np.diff(cut) > 0)
                at = cut[:-1][some]
                sums, mixes, least = np.zeros(end - first, U), np.zeros(end - first, U), np.zeros((end - first, n), np.uint32)
                if len(some):
                    sums[some] = np.add.reduceat(mixed(sets), at)
                    mixes[some] = np.bitwise_xor.reduceat(mixed(sets + U(1)), at)
                    for k in range(n):
                        least[some, k] = np.minimum.reduceat((sets * U(factors[k]) + U(shifts[k])) >> U(32), at).astype(np.uint32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (end - first + 1) * n, n, dtype=np.int32)), pa.array(least.view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([
                    batch.column("rid").slice(first, end - first), pa.array(np.diff(cut)), pa.array(sums.view(np.int64)), pa.array(mixes.view(np.int64)), lists,
                ], ["rid", "n_shingles", "s1", "s2", "hashes"])

    return rows.select("rid", "text").mapInArrow(run, "rid bigint, n_shingles bigint, s1 bigint, s2 bigint, hashes array<int>")


def jaccard(left: Column, right: Column) -> Column:
    """Exact Jaccard similarity of the shingle sets of two whole texts."""

    @F.arrow_udf("double")
    def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        def sets(texts: pa.Array) -> Iterator[np.ndarray]:
            for _, _, data, offsets in pieces(texts, 1 << 20):
                every, cut = shingle_sets(data, offsets)
                for x, y in zip(cut[:-1], cut[1:]):
                    yield every[x:y]

        found = []
        for x, y in zip(sets(a), sets(b)):
            both = np.concatenate([x, y])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            found.append(same / (len(both) - same) if len(both) else 0.0)
        return pa.array(found, pa.float64())

    return similarity(left, right)


def _alike(a: str, b: str) -> Column:
    """Share of equal MinHashes of two rows: an estimate of the similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / float(TREES * DEPTH)


def _estimated(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) with the estimated similarity, where it does not exclude the threshold."""
    left = signatures.select(F.col("rid").alias("a"), F.col("hashes").alias("ha"))
    right = signatures.select(F.col("rid").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", _alike("ha", "hb").alias("like")).where(F.col("like") >= THRESHOLD - MARGIN)


def _buckets(signatures: DataFrame, depths: range) -> DataFrame:
    """(bucket, rid, size) of every prefix of these lengths in every tree that two rows or more share."""
    prefix = [F.xxhash64(F.lit(t), F.lit(d), F.slice("hashes", t * DEPTH + 1, d)) for t in range(TREES) for d in depths]
    members = signatures.select("rid", F.explode(F.array(*prefix)).alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return written(members.join(sizes, "bucket"), "near-buckets")


def _all_pairs(small: DataFrame) -> DataFrame:
    """Pairs of rows that share a bucket of at most BUCKET rows."""
    left, right = small.select("bucket", F.col("rid").alias("a")), small.select("bucket", F.col("rid").alias("b"))
    return left.join(right, "bucket").where("a < b").select("a", "b").distinct()


def dense_groups(large: DataFrame) -> DataFrame:
    """(rid, g): rows that share buckets of more than BUCKET rows, directly or over other rows, are one group."""
    least = large.groupBy("bucket").agg(F.min("rid").alias("a"))
    edges = large.join(least, "bucket").where("a <> rid").select("a", F.col("rid").alias("b")).distinct()
    return written(components(edges).withColumnRenamed("label", "g"), "near-dense")


def _linked(sets: np.ndarray, cut: np.ndarray, left: int) -> np.ndarray:
    """Symmetric matrix of which rows are linked: of the first ``left`` rows with the others, or of all rows if there are no others."""
    m = len(cut) - 1
    both = np.zeros((m, m))
    at = slice(0, left), slice(left if left < m else 0, m)
    row = np.repeat(np.arange(m), np.diff(cut))
    order = np.argsort(sets, kind="stable")
    sets, row = sets[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]]))
    times = np.diff(np.append(first, len(sets)))
    often = np.repeat(times, times)
    # shingles of few rows pair by pair, the others as columns of a matrix
    some = (often > 1) & (often <= FEW)
    s, r = sets[some], row[some]
    for k in range(1, min(FEW, len(s))):
        same = s[k:] == s[:-k]
        both += np.bincount(r[:-k][same] * m + r[k:][same], minlength=m * m).reshape(m, m)
    both += both.T
    column, r = np.repeat(np.cumsum(times > FEW) - 1, times)[often > FEW], row[often > FEW]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [c, c + COLUMNS])
        x = np.zeros((m, COLUMNS), np.float32)
        x[r[i:j], column[i:j] - c] = 1
        both[at] += x[at[0]] @ x[at[1]].T
    sizes = np.diff(cut)
    linked = np.zeros((m, m), bool)
    linked[at] = both[at] / (sizes[at[0], None] + sizes[None, at[1]] - both[at]) >= THRESHOLD
    np.fill_diagonal(linked, False)
    return linked | linked.T


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same rows as all links, one less than the rows of each component."""
    new, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        todo = [root] if new[root] else []
        new[root] = False
        while todo:
            x = todo.pop()
            found = np.flatnonzero(linked[x] & new).tolist()
            new[found] = False
            edges += [(x, y) for y in found]
            todo += found
    return edges


def dense_links(groups: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    """Every two rows of a group compared exactly, on the whole texts.  The rows of a group are dealt into blocks; each two
    blocks meet in a task of their own, which gives no pairs: for each row its number of links to the other block
    (rid, n_links; b is null), and links (rid, b) that connect the same rows as all links do."""
    members = groups.join(signatures.select("rid", "n_shingles"), "rid")
    rows = F.count("*")
    blocks = F.ceil(F.greatest(rows / F.least(F.greatest(rows / 8, F.lit(128)), F.lit(1024)), F.sum("n_shingles") / BLOCK_SHINGLES))
    members = members.join(members.groupBy("g").agg(blocks.alias("blocks")), "g").join(texts, "rid")
    dealt = members.select("g", "rid", "text", F.pmod(F.xxhash64("rid"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("rid", "ascending")])
        block, rid = table.column("block").to_numpy(), table.column("rid").to_numpy()
        parts = [shingle_sets(data, offsets) for chunk in table.column("text").chunks for _, _, data, offsets in pieces(chunk)]
        cut = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c) for _, c in parts]))])
        linked = _linked(np.concatenate([x for x, _ in parts]), cut, int((block == block[0]).sum()))
        if block[0] == block[-1] and table.column("i")[0] != table.column("j")[0]:
            linked[:] = False  # the other block has no rows
        n, edges = linked.sum(1), np.array(_forest(linked), np.int64).reshape(-1, 2)
        some = np.flatnonzero(n)
        return pa.table({
            "rid": pa.array(np.concatenate([rid[some], rid[edges[:, 0]]])),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rid[edges[:, 1]])]),
            "n_links": pa.array(np.concatenate([n[some], np.zeros(len(edges), np.int64)])),
        })

    tiles = dealt.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", "text")
    return written(tiles.groupBy("g", "i", "j").applyInArrow(compare, "rid bigint, b bigint, n_links bigint"), "near-dense-links")


def prefix_length(recall: float) -> int:
    """The longest prefix at which two rows of similarity THRESHOLD share one in some tree with a chance of ``recall`` at least;
    more similar rows do so more often, whatever else is in the table."""
    return max((d for d in range(1, DEPTH + 1) if 1 - (1 - THRESHOLD**d) ** TREES >= recall), default=1)


def candidate_pairs(signatures: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame | None]:
    """LSH forest: rows that share a prefix of a tree's hashes meet.

    Returns the pairs (a, b) of rows that meet in a bucket of at most BUCKET rows, unless the estimated similarity excludes
    them, and the groups of the rows in larger buckets, if any (see dense_groups).  Pairs within a group are left to it.
    """
    depth = prefix_length(recall)
    met = _buckets(signatures, range(depth, depth + 1))
    pairs = _estimated(_all_pairs(met.where(F.col("size") <= BUCKET)), signatures)
    large = met.where(F.col("size") > BUCKET)
    if large.isEmpty():
        return written(pairs, "near-pairs"), None
    groups = dense_groups(large)
    of = lambda c: groups.select(F.col("rid").alias(c), F.col("g").alias(f"g{c}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("ga IS NULL OR gb IS NULL OR ga <> gb")
    return written(pairs.select("a", "b", "like"), "near-pairs"), groups


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): one row per node, ``rid`` and ``label``, the smallest node of its component.

    Every round takes the smallest label of the neighbours and then the label of the label; each round is written to the
    shared folder.
    """
    both = written(edges.select(F.col("a").alias("rid"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("rid"), F.col("a").alias("other"))), "near-edges")
    labels = written(both.groupBy("rid").agg(F.least(F.col("rid"), F.min("other")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("rid").alias("other"), F.col("label").alias("seen")), "other").groupBy("rid").agg(F.min("seen").alias("seen"))
        low = labels.join(near, "rid").select("rid", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        low = written(low, "near-labels")
        jump = low.select(F.col("rid").alias("label"), F.col("label").alias("further"))
        new = written(low.join(jump, "label", "left").select("rid", "old", F.least("label", "further").alias("label")), "near-labels")
        if new.where("label <> old").isEmpty():
            return new.select("rid", "label")
        labels = new.select("rid", "label")


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("bigint").alias("n_links"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, all_links: bool = False) -> DataFrame:
    """Class of near duplicates of every row.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles (words as they stand; 64-bit hashes)
    is 0.8 or more.  Rows of equal sets are copies and take part once, by their first row.  Candidates come from
    ``candidate_pairs``, and from dense groups all pairs; every link is verified on the whole texts.  Classes are the connected components of the links.

    Columns: ``row`` (struct of the columns of ``docs``), ``rid`` (number of the row), ``doc_id``, ``class_id`` (smallest id of the class, null
    ids last), ``class_size`` (rows), ``n_links`` (verified links of the row's text to other texts: all with
    ``all_links``, else within dense groups only those that connect them), ``n_copies`` (rows of an equal set, itself included) and ``first`` (whether
    the row is the one of its class to stay: the smallest id, then row number).

    Texts without words (null, empty) have no shingles and are classes of their own row; texts of fewer than five words are one shingle.
    An empty table gives no rows.
    """
    base = written(docs.select(
        packed(docs), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid")), "near-rows")
    texts = base.select("rid", F.col(f"row.`{text_col}`").alias("text"))
    signed = written(_signatures(texts), "near-signatures")
    sets = signed.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("rid").alias("rep"), F.count("*").alias("n_copies"))
    same = signed.select("rid", "s1", "s2", "n_shingles").join(sets, ["s1", "s2", "n_shingles"], "left")
    same = written(same.select("rid", F.coalesce("rep", "rid").alias("rep"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")), "near-copies")
    reps = written(signed.join(sets.select(F.col("rep").alias("rid")), "rid").select("rid", "n_shingles", "hashes"), "near-reps")

    pairs, groups = candidate_pairs(reps, recall)
    sided = pairs.join(texts.withColumnsRenamed({"rid": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"rid": "b", "text": "tb"}), "b")
    links = written(sided.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("jaccard")).where(F.col("jaccard") >= THRESHOLD).select("a", "b"), "near-links")
    degree = _ends(links)
    if groups is not None:
        dense = dense_links(groups, reps, texts)
        joined = dense.where("b IS NOT NULL").select(F.col("rid").alias("a"), "b")
        degree = degree.unionByName(dense.where("b IS NULL").select(F.col("rid").alias("rep"), "n_links") if all_links else _ends(joined))
        links = written(links.unionByName(joined), "near-links")
    degree = degree.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    label = components(links).withColumnRenamed("rid", "rep")
    placed = same.join(label, "rep", "left").join(degree, "rep", "left").select(
        "rid", F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    ids = placed.join(base.select("rid", "doc_id"), "rid")
    ids = written(ids, "near-placed")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    classes = ids.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    done = ids.join(classes, "label").select(
        "rid", F.col("first.doc_id").alias("class_id"), "class_size", "n_links", "n_copies", (F.col("first.rid") == F.col("rid")).alias("first"))
    return base.select("row", "rid", "doc_id").join(done, "rid")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, whole: the one of the smallest id (see near_classes)."""
    return near_classes(docs, **options).where("first").select("row.*")


def op4_near_duplicates(documents: DataFrame) -> DataFrame:
    return near_classes(documents.select("doc_id", "text"), all_links=True).select("doc_id", "class_id", "class_size", "n_links", "n_copies")
