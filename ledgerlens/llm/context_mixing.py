"""Language-model scores by online logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bytetext import U, byte_values, mixed, span_hash
from ledgerlens.llm.classifier import id_class
from ledgerlens.session import written

END = 256  # symbol after the last byte of a token; the end of a text is the token without bytes
TABLES = (10, 16, 18, 20, 20, 20)  # log2 of the slots for contexts of 0 to 4 bytes and of the whole token so far
ORDERS = len(TABLES)
SLOTS = sum(1 << b for b in TABLES)
CHUNK = 1 << 15
LEVELS = ORDERS - 1 + 4
GATES = 4 * LEVELS
STEPS = 33  # places of the refining table over -8 .. 8
HOT_WORDS = 1 << 18  # words whose counts travel to every task; all others are counted by a join
WORDS_AT_ONCE = 1024
LN10 = np.log(10)
RATE = 0.03  # of a step along the gradient divided by the curvature
KNOWN = (0, 0, 0, 2, 4)
OFTEN = (33, 257, 2049, 16385)
CODED_WORDS = 1 << 10  # most frequent words, which have a code of their own in running text; all others are spelled
TEXT_ORDERS = 3  # contexts of running text: no earlier token, the last one, the last two
TEXT_SLOTS = 21  # log2 of the most slots for the contexts of one order; small corpora take fewer
TEXT_LEVELS = (1, 3, 16)
TEXT_GATES = (len(TEXT_LEVELS) + 1) ** (TEXT_ORDERS - 1)
TOKENS_AT_ONCE = 2048
TEXTS_AT_ONCE = 256
START = (1 << 31) - 1  # stands before the first token of a text


def code_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary code of the 257 symbols by their counts (Huffman): for each symbol its first place in the flat arrays, then per
    place the inner node passed (0 is the root) and the bit taken."""
    heap = [(int(n) + 1, s, s) for s, n in enumerate(counts)]
    heapq.heapify(heap)
    parent, made = {}, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], parent[b[2]] = (made, 0), (made, 1)
        heapq.heappush(heap, (a[0] + b[0], made, made))
        made += 1
    first, nodes, bits = [0], [], []
    for s in range(len(counts)):
        path, at = [], s
        while at in parent:
            at, bit = parent[at]
            path.append((made - 1 - at, bit))
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
        first.append(len(nodes))
    return np.array(first), np.array(nodes, np.int64), np.array(bits, np.int8)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Events:
    """Bit events of some tokens: slots (events x ORDERS), bit, token and byte position of each event."""

    slots: np.ndarray
    bits: np.ndarray
    token: np.ndarray
    place: np.ndarray


def events(tokens: list[bytes], tree) -> Events:
    first, nodes, bits = tree
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    symbols = np.full(ends[-1] if len(ends) else 0, END, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(tokens), np.uint8)
    starts = np.repeat(ends - sizes, sizes)
    place = np.arange(len(symbols)) - starts
    # contexts: nothing, the last 1 to 4 bytes (0 before the token), all bytes so far
    contexts = [np.zeros(len(symbols), U)]
    h = np.zeros(len(symbols), U)
    for k in range(1, 5):
        before = np.zeros(len(symbols), U)
        before[k:] = symbols[:-k] + 1
        before[place < k] = 0
        h = mixed(h * U(0x9E3779B97F4A7C15) + before + U(k))
        contexts.append(h)
    contexts.append(span_hash(byte_values(3)[symbols & 255], starts, starts + place, 1))
    lengths = np.diff(first)[symbols]
    at = np.repeat(np.arange(len(symbols)), lengths)
    flat = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + first[symbols][at]
    node = nodes[flat].astype(U)
    slots = np.empty((len(at), ORDERS), np.int32)
    base = 0
    for o, (context, size) in enumerate(zip(contexts, TABLES)):
        key = mixed(context[at] + node * U(0xD1342543DE82EF95) + U(o)) if o else node
        slots[:, o] = base + (key & U((1 << size) - 1)).astype(np.int64)
        base += 1 << size
    token = np.repeat(np.repeat(np.arange(len(tokens)), sizes), lengths)
    return Events(slots, bits[flat], token, place[at])


def stretched(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log odds of a one after these counts."""
    return np.log((one + 0.4) / (zero + 0.4))


def gate(place: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which weights mix: by the byte position in the token (0, 1, 2, later) and by what is known before (see level)."""
    return np.minimum(place, 3) * LEVELS + seen


def level(totals: np.ndarray) -> np.ndarray:
    """How well the contexts (columns) are known: how often the whole token so far came, in steps, and where that is
    seldom, as the slots are shared, the longest context of 0 to 4 bytes above its number in KNOWN."""
    longest = np.zeros(len(totals), np.int64)
    for o in range(ORDERS - 1):
        longest[totals[:, o] > KNOWN[o]] = o
    often = sum((totals[:, -1] >= least).astype(np.int64) for least in OFTEN)
    return np.where(often > 0, ORDERS - 2 + often, longest)


def refining_place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower of the two places beside ``x``, and how far x is towards the upper."""
    x = (np.clip(x, -7.99, 7.99) + 8) * 2
    low = x.astype(np.int64)
    return low, x - low.astype(x.dtype)


def first_weights() -> np.ndarray:
    """Start of the learning: the whole token so far alone where it is known, else all contexts alike."""
    weights = np.full((4, LEVELS, ORDERS), 0.3)
    weights[:, :, 0] = 0.0
    weights[:, ORDERS - 1 :] = 0.02
    weights[:, ORDERS - 1 :, -1] = 0.9
    return weights.reshape(GATES, ORDERS)


class Trainer:
    """Mixing weights and refining table, learnt online from tokens in the order in which they come.

    Every event is predicted as if one occurrence of its token had not been counted.  Weights move along the gradient of the
    coding cost, scaled by its curvature; the refining table gathers how often a one came where the mix said x.
    """

    def __init__(self, zero: np.ndarray, one: np.ndarray, tree) -> None:
        self.zero, self.one, self.tree = zero, one, tree
        self.weights = first_weights()
        self.bend = np.full((GATES, ORDERS), 1e-3)
        self.ones, self.all = np.zeros((2, GATES, STEPS))
        self.tokens = 0.0

    def learn(self, tokens: list[bytes], counts: np.ndarray) -> None:
        e = events(tokens, self.tree)
        bit = e.bits[:, None] == 1
        zero = np.maximum(self.zero.take(e.slots) - ~bit, 0)
        one = np.maximum(self.one.take(e.slots) - bit, 0)
        x = stretched(zero, one)
        g = gate(e.place, level(zero + one))
        mix = np.einsum("ij,ij->i", x, self.weights.astype(np.float32).take(g, axis=0))
        p = squash(mix)
        weight = (counts.astype(np.float64) ** 0.8)[e.token]  # frequent tokens count for more, but do not drown the others
        slope, bend = weight * (e.bits - p), weight * p * (1 - p)
        for o in range(ORDERS):
            up = np.bincount(g, slope * x[:, o], GATES)
            self.bend[:, o] = 0.95 * self.bend[:, o] + np.bincount(g, bend * x[:, o] ** 2, GATES)
            self.weights[:, o] += RATE * up / (0.05 * self.bend[:, o] + 1.0)
        low, part = refining_place(mix)
        for cell, share in ((g * STEPS + low, weight * (1 - part)), (g * STEPS + low + 1, weight * part)):
            self.ones += np.bincount(cell, share * e.bits, GATES * STEPS).reshape(GATES, STEPS)
            self.all += np.bincount(cell, share, GATES * STEPS).reshape(GATES, STEPS)
        self.tokens += len(tokens)


@dataclass
class Model:
    """Everything that scoring needs; of fixed size whatever the corpus."""

    logit: np.ndarray
    total: np.ndarray
    weights: np.ndarray
    refined: np.ndarray
    tree: tuple

    def log10(self, tokens: list[bytes]) -> np.ndarray:
        """log10 probability of each token; over all possible tokens the probabilities sum to one."""
        out = np.empty(len(tokens))
        weights, refined = self.weights.astype(np.float32), self.refined.ravel().astype(np.float32)
        for i in range(0, len(tokens), WORDS_AT_ONCE):
            some = tokens[i : i + WORDS_AT_ONCE]
            e = events(some, self.tree)
            g = gate(e.place, level(self.total.take(e.slots)))
            mix = np.einsum("ij,ij->i", self.logit.take(e.slots), weights.take(g, axis=0))
            low, part = refining_place(mix)
            cell = g * STEPS + low
            p = (squash(mix) + (1 - part) * refined.take(cell) + part * refined.take(cell + 1)) / 2
            p = np.clip(np.where(e.bits == 1, p, 1 - p), 1e-9, 1)
            out[i : i + len(some)] = np.bincount(e.token, np.log(p), len(some)) / LN10
        return out


@dataclass
class TextCode:
    """Binary code of the tokens of running text: word i of the first ``words`` by its own leaf, all others by the last leaf.
    ``size``: log2 of the slots for the contexts of one order."""

    tree: tuple
    words: int
    size: int

    @classmethod
    def of(cls, counts: np.ndarray, tokens: int) -> TextCode:
        """``counts``: of the words with a code; ``tokens``: all tokens learnt from."""
        tree = code_tree(np.append(counts, tokens - counts.sum()))
        return cls(tree, len(counts), min(TEXT_SLOTS, max(12, int(tokens).bit_length() + 2)))

    @property
    def slots(self) -> int:
        return self.words + ((TEXT_ORDERS - 1) << self.size)


def earlier_tokens(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the last token and of the last two before each token of some texts, which lie behind each other."""
    starts = np.cumsum(lengths) - lengths
    last = np.full(len(words), START, np.int64)
    last[1:] = words[:-1]
    last[starts] = START
    two = np.full(len(words), START, np.int64)
    two[1:] = last[:-1]
    two[starts] = START
    one = mixed(last.astype(U) + U(1))
    return one, mixed(one + two.astype(U) * U(0x9E3779B97F4A7C15))


@dataclass
class TextEvents:
    """Bit events of tokens of running text: slots (TEXT_ORDERS x events) and bit of each event, number of events of each token."""

    slots: np.ndarray
    bits: np.ndarray
    lengths: np.ndarray


def text_events(words: np.ndarray, one: np.ndarray, two: np.ndarray, code: TextCode) -> TextEvents:
    """Bits of the code of each token, each with its contexts over the earlier tokens of the text (see earlier_tokens)."""
    first, nodes, bits = code.tree
    symbols = np.minimum(words, code.words)
    start = first.take(symbols)
    lengths = first.take(symbols + 1) - start
    ends = np.cumsum(lengths)
    flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + lengths, lengths)
    slots = np.empty((TEXT_ORDERS, len(flat)), np.int64)
    slots[0] = nodes.take(flat)
    salt = (slots[0].view(U) + U(1)) * U(0xD1342543DE82EF95)
    for o, context in enumerate((one, two)):
        key = np.repeat(context, lengths)
        key ^= salt
        key *= U(0x9E3779B97F4A7C15)
        key >>= U(64 - code.size)
        np.add(key.view(np.int64), code.words + (o << code.size), out=slots[o + 1])
    return TextEvents(slots, bits.take(flat), lengths)


def text_lengths(batch: pa.RecordBatch) -> np.ndarray:
    """Tokens of each text of the column ``ids``, which holds their numbers in four bytes each."""
    return pc.binary_length(batch.column("ids")).to_numpy().astype(np.int64) // 4


def text_runs(batch: pa.RecordBatch, code: TextCode) -> Iterator[tuple[slice, TextEvents]]:
    """Events of all tokens of the column ``ids``, some thousand tokens at a time, in the order of the texts."""
    words = np.frombuffer(b"".join(plain(batch.column("ids"))), "<i4")
    one, two = earlier_tokens(words, text_lengths(batch))
    for i in range(0, len(words), TOKENS_AT_ONCE):
        some = slice(i, i + TOKENS_AT_ONCE)
        yield some, text_events(words[some], one[some], two[some], code)


def known_steps() -> np.ndarray:
    """How well a context is known that came 0, 1, .. times: number of TEXT_LEVELS reached."""
    return np.searchsorted(TEXT_LEVELS, np.arange(TEXT_LEVELS[-1] + 1), "right")


class TextInputs:
    """Log odds by each order, and which weights mix them: by how often the contexts came.  ``own``: the events are themselves
    among the counts and are left out.  Log odds without earlier tokens come from a table by node and bit."""

    def __init__(self, counts: np.ndarray, words: int, own: bool) -> None:
        self.counts, self.own, self.steps = counts, own, known_steps()
        zero, one = counts[:words].view(np.uint32).astype(np.float32).reshape(-1, 2).T
        less = np.float32(own)
        self.first = np.stack([stretched(np.maximum(zero - less, 0), one), stretched(zero, np.maximum(one - less, 0))], axis=1).ravel()

    def of(self, e: TextEvents) -> tuple[np.ndarray, np.ndarray]:
        x = np.empty(e.slots.shape, np.float32)
        x[0] = self.first.take(e.slots[0] * 2 + e.bits)
        ones = e.bits.astype(np.float32)
        g = np.zeros(e.slots.shape[1], np.int64)
        for o in range(1, TEXT_ORDERS):
            pair = self.counts.take(e.slots[o]).view(np.uint32).astype(np.float32)
            zero, one = pair[0::2], pair[1::2]
            if self.own:
                zero, one = zero - (1 - ones), one - ones
            x[o] = stretched(zero, one)
            g *= len(TEXT_LEVELS) + 1
            g += self.steps.take(np.minimum(zero + one, TEXT_LEVELS[-1]).astype(np.int64))
        return x, g


def text_mix(x: np.ndarray, weights: np.ndarray, g: np.ndarray) -> np.ndarray:
    return sum(x[o] * weights[o].astype(np.float32).take(g) for o in range(TEXT_ORDERS))


class TextTrainer:
    """Weights and refining table of running text, learnt online from texts in the order in which they come."""

    def __init__(self, counts: np.ndarray, code: TextCode) -> None:
        self.code = code
        self.inputs = None if counts is None else TextInputs(counts, code.words, own=True)
        self.weights = np.full((TEXT_ORDERS, TEXT_GATES), 0.35)
        self.weights[0, 0] = 1.0
        self.bend = np.full((TEXT_ORDERS, TEXT_GATES), 1e-3)
        self.ones, self.all = np.zeros((2, TEXT_GATES, STEPS))
        self.tokens = 0.0

    def learn(self, batch: pa.RecordBatch) -> None:
        for _, e in text_runs(batch, self.code):
            x, g = self.inputs.of(e)
            mix = text_mix(x, self.weights, g)
            p = squash(mix)
            slope, bend = e.bits - p, p * (1 - p)
            for o in range(TEXT_ORDERS):
                self.bend[o] = 0.95 * self.bend[o] + np.bincount(g, bend * x[o] ** 2, TEXT_GATES)
                self.weights[o] += RATE * np.bincount(g, slope * x[o], TEXT_GATES) / (0.05 * self.bend[o] + 1.0)
            low, part = refining_place(mix)
            cell = (g * STEPS + low) * 2 + e.bits
            found = np.bincount(cell, 1 - part, TEXT_GATES * STEPS * 2) + np.bincount(cell + 2, part, TEXT_GATES * STEPS * 2)
            found = found.reshape(TEXT_GATES, STEPS, 2)
            self.ones += found[:, :, 1]
            self.all += found.sum(2)
            self.tokens += len(e.lengths) if len(e.bits) else 0


@dataclass
class TextModel:
    """What predicts the code of a token from the tokens before it."""

    counts: np.ndarray
    code: TextCode
    weights: np.ndarray
    refined: np.ndarray

    def log10(self, batch: pa.RecordBatch) -> np.ndarray:
        """log10 probability of the code of every token of the column ``ids``; over the words with a code and the one leaf of
        all others the probabilities sum to one."""
        out = np.zeros(text_lengths(batch).sum())
        refined = self.refined.ravel().astype(np.float32)
        inputs = TextInputs(self.counts, self.code.words, own=False)
        for some, e in text_runs(batch, self.code):
            x, g = inputs.of(e)
            mix = text_mix(x, self.weights, g)
            low, part = refining_place(mix)
            cell = g * STEPS + low
            p = (squash(mix) + (1 - part) * refined.take(cell) + part * refined.take(cell + 1)) / 2
            p = np.clip(np.where(e.bits == 1, p, 1 - p), 1e-9, 1)
            out[some] = np.bincount(np.repeat(np.arange(len(e.lengths)), e.lengths), np.log(p), len(e.lengths)) / LN10
        return out


def _text_counts(texts: DataFrame, code: TextCode) -> np.ndarray:
    """How often a zero (lower half) and a one (upper half) came in each slot over all tokens of the running texts, summed over
    the tasks in two steps."""
    sent = texts.sparkSession.sparkContext.broadcast(code)

    def run(batches):
        own = sent.value
        both = np.zeros(own.slots * 2, np.uint32)
        for batch in batches:
            for _, e in text_runs(batch, own):
                once = np.ones(len(e.bits), np.uint32)
                for slots in e.slots:
                    np.add.at(both, slots * 2 + e.bits, once)
        part = TaskContext.get().partitionId()
        for c in range(-(-len(both) // CHUNK)):
            piece = both[c * CHUNK : (c + 1) * CHUNK]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([part // 64]), pa.array([piece.tobytes()])], ["chunk", "part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")], axis=0, dtype=np.uint64)
        total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "counts": [total.tobytes()]})

    kind = "chunk bigint, part bigint, counts binary"
    parts = texts.select("ids").mapInArrow(run, kind).groupBy("chunk", "part").applyInArrow(add, kind).groupBy("chunk").applyInArrow(add, kind)
    both = np.zeros(code.slots * 2, np.uint32)
    for chunk, _, raw in parts.toLocalIterator():
        piece = np.frombuffer(raw, np.uint32)
        both[chunk * CHUNK : chunk * CHUNK + len(piece)] = piece
    sent.unpersist()
    return both.view(np.uint64)


def train_texts(texts: DataFrame, code: TextCode):
    """Fit to the running texts (``ids``), all of them.  Returns (counts and code as one broadcast, weights, refining table);
    what reaches the driver is of bounded size."""
    sent = texts.sparkSession.sparkContext.broadcast((_text_counts(texts, code), code))

    def run(batches):
        own = TextTrainer(*sent.value)
        for batch in batches:
            own.learn(batch)
        values = np.concatenate([own.weights.ravel() * own.tokens, own.ones.ravel(), own.all.ravel(), [own.tokens]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "x"])

    shapes = (TEXT_ORDERS, TEXT_GATES), (TEXT_GATES, STEPS), (TEXT_GATES, STEPS)
    cut = np.cumsum([a * b for a, b in shapes])
    sums = np.zeros(cut[-1] + 1)
    for i, x in texts.select("ids").mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x")).collect():
        sums[i] = x
    weights, ones, every = (part.reshape(shape) for part, shape in zip(np.split(sums[:-1], cut[:-1]), shapes))
    if not sums[-1]:
        weights = TextTrainer(None, code).weights
    else:
        weights = weights / sums[-1]
    middle = squash((np.arange(STEPS) / 2) - 8)
    return sent, weights.astype(np.float32), (ones + 8 * middle) / (every + 8)


def _text_scores(table: DataFrame, trained) -> DataFrame:
    """``table`` with ``text_score`` in place of ``ids``: log10 probability of the codes of all its tokens, each after the tokens before it."""
    sent, weights, refined = trained
    kept = [f for f in table.schema.fields if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = TextModel(*sent.value, weights, refined)
        for batch in batches:
            ends = np.cumsum(text_lengths(batch))
            score = np.add.reduceat(model.log10(batch), np.r_[0, ends[:-1]]) if len(ends) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(score)], [f.name for f in kept] + ["text_score"])

    return table.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", text_score double")


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased (A-Z) text and one end."""
    return [*(text or "").encode().lower().split(), b""]


def plain(values: pa.Array) -> list:
    """Python values; by way of NumPy, which makes them many times faster than one Arrow scalar each."""
    return values.to_numpy(zero_copy_only=False).tolist()


def token_lists(texts: pa.Array) -> pa.ListArray:
    """``tokens_of`` each text: a blank behind the last word makes the split end with an empty word."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), "", pc.binary_join_element_wise(trimmed, " ", "")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the column ``text``; the end of a text is the empty word.  Words are counted in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                counted = pc.value_counts(token_lists(batch.column("text").slice(i, TEXTS_AT_ONCE)).flatten())
                for word, n in zip(plain(counted.field("values").cast(pa.binary())), plain(counted.field("counts"))):
                    found[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, WORDS_AT_ONCE):
            part = batch.slice(i, WORDS_AT_ONCE)
            yield plain(part.column("word")), part.column("n").to_numpy()


def _code(counts: DataFrame):
    def run(batches):
        total = np.zeros(END + 1, np.int64)
        for words, n in _runs(batches):
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            total[:END] += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(n, sizes), END).astype(np.int64)
            total[END] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(END + 1)), pa.array(total)], ["symbol", "n"])

    found = np.zeros(END + 1, np.int64)
    for symbol, n in counts.mapInArrow(run, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n")).collect():
        found[symbol] = n
    return code_tree(found)


def _slot_counts(counts: DataFrame, tree) -> tuple[np.ndarray, np.ndarray]:
    """How often a zero and a one came in each slot; SLOTS of each in all, summed over the tasks in two steps."""

    def run(batches):
        both = np.zeros(2 * SLOTS)
        for words, n in _runs(batches):
            e = events(words, tree)
            np.add.at(both, (e.slots + e.bits[:, None] * np.int64(SLOTS)).ravel(), np.repeat(n.astype(np.float64).take(e.token), ORDERS))
        both = both.reshape(2, SLOTS)
        part = TaskContext.get().partitionId()
        for c in range(-(-SLOTS // CHUNK)):
            piece = both[:, c * CHUNK : (c + 1) * CHUNK].astype(np.float32)
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([part // 64]), pa.array([piece.tobytes()])], ["chunk", "part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), np.float32) for x in table.column("counts")], axis=0, dtype=np.float64)
        return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "counts": [total.astype(np.float32).tobytes()]})

    kind = "chunk bigint, part bigint, counts binary"
    parts = counts.mapInArrow(run, kind).groupBy("chunk", "part").applyInArrow(add, kind).groupBy("chunk").applyInArrow(add, kind)
    both = np.zeros((2, SLOTS), np.float32)
    for chunk, _, raw in parts.toLocalIterator():
        piece = np.frombuffer(raw, np.float32).reshape(2, -1)
        both[:, chunk * CHUNK : chunk * CHUNK + piece.shape[1]] = piece
    return both[0], both[1]


def train(counts: DataFrame) -> Model:
    """Fit to the counted tokens, all of them; see score_texts.  What reaches the driver is of fixed size."""
    spark = counts.sparkSession
    tree = _code(counts)
    zero, one = _slot_counts(counts, tree)
    sent = spark.sparkContext.broadcast((zero, one))

    def run(batches):
        own = Trainer(*sent.value, tree)
        for words, n in _runs(batches):
            own.learn(words, n)
        values = np.concatenate([own.weights.ravel() * own.tokens, own.ones.ravel(), own.all.ravel(), [own.tokens]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "x"])

    sums = np.zeros(GATES * (ORDERS + 2 * STEPS) + 1)
    for i, x in counts.mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x")).collect():
        sums[i] = x
    sent.unpersist()
    cut = GATES * ORDERS, GATES * (ORDERS + STEPS), GATES * (ORDERS + 2 * STEPS)
    weights = sums[: cut[0]].reshape(GATES, ORDERS) / max(1.0, sums[-1]) if sums[-1] else first_weights()
    ones, every = sums[cut[0] : cut[1]].reshape(GATES, STEPS), sums[cut[1] : cut[2]].reshape(GATES, STEPS)
    middle = squash((np.arange(STEPS) / 2) - 8)
    return Model(stretched(zero, one), zero + one, weights, (ones + 8 * middle) / (every + 8), tree)


def _word_scores(counts: DataFrame, model) -> DataFrame:
    """The counted words with their log10 probability: every distinct word is spelled once, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, n in _runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(model.value.log10(words))], ["word", "n", "score"])

    return counts.select("word", "n").mapInArrow(run, "word binary, n bigint, score double")


def _scored(rows: DataFrame, hot, coded: int) -> DataFrame:
    """Per row: n_tokens, n_bytes, the sums over its hot words, its tokens as numbers (hot words by their place, others by
    their hash), and its other words listed.  The first ``coded`` hot words have no score here, as they are not spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, scores = hot.value
        logs = np.log10(counts + 1.0)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(i, TEXTS_AT_ONCE)
                texts = token_lists(part.column("text"))
                sizes = pc.list_value_length(texts).to_numpy().astype(np.int64)
                tokens = texts.flatten().dictionary_encode()  # each distinct word is looked up once
                distinct = tokens.dictionary.cast(pa.binary())
                code, words = tokens.indices.to_numpy(), plain(distinct)
                place = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                number = np.array([p if p >= 0 else len(index) + (crc32(w) & 0x3FFFFFFF) for p, w in zip(place.tolist(), words)], "<i4").take(code)
                at = place.take(code)
                new = np.flatnonzero(at < 0)
                pair, times = np.unique(np.repeat(np.arange(len(texts)), sizes)[new] * len(words) + code[new], return_counts=True)
                rare = np.r_[0, np.cumsum(np.bincount(pair // max(1, len(words)), minlength=len(texts)))].astype(np.int32)
                length = pc.binary_length(distinct).to_numpy().astype(np.int64).take(code) + 1
                out = []
                for low, high in zip((np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist()):
                    own = at[low:high]
                    known = own[own >= 0]
                    spelled = known[known >= coded]
                    out.append((high - low, int(length[low:high].sum()), float(scores[spelled].sum()), float(logs[known].sum()), len(known),
                                len(spelled) + high - low - len(known), number[low:high].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
                lists = [pa.ListArray.from_arrays(pa.array(rare), x) for x in (
                    distinct.take(pa.array(pair % max(1, len(words)))), pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("rid", "doc_id", "held_out")] + columns + lists,
                                                 ["rid", "doc_id", "held_out", "n_tokens", "n_bytes", "hot_score", "hot_sum", "hot_known", "n_spelled", "ids", "rare", "times"])

    return rows.mapInArrow(run, "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_bytes bigint, hot_score double, hot_sum double, "
                                "hot_known bigint, n_spelled bigint, ids binary, rare array<binary>, times array<int>")


def _rare_sums(rare: DataFrame, model) -> DataFrame:
    """Sums per rid over its words that are not hot.  ``rare``: rid, word, times, and n and score, both null for words that
    were never counted; these are spelled here, where the join has brought equal words together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, back = np.unique(batch.column("rid").to_numpy(), return_inverse=True)
            times = batch.column("times").to_numpy().astype(np.float64)
            n = batch.column("n").fill_null(0).to_numpy()
            score = batch.column("score").fill_null(0.0).to_numpy(zero_copy_only=False).copy()
            new = np.flatnonzero(n == 0)
            if len(new):
                words = batch.column("word").take(pa.array(new)).dictionary_encode()
                score[new] = model.value.log10(plain(words.dictionary))[words.indices.to_numpy()]
            sums = [np.bincount(back, times * x, len(rid)) for x in (np.log10(n + 1.0), n > 0, score)]
            yield pa.RecordBatch.from_arrays([pa.array(rid), *map(pa.array, sums)], ["rid", "rare_sum", "rare_known", "rare_score"])

    kind = "rid bigint, rare_sum double, rare_known double, rare_score double"
    return rare.mapInArrow(run, kind).groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("rare_sum", "rare_known", "rare_score")])


def _hot_words(words: DataFrame, most: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """The most frequent words, at most ``most``, most frequent first, with counts and scores: all words from a count on, found by a histogram of
    counts in eighths of powers of two, so that no task sends more than its share of them to the driver."""
    words = words.withColumn("bin", F.floor(F.log2("n") * 8))
    least, total = None, 0
    for b, n in words.groupBy("bin").agg(F.count("*").alias("words")).orderBy(F.col("bin").desc()).collect():
        total += n
        if total > most:
            break
        least = b
    if least is None:
        return {}, np.zeros(0, np.int64), np.zeros(0)
    found = words.where(F.col("bin") >= least).select("word", "n", "score").toArrow()
    found = found.sort_by([("n", "descending"), ("word", "ascending")])
    names = plain(found.column("word").combine_chunks())
    return dict(zip(names, range(len(names)))), found.column("n").to_numpy(), found.column("score").to_numpy()


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, hot_words: int = HOT_WORDS) -> DataFrame:
    """Log10 probability of every whole text under a model of all training texts, and a word-count base line.

    A text is a sequence of tokens: its words (runs without white space, A-Z lower-cased), then one end.  A token of the text
    is coded along a binary code of the most frequent words and one leaf for all others.  Each of these bits is predicted from
    hashed contexts of no, one and two earlier tokens, each with counts of zeros and ones over all training texts; their log
    odds are mixed by weights chosen by how often the contexts came, learnt online over the running texts of each partition,
    and the mix is refined by a table of how such mixes came true.  A word without a code is then spelled byte by byte, in the
    same way, from the last 0 to 4 bytes and the token so far; what the speller gives to words with a code is taken out.

    Ids whose crc32 (as text) modulo ``modulus`` is ``held`` are not learnt from, nor are null ids.  Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.  Every distinct training word is spelled
    once; counts and scores of the ``hot_words`` most frequent words travel to the tasks, all other words are joined with
    them, and words never counted are spelled after that join.  Null and empty texts are one end.
    Without training texts every count is 0 and the model is uniform over its code.  Repeated rows are scored each; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    key = id_class(F.col(f"`{id_col}`"), modulus)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(key == held, F.lit(False)).alias("held_out"),
        F.col(f"`{text_col}`").alias("text"))
    counts = written(word_counts(rows.where("doc_id IS NOT NULL AND NOT held_out")), "lm-counts")
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = spark.sparkContext.broadcast(train(counts))
    words = written(_word_scores(counts, model), "lm-words")
    index, times, scores = _hot_words(words, hot_words)
    code = TextCode.of(times[:CODED_WORDS], n)
    spelled = np.log10(max(1e-9, 1 - (10 ** scores[:CODED_WORDS]).sum()))
    hot = spark.sparkContext.broadcast((index, times, scores))
    table = written(_scored(rows, hot, code.words), "lm-scores")
    texts = _text_scores(table.drop("rare", "times"), train_texts(table.where("doc_id IS NOT NULL AND NOT held_out"), code))
    rare = table.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("rid", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    done = texts.join(_rare_sums(rare.join(words, "word", "left"), model), "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = F.col("hot_sum") + zero("rare_sum") - F.col("n_tokens") * F.log10(F.lit(float(n + distinct + 1)))
    done = done.withColumn("score", F.col("text_score") + F.col("hot_score") + zero("rare_score") - F.col("n_spelled") * F.lit(float(spelled)))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + zero("rare_known")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))


def op2_context_mixing(documents: DataFrame) -> DataFrame:
    return score_texts(documents.select("doc_id", "text"))
