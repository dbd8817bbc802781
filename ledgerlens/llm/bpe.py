"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

RANKS = "byte_bpe_50k.tiktoken"
CACHED_PIECES = 100_000
CHUNK_CHARS = 1 << 20
CLASSED = 1 << 14  # characters that odd_characters compares at once


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of several bytes: what is left of it when only lower ranks merge."""
    found = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            low = min(pairs)
            if low >= rank:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found


@lru_cache(4)
def tokenizer_json(path: str, pattern: str = public_tokenizers.PATTERN) -> str:
    """A tokenizers.Tokenizer for a rank file, as JSON text; about 3 MB for 50,000 ranks."""
    from tokenizers import Regex, models, pre_tokenizers

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    alphabet = byte_alphabet()
    name = lambda b: "".join(alphabet[x] for x in b)
    model = models.BPE(
        vocab={name(t): r for t, r in ranks.items()}, merges=[(name(a), name(b)) for a, b in merges_of(ranks)], ignore_merges=True, cache_capacity=1000)
    tok = Tokenizer(model)
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok.to_str()


@lru_cache(1)
def odd_characters() -> str:
    """A character class of what the regex module and the tokenizers library class differently ("" if nothing).

    Characters are classed ``CLASSED`` at a time: the library holds some 100 bytes per character of what it cuts, which for
    all of Unicode at once is 340 MB of the driver."""
    from tokenizers import Regex, pre_tokenizers

    codes = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.int32)
    odd = np.zeros(len(codes), bool)
    kinds = [(regex.compile(k), pre_tokenizers.Split(Regex(k), "removed")) for k in (r"\p{L}+", r"\p{N}+", r"\s+")]
    for low in range(0, len(codes), CLASSED):
        some = "".join(map(chr, codes[low : low + CLASSED].tolist()))
        for pattern, split in kinds:
            ours, theirs = np.zeros(len(some), bool), np.ones(len(some), bool)
            for m in pattern.finditer(some):
                ours[m.start() : m.end()] = True
            for _, (start, end) in split.pre_tokenize_str(some):
                theirs[start:end] = False
            odd[low : low + len(some)] |= ours ^ theirs
    edges = np.flatnonzero(np.diff(np.concatenate([[False], odd, [False]]).astype(np.int8)))
    firsts, lasts = codes[edges[::2]], codes[edges[1::2] - 1]
    return "[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(firsts, lasts)) + "]" if len(firsts) else ""


def latin_pattern(pattern: str) -> str:
    """``pattern`` for texts of Latin-1 characters, its classes spelled out, for the faster standard module."""

    def members(kind: str) -> str:
        return "".join(rf"\x{c:02x}" for c in range(256) if regex.match(kind, chr(c)))

    def spelled(m: re.Match) -> str:
        return re.sub(r"\\p\{\w+\}|\\s", lambda k: members(k[0]), m[0]) if m[0][0] == "[" else f"[{members(m[0])}]"

    return re.sub(r"\[[^\]]*\]|\\p\{\w+\}|\\[sS]", spelled, pattern)


class Codec:
    """Encoder and decoder of one vocabulary.

    Text is cut by ``pattern``; each distinct piece goes through the tokenizers library once and its ids are kept (up to
    ``CACHED_PIECES`` pieces, then the store starts anew).  The cut is made by the regex module; texts with a character
    that the two libraries class differently (letters of another Unicode version) go through the library whole.  Long
    texts are cut before white space that follows other characters, where a match always starts.
    """

    def __init__(self, json: str, pattern: str, odd: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import pre_tokenizers

        self.json, self.whole = json, None
        self.part = Tokenizer.from_str(json)
        self.part.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.latin = re.compile(latin_pattern(pattern))
        self.cut = regex.compile(r"(?<=\S)\s")
        values = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = self.part.get_vocab()
        self.table = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.table[i] = bytes(values[c] for c in token)
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self.names = [str(i) for i in range(len(self.table))]
        self.odd = regex.compile(odd) if odd else None
        self.known: dict[str, bytes] = {}

    def _chunks(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > CHUNK_CHARS:
            at = self.cut.search(text, start + CHUNK_CHARS)
            if not at:
                break
            yield text[start : at.start()]
            start = at.start()
        yield text[start:]

    def _found(self, chunk: str) -> list[str] | None:
        """The pieces of the chunk; None if the library has to cut it."""
        try:
            chunk.encode("latin-1")
            return self.latin.findall(chunk)
        except UnicodeEncodeError:
            return None if self.odd and self.odd.search(chunk) else self.pattern.findall(chunk)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (int32) of the whole text, without special tokens; null is empty."""
        out = []
        for chunk in self._chunks(text or ""):
            found = self._found(chunk)
            if found is None:
                self.whole = self.whole or Tokenizer.from_str(self.json)  # seldom needed
                out.append(np.array(self.whole.encode(chunk, add_special_tokens=False).ids, np.int32).tobytes())
                continue
            if len(self.known) > CACHED_PIECES:
                self.known.clear()
            new = [p for p in {*found} if p not in self.known]
            for i in range(0, len(new), 4096):
                some = new[i : i + 4096]
                for piece, e in zip(some, self.part.encode_batch_fast(some, add_special_tokens=False)):
                    self.known[piece] = array("i", e.ids).tobytes()
            out += map(self.known.__getitem__, found)
        return np.frombuffer(b"".join(out), np.int32)

    def offsets(self, ids: np.ndarray, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """First character and end character of every token; a character split over tokens belongs to each of them."""
        data = np.frombuffer((text or "").encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # byte -> character
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return char[starts], char[ends - 1] + 1

    def split_characters(self, ids: list[int], data: bytes) -> int:
        """Token boundaries that fall inside a character."""
        if data.isascii():
            return 0
        ends = np.cumsum(self.lengths[np.array(ids, np.int32)])[:-1]
        return int(((np.frombuffer(data, np.uint8)[ends] & 0xC0) == 0x80).sum())

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode_stream(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of successive runs of ids; bytes of a character split over runs wait for the rest, broken ones become U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield reader.decode(self.decode(ids))
        yield reader.decode(b"", True)


@lru_cache(2)
def codec(json: str, pattern: str, odd: str) -> Codec:
    """One codec per Python worker."""
    return Codec(json, pattern, odd)


def _udf(path: str, pattern: str, kind: str, make):
    json, odd = tokenizer_json(path, pattern), odd_characters()

    @F.arrow_udf(kind)
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(json, pattern, odd)
        for array in arrays:
            yield make(own, array)

    return run


def _lists(parts: list[np.ndarray]) -> pa.Array:
    cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))


def encode_column(
    df: DataFrame, text_col: str = "text", out: str = "tokens", path: str | None = None, pattern: str = public_tokenizers.PATTERN, offsets: bool = True,
) -> DataFrame:
    """Add ``out``: struct of ``ids`` and, with ``offsets``, of ``starts`` and ``ends`` (characters), arrays of int, of the whole text.

    ``path``: a rank file (base64 of the bytes, rank) on the driver; executors get the vocabulary with the code, not the
    file.  Null counts as empty and gives empty arrays.  Rows stay where they are: no shuffle.  A column named ``out`` is
    replaced, all others stay.  Empty tables give no rows.
    """
    names = ["ids", "starts", "ends"] if offsets else ["ids"]

    def make(own: Codec, array: pa.Array) -> pa.Array:
        columns: list[list[np.ndarray]] = [[] for _ in names]
        for value in array:
            text = value.as_py()
            ids = own.encode(text)
            for column, part in zip(columns, (ids, *own.offsets(ids, text)) if offsets else (ids,)):
                column.append(part)
        return pa.StructArray.from_arrays([_lists(c) for c in columns], names)

    udf = _udf(path or public_tokenizers.path(RANKS), pattern, f"struct<{','.join(n + ':array<int>' for n in names)}>", make)
    return df.withColumn(out, udf(F.col(f"`{text_col}`")))


def decode_column(df: DataFrame, ids_col: str, out: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add ``out``: the bytes of the ids (binary; null for null).  Bytes, since ids of a part of a text can start or end inside a character."""
    make = lambda own, array: pa.array([own.decode(v.values.to_numpy().tolist()) if v.is_valid else None for v in array], pa.binary())
    return df.withColumn(out, _udf(path or public_tokenizers.path(RANKS), pattern, "binary", make)(F.col(f"`{ids_col}`")))


def encoding_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode every whole text and return digests: doc_id, n_tokens, ids_sha256, decoded_sha256, n_split_chars."""

    def make(own: Codec, array: pa.Array) -> pa.Array:
        rows = []
        for value in array:
            ids = own.encode(value.as_py()).tolist()
            back = own.decode(ids)
            listed = " ".join(map(own.names.__getitem__, ids)).encode()
            rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(back).hexdigest(), own.split_characters(ids, back)))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_tokens", "ids_sha256", "decoded_sha256", "n_split_chars"])

    udf = _udf(path or public_tokenizers.path(RANKS), pattern, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,n_split_chars:bigint>", make)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), udf(F.col(f"`{text_col}`")).alias("_t")).select("doc_id", "_t.*")


def op1_byte_bpe(documents: DataFrame) -> DataFrame:
    return encoding_digests(documents)
