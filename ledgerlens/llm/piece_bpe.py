"""Exact SentencePiece (merge type) encoding by backtracking, and decoding."""

from __future__ import annotations

import codecs
import hashlib
import pickle
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN = " ⁇ "
CACHED_WORDS, CACHED_PAIRS = 200_000, 400_000
CACHED_CHARS = 64  # longer words are encoded anew each time
FAILED = "ledgerlens-byte-pieces"

codecs.register_error(FAILED, lambda e: ("�", e.start + 1))  # one mark per broken byte


@lru_cache(4)
def vocabulary(path: str) -> bytes:
    """Pieces, scores and kinds of a model file, pickled for the tasks (under 1 MB for 32,000 pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(sp.get_piece_size())
    kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "" for i in every]
    if sp.encode(" a  ", out_type=str) != [*sp.encode(" a", out_type=str), *sp.encode(" ", out_type=str)] or len([k for k in kinds if k == "byte"]) != 256 or "unused" in kinds:
        raise ValueError("only models that keep white space, fall back to bytes and use all pieces are supported")
    return pickle.dumps(([sp.id_to_piece(i) for i in every], [sp.get_score(i) for i in every], kinds))


def merged(text: str, score: dict[str, float]) -> list[str]:
    """What merging gives: of all neighbours whose join is a piece the best score first, then the leftmost."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def cut_pattern(pieces: Iterable[str]) -> str:
    """A pattern that cuts a text where no merge can cross the border.

    Characters that stand next to each other in some piece belong to one class; neighbours of different classes never
    merge, nor does a character that only stands alone in the vocabulary.  Spaces stay with what follows them, unless a
    piece holds a space after another character: then they are characters like any other.
    """
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
    inner = any(a != SPACE and b == SPACE for a, b in pairs)
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for a, b in sorted(pairs):
        if inner or a != SPACE:
            root[find(a)] = find(b)
        elif b != SPACE:
            find(b)
    classes: dict[str, list[str]] = {}
    for c in sorted(root):
        classes.setdefault(find(c), []).append(re.escape(c))
    lead = "" if inner else f"{SPACE}*"
    every = "".join(sum(classes.values(), []))
    return "|".join([f"{lead}[{''.join(c)}]+" for c in sorted(classes.values(), key=len, reverse=True)] + ([] if inner else [f"{SPACE}+"]) + [f"[^{every}{'' if inner else SPACE}]" if every else "(?s:.)"])


class PieceCodec:
    """Encoder and decoder of one model.

    A sequence of pieces is what merging gives if and only if every two neighbours, merged anew, give themselves: a merge
    over the border between two pieces that comes first in the text comes first in the two pieces as well.  So encoding
    searches for a sequence of such pieces: at each place it takes the longest piece that starts there (Aho-Corasick),
    then its shorter prefixes, checks it against the piece before, and goes back where none fits; places from which the
    rest cannot be encoded are marked in a bitfield and not entered again.  Characters outside the vocabulary are pieces
    of their own, written as bytes.

    Texts are first cut at borders that no merge can cross (``cut_pattern``); each distinct word is encoded once and kept
    in two generations, so that frequent ones stay when the store is full.
    """

    def __init__(self, packed: bytes) -> None:
        pieces, scores, kinds = pickle.loads(packed)
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if not k}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.byte_ids = [0] * 256
        self.table, self.control, self.lead = [], set(), set()
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
            elif k == "control":
                self.control.add(i)
            elif not k and p.startswith(SPACE):
                self.lead.add(i)
            self.table.append(bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else UNKNOWN.encode() if k else p.replace(SPACE, " ").encode())
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.prefix = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), p[:1] if len(p) > 1 else None) for p in self.ids}
        self.cut = re.compile(cut_pattern(self.ids))
        self.names = [str(i) for i in range(len(pieces))]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _fits(self, last: str, piece: str) -> bool:
        """Whether the two pieces (or the piece alone, after "") come out of merging them anew."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        found = self.pairs[last, piece] = merged(last + piece, self.score) == ([last, piece] if last else [piece])
        return found

    def pieces(self, word: str) -> list[str]:
        """Pieces of a word without any cut, by backtracking."""
        n = len(word)
        longest = list(word)
        for end, piece in self.automaton.iter(word):
            longest[end + 1 - len(piece)] = piece  # ends rise, so the longest comes last
        failed = bytearray((n >> 3) + 1)
        found: list[str] = []
        at, last, piece, pairs, prefix = 0, "", longest[0] if n else "", self.pairs, self.prefix
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = pairs.get((last, piece))
                if fits or fits is None and self._fits(last, piece):
                    found.append(piece)
                    if end == n:
                        break
                    at, last, piece = end, piece, longest[end]
                    continue
            shorter = prefix.get(piece)
            if shorter is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = found.pop()
                at -= len(piece)
                last = found[-1] if found else ""
            else:
                piece = shorter
        return found

    def _encoded(self, word: str) -> bytes:
        known, ids = self.ids, []
        for piece in self.pieces(word):
            i = known.get(piece)
            if i is not None:
                ids.append(i)
            else:
                ids += [self.byte_ids[b] for b in piece.encode()]
        return array("i", ids).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (int32) of the whole text, without begin and end; null is empty."""
        if not text:
            return np.zeros(0, np.int32)
        words = self.cut.findall(SPACE + text.replace(" ", SPACE))
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for word in {*words}.difference(known):
            if len(word) <= CACHED_CHARS:
                known[word] = older.get(word) or self._encoded(word)
        return np.frombuffer(b"".join([known.get(w) or self._encoded(w) for w in words]), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces again, one space of the first piece that is no control piece left out, bytes joined to
        characters, one U+FFFD for each byte that belongs to none, nothing for control pieces, a mark for the unknown piece."""
        first = next((i for i in ids if i not in self.control), None)
        if self.control.isdisjoint(ids):
            data = b"".join(map(self.table.__getitem__, ids))
            return (data[1:] if first in self.lead else data).decode("utf-8", FAILED)
        runs, part = [], []
        for i in [*ids, next(iter(self.control))]:  # a control piece also ends a run of bytes
            if i in self.control:
                runs.append(b"".join(part).decode("utf-8", FAILED))
                part = []
            else:
                part.append(self.table[i])
        return "".join(runs)[1:] if first in self.lead else "".join(runs)


@lru_cache(2)
def codec(packed: bytes) -> PieceCodec:
    """One codec per Python worker."""
    return PieceCodec(packed)


def _udf(path: str | None, kind: str, make):
    packed = vocabulary(path or public_tokenizers.path(MODEL))

    @F.arrow_udf(kind)
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(packed)
        for values in arrays:
            yield make(own, values)

    return run


def encode_column(df: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``out``: the ids (array of int) of the whole text, exactly as the model's own library gives them, without begin or end.

    ``path``: a model file on the driver; tasks get the vocabulary with the code, not the file.  Null and empty texts give
    an empty array.  Rows stay where they are: no shuffle; a very long text needs memory in proportion to itself.  A column
    named ``out`` is replaced, all others stay.  Empty tables give no rows.
    """

    def make(own: PieceCodec, values: pa.Array) -> pa.Array:
        parts = [own.encode(v.as_py()) for v in values]
        cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))

    return df.withColumn(out, _udf(path, "array<int>", make)(F.col(f"`{text_col}`")))


def decode_column(df: DataFrame, ids_col: str, out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``out``: the text of the ids, as the model's own library decodes them; null for null, empty for none."""
    make = lambda own, values: pa.array([own.decode(v.as_py()) if v.is_valid else None for v in values], pa.string())
    return df.withColumn(out, _udf(path, "string", make)(F.col(f"`{ids_col}`")))


def encoding_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode every whole text and return digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty (no ids); repeated rows and null ids give a row each; other columns are ignored.
    """

    def digest(own: PieceCodec, text: str | None) -> tuple[int, str, str]:
        ids = own.encode(text).tolist()
        listed = ",".join(map(own.names.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

    def make(own: PieceCodec, values: Iterable) -> pa.Array:
        columns = list(zip(*[digest(own, v.as_py()) for v in values])) or [[]] * 3
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["n_tokens", "ids_sha256", "decoded_sha256"])

    udf = _udf(path, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>", make)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), udf(F.col(f"`{text_col}`")).alias("_t")).select("doc_id", "_t.*")


def op11_piece_bpe(documents: DataFrame) -> DataFrame:
    """Digests of ids and decoded text of every document (see ``encoding_digests``)."""
    return encoding_digests(documents)
