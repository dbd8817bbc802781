"""Packing of line-addressed text into passages.

Packing walks the lines of one document in order, so it is a small per-row helper
inside an Arrow batch; Spark spreads the documents.  Whole documents are packed:
the limits of an index build are optional parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import constants as K
from ledgerlens.functions.hashing import identity

CHUNK = "struct<line_start: bigint, line_end: bigint, text: string>"
CHUNK_FIELDS = ["line_start", "line_end", "text"]
ROWS_AT_ONCE = 64
LINE_END = re.compile(r"\r\n|\r|\n")


def _fill(pieces: Iterable[tuple[int, int, str]], size: int, glue: str):
    """Consecutive pieces joined by ``glue`` while the joined length stays within ``size``."""
    held: list[str] = []
    first = last = length = 0
    for start, end, text in pieces:
        if held and length + len(glue) + len(text) > size:
            yield first, last, glue.join(held)
            held = []
        if not held:
            first, length = start, len(text)
        else:
            length += len(glue) + len(text)
        held.append(text)
        last = end
    if held:
        yield first, last, glue.join(held)


def _cut(number: int, text: str, size: int):
    return ((number, number, text[i:i + size]) for i in range(0, max(len(text), 1), size))


def line_chunks(text: str, first_line: int, size: int, max_chunks: int | None) -> list[tuple[int, int, str]]:
    rows = enumerate(LINE_END.split(text), first_line)
    pieces = (p for n, t in rows for p in _cut(n, t.replace("\x00", ""), size))
    chunks = [c for c in _fill(pieces, size, "\n") if c[2].strip()]
    return chunks if max_chunks is None else chunks[:max_chunks]


def _prose(text: str, first_line: int, size: int):
    """Paragraph pieces: fences skipped, heading and bullet marks cut, blank lines end a paragraph."""
    fenced, block = False, []
    for number, raw in enumerate(LINE_END.split(text), first_line):
        line = raw.strip()
        if line.startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            continue
        line = re.sub(r"^(?:#{1,6}|[-*])\s+", "", line)
        if line and len(line) <= size:
            block.append((number, number, line))
            continue
        yield from _fill(block, size, " ")
        block = []
        if line:
            yield from _cut(number, line, size)
    yield from _fill(block, size, " ")


def paragraph_chunks(text: str, first_line: int, size: int, sample: int | None) -> list[tuple[int, int, str]]:
    chunks = list(_fill(_prose(text, first_line, size), size, " "))
    if sample is None or len(chunks) <= sample:
        return chunks
    picks = {round(i * (len(chunks) - 1) / max(1, sample - 1)) for i in range(sample)}
    return [c for i, c in enumerate(chunks) if i in picks]


def _packed(df: DataFrame, text: str, fn) -> DataFrame:
    """Rows of ``df`` (keys, line_start, text) once per chunk, with the chunk as ``c``; a few documents are held at a time."""
    keys = [c for c in df.columns if c not in ("line_start", text)]
    schema = T.StructType([*[df.schema[c] for c in keys], T.StructField("c", T.DataType.fromDDL(CHUNK))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = [(i, *c) for i, (body, start) in enumerate(zip(part.column(text), part.column("line_start"))) for c in fn(body.as_py(), start.as_py())]
                own, first, last, chunk = zip(*found) if found else ((), (), (), ())
                c = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(chunk, pa.string())], CHUNK_FIELDS)
                own = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(own) for k in keys], c], [*keys, "c"])

    return df.select(*keys, "line_start", text).mapInArrow(pack, schema)


def pack_lines(passages: DataFrame, text: str = "content", size: int = K.PASSAGE_CHARS, max_chunks: int | None = None) -> DataFrame:
    """Passages (event_id, source_path, heading, line_start, content) -> chunks of at most ``size`` characters,
    with their first and last line and a content-bound id.  Over-long lines are split, not cut off."""
    packed = _packed(passages.select("event_id", "source_path", "heading", "line_start", text), text,
                     lambda x, s: line_chunks(x, s, size, max_chunks))
    return with_passage_ids(packed)


def pack_paragraphs(passages: DataFrame, text: str = "content", size: int = K.PARAGRAPH_CHARS, sample: int | None = None) -> DataFrame:
    """Paragraph chunks; ``sample`` keeps evenly spaced chunks per document (a sampling option)."""
    packed = _packed(passages.select("event_id", "source_path", "heading", "line_start", text), text,
                     lambda x, s: paragraph_chunks(x, s, size, sample))
    return with_passage_ids(packed)


def with_passage_ids(chunks: DataFrame) -> DataFrame:
    c = chunks.select("event_id", "source_path", "heading", "c.line_start", "c.line_end", "c.text")
    body = F.concat(
        F.lit("Section heading: "), "heading", F.lit("\nSource path: "), "source_path", F.lit("\nEvidence lines "), F.col("line_start").cast("string"),
        F.lit("-"), F.col("line_end").cast("string"), F.lit(": "), F.trim("text"))
    c = c.withColumn("retrieval_text", body)
    return c.withColumn("passage_id", identity("psg_", 20, "event_id", "source_path", "line_start", "line_end", "retrieval_text", sep="\u0000")).withColumn(
        "text_sha256", F.sha2("retrieval_text", 256))


def changed_texts(wanted: DataFrame, stored: DataFrame, key: str, text_hash: str) -> DataFrame:
    """Rows to embed again: new ids, or ids whose text hash changed."""
    return wanted.join(stored.select(key, text_hash).distinct(), [key, text_hash], "left_anti")
