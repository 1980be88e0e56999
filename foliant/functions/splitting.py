"""Long texts split into chunks: whole paragraphs while they fit, windows inside of paragraphs that are too long."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = "chunk_index int, chunk_count int, char_start int, char_end int, content string"


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of windows that overlap; one ends behind a line break, or else a full stop, in its last two fifths."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            stop = text.rfind("\n", at, end)
            stop = stop if stop >= 0 else max(text.rfind(s, at, end) for s in ".。")
            # A window always ends behind its overlap, so that the next one starts further on.
            if stop > at + int(size * 0.6) and stop + 1 - overlap > at:
                end = stop + 1
        yield at, end
        if end == len(text):
            return
        at = end - overlap


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, content) of a text's chunks; positions count in the stripped text.

    Paragraphs part at empty lines. A joined chunk's end is its start and length, as paragraphs join by one empty line."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap between 0 and size")
    text = text.strip()
    out: list[tuple[int, int, str]] = []
    start, held, at = 0, "", 0
    for part in text.split("\n\n"):
        own = part.strip()
        begin = at + part.find(own)
        at += len(part) + 2
        if not own:
            continue
        if held and len(held) + 2 + len(own) <= size:
            held += "\n\n" + own
            continue
        if held:
            out.append((start, start + len(held), held))
        start, held = begin, own
        if len(own) > size:
            out += [(begin + a, begin + b, own[a:b].strip()) for a, b in windows(own, size, overlap) if own[a:b].strip()]
            held = ""
    return [*out, (start, start + len(held), held)] if held else out


def split(df: DataFrame, text: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """All columns of df and FIELDS, one row for each chunk; a text without content gives none.

    Greedy joining depends on what came before, so it runs in Python, over Arrow batches, without a shuffle."""
    pieces("", size, overlap)
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, t in enumerate(batch.column(1)):
                found = pieces(t.as_py(), size, overlap)
                if found:
                    columns = [pa.array(range(len(found)), pa.int32()), pa.array([len(found)] * len(found), pa.int32()), *[pa.array(x, pa.int32()) for x in list(zip(*found))[:2]], pa.array([x[2] for x in found])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([n] * len(found))), *columns], schema.names)

    schema = T.StructType([kept.schema["row"], *T._parse_datatype_string(FIELDS).fields])
    return kept.mapInArrow(part, schema).select("row.*", *T._parse_datatype_string(FIELDS).names)
