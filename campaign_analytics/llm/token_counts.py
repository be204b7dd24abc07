"""Operator 10: token counts of whole texts by batch encoding.

Arrow functions return lengths only.  Texts are cut into pieces at spaces that no token
crosses, pieces are dealt into encoder batches of about equal bytes, and the lengths are
summed per text, so neither a very long text nor a row with many tokens grows a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tokens
from .common import id_and_text

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 15
LIMIT = 2048


def _counter(content: str, limit: int, batch_bytes: int, piece_chars: int) -> Callable:
    def lengths(counter: tokens.TokenCounter, pieces: list[str], owners: list[int], totals: list[int]) -> None:
        for owner, n in zip(owners, counter.count(pieces)):
            totals[owner] += n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokens.counter(content)
        for batch in batches:
            texts = batch.column("text")
            totals, sizes = [0] * len(texts), [0] * len(texts)
            pieces: list[str] = []
            owners: list[int] = []
            held = 0
            for row in range(len(texts)):
                text = texts[row].as_py() or ""
                sizes[row] = len(text.encode())
                for piece in tokens.safe_pieces(text, piece_chars):
                    pieces.append(piece)
                    owners.append(row)
                    held += len(piece.encode())
                    if held >= batch_bytes:
                        lengths(counter, pieces, owners, totals)
                        pieces, owners, held = [], [], 0
            if pieces:
                lengths(counter, pieces, owners, totals)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array([n > limit for n in totals], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return count


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (``n_tokens > limit``).

    ``tokenizer_path`` names a ``.json`` file of the tokenizers library, read on the driver.
    Counts exclude added begin and end tokens; special strings in a text count as the library
    counts them.  Null and empty texts: 0 bytes, 0 tokens.  Null or repeated ids: a row each.
    Empty table: no rows.  Other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return rows.mapInArrow(_counter(tokens.tokenizer_json(tokenizer_path), limit, batch_bytes, piece_chars), schema)
