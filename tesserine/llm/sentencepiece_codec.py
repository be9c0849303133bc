"""Operator 3: exact sentencepiece encoding (merge type) by backtracking, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held
from .piece_bpe import Memo, PieceModel


def _codec(path: str):
    """One model and its memos, for all of a worker's tasks: a segment's ids joined by one space, and the text decoded from them."""
    model = PieceModel(path)
    of_part = Memo(lambda s: model.spell(model.tokens(s)), 150_000)

    def coded(segment: str) -> tuple[str, str]:
        parts = [segment] if segment[1:].isalpha() else model.part.findall(segment)  # only punctuation marks cut, and none does at the start
        if len(parts) == 1:
            return model.spell(model.tokens(segment))
        of_part.trim()
        found = [of_part[p] for p in parts]
        return " ".join([x[0] for x in found]), "".join([x[1] for x in found])

    return model, Memo(coded, 200_000)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, with an end id, and decode the ids again.

    Returns ``id_col``, ``ids`` (decimal ids joined by one space, the end id last),
    ``decoded`` and ``n_tokens``, the number of ids.  One row per input row, in no
    order; a null text is the empty text, whose only id is the end id.  Other columns
    of ``docs`` are ignored.
    Work is per row, so no row meets another: there is no shuffle.  Texts are cut
    where no vocabulary piece can reach across, so repeated words cost a look-up;
    a text without such places is one long segment, encoded in linear space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of_segment = held(("codec", model_path), lambda: _codec(model_path))
        end = str(model.end)
        for batch in batches:
            ids, decoded, counts = [], [], []
            for text in batch.column(1).to_pylist():
                parts = list(map(of_segment.__getitem__, model.segments(text or "")))
                ids.append(joined := " ".join([*[x[0] for x in parts], end]))
                counts.append(joined.count(" ") + 1)
                decoded.append("".join([x[1] for x in parts])[1:])  # the first segment starts with the space put before the text
                of_segment.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(counts, pa.int64())], ["_id", "ids", "decoded", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, ids string, decoded string, n_tokens long").withColumnRenamed("_id", id_col)


def digest(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns: number of ids and digests of ids and decoded text."""
    return coded.select(
        id_col,
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
