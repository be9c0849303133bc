"""Operator 6: token counts with the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held
from .piece_bpe import Memo, PieceModel


def whole_tokens(model_path: str) -> list[str]:
    """The vocabulary strings proved to encode alone as exactly one token, by merging each of them.

    Bounded by the vocabulary, whatever the corpus.
    """
    model = PieceModel(model_path)
    return [piece for piece in model.ids if model.merge(piece) == [piece]]


def _counter(path: str) -> tuple[PieceModel, Memo]:
    """One model and the counts of its segments, for all of a worker's tasks."""
    model = PieceModel(path)
    parts = Memo(lambda s: len(model.to_ids(model.merge(s))), 150_000)

    def counted(segment: str) -> int:
        parts.trim()
        return sum(map(parts.__getitem__, model.part.findall(segment)))

    return model, Memo(counted)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text, without begin or end ids.

    Returns ``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens``, one row per input
    row; null and empty texts have 0 and 0.  Pre-tokens (segments that no piece
    crosses) found in the proved list count one each by a look-up; only the rest
    is merged.  There is no shuffle; the broadcast list is bounded by the vocabulary.
    """
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = held(("counts", model_path), lambda: _counter(model_path))
        whole = dict.fromkeys(proved.value, 1)
        counts.update(whole)
        for batch in batches:
            totals = []
            for text in batch.column(1).to_pylist():
                totals.append(sum(map(counts.__getitem__, model.segments(text or ""))))
                counts.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), size.alias("n_bytes"))
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id_col)
