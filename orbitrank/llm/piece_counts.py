"""Token counts of texts, without making the tokens of any text.

A piece model that never joins a space to what stands before it works inside
pre-tokens: a run of spaces and the letters after it. In each batch every distinct
pre-token is counted once; the batch's (row, pre-token) incidences are joined to these
counts by position and summed per row.

Defined results: null and empty texts have no tokens; special strings are ordinary
text; repeated rows are counted each. Columns other than the two that are read are left
out, whatever their names. A text of any length is cut into pre-tokens; only a
pre-token is handed to the tokenizer whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose texts have this many characters together are counted at once.
BATCH_CHARS = 1 << 22
#: Distinct pre-tokens whose counts a worker keeps from batch to batch; beyond, it begins anew.
KEPT_COUNTS = 500_000
TOKEN_LIMIT = 4096
_PRETOKEN = re.compile("▁+[^▁]*")
_MODELS: dict = {}


def _model(path: str):
    """The piece model of a worker, read once, and whether it works in pre-tokens."""
    if path not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(len(model))):
            raise ValueError("the model has pieces that reach over a space")
        _MODELS[path] = (model, {})
    return _MODELS[path]


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each beginning with the mark for a space."""
    return _PRETOKEN.findall("▁" + text.replace(" ", "▁")) if text else []


def _count_new(model, distinct: list[str]) -> list[int]:
    # The model puts one mark before what it is given, so the first mark is left out;
    # a single mark is a piece of its own.
    made = model.encode([x[1:] for x in distinct], num_threads=1)
    return [len(ids) if len(x) > 1 else 1 for x, ids in zip(distinct, made, strict=True)]


def _count_rows(texts: list[str], model, kept: dict[str, int]) -> list[int]:
    rows = [pretokens(text) for text in texts]
    new = list(set().union(*rows) - kept.keys())
    if len(kept) + len(new) > KEPT_COUNTS:
        kept.clear()
        new = list(set().union(*rows))
    kept.update(zip(new, _count_new(model, new), strict=True))
    return [sum(map(kept.__getitem__, row)) for row in rows]


def count_tokens(docs: DataFrame, model_path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = _model(model_path)
        for batch in stream:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            totals, held, chars = [], [], 0
            for text in texts:
                held.append(text)
                chars += len(text)
                if chars >= BATCH_CHARS:
                    totals += _count_rows(held, model, kept)
                    held, chars = [], 0
            totals += _count_rows(held, model, kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()),
                 pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", F.col("text")).mapInArrow(
        batches, f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
