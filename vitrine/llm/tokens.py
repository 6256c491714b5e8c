"""Token counts with a public tokenizer file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabulary file of the tokenizer at the driver; it is sent along with the job.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters handed to the tokenizer at once.
CHARS_AT_ONCE = 1 << 20


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_counts(docs: DataFrame, *, id: Column, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, size)``: tokens of each whole text; null and empty texts have none. One row per input row."""

    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        t = _load(SparkFiles.get(name))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes: list[int] = []
            held: list[str] = []
            chars = 0
            for x in texts:
                held.append(x)
                chars += len(x)
                if chars >= CHARS_AT_ONCE:
                    sizes += [len(e.ids) for e in t.encode_batch(held, add_special_tokens=False)]
                    held, chars = [], 0
            sizes += [len(e.ids) for e in t.encode_batch(held, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "size"])

    rows = docs.select(id.cast("bigint").alias("id"), text.alias("text"))
    return rows.mapInArrow(run, "id bigint, size bigint")
