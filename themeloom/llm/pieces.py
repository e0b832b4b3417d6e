"""SentencePiece encoding and decoding through a table of distinct chunks.

With SentencePiece's whitespace splitting, no piece crosses the start of a run of
whitespace markers (U+2581): the normalised text falls into chunks, each a run of
markers and the characters up to the next marker, and every chunk is segmented on its
own. So each distinct chunk is segmented once, and the ids of a text are its chunks'
ids joined back by position. The table is built per Arrow batch of a task: a global
table would shuffle every word twice (about three times the input) to save encodings
that cost a microsecond each, while within a batch frequent words already repeat
thousands of times.

The split below holds for models whose normaliser keeps the text (``identity``), adds
a dummy prefix, and treats runs of whitespace as one chunk, as ``piece_bpe_32k`` does;
``chunked_ids`` is checked against the library's own ``encode`` in the tests.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# SentencePiece's whitespace marker and the chunks it starts.
MARKER = "▁"
CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")
SLICE_CHARS = 4_000_000

RESULT = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
BATCH_BYTES = 64 * 1024 * 1024


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunks(text: str) -> list[str]:
    """The chunks SentencePiece segments apart: the text with a dummy prefix, spaces as
    markers, cut before every run of markers. The empty text has none."""
    if not text:
        return []
    return CHUNK.findall(MARKER + text.replace(" ", MARKER))


def chunked_ids(processor, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of every text (int32 arrays), without begin and end: each distinct chunk
    segmented once."""
    pieces = [chunks(t or "") for t in texts]
    flat = [c for p in pieces for c in p]
    if not flat:
        return [np.zeros(0, dtype=np.int32) for _ in texts]
    codes, distinct = pd.factorize(pd.Series(flat, dtype=object))
    del flat
    # a chunk is given to the library without its marker: the dummy prefix restores it
    encoded = processor.encode([c[1:] for c in distinct], num_threads=1)
    lone = processor.piece_to_id(MARKER)
    table = [e if c[1:] else [lone] for c, e in zip(distinct, encoded)]
    lengths = np.fromiter((len(e) for e in table), dtype=np.int64, count=len(table))
    values = np.fromiter((i for e in table for i in e), dtype=np.int32, count=int(lengths.sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out, at = [], 0
    for p in pieces:
        these = codes[at : at + len(p)]
        at += len(p)
        if len(these) == 0:
            out.append(np.zeros(0, dtype=np.int32))
            continue
        # positions of every chunk's ids, in the order of the text
        size = lengths[these]
        offsets = np.repeat(starts[these] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out.append(values[offsets])
    return out


def slices(texts: list[str | None], budget: int) -> list[tuple[int, int]]:
    """Consecutive slices of ``texts`` of about ``budget`` characters, one text at least."""
    out, start, total = [], 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= budget:
            out.append((start, i + 1))
            start, total = i + 1, 0
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def encode_texts(
    df: DataFrame,
    text: str = "text",
    model: str | None = None,
    ids: str = "ids",
    decoded: str = "decoded",
    begin_end: bool = True,
) -> DataFrame:
    """``df`` with ``ids`` (binary: begin id, the text's ids, end id, packed as
    little-endian unsigned 32-bit integers, as token files store them) and ``decoded``
    (the library's ``decode`` of those ids) for every row.

    A NULL text is encoded as the empty one (begin and end ids only, decoded ''); very
    long texts are encoded whole; equal texts get equal ids. Columns named ``ids`` or
    ``decoded`` already in ``df`` are replaced; all others are kept. Each Arrow batch
    is cut into slices of about SLICE_CHARS characters, each with its own chunk table;
    unless the session sets ``spark.sql.execution.arrow.maxBytesPerBatch``, batches are
    bounded to BATCH_BYTES, so a task's memory does not grow with long texts. The model
    file is read once on the driver and sent with the function (a few hundred KB), so
    executors need no shared copy of it.
    """
    import sentencepiece

    proto = Path(model or default_model()).read_bytes()
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**31 - 1), "2147483647b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    bos_eos = begin_end

    @F.pandas_udf(RESULT)
    def encode(values: pd.Series) -> pd.DataFrame:
        processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ends = [np.array([processor.bos_id()], np.int32), np.array([processor.eos_id()], np.int32)]
        texts = list(values.where(values.notna(), None))
        full, decoded = [], []
        # one table of distinct chunks per slice of a batch, so that memory stays bounded
        for start, stop in slices(texts, SLICE_CHARS):
            for body in chunked_ids(processor, texts[start:stop]):
                ids = np.concatenate([ends[0], body, ends[1]]) if bos_eos else body
                full.append(ids.astype("<u4").tobytes())
                decoded.append(processor.decode(ids.tolist()))
        return pd.DataFrame({"ids": full, "decoded": decoded})

    out = df.withColumn("_encoded", encode(F.col(f"`{text}`")))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (ids, decoded)]
    return out.select(*kept, F.col("_encoded.ids").alias(ids), F.col("_encoded.decoded").alias(decoded))


def piece_report(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (see ``encode_texts``)."""
    encoded = encode_texts(docs.select("doc_id", "text"), model=model, ids="_ids", decoded="_decoded")
    return encoded.select(
        "doc_id",
        (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("_decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
