"""Operator 1: exact token counts of huge texts by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, small_batches

#: Characters of one chunk, and of the first overlap with the next; overlaps double when alignment fails.
CHUNK, OVERLAP = 32_768, 256


class Counter:
    """Counts the tokens of whole texts, in chunks, for a sentencepiece BPE model without normalisation.

    A boundary between two characters is proven stable when no piece of the vocabulary holds the two
    side by side: merges only ever build pieces, so none can cross it, whatever else the text holds.
    Neighbouring chunks overlap; both are encoded with offsets, and spliced at a boundary in the
    overlap that both encodings have and that is proven. If there is none, the overlap widens, at
    last to the whole of the rest.
    """

    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.processor.serialized_model_proto())
        rules = proto.normalizer_spec
        self.exact = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        self.joined = {p.piece[i : i + 2] for p in proto.pieces if p.type in (1, 4) for i in range(len(p.piece) - 1)}
        self.chunk, self.overlap = chunk, overlap

    def proven(self, text: str, i: int) -> bool:
        return (text[i - 1] + text[i]).replace(" ", "▁") not in self.joined

    def short(self, text: str) -> bool:
        return not self.exact or len(text) <= self.chunk + self.overlap

    def count(self, text: str) -> int:
        if self.short(text):
            return len(self.processor.encode(text))
        total, begin, wide = 0, 0, self.overlap
        done = 0  # everything before this offset is counted
        while True:
            end = min(len(text), begin + self.chunk + wide)
            here = self._encode(text, begin, end)
            if end == len(text):
                return total + sum(x >= done for x in here)
            following = end - wide
            there = set(self._encode(text, following, min(len(text), end + wide)))
            common = [x for x in sorted({*here} & there) if following < x < end and x > done and self.proven(text, x)]
            if common:
                # The splice nearest the middle of the overlap; the next chunk begins a token later than its own start.
                cut = min(common, key=lambda x: abs(2 * x - following - end))
                total += sum(done <= x < cut for x in here)
                done, begin, wide = cut, following, self.overlap
            else:
                wide *= 2

    def _encode(self, text: str, begin: int, end: int) -> list[int]:
        """Where each token of ``text[begin:end]`` begins, in characters of the whole text."""
        part = text[begin:end]
        at = np.fromiter((p.begin for p in self.processor.encode(part, return_type="proto").pieces), np.int64)
        raw = np.frombuffer(part.encode(), np.uint8)  # the library counts bytes
        return (begin + np.cumsum((raw & 0xC0) != 0x80)[at] - 1).tolist()


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Count the tokens of every whole text, as the library gives them for the text at once.

    Returns a row for each input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit. A null text is
    empty and has no tokens. Repeated rows give repeated results; other columns are ignored. Texts
    reach the workers in batches bounded by bytes, and memory beyond a text itself by the chunk.
    """
    small_batches(docs.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path, chunk, overlap)
        for batch in texts:
            whole = [counter.short(x) for x in batch]
            quick = iter(counter.processor.encode([x for x, w in zip(batch, whole) if w], num_threads=1))
            yield pd.Series([len(next(quick)) if w else counter.count(x) for x, w in zip(batch, whole)], dtype="int64")

    out = narrowed(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
