"""Token counts: batches of segments go to the tokenizer in Arrow functions, and only lengths come back.

Texts are cut at the safe boundaries of `bpe.segments`, or not at all for other vocabularies' kinds, so a long text is
many short ones and its count is their sum. A worker keeps the lengths of segments it has met, in a table of bounded
size; the new ones of a slice of texts are encoded in batches of about equal bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from studyloom.llm.bpe import segments, special_pattern
from studyloom.llm.common import slices

KEPT_SEGMENTS = 500_000
KEPT_LENGTH = 64
BATCH_BYTES = 1 << 20


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """`texts` in batches of about `limit` bytes each."""
    batch, held = [], 0
    for t in texts:
        batch.append(t)
        held += len(t) + 16
        if held >= limit:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class Counter:
    """Lengths by the library that a vocabulary file belongs to: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str) -> None:
        self.kept: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths: Callable[[list[str]], list[int]] = lambda ts: [len(x) for x in model.encode(ts, num_threads=1)]
            self.cut: Callable[[str], list[str]] = lambda t: [t]  # white space is normalised across any boundary
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            byte_level = '"ByteLevel"' in (library.pre_tokenizer.__getstate__().decode() if library.pre_tokenizer else "")
            encode = getattr(library, "encode_batch_fast", library.encode_batch)
            self.lengths = lambda ts: [len(x) for x in encode(ts, add_special_tokens=False)]
            special = special_pattern([t.content for t in library.get_added_tokens_decoder().values()])
            self.cut = (lambda t: segments(t, special)) if byte_level else (lambda t: [t])

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        kept, cut = self.kept, self.cut
        if len(kept) > KEPT_SEGMENTS:
            kept.clear()
        pieces = [cut(t) for t in texts]
        new = list({s for p in pieces for s in p if s not in kept})
        # neighbours of like length make even batches
        new.sort(key=len)
        fresh: dict[str, int] = {}
        for batch in by_bytes(new):
            fresh.update(zip(batch, self.lengths(batch), strict=True))
        short = {s: n for s, n in fresh.items() if len(s) <= KEPT_LENGTH}
        kept.update(short)
        if len(short) == len(fresh):
            return [sum(map(kept.__getitem__, p)) for p in pieces]
        return [sum(kept[s] if s in kept else fresh[s] for s in p) for p in pieces]


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(path)


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    counter = load(path)
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text")
            n = pa.array(counter.counts([t or "" for t in texts.to_pylist()]), pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "n_bytes": size, "n_tokens": n, "over_limit": pc.greater(n, limit)})


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes, tokens without added ones, whether over `limit`.

    A null text counts as empty: 0 and 0. Special strings inside texts count as the library's default has it. Repeated
    rows count each for itself; other columns are not looked at. Nothing is shuffled, texts are counted whole.
    """
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    return d.mapInArrow(lambda b: _count(b, vocabulary, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", key)
