"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

The vocabulary file is a parameter and is read by each Python worker once. A text is cut at safe boundaries, where
the pre-tokeniser always begins a new piece: around the last white space before a word. The segments between such cuts repeat
across texts, so a worker keeps the ids of those it has met, in a table of bounded size, and runs the merge queue on the
others only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from studyloom.llm.common import slices

UNSAFE = re.compile(r"[ \n](?:\s|\Z)")
CUT = re.compile(r"(?=[ \n]\S)|(?<=\n)(?=\S)")
#: one piece of Latin letters and a mark, whose bounds need no pre-tokeniser
SIMPLE = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: segments that a worker keeps
KEPT_SEGMENTS = 700_000
KEPT_LENGTH = 64


@lru_cache(maxsize=1)
def byte_chars() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, and the byte it stands for.

    Fixed by the vocabulary format: printable Latin-1 bytes stand for themselves, the others for U+0100 and on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def segments(text: str, special: re.Pattern | None = None) -> list[str]:
    """`text` cut where the pre-tokeniser always begins a new piece: before a space or line end that a non-space follows,
    and after such a line end; and around `special` strings (a pattern with one group), at which texts begin and end anew.
    The segments put together are the text."""
    if special and special.search(text):
        return [s for k, part in enumerate(special.split(text)) for s in ([part] if k % 2 else segments(part))]
    if UNSAFE.search(text):
        return [s for s in CUT.split(text) if s]
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        first, *rest = line.split(" ")
        if first:
            out.append(first)
        out += [" " + s for s in rest]
    return out


def special_pattern(contents: list[str]) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, sorted(contents, key=len, reverse=True))) + ")") if contents else None


class Bpe:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        vocab, chars = spec["model"]["vocab"], byte_chars()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut_special = special_pattern(list(special))
        # the library's own reading of letters and digits decides where pieces end
        self.pre_tokenize = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.width = 1 + max([*vocab.values(), *special.values()])
        #: what decoding concatenates
        self.strings = [b""] * self.width
        for s, i in vocab.items():
            self.strings[i] = bytes(chars[c] for c in s)
        for s, i in special.items():
            self.strings[i] = s.encode()
        self.letter = {c: vocab[c] for c in chars}
        self.of_byte = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        #: left * width + right -> (rank, merged id)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] * self.width + vocab[b]] = (rank, vocab[a + b])
        self.kept: dict[str, bytes] = {}

    def piece(self, symbols: list[int]) -> list[int]:
        """The ids of one pre-token, given as ids of its bytes.

        The heap holds (rank, place) of pairs of neighbours, as one number. A popped entry counts only if the two symbols
        that stand there now still have that rank; all others are stale and skipped.
        """
        merges, width, n = self.merges, self.width, len(symbols)
        found = [merges.get(a * width + b) for a, b in zip(symbols, symbols[1:])]
        heap = [m[0] * n + i for i, m in enumerate(found) if m]
        if not heap:
            return symbols
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            left, j = symbols[i], after[i]
            if left < 0 or j == n:
                continue
            m = merges.get(left * width + symbols[j])
            if m is None or m[0] != rank:
                continue
            made = symbols[i] = m[1]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(made * width + symbols[k]):
                    heapq.heappush(heap, m[0] * n + i)
            h = before[i]
            if h >= 0 and (m := merges.get(symbols[h] * width + made)):
                heapq.heappush(heap, m[0] * n + h)
        return [s for s in symbols if s >= 0]

    def pieces(self, text: str) -> list[list[int]]:
        """The pre-tokens of a segment, as ids of their bytes."""
        of = self.of_byte
        if m := SIMPLE.fullmatch(text):
            return [[of[b] for b in part.encode()] for part in m.groups() if part]
        letter = self.letter
        return [[letter[c] for c in chars] for chars, _ in self.pre_tokenize(text)]

    def segment(self, text: str) -> bytes:
        """The ids of one segment, four bytes each."""
        if text in self.special:
            ids = [self.special[text]]
        else:
            ids = [i for p in self.pieces(text) for i in (self.piece(p) if len(p) > 1 else p)]
        data = array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()
        if len(text) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_SEGMENTS:
                self.kept.clear()
            self.kept[text] = data
        return data

    def encode(self, text: str) -> bytes:
        """The ids of `text` as little-endian unsigned 32-bit integers."""
        get, make = self.kept.get, self.segment
        return b"".join([get(s) or make(s) for s in segments(text, self.cut_special)])

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, put together and read as UTF-8; broken bytes become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        for part in slices(batch, "text"):
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for text in part.column("text").to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype("i4"))
            out = {"id": part.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                out["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)


def encoded(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row: whole texts encoded, and decoded again.

    `vocabulary`: path of the JSON file, which every worker must be able to open. A null text counts as empty: no ids and
    the digests of nothing. Special strings inside texts get their special id, as the tokenizers library does by default.
    Repeated rows are encoded each for itself; other columns are not looked at. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    d = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    return d.mapInArrow(lambda b: _encode(b, vocabulary, with_ids), schema).withColumnRenamed("id", key)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        texts = [None if ids is None else bpe.decode(np.array(ids, "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(texts, pa.string())})


def decoded(tokens: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids; null ids give a null text, no ids the empty text."""
    kind = tokens.schema[key].dataType.simpleString()
    d = tokens.select(tokens[key].alias("id"), tokens[ids].cast("array<int>").alias("ids"))
    return d.mapInArrow(lambda b: _decode(b, vocabulary), f"id {kind}, text string").withColumnRenamed("id", key)
