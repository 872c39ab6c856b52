"""Exact byte-level BPE over a public vocabulary, by a dynamic program over prefixes.

For every prefix of a piece the last token of its encoding is unique. The program walks the piece once, asks a
suffix-matching automaton for the vocabulary tokens that end at each position, longest first, and keeps the first
one whose pairing with the last token of the shorter prefix survives merging. Back-pointers then give the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits text before the merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces remembered by a Python worker; beyond it the memory is emptied and refilled, which costs time only.
CACHED_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file (base64 token, space, rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of token just before its own (last) merge, found by running all merges of lower rank."""
    own = ranks[token]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best, at = own, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], own)
            if rank < best:
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PrefixEncoder:
    """Encodes pieces (the parts the split pattern yields) into ids, remembering pieces seen before."""

    def __init__(self, ranks: dict[bytes, int], cached: int = CACHED_PIECES) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes; not a byte-level vocabulary")
        self.cached = cached
        self.pattern = regex.compile(SPLIT_PATTERN)
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merge_parts(token, ranks)
                if len(parts) != 2:
                    continue  # no sequence of merges yields it, so no encoding holds it
                left, right = ranks[parts[0]], ranks[parts[1]]
                self.split[rank] = (left, right)
                self.pairs[left, right] = rank
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.meets: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _edges(self, token: int, side: int) -> list[tuple[int, float]]:
        """(token, rank of the merge that absorbs it) for each token ever standing at that edge while token is built."""
        out, absorbed = [(token, float("inf"))], float(token)
        while token in self.split:
            absorbed, token = float(token), self.split[token][side]
            out.append((token, absorbed))
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens when their bytes are encoded together.

        They fuse if some token at left's right edge and some token at right's left edge stand side by side while
        the merge of the two is the next one due. On equal ranks the merge further left goes first.
        """
        known = self.meets.get((left, right))
        if known is None:
            pairs, known = self.pairs, True
            rights = self._edges(right, 0)
            for a, a_until in self._edges(left, 1):
                for b, b_until in rights:
                    due = pairs.get((a, b))
                    if due is not None and due < a_until and due <= b_until:
                        known = False
                        break
                if not known:
                    break
            self.meets[left, right] = known
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace").decode("latin-1")
        last = [0] * (len(raw) + 1)
        back = [0] * (len(raw) + 1)
        meets, compatible, done = self.meets, self.compatible, -1
        for end, (size, token) in self.automaton.iter(raw):
            if end == done:
                continue
            start = end + 1 - size
            if start == 0:
                last[end + 1] = token
                done = end
            else:
                before = last[start]
                ok = meets.get((before, token))
                if ok is None:
                    ok = compatible(before, token)
                if ok:
                    last[end + 1] = token
                    back[end + 1] = start
                    done = end
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return tuple(ids)

    def encode_into(self, text: str, out: list[int]) -> None:
        """Append the ids of text to out."""
        known = self.known
        extend = out.extend
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(known) >= self.cached:
                    known.clear()
                    self.meets.clear()
                known[piece] = ids
            extend(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of text; an empty list for an empty and for a null text."""
        out: list[int] = []
        if text:
            self.encode_into(text, out)
        return out

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """Number of ids of each text."""
        known, findall, out = self.known, self.pattern.findall, []
        for text in texts:
            n = 0
            for piece in findall(text) if text else ():
                ids = known.get(piece)
                if ids is None:
                    ids = self.encode_piece(piece)
                    if len(known) >= self.cached:
                        known.clear()
                        self.meets.clear()
                    known[piece] = ids
                n += len(ids)
            out.append(n)
        return out


_ENCODERS: dict[str, PrefixEncoder] = {}


class SharedVocabulary:
    """A broadcast vocabulary and the digest of its file, which names it in the Python workers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as file:
            self.digest = hashlib.sha256(file.read()).hexdigest()
        self.ranks = spark.sparkContext.broadcast(read_ranks(path))


def worker_encoder(shared: SharedVocabulary) -> PrefixEncoder:
    """The encoder of this Python worker, built once from the broadcast vocabulary; a worker keeps one."""
    if shared.digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.digest] = PrefixEncoder(shared.ranks.value)
    return _ENCODERS[shared.digest]


def share_vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY) -> SharedVocabulary:
    """Broadcast the vocabulary: a published file of some 50,000 tokens (about 1 MB) that doesn't grow with the data."""
    return SharedVocabulary(spark, path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids ARRAY<INT>) for every row of df, without special tokens.

    Null and empty texts give an empty list; a null id is kept; repeated rows give repeated results; other columns,
    whatever their names, are not read. One pass over the scan's partitions, no shuffle.
    """
    shared = share_vocabulary(df.sparkSession, vocabulary)
    src = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for text in batch.column(1).to_pylist():
                if text:
                    encoder.encode_into(text, flat)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    key_type = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {key_type}, ids array<int>").withColumnRenamed("key", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens INT) for every row of df: the sizes without the ids."""
    shared = share_vocabulary(df.sparkSession, vocabulary)
    src = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            sizes = encoder.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], ["key", "n_tokens"])

    key_type = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {key_type}, n_tokens int").withColumnRenamed("key", id_col)
