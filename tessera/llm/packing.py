"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

Tasks tokenise whole texts and keep only lengths and checksums of ids. Pieces that fill a sequence take one alone; the
others are dealt at random over packers of some tens of thousands of pieces each, more packers for more rows, and each
packer places its pieces, longest first, where the sum over gaps of (open sequences with that gap)^2 grows least. A
packer leaves a few sequences open at its end, so the loss doesn't grow with the corpus.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stage

CAPACITY = 1024
END_ID = 2
#: Pieces that one packer places.
PIECES_PER_PACKER = 50_000
#: Words whose ids a task remembers.
REMEMBERED = 300_000
#: Fixed value: how byte-level vocabularies split text before merging bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that are encoded together.
TEXTS_AT_ONCE = 64
NEWLINE_ID = 198

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself if printable, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level vocabulary file, as little-endian unsigned 32-bit numbers.

    The file's own library is exact but slow, so it only gets texts that hold one of the vocabulary's special strings;
    the others go through a faster library with the same vocabulary. A text in which words are set apart by single spaces
    is encoded word by word, each word with the space before it: frequent words are looked up, and the new words of
    some texts are encoded in one call, a line each.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        back = byte_of_char()
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
        self.special = tuple(special)
        self.exact = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.by_line = ranks[b"\n"] == NEWLINE_ID
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def _learn(self, fresh: list[str]) -> None:
        ids = np.array(self.fast.encode_ordinary("\n".join(" " + w for w in fresh)), dtype="<u4")
        cuts = np.flatnonzero(ids == NEWLINE_ID)
        begin, end, data = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)], ids.tobytes()
        self.known.update((w, data[s:e]) for w, s, e in zip(fresh, begin, end, strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        split: dict[int, list[str]] = {}
        for k, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[k] = np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                split[k] = text.split(" ")
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = set().union(*(words[1:] for words in split.values())) - self.known.keys()
        odd = {w for w in fresh if w.split() != [w]}  # empty, or with white space of some kind inside
        spaced = {w for w in odd if not w or w[0].isspace() or w[-1].isspace()}  # what comes next decides how these split
        if fresh - odd and self.by_line:
            self._learn(list(fresh - odd))
        self.known.update((w, self._plain(" " + w)) for w in (odd - spaced if self.by_line else fresh - spaced))
        for k, (first, *rest) in split.items():
            if first[-1:].isspace() or not first or (spaced and not spaced.isdisjoint(rest)):
                out[k] = self._plain(texts[k])
            else:
                out[k] = b"".join([self._plain(first), *map(self.known.__getitem__, rest)])
        return out


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n ids: whole pieces of the capacity, the first takes what is over."""
    head = (n - 1) % capacity + 1
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder, end = Encoder(path), np.array([END_ID], dtype="<u4").tobytes()
    for batch in batches:
        rows = []
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            some = batch.slice(at, TEXTS_AT_ONCE)
            for doc_id, ids in zip(some.column(0).to_pylist(), encoder.ids([t or "" for t in some.column(1).to_pylist()]), strict=True):
                ids += end
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(pieces_of(len(ids) // 4, capacity))]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(lambda it: _tokenised(it, vocabulary, capacity), PIECE_SCHEMA)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, pieces taken in the order given.

    A piece of length w moves an open sequence from gap g to g - w, which changes the sum of squares by
    2 (N[g - w] - N[g]) + 2 (a full one leaves the count: 1 - 2 N[g]). The smallest change wins, ties to the smaller
    gap; a new sequence is only opened if none has room, since fewer sequences are what counts in the end.
    """
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by gap
    count = np.zeros(capacity + 1, dtype=np.int64)
    sequence, offset, used = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for k, w in enumerate(lengths.tolist()):
        change = 2 * (count[: capacity + 1 - w] - count[w:]) + 2
        change[0] = 1 - 2 * count[w]
        change[count[w:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        gap = best + w
        if count[gap]:
            s = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, s, used = capacity, used, used + 1
        sequence[k], offset[k] = s, capacity - gap
        if gap > w:
            open_at[gap - w].append(s)
            count[gap - w] += 1
    return sequence, offset


def pack(pieces: DataFrame, total: int, capacity: int = CAPACITY) -> DataFrame:
    """A staged table of pieces (row, length and others) with sequence_id and offset."""
    packers = max(1, -(-total // PIECES_PER_PACKER))
    dealt = pieces.withColumn("packer", F.pmod(F.xxhash64("row"), F.lit(packers)))
    whole = dealt.where(F.col("length") == capacity).withColumns({"sequence_id": (F.col("row") * 2 + 1), "offset": F.lit(0).cast("long")})

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], ascending=[False, True])
        sequence, offset = place(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=(frame["packer"].to_numpy() * PIECES_PER_PACKER * 4 + sequence) * 2, offset=offset)

    rest = dealt.where(F.col("length") < capacity)
    return whole.unionByName(rest.groupBy("packer").applyInPandas(fill, whole.schema)).drop("packer", "row")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every row of docs (doc_id, text), tokenised and packed: one row per piece with its sequence and place there.

    Null text is an empty one: its only id is the end id. Repeated rows are packed each; a null doc_id stays null. An
    empty table gives an empty result; other columns are not read.
    """
    pieces = tokenised_pieces(docs, vocabulary, capacity).withColumn("row", F.monotonically_increasing_id())
    staged = stage(pieces, "pieces")
    return pack(staged, staged.count(), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
