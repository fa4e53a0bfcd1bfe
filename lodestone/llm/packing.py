"""Packing by minimum bin slack.

Documents become token ids followed by an end id; long ones are cut into full windows, and
only what remains of each competes for the other windows. For one window after another, the
largest remaining piece is taken, then a subset-sum dynamic program over the multiset of the
remaining lengths - a bit set in one integer, multiplicities split into powers of two - finds
the reachable total closest to the capacity, and walking back through the bit sets gives how
many pieces of each length it takes. Windows that stay short of the capacity wait for the
next group; the pieces of those that are left in the end are laid end to end and cut, and
what does not fill a window makes sequences of lengths that are powers of two, which need no
padding.

A partition packs its own documents in groups of bounded size, so nothing is shuffled and a
lost task packs the same sequences again. Sequence ids hold the partition's number in their
upper bits.

With special_literals, strings of special tokens in a text become the special ids, as in the
library's plain call (so the query and the pipeline have it); without, they are ordinary text,
so that no text can forge an end.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by
one, also with null ids; an empty table gives no sequences; extra columns are dropped unless
named, and those named as results are replaced; a very long text is encoded whole by one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.bpe import PieceEncoder, byte_characters, released, text_slices

#: Remaining pieces that a partition packs together.
GROUP = 8192
#: Bits of a sequence's id that number it within its partition.
PER_PARTITION = 33


#: Characters whose normal form and class are plain: there, splitting is that of the tokenizer's file.
_NOT_PLAIN = re.compile("[^\\t\\n\\r -~À-ÖØ-öø-ÿ]")
_PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


#: The normaliser and splitter of tokenizer files whose plain texts may be split here.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(tokenizer_path: str) -> bool:
    """Whether the file lower-cases, drops white space and splits words as this module does."""
    with open(tokenizer_path, encoding="utf-8") as f:
        file = json.load(f)
    before, after = file.get("normalizer") or {}, (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = {"truncation": None, "padding": None, "post_processor": None}
    if before.get("normalizers") != _NORMALIZERS or len(after) != 2 or any(file.get(k) != v for k, v in plain.items()):
        return False
    split, bytes_ = after
    return split == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True} and bytes_.get("type") == "ByteLevel" and not bytes_.get("use_regex") and not bytes_.get("add_prefix_space")


class WordEncoder:
    """Ids of a tokenizer.

    If its file is one that lower-cases, drops white space and ends words with a suffix, texts of plain
    characters are split here and each distinct piece goes through the tokenizer's model once
    while it is remembered. Other texts, and all texts of other files, go through the whole tokenizer.
    """

    REMEMBERED = 250_000

    def __init__(self, tokenizer_path: str, special_literals: bool = False) -> None:
        self.whole = PieceEncoder(tokenizer_path, spaced=False)
        self.known_kind = splits_words(tokenizer_path)
        self.literals = [t.content for t in self.whole.tokenizer.get_added_tokens_decoder().values()] if special_literals else []
        self.whole.tokenizer.encode_special_tokens = not special_literals
        self.model = self.whole.tokenizer.model
        self.character = {b: c for c, b in byte_characters().items()}
        self.known: dict[str, bytes] = {}

    def _learn(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.character.__getitem__, piece.encode()))
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        known, out = self.known, []
        for text in texts:
            shown = text.decode()
            if not self.known_kind or any(x in shown for x in self.literals):
                out.append(np.array(self.whole.tokenizer.encode(shown, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            if _NOT_PLAIN.search(shown):
                out += self.whole.encode([text])
                continue
            pieces = _PLAIN_PIECES.findall(shown.lower())
            new = set(pieces).difference(known)
            if len(known) + len(new) > self.REMEMBERED:
                known.clear()
                new = set(pieces)
            for piece in new:
                known[piece] = self._learn(piece)
            out.append(b"".join(map(known.__getitem__, pieces)))
        return out


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def word_encoder(tokenizer_path: str, special_literals: bool = False) -> WordEncoder:
    """One for each worker process."""
    key = (tokenizer_path, special_literals)
    if key not in _encoders:
        _encoders[key] = WordEncoder(tokenizer_path, special_literals)
    return _encoders[key]


def best_subset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the multiset {length: count}, the counts whose total is the largest within capacity; longer lengths come first."""
    mask = (1 << (capacity + 1)) - 1
    full = 1 << capacity
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        left, n = min(counts[length], capacity // length), 1
        while left > 0:
            n = min(n, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left -= n
            n *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += n
            total -= length * n
    return dict(taken)


def minimum_bin_slack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of indices into lengths (each from 1 to capacity), in the order in which they are filled."""
    where: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        where[lengths[i]].append(i)
    counts = {n: len(at) for n, at in where.items()}
    out = []
    order = sorted(counts, reverse=True)
    for largest in order:
        while counts.get(largest):
            take = {largest: 1}
            counts[largest] -= 1
            if not counts[largest]:
                del counts[largest]
            for length, n in best_subset(counts, capacity - largest).items():
                take[length] = take.get(length, 0) + n
                counts[length] -= n
                if not counts[length]:
                    del counts[length]
            out.append([where[length].pop() for length, n in take.items() for _ in range(n)])
    return out


def powers_of_two(total: int) -> list[int]:
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


class Packer:
    """Takes the documents of a partition; emit(row, start, ids, sequence, offset, doc_tokens) gets every piece."""

    def __init__(self, capacity: int, first_sequence: int, emit) -> None:  # noqa: ANN001
        self.capacity, self.next, self.emit = capacity, first_sequence, emit
        self.waiting: list[tuple[object, int, np.ndarray, int]] = []

    def add(self, row: object, ids: np.ndarray) -> None:
        n, c = len(ids), self.capacity
        for start in range(0, n - c + 1, c):
            self.emit(row, start, ids[start : start + c], self.next, 0, n)
            self.next += 1
        if n % c:
            self.waiting.append((row, n - n % c, ids[n - n % c :], n))
        if len(self.waiting) >= GROUP:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        waiting, self.waiting = self.waiting, []
        short = []
        for window in minimum_bin_slack([len(w[2]) for w in waiting], self.capacity):
            pieces = [waiting[i] for i in window]
            if sum(len(p[2]) for p in pieces) == self.capacity:
                self._put(pieces, [self.capacity])
            else:
                short += pieces
        if not last and len(short) <= GROUP // 2:  # they meet others in the next group
            self.waiting = short
        elif short:
            full, rest = divmod(sum(len(p[2]) for p in short), self.capacity)
            self._put(short, [self.capacity] * full + powers_of_two(rest))

    def _put(self, pieces: list, sizes: list[int]) -> None:
        """Lays the pieces end to end over sequences of these sizes, cutting where one ends."""
        left = sizes[0]
        at, k = 0, 0
        for row, start, ids, n in pieces:
            while len(ids):
                part = ids[:left]
                self.emit(row, start, part, self.next, at, n)
                start, ids, at, left = start + len(part), ids[len(part) :], at + len(part), left - len(part)
                if not left:
                    self.next += 1
                    k += 1
                    at, left = 0, sizes[k] if k < len(sizes) else 0


def pack_documents(docs: DataFrame, *, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = True, special_literals: bool = False) -> DataFrame:
    """A row for each piece: the id, columns to keep, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids.

    capacity is a power of two, so that full windows need no padding either.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    results = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    kept = [c for c in dict.fromkeys([id_col, *keep]) if c not in (*results, "ids")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in results] + ([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else []))
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer_path, special_literals)
        rows: dict[str, list] = {c: [] for c in schema.names}

        def emit(row: tuple, start: int, ids: np.ndarray, sequence: int, offset: int, doc_tokens: int) -> None:
            for c, v in zip(kept, row, strict=True):
                rows[c].append(v)
            for c, v in zip(results, (start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, sequence, offset), strict=True):
                rows[c].append(v)
            if with_ids:
                rows["ids"].append(ids.astype(np.int32))

        def flush() -> pa.RecordBatch:
            types = types_of[0]
            out = pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in rows.items()})
            for v in rows.values():
                v.clear()
            return out

        types_of: list[dict[str, pa.DataType]] = []
        packer = Packer(capacity, TaskContext.get().partitionId() << PER_PARTITION, emit)
        for batch in batches:
            if not types_of:
                types_of.append({c: batch.schema.field(c).type for c in kept} | {c: pa.int64() for c in results} | {"ids": pa.list_(pa.int32())})
            heads = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in kept), strict=True))
            for part, texts in text_slices(batch, text_col):
                for i, ids in zip(part, enc.encode(texts), strict=True):
                    packer.add(heads[i], np.concatenate([np.frombuffer(ids, "<u4"), end]))
                if len(rows["start"]) > 5000:
                    yield flush()
        packer.pack(last=True)
        if rows["start"]:
            yield flush()

    wanted = dict.fromkeys([*kept, text_col])
    return docs.select(*wanted).mapInArrow(lambda batches: released(run(batches)), schema)
