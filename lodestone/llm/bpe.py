"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is UTF-8 bytes; every token is a run of bytes, so byte offsets are running sums of
token lengths, character offsets follow by counting the bytes that begin a character, and
decoding joins the tokens' bytes again, also where a character lies in several tokens.

Texts are cut before single spaces that stand before a visible character: no match of the
splitting pattern reaches over such a space, so the pieces have the ids that they have in
the whole text, and each distinct piece is encoded once while a worker remembers it. New
pieces are encoded together and told apart by the byte offsets of their tokens. What is
remembered is bounded, and forgetting changes no result.

Defined results: a null or empty text has no tokens and decodes to no bytes; strings of
special tokens are ordinary text; repeated rows get equal results; an empty table gives an
empty table; a very long text is held whole by one task; other columns stay, those named as
results are replaced (an id column of such a name is an error).
"""

from __future__ import annotations

import base64
import ctypes
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Distinct pieces that a worker remembers.
REMEMBERED = 400_000
#: Before these bytes a space begins a match: visible ASCII, and first bytes of characters that are no white space.
_UNSAFE = re.compile(rb" (?![!-~\xc3-\xe0\xe4-\xf4])")
#: Marks that end a match of letters before them and begin one of their own.
_MARKS = b",.;:!?"
_SAFE = re.compile(rb" (?=[!-~\xc3-\xe0\xe4-\xf4])")


class PieceEncoder:
    """Encodes UTF-8 bytes piece by piece. Values are the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced  # a piece after the first begins with its space
        if spaced:
            self.sizes = np.array([len(t) for t in token_bytes(tokenizer_path)], np.int64)
        self.heads: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = self.heads if not spaced else {}

    def _learn(self, pieces: set[bytes], known: dict[bytes, bytes], together: bool) -> None:
        new = pieces.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = pieces
        stems = new
        if together:  # between a letter and such marks a match ends: the stem and the marks have ids of their own
            marked = {p: len(stem) for p in new if p[-1:] in _MARKS and (stem := p.rstrip(_MARKS))[-1:].isalpha()}
            stems = ({p[: marked[p]] if p in marked else p for p in new}).difference(known)
            self._learn({p[n:] for p, n in marked.items()}, self.marks, False)
        stems = list(stems)
        for at in range(0, len(stems), 128):
            some = stems[at : at + 128]
            if together:
                self._learn_together(some, known)
                continue
            for piece, e in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                known[piece] = np.array(e.ids, "<u4").tobytes()
        if together:
            for p, n in marked.items():
                known[p] = known[p[:n]] + self.marks[p[n:]]

    def _learn_together(self, pieces: list[bytes], known: dict[bytes, bytes]) -> None:
        """Pieces after a space, as one text: their tokens are told apart by where they end."""
        text = b" " + b" ".join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum([len(p) + 1 for p in pieces])
        last = np.searchsorted(ends, wanted)
        if len(last) and not np.array_equal(ends[np.minimum(last, len(ends) - 1)], wanted):
            raise RuntimeError("a token reaches over a piece's end")
        begin = 0
        for piece, end in zip(pieces, (4 * (last + 1)).tolist(), strict=True):
            known[piece] = ids.data[begin // 4 : end // 4].tobytes()
            begin = end

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        cut = [self._cut(t) for t in texts]
        if self.spaced:
            self._learn({c[0] for c in cut if c}, self.heads, False)
            self._learn(set().union(*(c[1:] for c in cut)), self.tails, True)
        else:
            self._learn(set().union(*cut), self.heads, False)
        heads, tails = self.heads, self.tails
        return [heads[c[0]] + b"".join(map(tails.__getitem__, c[1:])) if c else b"" for c in cut]

    def _cut(self, text: bytes) -> list[bytes]:
        if not self.spaced:
            return text.split()
        if not text:
            return []
        return _SAFE.split(text) if _UNSAFE.search(text) else text.split(b" ")


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(tokenizer_path: str, spaced: bool = True) -> PieceEncoder:
    """One for each worker process."""
    key = (tokenizer_path, spaced)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(tokenizer_path, spaced)
    return _encoders[key]


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 for itself, the others from 256 on."""
    visible = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


_tables: dict[str, list[bytes]] = {}


def token_bytes(tokenizer_path: str) -> list[bytes]:
    """The bytes of every id, by a tokenizers file or by ranks."""
    if tokenizer_path not in _tables:
        if tokenizer_path.endswith(".tiktoken"):
            with open(tokenizer_path, "rb") as f:
                pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f)]
        else:
            from tokenizers import Tokenizer

            back = byte_characters()
            vocab = Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True)
            pairs = [(i, bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()) for s, i in vocab.items()]
        table = [b""] * (max(i for i, _ in pairs) + 1)
        for i, token in pairs:
            table[i] = token
        _tables[tokenizer_path] = table
    return _tables[tokenizer_path]


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def offsets(ids: np.ndarray, text: bytes, table: list[bytes]) -> np.ndarray:
    """(first, last + 1) character of each token; a token that holds part of a character counts it whole."""
    ends = np.cumsum([len(table[i]) for i in ids.tolist()], dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    starts_char = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(starts_char)])  # characters begun before each byte
    inside = np.concatenate([~starts_char, [False]])
    return np.stack([upto[begins] - inside[begins], upto[ends]], axis=1) if len(ends) else np.empty((0, 2), np.int64)


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[range]:
    """Ranges of rows with about that many bytes; a longer text has one of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield range(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield range(at, len(texts))


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[range, list[bytes]]]:
    """Ranges of a batch's rows with about that many bytes of text, and their texts: no more than one slice is taken out of the batch."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield range(at, to), [t or b"" for t in texts.slice(at, to - at).to_pylist()]
        at, before = to, int(ends[to - 1])


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; in the end freed memory goes back to the system, where other processes of the executor may need it."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def encode_texts(docs: DataFrame, *, tokenizer_path: str, text_col: str = "text", keep_text: bool = True, with_offsets: bool = True) -> DataFrame:
    """docs and ids array<int>; with_offsets: also token_offsets, (first, last + 1) character of each token."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    if with_offsets:
        added.append(T.StructField("token_offsets", T.ArrayType(T.ArrayType(T.IntegerType(), False), False)))
    taken = {f.name for f in added} | (set() if keep_text else {text_col})
    kept = [f for f in docs.schema.fields if f.name not in taken]
    schema = T.StructType(kept + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        table = token_bytes(tokenizer_path) if with_offsets else []
        for batch in batches:
            for rows, some in text_slices(batch, text_col):
                encoded = enc.encode(some)
                part = batch.slice(rows.start, len(rows))
                columns = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                lengths = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)))
                if with_offsets:
                    columns["token_offsets"] = pa.array([offsets(np.frombuffer(e, "<u4"), t, table).tolist() for e, t in zip(encoded, some, strict=True)], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, *, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded and decoded binary: the bytes of its ids, valid UTF-8 only where whole characters were encoded."""
    kept = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(tokenizer_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            columns = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in kept}
            columns["decoded"] = pa.array([None if x is None else decode(np.array(x, np.int64), table) for x in ids.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, *, tokenizer_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids, and of the bytes that the reversed byte table gives for them.

    ranks_path: a tiktoken file that must give every id of the tokenizer's file the same bytes.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table, ranks = encoder(tokenizer_path), token_bytes(tokenizer_path), token_bytes(ranks_path)
        if table[: len(ranks)] != ranks:
            raise ValueError("the tokenizer's file and the ranks differ")
        decimal = [str(i) for i in range(len(table))]
        for batch in batches:
            counts, sums, back = [], [], []
            for _, some in text_slices(batch, text_col):
                for e in enc.encode(some):
                    ids = np.frombuffer(e, "<u4").tolist()
                    counts.append(len(ids))
                    sums.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_pydict({id_col: batch.column(batch.schema.get_field_index(id_col)), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return docs.select(id_col, text_col).mapInArrow(lambda batches: released(run(batches)), schema)
