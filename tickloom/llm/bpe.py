"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands inside no vocabulary token can never be joined by a
merge, so the text may be cut between them. ``Encoder`` cuts a batch of texts at
all such pairs (where the pre-tokenizer would not notice the cut either),
encodes each fragment by itself and concatenates the ids. Most fragments are
words seen before, so each distinct fragment of a batch is looked up once and
encoded if it is new.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import column, documents, texts_of

#: Fragments kept per worker, and the longest one worth keeping (bytes).
CACHE_ENTRIES = 300_000
CACHE_BYTES = 48

#: White space under any definition a pre-tokenizer may use (ASCII part).
ASCII_SPACE = [*range(0x09, 0x0E), *range(0x1C, 0x21)]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def library_tokenizer(path: str):
    """The library's own tokenizer, its truncation and padding unused."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id; an added token stands for its own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    symbols = byte_symbols()
    vocab = spec["model"]["vocab"]
    table = [b""] * (max([*vocab.values(), *added]) + 1)
    for token, i in vocab.items():
        table[i] = added.get(i) or bytes(symbols[c] for c in token)
    for i, content in added.items():
        table[i] = content
    return table


def boundary_table(tokens: Iterable[bytes]) -> np.ndarray:
    """For each pair of bytes (first * 256 + second): True if a text may always be cut between them.

    Beyond pairs that stand inside a token, three kinds are refused because a cut
    there could change the pre-tokenizer's matches or split a character: after
    white space, before an apostrophe, and before a UTF-8 continuation byte.
    """
    cut = np.ones((256, 256), bool)
    for t in tokens:
        for a, b in zip(t, t[1:]):
            cut[a, b] = False
    cut[ASCII_SPACE] = False
    cut[:, ord("'")] = False
    cut[:, 0x80:0xC0] = False
    return cut.reshape(-1)


def rank_encoding(path: str, tokens: list[bytes]):
    """A tiktoken encoding with the file's own vocabulary, or None where ids aren't the order of the merges.

    It gives the library's ids and is several times faster on short fragments.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    parts = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    in_order = all(vocab["".join(m)] == 256 + i for i, m in enumerate(parts))
    plain = spec["normalizer"] is None and spec["post_processor"] is None and all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    split = spec["pre_tokenizer"]
    if not (in_order and plain and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]):
        return None
    ranks = {t: i for i, t in enumerate(tokens) if i not in added.values()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def sliced(values: pa.LargeBinaryArray, at: np.ndarray | None = None) -> list[bytes]:
    """The values as bytes; with ``at``, those from each of these places to the next are one."""
    if not len(values):
        return [b""] * (0 if at is None else len(at) - 1)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    whole, cuts = data.to_pybytes() if data else b"", (ends if at is None else ends[at]).tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """Encodes and decodes with one vocabulary file; one per worker process, see ``encoder()``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokens = token_bytes(path)
        self.cut = boundary_table(self.tokens)
        self.ranked = rank_encoding(path, self.tokens)
        self.library = None if self.ranked else library_tokenizer(path)
        self.known: dict[bytes, bytes] = {}

    def apart(self, piece: bytes) -> list[int]:
        """The ids of one fragment."""
        text = piece.decode()
        if self.ranked is None:
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranked.encode(text, allowed_special="all") if "<" in text else self.ranked.encode_ordinary(text)

    def learn(self, pieces: list[bytes]) -> None:
        """Fill ``known`` for new fragments, most of them in one call.

        The control byte 1 is in no token but its own, so fragments joined by it
        keep their ids, unless the pre-tokenizer would look across it: those that
        end in white space, begin with an apostrophe, or hold that byte or the
        start of an added token go one at a time.
        """
        together = [
            p for p in pieces
            if p[0] != 0x27 and b"\x01" not in p and b"<|" not in p and (0x20 < p[-1] < 0x7F or not p[-4:].decode("utf-8", "ignore")[-1:].isspace())
        ] if self.ranked else []
        if together:
            ids = np.frombuffer(self.ranked.encode_to_numpy(b"\x01".join([*together, b""]).decode()), np.uint32)
            ends = np.flatnonzero(ids == self.tokens.index(b"\x01"))
            packed = ids.astype("<u4").tobytes()
            at = [0, *((ends + 1) * 4).tolist()]
            self.known.update(zip(together, [packed[a : b - 4] for a, b in zip(at, at[1:])]))
        if len(together) < len(pieces):
            for p in pieces:
                if p not in self.known:
                    self.known[p] = array("I", self.apart(p)).tobytes()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in ``data`` (bytes) before which a forced boundary lies."""
        if len(data) < 2:
            return np.empty(0, np.int64)
        ok = self.cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        # after white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000-206F, U+3000-303F
        for lead in np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))):
            end = lead + (1 if data[lead] == 0xC2 else 2)
            if end < len(ok) and (data[lead] != 0xC2 or data[end] in (0x85, 0xA0)):
                ok[end] = False
        return np.flatnonzero(ok) + 1

    def fragments(self, texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The fragments of all texts in order, and how many fragments precede each text (one more entry for the end)."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        data = b"".join(raw)
        stop = np.zeros(len(data) + 1, bool)
        stop[self.cuts(np.frombuffer(data, np.uint8))] = True
        stop[ends] = True
        stop[0] = True
        marks = np.flatnonzero(stop)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(marks) - 1, [None, pa.py_buffer(marks), pa.py_buffer(data)])
        return pieces, np.concatenate(([0], np.searchsorted(marks, ends)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Arrow finds the distinct fragments and puts the ids in place of each, so Python sees every distinct one once.
        """
        pieces, offsets = self.fragments(texts)
        coded = pieces.dictionary_encode()
        distinct = sliced(coded.dictionary)
        if len(self.known) > CACHE_ENTRIES:
            # those of this batch are the likeliest to come again
            self.known = {p: self.known[p] for p in distinct if p in self.known}
        out = list(map(self.known.get, distinct))
        holes = [i for i, x in enumerate(out) if x is None]
        self.learn([distinct[i] for i in holes])
        for i in holes:
            out[i] = self.known[distinct[i]]
            if len(distinct[i]) > CACHE_BYTES:
                del self.known[distinct[i]]
        return sliced(pa.array(out, pa.large_binary()).take(coded.indices), offsets)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, decode: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of every text, and with ``decode`` the text restored from the ids.

    Null and empty texts give an empty array. One pass over the rows, no shuffle.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = enc.encode(column(batch, "text").to_pylist())
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            cols = [column(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            names = ["doc_id", "ids"]
            if decode:
                cols.append(pa.array([enc.decode(x) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decode)


def op5_forced_boundary_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them.

    The same pass as ``encode_documents`` with digests taken in place, so that no
    row carries its ids through Arrow. Null texts count as empty.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = enc.encode(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents(spark, sf_dir).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
