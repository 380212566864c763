"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

A chunk (a word with its leading space, or white space) is cut into pieces by the vocabulary's split
pattern. Inside a piece the encoder takes the longest token that starts at the current byte, found by
one Aho-Corasick pass. A token may follow another only if the exact merges of the two put together
would keep them apart; if no token fits, the encoder steps back one token and never enters that
position again. Each position is left for good at most once, so the work is linear in the bytes.
Decoding gathers bytes from one blob with a table of offsets.

Null text counts as empty. Empty text has no ids. Repeated rows are encoded one by one; further
columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import by_value

# The split pattern of byte-level vocabularies, and Unicode white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0  -     　"

#: Chunks a worker remembers, pairs it remembers, rows and tokens it hands on at once.
CHUNKS, PIECES_KEPT = 400_000, 150_000
PAIRS = 500_000
ROWS_OUT = 512
DECODE_BLOCK = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Token bytes, merge parents and special tokens of a byte-level tokenizer file.

    Only files whose ids rise in merge order can be encoded this way; others are refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
    tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *specials.values()]))
    for word, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in word)
    for word, i in specials.items():
        tokens[i] = word.encode()
    parents = {}
    for merge in spec["model"]["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        parents.setdefault(vocab[left + right], (vocab[left], vocab[right]))
    if list(parents) != sorted(parents) or any(len(tokens[i]) != 1 for i in vocab.values() if i not in parents):
        raise ValueError("the ids of this vocabulary do not rise in merge order")
    return {"tokens": tokens, "parents": parents, "specials": specials}


class Codec:
    """Tables of one vocabulary, built once in each Python worker."""

    def __init__(self, vocabulary: dict):
        import re

        import ahocorasick
        import regex

        self.tokens, self.parents = vocabulary["tokens"], vocabulary["parents"]
        self.specials = vocabulary["specials"]
        special_ids = set(self.specials.values())
        ids = {t: i for i, t in enumerate(self.tokens) if t and i not in special_ids}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        # The next shorter token that is a prefix of a token; -1 if there is none.
        self.shorter = [-1] * len(self.tokens)
        for token, i in ids.items():
            self.shorter[i] = next((ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ids), -1)
        self.fits: dict[tuple[int, int], bool] = {}
        self.merged = {pair: i for i, pair in self.parents.items()}
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.pieces = regex.compile(PIECES)
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.lengths = [len(t) for t in self.tokens]
        self.ids = {t: i for t, i in ids.items() if self.stays_whole(i)}
        self.young_chunks: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.young_pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def stays_whole(self, token: int) -> bool:
        """Whether the merges of this token's own bytes end in the token."""
        parents = self.parents.get(token)
        return parents is None or self.compatible(*parents, below=token)

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether the exact merges of both tokens' bytes end in just these two tokens.

        Undo the merges at the seam, latest first. The pair is broken if at some moment the two
        pieces that touch could have merged before the later of them had been built. ``below``
        asks for merges before that rank only.
        """
        key, fine = (left, right), True
        # Merges of the left token precede those of the right one at equal rank.
        limit = len(self.tokens) + 1 if below is None else below
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                fine = False
                break
            inner_left, inner_right = self.parents.get(left), self.parents.get(right)
            if inner_left is None and inner_right is None:
                break
            if inner_right is None or (inner_left is not None and left > right):
                limit, left = left, inner_left[1]
            else:
                limit, right = right + 1, inner_right[0]
        if below is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[key] = fine
        return fine

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ids.get(data)) is not None:
            return [whole]
        size, sizes, shorter, fits = len(data), self.lengths, self.shorter, self.fits
        longest = [-1] * size
        # Matches come in order of their ends, so the last one written for a start is the longest.
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = token
        out: list[int] = []
        left_for_good = set()
        at, token = 0, longest[0]
        while at < size:
            while token >= 0:
                end = at + sizes[token]
                if end not in left_for_good:
                    if not out:
                        break
                    fine = fits.get((out[-1], token))
                    if fine is None:
                        fine = self.compatible(out[-1], token)
                    if fine:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                left_for_good.add(at)
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that the young generation of chunks does not hold."""
        out = self.old_chunks.get(chunk)
        if out is None:
            out = b""
            for piece in self.pieces.findall(chunk):
                found = self.young_pieces.get(piece) or self.old_pieces.get(piece)
                if found is None:
                    found = array("i", self.encode_piece(piece.encode())).tobytes()
                    self.young_pieces[piece] = found
                out += found
            if len(self.young_pieces) >= PIECES_KEPT:
                self.old_pieces, self.young_pieces = self.young_pieces, {}
        if len(self.young_chunks) >= CHUNKS:
            self.old_chunks, self.young_chunks = self.young_chunks, {}
        self.young_chunks[chunk] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        stops = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.specials else []
        for start, end in [*stops, (len(text), len(text))]:
            known = self.young_chunks
            for chunk in self.chunks.findall(text[at:start] if stops else text):
                parts.append(known.get(chunk) or self.encode_chunk(chunk))
            if end > start:
                parts.append(np.int32(self.specials[text[start:end]]).tobytes())
            at = end
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for k in range(0, len(ids), DECODE_BLOCK):
            part = ids[k : k + DECODE_BLOCK]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            where = np.repeat(self.offsets[part] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
            out.append(self.blob[where].tobytes())
        return b"".join(out).decode("utf-8", errors="replace")


def _codec(shared) -> Codec:
    """The worker's codec; the broadcast value lives as long as the worker, so tables are built once."""
    state = shared.value
    if "codec" not in state:
        state["codec"] = Codec(state)
    return state["codec"]


def _id_arrays(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(ids) if ids else np.empty(0, np.int32))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded``, the text that those ids give back."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(k, ROWS_OUT)
                ids = [codec.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _id_arrays(ids), pa.array([codec.decode(x) for x in ids], pa.string())],
                    names=[id_col, "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def decode(frame: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded`` of any column of ids; null ids count as none."""
    shared = frame.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    kind = frame.schema[id_col].dataType.simpleString()
    return frame.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and checksums of the result of ``encode``."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


by_value(__name__)
