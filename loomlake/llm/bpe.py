"""Operator 2, byte-level BPE encoding and decoding.

A piece's bytes are read as Latin-1, so that a pyahocorasick automaton over the vocabulary gives, in one pass, the
longest token that starts at each byte. The encoder lays longest matches from the left; where the next token can't
stand beside the last one it tries the token's next shorter prefix, and where none is left it takes the last token
back. Two tokens can stand side by side if merging their joined bytes by rank gives just these two; that is memoised for
each pair.
A byte place from which nothing fits is marked and never tried again, so the work is linear in the bytes.

Null texts are encoded as empty ones; an empty text has no ids. Pieces that were seen are kept in a memo that is bounded
by entries and by characters, so that texts of any length, without blanks too, pass through. Repeated rows give equal
rows, an empty table none, and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import text_batches

MEMO, MEMO_CHARS = 400_000, 1 << 24
RANKS_FILE = "byte_bpe_50k.tiktoken"


class Memo(dict):
    """A dict that computes what it lacks and starts anew when it is full: of entries, or of characters of its keys."""

    def __init__(self, make, most: int = MEMO, most_chars: int = MEMO_CHARS):
        super().__init__()
        self.make, self.most, self.most_chars, self.chars = make, most, most_chars, 0

    def __missing__(self, key):
        if len(self) >= self.most or self.chars > self.most_chars:
            self.clear()
            self.chars = 0
        if isinstance(key, str):
            self.chars += len(key)
        value = self[key] = self.make(key)
        return value


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str):
        import public_tokenizers

        self.by_words = pattern == public_tokenizers.PATTERN  # see ``pieces``
        with open(ranks_path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes_of = {rank: token.encode("latin-1") for token, rank in self.ranks.items()}
        self.lengths = {rank: len(token) for token, rank in self.ranks.items()}
        self.digits = {rank: f" {rank}" for rank in self.tokens}
        # tiktoken's white space is the Unicode property, without the separators U+001C to U+001F
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.shorter = Memo(self._shorter, 1 << 17)
        self.parts = Memo(self._parts, 1 << 17)
        self.beside = Memo(self._beside, 1 << 20)
        self.piece = Memo(self._piece)
        self.after_space = Memo(lambda word: self._piece(" " + word))

    def _shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        token = self.tokens[rank]
        return next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), None)

    def _parts(self, rank: int) -> tuple[int, int] | None:
        """The two ids whose merge makes this token; None for a single byte."""
        parts = list(self.tokens[rank])
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], rank))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _beside(self, pair: tuple[int, int]) -> bool:
        """Go back in time from two finished tokens: undo the later merge of the two, and look whether the parts that
        then touch would have been merged across the border before it (or at the same rank, being further left)."""
        left, right = pair
        until = 1 << 60
        while True:
            if self.ranks.get(self.tokens[left] + self.tokens[right], until) < until:
                return False
            for undo_left in (left > right, left <= right):
                parts = self.parts[left if undo_left else right]
                if parts is not None:
                    break
            else:
                return True
            until, left, right = (left, parts[1], right) if undo_left else (right + 1, left, parts[0])

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern."""
        data = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        size, lengths, beside, shorter = len(data), self.lengths, self.beside, self.shorter
        longest = [0] * size
        for end, rank in self.automaton.iter(data):
            longest[end + 1 - lengths[rank]] = rank  # ends ascend, so the longest comes last
        tokens, at, last, shut = [], 0, -1, set()
        candidate: int | None = longest[0]
        while True:
            while candidate is not None:
                end = at + lengths[candidate]
                if (last < 0 or beside[last, candidate]) and end not in shut:
                    break
                candidate = shorter[candidate]
            if candidate is None:
                shut.add(at)
                candidate = shorter[last]
                tokens.pop()
                at -= lengths[last]
                last = tokens[-1] if tokens else -1
                continue
            tokens.append(candidate)
            if end == size:
                return tokens
            at, last, candidate = end, candidate, longest[end]

    def _piece(self, text: str) -> tuple[int, str, bytes]:
        """Count, decimal ids each after a space, and decoded bytes of a text that pattern boundaries enclose."""
        found = self.pattern.findall(text)
        ids = self.encode_piece(found[0]) if len(found) == 1 else [i for m in found for i in self.encode_piece(m)]
        return len(ids), "".join(map(self.digits.__getitem__, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.encode_piece(m)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def pieces(self, text: str) -> list[tuple[int, str, bytes]]:
        """The text's pieces. Where each separator is one blank or line feed between other characters, the public pattern
        always starts a match there, so that words are looked up as wholes; any other text goes match by match, as all
        texts do by other patterns."""
        if not self.by_words or " ".join(text.split()) != text.replace("\n", " "):
            return list(map(self.piece.__getitem__, self.pattern.findall(text)))
        out: list[tuple[int, str, bytes]] = []
        for line in text.split("\n"):
            if out:
                out.append(self.piece["\n"])
            first, *rest = line.split(" ")
            out.append(self.piece[first])
            out.extend(map(self.after_space.__getitem__, rest))
        return out


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(ranks_path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    if (ranks_path, pattern) not in _LOADED:
        _LOADED[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
    return _LOADED[ranks_path, pattern]


def _vocabulary(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return ranks_path or public_tokenizers.path(RANKS_FILE), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>."""
    ranks_path, pattern = _vocabulary(ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks_path, pattern)
        for b in batches:
            ids = [[i for p in bpe.pieces(t or "") for i in map(int, p[1].split())] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    text_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, data binary; null ids decode to no bytes."""
    ranks_path, pattern = _vocabulary(ranks_path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks_path, pattern)
        for b in batches:
            data = [bpe.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    text_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the round trip."""
    ranks_path, pattern = _vocabulary(ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks_path, pattern)
        for b in batches:
            counts, ids, data = [], [], []
            for text in b.column(1).to_pylist():
                found = bpe.pieces(text) if text else []
                counts.append(sum([p[0] for p in found]))
                ids.append(hashlib.sha256("".join([p[1] for p in found])[1:].encode()).hexdigest())
                data.append(hashlib.sha256(b"".join([p[2] for p in found])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    text_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
