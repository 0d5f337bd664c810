"""Operator 7, token ids in bit-packed binary files.

A file holds the ids of consecutive documents (ascending doc_id), each in the fewest bits that hold the vocabulary.
Ids are packed in blocks of ``BLOCK``, so that any id range is read by seeking to its blocks; packing and unpacking
work on whole numpy lanes. Layout, little-endian: magic, the blocks' bytes, doc ids (int64), null flags (uint8), ids
before each document (uint64, one more than documents), block offsets (uint64, one more than blocks), and a footer
of (bits, block, documents, blocks) with the magic again.

Files are written to the shared folder under a temporary name and renamed, so a repeated or lost task leaves the same
files. Rows are ordered by id and then by the text's hash, so that one id that stands on many rows is parted like many
ids. A null or empty text has the end id alone; null doc_ids come first; repeated rows are all written; very long texts
are cut into pieces as wholes, and only distinct pieces are kept; an empty table writes no file; other columns are
ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import scratch_path, stash, text_batches

MAGIC = b"LLTOK001"
FOOTER = struct.Struct("<IIQQ8s")
BLOCK = 8192
END_ID = 2
TOKENIZER_FILE = "word_bpe_49k.json"
#: Pieces and characters that a worker's table holds at most, and documents that are encoded at a time.
MEMO, MEMO_CHARS = 600_000, 1 << 25
LOT = 2000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids make ``bits`` bytes; the last group is filled with zeros. Widths of whole bytes are their own bytes."""
    if bits in (8, 16, 32):
        return np.pad(ids, (0, -len(ids) % 8)).astype(f"<u{bits // 8}").tobytes()
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        moved = lanes[:, lane] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, first + k] |= ((moved >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    groups = np.frombuffer(data, np.uint8).reshape(-1, bits)
    out = np.empty((len(groups), 8), np.uint32)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        joined = np.zeros(len(groups), np.uint64)
        for k in range((shift + bits + 7) // 8):
            joined |= groups[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (joined >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:count]


class TokenWriter:
    """Streams documents into one file; holds one block and the document index."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        if block % 8:
            raise ValueError("a block holds a multiple of 8 ids")
        self.sink, self.bits, self.block = sink, bits, block
        self.docs, self.nulls, self.counts, self.offsets = [], [], [], [len(MAGIC)]
        self.rest, self.n_docs, self.n_ids = np.empty(0, np.uint32), 0, 0
        sink.write(MAGIC)

    def add(self, docs: np.ndarray, nulls: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents in a row: their ids one after the other, and how many each has."""
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id needs more bits")
        self.docs.append(docs)
        self.nulls.append(nulls)
        self.counts.append(counts)
        self.n_docs, self.n_ids = self.n_docs + len(docs), self.n_ids + len(ids)
        joined = np.concatenate([self.rest, ids])
        whole = len(joined) // self.block * self.block
        self._put(joined[:whole])
        self.rest = joined[whole:].copy()

    def _put(self, ids: np.ndarray) -> None:
        """Whole blocks, or the last one: a block is a whole number of eight-id groups, so blocks are packed in one go."""
        self.sink.write(pack(ids, self.bits))
        for n in [self.block] * (len(ids) // self.block) or [len(ids)] * (len(ids) > 0):
            self.offsets.append(self.offsets[-1] + -(-n // 8) * self.bits)

    def close(self) -> None:
        self._put(self.rest)
        starts = np.cumsum(np.concatenate([[0], *self.counts]))
        for values, kind in ((self.docs, "<i8"), (self.nulls, "u1"), ([starts], "<u8"), ([self.offsets], "<u8")):
            self.sink.write(np.concatenate([np.empty(0, kind), *values]).astype(kind).tobytes())
        self.sink.write(FOOTER.pack(self.bits, self.block, self.n_docs, len(self.offsets) - 1, MAGIC))
        self.sink.close()


class TokenReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        self.bits, self.block, docs, blocks, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        at = size - FOOTER.size - 8 * (blocks + 1) - 8 * (docs + 1) - 9 * docs
        index = self._bytes(at, size - FOOTER.size - at)
        self.docs = np.frombuffer(index, "<i8", docs)
        self.nulls = np.frombuffer(index, "u1", docs, 8 * docs)
        self.starts = np.frombuffer(index, "<u8", docs + 1, 9 * docs)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1, 9 * docs + 8 * (docs + 1))

    def _bytes(self, at: int, count: int) -> bytes:
        self.source.seek(at)
        return self.source.read(count)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Any id range of the file, from the blocks that hold it."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self._bytes(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        total = int(self.starts[-1])
        return unpack(data, self.bits, min((last + 1) * self.block, total) - first * self.block)[start - first * self.block : stop - first * self.block]

    def document(self, n: int) -> np.ndarray:
        return self.ids(int(self.starts[n]), int(self.starts[n + 1]))


def open_uri(uri: str):
    """(file system, path) of a local path or of any URI that pyarrow reads."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


#: What a plain text lacks: characters that normalisation does more to than to lower-case them, and the beginning of
#: special tokens.
NOT_PLAIN = r"[^\t\n\r\x20-\x7e\x{00c0}-\x{00d6}\x{00d8}-\x{00f6}\x{00f8}-\x{012f}\x{0131}-\x{024f}]|<\|"
SPACE, LETTER, DIGIT, OTHER = range(4)
_KINDS = np.full(256, OTHER, np.uint8)
_KINDS[[9, 10, 13, 32]] = SPACE
_KINDS[48:58] = DIGIT
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def piece_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that the tokenizer's pre-tokenizer makes of lower-cased plain text (UTF-8 bytes): a
    contraction, a run of letters, a digit, or a run of other characters; white space parts pieces and belongs to none."""
    kinds = _KINDS[data]
    before = np.concatenate([[SPACE], kinds[:-1]]).astype(np.uint8)
    starts = (kinds != SPACE) & ((kinds != before) | (kinds == DIGIT))
    marks = np.flatnonzero((data == 39) & (before != OTHER))
    if len(marks):
        ahead = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = ahead[marks + 1], ahead[marks + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))  # re, ve, ll
        starts[marks[short | long] + 1] = False
        after = np.concatenate([marks[short] + 2, marks[long] + 3])
        after = after[after < len(data)]
        starts[after[kinds[after] != SPACE]] = True
    ends = (before != SPACE) & (starts | (kinds == SPACE))
    ends = np.flatnonzero(ends)
    return np.flatnonzero(starts), np.append(ends, len(data)) if len(data) and kinds[-1] != SPACE else ends


class WordEncoder:
    """The tokenizers library behind a bounded table of pieces.

    The tokenizer drops white space and lets no token cross a piece's border, so a text's ids are those of its pieces in
    a row. Plain texts (see ``NOT_PLAIN``) are cut into pieces as bytes, a batch at
    a time; distinct pieces are found by Arrow, those not seen yet are encoded by the library's model, and ids are
    gathered with numpy. Other texts are cut at blanks, and the words go through the whole library.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.model, self.end_id = Tokenizer.from_file(path), Tokenizer.from_file(path), end_id
        self.model.normalizer = normalizers.Lowercase()
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.last = np.zeros(self.vocabulary, bool)  # ids that end a piece
        for token, at in self.library.get_vocab().items():
            self.last[at] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        """Entry 0 is the end of a document."""
        self.places: dict[str | None, int] = {}
        self.ids = np.array([] if self.end_id is None else [self.end_id], np.uint32)
        self.first, self.count, self.held = np.zeros(1, np.int64), np.full(1, len(self.ids), np.int64), 0

    def _add(self, names: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        known = len(self.first)
        self.places.update(zip(names, range(known, known + len(names)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, ids])
        self.held += sum(map(len, names))

    def _entries(self, pieces: pa.Array, learn) -> np.ndarray:
        """Table entries of the pieces; the ones that are not in the table are learnt."""
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if new := [w for w in names if w not in self.places]:
            learn(new)
        return np.fromiter(map(self.places.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]

    def _learn_pieces(self, names: list[str], lot: int = 512) -> None:
        """Pieces of plain text, joined by blanks; each one's last id is marked in the vocabulary."""
        found = [e.ids for e in self.model.encode_batch_fast([" ".join(names[at : at + lot]) for at in range(0, len(names), lot)], add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, sum(map(len, found)))
        counts = np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)
        if len(counts) != len(names) or counts.sum() != len(ids):
            raise ValueError("the vocabulary doesn't mark the ends of pieces")
        self._add(names, ids, counts)

    def _learn_words(self, names: list[str], lot: int = 4096) -> None:
        for at in range(0, len(names), lot):
            found = [e.ids for e in self.library.encode_batch_fast([w[1:] for w in names[at : at + lot]], add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self._add(names[at : at + lot], np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts.sum())), counts)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Table entries of the texts in a row, and how many each text has."""
        data = np.frombuffer(("\n".join(texts.to_pylist()) + "\n").encode(), np.uint8)
        stops = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        low = _LOWER[data]
        starts, ends = piece_bounds(low)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        inside = low[_KINDS[low] != SPACE]
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(inside))
        return self._entries(pieces, self._learn_pieces), np.diff(np.searchsorted(starts, stops), prepend=0)

    def _any(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As _plain; words stand in the table after a line feed, which no piece has."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = pc.binary_join_element_wise("", cut.flatten(), "\n")
        return self._entries(words, self._learn_words), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the end id, and how many each text has."""
        if len(self.places) > MEMO or self.held > MEMO_CHARS:
            self.clear()
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, NOT_PLAIN).to_numpy(zero_copy_only=False)
        counts, parts = np.zeros(len(texts), np.int64), []
        for flags, cut in ((~odd, self._plain), (odd, self._any)):
            if flags.any():
                entries, counts[flags] = cut(texts.filter(pa.array(flags)))
                parts.append(np.insert(entries, np.cumsum(counts[flags]), 0))
        entries = parts[0] if len(parts) == 1 else self._woven(parts, odd, counts + 1)
        sizes = self.count[entries]
        ends = np.cumsum(sizes)
        out = self.ids[np.repeat(self.first[entries] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts + 1)])])

    @staticmethod
    def _woven(parts: list[np.ndarray], odd: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Plain and other texts' entries in the texts' order."""
        whose = np.repeat(odd, counts)
        out = np.empty(len(whose), np.int64)
        out[~whose], out[whose] = parts
        return out


_LOADED: dict[tuple[str, int | None], WordEncoder] = {}


def encoder_of(path: str, end_id: int | None) -> WordEncoder:
    """One for each Python worker, so that its table serves all tasks there."""
    if (path, end_id) not in _LOADED:
        _LOADED[path, end_id] = WordEncoder(path, end_id)
    return _LOADED[path, end_id]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Encode and write; returns the manifest: path, part (its number), n_docs, n_ids of every file."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path(TOKENIZER_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                encoder, context = encoder_of(path, end_id), TaskContext.get()
                fs, base = open_uri(folder)
                fs.create_dir(base, recursive=True)
                part = context.partitionId()
                name = f"{base}/part-{part:06d}.tok"
                temporary = f"{name}.{context.taskAttemptId()}.tmp"
                writer = TokenWriter(fs.open_output_stream(temporary), bits_for(encoder.vocabulary))
            keys, texts = b.column(0), b.column(1)
            for at in range(0, b.num_rows, LOT):
                own = keys.slice(at, LOT)
                writer.add(pc.fill_null(own, 0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), *encoder.encode(texts.slice(at, LOT)))
        if writer is not None:
            writer.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pylist([{"path": name, "part": part, "n_docs": writer.n_docs, "n_ids": writer.n_ids}], MANIFEST)

    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]  # rows of one id are told apart by their texts, also where files part
    spread = F.xxhash64(F.monotonically_increasing_id())  # equal rows give equal bytes in any order, and may lie in several files
    return stash(rows.withColumn("u", spread).repartitionByRange(*keys, F.col("u")).drop("u").sortWithinPartitions(*keys).mapInArrow(run, "path string, part int, n_docs long, n_ids long"), "token-manifest")


MANIFEST = pa.schema([("path", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files, a file a row."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = stash(manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")), "token-bases")  # one row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_uri(folder)
        for b in batches:
            for name, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(name) as source:
                    reader = TokenReader(source)
                    for low in range(0, len(reader.docs), 1024):
                        high = min(low + 1024, len(reader.docs))
                        starts = reader.starts[low : high + 1].astype(np.int64)
                        ids = memoryview(reader.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes())
                        places = (4 * (starts - starts[0])).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.docs[low:high], pa.int64(), mask=reader.nulls[low:high].astype(bool)),
                                pa.array(starts[:-1] + base, pa.int64()),
                                pa.array(np.diff(starts), pa.int64()),
                                pa.array([zlib.crc32(ids[a:z]) for a, z in zip(places[:-1], places[1:], strict=True)], pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # as many partitions as files: given as a number, they are not put together again
    return based.repartition(max(1, based.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer_path), folder)
