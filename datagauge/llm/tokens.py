"""Token ids in binary files of patched frame-of-reference blocks.

A file holds whole documents in order and can be read alone. All numbers are little-endian::

    magic  b"PFOR" and version, uint32      block length, number of documents, blocks, exceptions: uint32 each
    number of ids: uint64                   document ids: int64, then one byte each: 1 where the id is given
    ids of each document: uint32            minimum of each block: uint32
    width of each block: uint8              start of each block in the packed bytes: uint64, and their end
    first exception of each block: uint32, and their number
    packed bytes                            exceptions: place in the block, uint16 each, then value less minimum, uint32
    CRC-32 of all bytes before: uint32

A block's ids less its minimum are packed at the width that a percentile of them needs, lowest bit first, each block from
a byte border. Wider ones are packed as 0 and listed as exceptions. Any block can be read through the index of starts.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datagauge.session import scratch_path

from . import words
from .shared import quoted, stored, text_bytes

BLOCK = 256
PERCENTILE = 90
IDS_PER_FILE = 4 << 20
PARTITION_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
_MAGIC = b"PFOR\x01\x00\x00\x00"
_HEAD = struct.Struct("<IIIIQ")
_CHUNK = 1 << 10  # blocks worked on at a time


def _lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each number below 2^32 needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(doc_ids: np.ndarray, given: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """The bytes of a file."""
    n_blocks = -(-len(ids) // block)
    base, width = np.zeros(n_blocks, dtype=np.uint32), np.zeros(n_blocks, dtype=np.uint8)
    packed: list[bytes] = []
    lengths, firsts, places, values = [], [], [], []
    nth = max(0, -(-percentile * block // 100) - 1)
    for a in range(0, n_blocks, _CHUNK):
        part = ids[a * block : (a + _CHUNK) * block].astype(np.uint32)
        m = -(-len(part) // block)
        fill = m * block - len(part)
        part = np.concatenate([part, np.full(fill, part[-1] if len(part) else 0, dtype=np.uint32)]).reshape(m, block)
        low = part.min(axis=1)
        part = part - low[:, None]
        bits = _lengths(part)
        w = np.partition(bits, nth, axis=1)[:, nth]
        over = bits > w[:, None]
        row, at = np.nonzero(over)
        places.append(at.astype("<u2"))
        values.append(part[over].astype("<u4"))
        firsts.append(over.sum(axis=1))
        part = np.where(over, np.uint32(0), part)
        rows: list[bytes] = [b""] * m
        for each in np.unique(w):
            mine = np.flatnonzero(w == each)
            if each:
                raw = part[mine].astype("<u4").view(np.uint8).reshape(len(mine), block, 4)
                flat = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :each].reshape(len(mine), block * int(each))
                done = np.packbits(flat, axis=1, bitorder="little")
                for i, r in zip(mine, done):
                    rows[i] = r.tobytes()
        base[a : a + m], width[a : a + m] = low, w
        lengths.append(np.array([len(r) for r in rows], dtype=np.uint64))
        packed += rows
    start, first = np.zeros(n_blocks + 1, dtype="<u8"), np.zeros(n_blocks + 1, dtype="<u4")
    if n_blocks:
        start[1:], first[1:] = np.cumsum(np.concatenate(lengths)), np.cumsum(np.concatenate(firsts))
    body = b"".join(
        [
            _MAGIC,
            _HEAD.pack(block, len(sizes), n_blocks, int(first[-1]), len(ids)),
            doc_ids.astype("<i8").tobytes(), given.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(),
            base.astype("<u4").tobytes(), width.tobytes(), start.tobytes(), first.tobytes(),
            *packed, *[p.tobytes() for p in places], *[v.tobytes() for v in values],
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(content) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, whether given, ids of each document, all ids) of a file; raises ValueError on a damaged one."""
    view = memoryview(content)
    if len(view) < len(_MAGIC) + _HEAD.size + 4 or bytes(view[: len(_MAGIC)]) != _MAGIC:
        raise ValueError("not a token file of this version")
    if zlib.crc32(view[:-4]) != struct.unpack("<I", view[-4:])[0]:
        raise ValueError("damaged token file")
    block, n_docs, n_blocks, n_over, n_ids = _HEAD.unpack_from(view, len(_MAGIC))
    at = len(_MAGIC) + _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(view, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    doc_ids, given, sizes = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<u4", n_docs)
    base, width, start, first = take("<u4", n_blocks), take("u1", n_blocks), take("<u8", n_blocks + 1), take("<u4", n_blocks + 1)
    data, places, values = take("u1", int(start[-1])), take("<u2", n_over), take("<u4", n_over)
    ids = np.empty((n_blocks, block), dtype=np.uint32)
    for a in range(0, n_blocks, _CHUNK):
        b = min(a + _CHUNK, n_blocks)
        for each in np.unique(width[a:b]):
            mine = a + np.flatnonzero(width[a:b] == each)
            out = np.zeros((len(mine), block, 32), dtype=np.uint8)
            if each:
                size = block * int(each) // 8
                raw = data[start[mine].astype(np.int64)[:, None] + np.arange(size)]
                out[:, :, :each] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(mine), block, int(each))
            ids[mine] = np.packbits(out, axis=2, bitorder="little").view("<u4")[:, :, 0]
    flat = ids.reshape(-1)
    flat[np.repeat(np.arange(n_blocks) * block, np.diff(first.astype(np.int64))) + places] = values
    ids += base[:, None]
    return doc_ids, given, sizes, flat[:n_ids]


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer; a process encodes a word once as long as it remembers it.

    The tokenizer cuts a text into words by itself and encodes them one by one; a space that no other white space
    stands next to always begins a word. So texts may be cut before such spaces. A text with any other space that
    could share a word, or with the content of an added token, which the tokenizer matches before it cuts, goes to the
    tokenizer as it is. Words are known by 128 bits of hash.
    """

    _SHARED = re.compile(r"\s (?:\s|\Z)")
    _LOOSE = re.compile(r"\s\s|\s\Z")
    _MOST = 1 << 20  # words that are remembered
    _JOINED = 1000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core; threads of its own would each keep memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True  # how the vocabulary writes a space
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.places = np.zeros(0, dtype=np.int64)  # of the words, in the order of their keys, among all that were learned
        self.ids, self.ends = [np.zeros(0, dtype=np.uint16)], np.zeros(1, dtype=np.int64)

    def _alone(self, text: str) -> bool:
        return bool(self._SHARED.search(text)) or any(content in text for content in self.added)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each word). Words that begin with a space are encoded many at a time: where the ids of one
        begin is told by the token that has the space."""
        ids, sizes = [], []
        for a in range(0, len(found), self._JOINED):
            part = found[a : a + self._JOINED]
            text = "".join(part)
            if all(w[0] == " " for w in part) and not self._LOOSE.search(text):
                whole = np.array(self._encode([text])[0], dtype=np.int64)
                starts = np.flatnonzero(self.spaced[whole])
                if len(starts) == len(part) and starts[0] == 0:
                    ids.append(whole)
                    sizes.append(np.diff(np.append(starts, len(whole))))
                    continue
            single = self._encode(part)
            ids.append(np.array([i for x in single for i in x], dtype=np.int64))
            sizes.append(np.array([len(x) for x in single], dtype=np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, piece: words.Piece, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        """Adds words, given by their bytes in the piece and sorted by key."""
        found = [piece.buf[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        order = np.array([w[0] != " " for w in found]).argsort(kind="stable")  # words with a space first
        ids, sizes = self._encode_words([found[i] for i in order])
        place = np.empty(len(found), dtype=np.int64)
        place[order] = len(self.ends) - 1 + np.arange(len(found))
        self.ids.append(ids.astype(np.uint16 if len(self.spaced) <= 1 << 16 else np.uint32))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks, self.places = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks), np.insert(self.places, at, place)

    def __call__(self, piece: words.Piece) -> list[np.ndarray]:
        """The ids of every text of a piece."""
        if len(self.keys) > self._MOST:
            self._forget()
        buf, offsets = piece.buf, piece.offsets
        n = len(offsets) - 1
        begins = buf == 0x20
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(buf))
        alone = [d for d in range(n) if self._alone(piece.text(d).decode())]
        out: list = [None] * n
        for d, ids in zip(alone, self._encode([piece.text(d).decode() for d in alone]) if alone else []):
            out[d] = np.array(ids, dtype=np.uint32)
        keys, checks = (words.hash_words(buf, starts, ends, seed) for seed in (0, 1))
        known, first, which = np.unique(keys, return_index=True, return_inverse=True)
        # Two words of one key would be told apart by their checks; then the texts are encoded without the memory.
        unsure = set(np.searchsorted(offsets, starts[checks != checks[first][which]], "right") - 1)
        at = np.searchsorted(self.keys, known)
        have = at < len(self.keys)
        have[have] = self.keys[at[have]] == known[have]
        unsure |= set(np.searchsorted(offsets, starts[np.isin(which, np.flatnonzero(have)[self.checks[at[have]] != checks[first[have]]])], "right") - 1) if have.any() else set()
        new = first[~have]
        if len(new):
            self._learn(piece, starts[new], ends[new], keys[new], checks[new])
        place = self.places[np.searchsorted(self.keys, known)][which] if len(known) else np.zeros(0, dtype=np.int64)
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        sizes = self.ends[place + 1] - self.ends[place]
        done = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[0][np.repeat(self.ends[place] - done[:-1], sizes) + np.arange(int(done[-1]))].astype(np.uint32)
        edges = done[np.searchsorted(starts, offsets)]
        for d in range(n):
            if out[d] is None:
                out[d] = flat[edges[d] : edges[d + 1]] if d not in unsure else np.array(self._encode([piece.text(d).decode()])[0], dtype=np.uint32)
        return out


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of this process, with the words it knows."""
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Writes the ids of all documents, in ascending order of their integer ids, as files below ``path``.

    Returns the manifest: (file, part, nth, n_docs, n_ids, start), start being the ids in all files before. Each text
    (null: empty) is encoded whole, followed by ``end_id``. Null ids come first; rows of equal ids stand in the order of
    a hash of their texts. An empty table gives no file. Files get their names only when complete, and a repeated task
    writes the same files again. ``path`` is a URI that pyarrow can write and Spark can read; ``tokenizer`` is a file
    that every executor has. A task holds one file's ids and the longest text; other columns are ignored.
    """
    key, text = F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("string")
    narrow = docs.select(key.alias("doc_id"), text.alias("text"))
    tasks = max(1, -(-text_bytes(narrow, "text") // PARTITION_BYTES))
    ordered = narrow.repartitionByRange(tasks, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]):
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        store, folder = _store(path)
        held: list[tuple] = []
        size = nth = 0

        def flush():
            nonlocal held, size, nth
            ids = [h[2] for h in held]
            keys = np.array([h[0] or 0 for h in held], dtype=np.int64)
            content = pack(keys, np.array([h[0] is not None for h in held]), np.array([len(x) for x in ids]), np.concatenate(ids))
            name = f"part-{part:06d}-{nth:05d}.tok"
            store.create_dir(folder, recursive=True)
            draft = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                out.write(content)
            store.move(draft, f"{folder}/{name}")
            row = {"file": [name], "part": [part], "nth": [nth], "n_docs": [len(held)], "n_ids": [size]}
            held, size, nth = [], 0, nth + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("nth", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            keys = batch.column(0)
            for piece in words.pieces(batch.column(1), PIECE_BYTES):
                for row, ids in zip(piece.rows, encode(piece)):
                    ids = np.append(ids, np.uint32(end_id))
                    held.append((keys[int(row)].as_py(), None, ids))
                    size += len(ids)
                    if size >= ids_per_file:
                        yield flush()
        if held:
            yield flush()

    manifest = stored(ordered.mapInArrow(write, "file string, part int, nth int, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files that the manifest lists.

    Each file is read whole by one task, straight from the store, one at a time. Null ids come back null, repeated ones
    as often as they were written; of an empty manifest nothing is read. A damaged file is an error."""
    listed = manifest.select("file", "start")
    listed = listed.repartition(max(1, listed.count()), "file")

    def read(batches: Iterator[pa.RecordBatch]):
        store, folder = _store(path)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1)):
                with store.open_input_stream(f"{folder}/{file}") as stream:
                    doc_ids, given, sizes, ids = unpack(stream.read())
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                sums = [zlib.crc32(raw[4 * (e - int(n)) : 4 * e]) for e, n in zip(ends.tolist(), sizes)]
                columns = [pa.array(doc_ids, pa.int64(), mask=~given), pa.array(start.as_py() + ends - sizes, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(sums, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return listed.mapInArrow(read, kind)


def token_files(docs: DataFrame, tokenizer: str, **options) -> tuple[str, DataFrame]:
    """Writes to a new folder in the shared folder; returns it with the manifest."""
    path = scratch_path(docs.sparkSession, "tokens")
    return path, write_tokens(docs, path, tokenizer, **options)
