"""Token ids of documents in compressed binary files, written and read as a Spark data source.

`written` sorts documents by id into ranges and writes a file for each; `read` gives the
documents back from the files alone. A file is

    b"QTF1"
    blocks: uint32 bytes of payload, ids, lanes, crc32 of the ids (little-endian uint32s), crc32 of the payload;
            payload: uint32 words of each lane, then the lanes' 16-bit words (see range_coder)
    footer: JSON of the number of documents and ids, the places of blocks, and the documents' packed columns
    uint32 bytes of the footer, uint32 crc32 of it, b"QTF1"

and every number is little-endian. Blocks are coded independently of each other, so a
damaged one is found by its checksum and leaves the others readable. A document may span
blocks. The writer holds one block and the lengths of its file's documents, the reader one
block and one document.

A task writes a file of a name of its own. The list of files and of the ids before each of
them is written last, by the driver, from what the tasks that count have reported: files
of lost or repeated tasks are not on it and so are never read.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.llm.range_coder import decoded, encoded
from quarry.llm.rawtext import pieces_of
from quarry.llm.token_ids import encoder
from quarry.llm.tokens import packed, unpacked

MAGIC, LIST = b"QTF1", "files.json"
BLOCK_IDS = 1 << 20
#: Characters of text that are tokenised at once.
CHARACTERS = 16_000_000
#: Rows and bytes of ids that the reader gives out at once.
ROWS, BYTES = 4_096, 16_000_000
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all machines share, and the folder's path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _text(values: np.ndarray) -> str:
    return base64.b64encode(packed(values)).decode()


def _values(text: str, n: int, kind: type) -> np.ndarray:
    return unpacked(base64.b64decode(text), n, kind)


class _File:
    """A file in the making."""

    def __init__(self, out, vocabulary: int) -> None:
        self.out, self.vocabulary = out, vocabulary
        self.at = out.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.blocks: list[tuple[int, int]] = []  # place, ids
        self.doc_ids: list[np.ndarray] = []
        self.absent: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, doc_ids: pa.ChunkedArray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.doc_ids.append(doc_ids.fill_null(0).to_numpy().astype(np.int64))
        self.absent.append(doc_ids.is_null().to_numpy().astype(np.uint8))
        self.sizes.append(sizes.astype(np.int64))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self._give(False)

    def _give(self, all_of_it: bool) -> None:
        if self.n_waiting < BLOCK_IDS and not all_of_it:
            return
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int32)
        end = len(ids) if all_of_it else len(ids) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, end, BLOCK_IDS):
            self._block(ids[at : at + BLOCK_IDS] if at + BLOCK_IDS <= end else ids[at:end])
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def _block(self, ids: np.ndarray) -> None:
        words, lanes = encoded(ids, self.vocabulary)
        payload = lanes.astype("<u4").tobytes() + words.astype("<u2").tobytes()
        head = struct.pack("<5I", len(payload), len(ids), len(lanes), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload))
        self.blocks.append((self.at, len(ids)))
        self.at += self.out.write(head + payload)
        self.n_ids += len(ids)

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the file."""
        self._give(True)
        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        doc_ids, absent, sizes = joined(self.doc_ids, np.int64), joined(self.absent, np.uint8), joined(self.sizes, np.int64)
        places = np.array(self.blocks, np.int64).reshape(-1, 2)
        columns = {"doc_ids": _text(np.diff(doc_ids, prepend=0)), "absent": _text(absent), "sizes": _text(sizes), "blocks": _text(places.ravel())}
        footer = json.dumps({"documents": len(sizes), "ids": self.n_ids, "n_blocks": len(places), "vocabulary": self.vocabulary} | columns).encode()
        self.out.write(footer + struct.pack("<2I", len(footer), zlib.crc32(footer)) + MAGIC)
        return len(sizes), self.n_ids


def _footer(source, size: int) -> dict:
    source.seek(size - 12)
    length, crc = struct.unpack("<2I", source.read(8))
    if source.read(4) != MAGIC or length > size - 16:
        raise ValueError("not a file of token ids, or one that was cut off")
    source.seek(size - 12 - length)
    footer = source.read(length)
    if zlib.crc32(footer) != crc:
        raise ValueError("the footer doesn't fit its checksum")
    return json.loads(footer)


def _blocks(source, footer: dict) -> Iterator[np.ndarray]:
    """The ids of each block, as little-endian uint32s."""
    for at, n in _values(footer["blocks"], 2 * footer["n_blocks"], np.int64).reshape(-1, 2).tolist():
        source.seek(at)
        length, ids, lanes, crc_ids, crc = struct.unpack("<5I", source.read(20))
        payload = source.read(length)
        if ids != n or zlib.crc32(payload) != crc:
            raise ValueError(f"the block at {at} doesn't fit its checksum")
        sizes, words = np.frombuffer(payload, "<u4", lanes), np.frombuffer(payload, "<u2", offset=4 * lanes)
        out = decoded(words, sizes, n, footer["vocabulary"]).astype("<u4")
        if zlib.crc32(out.tobytes()) != crc_ids:
            raise ValueError(f"the ids of the block at {at} don't fit their checksum")
        yield out


def _documents(source, footer: dict) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, number of ids, ids) of each document, in the file's order."""
    n = footer["documents"]
    doc_ids, sizes = np.cumsum(_values(footer["doc_ids"], n, np.int64)).tolist(), _values(footer["sizes"], n, np.int64).tolist()
    absent = _values(footer["absent"], n, np.uint8).tolist()
    blocks, held, at = _blocks(source, footer), np.zeros(0, "<u4"), 0
    for i, size in enumerate(sizes):
        parts, missing = [], size
        while missing > len(held) - at:
            parts.append(held[at:])
            missing -= len(held) - at
            held, at = next(blocks), 0
        parts.append(held[at : at + missing])
        at += missing
        yield None if absent[i] else doc_ids[i], size, b"".join(p.tobytes() for p in parts)


@dataclass
class _Written(WriterCommitMessage):
    order: int
    name: str
    documents: int
    ids: int


@dataclass
class _Part(InputPartition):
    name: str
    start: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.tokenizer, self.end = options["path"], options["tokenizer"], int(options["end"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        store, folder = _store(self.path)
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.qtf"
        texts = encoder(self.tokenizer, self.end)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            file = _File(out, texts.vocabulary)
            for rows in pieces_of(iterator, CHARACTERS):
                file.add(rows.column("doc_id"), *texts.encode(rows.column("text")))
            return _Written(task.partitionId(), name, *file.close())

    def commit(self, messages: list) -> None:
        """Writes the list of files, in the order of their ranges of ids."""
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.order):
            if m.documents:
                files.append({"name": m.name, "documents": m.documents, "ids": m.ids, "start": start})
                start += m.ids
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{LIST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        """Nothing is on the list, so nothing will be read; files that were finished are removed."""
        store, folder = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list:
        store, folder = _store(self.path)
        with store.open_input_stream(f"{folder}/{LIST}") as source:
            return [_Part(f["name"], f["start"]) for f in json.loads(source.read())] or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, folder = _store(self.path)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "start", "n_tokens", "ids"])
        with store.open_input_file(f"{folder}/{partition.name}") as source:
            rows, size, start = [], 0, partition.start
            for doc_id, n, ids in _documents(source, _footer(source, source.size())):
                rows.append((doc_id, start, n, ids))
                start += n
                size += len(ids)
                if len(rows) >= ROWS or size >= BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


class TokenFiles(DataSource):
    """`spark.read.format("token_files").load(folder)`, and append of (doc_id, text) to a new folder."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def written(docs: DataFrame, folder: str, tokenizer: str, end: int, files: int | None = None) -> str:
    """Writes the whole texts of `docs` (doc_id, text) to a new folder that all machines share; returns the folder.

    Documents stand in the order of doc_id (null ids first; rows of equal ids in that of a
    hash of their texts), each with the id `end` behind it. A null or empty text is that id
    alone; repeated rows are written each; an empty table gives a list of no files; of
    `docs` no other columns are read. `tokenizer` is the path of a file of the tokenizers
    library that every machine has. There are as many files as shuffle partitions unless
    `files` is given.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.write.format("token_files").mode("append").option("tokenizer", tokenizer).option("end", str(end)).save(folder)
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a folder: start counts the ids of all documents before it,
    ids are little-endian 32-bit integers. A damaged file or block is an error."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(folder)
