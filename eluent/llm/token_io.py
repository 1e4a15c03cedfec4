"""Token-ID output: Arrow IPC files of fixed-size-list batches.

A file holds equal-length sequences, ``rows`` of them in each record batch, so that sequence ``k`` is row ``k % rows`` of batch
``k // rows`` and its ids and mask can be used where they lie in a memory map. Documents follow each other without gaps; the
last sequence of a file is padded. Columns:

- ``ids``: fixed-size list of uint16 (uint32 for vocabularies over 65,536)
- ``mask``: fixed-size list of bool, false where padded
- ``end``: fixed-size list of bool, true at the last id of a document
- ``doc_id``: list of the documents that end in the sequence

Executors write files to the shared folder under a name of their attempt and then rename them, so that a second attempt
leaves the same files. They are read by Spark's ``binaryFile`` source.

Tokenizers whose ids of a text are those of its lower-cased words in turn are applied word by word, each word once; whether a tokenizer is of
that kind is tried on ``PROBES`` when it is loaded, and all others are given whole texts.

Null texts are empty: such a document holds the end id alone. Documents with a null id come first, those of one id in order of a hash of their texts; repeated rows are kept, each with
its own place. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Ids in a sequence, sequences in a record batch, bytes of ids after which a task begins another file.
LENGTH, ROWS, FILE_BYTES = 2048, 256, 32 << 20
END_ID = 2


#: Texts that tell apart tokenizers which keep case, white space, or what a word's neighbours are.
PROBES = (
    "Hello, World. HELLO world", "a  b\tc\n\nd \x0b e", " leading and trailing ", "don't it's WE'LL 3.14 12,345", "Caf\u00e9 \u00c9COLE na\u00efve \u00dcber stra\u00dfe", "x.y,z end. a,b ..", "\u0130stanbul \u65e5\u672c\u8a9e \U0001f600\U0001f600",
    "<|endoftext|> <|startoftext|>a", "http://a.b/c?d=e&f #tag @name __init__", "\u00a0nbsp\u00a0 \u2003em", "e\u0301 combining \u212b", "AAAA bbbb 0000 ----",
)


def _byte_characters() -> dict[int, str]:
    """What a byte-level vocabulary writes each byte as: visible Latin-1 as itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip([*shown, *(x for x in range(256) if x not in shown)], map(chr, [*shown, *range(256, 512)]), strict=False))


class WordIds(dict):
    """Ids of a white-space separated, ASCII-lower-cased word, as little-endian uint32.

    For tokenizers that lower-case and drop white space, so that the ids of a text are those of its words in turn; a full stop or
    comma after a letter is a word of its own there. Words of Latin-1 letters are one piece before the merges, and go straight to the merges.
    Others are encoded whole, many at a time. Bounded: two generations of words are kept.
    """

    LIMIT, TOGETHER = 250_000, 1_000
    LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[bytes, bytes] = {}
        self.characters = _byte_characters()
        self.by_word = True
        self.ends = {x: np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in (".", ",", "")}

        self.by_word = all(self.of_texts([x.encode()]) == self.whole([x.encode()]) for x in PROBES)

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, given whole to the tokenizer."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([x.decode() for x in texts], add_special_tokens=False)]

    def of_texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_word:
            return self.whole(texts)
        words = [x.lower().split() for x in texts]
        self.learn(set().union(*words))
        return list(map(self.ids, words))

    def __missing__(self, word: bytes) -> bytes:
        self.learn({word})
        return self[word]

    def learn(self, words: set[bytes]) -> None:
        """Makes sure that all of ``words`` are known."""
        new = words - self.keys()
        if len(self) + len(new) > self.LIMIT:
            self.older = dict(self)
            self.clear()
            new = words
        older, ends, letters, merge, rest = self.older, self.ends, self.LETTERS.fullmatch, self.tokenizer.model.tokenize, []
        for w in new:
            ids = older.get(w)
            if ids is None:
                text = w.decode()
                stem, end = (text[:-1], text[-1]) if text[-1] in ".," else (text, "")
                if not letters(stem):
                    rest.append(w)
                    continue
                if not stem.isascii():
                    stem = "".join(map(self.characters.__getitem__, stem.lower().encode()))
                ids = array("I", [t.id for t in merge(stem)]).tobytes() + ends[end]
            self[w] = ids
        for i in range(0, len(rest), self.TOGETHER):
            self._encode(rest[i : i + self.TOGETHER])

    def _encode(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        place = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
        ids, cuts = np.array(e.ids, "<u4"), np.searchsorted(place, begins).tolist()
        for w, a, b in zip(words, cuts, cuts[1:], strict=False):
            self[w] = ids[a:b].tobytes()

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, words))


@cache
def known_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def schema(width: int, length: int) -> pa.Schema:
    kind = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("end", pa.list_(pa.bool_(), length)), ("doc_id", pa.list_(pa.int64()))])


class _File:
    """One output file: gathers documents, writes a record batch whenever one is full."""

    def __init__(self, sink, width: int, length: int, rows: int):
        self.length, self.rows, self.kind = length, rows, np.dtype(f"<u{width}")
        self.schema = schema(width, length)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.ids, self.ends, self.docs, self.held, self.written = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        self.ends.append(self.held - 1)
        self.docs.append(doc_id)
        self.written += len(ids) * self.kind.itemsize
        while self.held >= self.rows * self.length:
            self._write(self.rows * self.length, self.rows * self.length)

    def _write(self, n: int, padded: int) -> None:
        flat = np.concatenate(self.ids)
        ids, end = np.zeros(padded, self.kind), np.zeros(padded, bool)
        ids[:n] = flat[:n]
        done = int(np.searchsorted(self.ends, n))
        end[self.ends[:done]] = True
        per = np.bincount(np.array(self.ends[:done], np.int64) // self.length, minlength=padded // self.length)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(self.docs[:done], pa.int64()))
        wrap = lambda x, f: pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(f).type)
        self.writer.write_batch(pa.record_batch([wrap(ids, "ids"), wrap(np.arange(padded) < n, "mask"), wrap(end, "end"), lists], schema=self.schema))
        self.ids, self.held = ([flat[n:]] if len(flat) > n else []), len(flat) - n
        self.ends, self.docs = [e - n for e in self.ends[done:]], self.docs[done:]

    def close(self) -> None:
        if self.held:
            self._write(self.held, -(-self.held // self.length) * self.length)
        self.writer.close()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes them to ``path`` in ascending doc_id order. Returns a row for each file: file, docs, ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        known = known_ids(tokenizer)
        width = 2 if known.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        fs, top = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        fs.create_dir(top, recursive=True)
        done, out, sink, temp, n_docs, n_ids = [], None, None, "", 0, 0

        def finish() -> None:
            out.close()
            sink.close()
            name = f"part-{part:06d}-{len(done):05d}.arrow"
            there = lambda: fs.get_file_info(f"{top}/{name}").type != pyarrow.fs.FileType.NotFound
            try:
                if there():  # left whole by an attempt that was lost later: the same rows in the same order
                    fs.delete_file(temp)
                else:
                    fs.move(temp, f"{top}/{name}")
            except OSError:
                if not there():
                    raise
            done.append((name, n_docs, n_ids))

        for b in common.batches(it, 500):
            for doc_id, found in zip(b.column(0).to_pylist(), known.of_texts(common.text_bytes(b.column(1))), strict=True):
                if out is None:
                    temp = f"{top}/_writing-{part:06d}-{len(done):05d}-{attempt}"
                    sink = fs.open_output_stream(temp)
                    out, n_docs, n_ids = _File(sink, width, length, rows), 0, 0
                ids = np.append(np.frombuffer(found, "<u4"), np.uint32(end_id)).astype(out.kind)
                out.add(doc_id, ids)
                n_docs, n_ids = n_docs + 1, n_ids + len(ids)
                if out.written >= file_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "docs", "ids"), map(list, zip(*done, strict=True)), strict=True)))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, "file string, docs long, ids long")


def read_sequences(content: bytes) -> pa.Table:
    """The sequences of one file, as views of ``content``."""
    return pa.ipc.open_file(pa.py_buffer(content)).read_all()


def _documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for file, content in zip(b.column(0), b.column(1), strict=True):
            reader = pa.ipc.open_file(content.as_buffer())
            held, before, at = b"", 0, 0  # ids of a document that goes on in the next batch
            for i in range(reader.num_record_batches):
                x = reader.get_batch(i)
                flat = lambda c: x.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                n = int(flat("mask").sum())
                ids, ends = flat("ids")[:n].astype("<u4"), np.flatnonzero(flat("end")[:n]) + 1
                out: dict[str, list] = {"doc_id": x.column("doc_id").flatten().to_pylist(), "seq": [], "local_start": [], "n_tokens": [], "ids_crc32": []}
                a = 0
                for e in ends.tolist():
                    size = len(held) // 4 + e - a
                    out["ids_crc32"].append(zlib.crc32(ids[a:e].tobytes(), zlib.crc32(held)))
                    out["seq"].append(at)
                    out["local_start"].append(before)
                    out["n_tokens"].append(size)
                    held, a, before, at = b"", e, before + size, at + 1
                held += ids[a:].tobytes()
                yield pa.RecordBatch.from_pydict({"file": pa.array([file.as_py().rsplit("/", 1)[-1]] * len(ends), pa.string()), **{k: pa.array(v, pa.int64()) for k, v in out.items()}})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document in the files at ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.arrow").load(path).select("path", "content")
    docs = files.mapInArrow(_documents, "file string, doc_id long, seq long, local_start long, n_tokens long, ids_crc32 long")
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("ids"))  # a row for each file of 32 MB
    offset = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return docs.join(totals.select("file", offset.alias("before")), "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def encode(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes ``docs`` to a new place in the shared folder and returns what its files hold."""
    spark = docs.sparkSession
    path = common.fresh_path(spark, "tokens")
    if write(docs, path, tokenizer, **options).agg(F.count("*")).first()[0] == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_documents(spark, path)
