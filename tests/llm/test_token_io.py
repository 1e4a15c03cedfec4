import zlib

import numpy as np
import pyarrow as pa
import pytest

from eluent.llm import common, token_io

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")

ROWS = [(5, "Hello, World! it's 42% fine."), (3, None), (9, ""), (7, "a., b.. <|endoftext|>. é, É. 日本。 ﬁ ok.'s ,. \x85 İ é"), (None, "null id"), (3, "again"), (1, "word " * 5000)]


def expected(rows):
    t, out, at = tokenizers.Tokenizer.from_file(PATH), [], 0
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_round_trip(docs_of):
    got = [tuple(r) for r in token_io.encode(docs_of(ROWS), PATH, length=16, rows=4, file_bytes=256).orderBy("start").collect()]
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0]))
    assert got in (expected(order), expected([*order[:2], order[3], order[2], *order[4:]]))  # equal ids in either order


def test_random_access(spark, docs_of):
    path = common.fresh_path(spark, "tokens")
    files = token_io.write(docs_of(ROWS), path, PATH, length=16, rows=4).collect()
    assert sum(f["docs"] for f in files) == len(ROWS)
    content = [r[0] for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    ids = 0
    for c in map(bytes, content):
        t = token_io.read_sequences(c)
        assert t.schema.field("ids").type == pa.list_(pa.uint16(), 16)
        batch = pa.ipc.open_file(pa.py_buffer(c)).get_batch(0)
        base = batch.column("ids").flatten().to_numpy(zero_copy_only=True)  # no copy
        assert len(base) % 16 == 0
        ids += sum(t.column("mask").combine_chunks().flatten().to_pylist())
    assert ids == sum(f["ids"] for f in files)


def test_empty(docs_of):
    assert token_io.encode(docs_of([]), PATH).count() == 0


def test_words_are_the_text():
    k = token_io.WordIds(PATH)
    for _, text in ROWS:
        words = (text or "").encode().lower().split()
        k.learn(set(words))
        assert np.frombuffer(k.ids(words), "<u4").tolist() == k.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_tokenizers_that_are_not_word_by_word(docs_of):
    path = public.path("byte_bpe_50k.json")
    assert token_io.WordIds(PATH).by_word and not token_io.WordIds(path).by_word
    t = tokenizers.Tokenizer.from_file(path)
    rows = [(1, "Hello,  World\n HELLO"), (2, None), (3, "  two  blanks")]
    got = [tuple(r)[:1] + tuple(r)[2:] for r in token_io.encode(docs_of(rows), path, length=16, rows=4).orderBy("doc_id").collect()]
    assert got == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ((i, [*t.encode(text or "", add_special_tokens=False).ids, 2]) for i, text in rows)]


def test_long_text_and_files_left_by_a_lost_attempt(spark, docs_of):
    import time

    rows = [(1, "Some words, 12,345 and more. " * 36_000), (2, "x" * 1_000_000), (3, "a b")]
    path = common.fresh_path(spark, "tokens")
    began = time.time()
    first = token_io.write(docs_of(rows), path, PATH).collect()
    assert time.time() - began < 30
    again = token_io.write(docs_of(rows), path, PATH).collect()  # a second attempt finds the files of the first
    assert sorted(first) == sorted(again)
    got = sorted(tuple(r) for r in token_io.read_documents(spark, path).collect())
    t = tokenizers.Tokenizer.from_file(PATH)
    assert [(g[0], g[2]) for g in got] == [(i, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x in rows]
