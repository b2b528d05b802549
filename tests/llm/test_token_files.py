"""Token files: an exact round trip, and the same ids as the library gives for whole texts."""

import glob
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import token_files as tf
from tracewell.llm.words import byte_slices
from tracewell.session import work_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = tf.Encoder(PATH, tf.END)
SCHEMA = "doc_id long, text string"


def plain(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, tf.END]


def encoded(encoder, texts):
    out = []
    for s in byte_slices(pa.array(texts, pa.string())):
        ids, at = encoder.ids(s.data, s.offsets)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


@settings(max_examples=600, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.none(),
            st.text(alphabet=st.sampled_from(list(" \n\t  　\x1c\x85ab'sté漢😀.1<|>")), max_size=40),
            st.text(alphabet=st.sampled_from(list(" \n'a1.é")), max_size=15),
            st.text(max_size=20),
            st.lists(st.sampled_from(["it's", " <|endoftext|>", "<|endoftext|> a", " ", "  ", "end. ", " 'll", "été à", "ß ", "<|end", "we'll", "1'2", ".'a", "\r\n"])).map("".join),
        ),
        min_size=1,
        max_size=6,
    )
)
def test_pieces_give_what_whole_texts_give(texts):
    assert encoded(ENCODER, texts) == [plain(t) for t in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 50)
    r, encoder = random.Random(1), tf.Encoder(PATH, tf.END)
    for _ in range(20):
        texts = [" ".join("".join(r.choices("abcde", k=r.choice([3, 100]))) for _ in range(20)) for _ in range(3)]
        assert encoded(encoder, texts) == [plain(t) for t in texts]
        assert len(encoder.known) <= 50 and max(map(len, encoder.known), default=0) <= tf.LONGEST
        assert len(encoder.flat) == encoder.starts[-1] and len(encoder.starts) == len(encoder.known) + 1


def test_tasks_of_a_worker_share_an_encoder():
    tf._encoder.cache_clear()
    first = tf._encoder(PATH, tf.END, False)
    assert encoded(first, ["shared words"]) == encoded(first, ["shared words"]) == [plain("shared words")]
    assert tf._encoder(PATH, tf.END, False) is first and tf._encoder(PATH, tf.END, True) is not first


def test_known_pieces_cost_little():
    words = np.random.default_rng(3).integers(10**5, 10**8, 40_000).astype(str).tolist()
    text, encoder = pa.array([" ".join(words)]), tf.Encoder(PATH, tf.END)
    (s,) = byte_slices(text)
    pieces = pa.array([w.encode() for w in words], pa.large_binary())
    ids, _ = encoder.ids(s.data, s.offsets)

    def least(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    again = least(lambda: encoder.ids(s.data, s.offsets))
    assert ids.tolist() == plain(text[0].as_py())
    assert again < least(pieces.to_pylist)


def corpus():
    r = random.Random(2)
    words = "the of and token é naïve don't 2024 {x}".split()
    rows = [(i * 37 % 1013, " ".join(r.choices(words, k=r.randrange(1, 80)))) for i in range(400)]
    rows += [(-5, "minus"), (None, "no id"), (None, None), (2000, None), (2001, ""), (2002, " \n "), (2002, "other text")]
    return rows + [(2003, "same row")] * 2 + [(3000, "long " * 200_000), (3001, "x" * 30_000)]


def expected(rows):
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    return [(i, plain(t)) for i, t in order]


@pytest.fixture(scope="module", params=["dictionary", "delta"])
def written(spark, request):
    rows, path = corpus(), work_path(spark, "token-test")
    clash = {x: F.lit("x") for x in ("part", "first", "ids", "n_tokens", "packed", "start")}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns(clash)
    tf.write_tokens(docs, path, PATH, encoding=request.param)
    return request.param, rows, path


def test_round_trip(spark, written):
    _, rows, path = written
    got = sorted(tf.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in expected(rows)]
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in got))) == sorted(map(repr, expected(rows)))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    crc = {r.start: (r.n_tokens, r.ids_crc32) for r in tf.ids_crc32(tf.read_documents(spark, path)).collect()}
    assert crc == {r.start: (len(r.ids), zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))) for r in got}


def test_windows_of_the_whole_stream(spark, written):
    _, rows, path = written
    stream = np.array([x for r in sorted(tf.read_documents(spark, path).collect(), key=lambda r: r.start) for x in r.ids])
    for a, b in [(0, 10), (5000, 9000), (len(stream) - 3, len(stream) + 50), (len(stream), len(stream) + 1), (7, 7)]:
        found = sorted(tf.read_window(spark, path, a, b).collect(), key=lambda r: r.position)
        assert [x for r in found for x in r.ids] == stream[a:b].tolist()
        assert all(stream[r.position : r.position + len(r.ids)].tolist() == r.ids for r in found)


def test_encodings_row_groups_and_indexes(spark, written):
    encoding, _, path = written
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).total_byte_size <= 2 * tf.ROW_GROUP_BYTES
            columns = {c.path_in_schema: c for c in map(meta.row_group(g).column, range(meta.num_columns))}
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert columns["first"].encodings == ("DELTA_BINARY_PACKED",)
            ids = columns["ids.list.element"].encodings
            assert "RLE_DICTIONARY" in ids if encoding == "dictionary" else ids == ("DELTA_BINARY_PACKED",)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_selective_reads(spark, written):
    _, _, path = written
    counts = plan(tf.read_counts(spark, path))
    assert "n_tokens" in counts and "ids" not in counts
    some = tf.read_documents(spark, path).where("doc_id between 100 and 110")
    assert "GreaterThanOrEqual(doc_id,100)" in plan(some)
    assert {r.doc_id for r in some.collect()} == {r for r, _ in corpus() if r is not None and 100 <= r <= 110}


def test_empty_table(spark):
    path = work_path(spark, "token-test")
    tf.write_tokens(spark.createDataFrame([], SCHEMA), path, PATH)
    assert tf.ids_crc32(tf.read_documents(spark, path)).collect() == []
    assert tf.read_window(spark, path, 0, 10).collect() == []


def test_whole_texts_for_other_tokenizers(spark):
    path, other = work_path(spark, "token-test"), public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "Some  words here"), (2, "MORE of them\n"), (3, None)]
    tf.write_tokens(spark.createDataFrame(rows, SCHEMA), path, other, whole=True)
    t = Tokenizer.from_file(other)
    got = {r.doc_id: r.ids for r in tf.read_documents(spark, path).collect()}
    assert got == {i: [*t.encode(x or "", add_special_tokens=False).ids, tf.END] for i, x in rows}


def test_query_on_given_documents(spark, sf):
    from tracewell.llm.queries import op13_token_files

    rows = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    at, want = 0, []
    for doc_id, text in rows:
        ids = plain(text)
        want.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, op13_token_files(spark, sf).collect())) == want


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.given += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_pieces_go_to_the_library_joined():
    encoder = tf.Encoder(PATH, tf.END)
    encoder.tokenizer = Counting(encoder.tokenizer)
    texts = [" ".join(f"w{zlib.crc32(b'%d' % (100 * k + i)):x}" for i in range(100)) for k in range(20)]
    assert encoded(encoder, texts) == [plain(t) for t in texts]
    assert encoder.tokenizer.given <= 100  # of some thousand pieces
    texts += [texts[0] + "<|endoftext|>" + texts[1], "a<|endoftext|>", "<|endoftext|>" * 3]
    assert encoded(encoder, texts) == [plain(t) for t in texts]


def test_pieces_that_come_again_stay_known(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 60)
    encoder, kept = tf.Encoder(PATH, tf.END), 0
    for k in range(12):
        text = " often seen words " + " ".join(f"x{chr(97 + k)}{chr(97 + i)}" for i in range(20))
        assert encoded(encoder, [text]) == [plain(text)]
        kept += k > 0 and b" often" in encoder.known
    assert kept == 11 and len(encoder.known) <= 60
