"""op3, op5, op10 and op1 against the tokenizers library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import edge_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, edit_counts, imatch, token_store
from quarry.llm.queries import op1_imatch, op3_token_files, op5_bpe_round_trip, op10_edit_counts, tokenizer

BYTE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
PIECES = st.sampled_from([*"ab  \n\t'slrevd12.,!é\x1c\x85λß日", "<|endoftext|>", "'ll", " the", "  ", "word", "!!", "###"])
TEXTS = st.lists(PIECES, max_size=60).map("".join)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


CODEC, PLAIN = bpe.BytePairCodec(BYTE), bpe.BytePairCodec(BYTE, special=False)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_bpe_equals_the_library(library, text):
    want = library[BYTE].encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text).tolist() == want
    assert CODEC.decode(want) == library[BYTE].decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_words_equal_the_library(library, text):
    e = token_store.encoder(WORD)
    ids, ends = e.encode_batch(pa.array(["", text, "x"]).slice(1))
    assert ids[: ends[1]].tolist() == library[WORD].encode(text, add_special_tokens=False).ids and len(ends) == 3


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=6), st.sampled_from([1, 40, 1 << 20]))
def test_many_texts_equal_the_library(library, texts, slice_bytes):
    got = [np.frombuffer(x, CODEC.dtype) for x in CODEC.encode_many(pa.array(["x", *texts], pa.string()).slice(1), slice_bytes)]
    assert [x.tolist() for x in got] == [library[BYTE].encode(t, add_special_tokens=False).ids for t in texts]
    assert [CODEC.decimals(x).decode() for x in got] == [",".join(map(str, x)) for x in got]


def test_other_rules_are_left_to_the_library(library):
    assert token_store.encodes_wordwise(WORD) and not token_store.encodes_wordwise(BYTE)
    texts = ["", "Two  words\n", "x" * 50, " lead 12.", "é日本"]
    ids, ends = token_store.WordwiseEncoder(BYTE).encode_batch(pa.array(["skipped", *texts]).slice(1))
    assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:])] == [library[BYTE].encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_without_id_fill_no_file(spark, library, tmp_path):
    rows = [(None, prose(i % 40, 30) if i % 3 else "same text") for i in range(600)] + [(5, prose(99, 30))] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = token_store.write_token_files(df, str(tmp_path / "t"), WORD, 2, text_bytes_per_file=10_000)
    files = manifest.collect()
    assert len(files) > 8 and max(f.n_docs for f in files) < 400
    got = sorted((r.doc_id or -1, r.ids_crc32) for r in token_store.read_token_digests(spark, manifest).collect())
    crc = {t: zlib.crc32(np.array([*library[WORD].encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows}
    assert got == sorted((d or -1, crc[t]) for d, t in rows)


def test_small_caches_change_nothing(library):
    small = bpe.BytePairCodec(BYTE, cache_entries=3)
    words = token_store.WordwiseEncoder(WORD, cache_entries=3)
    texts = [prose(i, 60) for i in range(5)]
    for t in texts:
        assert small.encode(t).tolist() == library[BYTE].encode(t, add_special_tokens=False).ids
        assert words.encode_batch(pa.array([t]))[0].tolist() == library[WORD].encode(t, add_special_tokens=False).ids


def test_long_pretoken_and_broken_bytes(library):
    for text in ("a" * 20_000, "ab" * 9_000):
        assert CODEC.encode(text).tolist() == library[BYTE].encode(text, add_special_tokens=False).ids
    for ids in ([230], [230, 151], [230, 64, 151, 230]):
        assert CODEC.decode(ids) == library[BYTE].decode(ids, skip_special_tokens=False)


def test_op5_whole_table(spark, sf_dir, small_docs, library):
    got = {r.doc_id: r for r in op5_bpe_round_trip(spark, sf_dir).collect()}
    assert len(got) == len(small_docs)
    for d, t in small_docs:
        ids = library[BYTE].encode(t or "", add_special_tokens=False).ids
        r = got[d]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and r.lossless


def test_encode_then_decode(edge_docs):
    back = bpe.decode_documents(bpe.encode_documents(edge_docs, BYTE), BYTE).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t, _, _ in edge_rows())


def expected_tokens(rows, library):
    start, out = 0, []
    for d, t in rows:
        ids = [*library[WORD].encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_op3_whole_table(spark, sf_dir, small_docs, library):
    got = sorted(tuple(r) for r in op3_token_files(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected_tokens(small_docs, library)


def test_op3_edges_and_random_access(spark, edge_docs, empty_docs, library, tmp_path):
    m = token_store.write_token_files(edge_docs, f"file://{tmp_path}/edge", WORD, 2, seq_len=16, batch_rows=4, text_bytes_per_file=4000)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_token_digests(spark, m).collect())
    want = sorted((-1 if d is None else d, n, c) for d, _, n, c in expected_tokens([(d, t) for d, t, _, _ in edge_rows()], library))
    assert got == want
    files = [token_store.TokenFile(r.path) for r in m.orderBy("part").collect()]
    for f, r in zip(files, m.orderBy("part").collect()):
        seen = [f[i] for i in range(len(f))]
        assert sum(int(mask.sum()) for _, mask in seen) == r.n_tokens
        assert all(len(ids) == 16 for ids, _ in seen)
        stream = np.concatenate([*f.stream(), np.empty(0, np.uint16)])
        assert np.array_equal(stream, np.concatenate([*[ids[mask] for ids, mask in seen], np.empty(0, np.uint16)]))
        if len(f):
            base = pa.default_memory_pool().bytes_allocated()
            f[0]
            assert pa.default_memory_pool().bytes_allocated() - base < 4096  # views of the map
    empty = token_store.write_token_files(empty_docs, f"file://{tmp_path}/none", WORD, 2)
    assert token_store.read_token_digests(spark, empty).count() == 0


def test_edits_equal_a_recount():
    r = random.Random(5)
    alphabet = [*"ab  \n\t'slrevd12.,!é\x85λ日", "<|endoftext|>", "'ll", " the", "  "]
    some = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    for _ in range(600):
        text = some(r.choice([0, 5, 40, 900]))
        tree = edit_counts.CountedText(text, PLAIN)
        for _ in range(r.randrange(1, 6)):
            at, gone, new = r.randrange(len(text) + 3), r.choice([0, 0, 1, 4, 60, 5000]), some(r.choice([0, 1, 3, 30, 2000]))
            tree.edit(at, gone, new)
            text = text[:at] + new + text[at + gone :]
            assert tree.text() == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(PLAIN.encode(text)) and tree.n_pretokens == len(PLAIN.pretokens(text))


def test_an_edit_touches_little():
    tree = edit_counts.CountedText(prose(1, 20_000), PLAIN)
    tree.edit(50_000, 3, "new words")
    assert tree.n_reencoded < 12 and tree.updates < 40


def test_op10_whole_table(spark, sf_dir, small_docs):
    got = {r.doc_id: r for r in op10_edit_counts(spark, sf_dir).collect()}
    assert len(got) == len(small_docs)
    for d, t in small_docs:
        text = t or ""
        for at, gone, new in edit_counts.review_edits(text):
            text = text[:at] + new + text[at + gone :]
        r = got[d]
        assert (r.n_tokens, r.n_tokens_edited) == (len(PLAIN.encode(t or "")), len(PLAIN.encode(text)))
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op10_edges(edge_docs, empty_docs):
    got = edit_counts.count_edits(edge_docs, BYTE, edit_counts.review_edits).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(PLAIN.encode(t or "")) for _, t, _, _ in edge_rows())
    assert edit_counts.count_edits(empty_docs, BYTE, edit_counts.review_edits).count() == 0


def brute_fingerprints(rows):
    texts = [t or "" for _, t in rows]
    n, df = len(texts), {}
    for t in texts:
        for w in imatch.terms(t):
            df[w] = df.get(w, 0) + 1
    import math

    band = np.sort(np.array([int(imatch.term_hashes({w})[0]) for w, c in df.items() if math.log(8) - 1e-12 <= math.log(n / c) <= math.log(1e4)], dtype=np.uint64))
    out = []
    for i, (d, _) in enumerate(rows):
        t, nxt = texts[i], texts[(i + 1) % n]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = (imatch.fingerprint(x, band) for x in (t, e, nxt))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), imatch.as_text(a), imatch.as_text(b), imatch.likeness(a, b), imatch.likeness(a, c)))
    return out


def test_op1_whole_table(spark, sf_dir, small_docs):
    got = sorted(tuple(r) for r in op1_imatch(spark, sf_dir).collect())
    assert got == brute_fingerprints(small_docs)
    likely = [r[5] for r in got if r[1] > 500]
    other = [r[6] for r in got if r[1] > 500]
    assert np.mean(likely) > np.mean(other) + 0.05


def test_op1_edges(spark, edge_docs, empty_docs, monkeypatch):
    rows = sorted([(d, t) for d, t, _, _ in edge_rows()], key=lambda r: (imatch.NULL_ID if r[0] is None else r[0], (r[1] or "").encode()))
    want = brute_fingerprints(rows)
    monkeypatch.setattr(imatch.with_successors, "__defaults__", (3000, 64))
    got = [tuple(r) for r in imatch.fingerprint_documents(edge_docs).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert imatch.fingerprint_documents(empty_docs).count() == 0
    by_text = {}
    for (_, t), r in zip(rows, want):
        assert by_text.setdefault(t or "", r[3]) == r[3]
