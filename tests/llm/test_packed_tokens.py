"""Packed token files against the tokenizers library, and read back."""

import zlib

import numpy as np
import public_tokenizers as tokenizers_files
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kbweave.llm.packed_tokens import Encoder, PackedFile, _Writer, bits_of, pack, read_documents, read_index, unpack, write_tokens
from kbweave.sources.tables import load_table

PATH = tokenizers_files.path("byte_bpe_50k.json")
WORDS = tokenizers_files.path("word_bpe_49k.json")


def brute(rows, path=PATH, end=2):
    t = Tokenizer.from_file(path)
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_packing():
    assert [bits_of(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
    rng = np.random.default_rng(1)
    for bits in (1, 3, 7, 8, 15, 16, 17, 31, 32):
        for n in (0, 1, 9, 1000):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
            data = pack(ids, bits)
            assert len(data) == -(-n * bits // 8) and (unpack(data, n, bits) == ids).all()
    with pytest.raises(ValueError):
        pack(np.array([8], np.uint32), 3)


def test_random_access():
    rng = np.random.default_rng(2)
    w = _Writer(5, 11, 64)
    sizes = [1, 200, 1, 63, 64, 65, 700]
    ids = rng.integers(0, 2048, sum(sizes)).astype(np.uint32)
    lines = [*w.add(pa.array([1, 2, None, 4], pa.int64()), np.array(sizes[:4]), ids[:sum(sizes[:4])]),
             *w.add(pa.array([5, 6, 7], pa.int64()), np.array(sizes[4:]), ids[sum(sizes[:4]):]), *w.end()]
    f = PackedFile(b"".join(x + b"\n" for x in lines))
    assert f.number == 5 and f.n_ids == ids.size and f.null.tolist() == [False, False, True, False, False, False, False]
    at = 0
    for i, n in enumerate(sizes):
        assert (f.document(i) == ids[at:at + n]).all()
        at += n
    for _ in range(50):
        lo, hi = sorted(rng.integers(0, ids.size + 1, 2).tolist())
        assert (f.ids(lo, hi - lo) == ids[lo:hi]).all()
    with pytest.raises(IndexError):
        f.ids(ids.size, 1)
    with pytest.raises(ValueError):
        PackedFile(b"x" * 100)


HARD = ["", None, " ", "a", " a", "a ", "a  b", "a   b c", "it's we'll 'tis", "x\n y \n\n z", "tab\t a", "é la é", "a b", "a  b",
        "世界 a b", "a <|endoftext|> b", "a<|endoftext|> b", "a  <|endoftext|>  b", "1 2 3a 4!5 ?? . .", "a b" * 50, "\x00 a \x1c b \x85 c",
        "naïve café d'été l 'x y", "end. ", " . a"]


def test_pieces_give_the_ids_of_whole_texts():
    t = Tokenizer.from_file(PATH)
    e = Encoder(open(PATH, "rb").read(), 2)
    assert e.by_piece and not Encoder(open(WORDS, "rb").read(), 2).by_piece
    rng = np.random.default_rng(4)
    bits = ["a", " ", "  ", "\n", "'s", "é", ".", "7", "<|endoftext|>", "the", "\t", " ", "Zq", ",", "!?", ";x", "'", "ß", "×", "÷,", "ж", "\xa0", "\u3000", "世", "\u0345", "\u2028"]
    texts = HARD + ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(2000)]
    e.encode(pa.array(texts[::7]))                # what is known already gives the same ids
    ids, sizes = e.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, sizes):
        assert ids[at:at + n].tolist() == t.encode(text or "", add_special_tokens=False).ids + [2], text
        at += n
    assert at == ids.size


@pytest.mark.parametrize("path", [PATH, WORDS])
def test_files(spark, tmp_path, path):
    rows = [(i * 3 - 20, x) for i, x in enumerate(HARD)] + [(None, "no id"), (1000, "word " * 30_000), (7000, "z")]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, value binary").repartition(4)
    write_tokens(df, str(tmp_path / "a"), path, 2, file_bytes=200, block=50)
    got = read_index(spark, str(tmp_path / "a")).orderBy("file", "place").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == brute(rows, path)
    assert len({r["file"] for r in got}) > 3
    t = Tokenizer.from_file(path)
    some = {r["doc_id"]: r["ids"] for r in read_documents(spark, str(tmp_path / "a"), [1000, 7000, -20, 5]).collect()}
    assert some == {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in rows if i in (1000, 7000, -20)}
    assert read_documents(spark, str(tmp_path / "a")).count() == len(rows)


def test_repeated_rows_and_empty(spark, tmp_path):
    rows = [(1, "same text")] * 300 + [(1, "other"), (0, "first")]
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "r"), PATH, 2, file_bytes=300)
    got = read_index(spark, str(tmp_path / "r")).orderBy("file", "place").collect()
    assert len(got) == 302 and got[0]["doc_id"] == 0 and len({r["file"] for r in got}) > 3
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), PATH, 2)
    assert read_index(spark, str(tmp_path / "e")).count() == 0


def test_table(spark, tmp_path):
    docs = load_table(spark, "/root/testdata/sf0.001", "documents", ["doc_id", "text"])
    write_tokens(docs, str(tmp_path / "t"), PATH, 2, file_bytes=1 << 17)
    got = read_index(spark, str(tmp_path / "t")).orderBy("file", "place").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == brute([tuple(r) for r in docs.collect()])


def test_bounded_memory_of_stretches(monkeypatch):
    from kbweave.llm import packed_tokens as K
    monkeypatch.setattr(K, "KNOWN", 40)
    t, e = Tokenizer.from_file(PATH), Encoder(open(PATH, "rb").read(), 2)
    for i in range(30):
        text = " ".join(f"w{i}x{j}" for j in range(i * 2)) + " " + "long" * 40
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids + [2] and len(e.known) <= 40
