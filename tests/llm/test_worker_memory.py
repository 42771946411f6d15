"""What the pipeline's Python workers keep between tasks and hold at once."""

import numpy as np
import pyarrow as pa

from kbweave.llm import linedup, sentencepiece_codec, simhash, textvec
from kbweave.llm.queries import MODEL


def test_hash_powers_follow_the_largest_slice_and_are_let_go():
    textvec.let_go()
    for n in (300_000, 530_000):
        buf = np.arange(n, dtype=np.int64).astype(np.uint8)
        textvec.Prefix(buf)
        assert n < len(textvec._pow) <= n + (1 << 18)
    one, at = textvec.Prefix(buf), (np.array([5]), np.array([77]))
    kept = one(*at)
    textvec.let_go()
    assert len(textvec._pow) == len(textvec._inv) == 1
    assert textvec.Prefix(buf)(*at) == kept == textvec.Prefix(buf[256:])(*at)


def test_fingerprints_of_many_short_slices(spark):
    texts = [f"one two three four {i % 7}" for i in range(1000)] + [None, ""]
    want = [simhash.fingerprint_bytes((t or "").encode(), 4) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_the_reference_library_keeps_to_the_threads_given():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(MODEL), 1)
    asked, own = [], codec.reference

    class Counted:
        def encode(self, texts, **options):
            asked.append(options.get("num_threads"))
            return own.encode(texts, **options)
    codec.reference = Counted()
    ids, sizes, *_ = codec.encode_column(pa.array(["a word or two", None, "grüße 東京"]))
    assert asked == [1] and sizes.tolist()[1] == 0 and len(ids) == sizes.sum()


def test_line_dedup_of_many_short_slices(spark):
    """More rows than a step takes at once, in one batch: every text keeps its place, nulls and empty texts too."""
    line = "this line of more than fifty characters stands in many of the texts"
    texts = [None if i % 97 == 5 else "" if i % 89 == 7 else f"{line}\nown words of text {i}" for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["text"] for r in linedup.drop_repeated_lines(docs).collect()}
    assert got == {i: t if i == 0 or not t else f"own words of text {i}" for i, t in enumerate(texts)}
