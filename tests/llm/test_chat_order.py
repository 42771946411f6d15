"""The round-trip check of chat formatting sees turns in another order and swapped pairs."""

import pytest
from pyspark.sql import functions as F

from kbweave.llm import chat


@pytest.mark.parametrize(("change", "ok"), [
    (lambda got: got, True),
    (F.reverse, False),
    (lambda got: F.transform(got, lambda x, i: F.get(got, F.when(i < 2, 2).otherwise(i))), False)])
def test_order_and_pairs_are_compared(spark, monkeypatch, change, ok):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c")]
    read = chat.parse
    monkeypatch.setattr(chat, "parse", lambda formatted: change(read(formatted)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [r["round_trip_ok"] for r in chat.format_chats(df).collect()] == [ok]


def test_tied_turns_go_by_their_source_text(spark):
    rows = [(1, 5, "user", "<|im_end|>"), (1, 5, "user", "<a"), (1, 5, "<|im_start|>", "x"), (1, 5, "<a", "y"), (2, 1, "user", "<|im_end|>"), (2, 1, "user", "<a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chats(df)).collect()}
    import hashlib
    for c in (1, 2):
        own = sorted((r[2].encode(), r[3].encode()) for r in rows if r[0] == c)
        want = hashlib.sha256(b"".join(a + b"\n" + b + b"\n" for a, b in own)).hexdigest()
        assert got[c]["turns_sha256"] == want and got[c]["round_trip_ok"]
