"""Strict replies, the keyword automaton and dialogue rounds with a model."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kbweave.functions import strictjson as J
from kbweave.operators import dialog as D
from kbweave.operators import entries as EN
from kbweave.operators import lexicon as LX
from kbweave.operators import model as M


@pytest.mark.parametrize("text,status", [
    ('{"title":"a","content":"b","links":[]}', "ok"), ("{'title':'a','content':'b','links':[]}", "bad_json"),
    ('[["title","a"],["content","b"],["links",[]]]', "not_object"), ('{"title":NaN,"content":"b","links":[]}', "bad_json"),
    ('{"title":"a","content":"b","links":[]} x', "bad_json"), ('{"title":"a","content":"b","links":[]}],[{"x":1}', "bad_json"),
    ('{"title":"a","title":"z","content":"b","links":null}', "ok"), ('"title content links"', "not_object"), ("", "bad_json"),
    ('{"title":"a","content":"b"}', "missing_fields"), ("[" * 100_000, "bad_json"), ('{"a":Infinity}', "bad_json"), ("null", "not_object")])
def test_strict_reading(text, status):
    assert J.read(text)[0] == status


def test_entry_fields():
    e = J.entry({"title": 1.5, "content": {"k": "é"}, "links": [{"text": "a", "url": "u"}, 3, {"text": None}]})
    assert e == {"title": "1.5", "content": '{"k":"é"}', "links": [{"text": "a", "url": "u"}, {"text": None, "url": None}, {"text": None, "url": None}]}
    assert J.entry({"title": "\ud800x", "content": None, "links": "no"}) == {"title": "?x", "content": None, "links": None}


def test_parse_and_retry_share_the_parser(spark):
    replies = ["{'title':'a','content':'b','links':[]}", '[["title","a"],["content","b"],["links",[]]]', '```\n{"title":"a","content":"b","links":[]}\n```']
    df = spark.createDataFrame([(r,) for r in [*replies, None]], "reply string")
    assert [r.status for r in EN.parse_replies(df).collect()] == ["bad_json", "not_object", "ok", "bad_json"]

    def model(texts):
        return [replies[int(t)] for t in texts]
    got = M.structure_pages(spark.createDataFrame([("0",), ("1",), ("2",)], "md string").coalesce(1), model, sleep=lambda _: None).collect()
    assert [r.reply for r in got] == [None, None, replies[2]]
    assert [r.reply_error for r in got] == ["ValueError: bad_json", "ValueError: not_object", None]


def test_lexicon_equals_substring_search(spark):
    words = [("b", 2, "farewell"), ("abc", 1, "greeting"), ("bc", 1, "small_talk"), ("a b", 0, "off_topic"), ("b", 3, "greeting"), ("", 0, "greeting"),
             (None, 0, "farewell"), ("天気", 0, "small_talk")]
    texts = ["xx", "b", "abcd", "a b", None, "", "今日の天気", "B", "zbcz"]
    lex = spark.createDataFrame(words, "keyword string, priority int, intent string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    def best(t):
        return min(((p, i) for k, p, i in words if k and t and k in t), default=(None, None))[1]
    for limit in (1 << 20, 40):                                  # one automaton, several
        got = LX.classify_by_lexicon(df, lex, max_bytes=limit).orderBy("id").collect()
        assert [r.cls.intent for r in got] == [best(t) for t in texts]
        assert [r.cls.requires_search for r in got] == [best(t) is None for t in texts]
    assert LX.classify_by_lexicon(df, lex.limit(0)).where("cls.intent is not null").count() == 0


def _make_model():
    def model(prompts):                       # nested: travels to the workers by value
        out = []
        for p in prompts:
            h = hashlib.md5(p.encode()).hexdigest()
            if h[0] in "0123":
                raise ValueError("refused")
            out.append("Re " + h[:10])
        return out
    return model


def _kb(spark):
    from kbweave.operators.kb import kb_rows
    from kbweave.schemas import ENTRY
    return kb_rows(spark.createDataFrame([(1, ("apples and pears", "fruit text", [("apples", "http://a")])), (2, ("blue sky", "weather", []))],
                                         f"page_id long, entry {ENTRY.simpleString()}"), 256)


@pytest.mark.parametrize("per_round", [2, 50])
def test_rounds_equal_the_stream_with_a_model(spark, per_round):
    import uuid

    from kbweave.config import checkpoint_root
    from kbweave.plans.wavefront import generated_dialog_with_model
    from kbweave.streaming.jobs import dialog_stream
    intents = [("greeting", ["hello"])]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ("hello" if (c + t) % 5 == 0 else f"apples {c} {t}")) for c in range(4) for t in range(6 if c else 16)]
    rows += [(9, 0, "user", "apples"), (9, 2, "user", " Exit "), (9, 4, "user", "after"), (10, 0, "assistant", "no user here")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    kb, model = _kb(spark), _make_model()
    got = generated_dialog_with_model(conv, kb, model, intents=intents, turns_per_round=per_round, batch_size=3, sleep=lambda _: None)
    d = f"{checkpoint_root(spark)}/test-model-{uuid.uuid4().hex[:8]}"
    conv.coalesce(1).write.parquet(d)
    stream = spark.read.parquet(dialog_stream(spark, d, kb, intents=intents, model=lambda p: model([p])[0]))
    want = sorted(tuple(r) for r in stream.select("conv_id", "turn", "prompt", F.coalesce("reply", F.lit("-"))).collect())
    assert sorted((r.conv_id, r.turn, r.prompt, r.reply or "-") for r in got.collect()) == want
    assert {r.answer_error for r in got.where("reply is null").collect()} == {"ValueError: refused"}


def test_rounds_of_an_empty_table(spark):
    from kbweave.plans.wavefront import generated_dialog_with_model
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert generated_dialog_with_model(none, _kb(spark), _make_model()).count() == 0


def test_dialog_stream_searches_once(spark, monkeypatch):
    """The columns of the second stage are known without a second search of the whole knowledge base."""
    import uuid

    from kbweave.config import checkpoint_root
    from kbweave.operators import retrieve as R
    from kbweave.streaming.jobs import dialog_stream
    d = f"{checkpoint_root(spark)}/test-once-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([(1, 0, "user", "apples"), (1, 1, "assistant", "yes"), (1, 2, "user", "pears")],
                          "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(d)
    asked, search = [], R.topk_stored
    monkeypatch.setattr(R, "topk_stored", lambda kb, *a, **b: asked.append(kb.isEmpty()) or search(kb, *a, **b))
    assert spark.read.parquet(dialog_stream(spark, d, _kb(spark))).count() == 2
    assert asked.count(False) == 1
