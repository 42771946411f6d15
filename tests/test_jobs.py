"""Job runner: ingest pages into a KB table, then answer conversations."""

import uuid

from kbweave.config import checkpoint_root
from kbweave.operators import entries as EN
from kbweave.operators import extract as X
from kbweave.plans import jobs as J

from conftest import SF_SMALL


def test_ingest_then_answer(spark):
    root = f"{checkpoint_root(spark)}/test-jobs-{uuid.uuid4().hex[:8]}"
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    J.ingest(spark, pages, f"{root}/kb")
    kb = spark.read.parquet(f"{root}/kb")
    n_pages = pages.count()
    assert kb.where("doc_type = 'title'").count() == n_pages
    replies = EN.damaged_replies(X.page_entries(pages))
    status = J.ingest(spark, pages, f"{root}/kb2", replies=replies, out=f"{root}/out")
    assert spark.read.parquet(f"{root}/out/quarantine").count() == n_pages - status["ok"]
    assert spark.read.parquet(f"{root}/out/markdown").count() == n_pages
    assert spark.read.json(f"{root}/out/entries").count() == spark.read.parquet(f"{root}/kb2").where("ord = 0").count()
    assert sum(status.values()) == n_pages and status["ok"] < n_pages
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    J.answer(spark, conv, kb, f"{root}/ans", generating=True)
    out = spark.read.parquet(f"{root}/ans")
    assert out.count() == conv.where("role = 'user'").count()
    assert out.where("reply IS NULL").count() == 0


def test_reingest_appends_duplicates_unless_dedup(spark):
    root = f"{checkpoint_root(spark)}/test-reingest-{uuid.uuid4().hex[:8]}"
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    J.ingest(spark, pages, f"{root}/kb")
    n = spark.read.parquet(f"{root}/kb").count()
    J.ingest(spark, pages, f"{root}/kb")                      # the reference appends again
    assert spark.read.parquet(f"{root}/kb").count() == 2 * n
    J.ingest(spark, pages, f"{root}/kb", dedup=True)          # opt-in: nothing new to add
    assert spark.read.parquet(f"{root}/kb").count() == 2 * n


def test_markdown_files_as_input(spark, tmp_path):
    d = tmp_path / "md"
    d.mkdir()
    (d / "a.md").write_text("intro\n## First [one](http://x/1)\ntext ![pic](i.png) [two](/2)\n# Later", encoding="utf-8")
    (d / "b.md").write_text("only a line é", encoding="utf-8")
    root = f"{checkpoint_root(spark)}/test-md-{uuid.uuid4().hex[:8]}"
    status = J.ingest_markdown(spark, str(d), f"{root}/kb", out=f"{root}/out")
    assert status == {"ok": 2}
    rows = [(r.doc_type, r.text, r.url) for r in spark.read.parquet(f"{root}/kb").orderBy("page_id", "ord").collect()]
    assert ("title", "First one", "") in rows and ("title", "only a line é", "") in rows
    assert ("content", "intro\nFirst one\ntext pic two\nLater", "") in rows
    assert [r for r in rows if r[0] == "link"] == [("link", "one", "http://x/1"), ("link", "two", "/2")]

    def model(texts):
        return ['{"title":"m","content":"c","links":[]}' if "only" in t else "no json" for t in texts]
    status = J.ingest_markdown(spark, str(d), f"{root}/kb2", model=model, sleep=lambda _: None)
    assert status["ok"] == 1 and sum(status.values()) == 2 and status.rejected == {}
