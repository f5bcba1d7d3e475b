"""An address has its posting id and whether it lies on a platform's own board."""

from __future__ import annotations

from millrace.operators.parts import ORACLES, QUERIES


def test_own_boards(spark, tmp_path):
    urls = ["https://x.org/?gh_jid=7", "https://x.org/a", None, None, None, None, "https://jobs.ashbyhq.com/acme/1", "https://jobs.lever.co.evil.org/acme/1"]
    ids = [0, 1, 2, 3, 4, 5, 6, 12]
    spark.createDataFrame(list(zip(ids, urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.posting_id, r.direct) for r in QUERIES["X19_posting_ids"](spark, str(tmp_path)).collect()}
    assert got == {0: ("7", False), 1: ("1", False), 2: ("2", True), 3: (None, True), 4: (None, False), 5: ("5", False), 6: (None, True), 12: (None, False)}
    assert " as direct" in ORACLES["X19_posting_ids"]
