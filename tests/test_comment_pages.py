"""Comments in pages: the same text as the whole comment, no row larger than a page."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import merge
from tests.test_respond_merge import findings_df


@pytest.fixture(scope="module")
def reviewed(spark):
    rnd = random.Random(5)
    sizes = {"hot": 400, "one": 1, "few": 7}
    rows = [
        (rid, rnd.choice(["security", "style"]), f"FINDING#x#{i}", rnd.choice(["critical", "warning", "info", "urgent"]),
         "naming", f"f{i}.py", i, rnd.choice(["é", "x", "語"]) * rnd.randint(0, 300), "Do it")
        for rid, n in sizes.items() for i in range(n)
    ]
    rows.append(("elsewhere", "style", "FINDING#x#0", "info", "naming", "z.py", 1, "not asked for", ""))
    rows.append(("few", "style", "FINDING#x#99", "info", "naming", "z.py", 1, None, "no message, no text"))
    reviews = spark.createDataFrame([(r,) for r in [*sizes, "clean"]], "review_id string")
    ranked = merge.rendered_findings(merge.rank_findings(findings_df(spark, rows)))
    verdicts = merge.verdicts(reviews, ranked)
    return verdicts, ranked, {r.review_id: r.comment for r in merge.review_comments(verdicts, ranked).collect()}


@pytest.mark.parametrize("size", [4, 100, 1000, 60_000])
def test_pages_joined_are_the_comment(spark, reviewed, size):
    verdicts, ranked, whole = reviewed
    if size == 4:  # a code point a page
        verdicts = verdicts.where("review_id in ('one', 'clean')")
        whole = {k: whole[k] for k in ("one", "clean")}
    pages = merge.comment_pages(verdicts, ranked, page_bytes=size).orderBy("review_id", "page").collect()
    got: dict[str, list] = {}
    for p in pages:
        got.setdefault(p.review_id, []).append(p)
    assert set(got) == set(whole)
    for rid, mine in got.items():
        assert "".join(p.text for p in mine) == whole[rid]
        assert [p.page for p in mine] == list(range(len(mine))) and {p.pages for p in mine} == {len(mine)}
        assert max(len(p.text.encode()) for p in mine) <= size
    if size == 1000:
        assert len(got["hot"]) > 50


def test_findings_stay_whole_where_a_page_can_hold_them(spark, reviewed):
    verdicts, ranked, _ = reviewed
    pages = [p.text for p in merge.comment_pages(verdicts, ranked, page_bytes=2000).collect()]
    for r in ranked.where("review_id = 'hot' and md is not null").select("md").collect():
        assert len(r.md.encode()) > 2000 or any(r.md + "\n" in p for p in pages)


def test_no_task_gathers_a_review(spark, reviewed):
    """The rows of a page are the largest group of the plan that holds text."""
    verdicts, ranked, _ = reviewed
    plan = merge.comment_pages(verdicts, ranked, page_bytes=1000)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_page_must_hold_a_code_point(reviewed):
    with pytest.raises(ValueError):
        merge.comment_pages(reviewed[0], reviewed[1], page_bytes=3)


def test_no_reviews(spark, reviewed):
    verdicts, ranked, _ = reviewed
    assert merge.comment_pages(verdicts.where(F.lit(False)), ranked).count() == 0
