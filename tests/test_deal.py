"""Postings are dealt out before they get wide."""

from postmill.plans import views


def test_postings_are_dealt_out_once_and_narrow(spark, sf_dir):
    posts = views.postings(spark, sf_dir)
    for columns in (["title", "description"], ["seq", "url"]):
        plan = posts.select(*columns)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if " Exchange " in line]
        assert len(dealt) == 1 and "hashpartitioning(l_orderkey" in dealt[0]
