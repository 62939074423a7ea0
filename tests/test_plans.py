"""What plans must and must not hold."""

import re

from loomspark.plans import retrieval


def test_lexical_search_shuffles_no_pairs(spark, sf_dir):
    plan = retrieval.bm25_search_topk(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "hashpartitioning(id#" in plan
    assert not re.search(r"hashpartitioning\(qid#\w+, id#", plan) and not re.search(r"hashpartitioning\(id#\w+, qid#", plan)
