"""Every query of the catalog against its SQL on another engine."""

import re

import pytest
from same import assert_same

from gneiss.plans import catalog, code, sqlapi, stored  # noqa: F401  (they add their queries to the catalog)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df())


def test_code_tokens_against_plain_python(spark, sf_dir, duck):
    pattern = r"\b[a-zA-Z_][a-zA-Z0-9_]*\b|\d+\.?\d*|[+\-*/=<>!&|]+"
    expected = {}
    for doc_id, text in duck.sql("select doc_id, text from documents").fetchall():
        clean = re.sub(r"//[^\n]*", "", text.lower())
        expected[doc_id] = " ".join(t for t in re.findall(pattern, clean) if len(t) >= 2)
    assert {r.doc_id: r.tokens for r in catalog.tokenize_code(spark, sf_dir).collect()} == expected


def _events(duck):
    return duck.sql("select event_id, event_type, user_id, epoch_us(ts) at_us from events order by at_us, event_id").fetchall()


def test_debounce_against_a_loop(spark, sf_dir, duck):
    last, passed = {}, 0
    for _, kind, user, at in _events(duck):
        if (user, kind) not in last or at - last[user, kind] >= 6 * 3_600_000_000:
            last[user, kind] = at
            passed += 1
    assert catalog.debounce_replay(spark, sf_dir).count() == passed


def test_rate_limit_against_a_loop(spark, sf_dir, duck):
    taken, accepted = {}, set()
    for event, _, user, at in _events(duck):
        own = taken[user] = [t for t in taken.get(user, []) if t > at - 24 * 3_600_000_000]
        if len(own) < 3:
            own.append(at)
            accepted.add(event)
    rows = catalog.rate_limit_replay(spark, sf_dir).collect()
    assert {r.event_id for r in rows if r.accepted} == accepted


def test_plans_have_the_wanted_shape(spark, sf_dir):
    plan = catalog.bm25_topk(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SortMergeJoin" not in plan
    plan = catalog.multi_source_topn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan
    plan = catalog.doc_length(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)
