"""Rules as rows against the fixed engine, and every kind on its own."""

import json

import pytest

from folioscore.operators import governance as G, rule_table as R


def checked(spark, documents, rules):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "id long, document string")
    out = R.check_documents(rows, R.rule_frame(spark, rules)).orderBy("id").collect()
    return [(r["errors"], r["unknown"]) for r in out]


KINDS = [
    (R.Row("a.b", "text", "x"), ["x"], ["y", 1, None, True]),
    (R.Row("a.b", "number", low=2), [2, 2.0], ["2", 3, True]),
    (R.Row("a.b", "true"), [True], ["true", 1, False]),
    (R.Row("a.b", "false"), [False], ["false", 0, True]),
    (R.Row("a.b", "whole", low=1, high=3), [1, 3], [0, 4, 2.5, "2", True]),
    (R.Row("a.b", "inside", low=0, high=1), [0.5, 1e-9], [0, 1, "0.5"]),
    (R.Row("a.b", "pattern", r"^a+\z"), ["aa"], ["ab", "aa\n", 1]),
    (R.Row("a.b", "one_of", options=["x", "y"]), ["y"], ["z", None, ["y"]]),
    (R.Row("a.b", "json", '["q"]'), [["q"]], [["q", "r"], "q", []]),
    (R.Row("a.b", "past"), ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+05:00"], ["2024-01-01T00:00:00", "9999-01-01T00:00:00Z", "soon", 5]),
    (R.Row("a.b", "any"), ["", 0, False, []], [None]),
    (R.Row("a.b", "optional"), [None, 1], []),
]


@pytest.mark.parametrize("rule,good,bad", KINDS, ids=[r.kind for r, _, _ in KINDS])
def test_kinds(spark, rule, good, bad):
    got = checked(spark, [json.dumps({"a": {"b": v}}) for v in good + bad], [rule])
    assert got == [([], [])] * len(good) + [(["a.b"], [])] * len(bad)


def test_missing_values_sums_and_text_that_is_no_object(spark):
    rules = [R.Row("a.b", "text", "x"), R.Row("c", "any"), R.Row("d.sum", "sum", low=1, options=["d.e", "d.f"]), R.Row("d.e", "optional"), R.Row("d.f", "optional")]
    documents = ['{"a": {}, "d": {"e": 0.25, "f": 0.75}}', '{"a": {"b": "x"}, "c": 1, "d": {"e": 1}}', "[]", "not json", '"text"', None, "", "{}"]
    got = [e for e, _ in checked(spark, documents, rules)]
    assert got == [["a.b", "c"], ["d.sum"], *[["document"]] * 5, ["a.b", "c", "d.sum"]]


def test_unknown_keys_at_any_depth(spark):
    rules = [R.Row("a.b.c", "any"), R.Row("a.d", "optional")]
    got = checked(spark, ['{"a": {"b": {"c": 1, "x": {"c": 2}}, "d": {"deep": 1}, "y": []}, "z": null}'], rules)
    assert got == [([], ["a.b.x", "a.y", "z"])]


def test_bad_rule_tables(spark):
    documents = spark.createDataFrame([(1, "{}")], "id long, document string")
    with pytest.raises(ValueError, match="shape"):
        R.check_documents(documents, R.rule_frame(spark, [R.Row("a", "shape")]))
    assert R.check_documents(documents, R.rule_frame(spark, [R.Row("a", "optional")])).count() == 1


def test_the_contract_rules_say_the_same_as_the_fixed_engine(spark, small):
    from folioscore.queries.governed import _contracts
    from folioscore.queries.inputs import Inputs

    contracts = _contracts(Inputs(spark, small))
    fixed = {r["pilot_id"]: r["errors"] for r in G.check_contracts(contracts).collect()}
    rows = R.check_documents(contracts, R.rule_frame(spark, G.contract_rule_rows())).collect()
    assert {r["pilot_id"]: r["errors"] for r in rows} == fixed and all(r["unknown"] == [] for r in rows)
    assert sum(bool(e) for e in fixed.values()) > 10
    plan = R.check_documents(contracts, R.rule_frame(spark, G.contract_rule_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_rules_are_constants_and_contracts_are_parsed_once(spark, small):
    from folioscore.queries.governed import _own_contracts
    from folioscore.queries.inputs import Inputs

    contracts = _own_contracts(Inputs(spark, small))
    plan = R.check_documents(contracts, R.rule_frame(spark, G.contract_rule_rows()))._jdf.queryExecution().optimizedPlan().toString()
    assert "concat($., " not in plan and plan.count("from_json(") == 1
    assert contracts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
