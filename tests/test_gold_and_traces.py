import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import text_variants as tv
from plumbline.operators import trace_audit, traces
from plumbline.operators.arithmetic import evaluate
from plumbline.sources import qa_mining, tables

FACT = "array<struct<key:string,value:string,kind:string,unit:string,required:boolean,clause:string>>"


def items(spark, n=12):
    rows = []
    for i in range(n):
        facts = [
            ("dose", f"{i + 1}.5", "numeric", "mg", True, "The dose was {value}."),
            ("arm", f"arm {i % 3}", "entity", "", True, "Patients were in {value}."),
            ("sites", str(i + 2), "numeric", "sites", True, "The trial ran at {value}."),
            ("end", "2024-05-01", "date", "", True, "It ended on {value}."),
        ]
        rows.append((f"i{i}", f"d{i % 2}" if i < n - 1 else "solo", "Context.", "What?", facts))
    schema = f"item_id string, domain string, context string, question string, facts {FACT}"
    return tv.with_source_record(spark.createDataFrame(rows, schema))


def test_full_cross_product_and_invariants(spark):
    base = items(spark)
    rows = tv.build_variants(base).join(base.select("item_id", "reference"), "item_id").collect()
    assert len(rows) == 12 * 6 * 3
    for row in rows:
        assert row.uid == f"{row.item_id}:{row.degradation}@{row.severity:g}"
        assert len(row.edit) > 20
        if row.introduces_error:
            assert row.text != row.reference
        else:
            assert row.degradation == "verbosity" and row.text.startswith(row.reference)
            assert row.len_ratio >= 1.5 + 1.5 * row.severity
        if row.degradation == "topic_drift":
            assert "remainder addresses" not in row.text


def test_variants_do_not_depend_on_partitions(spark):
    base = items(spark)
    one = tv.build_variants(base.coalesce(1)).select("uid", "requested", "text")
    many = tv.build_variants(base.orderBy(F.rand(3)).repartition(7)).select("uid", "requested", "text")
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_random_severities_change_every_text(spark):
    rng = random.Random(4)
    severities = tuple(round(rng.uniform(0.05, 1.0), 3) for _ in range(6))
    base = items(spark, 6)
    bad = (
        tv.build_variants(base, tv.error_kinds(), severities)
        .join(base.select("item_id", "reference"), "item_id")
        .where(F.col("text") == F.col("reference"))
    )
    assert bad.isEmpty()


def test_lone_item_is_cut_and_no_numbers_means_hedging(spark):
    facts = [("a", "alpha", "claim", "", True, "It was {value}."), ("b", "beta", "claim", "", True, "Then {value}.")]
    one = spark.createDataFrame(
        [("x", "d", "c", "q", facts)],
        f"item_id string, domain string, context string, question string, facts {FACT}",
    )
    rows = tv.build_variants(tv.with_source_record(one), ["topic_drift", "numeric_swap"], (0.5,)).collect()
    by = {r.requested: r for r in rows}
    assert by["topic_drift"].text == "It was alpha. The remainder addresses a different question."
    assert by["numeric_swap"].degradation == "hedging"


EXAMPLE = {
    "task": "Compute the mass in kg when warehouse A is filled to pallet capacity.",
    "steps": [
        {"tool": "lookup", "args": {"key": "warehouse_a_capacity"}, "result": "4200"},
        {"tool": "lookup", "args": {"key": "pallet_weight_kg"}, "result": "27.5"},
        {"tool": "calculator", "args": {"expr": "4200 * 27.5"}, "result": "115500"},
    ],
    "final_answer": "115500 kg",
    "expected_final_answer": "115500 kg",
}


def cases():
    out = {"valid": EXAMPLE}
    for name in ("argument", "result", "tool", "answer", "repeat", "open"):
        out[name] = json.loads(json.dumps(EXAMPLE))
    out["argument"]["steps"][2]["args"]["expr"] = "4200 * 28.5"
    out["result"]["steps"][0]["result"] = "9999"
    out["tool"]["steps"][0] = {"tool": "web_search", "args": {"query": "capacity"}, "result": "4200"}
    out["answer"]["final_answer"] = "125500 kg"
    out["repeat"]["steps"].append(dict(EXAMPLE["steps"][0]))
    del out["open"]["expected_final_answer"]
    return out


def test_audit_golden_cases(spark):
    rows = [(k, json.dumps(v)) for k, v in cases().items()]
    checked = trace_audit.validate_traces(spark.createDataFrame(rows, "trace_id string, payload string"))
    assert checked.where("reject_reason is not null").isEmpty()
    out = {r.trace_id: r for r in trace_audit.audit(checked).collect()}
    verdicts = {k: r.status for k, r in out.items()}
    assert verdicts == {
        "valid": "passed", "argument": "failed", "result": "failed", "tool": "failed",
        "answer": "failed", "repeat": "passed", "open": "consistent",
    }
    assert out["argument"].checked[2].replayed == "119700"
    assert out["argument"].checked[2].status == "result_mismatch"
    assert out["tool"].checked[0].status == "unsupported_tool"
    assert out["repeat"].repeats == [4] and out["answer"].step_failures == 0


def test_payload_bounds(spark):
    def changed(**kw):
        doc = json.loads(json.dumps(EXAMPLE))
        doc.update(kw)
        return json.dumps(doc)

    step = EXAMPLE["steps"][0]
    rows = [
        ("extra", changed(note=1)),
        ("steps", changed(steps=[step] * 41)),
        ("none", changed(steps=[])),
        ("args", changed(steps=[{**step, "args": {f"a{i}": 1 for i in range(9)}}])),
        ("nested", changed(steps=[{**step, "args": {"a": [1]}}])),
        ("flag", changed(steps=[{**step, "args": {"a": True}}])),
        ("huge", changed(steps=[{**step, "args": {"a": 1e13}}])),
        ("type", changed(steps=[{**step, "result": 5}])),
        ("json", "{"),
        ("ok", changed()),
    ]
    out = trace_audit.validate_traces(spark.createDataFrame(rows, "trace_id string, payload string"))
    reasons = {r.trace_id: r.reject_reason for r in out.collect()}
    assert reasons.pop("ok") is None
    assert all(reasons.values()), reasons


def test_tools(spark):
    assert evaluate("38 * 38.5") == "1463" and evaluate("-2**2") == "-4" and evaluate("7 // 2") == "3"
    for bad in ("__import__('os')", "2 ** 9", "1/0", "a + 1", "(1", "1 2", "", "x" * 300):
        assert evaluate(bad) is None
    rows = [
        ("t", 1, "date_diff", [("d1", "2026-01-01", False), ("d2", "2026-03-01", False)], "59"),
        ("t", 2, "date_diff", [("d1", "2026-02-30", False), ("d2", "2026-03-01", False)], "1"),
        ("t", 3, "unit_convert", [("frm", "KG", False), ("to", "t", False), ("value", "0.15", True)], "0.0001"),
        ("t", 4, "unit_convert", [("frm", "kg", False), ("to", "t", False)], "1"),
        ("t", 5, "lookup", [("key", "nope", False)], "1"),
    ]
    calls = spark.createDataFrame(
        rows,
        "trace_id string, step int, tool string, args array<struct<name:string,text:string,number:boolean>>, recorded string",
    )
    out = {r.step: r.status for r in trace_audit.step_status(calls).collect()}
    assert out == {1: "passed", 2: "invalid_call", 3: "passed", 4: "invalid_call", 5: "invalid_call"}


def test_trace_damage_is_caught_or_harmless(spark):
    rows = [(k, json.dumps(v)) for k, v in cases().items() if k == "valid"]
    valid = trace_audit.validate_traces(spark.createDataFrame(rows, "trace_id string, payload string"))
    variants = traces.build_trace_variants(valid)
    assert variants.count() == 12
    checked = trace_audit.audit(
        variants.select(
            F.col("uid").alias("trace_id"), "steps", "final_answer",
            F.lit(None).cast("string").alias("expected_final_answer"),
        )
    ).collect()
    for row in checked:
        assert (row.status == "consistent") == row.trace_id.split(":")[1].startswith("length_padding")


def test_sources(spark, tmp_path):
    base = items(spark, 5).withColumnRenamed("item_id", "id")
    tables.write_items(base, f"{tmp_path}/items")
    assert [r.id for r in tables.read_items(spark, f"{tmp_path}/items", 2).orderBy("id").collect()] == ["i0", "i1"]
    pair = dict(id="a", source_id="s", context="c", question="q", reference="1", candidate="1")
    with open(f"{tmp_path}/pairs.json", "w") as out:
        out.write(json.dumps(pair) + "\n")
    with pytest.raises(ValueError, match="reference equals candidate"):
        tables.read_pairs(spark, f"{tmp_path}/pairs.json")
    stamp = tables.provenance("live", 1, "x")
    tables.save(base.select("id"), str(tmp_path), "full", stamp)
    tables.save(base.select("id").limit(1), str(tmp_path), "full", stamp, smoke=True)
    assert tables.load(spark, str(tmp_path), "full").count() == 5
    for name in ("../x", "/tmp/x", "a/b"):
        with pytest.raises(ValueError):
            tables.load(spark, str(tmp_path), name)


def test_mining_small_case(spark, tmp_path):
    context = "In 1990 there were 12.5 units and 30 more."
    def qa(i, text, start, impossible=False):
        return {"id": i, "question": "?", "is_impossible": impossible, "answers": [{"text": text, "answer_start": start}]}
    doc = {"data": [{"title": "T", "paragraphs": [
        {"context": context, "qas": [qa("q0", "units", 24), qa("q1", "12.5", 19), qa("q2", "30", 34)]},
        {"context": context, "qas": [qa("q3", "30", 0), qa("q4", "30", 34)]},
    ]}]}
    path = tmp_path / "source.json"
    path.write_text(json.dumps(doc))
    source = spark.read.schema(qa_mining.SOURCE_SCHEMA).json(str(path))
    out = {r.id: r.candidate for r in qa_mining.mine_numeric_pairs(source, 2).collect()}
    assert out == {"q1": "13.7", "q4": "33"}
    with pytest.raises(ValueError):
        qa_mining.mine_numeric_pairs(source, 3)
