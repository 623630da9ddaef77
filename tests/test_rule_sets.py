"""Rule sets of any size against rules run one after the other in plain Python."""

import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import rules


def engine(listed):
    made = rules.RuleEngine.standard()
    made.conditions["warned"] = lambda row, p: F.size(row("warnings")) > p["n"]
    made.actions["double"] = lambda row, p: {"quantity": (row("quantity") * 2).cast("decimal(18,3)"), "unit": F.lit("case")}
    made.actions["reset"] = lambda row, p: {"warnings": F.array(F.lit("reset"))}
    for i, (condition, cp, action, ap) in enumerate(listed):
        made.add(rules.Rule(f"R{i}", condition, cp, action, ap, priority=i))
    return made


def drawn(draw, n):
    condition = lambda: draw.choice([("range", {"field": "quantity", "min": (m := draw.randrange(40)), "max": m + draw.randrange(15)}), ("equals", {"field": "unit", "value": draw.choice(["unit", "case"])}), ("contains", {"field": "name", "value": str(draw.randrange(10))}), ("warned", {"n": draw.randrange(4)}), ("missing", {"field": "unit"}), ("unheard_of", {}), ("range", {})])
    action = lambda: draw.choice([("set_quantity", {"value": draw.randrange(40)}), ("set_unit", {"value": draw.choice(["unit", "case", None])}), ("warn", {"message": f"m{draw.randrange(9)}"}), ("double", {}), ("reset", {})])
    return [(*condition(), *action()) for _ in range(n)]


def by_hand(row, listed):
    r, executed = {**row, "warnings": []}, []
    for i, (condition, cp, action, ap) in enumerate(listed):
        if condition == "unheard_of":
            r["warnings"] = [*r["warnings"], f"R{i}: unsupported rule"]
        elif condition == "range" and not cp:
            r["warnings"] = [*r["warnings"], f"R{i}: RULE_ERROR KeyError('field')"]
        else:
            value = r.get(cp.get("field"))
            hit = {"range": lambda: value is not None and cp["min"] <= value <= cp["max"], "equals": lambda: value == cp["value"], "contains": lambda: cp["value"] in value, "warned": lambda: len(r["warnings"]) > cp["n"], "missing": lambda: value in (None, "")}[condition]()
            executed.append((f"R{i}", True, hit))
            if hit and action == "set_quantity":
                r["quantity"] = Decimal(ap["value"])
            elif hit and action == "set_unit":
                r["unit"] = ap["value"]
            elif hit and action == "warn":
                r["warnings"] = [*r["warnings"], ap["message"]]
            elif hit and action == "double":
                r["quantity"], r["unit"] = None if r["quantity"] is None else r["quantity"] * 2, "case"
            elif hit:
                r["warnings"] = ["reset"]
            continue
        executed.append((f"R{i}", False, False))
    return (r["id"], r["quantity"], r["unit"], tuple(r["warnings"]), tuple(executed))


ROWS = [{"id": i, "quantity": None if i == 0 else Decimal(i * 7 % 40), "unit": (None, "unit", "case")[i % 3], "name": f"n{i}"} for i in range(40)]


def run(spark, made):
    rows = spark.createDataFrame([tuple(r.values()) for r in ROWS], "id int, quantity decimal(18,3), unit string, name string")
    return {(r.id, r.quantity, r.unit, tuple(r.warnings), tuple(map(tuple, r.executed))) for r in made.run(rows).collect()}


@pytest.mark.parametrize(("n", "seed"), [(0, 0), (1, 1), (6, 2), (15, 3), (15, 4), (60, 5)])
def test_rules_equal_one_after_the_other(spark, n, seed):
    listed = drawn(random.Random(seed), n)
    assert run(spark, engine(listed)) == {by_hand(r, listed) for r in ROWS}


def test_barriers_and_written_stages(spark, monkeypatch):
    monkeypatch.setattr(rules, "CUT", 2)
    monkeypatch.setattr(rules, "SAVE", 5)
    listed = drawn(random.Random(8), 25)
    made = engine(listed)
    assert len(rules.levels([made._made(r) for r in made.list()])) > 10
    assert run(spark, made) == {by_hand(r, listed) for r in ROWS}


def test_rules_that_read_what_none_writes_are_one_level():
    made = engine([("contains", {"field": "name", "value": str(i)}, *(("set_quantity", {"value": i}), ("warn", {"message": "m"}), ("set_unit", {"value": "case"}))[i % 3]) for i in range(300)])
    assert [len(x) for x in rules.levels([made._made(r) for r in made.list()])] == [300]


def test_five_hundred_rules(spark):
    draw = random.Random(6)
    listed = [("contains", {"field": "name", "value": str(draw.randrange(100))}, *draw.choice([("set_quantity", {"value": draw.randrange(40)}), ("set_unit", {"value": "case"}), ("warn", {"message": f"m{i}"})])) if i % 50 else ("range", {"field": "quantity", "min": 3, "max": 20}, "warn", {"message": "in"}) for i in range(500)]
    began = time.time()
    got = run(spark, engine(listed))
    assert got == {by_hand(r, listed) for r in ROWS} and time.time() - began < 60
