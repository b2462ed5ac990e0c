"""JSON arrays read in splits, beside a plain parser."""

from __future__ import annotations

import json
import random

import pytest

from tabgate.operators import vocabulary as L
from tabgate.sources import json_array


def odd_objects(n, seed=3):
    rng = random.Random(seed)
    texts = ["", "}", "{", '"', "\\", '\\"', "}{", "],[", 'a"}', "é} ", "\n", "{\"x\": \"}\"}", "plain"]
    def value(deep):
        kind = rng.randrange(5 if deep else 3)
        if kind < 2:
            return "".join(rng.choice(texts) for _ in range(rng.randrange(4)))
        if kind == 2:
            return rng.choice([None, 1, -2.5, True])
        if kind == 3:
            return [value(deep - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(texts) + str(i): value(deep - 1) for i in range(rng.randrange(4))}
    return [{"id": i, "v": value(3)} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", ["97", "1000", "128m"])
def test_objects_of_an_array_in_splits(spark, tmp_path, indent, size):
    own = odd_objects(150)
    mixed = [None, "a}{", 3, *own[:50], "\\\"{", *own[50:], ["}"], None]
    for name, entries in {"a": mixed, "b": own[:1], "empty": []}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(entries, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "none.json").write_text("")
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(o) for o in own[:9]))
    (tmp_path / "cut.json").write_text(json.dumps([*own[:4], {"x": {"y": [1, {"z": "}"}]}}])[:-4])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = json_array.objects(spark, str(tmp_path)).collect()
        if size == "97":
            assert json_array.pieces(spark, str(tmp_path / "a.json")).select("block").distinct().count() > 20
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    found = {}
    for r in sorted(got, key=lambda r: r.position):
        found.setdefault(r.path.rsplit("/", 1)[1], []).append((r.position, json.loads(r.text)))
    whole = {"a.json": own, "b.json": own[:1], "lines.json": own[:9], "cut.json": own[:4]}
    assert found == {k: list(enumerate(v)) for k, v in whole.items()}


def test_dump_as_array(spark, tmp_path):
    element = {"CDECode": "1", "CDEVersion": None, "CDEFullName": "a}", "permissibleValues": [{"value": "{x", "ncit_concept_code": "C1", "synonyms": ["s"]}]}
    (tmp_path / "dump.json").write_text(json.dumps([element, {"CDECode": "2"}, {"CDECode": "1", "CDEFullName": "later"}], indent=1))
    rows = L.read_dump(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.CDECode, r.CDEFullName) for r in rows] == [("1", "a}"), ("2", None), ("1", "later")]
    assert rows[0].permissibleValues[0].synonyms == ["s"]
    first = L.elements(L.read_dump(spark, str(tmp_path)))
    assert sorted((r.code, r.full_name) for r in first.collect()) == [("1", "a}"), ("2", None)]
