import pytest
from pyspark.sql import functions as F

from nearfield.functions import filters as flt


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(
        [
            (1, "a", 5, 1.5, True, ["x", "y"], ("in",), '{"n": 3, "s": "3", "b": true, "deep": {"k": "v"}}'),
            (2, "b", None, 2.5, False, ["z"], ("out",), '{"n": 4.5}'),
            (3, None, 7, None, None, None, None, None),
        ],
        "id int, s string, n int, d double, flag boolean, tags array<string>, nest struct<k:string>, js string",
    )
    return df.withColumn("extra", F.parse_json("js")).drop("js").cache()


def ids(rows, spec):
    kept = sorted(r.id for r in flt.filter_rows(rows, spec, variant="extra").collect())
    value = flt.compile_filter(spec, rows.schema, variant="extra", as_value=True)
    shown = rows.select("id", value.alias("v")).collect()
    assert all(r.v is not None for r in shown)
    assert kept == sorted(r.id for r in shown if r.v)
    return kept


@pytest.mark.parametrize(
    "spec, expected",
    [
        (flt.match("s", "a"), [1]),
        (flt.match("flag", True), [1]),
        (flt.match("n", 5), [1]),
        (flt.match("n", "5"), []),  # a string never equals a number
        (flt.match("flag", 1), []),
        (flt.match("tags", "y"), [1]),
        (flt.match("nest.k", "out"), [2]),
        (flt.match("absent", 1), []),
        (flt.range_("n", gte=5, lt=7), [1]),
        (flt.range_("d", gt=1.5), [2]),
        (flt.range_("s", gt=1), []),
        (flt.any_of("s", ["a", "b"]), [1, 2]),
        (flt.any_of("s", []), [1, 2, 3]),  # an empty list asks for nothing
        (flt.none_of("s", ["a"]), [2, 3]),  # a missing key passes
        (flt.none_of("tags", ["x"]), [2, 3]),
        (flt.none_of("absent", ["x"]), [1, 2, 3]),
        (flt.metadata({"s": "b", "flag": False}), [2]),
        (flt.match("extra_key", "v"), []),
        (flt.match("deep.k", "v"), [1]),
        (flt.match("b", True), [1]),
        (flt.range_("extra", gt=1), []),
        ({"must_not": [{"key": "n", "range": {"gte": 6}}]}, [1, 2]),
        ({"should": [{"key": "s", "match": {"value": "a"}}, {"key": "n", "range": {"gte": 6}}]}, [1, 3]),
        ({}, [1, 2, 3]),
    ],
)
def test_selects(rows, spec, expected):
    assert ids(rows, spec) == expected


def test_variant_values_keep_their_type(rows):
    only = rows.drop("n", "s")
    assert [r.id for r in flt.filter_rows(only, flt.match("n", 3), variant="extra").collect()] == [1]
    assert [r.id for r in flt.filter_rows(only, flt.match("s", 3), variant="extra").collect()] == []
    assert [r.id for r in flt.filter_rows(only, flt.match("s", "3"), variant="extra").collect()] == [1]
    assert [r.id for r in flt.filter_rows(only, flt.range_("n", gt=3), variant="extra").collect()] == [2]


def test_flat_combiners():
    either = flt.any_of("s", ["a", "b"])
    assert flt.combine_and_flat(either, flt.none_of("n", [1])) == {
        "must": either["should"],
        "must_not": flt.none_of("n", [1])["must_not"],
    }
    both = flt.metadata({"s": "a", "n": 1})
    assert flt.combine_or_flat(both) == {"should": both["must"]}
    assert flt.combine_and_flat() == {} and flt.combine_or_flat({}) == {}


def test_all_problems_are_reported():
    bad = {
        "maybe": [],
        "must": "x",
        "should": [
            {"match": {"value": 1}},
            {"key": "a"},
            {"key": "a", "match": {"value": 1}, "range": {"gt": 1}},
            {"key": "a", "match": {}},
            {"key": "a", "range": {}},
            {"key": "a", "range": {"near": 1, "gt": "2"}},
            7,
        ],
    }
    assert len(flt.problems(bad)) == 10
    assert flt.problems(None) and flt.problems([]) and not flt.problems(flt.match("a", 1))
    with pytest.raises(ValueError, match="unknown clause"):
        flt.compile_filter(bad, None)


def test_scalar_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "cast(id as string) as s").write.parquet(path)
    spec = {"must": [{"key": "id", "range": {"gte": 3}}], "must_not": [{"key": "s", "match": {"value": "5"}}]}
    plan = flt.filter_rows(spark.read.parquet(path), spec)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,3)" in plan and "Or(IsNull(s),Not(EqualTo(s,5)))" in plan


def passes(row, spec):
    """The meaning of a filter, one row at a time."""

    def holds(entry):
        value = row.get(entry["key"])
        for one in value if isinstance(value, list) else [value]:
            if one is None:
                continue
            if "match" in entry:
                want = entry["match"]["value"]
                kind = lambda v: "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v)
                if kind(one) == kind(want) and one == want:
                    return True
            elif isinstance(one, (int, float)) and not isinstance(one, bool):
                if all(flt.BOUNDS[name](one, bound) for name, bound in entry["range"].items()):
                    return True
        return False

    return (
        all(map(holds, spec.get("must", [])))
        and (not spec.get("should") or any(map(holds, spec["should"])))
        and not any(map(holds, spec.get("must_not", [])))
    )


def test_random_filters(spark):
    import random

    rng = random.Random(9)
    rows = [
        {
            "id": i,
            "s": rng.choice(["a", "b", None]),
            "n": rng.choice([1, 2, 3, None]),
            "d": rng.choice([0.5, 1.0, 2.5, None]),
            "flag": rng.choice([True, False, None]),
            "tags": rng.choice([["a"], ["a", "b"], [], [None, "b"], None]),
            "nums": rng.choice([[1], [2, 3], None]),
        }
        for i in range(150)
    ]
    schema = "id int, s string, n int, d double, flag boolean, tags array<string>, nums array<int>"
    df = spark.createDataFrame(rows, schema)

    def entry():
        key = rng.choice(["s", "n", "d", "flag", "tags", "nums", "none"])
        if rng.random() < 0.6:
            return {"key": key, "match": {"value": rng.choice(["a", "b", 1, 2, 2.5, 1.0, True, False])}}
        names = rng.sample(list(flt.BOUNDS), rng.randint(1, 2))
        return {"key": key, "range": {name: rng.choice([0, 1, 1.5, 2]) for name in names}}

    specs = [
        {c: [entry() for _ in range(rng.randint(0, 3))] for c in flt.CLAUSES if rng.random() < 0.6} for _ in range(120)
    ]
    shown = df.select("id", *[flt.compile_filter(s, df.schema, as_value=True).alias(f"f{i}") for i, s in enumerate(specs)])
    for got, row in zip(shown.orderBy("id").collect(), rows):
        for i, spec in enumerate(specs):
            assert got[f"f{i}"] == passes(row, spec), (row, spec)
    for spec in specs[:10]:
        assert {r.id for r in flt.filter_rows(df, spec).collect()} == {r["id"] for r in rows if passes(r, spec)}


def test_shredded_payload_agrees_and_is_pushed_down(spark, tmp_path):
    """Keys that stand beside the payload as columns: the same rows, row groups skipped, payload not read."""
    from nearfield.functions import filters as flt
    from pyspark.sql import functions as F

    payloads = [{"lang": "en", "n": 3, "ok": True}, {"lang": "fr", "n": 2.5}, {"lang": 7, "n": "3", "ok": "true"}, {"n": None}, {}, {"lang": "en", "n": 10**6}]
    import json

    rows = [(i, json.dumps(payloads[i % len(payloads)])) for i in range(60)]
    free = spark.createDataFrame(rows, "id long, body string").select("id", F.parse_json("body").alias("payload"))
    shredded = flt.shred(free, {"lang": "string", "n": "double", "ok": "boolean"})
    specs = [
        flt.match("lang", "en"), flt.match("lang", 7), flt.match("n", 3), flt.match("n", "3"), flt.range_("n", gte=2.5, lt=100), flt.match("ok", True),
        flt.none_of("lang", ["en", "fr"]), flt.any_of("lang", ["fr", "de"]), flt.none_of("n", [3]),
        {"must": [{"key": "lang", "match": {"value": "en"}}], "must_not": [{"key": "n", "range": {"gt": 5}}]},
    ]
    shredded.orderBy(F.col("payload_keys.lang")).write.parquet(str(tmp_path / "points"))
    kept = spark.read.parquet(str(tmp_path / "points"))
    for spec in specs:
        want = sorted(r.id for r in flt.filter_rows(free, spec).collect())
        assert sorted(r.id for r in flt.filter_rows(kept, spec).collect()) == want
    plan = flt.filter_rows(kept, specs[0]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(payload_keys.lang,en)" in plan and "variant" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError, match="unknown kind"):
        flt.shred(free, {"lang": "text"})
