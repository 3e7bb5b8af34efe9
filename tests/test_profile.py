from pressmill.operators import profile as p

SCHEMA = "id string, code string, codes array<string>, score double, load int, extra string"
CHECKS = [p.Check("code", "code", ("A", "B")), p.Check("codes", "codes", ("X", "Y")), p.Check("score", "range", low=0.0, high=1.0)]


def rows(spark):
    out = []
    for load in range(1, 7):
        for i in range(20):
            bad = load == 5
            out.append((f"{load}-{i}", "A" if bad and i < 10 else None if i else "B", ["X"] if i < 2 else [], 0.2 if load == 3 else 0.8, load, "e"))
    out += [("n1", "a", ["X", "X"], float("nan"), 1, "e"), ("n2", "", [None], 1.5, 2, "e"), ("n3", None, None, None, None, "e"), ("n1", "a", ["X", "X"], float("nan"), 2, "e")]
    return spark.createDataFrame(out, SCHEMA)


def test_bad_values_and_drift(spark):
    got = {tuple(r) for r in p.quality_issues(rows(spark), CHECKS, "t", "id", "load").collect()}
    assert {g for g in got if g[3] == "bad_value"} == {("t", c, k, "bad_value") for k in ("n1", "n2") for c in ("code", "codes", "score")}
    assert {g for g in got if g[3] == "drift"} == {("t", "code", "5", "drift"), ("t", "score", "3", "drift")}


def test_states_merge(spark):
    data = rows(spark)
    states = p.compile_state(data, CHECKS, "load")
    merged = p.merge_states(states, CHECKS).collect()[0]
    assert merged["rows"] == data.count() and merged["score__bad"] == 3 and merged["code__nulls"] == data.where("code is null").count()
    whole = {r.column_name: r for r in p.report(p.merge_states(states, CHECKS), CHECKS).collect()}
    assert abs(whole["score"]["mean"] - data.where("score between 0 and 1 and not isnan(score)").agg({"score": "avg"}).collect()[0][0]) < 1e-9
    assert whole["code"].n_distinct == 4


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert p.quality_issues(empty, CHECKS, "t", "id", "load").count() == 0
    assert p.compile_state(empty, CHECKS, "load").count() == 0


def test_control_limits(spark):
    history = spark.createDataFrame([("m", i, 0.1 + 0.001 * (i % 3)) for i in range(10)] + [("m", 10, 0.9)], "metric string, load int, value double")
    out = {r.load: r.out_of_control for r in p.control_limits(history, "value", ["metric"], "load").collect()}
    assert out[10] and not any(out[i] for i in range(10))


def test_pattern_and_unconstrained_columns(spark):
    checks = [p.Check("id", "pattern", (r"\d-\d+",)), p.Check("extra", "any")]
    whole = {r.column_name: r for r in p.report(p.merge_states(p.compile_state(rows(spark), checks, "load"), checks), checks).collect()}
    assert round(whole["id"].bad_rate * 124) == 4 and whole["extra"].bad_rate == 0 and whole["extra"].n_distinct == 1 and whole["extra"]["mean"] is None
    bad = {(r.item, r.n) for r in p.scan_entries(rows(spark), checks, "load", "id").where("entry = 'bad'").collect()}
    assert bad == {("n1", 1), ("n2", 1), ("n3", 1)}
