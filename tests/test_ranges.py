"""Numbers by ranges, and maps that never become one row."""

import random

from depweave.operators import textbatch
from depweave.plans import registry
from depweave.sources.scratch import numbered
from tests.test_queries import SF_DIR


def test_numbers_follow_the_order_over_ranges(spark):
    xs = list(range(5000))
    random.Random(2).shuffle(xs)
    df = spark.createDataFrame([(x % 3, x) for x in xs], "a int, b int").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got = {(r.a, r.b): r.n for r in numbered(df, ["a", "b"], "n").collect()}
            assert got == {key: n for n, key in enumerate(sorted((x % 3, x) for x in xs), 1)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_map_is_not_gathered(spark):
    for name in ("export_map_flat", "import_map_counts"):
        plan = registry.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(struct" not in plan and "collect_list(named_struct" not in plan


def test_batches_over_ranges(spark):
    """A large group over many ranges, with rows of size 0 and rows above the budget, against a plain loop."""
    rng = random.Random(5)
    pick = {"hot": (0, 1, 3, 10, 40, 150), "even": (10,), "small": (5, 60), "zero": (0, 200)}
    rows = [(g, i, rng.choice(sizes)) for g, sizes in pick.items() for i in range({"hot": 3000, "even": 700}.get(g, 40))]
    want, no, total, last = {}, 0, 0, None
    for g, i, s in sorted(rows):
        if g != last:
            no, total = 0, s
        elif total + s > 100:  # the batch has a row, if only an empty one
            no, total = no + 1, s
        else:
            total += s
        want[g, i], last = no, g
    rng.shuffle(rows)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = textbatch.batch_by_budget(spark.createDataFrame(rows, "g string, i int, s int"), "g", "i", "s", 100)
            assert {(r.g, r.i): r.batch_no for r in df.collect()} == want
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_queries_gather_no_group(spark):
    plan = lambda name: registry.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan("batch_by_budget")
    assert "row_number()" not in plan("apply_validations")
