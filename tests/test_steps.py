"""Steps by brand and week: replaced week by week, read with partition and pushed filters."""
import datetime as dt

from pyspark.sql import functions as F

from rebaja.operators import decisions as D, outcomes as O
from rebaja.sources.steps import StepStore

W = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * i) for i in range(6)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_replaces_weeks_and_prunes(spark, tmp_path):
    store = StepStore(spark, str(tmp_path))
    df = spark.createDataFrame([(b, w, i, f"{b}{i}") for b, n in (("A", 6), ("B", 3)) for w in W[:n] for i in range(50)], "brand string, week date, i int, key string")
    for week in W:  # a run a week
        store.write("actions", df.where(F.col("week") == F.lit(week)))
    assert store.read("actions").count() == df.count() and store.weeks("actions").count() == 9
    last = store.latest("actions")
    assert {(r.brand, r.week) for r in last.select("brand", "week").distinct().collect()} == {("A", W[5]), ("B", W[2])} and last.count() == 100
    files = {f.split("actions/")[1].rsplit("/", 1)[0] for f in last.inputFiles()}
    assert "PartitionFilters: [((" in plan(last) and "PushedFilters: []" in plan(last) and files
    assert {(r.brand, r.week) for r in store.latest("actions", 2, before=W[2]).select("brand", "week").distinct().collect()} == {(b, w) for b in "AB" for w in W[:2]}
    store.write("actions", df.where((F.col("week") == F.lit(W[5])) & (F.col("i") < 7)).withColumn("key", F.lit("again")))
    assert store.read("actions").count() == df.count() - 43 and store.latest("actions").where("brand = 'A'").agg(F.count("*"), F.max("key")).first()[:] == (7, "again")


def test_run_is_published_and_read_back(spark, run, tmp_path):
    store = StepStore(spark, str(tmp_path))
    run.publish(store)
    run.publish(store)  # the same week again
    for name, step in (("actions", run.actions), ("pricing_rows", run.rows), ("channel_actions", run.channel_actions)):
        back = store.latest(name) if step.limit(1).count() else None
        if back is not None:
            assert back.select(step.columns).exceptAll(step).count() == 0 and back.count() == step.count(), name
    parents = store.latest("parent")
    filters = plan(parents).split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert parents.count() == run.current(run.parent).count() and "week" in filters
    decided = D.decide_by_formula(run.history)
    assert O.outcomes(run.history, decided, run.t.transactions, run.t.products, run.t.costs).count() >= 0


def test_outcomes_read_their_weeks_only(spark, run):
    weeks = O.eval_weeks(run.history, D.decide_by_formula(run.history))
    actual = O.actual_metrics(run.t.transactions, run.t.products, weeks)
    text = plan(actual)
    assert "GreaterThanOrEqual(fecha," in text and "LessThan(fecha," in text
    first, last = weeks.agg(F.min("week"), F.max("week")).first()
    near = run.t.transactions.where((F.col("fecha") >= F.lit(first)) & (F.col("fecha") < F.date_add(F.lit(last), 60)))
    assert near.count() < run.t.transactions.count()
    assert O.actual_metrics(run.t.transactions, run.t.products, weeks.where("false")).count() == 0
