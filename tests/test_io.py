import datetime as dt
import json

from pyspark.sql import functions as F

from rebaja import schemas
from rebaja.operators import alerts as AL, competitors as K, decisions as D, models as ML, pricing as A, reports as RP
from rebaja.sources import tables as T
from rebaja.streaming import weekly as SW


def test_step_tables_replace_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "steps")
    df = spark.createDataFrame([("A", dt.date(2026, 4, 20), 1), ("A", dt.date(2026, 4, 27), 2), ("B", dt.date(2026, 4, 20), 3)], "brand string, week date, v int")
    T.write_step(df, path)
    T.write_step(df.where("v = 2").withColumn("v", F.lit(9)), path)
    got = {(r.brand, str(r.week)): r.v for r in spark.read.parquet(path).collect()}
    assert got == {("A", "2026-04-20"): 1, ("A", "2026-04-27"): 9, ("B", "2026-04-20"): 3}


def test_raw_read_completes_and_prunes(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("A", "P", 1.0), ("B", "Q", 2.0)], "brand string, sku string, cost double").write.partitionBy("brand").parquet(f"{root}/costs")
    df = T.read_raw(spark, root, "costs", ["A"])
    assert [(r.brand, r.sku, r.cost) for r in df.collect()] == [("A", "P", 1.0)]
    assert "PartitionFilters: [isnotnull(brand" in df._jdf.queryExecution().executedPlan().toString()
    spark.createDataFrame([("001", "x")], "centro string, sucursal string").write.parquet(f"{root}/stores")
    assert T.read_raw(spark, root, "stores").first().region is None


def test_action_files_keep_store_codes(spark, tmp_path):
    folder = tmp_path / "actions"
    folder.mkdir()
    names = [f.name for f in schemas.ACTIONS_CSV]
    line = {"brand": "A", "parent_sku": "P", "store": "2002", "current_price": "100", "current_discount": "15%", "action_type": "decrease"}
    text = ",".join(names) + "\n" + ",".join(line.get(n, "") for n in names) + "\n"
    (folder / "pricing_actions_2026-04-20.csv").write_text(text)
    (folder / "pricing_actions_2026-04-27.csv").write_text(text.replace("2002", "0170"))
    got = {str(r.week): (r.store, r.current_price, r.unit_cost) for r in T.read_actions_csv(spark, str(folder)).collect()}
    assert got == {"2026-04-20": ("2002", 100, None), "2026-04-27": ("0170", 100, None)}


def test_decision_documents(spark, tmp_path):
    doc = {"week": "2026-04-20", "brand": "a", "decisions": {"P-1": {"status": "manual", "manual_price": 44990, "timestamp": "2026-04-21T10:00:00",
           "user": "u", "estimated_impact": {"margin_pct": 31.5, "velocity": 2.5}}, "P-2": {"status": "approved"}}}
    (tmp_path / "decisions_2026-04-20.json").write_text(json.dumps(doc, indent=2))
    got = {r.key: r for r in T.read_decisions_json(spark, str(tmp_path)).collect()}
    assert (got["P-1"].manual_price, got["P-1"].manual_margin_pct, got["P-1"].ts.day) == (44990.0, 31.5, 21) and got["P-2"].status == "approved"


def test_csv_json_and_audit(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2026, 4, 20), 1)], "brand string, week date, v int")
    T.write_csv(df, str(tmp_path / "c"))
    T.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().v == 1
    events = spark.createDataFrame([("A", "u", "approved", f"k{i}", "w", dt.datetime(2026, 4, 20, i)) for i in range(5)], schemas.AUDIT)
    D.append_audit(events, str(tmp_path / "audit"))
    D.append_audit(events.limit(1).withColumn("key", F.lit("last")).withColumn("timestamp", F.lit(dt.datetime(2026, 5, 1))), str(tmp_path / "audit"))
    log = spark.read.schema(schemas.AUDIT).json(str(tmp_path / "audit"))
    assert [r.key for r in D.load_audit(log, "A", 3).collect()] == ["last", "k4", "k3"]


def test_union_and_nulls(spark):
    a, b = spark.createDataFrame([(1.0, "x")], "v double, s string"), spark.createDataFrame([(float("nan"),)], "v double")
    rows = {r.brand: r for r in RP.null_normalise(RP.union_brands({"A": a, "B": b})).collect()}
    assert rows["B"].v is None and rows["B"].s == "" and rows["A"].s == "x"


def test_streaming_sales_equal_batch(spark, run, tmp_path):
    keys = ["brand", "sku", "centro", "week"]
    lines = run.t.transactions.select("brand", "sku", "centro", "fecha", "cantidad", "precio_final", "tipo_entrega")
    lines.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = SW.stream_weekly_sales(SW.file_stream(spark, str(tmp_path / "in"), lines.schema, files=2), lateness="4000 days")
    got = SW.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "update", keys)
    from rebaja.operators import weekly as W
    batch = W.weekly_sales(run.t.transactions).select(*keys, "units_sold", "gross_revenue", "click_collect_units")
    assert got.count() == batch.count() and got.select(batch.columns).exceptAll(batch).count() == 0


def test_streaming_traffic_and_audit(spark, run, tmp_path):
    run.t.traffic.repartition(4).write.parquet(str(tmp_path / "t"))
    stream = SW.stream_traffic_weekly(SW.file_stream(spark, str(tmp_path / "t"), run.t.traffic.schema, files=1), lateness="400 days")
    got = SW.run_available(stream, str(tmp_path / "to"), str(tmp_path / "tc"), "update", ["centro", "week"])
    from rebaja.operators import weekly as W
    want = W.traffic_weekly(run.t.traffic)
    diff = got.withColumn("avg_dwell_time", F.round("avg_dwell_time", 6)).select(want.columns).exceptAll(want.withColumn("avg_dwell_time", F.round("avg_dwell_time", 6)))
    assert got.count() == want.count() and diff.count() == 0
    rows = [("A", "u", "approved", "k", "w", dt.datetime(2026, 4, 20, 1))] * 2 + [("A", "u", "approved", "k2", "w", dt.datetime(2026, 4, 22, 1))]
    spark.createDataFrame(rows, schemas.AUDIT).repartition(1).write.parquet(str(tmp_path / "a"))
    counts = SW.run_available(SW.stream_audit_counts(SW.file_stream(spark, str(tmp_path / "a"), schemas.AUDIT), "9 days"), str(tmp_path / "ao"), str(tmp_path / "ac"),
                              "update", ["brand", "action", "week"])
    assert [(r.n, str(r.week)) for r in counts.collect()] == [(2, "2026-04-20")]


def pages(spark):
    ld = '<script type="application/ld+json">{"@type": "Product", "name": "Bondi 9", "offers": [{"price": "129990.0", "availability": "https://schema.org/InStock"}]}</script>'
    state = {"props": {"pageProps": {"results": [
        {"displayName": "Hoka Bondi 9 Mujer", "brand": "HOKA", "url": "/p/1", "prices": [{"price": ["105.990"], "crossed": False}, {"price": ["149.990"], "crossed": True}]},
        {"displayName": "No price", "brand": "X", "url": "/p/2", "prices": []}, {"displayName": "Plain", "brand": "HOKA", "url": "/p/3", "prices": [{"price": ["99990"]}]}]}}}
    other = '<script type="application/ld+json">{"@type": "BreadcrumbList", "name": "x"}</script>'
    rows = [("a", "http://x/a", f"<html>{ld}</html>"), ("b", "http://x/b", f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(state)}</script>'),
            ("c", "http://x/c", other), ("d", "http://x/d", "<html>nothing</html>"), ("e", "http://x/e", '<script type="application/ld+json">not json</script>')]
    return spark.createDataFrame(rows, "page_id string, url string, html string")


def test_offers_on_pages(spark):
    got = {(r.page_id, r.position): r for r in K.extract_offers(pages(spark)).collect()}
    assert set(got) == {("a", 0), ("b", 0), ("b", 2)}
    assert (got["a", 0].comp_price, got["a", 0].comp_in_stock) == (129990, True)
    assert (got["b", 0].comp_price, got["b", 0].comp_list_price, got["b", 0].comp_discount) == (105990, 149990, 0.293)


def test_search_replies_and_links(spark):
    results = [{"value": "Bondi 9", "data": {"displayedPrice": 80000, "discountPercentage": 20, "url": "/bondi-9"}},
               {"data": {"description": "Mach 6", "displayedPrice": "59990.0", "url": "https://shop.example/mach"}},
               {"value": "Free", "data": {"displayedPrice": 0, "url": "/free"}}, {"value": "No data"},
               {"value": "Gift", "data": {"displayedPrice": 990, "discountPercentage": 100, "url": None}}]
    rows = [("r", "https://site.example/search?q=x", "  " + json.dumps({"response": {"results": results}})), ("n", None, json.dumps({"response": {"results": results[:1]}})),
            ("z", "https://site.example/z", json.dumps({"response": None})), ("l", "https://site.example/l", json.dumps([1, 2])), ("0", "https://site.example/0", None)]
    got = {(r.page_id, r.position): r for r in K.extract_offers(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert set(got) == {("r", 0), ("r", 1), ("r", 4), ("n", 0)}
    assert [(got["r", i].name, got["r", i].url, got["r", i].comp_price, got["r", i].comp_list_price, got["r", i].comp_discount) for i in (0, 1, 4)] == [
        ("Bondi 9", "https://site.example/bondi-9", 80000, 100000, 0.2), ("Mach 6", "https://shop.example/mach", 59990, 59990, 0.0),
        ("Gift", "https://site.example/search?q=x", 990, 990, 0.0)]
    assert got["n", 0].url == "/bondi-9"
    found = {(r.page_id, r.position): r.url for r in K.extract_offers(pages(spark)).collect()}
    assert found == {("a", 0): "http://x/a", ("b", 0): "http://x/p/1", ("b", 2): "http://x/p/3"}


def test_name_scores(spark):
    cases = [("bondi 9", "bondi 9 blue white", 0.85, 1.0), ("mach 6 black", "black mach 6", 1.0, 1.0), ("bondi 9", "clifton 9", 0.0, 0.85)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, a string, b string").coalesce(1)
    got = [r.s for r in df.select("i", K.name_score("a", "b").alias("s")).orderBy("i").collect()]
    for (a, b, lo, hi), s in zip(cases, got):
        assert lo <= s <= hi, (a, b, s)
    assert got[2] < 0.85


def test_matching(spark):
    ours = spark.createDataFrame([("A", "P", "BONDI 9", "Hoka", "780"), ("A", "Q", "MACH 6", "Hoka", None)], "brand string, codigo_padre string, product_name string, vendor_brand string, ean11 string")
    offers = spark.createDataFrame([
        ("A", "P", "falabella", "1", "Hoka Bondi 9 Mujer", "HOKA", None, 100), ("A", "P", "falabella", "2", "Bondi X", "HOKA", None, 90), ("A", "P", "paris", "3", "Other thing", "Nike", "780", 80),
        ("A", "Q", "paris", "4", "Mach 6", "Nike", None, 70), ("A", "Q", "falabella", "5", "Arahi 7", None, None, 60)],
        "brand string, codigo_padre string, competitor string, offer_id string, name string, offer_brand string, ean11 string, comp_price int")
    got = {(r.codigo_padre, r.competitor): (r.offer_id, r.match_method, r.match_score) for r in K.match_offers(ours, offers).collect()}
    assert got == {("P", "falabella"): ("1", "high_name", 1.0), ("P", "paris"): ("3", "exact_ean", 1.0)}


WEEK = dt.date(2026, 4, 20)


def alerts(spark, rows):
    df = spark.createDataFrame([("A", "P", c, WEEK, p, d, v, s, w) for c, p, d, v, s, w in rows],
                               "brand string, codigo_padre string, centro string, week date, avg_precio_final double, discount_rate double, velocity_4w double, stock_on_hand long, weeks_of_cover double")
    return AL.cross_store_alerts(df).collect()


def test_cross_store_alerts(spark):
    same = ("2001", 100000.0, 0.0, 1.0, None, None)
    assert alerts(spark, [same, ("2002", *same[1:])]) == [] == alerts(spark, [same])
    spread = alerts(spark, [("2001", 150000.0, 0.0, 1.0, None, None), ("2002", 120000.0, 0.0, 3.0, None, None)])
    assert len(spread) == 2 and spread[0].alert_reasons == "price_inconsistency_bm;" and spread[0].sync_price == 127500
    web = alerts(spark, [same, ("2002", *same[1:]), ("AB04", 70000.0, 0.0, 1.0, None, None)])
    assert web[0].alert_reasons == "ecomm_gap;" and web[0].bm_price_spread == 0
    stock = alerts(spark, [("2001", 100000.0, 0.0, 1.0, 0, 0.0), ("2002", 100000.0, 0.0, 1.0, 50, 20.0)])
    assert stock[0].alert_reasons == "stock_imbalance;"
    split = alerts(spark, [("2001", 100000.0, 0.0, 1.0, None, None), ("2002", 100000.0, 0.2, 1.0, None, None)])
    assert split[0].alert_reasons == "discount_spread;markdown_split;"


def test_models(spark, run):
    small = ML.Settings(rounds=3, depth=3, max_bins=32)
    df = run.parent.where("brand = 'SUR'")
    mode, cls, reg = ML.choose_targets(df)
    assert mode == "margin"
    split = ML.holdout_split(df)
    assert split.where("is_holdout").select("week").distinct().count() == 4
    train, test = (split.where(F.col("is_holdout") == h).drop("is_holdout") for h in (False, True))
    c, g = ML.train_classifier(train, cls, small), ML.train_regressor(train, reg, small)
    scored = ML.score_week(test, c, g)
    assert scored.count() == test.count() and set(test.columns) < set(scored.columns)
    assert scored.where("not (markdown_probability between 0 and 1) or not (raw_depth between 0 and 0.6)").count() == 0
    assert ML.auc(ML.score_week(train, c, g), cls)["auc"] > 0.6
    top = ML.feature_importance({"SUR": ML.BrandModels("SUR", mode, cls, reg, c, g)}, spark, 5).collect()
    assert len(top) == 5 and top[0].importance >= top[-1].importance
    assert not {"should_reprice", "optimal_profit"} & {r.feature.split("__")[0] for r in top}
    folds = ML.time_series_folds(df).groupBy("fold", "role").agg(F.max("week").alias("hi"), F.min("week").alias("lo")).collect()
    edge = {(r.fold, r.role): (r.lo, r.hi) for r in folds}
    assert all(edge[f, "train"][1] < edge[f, "validate"][0] for f in range(4))


def test_pages_of_actions(spark, run):
    both = [r.parent_sku + r.store for n in (1, 2) for r in A.page(run.actions, n, 3).collect()]
    assert both == [r.parent_sku + r.store for r in A.order_actions(run.actions).limit(6).collect()]
