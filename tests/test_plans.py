"""Plan shapes that must hold at scale."""

from pyspark.sql import functions as F

from cinderleaf.operators import audit, catalog
from cinderleaf.operators.retrieval import vector_topk
from cinderleaf.plans.corpus import quality_report
from cinderleaf.queries.views import view


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quality_report_reads_two_columns_and_stays_in_the_jvm(spark, sf):
    plan = physical(quality_report(spark.read.parquet(f"{sf}/documents.parquet"), "lang"))
    assert "ReadSchema: struct<text:string,lang:string>" in plan
    assert "Python" not in plan
    assert plan.count("Exchange") == 1


def test_filters_reach_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'")
    plan = physical(quality_report(docs, "lang"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan


def test_top_rows_per_group_are_cut_before_the_shuffle(spark, sf):
    places = view(spark, sf, "places")
    for df in (
        catalog.district_recommendations(places, "ord"),
        audit.keep_last_n(places, 3, ["ord"], ["category_id"]),
    ):
        assert "WindowGroupLimit" in physical(df)


def test_top_vectors_are_cut_before_the_shuffle(spark, sf):
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = physical(vector_topk(vecs, vecs, 2, query_id="vec_id", doc_id="vec_id"))
    assert "MapInPandas" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_select_spots_has_no_cross_join(spark, sf):
    plan = physical(catalog.select_spots(view(spark, sf, "places"), "beach"))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_page_and_tail_sort_only_what_they_return(spark, sf):
    log = view(spark, sf, "audit")
    assert "TakeOrderedAndProject" in physical(audit.audit_page(log, "event_id", 2))
    assert "TakeOrderedAndProject" in physical(audit.log_tail(log, "event_id").select(F.col("event_id")))


def test_cautions_of_a_district_are_not_one_task(spark, monkeypatch):
    """All spots lie in one district; before, one task joined them with all stops there."""
    from cinderleaf.operators import routes

    paths = spark.createDataFrame([(f"r{i}", ["kandy", "galle"]) for i in range(30)], "route string, path array<string>")
    spots = spark.range(2000).selectExpr(
        "'kandy' AS district_id", "id AS ord", "concat('s', id) AS name",
        "CASE id % 3 WHEN 0 THEN 'Dangerous' WHEN 1 THEN 'Moderate' ELSE 'Safe' END AS safety_level",
    ).repartition(4)
    alerts = spark.createDataFrame([], "district string, ord long, level string, hazard string, bulletin string")
    found = []
    for fits in (True, False):
        monkeypatch.setattr(routes, "fits_broadcast", lambda df, fits=fits: fits)
        out = routes.route_cautions(paths, "route", spots, alerts).where("stage = 0")
        tasks = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert not fits or max(tasks) < 0.5 * sum(tasks)  # small shuffle partitions are put together again
        found.append(sorted(tuple(r) for r in out.collect()))
    assert found[0] == found[1] and len(found[0]) == 30 * 667
