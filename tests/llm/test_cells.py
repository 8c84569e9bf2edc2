from pyspark.sql import functions as F

from tallyline.llm import components, simhash


def test_rows_of_all_cells_are_never_broadcast(spark, monkeypatch):
    plans = []

    def watched(stored):
        def keep(df, *rest):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return stored(df, *rest)

        return keep

    whole = simhash.stored
    monkeypatch.setattr(simhash, "stored", watched(whole))
    monkeypatch.setattr(components, "stored", watched(whole))
    points = whole(spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.xxhash64((F.col("id") / 3).cast("long")) + F.col("id") % 3).otherwise(F.xxhash64("id")).alias("fp"), "id"), "points")
    found = simhash.link_components(points)
    named = found.withColumnRenamed("id", "vertex")
    cells = simhash.shared_cells(points)
    pairs = [simhash.head_pairs(cells), simhash.mixed_pairs(cells, named)]
    plans += [p._jdf.queryExecution().executedPlan().toString() for p in pairs]
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "[cell#" in line]
    assert len(joins) >= 8 and not [j for j in joins if "Broadcast" in j]
    assert found.count() == 3000 and found.where("component < id").count() > 0
