from corpusloom.sources.tables import table
from corpusloom.streaming import events as S


def test_cooldown_resumes(spark, sf):
    batch = table(spark, sf, "events")
    stream = S.read_events(spark, sf, batch.schema, glob="events.parquet")
    cooled = S.cooled_down(stream.selectExpr("user_id", "cast(ts as timestamp) as ts"), 24)
    import uuid

    name = f"cool_{uuid.uuid4().hex}"
    S.run_available(cooled, name).awaitTermination()
    S.run_available(cooled, name).awaitTermination()  # nothing new, nothing twice
    from corpusloom.sources.stages import shared_folder

    got = spark.read.parquet(f"{shared_folder(spark)}/streams/{name}/rows").toPandas().sort_values(["user_id", "ts"])
    assert 0 < len(got) <= batch.count()
    gaps = got.groupby("user_id")["ts"].diff().dropna()
    assert (gaps.dt.total_seconds() >= 24 * 3600).all()
