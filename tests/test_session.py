from pathlib import Path

from docloom.session import ensure_checkpoint_dir, materialize, parallelism, release


def test_tables_go_to_the_shared_folder_and_can_be_released(spark):
    shared = ensure_checkpoint_dir(spark)
    assert shared == spark.conf.get("spark.checkpoint.dir")
    release(spark)
    df = materialize(spark.range(10).selectExpr("id", "cast(null as string) as s"))
    assert df.count() == 10 and len(list(Path(shared).glob("docloom-*"))) == 1
    assert release(spark) == 1 and not list(Path(shared).glob("docloom-*"))
    assert parallelism(spark) >= 4
