import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session", autouse=True)
def checkpoint_folder(spark, tmp_path_factory):
    """Tests name their own folder, as no cluster does."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(tmp_path_factory.mktemp("checkpoints").as_uri())


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) with further columns, some of which carry names that operators use inside."""

    def build(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        extra = {"block": F.lit(1), "node": F.lit("x"), "kept": F.lit(None).cast("boolean"), "n_words": F.lit(-1), "tokens": F.lit("t")}
        return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **extra})

    return build
