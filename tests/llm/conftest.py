import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Write documents (and further tables) as the queries read them."""

    def write(documents, schema="doc_id long, text string, lang string, source string, n_chars long", **more):
        spark.createDataFrame(documents, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for name, (rows, kind) in {"benchmark": ([], "item_id long, text string"), "labels": ([], "doc_id long, quality int, toxic int")}.items():
            spark.createDataFrame(more.get(name, rows), kind).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
