import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        folder = str(tmp_path_factory.mktemp("shared"))
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture
def make_docs(spark):
    def make(rows):
        """Documents from (doc_id, text) pairs, or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def folder_of(tmp_path, docs, **others):
    """A folder of tables like the given ones."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, df in others.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)
