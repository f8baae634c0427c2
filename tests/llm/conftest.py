import pytest
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)



@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang); the other columns follow."""

    def build(*rows):
        filled = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(filled, DOCUMENTS)

    return build


@pytest.fixture
def clashing(documents):
    """Documents with further columns by the names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["bits", "node", "key", "keys", "high", "low", "first", "refs", "mark", "id", "runs", "bucket", "component_id", "kept",
             "n_lines", "n_words", "held_out", "score", "spans", "base", "ids", "lost", "holder", "lost_", "n", "a", "b", "start"]

    def build(*rows):
        return documents(*rows).withColumns({n: F.lit("x") for n in names})

    return build


@pytest.fixture
def vectors(spark):
    schema = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("label", LongType())])

    def build(*rows):
        return spark.createDataFrame([(i, v, 0) for i, v in rows], schema)

    return build
