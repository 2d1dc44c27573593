import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """documents-shaped rows from (doc_id, text, ...) tuples, with columns whose names operators use inside."""

    def make(rows, **more):
        full = [(r + (None,) * 5)[:4] + (len(r[1]) if r[1] is not None else None,) for r in (tuple(x) for x in rows)]
        df = spark.createDataFrame(full, DOCUMENTS)
        for name, value in more.items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return make


def words(n, seed=0, alphabet="abcdefghijklmnopqrstuvwxyz"):
    import random

    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(2, 9))) for _ in range(n)]
