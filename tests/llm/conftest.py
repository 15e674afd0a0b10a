import duckdb
import pytest

SF = "/root/testdata/sf0.001"

#: Names that the operators use inside, as extra columns of the input.
CLASHES = "id n g k1 k2 at many spans part row offset shard slot size lang_pred held group node component rate copies h"


@pytest.fixture(scope="session")
def tables():
    """Rows of the smallest tables as Python values."""

    def rows(sql: str) -> list[tuple]:
        with duckdb.connect() as db:
            for name in ("documents", "pages", "embeddings", "labels"):
                db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
            return db.execute(sql).fetchall()

    return rows


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text[, lang]) rows, with columns whose names clash."""

    def build(rows: list[tuple]):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        for name in CLASHES.split():
            df = df.selectExpr("*", f"'x' as {name}")
        return df

    return build


EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (None, "no key at all"), (7, None),
    (8, "é漢字   wörter, mit marks!  two  spaces"), (9, "word " * 20_000), (9, "word " * 20_000), (10, "1234 5678 !!"),
]


@pytest.fixture(scope="session")
def edges():
    return list(EDGES)
