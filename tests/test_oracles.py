"""Every query of the reference's own operators against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from loomspark.plans import ingestion
from tests.oracle import connect, differences

OWN = [(n, f, p.ORACLES.get(n)) for p in entry.PLANS for n, f in p.QUERIES.items()]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name,query,sql", OWN, ids=[x[0] for x in OWN])
def test_matches_sql(spark, sf_dir, con, name, query, sql):
    got = query(spark, sf_dir).toPandas()
    if sql is None:
        assert len(got) > 0
    else:
        assert differences(got, con.execute(sql).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


#: Texts without words, null ones, ones of references alone, and signs whose lower case is longer or that only look blank.
ODD = (None, "", " ", "\n", "\t \n", "\u00a0\u3000", "\u200b", "\x1c", "\x85", "\u2028", "İstanbul K Kelvin", "---", "REFERENCES", "References\n[1] a\n[2] b", "REFERENCES\nfoo\nAPPENDIX REFERENCES\nfoo", "1. Methods\nbar")


@pytest.mark.parametrize("name", ["embed_documents", "ingest_outcomes", "reprocess_outcomes"])
def test_odd_texts_match_sql(spark, sf_dir, tmp_path, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(1001 + i, t, "en", "web", None) for i, t in enumerate(ODD)], docs.schema)
    docs.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = ingestion.QUERIES[name](spark, f"{tmp_path}").toPandas()
    assert len(got) == 40 + len(ODD)
    assert differences(got, connect(f"{tmp_path}").execute(ingestion.ORACLES[name]).df()) is None
