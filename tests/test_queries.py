"""Every engine query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkmoat import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: "" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.6g}" if isinstance(v, float) else str(bool(v)) if type(v).__name__ in ("bool", "bool_") else str(v)
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        want = con.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() == 200


#: Addresses with noise after them, as in documents whose words all end in signs, and at the limits of a rule by itself.
NOISY = [
    "Mail%%% one.24@mail1.example.com%%% two.25@mail2.example.com### end", "see a@b.com+ or +a@b.com", "a@b.com%20c and c@d.org%", "..a@b.com.. and a.@b.com", "a@b.com%@c.com a@b.com_ a@b.com-",
    "x@" + "y" * 70 + ".com " + "z" * 65 + "@b.com", "a@xn--p1ai.xn--p1ai b@xn--p1ai.com", " ".join(f"u{i}@d.com" for i in range(300)), "x@y " * 130 + "real@mail.com", "caf\u00e9a@b.com\u00e9 \U0001f600\r\na@b.com", None, "",
]


@pytest.fixture(scope="module")
def noisy(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("noisy"))
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or "")) for i, t in enumerate(NOISY)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(len(NOISY) + 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    return folder, c


@pytest.mark.parametrize("name", ["email_address_documents", "findings_by_rule", "findings_by_lang_source_cube", "flagged_vs_labels", "top_documents_by_findings", "finding_density_percentiles"])
def test_noisy_addresses(spark, noisy, name):
    folder, c = noisy
    got, want = entry.queries()[name](spark, folder).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    assert len(want) and rows(got) == rows(want)


def test_rule_by_itself_keeps_its_ends(spark):
    """The documented rule ends an address before ``%`` and ``+`` and has a limit; only the queries over documents ask for whole runs."""
    docs = spark.createDataFrame([(0, "a@b.com%%%", "input", None), (1, "x@y " * 130, "input", None)], "doc_id long, text string, scope string, prompt_context string")
    by_itself, whole = (queries.engine.scan(docs, queries.engine.only("pii.email_address", options=o)).orderBy("doc_id").collect() for o in ({}, queries.WHOLE_RUNS))
    assert [[(f.start, f.end, f.action) for f in r.findings] for r in by_itself] == [[(0, 7, "redact")], [(513, 520, "block")]]
    assert [len(r.findings) for r in whole] == [0, 0]
