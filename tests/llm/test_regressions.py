"""Cases that earlier forms of the operators got wrong."""

import numpy as np
import pytest


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("n, shared", [(1, True), (2, False), (2, True), (12, True)])
def test_substrings_of_few_documents_over_many_partitions(spark, many_partitions, n, shared):
    """Most partitions hold no document, most documents no open window."""
    from cellweave.llm.substrings import repeated_substrings

    rng = np.random.default_rng(n)
    letters = lambda m: "".join(chr(97 + x) for x in rng.integers(0, 26, m))
    passage = letters(90) if shared else ""
    rows = [(i, letters(69 + i) + chr(65 + i) + passage) for i in range(n)]
    out = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: (70 + i + len(passage), len(passage) if i else 0) for i in range(n)}


def test_substrings_refuse_lengths_whose_contexts_can_collide(spark):
    from cellweave.llm.substrings import repeated_substrings

    docs = spark.createDataFrame([(1, "a" * 600)], "doc_id long, text string")
    for length in (16, 513):
        with pytest.raises(ValueError):
            repeated_substrings(docs, length)


def test_nearest_past_a_doubles_range_is_never_undefined(spark):
    """At 1e200 every product overflows; scores are infinities of the true sign, or the true sum where that fits."""
    from cellweave.llm import vectors as V

    rng = np.random.default_rng(15)
    x = rng.normal(size=(60, 6))
    x[7] = [1, -1, 0, 0, 0, 0]
    x[20] = [1, 1, 0, 0, 0, 0]
    rows = [(i, v.tolist()) for i, v in enumerate(x * 1e200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = V.nearest(table, table.where("vec_id % 20 = 0"), k=60).toPandas()
    sign = np.sign(np.einsum("nd,nd->n", x[out.query_id], x[out.vec_id]))
    assert len(out) == 3 * 59 and out.score.notna().all()
    assert (out.score == np.where(sign == 0, 0, sign * np.inf)).all()
    assert out[(out.query_id == 20) & (out.vec_id == 7)].score.item() == 0
    for _, part in out.sort_values("rank").groupby("query_id"):
        assert part.score.is_monotonic_decreasing


def test_licence_sql_states_the_query(spark, tmp_path):
    """Every known text, wrapped, spelt otherwise, under copyright lines of many forms, and lines that only look like one."""
    import textwrap

    import duckdb

    from cellweave.llm import licenses as L

    heads = ["", "Copyright (c) 2019 A. Holder", "COPYRIGHT 1999-2004, B", "© 2001 C", "(c) Copyright D 2010", "(C) 2011 E", "  copyright: Foo Bar Ltd", "Copyright holders may not be named", "copyright notice", "(c) you must keep it", "(c) Example Inc", "copyright , 1990", "Copyright <YEAR> <OWNER>", "copyright law applies", "Copyrights F"]
    texts = [f"{h}\n\n{t}" if h else t for k, (_, t) in enumerate(L.ALL_TEXTS) for h in (heads if k % 7 == 0 else heads[:2])]
    texts += ["\n".join(textwrap.wrap(t, 60)) for _, t in L.ALL_TEXTS if len(t) < 20_000]
    texts += [t.replace("license", "licence").upper() for _, t in L.ALL_TEXTS if len(t) < 20_000] + [None, "", "Copyright (c) 2020 X", "a\nReleased under the MIT Licence.\nLicensed under CC BY 4.0.\n", "über Licence ©"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(L.OP6_SQL)
    got = L.op6_licenses(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
    assert sum(r.license_id is not None for r in got) > 60
