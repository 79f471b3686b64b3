"""Dimension files: names in any case, byte-order marks, zeros, bad rows, defaults."""

import pytest

from cellweave.sources import dimensions as D


def put(tmp_path, name, text, **how):
    (tmp_path / name).write_text(text, **how)
    return str(tmp_path / name)


def test_files_and_factors(spark, tmp_path):
    centroids = D.read_centroids(spark, put(tmp_path, "c.csv", "﻿STATEFP,COUNTYFP,COUNAME,LATITUDE,LONGITUDE\n1,1,Autauga,+32.5,-86.5\n48,301,Loving,31.8,-103.6\n4,7,Gila,x,-110\n", encoding="utf-8"))
    assert sorted(map(tuple, centroids.collect())) == [("01001", 32.5, -86.5), ("48301", 31.8, -103.6)]
    betas = D.read_exponents(spark, put(tmp_path, "b.csv", "name,GEOID,local_beta\nA,01001,0.5\nB,99999,2\nC,,1\n"))
    assert sorted(map(tuple, betas.collect())) == [("01001", 0.5), ("99999", 2.0)]
    path = put(tmp_path, "p.csv", "geoid,year,trend_pop\n01001,2004,400\n01001,2005,100\n48301,2005,0\n48301,bad,5\n77777,2004,9\n")
    assert sorted(map(tuple, D.read_population(spark, path, 2005, 2005).collect())) == [("01001", 2005, 100), ("48301", 2005, 1)]
    got = {(r.geoid, r.year): r.factor for r in D.county_factors(centroids, betas, D.read_population(spark, path), 2004).collect()}
    assert got == {("01001", 2004): 1.0, ("01001", 2005): 2.0, ("48301", 2004): 1.0, ("48301", 2005): 1.0}


def test_counts_and_missing_columns(spark, tmp_path):
    path = put(tmp_path, "s.csv", "geoid,year,total,county_name,state_name\n1,2005,3,New,T\n1,2004,2,Old,S\n2,2004,x,a,b\n")
    assert sorted(map(tuple, D.read_counts(spark, path).collect())) == [("1", 2004, 2, "Old", "S"), ("1", 2005, 3, "Old", "S")]
    with pytest.raises(ValueError, match="local_beta"):
        D.read_exponents(spark, path)
