"""Queries on the whole graph, held against brute force."""

import os
from collections import defaultdict

import duckdb
import pytest

from gristmill.operators import retrieval as op
from gristmill.plans import base, registry
from gristmill.plans import retrieval as plans

from .conftest import SF


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_ppr_walks_all_orders_from_fifty_seeds(spark):
    con = duckdb.connect()
    rows = lambda sql: con.execute(sql.replace("@", SF)).fetchall()
    pairs = rows("SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM '@/nation.parquet' UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM '@/customer.parquet' UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM '@/supplier.parquet'")
    pairs += rows("SELECT 's' || l_suppkey, 'p' || l_partkey FROM '@/lineitem.parquet' UNION ALL SELECT 'c' || o_custkey, 'p' || l_partkey FROM '@/orders.parquet' JOIN '@/lineitem.parquet' ON o_orderkey = l_orderkey")
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    assert {(r["src"], r["dst"]) for r in base.edges(spark, SF).collect()} == set(pairs)
    file_of = {f"{k}{n}": str(n % 50) for k, t, c in (("c", "customer", "c_custkey"), ("s", "supplier", "s_suppkey"), ("p", "part", "p_partkey")) for (n,) in rows(f"SELECT {c} FROM '@/{t}.parquet'")}
    weight = defaultdict(dict)
    for r in op.link_entities(plans.asked(spark, SF), base.nodes(spark, SF), 50).collect():
        weight[r["query"]][r["node_id"]] = r["weight"]
    want = {}
    for query, seeds in weight.items():
        assert len(seeds) == 50
        start = {n: w / sum(seeds.values()) for n, w in seeds.items()}
        rank = start
        for _ in range(20):
            after = defaultdict(float)
            for n, x in rank.items():
                for m in near[n]:
                    after[m] += 0.85 * x / len(near[n])
            home = 1 - sum(after.values())
            for n, p in start.items():
                after[n] += p * home
            rank = after
        of_file = defaultdict(float)
        for n, x in rank.items():
            if n in file_of and round(x, 4) >= 0.001:
                of_file[file_of[n]] += round(x, 4)
        top = sorted(((-round(s, 4), f) for f, s in of_file.items()))[:10]
        want |= {(query, f): (i, s / top[0][0]) for i, (s, f) in enumerate(top)}
    got = {(r["query"], r["file_id"]): (r["rank"], r["score"]) for r in registry.queries()["op_ppr"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(want) > 10
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
