"""Keywords, commands and expansion of queries that the given tables do not hold, against the registered SQL."""

import duckdb
import pytest

from quern.plans import queries as q

QUERIES = [
    "How to configure VLAN 20 and acl on interface 10.1.2.3/24 with permit 10.0.0.1-10.0.0.9?", "配置 acl 禁止192.168.1.1访问，firewall启用", "PFC and ECN for RoCE on Nvidia switch: enable QoS", "BGP neighbor 10.0.0.1 10.0.0.1/32 error 故障", "",
    None, "show ip route 5 route ROUTE access-list Access-List xacl acl_x", "the of and 的 了", "MLAGPeer bondX1 aB2c ABc  DNS，DNS。status", "command 命令 log LOG monitor-log metric 300.1.1.1 1.1.1.256 01.02.03.04", "什么是优先级流控 Cumulus nv set", "Encrypt VPN tls SSL; 10.1.1.1 - 10.1.1.9",
]


@pytest.mark.parametrize("name", ["query_keywords", "query_commands", "query_expansion"])
def test_rich_queries_equal_the_sql(spark, tmp_path, name):
    rows = [(i, 2 * k, "user", text) for i in range(2) for k, text in enumerate(QUERIES)] + [(i, 1, "assistant", "acl vlan") for i in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = q.queries()[name](spark, str(tmp_path))
    columns = sorted(found.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    rows = sorted(tuple(r[c] for c in columns) for r in found.collect())
    assert rows == want and len(rows) == 2 * len(QUERIES)
    varying = {"query_keywords": "coarse_intent", "query_commands": "groups", "query_expansion": "domain_intent"}[name]
    assert len({r[columns.index(varying)] for r in rows}) >= 4
