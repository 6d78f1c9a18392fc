"""Queries over digest trees of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.operators import merkle as K
from lumenweir.sources.stages import multiset_digest
from lumenweir.sources.tables import stored, table

FIELDS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


def item_digests(df: DataFrame) -> DataFrame:
    return K.value_digests(df, F.col("l_returnflag"), F.concat_ws("|", *FIELDS))


def document_digests(df: DataFrame) -> DataFrame:
    """Texts by source; copies share a digest."""
    return K.value_digests(df, F.col("source"), F.col("text"))


def digest_tree_items(spark, d) -> DataFrame:
    """Every node of the tree over the items of each return flag."""
    return K.digest_tree(stored(item_digests(table(spark, d, "lineitem")), "digests"))


def digest_tree_sources(spark, d) -> DataFrame:
    return K.roots(K.digest_tree(stored(document_digests(table(spark, d, "documents")), "digests")))


def digest_changes(spark, d) -> DataFrame:
    """What tells the items from a later state of them: some supplied by another, some gone, some twice."""
    items = table(spark, d, "lineitem")
    h = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(1000))
    later = items.withColumn("l_suppkey", F.when(h == 1, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))).filter(h != 2)
    later = later.withColumn("_copy", F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return K.changed_values(stored(item_digests(items), "digests"), stored(item_digests(later), "digests"))


def multiset_digests(spark, d) -> DataFrame:
    """One digest for each source's texts, and one for each lang's, without sorting or gathering them."""
    docs = table(spark, d, "documents")
    by = lambda c: docs.groupBy(F.coalesce(c, F.lit("")).alias("name")).agg(F.count("*").alias("n"), multiset_digest(F.col("text")).alias("sha256")).withColumn("field", F.lit(c))
    return by("source").unionByName(by("lang"))


_F = (digest_tree_items, digest_tree_sources, digest_changes, multiset_digests)
QUERIES = {f.__name__: f for f in _F}

TREE = """dep AS (SELECT name, CASE WHEN count(*) <= 64 THEN 0 WHEN count(*) <= 16384 THEN 1 WHEN count(*) <= 4194304 THEN 2 ELSE 3 END AS depth FROM dig GROUP BY 1),
    leaf AS (SELECT name, depth, substr(d, 1, 2 * depth) AS prefix, sum(n) AS n, sha256(string_agg(d || ':' || n, ',' ORDER BY d)) AS sha256 FROM dig JOIN dep USING (name) GROUP BY ALL),
    l3 AS (SELECT * FROM leaf WHERE depth = 3),
    l2 AS (SELECT * FROM leaf WHERE depth = 2 UNION ALL SELECT name, depth, substr(prefix, 1, 4), sum(n), sha256(string_agg(prefix || ':' || sha256, ',' ORDER BY prefix)) FROM l3 GROUP BY ALL),
    l1 AS (SELECT * FROM leaf WHERE depth = 1 UNION ALL SELECT name, depth, substr(prefix, 1, 2), sum(n), sha256(string_agg(prefix || ':' || sha256, ',' ORDER BY prefix)) FROM l2 GROUP BY ALL),
    l0 AS (SELECT * FROM leaf WHERE depth = 0 UNION ALL SELECT name, depth, '', sum(n), sha256(string_agg(prefix || ':' || sha256, ',' ORDER BY prefix)) FROM l1 GROUP BY ALL)"""
ITEM = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, {}, l_returnflag, l_linestatus)"
SQL = {
    "multiset_digests": """WITH x AS (SELECT coalesce(sha256(text), repeat('0', 64)) AS d, unnest([{'field': 'source', 'name': coalesce(source, '')}, {'field': 'lang', 'name': coalesce(lang, '')}]) AS k FROM documents),
        p AS (SELECT k.field AS field, k.name AS name, count(*) AS n, """ + ", ".join(f"sum(('0x' || substr(d, {1 + 15 * i}, 15))::HUGEINT) AS s{i}" for i in range(4)) + """ FROM x GROUP BY ALL)
        SELECT name, n, sha256(concat_ws(':', n, s0, s1, s2, s3)) AS sha256, field FROM p""",
    "digest_tree_items": f"""WITH dig AS (SELECT l_returnflag AS name, sha256({ITEM.format('l_suppkey')}) AS d, count(*) AS n FROM lineitem GROUP BY ALL), {TREE},
        nodes AS (SELECT *, 0 AS level FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3)
        SELECT name, depth, level, prefix, CAST(n AS BIGINT) AS n, sha256 FROM nodes""",
    "digest_tree_sources": f"""WITH dig AS (SELECT coalesce(source, '') AS name, coalesce(sha256(text), repeat('0', 64)) AS d, count(*) AS n FROM documents GROUP BY ALL), {TREE}
        SELECT name, CAST(n AS BIGINT) AS n, sha256 FROM l0""",
    "digest_changes": f"""WITH x AS (SELECT *, (l_orderkey * 7 + l_linenumber) % 1000 AS h FROM lineitem),
        a AS (SELECT l_returnflag AS name, sha256({ITEM.format('l_suppkey')}) AS d, count(*) AS n FROM x GROUP BY ALL),
        b AS (SELECT l_returnflag AS name, sha256({ITEM.format("l_suppkey + CASE WHEN h = 1 THEN 1 ELSE 0 END")}) AS d, CAST(sum(CASE WHEN h = 3 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM x WHERE h <> 2 GROUP BY ALL)
        SELECT name, d, coalesce(a.n, 0) AS stated, coalesce(b.n, 0) AS found FROM a FULL JOIN b USING (name, d) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
}
