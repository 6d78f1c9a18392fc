"""Queries over exclusions, duplicates, leakage groups, splits, balancing and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.functions import identity as I
from lumenweir.functions import text as T
from lumenweir.operators import curation as C
from lumenweir.operators.similarity import shingles, stored_clone_pairs, without_keys
from lumenweir.plans.corpus import CORPUS, ROWS, corpus, rows
from lumenweir.sources.tables import stored, table

LEAST = {"train": 3, "validation": 1, "test": 2}
#: Gates of the seed search, which some seeds miss on the driver's tables.
SPLIT_LEAST = {"train": 28, "validation": 6, "test": 11}


def exact_dedup_conflict(spark, d) -> DataFrame:
    done = C.exact_duplicates(corpus(spark, d).select("identity", "path", "label", "collection"))
    return done.groupBy("collection", "label", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def exclusion_cascade(spark, d) -> DataFrame:
    c = corpus(spark, d)
    rules = [
        ("excluded_origin", F.col("origin").isin("src3")),
        ("unreadable_source", F.trim("text") == ""),
        ("label_leaking_identifiers", F.contains("text", F.lit("###"))),
        ("overlength_source", F.size(T.word_tokens(F.col("text"))) > 600),
    ]
    return C.with_reason(c, rules).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "collection", "label").agg(F.count("*").alias("n"))


def exclusion_pivot(spark, d) -> DataFrame:
    return exclusion_cascade(spark, d).groupBy("reason").pivot("label", ["PRESENT", "ABSENT"]).agg(F.sum("n")).select("reason", F.coalesce("PRESENT", F.lit(0)).alias("present"), F.coalesce("ABSENT", F.lit(0)).alias("absent"))


def family_inheritance(spark, d) -> DataFrame:
    got = C.families(corpus(spark, d).select("identity", "path", "origin", "collection"), F.col("collection") == "en")
    return got.filter(F.size("families") > 0).select("path", "identity", F.array_join("families", ",").alias("families"))


def near_duplicate_pairs(spark, d) -> DataFrame:
    """Pairs between the first documents of each shingle set and length, and each further document with the first one of its own."""
    docs = table(spark, d, "documents").select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    docs = stored(docs.select("doc_id", F.size("w").alias("n"), F.array_sort(shingles(F.col("w"))).alias("grams")), "shingles").filter(F.size("grams") > 0)
    docs = docs.withColumns({"a": F.xxhash64("grams"), "b": F.xxhash64(F.lit(7), "grams")})
    thin = docs.select("doc_id", "a", "b", "n", F.size("grams").cast("bigint").alias("shared"))
    first = stored(thin.groupBy("a", "b", "n").agg(F.min("doc_id").alias("left_doc"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "classes")
    copies = stored(thin.join(first, ["a", "b", "n"]).filter("doc_id > left_doc"), "copies")
    one = without_keys(docs, copies.select("doc_id", "a", "b", "n")).select(F.col("doc_id").alias("key"), "n", "grams")
    pairs = stored_clone_pairs(one).withColumnRenamed("left", "left_doc").withColumnRenamed("right", "right_doc")
    return pairs.unionByName(copies.select("left_doc", F.col("doc_id").alias("right_doc"), "shared", F.lit(1.0).alias("score")))


def group_rows(spark, d) -> DataFrame:
    w = T.words(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), I.list_digest(w).alias("skeleton"), w.alias("tokens"), F.when(F.col("source").isin("src7", "src11"), F.col("source")).alias("family"))


def leakage(spark, d) -> DataFrame:
    r = stored(group_rows(spark, d), "group_rows")
    return C.grouped(r, C.leakage_edges(r, min_tokens=5))


def leakage_groups(spark, d) -> DataFrame:
    return leakage(spark, d).select(F.col("key").alias("doc_id"), "root", "group_id", "members")


def group_members_hist(spark, d) -> DataFrame:
    return leakage(spark, d).select("root", "members").distinct().groupBy("members").agg(F.count("*").alias("n_groups"))


def edge_forest(spark, d) -> DataFrame:
    r = stored(group_rows(spark, d), "group_rows")
    return C.spanning_forest(stored(C.leakage_edges(r, min_tokens=5), "edges")).select("left", "right", "reason")


def hash_group_split(spark, d) -> DataFrame:
    return C.split_cells(rows(spark, d))


def partition_summary(spark, d) -> DataFrame:
    return rows(spark, d).groupBy("partition", "label").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups"), F.countDistinct("collection").alias("collections"))


def split_gates(spark, d) -> DataFrame:
    return C.gates(rows(spark, d), LEAST, 4)


def split_rows(spark, d) -> DataFrame:
    """rows() in groups of about eight texts, without their partition."""
    return rows(spark, d).drop("partition").withColumn("group_id", F.substring("group_id", 1, 2))


def stratified_group_split(spark, d) -> DataFrame:
    r = stored(split_rows(spark, d), "strata_rows")
    out, seed, _ = C.stratified_group_split(r, 8, range(42, 62), SPLIT_LEAST)
    return out.groupBy("partition", "collection", "label").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups")).withColumn("seed", F.lit(seed).cast("int"))


def split_attempts(spark, d) -> DataFrame:
    r = stored(split_rows(spark, d), "strata_rows")
    return C.seed_attempts(r, 8, range(42, 62), SPLIT_LEAST)[1]


def balanced_match_rank(spark, d) -> DataFrame:
    return C.balanced_ranks(rows(spark, d), 42)


def match_level_hist(spark, d) -> DataFrame:
    return balanced_match_rank(spark, d).groupBy("match_level").agg(F.count("*").alias("n"))


def balanced_match_greedy(spark, d) -> DataFrame:
    return C.balanced_greedy(rows(spark, d), [["version"], []], 42)


def pair_removal(spark, d) -> DataFrame:
    m = stored(balanced_match_rank(spark, d), "pairs")
    pick = I.drawn(F.concat(F.lit("t:"), F.col("query_id").cast("string")), 8)
    state = rows(spark, d).select("query_id", F.when(pick == 0, "invalid").when(pick == 1, "disagreed").otherwise("accepted").alias("status"), (F.col("source_tokens") > 900).alias("too_long"))
    return C.pair_removal(m.select(F.col("case_id").alias("left"), F.col("control_id").alias("right")), state).withColumn("reason", F.coalesce("reason", F.lit("kept")))


def pilot_sample(spark, d) -> DataFrame:
    return C.pilot_sample(rows(spark, d).filter("partition = 'train'"), 6, 42)


_F = (exact_dedup_conflict, exclusion_cascade, exclusion_pivot, family_inheritance, near_duplicate_pairs, leakage_groups, group_members_hist, edge_forest, hash_group_split, partition_summary, split_gates, stratified_group_split, split_attempts, balanced_match_rank, match_level_hist, balanced_match_greedy, pair_removal, pilot_sample)
QUERIES = {f.__name__: f for f in _F}

CASCADE = f"""WITH {CORPUS}, x AS (SELECT collection, label, CASE WHEN origin = 'src3' THEN 'excluded_origin' WHEN trim(text) = '' THEN 'unreadable_source' WHEN contains(text, '###') THEN 'label_leaking_identifiers'
    WHEN len(regexp_extract_all(text, '[A-Za-z0-9]+')) > 600 THEN 'overlength_source' ELSE 'kept' END AS reason FROM corpus)"""
PAIRS = r"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i+4], chr(31))))) AS g FROM w WHERE len(w) >= 5),
    m AS (SELECT doc_id, n, count(*) AS m, md5(string_agg(CAST(g AS VARCHAR), ',' ORDER BY g)) AS s FROM g GROUP BY ALL),
    one AS (SELECT min(doc_id) AS doc_id FROM m GROUP BY s, n),
    k AS (SELECT g.doc_id, g.g FROM g JOIN one USING (doc_id)),
    sh AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS shared FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    pairs AS (SELECT l, r, shared, shared / (x.m + y.m - shared) AS score FROM sh JOIN m x ON x.doc_id = l JOIN m y ON y.doc_id = r
      WHERE least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) AND least(x.m, y.m) >= 0.85 * greatest(x.m, y.m) AND shared / (x.m + y.m - shared) >= 0.85)"""
GROUPS = PAIRS + r""",
    fam AS (SELECT doc_id, CASE WHEN source IN ('src7', 'src11') THEN source END AS f, w FROM documents JOIN w USING (doc_id)),
    near_reps AS (SELECT l, r FROM pairs),
    edges AS (SELECT min(doc_id) OVER (PARTITION BY f) AS a, doc_id AS b FROM fam WHERE f IS NOT NULL
      UNION SELECT min(doc_id) OVER (PARTITION BY array_to_string(w, chr(31))) AS a, doc_id AS b FROM fam
      UNION SELECT l, r FROM near_reps
      UNION SELECT min(doc_id) OVER (PARTITION BY s), doc_id FROM m),
    both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    reach(n, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON reach.v = both_ways.a),
    roots AS (SELECT n AS doc_id, min(v) AS root FROM reach GROUP BY 1),
    names AS (SELECT root, sha256('[' || string_agg('"' || doc_id || '"', ',' ORDER BY CAST(doc_id AS VARCHAR)) || ']') AS group_id, count(*) AS members FROM roots GROUP BY 1)"""
CLONES = PAIRS.replace("one AS (SELECT min(doc_id) AS doc_id FROM m GROUP BY s, n)", "one AS (SELECT min(doc_id) AS doc_id FROM w WHERE len(w) >= 5 GROUP BY array_to_string(w, chr(31)))")
FOREST = CLONES + r""",
    fam AS (SELECT doc_id, CASE WHEN source IN ('src7', 'src11') THEN source END AS f, w FROM documents JOIN w USING (doc_id)),
    edges AS (SELECT min(doc_id) OVER (PARTITION BY f) AS l, doc_id AS r, 0 AS rank, 'declared_family' AS reason FROM fam WHERE f IS NOT NULL
      UNION SELECT min(doc_id) OVER (PARTITION BY array_to_string(w, chr(31))), doc_id, 1, 'exact_skeleton' FROM fam
      UNION SELECT l, r, 2, 'near_clone' FROM pairs),
    e AS (SELECT *, row_number() OVER (ORDER BY rank, l, r) AS k FROM edges WHERE l <> r),
    ways AS (SELECT k, l AS a, r AS b FROM e UNION ALL SELECT k, r, l FROM e),
    reach(k, v) AS (SELECT k, l FROM e UNION SELECT reach.k, ways.b FROM reach JOIN ways ON ways.a = reach.v AND ways.k < reach.k)"""
SPLIT = f"""WITH {ROWS}, x AS (SELECT * EXCLUDE (group_id, partition), substr(group_id, 1, 2) AS group_id FROM r),
    cells AS (SELECT group_id, collection, label, collection || '|' || label AS stratum, count(*) AS n FROM x GROUP BY ALL),
    own AS (SELECT group_id, arg_min(stratum, (-n, stratum)) AS stratum, sum(n) AS w FROM cells GROUP BY 1),
    each_seed AS (SELECT *, unnest(range(42, 62)) AS seed FROM own), o AS (SELECT *, sha256(seed || ':' || group_id) AS h FROM each_seed),
    line AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY seed, stratum ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (PARTITION BY seed, stratum) AS total FROM o),
    placed AS (SELECT seed, group_id, CASE WHEN fold IN (0, 1) THEN 'test' WHEN fold = 2 THEN 'validation' ELSE 'train' END AS partition FROM (SELECT *, (2 * before + w) * 8 // (2 * total) AS fold FROM line)),
    dealt AS (SELECT * FROM cells JOIN placed USING (group_id)),
    strata AS (SELECT seed, partition, label, count(*) AS collections, min(n) AS least_rows FROM (SELECT seed, partition, label, collection, sum(n) AS n FROM dealt GROUP BY ALL) GROUP BY ALL),
    groups AS (SELECT seed, partition, label, count(DISTINCT group_id) AS groups FROM dealt GROUP BY ALL),
    attempts AS (SELECT CAST(seed AS INTEGER) AS seed, partition, label, groups, collections, CAST(least_rows AS BIGINT) AS least_rows, groups >= CASE partition WHEN 'train' THEN 28 WHEN 'validation' THEN 6 ELSE 11 END AND collections = (SELECT count(DISTINCT collection) FROM cells) AS passed FROM groups JOIN strata USING (seed, partition, label)),
    good AS (SELECT min(seed) AS seed FROM (SELECT seed FROM attempts WHERE passed GROUP BY 1 HAVING count(*) = 6))"""
RANKS = f"""WITH {ROWS}, c AS (SELECT *, count_if(label = 'PRESENT') OVER w AS p, count_if(label = 'ABSENT') OVER w AS a, sha256('[42,"' || query_id || '"]') AS o FROM r WINDOW w AS (PARTITION BY partition, collection)),
    x AS (SELECT *, label = CASE WHEN p < a THEN 'PRESENT' ELSE 'ABSENT' END AS is_case FROM c),
    k0 AS (SELECT *, row_number() OVER (PARTITION BY partition, collection, version, is_case ORDER BY o) AS k FROM x),
    m0 AS (SELECT s.partition, s.collection, s.query_id AS case_id, t.query_id AS control_id FROM k0 s JOIN k0 t ON s.is_case AND NOT t.is_case AND s.partition = t.partition AND s.collection = t.collection AND s.version = t.version AND s.k = t.k),
    k1 AS (SELECT *, row_number() OVER (PARTITION BY partition, collection, is_case ORDER BY o) AS k FROM x WHERE query_id NOT IN (SELECT case_id FROM m0 UNION SELECT control_id FROM m0)),
    m1 AS (SELECT s.partition, s.collection, s.query_id AS case_id, t.query_id AS control_id FROM k1 s JOIN k1 t ON s.is_case AND NOT t.is_case AND s.partition = t.partition AND s.collection = t.collection AND s.k = t.k),
    matched AS (SELECT *, CAST(0 AS BIGINT) AS match_level FROM m0 UNION ALL SELECT *, 1 FROM m1)"""
SQL = {
    "exact_dedup_conflict": f"""WITH {CORPUS}, x AS (SELECT *, min(path) OVER w AS keep, min(label) OVER w <> max(label) OVER w AS conflict FROM corpus WINDOW w AS (PARTITION BY identity))
        SELECT collection, label, CASE WHEN conflict THEN 'conflicting_duplicate' WHEN path <> keep THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS n FROM x GROUP BY ALL""",
    "exclusion_cascade": CASCADE + " SELECT reason, collection, label, count(*) AS n FROM x GROUP BY ALL",
    "exclusion_pivot": CASCADE + " SELECT reason, CAST(count_if(label = 'PRESENT') AS BIGINT) AS present, CAST(count_if(label = 'ABSENT') AS BIGINT) AS absent FROM x GROUP BY ALL",
    "family_inheritance": f"""WITH {CORPUS} SELECT min(path) AS path, identity, string_agg(DISTINCT origin, ',' ORDER BY origin) FILTER (collection = 'en') AS families FROM corpus GROUP BY identity HAVING count_if(collection = 'en') > 0""",
    "near_duplicate_pairs": f"WITH {PAIRS} SELECT l AS left_doc, r AS right_doc, shared, round_even(score, 4) AS score FROM pairs UNION ALL SELECT * FROM (SELECT min(doc_id) OVER (PARTITION BY s, n) AS left_doc, doc_id AS right_doc, m AS shared, CAST(1 AS DOUBLE) AS score FROM m) WHERE left_doc < right_doc",
    "leakage_groups": f"WITH RECURSIVE {GROUPS} SELECT doc_id, root, group_id, members FROM roots JOIN names USING (root)",
    "group_members_hist": f"WITH RECURSIVE {GROUPS} SELECT members, count(*) AS n_groups FROM names GROUP BY 1",
    "edge_forest": f"WITH RECURSIVE {FOREST} SELECT l AS left, r AS right, reason FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.k = e.k AND reach.v = e.r)",
    "stratified_group_split": f"{SPLIT} SELECT partition, collection, label, count(*) AS n, count(DISTINCT group_id) AS groups, seed FROM x JOIN placed USING (group_id) JOIN good USING (seed) GROUP BY ALL",
    "split_attempts": f"{SPLIT} SELECT * FROM attempts",
    "hash_group_split": f"""WITH {ROWS}, e AS (SELECT DISTINCT partition, collection FROM r), l AS (SELECT unnest(['PRESENT', 'ABSENT']) AS label)
        SELECT e.partition, e.collection, l.label, count(query_id) AS n, count(DISTINCT group_id) AS groups FROM e CROSS JOIN l LEFT JOIN r ON r.partition = e.partition AND r.collection = e.collection AND r.label = l.label GROUP BY ALL""",
    "partition_summary": f"WITH {ROWS} SELECT partition, label, count(*) AS n, count(DISTINCT group_id) AS groups, count(DISTINCT collection) AS collections FROM r GROUP BY ALL",
    "split_gates": f"""WITH {ROWS}, c AS (SELECT partition, collection, label, count(*) AS n FROM r GROUP BY ALL), g AS (SELECT partition, label, count(DISTINCT group_id) AS g FROM r GROUP BY ALL),
        s AS (SELECT partition, count(DISTINCT collection) AS k, count(*) AS cells FROM c GROUP BY 1), t AS (SELECT partition, min(g) AS g, count(*) AS labels FROM g GROUP BY 1)
        SELECT partition, k = 4 AND cells = 8 AND labels = 2 AND g >= CASE partition WHEN 'train' THEN 3 WHEN 'validation' THEN 1 ELSE 2 END AS passed FROM s JOIN t USING (partition)""",
    "balanced_match_rank": RANKS + " SELECT partition, collection, case_id, control_id, match_level FROM matched",
    "match_level_hist": RANKS + " SELECT match_level, count(*) AS n FROM matched GROUP BY 1",
    "pair_removal": RANKS
    + """, st AS (SELECT query_id, CASE ('0x' || substr(sha256('t:' || query_id), 1, 8))::BIGINT % 8 WHEN 0 THEN 'teacher_invalid' WHEN 1 THEN 'teacher_disagreed' ELSE CASE WHEN source_tokens > 900 THEN 'overlength_sequence' END END AS own FROM r),
        b AS (SELECT case_id, control_id, s.own AS l, t.own AS o FROM matched JOIN st s ON s.query_id = case_id JOIN st t ON t.query_id = control_id)
        SELECT case_id AS query_id, CASE WHEN l IS NULL AND o IS NULL THEN 'kept' ELSE coalesce(l, 'partner_removed') END AS reason FROM b
        UNION ALL SELECT control_id, CASE WHEN l IS NULL AND o IS NULL THEN 'kept' ELSE coalesce(o, 'partner_removed') END FROM b""",
}
