"""Queries over text functions and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.functions import identity as I
from lumenweir.functions import text as T
from lumenweir.operators.similarity import MOST_KEYS, contained_passages, parts_of, shingles
from lumenweir.sources.tables import stored, table

NUMBERED = r"""list_transform(lines, lambda x, i: printf('%04d', i) || CASE WHEN x = '' THEN ' |' ELSE ' | ' || x END)"""
LINES = r"""
    n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents),
    l AS (SELECT doc_id, t, CASE WHEN t = '' THEN [] WHEN right(t, 1) = chr(10) THEN string_split(left(t, length(t) - 1), chr(10)) ELSE string_split(t, chr(10)) END AS lines FROM n)
"""


def fingerprint_sha(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", I.sha(F.coalesce("text", F.lit(""))).alias("text_sha256"), I.list_digest(F.array("lang", "source")).alias("key_sha256"), I.seeded(42, F.col("doc_id")).alias("seeded_order"))


def seeded_sample(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", I.seeded(42, F.col("doc_id")).alias("seeded_order"))
    return docs.orderBy("seeded_order").limit(25)


def line_numbers(spark, d) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.size(T.source_lines(t)).cast("bigint").alias("n_lines"), I.sha(T.numbered(t)).alias("numbered_sha256"))


def line_roundtrip(spark, d) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    back = T.unnumbered(T.numbered(t)) == F.array_join(T.source_lines(t), "\n")
    return table(spark, d, "documents").select(F.size(T.source_lines(t)).alias("n"), back.alias("same")).agg(F.count("*").alias("n_docs"), F.count_if(F.col("same") | (F.col("n") == 0)).alias("n_same"))


def normalise_lines(spark, d) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    lines = T.source_lines(t)
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("bigint").alias("n_filled"), I.sha(F.array_join(lines, "\n")).alias("lines_sha256"))


def markup_comment_blank(spark, d) -> DataFrame:
    parts = F.regexp_extract_all("html", F.lit(T.MARKUP_CHUNK), F.lit(0))
    gone = F.filter(parts, lambda c: c.startswith("<!--") | c.startswith("<script"))
    out = T.blanked(F.col("html"), T.MARKUP_CHUNK, r"\A<(?:!--|script)")
    return table(spark, d, "pages").select("page_id", F.size(gone).cast("bigint").alias("n_blanked"), F.length(out).cast("bigint").alias("n_chars"), I.sha(out).alias("blanked_sha256"))


def commented(w, i):
    """The i-th word as a piece of code: a statement, a line comment, a block comment, a string that looks like one, or a call."""
    put = lambda before, after: F.concat(F.lit(before), w, F.lit(after))
    k = i % 5
    return F.when(k == 0, put("", " = 1; ")).when(k == 1, put("// ", "\n")).when(k == 2, put("/* ", "\n*/ ")).when(k == 3, put('"// ', '" ')).otherwise(put("", "();\n"))


def source_comment_blank(spark, d) -> DataFrame:
    """The words of each document as code with comments, and that code with its comments blanked."""
    w = T.word_tokens(F.coalesce("text", F.lit("")))
    docs = table(spark, d, "documents").select("doc_id", w.alias("w"))
    docs = docs.select("doc_id", F.array_join(F.transform("w", commented), "").alias("code"))
    blank = T.strip_comments(F.col("code"))
    return docs.select("doc_id", F.length("code").cast("bigint").alias("n_chars"), F.sha2("code", 256).alias("code_sha256"), F.sha2(blank, 256).alias("blanked_sha256"))


def skeleton_classes(spark, d) -> DataFrame:
    """Classes of documents that are one text but for names and literals, read as code."""
    tokens = T.code_tokens(F.col("text"))
    own = table(spark, d, "documents").select("doc_id", I.list_digest(T.skeleton(tokens)).alias("skeleton")).filter("skeleton IS NOT NULL")
    return own.groupBy("skeleton").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def token_counts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.size(T.word_tokens(F.col("text"))), F.lit(0)).cast("bigint").alias("n_tokens"))


def overlength(spark, d) -> DataFrame:
    return token_counts(spark, d).filter("n_tokens > 1000")


def version_extract_hist(spark, d) -> DataFrame:
    page = T.extracted(F.col("url"), r"[?&]page=(\d+)")
    host = T.extracted(F.col("url"), r"^https?://(?:www\.|m\.|blog\.)?([^/]+)")
    return table(spark, d, "pages").select(page.alias("version"), T.extracted(F.col("url"), r"^(\w+):").alias("scheme"), host.alias("host")).groupBy("version", "scheme").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))


def cited_text(doc_id):
    n = lambda k: (doc_id % k + 1).cast("string")
    return F.concat(F.lit("See lines "), n(7), F.lit("-"), n(90), F.lit(", "), n(11), F.lit(" and "), n(13), F.lit("; line "), n(5), F.lit(". Deadlines 12 stay. It is PRESENT at line "), n(3), F.lit("."))


def citation_extract(spark, d) -> DataFrame:
    c = T.citations(cited_text(F.col("doc_id")))
    return table(spark, d, "documents").select("doc_id", F.size(c).cast("bigint").alias("n_cited"), F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_cited"), F.array_join(c.cast("array<string>"), ",").alias("cited"))


def last_sentence_verdict(spark, d) -> DataFrame:
    last = T.last_sentence(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.length(last).cast("bigint").alias("n_chars_last"), F.contains(F.upper(last), F.lit("THE")).alias("says_the"), (F.contains(F.upper(last), F.lit("THE")) & ~F.contains(F.upper(last), F.lit("AND"))).alias("says_the_only"))


def shingle_frequency_topk(spark, d) -> DataFrame:
    """The 20 shingles that most documents have: counted by hash; only those that can be among them are counted as strings.

    Hashes move alone, 8 bytes a shingle, and only counts of those that several documents have are stored. Where few can be
    among the first, they are broadcast, so that no strings of others move."""
    top = 20
    docs = table(spark, d, "documents").select(T.words(F.coalesce("text", F.lit(""))).alias("w"))
    parts = parts_of(spark, (docs.agg(F.sum(F.size("w"))).first()[0] or 0))
    hashes = docs.select(F.explode(shingles(F.col("w"), by=" ")).alias("h")).repartition(parts, "h")
    counts = stored(hashes.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "shingle_counts")
    most = counts.orderBy(F.desc("df")).limit(top).agg(F.count("*").alias("n"), F.min("df").alias("least")).first()
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(5)), " ")))
    named = docs.select(F.explode(F.when(F.size("w") >= 5, runs)).alias("shingle")).withColumn("h", F.xxhash64("shingle"))
    if most.n == top:  # else shingles of one document are among them, and all count
        few = counts.filter(F.col("df") >= most.least).select("h")
        named = named.join(F.broadcast(few) if few.count() <= MOST_KEYS else few, "h")
    return named.groupBy("shingle").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "shingle").limit(top)


def benchmark_contamination(spark, d) -> DataFrame:
    return contained_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


def readable_sources(spark, d) -> DataFrame:
    # every fifth document with a byte that no UTF-8 text has
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    raw = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 5 == 0, F.concat(raw, F.lit(b"\xff"))).otherwise(raw).alias("raw"))
    return raw.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.try_validate_utf8(F.col("raw").cast("string")).isNotNull()).alias("readable"), F.sum(F.octet_length("raw")).cast("bigint").alias("n_bytes"))


def query_render(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    text = T.rendered_query(F.lit("check-1"), F.lit("repeats"), F.when(F.col("item_id") % 2 == 0, "FILE").otherwise("FUNCTION"), F.concat(F.lit("f"), F.col("item_id").cast("string")), F.array(F.lit("first"), F.lit("second")), F.col("text"))
    prompt = F.replace(F.lit("Read this.\n<<QUERY>>\nAnswer."), F.lit("<<QUERY>>"), text)
    return b.select("item_id", prompt.alias("prompt"), T.run_name(F.lit("report_vf"), F.col("item_id") % 3 + 42, 42).alias("run_name"), T.number_text(F.when(F.col("item_id") % 4 != 0, F.col("item_id") / 8)).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (fingerprint_sha, seeded_sample, line_numbers, line_roundtrip, normalise_lines, markup_comment_blank, source_comment_blank, skeleton_classes, token_counts, overlength, version_extract_hist, citation_extract, last_sentence_verdict, shingle_frequency_topk, benchmark_contamination, readable_sources, query_render)
}
CITED = r"""'See lines ' || (doc_id % 7 + 1) || '-' || (doc_id % 90 + 1) || ', ' || (doc_id % 11 + 1) || ' and ' || (doc_id % 13 + 1) || '; line ' || (doc_id % 5 + 1) || '. Deadlines 12 stay. It is PRESENT at line ' || (doc_id % 3 + 1) || '.'"""
COMMENTED = """array_to_string(list_transform(w, lambda x, i: CASE (i - 1) % 5 WHEN 0 THEN x || ' = 1; ' WHEN 1 THEN {line} || chr(10) WHEN 2 THEN {block} WHEN 3 THEN '"// ' || x || '" ' ELSE x || '();' || chr(10) END), '')"""
SQL = {
    "source_comment_blank": f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS w FROM documents),
        c AS (SELECT doc_id, {COMMENTED.format(line="'// ' || x", block="'/* ' || x || chr(10) || '*/ '")} AS code,
          {COMMENTED.format(line="repeat(' ', 3 + length(x))", block="repeat(' ', 3 + length(x)) || chr(10) || '   '")} AS blanked FROM t)
        SELECT doc_id, length(code) AS n_chars, sha256(code) AS code_sha256, sha256(blanked) AS blanked_sha256 FROM c""",
    "fingerprint_sha": """SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, sha256('["' || lang || '","' || source || '"]') AS key_sha256,
        sha256('[42,"' || doc_id || '"]') AS seeded_order FROM documents""",
    "seeded_sample": """SELECT doc_id, sha256('[42,"' || doc_id || '"]') AS seeded_order FROM documents ORDER BY 2 LIMIT 25""",
    "line_numbers": f"""WITH {LINES} SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, sha256(array_to_string({NUMBERED}, chr(10))) AS numbered_sha256 FROM l""",
    "line_roundtrip": "SELECT count(*) AS n_docs, count(*) AS n_same FROM documents",
    "normalise_lines": f"""WITH {LINES} SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(list_filter(lines, lambda x: trim(x) <> '')) AS BIGINT) AS n_filled,
        sha256(array_to_string(lines, chr(10))) AS lines_sha256 FROM l""",
    "markup_comment_blank": r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script.*?</script>|[^<]+|<', 0) AS parts FROM pages),
        b AS (SELECT page_id, list_filter(parts, lambda c: starts_with(c, '<!--') OR starts_with(c, '<script')) AS gone,
          array_to_string(list_transform(parts, lambda c: CASE WHEN starts_with(c, '<!--') OR starts_with(c, '<script') THEN regexp_replace(c, '[^\r\n]', ' ', 'g') ELSE c END), '') AS t FROM p)
        SELECT page_id, CAST(len(gone) AS BIGINT) AS n_blanked, length(t) AS n_chars, sha256(t) AS blanked_sha256 FROM b""",
    "token_counts": "SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+')), 0) AS BIGINT) AS n_tokens FROM documents",
    "overlength": "SELECT doc_id, n_tokens FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT) AS n_tokens FROM documents) WHERE n_tokens > 1000",
    "version_extract_hist": r"""SELECT coalesce(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), ''), 'unspecified') AS version, regexp_extract(url, '^(\w+):', 1) AS scheme,
        count(*) AS n, count(DISTINCT regexp_extract(url, '^https?://(?:www\.|m\.|blog\.)?([^/]+)', 1)) AS hosts FROM pages GROUP BY ALL""",
    "citation_extract": rf"""WITH t AS (SELECT doc_id, {CITED} AS a FROM documents),
        c AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(a, '\blines?\s+(\d+(?:\s*[-–]\s*\d+)?(?:\s*(?:,|,?\s*and)\s*\d+(?:\s*[-–]\s*\d+)?)*)', 1), lambda m: regexp_extract_all(m, '\d+'))) AS n FROM t)
        SELECT doc_id, CAST(len(n) AS BIGINT) AS n_cited, CAST(list_sum(list_transform(n, lambda x: CAST(x AS BIGINT))) AS BIGINT) AS sum_cited, array_to_string(n, ',') AS cited FROM c""",
    "last_sentence_verdict": r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\A[ \t\n\r\f]+|[ \t\n\r\f]+\z', '', 'g'), '([.!?])[ \t\n\r\f]+', '\1' || chr(30), 'g'), chr(30)) AS p FROM documents),
        l AS (SELECT doc_id, coalesce(list_filter(p, lambda x: x <> '')[-1], '') AS s FROM s)
        SELECT doc_id, length(s) AS n_chars_last, contains(upper(s), 'THE') AS says_the, contains(upper(s), 'THE') AND NOT contains(upper(s), 'AND') AS says_the_only FROM l""",
    "shingle_frequency_topk": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS shingle FROM w WHERE len(w) >= 5)
        SELECT shingle, count(*) AS df FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "benchmark_contamination": "SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "readable_sources": "SELECT source, count(*) AS n, CAST(count_if(doc_id % 5 <> 0) AS BIGINT) AS readable, CAST(sum(octet_length(encode(coalesce(text, ''))) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_bytes FROM documents GROUP BY 1",
    "query_render": """SELECT item_id, 'Read this.' || chr(10) || 'check_id: check-1' || chr(10) || 'definition: repeats' || chr(10) || 'scope: '
          || CASE WHEN item_id % 2 = 0 THEN 'FILE the whole file' ELSE 'FUNCTION f' || item_id END || chr(10) || 'assumptions:' || chr(10) || '- first' || chr(10) || '- second' || chr(10)
          || 'source:' || chr(10) || text || chr(10) || 'Answer.' AS prompt,
        CASE WHEN item_id % 3 = 0 THEN 'report-vf' ELSE 'report-vf-seed' || (item_id % 3 + 42) END AS run_name,
        CASE WHEN item_id % 4 <> 0 THEN printf('%.3f', item_id / 8.0) ELSE '—' END AS shown FROM benchmark""",
}
