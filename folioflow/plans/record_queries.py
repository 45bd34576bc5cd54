"""Identity, matching, merging, keys, library tables, exports, pages, text functions and streams."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import names, patterns, simhash, structured, text
from ..operators import library, matching, webpages
from ..operators.search import tokens
from ..sinks import writers
from ..sources import bibtex, detect, lifecycle, readers, ris
from ..streaming import feeds
from .search_queries import query
from .tables import PUBLICATIONS_SQL, WORDS_SQL, publications, table

NOW = datetime.datetime(2001, 8, 3, 12, 0, 0)
_SHA = "substr(sha1(coalesce(authors, '') || coalesce(title, '')), 1, 15)"


@query("identity_sha1", f"WITH {PUBLICATIONS_SQL} SELECT doc_id, {_SHA} AS sha1 FROM p")
def identity_sha1(spark, sf):
    return matching.record_identity(publications(spark, sf)).select("doc_id", "sha1")


@query("uniquify", f"WITH {PUBLICATIONS_SQL}, k AS (SELECT doc_id, {_SHA} AS sha1 FROM p) SELECT min(doc_id) AS doc_id, sha1 FROM k GROUP BY sha1")
def uniquify(spark, sf):
    """One record of each identity."""
    return matching.uniquified(matching.record_identity(publications(spark, sf)).select("doc_id", "sha1"), ["sha1"], [F.col("doc_id")])


@query(
    "known_guids",
    f"""WITH {PUBLICATIONS_SQL}, k AS (SELECT doc_id, guid, labels, {_SHA} AS sha1 FROM p), c AS (SELECT sha1, min(guid) AS known FROM k WHERE labels = 'en' GROUP BY sha1)
        SELECT doc_id, coalesce(known, upper(md5(k.sha1))) AS guid FROM k LEFT JOIN c USING (sha1)""",
)
def known_guids(spark, sf):
    """Records without a guid take that of the cached record with their identity."""
    p = matching.record_identity(publications(spark, sf))
    fresh = p.withColumn("guid", F.lit(None).cast("string"))
    return matching.with_known_guids(fresh, p.where("labels = 'en'")).select("doc_id", "guid")


_KEY = r"upper(regexp_replace(p_name, '[\s.:!?\-;,]', '', 'g'))"


@query("title_match_pairs", f"WITH t AS (SELECT DISTINCT p_name, {_KEY} AS k FROM part) SELECT x.p_name AS a, y.p_name AS b, levenshtein(x.k, y.k) AS distance FROM t x JOIN t y ON x.p_name < y.p_name AND levenshtein(x.k, y.k) < 5")
def title_match_pairs(spark, sf):
    """Names of parts that match as titles do."""
    return matching.duplicate_pairs(table(spark, sf, "part").select("p_name").distinct(), "p_name", "p_name")


@query("title_match_tables", "SELECT n_nationkey AS a, s_suppkey AS b, levenshtein(upper(n_name), upper('Nation_' || s_nationkey)) AS distance FROM nation JOIN supplier ON levenshtein(upper(n_name), upper('Nation_' || s_nationkey)) < 5")
def title_match_tables(spark, sf):
    left = table(spark, sf, "nation")
    right = table(spark, sf, "supplier").withColumn("t", F.concat(F.lit("Nation_"), F.col("s_nationkey").cast("string")))
    return matching.title_pairs(left, right, "n_nationkey", "s_suppkey", "n_name", "t")


#: The similarity hash in SQL: a token's words go through the hash function's steps as a fold over lists of numbers,
#: [0, words] to add them, [1, x, y, z, rotation] to mix and [2, x, y, rotation] to finish; then bits are counted.
_M32 = "4294967295"
_TURNED = f"(((s[e[3]] << e[{{0}}]) | (s[e[3]] >> (32 - e[{{0}}]))) & {_M32})"
_MIX_SQL = ", ".join(f"[1, {k % 3 + 1}, {(k + 2) % 3 + 1}, {(k + 1) % 3 + 1}, {r}]" for k, r in enumerate(simhash.MIX))
_FINAL_SQL = ", ".join(f"[2, {(k + 2) % 3 + 1}, {(k + 1) % 3 + 1}, {r}]" for k, r in enumerate(simhash.FINAL))
_SIMHASH_SQL = rf"""tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+')) AS t FROM documents),
       hx AS (SELECT DISTINCT t, octet_length(encode(t)) AS n, rpad(hex(encode(t)), CAST(24 * ((octet_length(encode(t)) + 11) // 12) AS INTEGER), '0') AS h FROM tok WHERE octet_length(encode(t)) > {simhash.SHORT}),
       words AS (SELECT t, n, list_transform(range(0, len(h) // 8), lambda i: CAST('0x' || h[8*i+7:8*i+8] || h[8*i+5:8*i+6] || h[8*i+3:8*i+4] || h[8*i+1:8*i+2] AS BIGINT)) AS w FROM hx),
       steps AS (SELECT t, [[({0xDEADBEEF + simhash.SEED_1} + n) & {_M32}, ({0xDEADBEEF + simhash.SEED_1} + n) & {_M32}, ({0xDEADBEEF + simhash.SEED_1 + simhash.SEED_2} + n) & {_M32}]]
                 || flatten(list_transform(range(0, len(w) // 3), lambda b: [[0, w[3*b+1], w[3*b+2], w[3*b+3]]] || CASE WHEN b + 1 < len(w) // 3 THEN [{_MIX_SQL}] ELSE [{_FINAL_SQL}] END)) AS st FROM words),
       hashed AS (SELECT t, list_reduce(st, lambda s, e: CASE e[1]
                   WHEN 0 THEN [(s[1] + e[2]) & {_M32}, (s[2] + e[3]) & {_M32}, (s[3] + e[4]) & {_M32}]
                   WHEN 1 THEN list_transform(s, lambda v, i: CASE i WHEN e[2] THEN xor((v - s[e[3]]) & {_M32}, {_TURNED.format(5)}) WHEN e[3] THEN (v + s[e[4]]) & {_M32} ELSE v END)
                   ELSE list_transform(s, lambda v, i: CASE i WHEN e[2] THEN (xor(v, s[e[3]]) - {_TURNED.format(4)}) & {_M32} ELSE v END) END) AS h FROM steps),
       sized AS (SELECT doc_id, t, count(*) AS m FROM tok WHERE octet_length(encode(t)) > {simhash.SHORT} GROUP BY ALL),
       votes AS (SELECT doc_id, c, sum(m * ((CASE WHEN c >= 32 THEN h[3] >> (c - 32) ELSE h[2] >> c END) & 1)) AS yes, sum(m) AS n FROM sized JOIN hashed USING (t), range(64) r(c) GROUP BY ALL),
       bits AS (SELECT doc_id, string_agg(CASE WHEN yes - n // 2 >= 0 THEN '1' ELSE '0' END, '' ORDER BY c DESC) AS bits,
                sum(CASE WHEN c >= 32 AND yes - n // 2 >= 0 THEN 1 << (c - 32) ELSE 0 END) AS hi, sum(CASE WHEN c < 32 AND yes - n // 2 >= 0 THEN 1 << c ELSE 0 END) AS lo FROM votes GROUP BY doc_id),
       sim AS (SELECT d.doc_id, text, coalesce(bits, repeat('1', 64)) AS bits, CAST(coalesce(hi, {_M32}) AS BIGINT) AS hi, CAST(coalesce(lo, {_M32}) AS BIGINT) AS lo FROM documents d LEFT JOIN bits USING (doc_id))"""


@query("simhash_bits", f"WITH {_SIMHASH_SQL} SELECT doc_id, bits FROM sim")
def simhash_bits(spark, sf):
    """The similarity hash of each whole text, as 64 digits."""
    return publications(spark, sf).select("doc_id", simhash.simhash64("text").alias("h")).select("doc_id", simhash.binary_digits(F.col("h")).alias("bits"))


#: The same of runs of three tokens of any length, zeros before the first ones: 24 bytes in two blocks, other seeds.
_WIDE_SQL = f"""hash_at AS (SELECT doc_id, k, h[3] AS hi, h[2] AS lo FROM (SELECT doc_id, unnest(ts) AS t, unnest(range(0, len(ts))) AS k FROM every) JOIN hashed USING (t)),
       run AS (SELECT doc_id, [lag(lo, 2, 0) OVER o, lag(hi, 2, 0) OVER o, lag(lo, 1, 0) OVER o, lag(hi, 1, 0) OVER o, lo, hi] AS w FROM hash_at WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
       wide AS (SELECT doc_id, list_reduce([[{0xDEADBEEF + 24 + 0x2C759C01} & {_M32}, {0xDEADBEEF + 24 + 0x2C759C01} & {_M32}, {0xDEADBEEF + 24 + 0x2C759C01 + 0xFEF136D7} & {_M32}], [0, w[1], w[2], w[3]], {_MIX_SQL}, [0, w[4], w[5], w[6]], {_FINAL_SQL}],
                 lambda s, e: CASE e[1]
                   WHEN 0 THEN [(s[1] + e[2]) & {_M32}, (s[2] + e[3]) & {_M32}, (s[3] + e[4]) & {_M32}]
                   WHEN 1 THEN list_transform(s, lambda v, i: CASE i WHEN e[2] THEN xor((v - s[e[3]]) & {_M32}, {_TURNED.format(5)}) WHEN e[3] THEN (v + s[e[4]]) & {_M32} ELSE v END)
                   ELSE list_transform(s, lambda v, i: CASE i WHEN e[2] THEN (xor(v, s[e[3]]) - {_TURNED.format(4)}) & {_M32} ELSE v END) END) AS h FROM run),
       counted AS (SELECT doc_id, c, sum((CASE WHEN c >= 32 THEN h[3] >> (c - 32) ELSE h[2] >> c END) & 1) AS yes, count(*) AS n FROM wide, range(64) r(c) GROUP BY ALL),
       joined AS (SELECT doc_id, string_agg(CASE WHEN 2 * yes - n >= 0 THEN '1' ELSE '0' END, '' ORDER BY c DESC) AS bits FROM counted GROUP BY doc_id)"""


@query(
    "simhash_wide",
    f"WITH {_SIMHASH_SQL.split('sized AS')[0].rstrip().rstrip(',').replace(f'> {simhash.SHORT}', '> 0')}, every AS (SELECT doc_id, regexp_extract_all(text, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS ts FROM documents), {_WIDE_SQL} SELECT d.doc_id, coalesce(bits, repeat('1', 64)) AS bits FROM documents d LEFT JOIN joined USING (doc_id)",
)
def simhash_wide(spark, sf):
    """The hash whose votes come from runs of three tokens."""
    return publications(spark, sf).select("doc_id", simhash.simhash_wide64("text").alias("h")).select("doc_id", simhash.binary_digits(F.col("h")).alias("bits"))


@query(
    "dup_simhash",
    f"""WITH {_SIMHASH_SQL}, o AS (SELECT *, CASE WHEN hi = {_M32} AND lo = {_M32} THEN '=' || text ELSE '' END AS own FROM sim), g AS (SELECT hi, lo, own, min(doc_id) AS top FROM o WHERE own IS NOT NULL GROUP BY ALL)
        SELECT top AS a, doc_id AS b, 0 AS distance FROM o JOIN g USING (hi, lo, own) WHERE doc_id <> top
        UNION ALL SELECT x.top, y.top, CAST(bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS INTEGER) FROM g x JOIN g y ON x.top < y.top AND x.own = '' AND y.own = '' AND bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 3""",
)
def dup_simhash(spark, sf):
    """Texts whose hashes differ in at most three bits; of texts with one long word or none, equal ones."""
    p = publications(spark, sf).select("doc_id", "text", simhash.simhash64("text").alias("h"))
    return matching.simhash_pairs(p, "doc_id", "h", text="text")


@query(
    "dup_titles",  # the SQL function counts bytes, so letters of two bytes become free ones of one
    rf"""WITH {PUBLICATIONS_SQL}, k AS (SELECT doc_id, translate(replace(upper(regexp_replace(title, '[\s.:!?\-;,]', '', 'g')), 'ẞ', 'SS'), 'ÉÓÈÑÄÜÇÊÖÍ', 'abcdefghij') AS x FROM p WHERE title IS NOT NULL), c AS (SELECT x, min(doc_id) AS top FROM k GROUP BY x)
        SELECT top AS a, doc_id AS b FROM k JOIN c USING (x) WHERE doc_id <> top
        UNION ALL SELECT u.top, v.top FROM c u JOIN c v ON u.top < v.top AND abs(length(u.x) - length(v.x)) < 5 AND levenshtein(u.x, v.x) < 5""",
)
def dup_titles(spark, sf):
    """Duplicates by titles: copies with the first of them, near titles by the first of each."""
    return matching.duplicates(publications(spark, sf), "doc_id", "title")


@query(
    "merge_overlay",
    """SELECT p_partkey, 'P' || p_partkey AS guid, CASE WHEN s_name IS NOT NULL AND s_nationkey % 2 = 0 THEN s_name ELSE p_name END AS title,
       CASE WHEN s_suppkey IS NULL OR s_nationkey % 3 = 0 THEN p_brand ELSE 'A' || s_nationkey END AS authors FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""",
)
def merge_overlay(spark, sf):
    """Given fields of new records over old ones; empty values and author lists cut short don't count."""
    old = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("guid"), F.col("p_name").alias("title"), F.col("p_brand").alias("authors"))
    s = table(spark, sf, "supplier")
    new = s.select(
        F.col("s_suppkey").alias("p_partkey"),
        F.lit("other").alias("guid"),
        F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).otherwise("0").alias("title"),
        F.when(F.col("s_nationkey") % 3 == 0, "Some One and {others}").otherwise(F.concat(F.lit("A"), F.col("s_nationkey").cast("string"))).alias("authors"),
    )
    return matching.merge_record(old, new, "p_partkey", ["guid", "title", "authors"])


@query(
    "match_priority",
    """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'd' || c_nationkey END AS doi, CASE WHEN c_custkey % 3 = 0 THEN 'm' || (c_nationkey + 5) END AS pmid FROM customer),
       v AS (SELECT 'N' || n_nationkey AS guid, 'd' || (n_nationkey * 2) AS doi, 'm' || n_nationkey AS pmid FROM nation),
       h AS (SELECT c_custkey, guid, 'doi' AS "by", 0 AS k FROM r JOIN v USING (doi) UNION ALL SELECT c_custkey, guid, 'pmid', 1 FROM r JOIN v USING (pmid))
       SELECT c_custkey, arg_min(guid, k) AS guid, arg_min("by", k) AS "by" FROM h GROUP BY c_custkey""",
)
def match_priority(spark, sf):
    """Records against a provider by the first identifier that matches."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    s = lambda x: x.cast("string")
    key, nation = F.col("c_custkey"), F.col("n_nationkey")
    records = c.select("c_custkey", F.when(key % 2 == 0, F.concat(F.lit("d"), s(F.col("c_nationkey")))).alias("doi"), F.when(key % 3 == 0, F.concat(F.lit("m"), s(F.col("c_nationkey") + 5))).alias("pmid"), F.lit(None).cast("string").alias("title"))
    provider = n.select(F.concat(F.lit("N"), s(nation)).alias("guid"), F.concat(F.lit("d"), s(nation * 2)).alias("doi"), F.concat(F.lit("m"), s(nation)).alias("pmid"), F.lit(None).cast("string").alias("title"))
    return matching.match_by_priority(records, provider, "c_custkey", ("doi", "pmid"))


@query("first_provider", "WITH h AS (SELECT user_id, event_type AS provider, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT *, list_position(['purchase', 'signup', 'view'], provider) AS k FROM h) SELECT user_id, provider, n FROM o WHERE k > 0 QUALIFY k = min(k) OVER (PARTITION BY user_id)")
def first_provider(spark, sf):
    hits = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("provider")).agg(F.count(F.lit(1)).alias("n"))
    return matching.first_provider(hits, "user_id", "purchase, signup, view")


#: All strings of one to three letters in order, with their numbers from 2 on.
_LETTERS = """l AS (SELECT chr(97 + CAST(range AS INTEGER)) AS c FROM range(26)),
       w AS (SELECT c AS t FROM l UNION ALL SELECT x.c || y.c FROM l x, l y UNION ALL SELECT x.c || y.c || z.c FROM l x, l y, l z),
       n AS (SELECT t, row_number() OVER (ORDER BY length(t), t) + 1 AS k FROM w UNION ALL SELECT '', 1)"""


@query(
    "citekey_disambiguate",
    f"""WITH {_LETTERS}, s AS (SELECT o_orderkey, 'P' || substr(o_orderpriority, 1, 1) AS base, row_number() OVER (PARTITION BY substr(o_orderpriority, 1, 1) ORDER BY o_orderkey) AS k FROM orders)
        SELECT o_orderkey, base || t AS citekey FROM s JOIN n USING (k)""",
)
def citekey_disambiguate(spark, sf):
    """A few base keys for all orders: one to three letters."""
    o = table(spark, sf, "orders").withColumn("base", F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)))
    return matching.citekeys(o, "base", [F.col("o_orderkey")]).select("o_orderkey", "citekey")


@query(
    "format_pattern",
    """SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2, 3)) AS x FROM customer""".replace(
        " AS x", " || '_' || CAST(1990 + c_nationkey AS VARCHAR) || '-' || lower(substr(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'), 1, 6)) AS key"
    ).replace("lower(substr(c_mktsegment, 2, 3))", "substr(c_mktsegment, 2, 3)"),
)
def format_pattern(spark, sf):
    """A key pattern with a leading-case author, year and cut title word."""
    c = table(spark, sf, "customer")
    key = patterns.format_pattern("[Firstauthor:4]_[YYYY]-[title1:6]", F.array("c_mktsegment"), F.col("c_name"), (F.col("c_nationkey") + 1990).cast("string"), F.lit("J"))
    return c.select("c_custkey", key.alias("key"))


@query("pattern_authors", "SELECT o_custkey, list(lower(o_orderstatus) ORDER BY o_orderkey) AS x, 1 AS n FROM orders GROUP BY o_custkey".replace("list(lower(o_orderstatus) ORDER BY o_orderkey) AS x, 1 AS n", "array_to_string((list(lower(o_orderstatus) ORDER BY o_orderkey))[1:2], '_') || CASE WHEN count(*) > 2 THEN '_et_al' ELSE '' END AS key"))
def pattern_authors(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("names"))
    return per.select("o_custkey", patterns.format_pattern("[authors2]", F.col("names"), F.lit(""), F.lit(""), F.lit("")).alias("key"))


# -- library tables ---------------------------------------------------------------------------------


@query("member_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def member_semi(spark, sf):
    return _members(spark, sf, True)


@query("member_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def member_anti(spark, sf):
    return _members(spark, sf, False)


def _bridge(spark, sf):
    return table(spark, sf, "labels").select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("collection_guid"), F.concat(F.lit("G"), F.col("doc_id").cast("string")).alias("publication_guid"))


def _members(spark, sf, inside):
    return library.members(publications(spark, sf), _bridge(spark, sf), "q1", inside).select("doc_id")


@query("imported_mark", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS imported FROM documents")
def imported_mark(spark, sf):
    return library.marked(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("with_attachments", "SELECT o_orderkey, count(l_orderkey) AS n_files, coalesce(string_agg('L' || l_linenumber, ',' ORDER BY 'L' || l_linenumber), '') AS files FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def with_attachments(spark, sf):
    """Records with the files attached to each."""
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("publication"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("name"))
    out = library.with_attachments(table(spark, sf, "orders").select(F.col("o_orderkey").alias("guid")), files)
    return out.select(F.col("guid").alias("o_orderkey"), "n_files", F.coalesce(F.array_join("files", ","), F.lit("")).alias("files"))


@query(
    "tree_paths",
    """WITH RECURSIVE c AS (SELECT 'r' || r_regionkey AS guid, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
         UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
       t AS (SELECT guid, name AS path FROM c WHERE parent IS NULL UNION ALL SELECT c.guid, t.path || '/' || c.name FROM t JOIN c ON c.parent = t.guid) SELECT guid, path FROM t""",
)
def tree_paths(spark, sf):
    """Paths of nested collections."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf, "region").select(s("r", "r_regionkey").alias("guid"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(s("n", "n_nationkey").alias("guid"), s("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    u = table(spark, sf, "supplier").select(s("s", "s_suppkey").alias("guid"), s("n", "s_nationkey").alias("parent"), F.col("s_name").alias("name"))
    return readers.folder_paths(r.unionByName(n).unionByName(u))


@query("sort_orders", "SELECT n_nationkey, n_regionkey AS parent, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER) AS sort_order FROM nation")
def sort_orders(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("parent"), "n_name")
    return library.sort_orders(n, [F.col("n_name")]).drop("n_name")


@query(
    "changelog_diff",
    """WITH a AS (SELECT doc_id, text, n_chars FROM documents WHERE lang <> 'de'), b AS (SELECT doc_id, text, CASE WHEN source = 'src3' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE lang <> 'fr')
       SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'INSERT' WHEN b.doc_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS type
       FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text <> b.text OR a.n_chars <> b.n_chars""",
)
def changelog_diff(spark, sf):
    d = table(spark, sf, "documents")
    new = d.where("lang <> 'fr'").withColumn("n_chars", F.when(F.col("source") == "src3", F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return library.changes(d.where("lang <> 'de'").select("doc_id", "text", "n_chars"), new.select("doc_id", "text", "n_chars"), "doc_id")


@query("changelog_latest", "WITH e AS (SELECT user_id, event_type AS type, event_id AS counter FROM events) SELECT user_id, arg_max(type, counter) AS type, max(counter) AS counter FROM e GROUP BY user_id")
def changelog_latest(spark, sf):
    """The last change of each record of a log."""
    log = table(spark, sf, "events").select("user_id", F.col("event_type").alias("type"), F.col("event_id").alias("counter"))
    return feeds.latest_states(log, "user_id").select("user_id", "type", "counter")


@query("upsert_settings", "SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey < 10 THEN 'new' || n_regionkey ELSE n_name END AS value FROM nation UNION ALL SELECT 'x' || r_regionkey, 'new' || r_name FROM region")
def upsert_settings(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    key = F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key")
    new = n.where("n_nationkey < 10").select(key, F.concat(F.lit("new"), F.col("n_regionkey").cast("string")).alias("value"))
    more = r.select(F.concat(F.lit("x"), F.col("r_regionkey").cast("string")).alias("key"), F.concat(F.lit("new"), "r_name").alias("value"))
    return library.upsert(n.select(key, F.col("n_name").alias("value")), new.unionByName(more), "key")


@query("setting_value", "SELECT n_name AS value FROM nation WHERE n_nationkey = 7")
def setting_value(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    return library.setting(n, "k7")


@query("settings_all", "SELECT count(*) AS n, min(n_name) AS first FROM nation")
def settings_all(spark, sf):
    """All settings as a map, here its size and smallest value."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    m = library.settings_map(n)
    return m.select(F.size("settings").cast("long").alias("n"), F.array_min(F.map_values("settings")).alias("first"))


@query("insert_pubs", "SELECT c_custkey AS guid FROM customer WHERE c_nationkey < 12 UNION SELECT c_custkey FROM customer WHERE c_nationkey >= 10")
def insert_pubs(spark, sf):
    """New records whose unique keys are free join the library."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("guid"), "c_nationkey")
    return library.insert(c.where("c_nationkey < 12"), c.where("c_nationkey >= 10"), ["guid"]).select("guid")


@query("update_pubs", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_pubs(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    new = c.where("c_nationkey = 3").withColumn("c_mktsegment", F.lit("changed"))
    return library.update(c, new, "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("trash_and_empty", "SELECT doc_id FROM documents WHERE lang <> 'es' AND source <> 'src4'")
def trash_and_empty(spark, sf):
    """Records move to the trash, which is then emptied."""
    p = publications(spark, sf).select("doc_id", "guid", "journal", "trashed")
    return library.empty_trash(library.set_trash(p, p.where("journal = 'src4'"), True)).select("doc_id")


@query("restore", "SELECT count(*) AS live FROM documents WHERE lang <> 'es' OR source = 'src4'")
def restore(spark, sf):
    p = publications(spark, sf).select("guid", "journal", "trashed")
    return library.set_trash(p, p.where("journal = 'src4'"), False).where("not trashed").agg(F.count(F.lit(1)).alias("live"))


@query("remove_members", "SELECT 'q' || quality AS collection_guid, count(*) AS n FROM labels WHERE NOT (quality = 1 AND toxic = 1) GROUP BY 1")
def remove_members(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("G"), F.col("doc_id").cast("string")).alias("guid"))
    return library.remove_members(_bridge(spark, sf), "q1", gone).groupBy("collection_guid").agg(F.count(F.lit(1)).alias("n"))


@query("templated", "SELECT r_regionkey, 'at ' || r_name || '/x of ' || r_name AS value FROM region")
def templated(spark, sf):
    """Configuration names in values, replaced also in what replaces them."""
    r = table(spark, sf, "region").withColumn("v", F.concat(F.lit("at __HOME__ of "), F.col("r_name")))
    out = library.templated(F.col("v"), {"HOME": "__BASE__/x", "BASE": "__R__"})
    return r.select("r_regionkey", F.replace(out, F.lit("__R__"), F.col("r_name")).alias("value"))


# -- exports and round trips ------------------------------------------------------------------------------


@query("citekeys_list", "SELECT '\\cite{' || string_agg(s_name, ',' ORDER BY s_name) || '}' AS text FROM supplier")
def citekeys_list(spark, sf):
    return writers.citekey_list(table(spark, sf, "supplier").select(F.col("s_name").alias("citekey")), cite=True)


_ELIDED = "CASE WHEN len(l) > 7 THEN l[1] || ', ' || l[2] || ', ' || l[3] || ',  ... (' || (len(l) - 6) || ' others) ... , ' || l[-3] || ', ' || l[-2] || ', ' || l[-1] ELSE array_to_string(l, ', ') END"


@query("author_elision", f"WITH a AS (SELECT o_custkey, list('A' || o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey) SELECT o_custkey, {_ELIDED} AS authors FROM a")
def author_elision(spark, sf):
    return _author_strings(spark, sf).select("o_custkey", text.elided_authors(F.col("authors")).alias("authors"))


def _author_strings(spark, sf):
    ids = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("A"), k.cast("string")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(ids, " and ").alias("authors"))


@query("email_export", "SELECT s_suppkey, s_name || '%0A' || 'N' || s_nationkey || '%0A' || 'J, ' || (1990 + s_nationkey) AS text FROM supplier")
def email_export(spark, sf):
    return writers.export_text(_supplier_records(spark, sf), "email").select("text").withColumn("s_suppkey", F.regexp_extract("text", r"#(\d+)", 1).cast("long"))


def _supplier_records(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        F.lit("ARTICLE").alias("pubtype"), F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("citekey"), F.col("s_name").alias("title"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("authors"), F.lit("J").alias("journal"), (F.col("s_nationkey") + 1990).cast("string").alias("year"), F.lit("").alias("linkout"),
    )


@query("bibtex_export", "SELECT '@ARTICLE{k' || s_suppkey || ',' || chr(10) || '  title    = {' || s_name || '},' || chr(10) || '  author   = {N' || s_nationkey || '},' || chr(10) || '  journal  = {J},' || chr(10) || '  year     = {' || (1990 + s_nationkey) || '}' || chr(10) || '}' || chr(10) AS text FROM supplier")
def bibtex_export(spark, sf):
    return writers.export_text(_supplier_records(spark, sf), "bibtex")


@query("ris_export", "SELECT 'TY  - JOUR' || chr(10) || 'AU  - N' || s_nationkey || chr(10) || 'PY  - ' || (1990 + s_nationkey) || '///' || chr(10) || 'TI  - ' || s_name || chr(10) || 'JO  - J' || chr(10) || 'ER  - ' || chr(10) AS text FROM supplier")
def ris_export(spark, sf):
    return writers.export_text(_supplier_records(spark, sf), "ris")


@query("citations_export", "SELECT s_name || chr(10) || 'N' || s_nationkey || chr(10) || 'J, ' || (1990 + s_nationkey) AS text FROM supplier")
def citations_export(spark, sf):
    return writers.export_text(_supplier_records(spark, sf), "citations")


@query("bibtex_round_trip", "SELECT 'k' || s_suppkey AS citekey, s_name AS title, 'N' || s_nationkey AS authors, CAST(1990 + s_nationkey AS VARCHAR) AS year FROM supplier")
def bibtex_round_trip(spark, sf):
    """Records written as BibTeX and parsed again."""
    files = writers.export_text(_supplier_records(spark, sf), "bibtex").select(F.lit("x").alias("path"), F.col("text").alias("content"))
    return readers.parse_files(files, bibtex.read_bibtex).select("citekey", "title", "authors", "year")


@query("ris_round_trip", "SELECT s_name AS title, 'N' || s_nationkey AS authors, 'J' AS journal, CAST(1990 + s_nationkey AS VARCHAR) AS year FROM supplier")
def ris_round_trip(spark, sf):
    files = writers.export_text(_supplier_records(spark, sf), "ris").select(F.lit("x").alias("path"), F.col("text").alias("content"))
    return readers.parse_files(files, ris.read_ris).select("title", "authors", "journal", "year")


# -- pages ---------------------------------------------------------------------------------------------------


@query("html_title", r"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), '') AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", webpages.page_title(F.col("html")).alias("title"))


@query("html_links", r"""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS link FROM pages""")
def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(webpages.page_links(F.col("html"))).alias("link"))


@query("page_records", """SELECT page_id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS authors, CAST(NULL AS VARCHAR) AS doi, CASE WHEN NOT regexp_matches(html, '(?i)<meta[^>]*(citation_|dc\\.)title|@article|(?m)^TY  -') THEN 'UnknownSiteError' END AS error FROM pages""")
def page_records(spark, sf):
    """Bibliographic records of all pages, or the error of those that have none."""
    return webpages.extract_records(table(spark, sf, "pages")).select("page_id", "title", "authors", "doi", "error")


RULES = [
    webpages.SiteRule("net", url=(r"example\.net/",), rewrite=((r"/en/", "/pdf/"), (r"#.*$", ""))),
    webpages.SiteRule("paged", url=(r"[?&]page=\d+",), match=r'href="(/[^"]*)"'),
    webpages.SiteRule("script", body=(r"track\(1\);",)),
]


@query(
    "url_rules",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, 'example\.net/') THEN 'net' WHEN regexp_matches(url, '[?&]page=\d+') THEN 'paged' WHEN regexp_matches(html, 'track\(1\);') THEN 'script' END AS site,
        CASE WHEN regexp_matches(url, 'example\.net/') THEN regexp_replace(regexp_replace(url, '/en/', '/pdf/', 'g'), '#.*$', '', 'g')
             WHEN regexp_matches(url, '[?&]page=\d+') THEN nullif(regexp_extract(html, 'href="(/[^"]*)"', 1), '') WHEN regexp_matches(html, 'track\(1\);') THEN url END AS link FROM pages""",
)
def url_rules(spark, sf):
    """The site of each page by address and body signatures, and where its document is."""
    u, h = F.col("url"), F.col("html")
    return table(spark, sf, "pages").select("page_id", webpages.site_of(u, h, RULES).alias("site"), webpages.document_link(u, h, RULES).alias("link"))


@query(
    "url_pubmed_id",
    """SELECT page_id, CASE page_id % 7 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN CAST(page_id AS VARCHAR) WHEN 2 THEN CAST(page_id AS VARCHAR) WHEN 3 THEN CAST(page_id AS VARCHAR)
       WHEN 4 THEN 'PMC' || page_id WHEN 5 THEN 'PMC' || page_id END AS id FROM pages""",
)
def url_pubmed_id(spark, sf):
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 7
    forms = ("http://www.ncbi.nlm.nih.gov/pubmed/{}", "http://www.ncbi.nlm.nih.gov/pubmed?term={}", "http://www.ncbi.nlm.nih.gov/sites/entrez/{}", "http://x.org/pubmed/{}", "http://www.ncbi.nlm.nih.gov/pmc/articles/PMC{}/", "http://ukpmc.ac.uk/articles/PMC{}", "http://x.org/{}")
    url = F.concat(F.lit(""), F.lit(""))
    for j, f in enumerate(forms):
        a, b = f.split("{}")
        url = F.when(k == j, F.concat(F.lit(a), n, F.lit(b))).otherwise(url)
    return table(spark, sf, "pages").select("page_id", text.pubmed_id(url).alias("id"))


@query(
    "detect_text_format",
    r"""WITH l AS (SELECT doc_id, list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda x: x <> '')[1:500] AS ls FROM documents), i AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM l),
        t AS (SELECT doc_id, k, ls[k] AS one, array_to_string(ls[greatest(1, k - 5):k], '') AS near FROM i),
        f AS (SELECT doc_id, k, CASE WHEN regexp_matches(one, '(?i)@\w+\{') OR regexp_matches(near, '(?i)@\w+\{') THEN 'BIBTEX' WHEN regexp_matches(one, '(?i)^\s*TY\s+-\s+') OR regexp_matches(near, '(?i)^\s*TY\s+-\s+') THEN 'RIS'
                              WHEN regexp_matches(one, '(?is)xml.*rss') OR regexp_matches(near, '(?is)xml.*rss') THEN 'RSS' END AS format FROM t)
        SELECT d.doc_id, f.format FROM documents d LEFT JOIN (SELECT doc_id, arg_min(format, k) AS format FROM f WHERE format IS NOT NULL GROUP BY doc_id) f USING (doc_id)""",
)
def detect_text_format(spark, sf):
    """The format of whole texts by their first lines."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", detect.text_format(F.col("text")).alias("format"))


@query("detect_library", "SELECT r_name AS path, CASE WHEN r_regionkey = 0 THEN 'ZOTERO' WHEN r_regionkey = 1 THEN 'MENDELEY' WHEN r_regionkey = 2 THEN 'NATIVE' END AS format FROM region")
def detect_library(spark, sf):
    k = F.col("r_regionkey")
    tables = F.when(k == 0, F.array(F.lit("zoteroDummyTable"))).when(k == 1, F.array(F.lit("DocumentContributors"), F.lit("RunsSinceLastCleanup"))).when(k == 2, F.array(F.lit("Fulltext"), F.lit("Publications"))).otherwise(F.array(F.lit("other")))
    return detect.library_format(table(spark, sf, "region").select(F.col("r_name").alias("path"), F.explode(tables).alias("name")))


# -- text functions -------------------------------------------------------------------------------------------


@query(
    "clean_identifiers",
    r"""SELECT c_custkey, '10.1000/x' || c_custkey AS doi, '0901.' || c_custkey AS arxivid, c_nationkey || '-' || c_custkey AS pages, c_nationkey || '--' || c_custkey AS double_pages,
        CAST(1990 + c_nationkey AS VARCHAR) AS year, 'a b ' || c_name || ' c' AS flat FROM customer""",
)
def clean_identifiers(spark, sf):
    s = lambda c: F.col(c).cast("string")
    c = table(spark, sf, "customer")
    pages = F.concat(s("c_nationkey"), F.lit(" -- "), s("c_custkey"))
    return c.select(
        "c_custkey",
        text.clean_doi(F.concat(F.lit("http://dx.doi.org/10.1000/x"), s("c_custkey"))).alias("doi"),
        text.clean_arxiv(F.concat(F.lit("arXiv: 0901."), s("c_custkey"))).alias("arxivid"),
        text.single_dash(pages).alias("pages"),
        text.double_dash(text.single_dash(pages)).alias("double_pages"),
        text.year_of(F.concat(F.lit("01-JAN-"), (F.col("c_nationkey") + 1990).cast("string"))).alias("year"),
        text.flat_braces(F.concat(F.lit("a {b {"), F.col("c_name"), F.lit("} c}"))).alias("flat"),
    )


@query(
    "title_functions",
    r"""SELECT p_partkey, 'x ' || p_name || ' y' AS stripped, p_name || ' b' AS untagged, '88' || replace(p_name, ' ', '99') || '88' AS label,
        CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 4) || ' ... ' || right(p_name, 4) ELSE p_name END AS short, '{DNA} ' || p_name || ' {CpG}' AS quoted FROM part""",
)
def title_functions(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey",
        text.strip_tex(F.concat(F.lit(r"x \textbf{"), n, F.lit("} y"))).alias("stripped"),
        text.strip_short_tags(F.concat(F.lit("<i>"), n, F.lit("</i> <b>b</b>"))).alias("untagged"),
        text.label_key(n).alias("label"),
        text.mid_ellipsis(n, 8).alias("short"),
        text.quote_words(F.concat(F.lit("DNA "), n, F.lit(" CpG"))).alias("quoted"),
    )


@query("path_functions", r"""SELECT page_id, '/a/' || page_id AS dir, 'p.' || page_id || '.PDF' AS file, 'p.' || page_id AS base, 'PDF' AS extension, 'a_' || page_id || '_p_' || page_id || '_PDF' AS lock FROM pages""")
def path_functions(spark, sf):
    n = F.col("page_id").cast("string")
    path = F.concat(F.lit("/a/"), n, F.lit("/p."), n, F.lit(".PDF"))
    return table(spark, sf, "pages").select("page_id", text.path_parts(path).alias("x"), text.lock_name(path).alias("lock")).select("page_id", "x.*", "lock")


@query("month_names", "SELECT o_orderkey, strftime(o_orderdate, '%B') AS month FROM orders")
def month_names(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.month_name(F.lower(F.date_format("o_orderdate", "MMM"))).alias("month"))


@query("bibtex_counts", "SELECT p_partkey, CAST(2 AS BIGINT) AS opened, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS closed, CAST(1 AS BIGINT) AS entries, '@article{k, title={' || p_name || '}}' AS repaired FROM part")
def bibtex_counts(spark, sf):
    entry = F.concat(F.lit("@article{k, title={"), F.col("p_name"), F.lit("}"), F.when(F.col("p_size") % 2 == 0, "").otherwise("}"))
    return table(spark, sf, "part").select("p_partkey", text.bibtex_counts(entry).alias("x"), text.repair_bibtex(entry).alias("repaired")).select("p_partkey", "x.*", "repaired")


@query("author_parts", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'von' END AS von, c_mktsegment AS last, 'Jo ' || substr(c_name, 1, 1) || '.' AS first, 'JC' AS initials FROM customer")
def author_parts(spark, sf):
    """Names split into their parts, and initials."""
    von = F.when(F.col("c_nationkey") % 2 == 0, F.lit("von ")).otherwise(F.lit(""))
    name = F.concat(von, F.col("c_mktsegment"), F.lit(", Jo "), F.substring("c_name", 1, 1), F.lit("."))
    parts = table(spark, sf, "customer").select("c_custkey", names.name_parts(name).alias("x")).select("c_custkey", "x.von", "x.last", "x.first")
    return parts.withColumn("initials", names.initials(F.col("first")))


@query("author_renderings", "SELECT c_custkey, upper(c_mktsegment) || '_JC' AS key, c_mktsegment || ' JC' AS nice, c_mktsegment || ', JC' AS normalized, c_mktsegment || ', Jo C.' AS bibtex, c_mktsegment || '|Jo|C.' AS bibutils, c_mktsegment || ', Jo C.' AS again FROM customer")
def author_renderings(spark, sf):
    none, last, first = F.lit(None).cast("string"), F.col("c_mktsegment"), F.lit("Jo C.")
    out = names.bibutils_name(last, first)
    return table(spark, sf, "customer").select(
        "c_custkey",
        names.author_key(last, first).alias("key"),
        names.nice_name(none, last, first).alias("nice"),
        names.normalized_name(none, last, first).alias("normalized"),
        names.bibtex_name(none, last, none, first).alias("bibtex"),
        out.alias("bibutils"),
        names.from_bibutils(out).alias("again"),
    )


def _ladder() -> str:
    out = f"CASE WHEN s < {text.AGES[0][0]} THEN '{text.AGES[0][1]}'"
    for limit, word, unit in text.AGES[1:]:
        out += f" WHEN s < {limit} THEN " + (f"CAST(CAST(floor(s / {unit} + 0.5) AS BIGINT) AS VARCHAR) || ' {word} ago'" if unit else f"'{word} ago'")
    return out + " END"


@query("pretty_date", f"SELECT o_orderkey, {_ladder()} AS age FROM (SELECT o_orderkey, epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate) AS s FROM orders)")
def pretty_date(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.pretty_date(F.col("o_orderdate"), F.lit(NOW)).alias("age"))


@query("date_functions", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day, strftime(o_orderdate, '%Y-%m-%d ') AS local FROM orders")
def date_functions(spark, sf):
    d = F.col("o_orderdate")
    o = table(spark, sf, "orders").select("o_orderkey", text.ris_date(F.date_format(d, "yyyy/MM/dd/")).alias("x"), text.local_date(F.date_format(d, "yyyy-MM-dd HH:mm:ss")).alias("local"))
    return o.select("o_orderkey", "x.year", "x.month", "x.day", "local")


@query("word_counts", f"SELECT doc_id, CAST(len({WORDS_SQL.format('text')}) AS BIGINT) AS n FROM documents")
def word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"))


# -- streams ---------------------------------------------------------------------------------------------------


@query("job_states", """WITH e AS (SELECT user_id AS jobid, CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'ERROR' ELSE 'PENDING' END AS status, event_type, ts, event_id FROM events)
  SELECT jobid, arg_max(status, ts) AS status, arg_max(status, ts) = 'ERROR' AS error FROM e GROUP BY jobid""")
def job_states(spark, sf):
    e, t = table(spark, sf, "events"), F.col("event_type")
    status = F.when(t == "view", "RUNNING").when(t == "purchase", "DONE").when(t == "error", "ERROR").otherwise("PENDING")
    return feeds.job_states(e.select(F.col("user_id").alias("jobid"), status.alias("status"), F.lit("PDF_IMPORT").alias("type"), F.col("ts").alias("at"))).select("jobid", "status", "error")


@query("job_commands", "SELECT CASE WHEN event_type = 'signup' AND user_id < 20 THEN 'PAUSED' WHEN event_type = 'signup' THEN 'PENDING' WHEN event_type = 'error' THEN 'PENDING' ELSE 'RUNNING' END AS status, count(*) AS n FROM events WHERE event_type IN ('signup', 'error', 'view') GROUP BY 1")
def job_commands(spark, sf):
    """Pause some waiting jobs, try failed ones again, clear the done ones."""
    t = F.col("event_type")
    status = F.when(t == "view", "RUNNING").when(t.isin("purchase", "click"), "DONE").when(t == "error", "ERROR").otherwise("PENDING")
    jobs = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("jobid"), status.alias("status"))
    jobs = feeds.command(jobs, "pause", [str(k) for k in range(20)])
    jobs = feeds.command(feeds.command(jobs, "retry"), "clear")
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("feed_stream_dedup", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def feed_stream_dedup(spark, sf):
    """The events file as a stream, each (user, type) kept once; the stream ends with what there is."""
    from ..streaming.run import drained

    schema = table(spark, sf, "events").schema
    stream = feeds.file_stream(spark, f"{sf}/events.parquet*", schema)  # a glob: a stream's source is a folder or a pattern
    kept = feeds.first_by_key(stream.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", "3650 days")
    return drained(kept).agg(F.count(F.lit(1)).alias("n"))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """Hourly counts; a Spark-native extra."""
    e = feeds.windowed_counts(table(spark, sf, "events"), "ts", "1 hour", "1 hour", ["event_type"])
    return e.select(F.col("window.start").alias("start"), "event_type", "n")


# -- structured values, sources, keys of the whole library ----------------------------------------------------


@query(
    "rekey_library",
    f"""WITH {_LETTERS}, s AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || substr(c_mktsegment, 2) || (1990 + c_nationkey) AS base FROM customer),
        r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS k FROM s) SELECT c_custkey, base || t AS citekey FROM r JOIN n USING (k)""",
)
def rekey_library(spark, sf):
    c = table(spark, sf, "customer")
    key = patterns.format_pattern("[Firstauthor][YYYY]", F.array("c_mktsegment"), F.col("c_name"), (F.col("c_nationkey") + 1990).cast("string"), F.lit(""))
    return matching.rekeyed(c, key, [F.col("c_custkey")]).select("c_custkey", "citekey")


@query("structured_values", """SELECT n_nationkey, '{"name":"' || n_name || '","key":' || n_nationkey || '}' AS json, 'new' AS merged, n_name AS kept, n_name AS thawed, n_name AS decoded FROM nation""")
def structured_values(spark, sf):
    """Nested values as text and back; maps over one another."""
    n = table(spark, sf, "nation")
    value = F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    m = structured.merged_maps(F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.col("n_name")), F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), F.lit("0")))
    return n.select(
        "n_nationkey",
        structured.json_text(value).alias("json"),
        F.element_at(m, "a").alias("merged"),
        F.element_at(m, "b").alias("kept"),
        F.variant_get(structured.thawed(structured.frozen(value)), "$.name", "string").alias("thawed"),
        structured.decoded(structured.encoded(F.col("n_name"))).alias("decoded"),
    )


@query("xml_values", "SELECT r_regionkey, r_name FROM region")
def xml_values(spark, sf):
    """A record as XML and read again."""
    r = table(spark, sf, "region").select("r_regionkey", structured.xml_text(F.struct("r_name")).alias("x"))
    return r.select("r_regionkey", structured.from_xml_text(F.col("x"), "r_name string").alias("y")).select("r_regionkey", "y.r_name")


@query("library_source", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND contains(o_orderpriority, 'URGENT') ORDER BY o_orderdate DESC, 'G' || o_orderkey LIMIT 25 OFFSET 50")
def library_source(spark, sf):
    """A page of a library source: matches in the live part, newest first."""
    o = table(spark, sf, "orders")
    pubs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("guid"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("p"), (F.col("o_orderstatus") == "P").alias("trashed"))
    return lifecycle.LibrarySource(spark, pubs, {"text": F.col("p")}, query="urgent", limit=25).page(50).select("id")


@query("trash_source", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'P' AND contains(o_orderpriority, 'URGENT')")
def trash_source(spark, sf):
    o = table(spark, sf, "orders")
    pubs = o.select(F.col("o_orderkey").cast("string").alias("guid"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("p"), (F.col("o_orderstatus") == "P").alias("trashed"))
    return lifecycle.TrashSource(spark, pubs, {"text": F.col("p")}, query="urgent").load().agg(F.count(F.lit(1)).alias("total"))


# -- Spark-native extras, without a counterpart in a reference manager ---------------------------------------


@query("rollup_priorities", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_priorities(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("previous_event", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def previous_event(spark, sf):
    from pyspark.sql.window import Window

    return table(spark, sf, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


@query("shared_keys", "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def shared_keys(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey").intersect(table(spark, sf, "supplier").select("s_nationkey")).agg(F.count(F.lit(1)).alias("n"))
