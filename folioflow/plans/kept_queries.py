"""Files in ranges, classes of titles, the kept index, the job stream, the writer, and rows whose keys repeat."""

from __future__ import annotations

import sqlite3

from pyspark.sql import functions as F

from ..operators import layouts, library, matching, search
from ..operators.termindex import TermIndex
from ..sinks import writers
from ..sources import libraries, lifecycle, readers, splits
from ..store import working_folder
from ..streaming import feeds, jobs
from .search_queries import query
from .source_queries import _filled, _s, _sqlite_files, _text_files
from .tables import PUBLICATIONS_SQL, WORDS_SQL, publications, table

# -- files in ranges --------------------------------------------------------------------------------------

_ENTRY = (
    "@string{own{k} = {Own {k}}}\n@article{p{k},\n  title = {The {{name}} of\n    many lines},\n  journal = own{k} # \" and \" # own{k},\n  year = {19{y}},\n  note = {" + "a long note, " * 12 + "}\n}\n"
)
_OPEN = "@book{open{k},\n  title = {never closed {k},\n  note = { more {\n"


@query(
    "bibtex_ranges",
    """SELECT 'p' || p_partkey AS citekey, 'The ' || p_name || ' of many lines' AS title, 'Own ' || p_partkey || ' and Own ' || p_partkey AS journal, '19' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS year FROM part""",
)
def bibtex_ranges(spark, sf):
    """Files cut into ranges of 20,000 bytes, wherever these fall: macros, entries of many lines, and one in seven that is never closed."""
    p = table(spark, sf, "part")
    text = F.concat(F.when(F.col("p_partkey") % 7 == 3, _filled(_OPEN, k="p_partkey")).otherwise(F.lit("")), _filled(_ENTRY, k="p_partkey", name="p_name", y=F.lpad(_s("p_size"), 2, "0")))
    path = working_folder(spark, "ranges")
    p.select(text.alias("text")).write.text(path)
    return splits.read_bibtex_ranges(spark, path, range_bytes=20_000).select("citekey", "title", "journal", "year")


@query("ris_ranges", "SELECT 'Part ' || p_name AS title, 'Roe, J and Doe, ' || p_brand AS authors, CAST(p_size AS VARCHAR) AS volume FROM part")
def ris_ranges(spark, sf):
    """Tagged records cut into ranges of 5000 bytes."""
    p = table(spark, sf, "part")
    text = F.concat(F.lit("TY  - JOUR\nTI  - Part "), "p_name", F.lit("\nAU  - Roe, J\nAU  - Doe, "), "p_brand", F.lit("\nVL  - "), _s("p_size"), F.lit("\nER  - \n"))
    path = working_folder(spark, "ranges")
    p.select(text.alias("text")).write.text(path)
    return splits.read_ris_ranges(spark, path, range_bytes=5_000).select("title", "authors", "volume")


@query(
    "citations_written",
    "SELECT 'k' || s_suppkey AS citekey, s_name AS title, 'N' || s_nationkey || ', A' AS authors, CAST(1950 + s_nationkey AS VARCHAR) AS year FROM supplier WHERE s_suppkey % 3 <> 0",
)
def citations_written(spark, sf):
    """Records written by ``write.format("bibtex")``, first all, then over them those of two kinds; read with a filter that the source tests."""
    readers.register_formats(spark)
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(F.when(k % 3 == 0, "BOOK").otherwise("ARTICLE").alias("pubtype"), F.concat(F.lit("k"), _s(k)).alias("citekey"), F.col("s_name").alias("title"), F.concat(F.lit("N"), _s("s_nationkey"), F.lit(", A")).alias("authors"), _s(F.col("s_nationkey") + 1950).alias("year"))
    path = working_folder(spark, "written")
    s.withColumn("title", F.lit("old")).write.format("bibtex").mode("append").save(path)
    s.write.format("bibtex").mode("overwrite").save(path)
    return spark.read.format("bibtex").load(path).where("pubtype = 'ARTICLE'").select("citekey", "title", "authors", "year")


# -- classes of titles ------------------------------------------------------------------------------------


@query(
    "title_classes",
    r"""WITH RECURSIVE k AS (SELECT p_partkey, upper(regexp_replace(p_name, '[\s.:!?\-;,]', '', 'g')) AS x FROM part), f AS (SELECT x, min(p_partkey) AS top FROM k GROUP BY x),
        e AS (SELECT a.top AS u, b.top AS v FROM f a JOIN f b ON a.top <> b.top AND abs(length(a.x) - length(b.x)) < 5 AND levenshtein(a.x, b.x) < 5),
        r AS (SELECT top AS u, top AS v FROM f UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), c AS (SELECT u, min(v) AS class_id FROM r GROUP BY u)
        SELECT p_partkey, class_id FROM k JOIN f USING (x) JOIN c ON c.u = f.top""",
)
def title_classes(spark, sf):
    """Every part with the smallest key that its name reaches over near names."""
    return matching.title_classes(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")


# -- the kept index ---------------------------------------------------------------------------------------


def _fields():
    return {"title": F.col("title"), "text": F.col("text"), "journal": F.col("journal")}


def _has(column: str, word: str) -> str:
    return f"list_contains({WORDS_SQL.format(column)}, '{word}')"


def _begins(column: str, start: str) -> str:
    return f"len(list_filter({WORDS_SQL.format(column)}, lambda w: starts_with(w, '{start}'))) > 0"


@query("index_tree", f"WITH {PUBLICATIONS_SQL} SELECT doc_id AS key FROM p WHERE ({_has('text', 'the')} OR {_begins('title', 'de')}) AND NOT ({_has('journal', 'src1')} OR {_begins('text', 'que')})")
def index_tree(spark, sf):
    """A tree of "and", "or", "not" and beginnings of words, on bits of a kept index."""
    index = TermIndex(spark, working_folder(spark, "terms"), range_rows=20_000)
    index.apply(publications(spark, sf), "doc_id", _fields())
    wanted = ("text", "the", False), "or", ("title", "de", True)
    unwanted = ("journal", "src1", False), "or", ("text", "que", True)
    return index.keys(index.matches((wanted, "and", ("not", unwanted))))


@query(
    "index_after_changes",
    f"""WITH {PUBLICATIONS_SQL}, n AS (SELECT doc_id, title, CASE WHEN doc_id % 100 = 1 THEN 'changed words here' ELSE text END AS text, journal FROM p WHERE doc_id % 100 <> 2 UNION ALL SELECT -1 - doc_id, 'new the', text, journal FROM p WHERE doc_id % 100 = 3)
        SELECT doc_id, title FROM n WHERE {_has('text', 'the')} AND NOT {_has('journal', 'nothing')} AND ({_has('title', 'the')} OR {_has('text', 'the')}) UNION ALL SELECT doc_id, title FROM n WHERE {_has('text', 'changed')}""",
)
def index_after_changes(spark, sf):
    """One text in a hundred changed, one deleted, one added; the index keeps up by segments and merges them. Equal to a scan of the new table."""
    p = publications(spark, sf).select("doc_id", "title", "text", "journal")
    k = F.pmod("doc_id", F.lit(100))
    changed, gone = p.where(k == 1).withColumn("text", F.lit("changed words here")), p.where(k == 2).select("doc_id")
    added = p.where(k == 3).select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("new the").alias("title"), "text", "journal")
    index = TermIndex(spark, working_folder(spark, "terms"))
    index.apply(p, "doc_id", _fields())
    index.apply(changed, "doc_id", _fields())
    index.apply(added, "doc_id", _fields(), deleted=gone)
    now = library.delete(p, gone, "doc_id").join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed).unionByName(added)
    found = index.search(now, "doc_id", "text:the", _fields()).unionByName(index.search(now, "doc_id", "text:changed", _fields()))
    return found.select("doc_id", "title")


@query("index_terms", f"WITH {PUBLICATIONS_SQL}, t AS (SELECT DISTINCT doc_id, unnest({WORDS_SQL.format('text')}) AS token FROM p) SELECT token, count(*) AS n FROM t WHERE starts_with(token, 'th') GROUP BY token")
def index_terms(spark, sf):
    """The words that begin with some letters, with the numbers of texts that have them, from the dictionary's ranges."""
    index = TermIndex(spark, working_folder(spark, "terms"), range_rows=20_000)
    index.apply(publications(spark, sf), "doc_id", {"text": F.col("text")})
    return index.terms("th").select("token", "n")


@query("index_phrases", f"WITH {PUBLICATIONS_SQL} SELECT doc_id FROM p WHERE array_to_string({WORDS_SQL.format('text')}, ' ') SIMILAR TO '(.* )?of the( .*)?' AND {_has('journal', 'src1')}")
def index_phrases(spark, sf):
    """A phrase and a journal: the index gives the texts with all words, and only these are read for the phrase."""
    index = TermIndex(spark, working_folder(spark, "terms"))
    p = publications(spark, sf)
    index.apply(p, "doc_id", _fields())
    return index.search(p, "doc_id", 'text:"of the" journal:src1', _fields()).select("doc_id")


# -- jobs -------------------------------------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'PAUSED' ELSE 'PENDING' END"
_LEGAL = " OR ".join(f"(r.status = '{a}' AND e.wanted IN ({', '.join(repr(b) for b in bs)}))" for a, bs in feeds.TRANSITIONS.items() if bs)


@query(
    "job_stream",
    f"""WITH RECURSIVE e AS (SELECT user_id * 10 + event_id % 5 AS job, ts, {_STATUS} AS wanted, row_number() OVER (PARTITION BY user_id * 10 + event_id % 5 ORDER BY ts, event_id) AS k FROM events),
        r AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS TIMESTAMP) AS since, 0 AS n_accepted, 0 AS n_refused, CAST(0 AS BIGINT) AS seconds FROM e
          UNION ALL SELECT job, k, CASE WHEN ok THEN wanted ELSE status END, CASE WHEN ok THEN ts ELSE since END, n_accepted + ok::INT, n_refused + (NOT ok)::INT,
            seconds + CASE WHEN ok AND status = 'RUNNING' AND wanted IN ('DONE', 'ERROR') THEN greatest(1, CAST(floor(epoch(ts)) - floor(epoch(since)) AS BIGINT)) ELSE 0 END
          FROM (SELECT r.job, e.k, r.status, r.since, e.ts, e.wanted, r.n_accepted, r.n_refused, r.seconds, CASE WHEN r.status IS NULL THEN e.wanted = 'PENDING' ELSE ({_LEGAL}) END AS ok FROM r JOIN e ON e.job = r.job AND e.k = r.k + 1))
        SELECT CAST(job AS VARCHAR) AS jobid, last(status ORDER BY k) AS status, CAST(max(n_accepted) AS BIGINT) AS n_accepted, CAST(max(n_refused) AS BIGINT) AS n_refused, max(seconds) AS seconds FROM r GROUP BY job""",
)
def job_stream(spark, sf):
    """Events as a stream of steps of jobs: the last states, allowed and refused steps, and the seconds that jobs ran."""
    from ..streaming.run import drained

    own = spark.newSession()  # the store that the state needs is set for this query alone
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(*jobs.PROVIDER)
    stream = feeds.file_stream(own, f"{sf}/events.parquet*", table(spark, sf, "events").schema)
    job = F.col("user_id") * 10 + F.col("event_id") % 5
    steps = jobs.job_steps(stream.select(_s(job).alias("jobid"), F.col("ts").alias("at"), F.expr(_STATUS).alias("status"), F.col("event_id").alias("seq")))
    out = drained(steps)
    return jobs.job_table(spark.read.schema(out.schema).parquet(*{f.rpartition("/")[0] for f in out.inputFiles()}))


# -- keys that repeat ---------------------------------------------------------------------------------------


@query("url_match_repeated", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' A' ELSE p_name END AS title FROM part")
def url_match_repeated(spark, sf):
    """Pages whose addresses stand twice: a record stays one, completed from the page with the smaller number."""
    p = table(spark, sf, "part")
    link = F.concat(F.lit("http://x.org/"), _s("p_partkey"))
    records = p.select(_s("p_partkey").alias("guid"), link.alias("linkout"), F.col("p_name").alias("title"))
    html = F.concat(F.lit('<meta name="citation_title" content="'), "p_name", F.lit(" "), "letter", F.lit('">'))
    pages = p.where("p_partkey % 2 = 0").select("p_partkey", "p_name", F.explode(F.array(F.struct(F.lit("B").alias("letter"), F.lit(2).alias("n")), F.struct(F.lit("A").alias("letter"), F.lit(1).alias("n")))).alias("v")).select("*", "v.*")
    pages = pages.select(F.col("n").alias("page_id"), link.alias("url"), html.alias("html"))
    return lifecycle.url_match(records, pages).select(F.col("guid").cast("long").alias("p_partkey"), "title")


@query("upsert_repeated", "SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey < 10 THEN 'new 1' ELSE n_name END AS value FROM nation UNION ALL SELECT 'x', 'new 1'")
def upsert_repeated(spark, sf):
    """Settings that are given three times: the first in order counts, and keys stay unique."""
    n = table(spark, sf, "nation")
    key = F.concat(F.lit("k"), _s("n_nationkey"))
    more = n.where("n_nationkey < 10").select(key.alias("key"), F.explode(F.array(*map(F.lit, (3, 1, 2)))).alias("v")).unionByName(n.where("n_nationkey < 3").select(F.lit("x").alias("key"), (F.col("n_nationkey") + 1).cast("int").alias("v")))
    return library.upsert(n.select(key.alias("key"), F.col("n_name").alias("value")), more.select("key", F.concat(F.lit("new "), _s("v")).alias("value")), "key")


@query(
    "insert_clashes",
    """WITH old AS (SELECT * FROM customer WHERE c_custkey % 10 = 0), new AS (SELECT 'G' || c_custkey // 2 AS guid, 'S' || c_nationkey || '-' || c_custkey // 3 AS sha1, c_custkey AS n FROM customer WHERE c_custkey % 10 <> 0),
       fresh AS (SELECT * FROM new WHERE guid NOT IN (SELECT 'G' || c_custkey // 2 FROM old)),
       r AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY n) AS a, row_number() OVER (PARTITION BY sha1 ORDER BY n) AS b FROM fresh)
       SELECT 'G' || c_custkey // 2 AS guid, 'old' || c_custkey AS sha1, c_custkey AS n FROM old UNION ALL SELECT guid, sha1, n FROM r WHERE a = 1 AND b = 1""",
)
def insert_clashes(spark, sf):
    """New rows that clash in one of two unique columns with old rows or earlier new ones."""
    c, n = table(spark, sf, "customer"), F.col("c_custkey")
    guid = F.concat(F.lit("G"), _s(F.floor(n / 2).cast("long"))).alias("guid")
    old = c.where(n % 10 == 0).select(guid, F.concat(F.lit("old"), _s(n)).alias("sha1"), n.alias("n"))
    new = c.where(n % 10 != 0).select(guid, F.concat(F.lit("S"), _s("c_nationkey"), F.lit("-"), _s(F.floor(n / 3).cast("long"))).alias("sha1"), n.alias("n"))
    return library.insert(old, new, ["guid", "sha1"], [F.col("n")])


@query("feed_first_items", "SELECT n_name AS title, 'http://x.org/' || min(k) AS linkout FROM nation, (VALUES (1), (2), (3)) v(k) GROUP BY n_name")
def feed_first_items(spark, sf):
    """Items of one identity with three links: the one whose link sorts first stays."""
    rss = '<rss version="2.0"><channel><title>F</title><item><title>{name}</title><link>http://x.org/{k}</link></item></channel></rss>'
    n = table(spark, sf, "nation").select("n_name", F.explode(F.array(*map(F.lit, (3, 1, 2)))).alias("k"))
    source = lifecycle.plugin("source", "feed")(spark, _text_files(n.select(_filled(rss, name="n_name", k="k").alias("text")), "feeds"))
    source.connect()
    return source.all().select("title", "linkout")


# -- words of pages -----------------------------------------------------------------------------------------


@query(
    "lines_by_gaps",
    """SELECT CAST(o_orderkey AS VARCHAR) AS doc, content FROM orders, LATERAL (SELECT unnest([o_orderkey || ' one', 'two ' || o_custkey, 'three']) AS content)""",
)
def lines_by_gaps(spark, sf):
    """Words whose tops lie within two units of one another are one line, wherever a grid would cut them."""
    o = table(spark, sf, "orders")
    word = lambda w, x, y: F.struct(w.alias("word"), F.lit(x).alias("xmin"), (F.lit(y) + F.col("o_orderkey") % 7 * 0.3).alias("ymin"))
    words = F.array(word(_s("o_orderkey"), 1.0, 2.9), word(F.lit("one"), 50.0, 3.1), word(F.lit("two"), 1.0, 14.8), word(_s("o_custkey"), 50.0, 16.7), word(F.lit("three"), 1.0, 30.0))
    words = o.select(_s("o_orderkey").alias("doc"), F.explode(words).alias("w")).select("doc", F.lit(1).alias("page"), "w.*", (F.col("w.xmin") + 20).alias("xmax"), F.lit(9.0).alias("size"))
    return layouts.words_to_lines(words).select("doc", "content")


@query("columns_in_order", "SELECT CAST(o_orderkey AS VARCHAR) AS doc, 'head' || o_orderkey || ' l1 l2 l3 r1 r2 foot' AS content FROM orders")
def columns_in_order(spark, sf):
    """A heading over two columns and a line below them, read in their order."""
    o = table(spark, sf, "orders")
    spots = {"l1": (10, 100), "r1": (300, 101), "l2": (10, 112), "r2": (305, 113), "l3": (12, 124), "foot": (150, 200)}
    word = lambda w, x, y: F.struct(w.alias("word"), F.lit(float(x)).alias("xmin"), F.lit(float(y)).alias("ymin"), F.lit(float(x + (380 if y == 20 else 120))).alias("xmax"))
    words = F.array(word(F.concat(F.lit("head"), _s("o_orderkey")), 10, 20), *(word(F.lit(w), x, y) for w, (x, y) in spots.items()))
    words = o.select(_s("o_orderkey").alias("doc"), F.lit(1).alias("page"), F.explode(words).alias("w")).select("doc", "page", "w.*", F.lit(9.0).alias("size"))
    lines = layouts.words_to_lines(layouts.reading_order(words), by=("block",))
    order = F.array_sort(F.collect_list(F.struct("block", "ymin", "xmin", "content")))
    return lines.groupBy("doc").agg(F.array_join(F.transform(order, lambda x: x["content"]), " ").alias("content"))


# -- library files of several versions -----------------------------------------------------------------------


def _versions(db, rows):
    old = rows[0]["s_nationkey"] % 2 == 0  # half of the files are of a version without two columns
    db.executescript(f"CREATE TABLE RunsSinceLastCleanup (time); CREATE TABLE DocumentContributors (id, documentId, contribution, firstNames, lastName); CREATE TABLE Documents (id, type, title, year{'' if old else ', arxivId, city'});")
    for r in rows:
        db.execute(f"INSERT INTO Documents VALUES (?, ?, ?, ?{'' if old else ', ?, ?'})", (r["s_suppkey"], "Book", r["s_name"], 1990 + r["s_nationkey"], *(() if old else (f"x{r['s_suppkey']}", "Rome"))))


def _mixed_files(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("N"), _s("s_nationkey")).alias("path"), "s_suppkey", "s_name", "s_nationkey")
    good = _sqlite_files(s, "path", _versions)
    broken = table(spark, sf, "nation").select(F.concat(F.lit("B"), _s("n_nationkey")).alias("path"), F.concat(F.lit("SQLite format 3"), F.repeat(F.lit("x"), F.col("n_nationkey") + 40)).cast("binary").alias("content"))
    return good.unionByName(broken)


@query(
    "library_versions",
    """SELECT 'N' || s_nationkey AS path, s_name AS title, CASE WHEN s_nationkey % 2 = 1 THEN 'x' || s_suppkey END AS arxivid, CASE WHEN s_nationkey % 2 = 1 THEN 'Mendeley field "city": Rome<br />' || chr(10) END AS note FROM supplier""",
)
def library_versions(spark, sf):
    """Files of two versions of a program and broken ones beside each other: each is read with the columns that it has."""
    return libraries.read_mendeley(_mixed_files(spark, sf)).select("path", "title", "arxivid", "note")


@query("broken_libraries", "SELECT 'B' || n_nationkey AS path FROM nation")
def broken_libraries(spark, sf):
    """The files that begin as library files do but can't be read, each with its error."""
    assert sqlite3
    return libraries.read_errors(_mixed_files(spark, sf)).where("length(error) > 0").select("path")


@query("unsorted_page", f"WITH {PUBLICATIONS_SQL} SELECT count(*) AS n, true AS all_match FROM (SELECT * FROM p WHERE NOT trashed AND {_has('text', 'the')} LIMIT 30 OFFSET 5)")
def unsorted_page(spark, sf):
    """A page of a library whose matches are more than the limit for sorting: so many rows of them, in no order."""
    p = publications(spark, sf).withColumn("created", F.col("n_chars"))
    source = lifecycle.plugin("source", "db")(spark, p, _fields(), sort_limit=1, query="text:the")
    source.connect()
    page = source.page(5, 30)
    return page.agg(F.count(F.lit(1)).alias("n"), F.bool_and(search.condition("text:the", _fields()) & ~F.col("trashed")).alias("all_match"))


@query("exported_ranges", "SELECT p_name AS title, CAST(p_size AS VARCHAR) AS volume FROM part")
def exported_ranges(spark, sf):
    """An export of all parts read again in ranges of 8000 bytes."""
    p = table(spark, sf, "part").select(F.lit("ARTICLE").alias("pubtype"), F.concat(F.lit("k"), _s("p_partkey")).alias("citekey"), F.col("p_name").alias("title"), _s("p_size").alias("volume"))
    path = working_folder(spark, "exports")
    writers.export_text(p, "bibtex").write.text(path)
    return splits.read_bibtex_ranges(spark, path, range_bytes=8_000).select("title", "volume")


# -- rules and trees ------------------------------------------------------------------------------------------


@query(
    "rules_table",
    r"""WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)/', 1) AS host FROM pages), r AS (SELECT DISTINCT host FROM h), n AS (SELECT host, row_number() OVER (ORDER BY host) AS k FROM r)
        SELECT page_id, CASE WHEN url LIKE '%.html%' THEN 0 WHEN k % 3 = 0 THEN 3 * k ELSE 3 * k + 1 END AS rule, CASE WHEN url LIKE '%.html%' OR k % 3 = 0 THEN url ELSE regexp_replace(url, '/(en|fr|de|es)/', '/\1/pdf/') END AS address FROM h JOIN n USING (host)""",
)
def rules_table(spark, sf):
    """Three rules for each host of the pages, one for all: each page's first rule, and the address that this makes of the page's own."""
    from pyspark.sql.window import Window

    from ..operators import webpages

    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    hosts = pages.select(F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host")).distinct()
    hosts = hosts.withColumn("k", F.row_number().over(Window.orderBy("host")).cast("long"))  # a row for each host, which names its rules
    safe = F.replace("host", F.lit("."), F.lit("\\."))
    none = F.lit(None).cast("string")
    rule = lambda n, pattern, search, to: F.struct((3 * F.col("k") + n).alias("rule"), F.lit("url").alias("field"), pattern.alias("pattern"), search.alias("search"), to.alias("replacement"))
    each = F.array(
        rule(0, F.when(F.col("k") % 3 == 0, F.concat(F.lit("^https?://"), safe, F.lit("/"))).otherwise(F.concat(safe, F.lit("/never/"))), none, none),
        rule(1, F.concat(F.lit("//"), safe, F.lit("/(en|fr|de|es)/")), F.lit("/(en|fr|de|es)/"), F.lit("/$1/pdf/")),
        rule(2, safe, none, none),
    )
    one = spark.range(1).select(F.lit(0).cast("long").alias("rule"), F.lit("url").alias("field"), F.lit(r"\.html").alias("pattern"), none.alias("search"), none.alias("replacement"))
    return webpages.ruled_links(pages, hosts.select(F.explode(each).alias("r")).select("r.*").unionByName(one))


@query(
    "folder_and_below",
    """WITH RECURSIVE c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey >= 3 THEN s_suppkey // 3 END AS p FROM supplier), t AS (SELECT k FROM c WHERE k = 2 UNION ALL SELECT c.k FROM c JOIN t ON c.p = t.k)
       SELECT doc_id FROM documents WHERE doc_id % (SELECT count(*) FROM supplier) IN (SELECT k FROM t) OR doc_id // 7 % (SELECT count(*) FROM supplier) IN (SELECT k FROM t)""",
)
def folder_and_below(spark, sf):
    """Texts that are in a folder or in any below it, by the intervals of the tree of folders."""
    from ..operators import trees

    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    n = s.count()
    folder = lambda c: F.concat(F.lit("F"), _s(c))
    tree = s.select(folder(k).alias("guid"), F.when(k >= 3, folder(F.floor(k / 3).cast("long"))).alias("parent"))
    docs = table(spark, sf, "documents").select("doc_id", _s("doc_id").alias("guid"))
    places = F.array(F.col("doc_id") % n, F.floor(F.col("doc_id") / 7).cast("long") % n)
    bridge = docs.select(F.explode(F.array_distinct(places)).alias("f"), F.col("guid").alias("publication_guid")).select(folder(F.col("f")).alias("collection_guid"), "publication_guid")
    return trees.members_below(docs, bridge, trees.interval_labels(tree), "F2").select("doc_id")


# -- lists and counts that are kept ---------------------------------------------------------------------------


@query("far_page", f"WITH {PUBLICATIONS_SQL} SELECT doc_id, title FROM p ORDER BY n_chars DESC, doc_id LIMIT 40 OFFSET (SELECT count(*) * 9 // 10 FROM p)")
def far_page(spark, sf):
    """A page far back in a list that was sorted once: it opens the range that holds it."""
    from ..operators.pages import SortedList

    p = publications(spark, sf).select("doc_id", "title", "n_chars")
    kept = SortedList.write(p, [F.col("n_chars").desc(), F.col("doc_id")], working_folder(spark, "list"), range_rows=100)
    return kept.page(kept.total() * 9 // 10, 40).select("doc_id", "title")


def _counted(spark, sf, what):
    """Counters of the documents after two batches of changes: one row in fifty goes, one in fifty gets another source."""
    from ..operators.counters import Counters, changed_rows

    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    k = F.pmod("doc_id", F.lit(50))
    later = d.where(k != 7).withColumn("source", F.when(k == 8, F.lit("moved")).otherwise(F.col("source")))
    last = later.where(F.col("n_chars") < 4000)
    kept = Counters(spark, working_folder(spark, what), {"source": F.col("source"), "both": F.array("lang", "source"), "items": F.lit("all"), "chars": F.col("n_chars")})
    kept.apply(added=d)
    for before, after in ((d, later), (later, last)):
        gone, came = changed_rows(before, after, "doc_id")
        kept.apply(gone, came)
    kept.compact()
    return kept


_LATER = "WITH l AS (SELECT lang, CASE WHEN doc_id % 50 = 8 THEN 'moved' ELSE source END AS source, n_chars FROM documents WHERE doc_id % 50 <> 7 AND n_chars < 4000)"


@query("counts_by_deltas", f"{_LATER} SELECT grp, count(*) AS n FROM (SELECT unnest([lang, source]) AS grp FROM l) WHERE grp IS NOT NULL GROUP BY grp")
def counts_by_deltas(spark, sf):
    """A histogram kept by signed counts through deletions and updates."""
    return _counted(spark, sf, "counts").counts("both")


@query("dashboard_by_deltas", f"{_LATER} SELECT count(*) AS num_items, max(n_chars) AS longest FROM l")
def dashboard_by_deltas(spark, sf):
    """Totals and the largest value by signed counts; the largest goes back when its rows are deleted."""
    kept = _counted(spark, sf, "counts")
    return kept.dashboard(num_items=kept.total("items"), longest=kept.largest("chars", "long"))


@query(
    "match_by_title",
    r"""WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'D' || p_partkey END AS doi, upper(regexp_replace(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' xy' ELSE '!' END, '[\s.:!?\-;,]', '', 'g')) AS x FROM part WHERE p_partkey % 5 < 4),
        o AS (SELECT 'G' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS guid, CASE WHEN p_partkey % 8 = 0 THEN 'd' || p_partkey END AS doi, upper(regexp_replace(p_name, '[\s.:!?\-;,]', '', 'g')) AS y FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'H' || p_partkey, NULL, upper(regexp_replace(p_name, '[\s.:!?\-;,]', '', 'g')) FROM part WHERE p_partkey % 2 = 0),
        t AS (SELECT x, y, levenshtein(x, y) AS d FROM (SELECT DISTINCT x FROM q) CROSS JOIN (SELECT DISTINCT y FROM o) WHERE abs(length(x) - length(y)) < 5 AND levenshtein(x, y) < 5),
        b AS (SELECT x, arg_min(guid, (d, guid)) AS guid FROM t JOIN o USING (y) GROUP BY x), i AS (SELECT lower(doi) AS doi, min(guid) AS guid FROM o WHERE doi IS NOT NULL GROUP BY ALL)
        SELECT p_partkey, coalesce(i.guid, b.guid) AS guid, CASE WHEN i.guid IS NOT NULL THEN 'doi' ELSE 'title' END AS "by" FROM q LEFT JOIN i ON lower(q.doi) = i.doi LEFT JOIN b USING (x) WHERE coalesce(i.guid, b.guid) IS NOT NULL""",
)
def match_by_title(spark, sf):
    """Records matched by an identifier or, most of them, by titles that differ a little; the provider has every title twice."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    ids = {"pmid": none, "arxivid": none}
    name = F.concat("p_name", F.when(k % 3 == 0, F.lit(" xy")).otherwise(F.lit("!")))
    asked = p.where(k % 5 < 4).select("p_partkey", name.alias("title"), F.when(k % 4 == 0, F.concat(F.lit("D"), _s(k))).alias("doi")).withColumns(ids)
    known = p.where(k % 2 == 0).select(F.concat(F.lit("G"), F.lpad(_s(k), 9, "0")).alias("guid"), F.col("p_name").alias("title"), F.when(k % 8 == 0, F.concat(F.lit("d"), _s(k))).alias("doi"))
    known = known.unionByName(p.where(k % 2 == 0).select(F.concat(F.lit("H"), _s(k)).alias("guid"), F.col("p_name").alias("title"), none.alias("doi"))).withColumns(ids)
    return matching.match_by_priority(asked, known, "p_partkey")
