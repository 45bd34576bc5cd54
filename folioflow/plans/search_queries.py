"""Search, paging, counts, histograms and clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tree_query
from ..operators import aggregates, search
from ..store import working_folder
from .tables import PUBLICATIONS_SQL, WORDS_SQL, publications, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


FIELDS = {"text": F.col, "title": F.col, "journal": F.col}
_W = WORDS_SQL.format("text")
_TITLE_W = WORDS_SQL.format("title")
_JOURNAL_W = WORDS_SQL.format("journal")
_ANY = lambda word: f"(list_contains({_W}, '{word}') OR list_contains({_TITLE_W}, '{word}') OR list_contains({_JOURNAL_W}, '{word}'))"
_PHRASE = lambda words, text: f"contains(' ' || array_to_string({words}, ' ') || ' ', ' {text} ')"


def _order():
    return [F.desc("n_chars"), F.col("doc_id")]


def _fields():
    return {k: f(k) for k, f in FIELDS.items()}


def _found(spark, sf, text, trash=None):
    return search.search(publications(spark, sf), text, _fields(), {"labelid": F.col("labels"), "guid": F.col("guid")}, trash)


@query("search_page", f"WITH {PUBLICATIONS_SQL} SELECT doc_id, title, journal, n_chars FROM p WHERE list_contains({_JOURNAL_W}, 'src1') AND {_ANY('the')} ORDER BY n_chars DESC, doc_id LIMIT 25")
def search_page(spark, sf):
    """A fielded search's first page."""
    return search.page(search.light(_found(spark, sf, 'journal:src1 the'), ["doc_id", "title", "journal", "n_chars"]), 0, 25, _order())


@query("search_second_page", f"WITH {PUBLICATIONS_SQL} SELECT doc_id, journal, n_chars FROM p WHERE {_ANY('and')} ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25")
def search_second_page(spark, sf):
    return search.page(search.light(_found(spark, sf, "and"), ["doc_id", "journal", "n_chars"]), 25, 25, _order())


@query("search_past_end", f"WITH {PUBLICATIONS_SQL} SELECT doc_id FROM p WHERE labels = 'de' ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 100000000")
def search_past_end(spark, sf):
    """An offset beyond the last match gives an empty page."""
    return search.page(_found(spark, sf, "labelid:de").select("doc_id", "n_chars"), 100_000_000, 25, _order()).select("doc_id")


@query("search_count", f"WITH {PUBLICATIONS_SQL} SELECT count(*) AS total FROM p WHERE {_ANY('of')}")
def search_count(spark, sf):
    return search.count(_found(spark, sf, "of"))


@query("search_phrase", f"WITH {PUBLICATIONS_SQL} SELECT doc_id FROM p WHERE {_PHRASE(_W, 'of the')} AND labels = 'en'")
def search_phrase(spark, sf):
    """A quoted phrase in one field, and a whole-value field."""
    return _found(spark, sf, 'text:"of the" labelid:en').select("doc_id")


@query("search_trash", f"WITH {PUBLICATIONS_SQL} SELECT count(*) AS total FROM p WHERE trashed AND {_ANY('la')}")
def search_trash(spark, sf):
    return search.count(_found(spark, sf, "la", trash=True))


@query("search_live", f"WITH {PUBLICATIONS_SQL} SELECT count(*) AS total FROM p WHERE NOT trashed AND {_ANY('la')}")
def search_live(spark, sf):
    return search.count(_found(spark, sf, "la", trash=False))


@query("search_composed", f"WITH {PUBLICATIONS_SQL} SELECT doc_id FROM p WHERE labels = 'en' AND list_contains({_TITLE_W}, 'the') AND list_contains({_TITLE_W}, 'and')")
def search_composed(spark, sf):
    """A base query, and an input restricted to one field."""
    return _found(spark, sf, search.compose("labelid:en", "the and", "title")).select("doc_id")


@query("search_empty", "SELECT count(*) AS total FROM documents")
def search_empty(spark, sf):
    """An empty query matches everything."""
    return search.count(_found(spark, sf, ""))


@query("search_boolean_tree", f"WITH {PUBLICATIONS_SQL} SELECT doc_id FROM p WHERE (list_contains({_W}, 'the') OR list_contains({_W}, 'der')) AND list_contains({_JOURNAL_W}, 'src2')")
def search_boolean_tree(spark, sf):
    tree = (("text:the", "or", "text:der"), "and", "journal:src2")
    return publications(spark, sf).where(tree_query(tree, lambda t: search.condition(t, _fields()))).select("doc_id")


@query("search_guid", "SELECT doc_id, 'G' || CAST(doc_id AS VARCHAR) AS guid FROM documents WHERE doc_id = 17")
def search_guid(spark, sf):
    """An exact key."""
    return _found(spark, sf, "guid:G17").select("doc_id", "guid")


@query("search_all_rows", "SELECT doc_id, lang AS labels FROM documents ORDER BY doc_id")
def search_all_rows(spark, sf):
    return search.all_rows(search.light(publications(spark, sf), ["doc_id", "labels"]), [F.col("doc_id")])


@query("page_numbers", "SELECT source AS journal, count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM documents GROUP BY source")
def page_numbers(spark, sf):
    counts = publications(spark, sf).groupBy("journal").agg(F.count(F.lit(1)).alias("total"))
    return counts.withColumn("pages", search.page_count(F.col("total"), 25))


@query("token_index", f"WITH t AS (SELECT doc_id, unnest({_W}) AS token FROM documents) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY token")
def token_index(spark, sf):
    """The inverted index, summed up by token."""
    index = search.token_index(publications(spark, sf), "doc_id", {"text": F.col("text")})
    docs = index.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("index_phrase", f"SELECT doc_id FROM documents WHERE {_PHRASE(_W, 'in the')} AND list_contains({_W}, 'and')")
def index_phrase(spark, sf):
    """A phrase and a word through the inverted index of the words that it needs."""
    text = '"in the" and'
    index = search.token_index(publications(spark, sf), "doc_id", {"text": F.col("text")}, search.wanted_tokens(text))
    return search.index_search(index, "doc_id", text)


@query("stored_index_search", f"WITH {PUBLICATIONS_SQL} SELECT doc_id FROM p WHERE {_PHRASE(_W, 'of the')} AND list_contains({_JOURNAL_W}, 'src1') AND len(list_filter({_TITLE_W}, lambda w: starts_with(w, 'th'))) > 0")
def stored_index_search(spark, sf):
    """An index of all fields written once by token, and a search that reads the buckets of its words."""
    fields = {"text": F.col("text"), "title": F.col("title"), "journal": F.col("journal"), "keyword": F.col("labels")}
    index = search.StoredIndex.write(publications(spark, sf), "doc_id", fields, working_folder(spark, "index"), 64)
    return search.index_search(index, "doc_id", 'text:"of the" journal:src1 title:th*')


@query("typeahead", "SELECT DISTINCT c_mktsegment AS short, lower(c_mktsegment) AS long FROM customer WHERE starts_with(lower(c_mktsegment), 'ma') OR starts_with(lower(c_mktsegment), 'ma')")
def typeahead(spark, sf):
    journals = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("short"), F.lower("c_mktsegment").alias("long")).distinct()
    return search.typeahead(journals, "ma")


@query("hist_source", "SELECT source AS name, count(*) AS count FROM documents WHERE source <> '' GROUP BY source")
def hist_source(spark, sf):
    return aggregates.histogram(publications(spark, sf), F.array("journal"))


@query("hist_name_token", "SELECT name, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part) WHERE name <> '' GROUP BY name")
def hist_name_token(spark, sf):
    return aggregates.histogram(table(spark, sf, "part"), F.split("p_name", " "))


_CLOUD = """k AS (SELECT name, count FROM c ORDER BY count DESC, name LIMIT 302),
m AS (SELECT min(ln(CAST(greatest(count, 1) AS DOUBLE))) AS lo, max(ln(CAST(greatest(count, 1) AS DOUBLE))) AS hi FROM k)
SELECT name, count, CAST(10 + floor(CASE WHEN hi > lo THEN (ln(CAST(greatest(count, 1) AS DOUBLE)) - lo) / (hi - lo) ELSE 1.0 END * 10 + 1e-9) AS BIGINT) AS size FROM k, m"""


@query("cloud_source", f"WITH c AS (SELECT source AS name, count(*) AS count FROM documents WHERE source <> '' GROUP BY source), {_CLOUD}")
def cloud_source(spark, sf):
    counts = aggregates.histogram(publications(spark, sf), F.array("journal"))
    return aggregates.cloud_order(aggregates.cloud(counts)).select("name", "count", "size")


@query("cloud_words", f"WITH c AS (SELECT token AS name, count(*) AS count FROM (SELECT unnest({_W}) AS token FROM documents) GROUP BY token), {_CLOUD}")
def cloud_words(spark, sf):
    """The most frequent words; more names than a cloud keeps."""
    counts = aggregates.histogram(publications(spark, sf), search.tokens(F.col("text")))
    return aggregates.cloud_order(aggregates.cloud(counts), "count").select("name", "count", "size")


@query("top_journals", "SELECT source AS name, count(*) AS count FROM documents GROUP BY source ORDER BY count DESC, name LIMIT 10")
def top_journals(spark, sf):
    return aggregates.top_k(aggregates.field_counts(publications(spark, sf), "journal"), 10)


@query("pubtypes", "SELECT o_orderstatus AS name, count(*) AS count FROM orders GROUP BY 1")
def pubtypes(spark, sf):
    return aggregates.field_counts(table(spark, sf, "orders"), "o_orderstatus")


@query(
    "dash_stats",
    """SELECT count(*) AS num_items, count(*) FILTER (o_orderstatus = 'F') AS num_pdfs,
       CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 2 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS BIGINT) AS num_attachments, max(o_orderdate) AS last_imported
       FROM orders WHERE o_orderstatus <> 'P'""",
)
def dash_stats(spark, sf):
    o = table(spark, sf, "orders")
    shape = o.select(
        F.when(F.col("o_orderstatus") == "F", "a.pdf").alias("pdf"),
        F.when(F.col("o_orderpriority").startswith("1"), "a,b").when(F.col("o_orderpriority").startswith("2"), "a").alias("attachments"),
        F.col("o_orderdate").alias("created"),
        (F.col("o_orderstatus") == "P").alias("trashed"),
    )
    return aggregates.dashboard(shape)


@query(
    "queue_stats",
    """WITH j AS (SELECT event_type AS type, CASE WHEN user_id % 3 = 0 THEN 'PENDING' ELSE 'DONE' END AS status, user_id % 7 = 1 AND user_id % 3 <> 0 AS error, user_id AS duration FROM events)
       SELECT type, count(*) FILTER (status = 'PENDING') AS num_pending, count(*) FILTER (status = 'DONE' AND NOT error) AS num_done, count(*) FILTER (error) AS num_error,
       count(*) FILTER (status = 'DONE' AND NOT error) / (count(*) FILTER (status = 'PENDING') + count(*) FILTER (status = 'DONE' AND NOT error)) AS progress,
       CAST(round(avg(duration) FILTER (status = 'DONE' AND NOT error) * count(*) FILTER (status = 'PENDING')) AS BIGINT) AS eta FROM j GROUP BY type""",
)
def queue_stats(spark, sf):
    e, u = table(spark, sf, "events"), F.col("user_id")
    jobs = e.select(F.col("event_type").alias("type"), F.when(u % 3 == 0, "PENDING").otherwise("DONE").alias("status"), ((u % 7 == 1) & (u % 3 != 0)).alias("error"), u.alias("duration"))
    return aggregates.queue_stats(jobs)


@query("joined_names", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def joined_names(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return aggregates.joined_text(n, ["r_name"], "n_name")
