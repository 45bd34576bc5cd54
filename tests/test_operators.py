"""Search, matching, library, page and layout operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import aggregates, layouts, library, matching, search, webpages
from folioflow.sources.records import DatabaseVersionError, QueryError
from folioflow.streaming import feeds


def test_query_parser():
    assert search.parse_query('a author:"Paul Sandler" year:2008 "x y"') == [(None, "a", False), ("author", "Paul Sandler", True), ("year", "2008", False), (None, "x y", True)]
    assert search.parse_query(None) == [] and search.compose("labelid:1", " a  b ", "title") == "labelid:1 title:a title:b" and search.compose(None, "") == ""


def test_conditions(spark):
    df = spark.createDataFrame([(1, "RNA folding, fast", "x"), (2, "rna-fold", "x"), (3, None, "y")], "id int, title string, label string")
    hits = lambda q: [r["id"] for r in df.where(search.condition(q, {"title": F.col("title")}, {"labelid": F.col("label")})).orderBy("id").collect()]
    assert hits("") == [1, 2, 3] and hits("rna") == [1, 2] and hits("title:fold*") == [1, 2] and hits('"folding fast"') == [1] and hits("labelid:y") == [3] and hits("fol") == [] and hits("year:1") == []
    with pytest.raises(QueryError):
        hits("nofield:x")


def test_index_agrees_with_scan(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(k, " ".join(r.choice("abcd") for _ in range(6)), r.choice("abcd")) for k in range(60)], "id int, t string, u string")
    index = search.token_index(df, "id", {"t": F.col("t"), "u": F.col("u")})
    for q in ('"a b"', "a d", 't:"b c" u:a', "d", ""):
        want = {x["id"] for x in df.where(search.condition(q, {"t": F.col("t"), "u": F.col("u")})).collect()}
        assert {x["id"] for x in search.index_search(index, "id", q).collect()} == want, q


def test_pages(spark):
    df = spark.range(23)
    ids = lambda o, n: [r["id"] for r in search.page(df, o, n, [F.desc("id")]).collect()]
    assert ids(0, 10) == list(range(22, 12, -1)) and ids(20, 10) == [2, 1, 0] and ids(30, 10) == []
    assert search.typeahead(spark.createDataFrame([("Nat Gen", "Nature Genetics"), ("Cell", "Cell")], "short string, long string"), "ge").count() == 1


def test_cloud(spark):
    counts = spark.createDataFrame([(f"n{k}", k) for k in range(1, 401)], "name string, count long")
    c = aggregates.cloud(counts).collect()
    assert len(c) == 302 and max(x["size"] for x in c) == 20 and min(x["size"] for x in c) == 10
    assert {x["weight"] for x in aggregates.cloud(counts.limit(1)).collect()} == {1.0}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_title_pairs_lose_none(spark):
    r = random.Random(2)
    base = ["".join(r.choice("ABC") for _ in range(r.randint(0, 25))) for _ in range(25)]
    titles = list(base)
    for t in base:
        x = list(t)
        for _ in range(r.randint(1, 5)):
            k = r.randint(0, len(x))
            x[k : k + r.randint(0, 1)] = r.choice(["", "A", "B"])
        titles.append("".join(x))
    df = spark.createDataFrame(list(enumerate(titles)), "id int, t string")
    want = {(a, b, lev(titles[a], titles[b])) for a in range(len(titles)) for b in range(a + 1, len(titles)) if lev(titles[a], titles[b]) < 5}
    assert {tuple(x) for x in matching.duplicate_pairs(df, "id", "t").collect()} == want


def test_simhash_pairs_lose_none(spark):
    r = random.Random(3)
    h = [r.getrandbits(64) - (1 << 63) for _ in range(20)]
    for x in list(h):
        for _ in range(2):
            y = x
            for _ in range(r.randint(0, 4)):
                y ^= 1 << r.randint(0, 62)
            h.append(y)
    df = spark.createDataFrame(list(enumerate(h)), "id int, h long")
    rows = matching.simhash_pairs(df, "id", "h").collect()
    near = {(a, b) for a in range(len(h)) for b in range(a + 1, len(h)) if bin((h[a] ^ h[b]) & (2**64 - 1)).count("1") <= 3}
    first = {x: min(k for k, y in enumerate(h) if y == x) for x in h}
    assert {(x["a"], x["b"]) for x in rows} == {(a, b) for a, b in near if (first[h[a]] == a and first[h[b]] == b) or (h[a] == h[b] and first[h[a]] == a)}


def test_duplicates_of_any_number_lose_none(spark):
    r = random.Random(8)
    titles = ["Protein folding kinetics study", "Kinetics study protein folding", "Kinetics study protein folding", "KINETICS STUDY PROTEIN FOLDING", "Errata", "Errata", "The War", "the war", "", "", None, "abc", "abcd", "axcdyfgh"]
    for n in (3, 6, 7, 12, 13, 30, 31):
        base = "".join(r.choice("abcdé") for _ in range(n))
        for _ in range(12):
            t = list(base)
            for _ in range(r.randint(0, 5)):
                k = r.randint(0, len(t))
                t[k : k + r.randint(0, 1)] = r.choice([[], ["x"], ["a"]])
            titles.append("".join(t))
    keys = [None if t is None else t.replace(" ", "").upper() for t in titles]
    first = {}
    for k, x in enumerate(keys):
        first.setdefault(x, k)
    own = [(x, k) for x, k in first.items() if x is not None]
    want = {(first[x], k) for k, x in enumerate(keys) if x is not None and first[x] != k}
    want |= {(min(a, b), max(a, b)) for n, (x, a) in enumerate(own) for y, b in own[:n] if lev(x, y) < 5}
    for extra in (0, 600):  # few records and many
        more = [f"{k} {r.getrandbits(200):x}" for k in range(extra)]
        df = spark.createDataFrame(list(enumerate(titles + more)), "id int, t string")
        got = [tuple(x) for x in matching.duplicates(df, "id", "t").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_blocks_of_hashes_are_not_broadcast(spark):
    h = spark.range(300).select("id", F.xxhash64(F.col("id") % 200).alias("h"))
    pairs = matching.simhash_pairs(h, "id", "h")
    plan = pairs._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    joins = [line for line in plan.splitlines() if "Join" in line and "band" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert {(r["a"], r["b"]) for r in pairs.collect()} >= {(k, k + 200) for k in range(100)}


def test_dup_simhash_keeps_texts_of_one_long_word(spark, tmp_path):
    from folioflow.plans import record_queries

    texts = ["Errata", "Preface", "Errata", "Errata", "", "", "the War", None, None, "one long sentence here", "one long sentence here"]
    rows = [(k, t, "en", "src0", 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(x) for x in record_queries.dup_simhash(spark, f"file://{tmp_path}").collect()}
    assert got == {(0, 2, 0), (0, 3, 0), (4, 5, 0), (9, 10, 0)}


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "g", "T", "A and B"), (2, "h", "", "C")], "k int, guid string, title string, authors string")
    new = spark.createDataFrame([(1, "x", "0", "A and {others}"), (2, "y", "New", "D")], "k int, guid string, title string, authors string")
    once = matching.merge_record(old, new, "k", ["guid", "title", "authors"])
    assert {tuple(r) for r in once.collect()} == {(1, "g", "T", "A and B"), (2, "h", "New", "D")}
    assert {tuple(r) for r in matching.merge_record(once, new, "k", ["guid", "title", "authors"]).collect()} == {tuple(r) for r in once.collect()}


def test_keys_and_providers(spark):
    df = spark.createDataFrame([(k, "Huber2015") for k in range(30)], "id int, base string")
    keys = [r["citekey"] for r in matching.citekeys(df, "base", [F.col("id")]).orderBy("id").collect()]
    assert keys[:4] == ["Huber2015", "Huber2015a", "Huber2015b", "Huber2015c"] and len(set(keys)) == 30
    row = spark.range(1).select(matching.reconciled_authors(F.lit("Doe, J and Roe, R. K."), F.array(F.lit("Jane M. Doe"), F.lit("R.K. Roe"))).alias("a")).first()
    assert row["a"] == "Doe, Jane M. and Roe, R. K."


def test_library(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "guid string, v int")
    assert {tuple(r) for r in library.changes(t, spark.createDataFrame([("b", 3), ("c", None)], "guid string, v int")).collect()} == {("a", "DELETE"), ("b", "UPDATE"), ("c", "INSERT")}
    assert library.changes(t, t).count() == 0
    assert {tuple(r) for r in library.upsert(t, spark.createDataFrame([("b", 9), ("d", 1)], "guid string, v int"), "guid").collect()} == {("a", 1), ("b", 9), ("d", 1)}
    log = library.numbered(t, [F.desc("guid")]).orderBy("counter").collect()
    assert [r["guid"] for r in log] == ["b", "a"] and log[0]["counter"] < log[1]["counter"]
    assert library.migrated(t, 1, 3, {1: lambda x: x.withColumn("n", F.lit(1)), 2: lambda x: x.drop("v")}).columns == ["guid", "n"]
    with pytest.raises(DatabaseVersionError):
        library.check_version({"db_version": "2"}, 3)


META = '<html><head><title>P</title><meta name="citation_title" content="A title"><meta name="citation_author" content="Jane Roe"><meta name="citation_author" content="Doe, John"><meta name="citation_firstpage" content="3"><meta name="citation_lastpage" content="9"><meta name="citation_date" content="2010/05/01"><meta name="citation_doi" content="doi:10.1000/x.1"></head></html>'


def test_pages_to_records(spark):
    lancet = '<h1>T</h1><a class="ja50-ce-author">Jane Roe</a><div id="article_cite">The Lancet, Volume 377, Issue 9768 , Pages 813 - 814, 5 March 2011</div><div id="article_DOI">doi:10.1016/S1 Cite or Link</div>'
    books = '<td class="metadata_label">Title</td><td class="metadata_value">Big Book</td><td class="metadata_label">Publisher</td><td class="metadata_value">Acme, 2004</td><td class="metadata_label">Length</td><td class="metadata_value">320 pages</td>'
    emerald = '<div class="toc">Title: On Things Author(s): Jane Roe, John Doe Journal: J Things Year: 2009 Volume: 3 Issue: 2 Page: 5 - 9 DOI: 10.1/x Publisher: Emerald</div>'
    rows = [
        (1, "http://x.org/1", META), (2, "http://www.thelancet.com/a", lancet), (3, "http://books.google.com/books?id=1", books), (4, "http://www.emeraldinsight.com/1", emerald), (5, "http://x.org/2", "<p>none</p>"),
        (6, "", META), (7, "http://x.org/f.doc", META), (8, "http://x.org/3", "<pre>@article{k, title={In page}, year=1999}</pre>"), (9, None, None), (10, "http://www.nature.com/doifinder/10.1", META),
    ]
    got = {r["page_id"]: r for r in webpages.extract_records(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert (got[1]["title"], got[1]["authors"], got[1]["pages"], got[1]["year"], got[1]["doi"]) == ("A title", "Roe, Jane and Doe, John", "3-9", "2010", "10.1000/x.1")
    assert (got[2]["journal"], got[2]["volume"], got[2]["issue"], got[2]["pages"], got[2]["year"], got[2]["doi"]) == ("The Lancet", "377", "9768", "813-814", "2011", "10.1016/S1")
    assert (got[3]["title"], got[3]["publisher"], got[3]["year"], got[3]["pages"], got[3]["pubtype"]) == ("Big Book", "Acme", "2004", "320", "BOOK")
    assert (got[4]["title"], got[4]["authors"], got[4]["journal"], got[4]["pages"], got[4]["doi"]) == ("On Things", "Roe, Jane and Doe, John", "J Things", "5-9", "10.1/x")
    assert got[8]["title"] == "In page" and got[8]["year"] == "1999"
    assert all(got[k]["error"] == "UnknownSiteError" for k in (5, 6, 7, 9, 10))


def test_follow_ups(spark):
    pages = [
        (1, "http://iopscience.iop.org/0001-1/2/3/", '<meta name="citation_title" content="T"><meta name="citation_abstract" content="A">'),
        (2, "http://la-press.com/x", '<a class="endnote" href="exp.php?id=3">e</a><div class="journalListingAuthor">J 2010:4 5-9</div>'),
        (3, "http://onlinelibrary.wiley.com/1", '<a href="/documentcitationdownload?a=1&amp;b=2">c</a>'),
        (4, "http://x.org/f", '<frameset><frame src="menu.html"><frame src="http://x.org/one"><frame src="http://x.org/two"></frameset>'),
        (5, "http://x.org/p", '<meta name="citation_title" content="Short"><meta name="citation_pmid" content="77">'),
        (6, "http://books.google.com/books?id=1", '<a href="http://books.google.com/books/download/x?output=bibtex">b</a>'),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    wants = {(r["page_id"], r["step"], r["position"]): r["address"] for r in webpages.follow_ups(df).collect()}
    assert wants == {
        (1, "export", 0): "http://iopscience.iop.org/export?articleId=0001-1/2/3&exportFormat=iopexport_bib&exportType=abs", (2, "export", 0): "http://la-press.com/exp.php?id=3",
        (3, "export", 0): "http://onlinelibrary.wiley.com/documentcitationdownload?a=1&b=2", (4, "frame", 0): "http://x.org/one", (4, "frame", 1): "http://x.org/two", (6, "export", 0): "http://books.google.com/books/download/x?output=bibtex",
    }
    ris = "TY  - JOUR\nTI  - From RIS\nVL  - 99\nER  - \n"
    linked = [(wants[1, "export", 0], "@article{k, title={Full}, year=2001}"), (wants[2, "export", 0], ris), (wants[3, "export", 0], ris), ("http://x.org/one", "<p>menu</p>"), ("http://x.org/two", '<meta name="citation_title" content="Framed">'), (wants[6, "export", 0], "@book{b, title={Read}}")]
    pubmed = spark.createDataFrame([("77", "Whole title", "J"), ("78", "Other", "J")], "pmid string, title string, journal string")
    got = {r["page_id"]: r for r in webpages.extract_records(df, linked=spark.createDataFrame(linked, "url string, html string"), pubmed=pubmed).collect()}
    assert {k: r["title"] for k, r in got.items()} == {1: "Full", 2: "From RIS", 3: "From RIS", 4: "Framed", 5: "Whole title", 6: "Read"}
    assert got[1]["year"] == "2001" and got[1]["abstract"] is None and (got[2]["volume"], got[2]["pages"], got[3]["volume"]) == ("4", "5-9", "99") and got[5]["journal"] == "J"
    alone = {r["page_id"]: r["error"] for r in webpages.extract_records(df).collect()}
    assert alone == {1: None, 2: "UnknownSiteError", 3: "UnknownSiteError", 4: "UnknownSiteError", 5: None, 6: "UnknownSiteError"}


def test_citation_parts():
    assert webpages.citation_parts("The Lancet, Volume 377, Issue 9768, Page 813, 5 March 2011") == {"journal": "The Lancet", "volume": "377", "issue": "9768", "pages": "813", "month": "March", "year": "2011"}
    assert webpages.citation_parts("none") == {}
    page = '<div class="artiHead">J Things Volume 4, Issues 1-2, 15 May 2009, Pages 7-19</div><div class="articleTitle">On X</div><a target="doilink">doi:10.1016/j.x</a><div class="articleText_indent">Abstract We see.</div><div id="authorsAnchors">J.Roe and K. Doe, a</div>'
    got = webpages.read_page("http://www.sciencedirect.com/1", page)[0]
    assert {k: got[k] for k in ("journal", "volume", "issue", "pages", "month", "year", "doi", "abstract", "authors")} == {"journal": "J Things", "volume": "4", "issue": "1-2", "pages": "7-19", "month": "May", "year": "2009", "doi": "10.1016/j.x", "abstract": "We see.", "authors": "Roe, J. and Doe, K."}
    got = webpages.read_page("http://www.nature.com/1", '<meta name="citation_title" content="T"><div id="abs" class="x"><a href="#top">Top of page</a><h2>Abstract</h2><p>We <i>see</i>.</p></div>')[0]
    assert got["abstract"] == "We see."


def line(doc, position, content, fs, xmin=40.0, xmax=300.0, ymin=0.0, bad=0, common=0, address=0):
    return (doc, position, content, float(fs), xmin, xmax, ymin, bad, 0, common, address)


def test_layouts(spark):
    rows = [
        line("n", 0, "www.nature.com/x", 7), line("n", 1, "A fine", 24, ymin=50.0), line("n", 2, "title", 24, ymin=70.0), line("n", 3, "Jane Roe, John Doe", 10, ymin=90.0), line("n", 4, "Institute", 10, ymin=110.0, address=1),
        line("s", 0, "www.sciencemag.org", 7), line("s", 1, "RESEARCH ARTICLES", 20), line("s", 2, "Science title", 20, ymin=40.0), line("s", 3, "Ann Roe", 10, ymin=60.0), line("s", 4, "the words", 10, ymin=70.0, common=2),
        line("j", 0, "Old title", 12), line("j", 1, "Author(s): A. Roe", 12), line("j", 2, "Source: X", 12), line("j", 3, "Your use of the JSTOR archive indicates", 8),
        line("b", 0, "Biopolymers, Vol. 12", 9), line("b", 1, "Bio title", 18), line("b", 2, "R. Roe", 11), line("b", 3, "Dept", 9, address=1), line("b", 4, "No One", 11),
        line("l", 0, "Landes Bioscience", 9), line("l", 1, "Land title", 24), line("l", 2, "A. Roe,", 12, xmin=36.0),
        line("u", 0, "Unknown", 24),
    ]
    got = {r["doc"]: (r["title"], r["authors"]) for r in layouts.extract_titles(spark.createDataFrame(rows, layouts.LINE)).collect()}
    assert got == {"n": ("A fine title", "Jane Roe, John Doe"), "s": ("Science title", "Ann Roe"), "j": ("Old title", "A. Roe"), "b": ("Bio title", "R. Roe"), "l": ("Land title", "A. Roe,"), "u": (None, None)}
    # a block ends at the abstract, at a gap, far below the heading, and at common words away from it; other columns don't count
    blocks = [
        line("gap", 0, "www.nature.com", 7), line("gap", 1, "Wide gap", 32), line("gap", 2, "A. Roe and Co", 9, ymin=20.0), line("gap", 3, "B. Roe and Co", 9, ymin=60.0),
        line("abs", 0, "www.nature.com", 7), line("abs", 1, "No names", 32), line("abs", 2, "Abstract", 9, ymin=20.0), line("abs", 3, "A. Roe and Co", 9, ymin=30.0), line("abs", 4, "Later title", 28, ymin=50.0), line("abs", 5, "C. Roe and Co", 11, ymin=60.0),
        line("far", 0, "www.nature.com", 7), line("far", 1, "Far", 32), line("far", 2, "A. Roe and Co", 9, ymin=400.0),
        line("two", 0, "www.nature.com", 7), line("two", 1, "Two", 32), line("two", 2, "A. Roe of the Co", 9, ymin=20.0, common=2), line("two", 3, "B. Roe of the Co", 9, ymin=30.0, common=2), line("two", 4, "Side", 9, xmin=900.0, xmax=950.0, ymin=25.0),
        line("next", 0, "www.nature.com", 7), line("next", 1, "First", 32), line("next", 2, "Second", 28), line("next", 3, "A. Roe and Co", 11, ymin=20.0),
    ]
    got = {r["doc"]: (r["title"], r["authors"]) for r in layouts.extract_titles(spark.createDataFrame(blocks, layouts.LINE)).collect()}
    assert got == {"gap": ("Wide gap", "A. Roe and Co"), "abs": ("Later title", None), "far": ("Far", None), "two": ("Two", "A. Roe of the Co"), "next": ("Second", "A. Roe and Co")}
    side = spark.createDataFrame([("gap", "x"), ("u", "www.nature.com")], "doc string, content string")
    got = layouts.extract_titles(spark.createDataFrame([line("u", 0, "Turned", 32)], layouts.LINE), side).collect()
    assert [(r["doc"], r["title"], r["authors"]) for r in got] == [("u", "Turned", None)]
    words = spark.createDataFrame([("d", 1, "b", 20.0, 30.0, 10.4, 9.0), ("d", 1, "a", 5.0, 15.0, 10.0, 9.0), ("d", 1, "c", 5.0, 15.0, 40.0, 9.0)], "doc string, page int, word string, xmin double, xmax double, ymin double, size double")
    assert sorted(r["content"] for r in layouts.words_to_lines(words).collect()) == ["a b", "c"]


def test_streams(spark, tmp_path):
    from folioflow.streaming.run import drained

    rows = [("a", "t", "2024-01-01 00:00:00"), ("a", "t", "2024-01-01 00:01:00"), ("b", "t", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "authors string, title string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    out = drained(feeds.new_items(feeds.file_stream(spark, str(tmp_path / "in"), df.schema), "at"))
    assert out.count() == 2
    write = feeds.merge_into(str(tmp_path / "table"), "authors")
    write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    jobs = spark.createDataFrame([("1", "PENDING"), ("2", "RUNNING"), ("3", "ERROR"), ("4", "DONE")], "jobid string, status string")
    state = lambda d: {r["jobid"]: r["status"] for r in d.collect()}
    assert state(feeds.command(jobs, "pause")) == {"1": "PAUSED", "2": "RUNNING", "3": "ERROR", "4": "DONE"}
    assert state(feeds.command(jobs, "cancel", ["2"]))["2"] == "CANCELED" and state(feeds.command(jobs, "retry"))["3"] == "PENDING" and set(state(feeds.command(jobs, "clear"))) == {"1", "2"}
    assert jobs.where(feeds.allowed(F.col("status"), F.lit("RUNNING"))).count() == 1


def test_styles(spark):
    from folioflow.sinks import writers

    rows = [("Roe, Jane Maria and Doe, J.", "On things", "J Things", "3", "2", "5-9", "2001"), (None, "Alone", None, None, None, None, "2002"), (" and ".join(f"N{k}, A" for k in range(9)), "Many", "J", "1", None, None, None)]
    df = spark.createDataFrame(rows, "authors string, title string, journal string, volume string, issue string, pages string, year string")
    got = {s: [r["c"] for r in df.select(writers.styled_citation(df, s).alias("c")).collect()] for s in writers.STYLES}
    assert got["nature"] == ["Roe, J. M. & Doe, J. On things. J Things 3, 5-9 (2001).", "Alone. (2002).", "N0, A. et al. Many. J 1,"]
    assert got["author-date"][0] == "Roe, J. M., & Doe, J. (2001). On things. J Things, 3(2), 5-9."
    assert got["initials first"][0] == "J. M. Roe and J. Doe, On things, J Things, vol. 3, no. 2, pp. 5-9, 2001."


def test_sinks_and_formats(spark, tmp_path):
    from folioflow.plugins import names, plugin
    from folioflow.sources import formats
    from folioflow.sources.records import FileFormatError, FileReadError, FolioError

    df = spark.createDataFrame([("k", "Title", "Roe, J", "ARTICLE")], "citekey string, title string, authors string, pubtype string")
    plugin("sink", "FILE")(df, {"out_format": "RIS", "path": str(tmp_path / "r")}).write()
    assert formats.guess_format(spark, str(tmp_path / "r")).name == "RIS"
    assert formats.read_any(spark, str(tmp_path / "r")).first()["title"] == "Title"
    text = plugin("sink", "file")(df, {"out_format": "bibtex", "use_quotes": True}).write()
    assert text.startswith("@ARTICLE{k,") and '"Title"' in text
    plugin("sink", "library")(df, {"path": str(tmp_path / "lib")}).write()
    assert plugin("format", "library").read(spark, str(tmp_path / "lib")).first()["title"] == "Title"
    assert "CITATIONS" in formats.formats(readable=False) and "ZOTERO" in formats.formats(writable=False) and formats.formats(readable=True, writable=True) == ["BIBTEX", "LIBRARY", "RIS"]
    with pytest.raises(FileFormatError):
        plugin("format", "zotero").write(df, str(tmp_path / "z"))
    with pytest.raises(FileReadError):
        formats.read_any(spark, str(tmp_path / "none"))
    (tmp_path / "plain.txt").write_text("plain")
    with pytest.raises(FileFormatError):
        formats.read_any(spark, str(tmp_path / "plain.txt"))
    assert {"nature", "jstor"} <= set(names("layout")) and {"lancet", "default"} <= set(names("extractor"))
    with pytest.raises(FolioError):
        plugin("sink", "none")


def test_jobs_by_type_and_reads(spark, tmp_path):
    from folioflow.functions.text import new_guid, seconds_ago
    from folioflow.sources.records import FolioError
    from folioflow.streaming.run import drained

    jobs = spark.createDataFrame([("a", "PDF_IMPORT", "PENDING"), ("b", "PDF_SEARCH", "PENDING"), ("c", "PDF_IMPORT", "DONE")], "jobid string, type string, status string")
    mark = lambda text: lambda df: df.select("jobid", F.lit(text).alias("did"))
    assert {tuple(r) for r in feeds.dispatched(jobs, {"PDF_IMPORT": mark("i"), "PDF_SEARCH": mark("s")}).collect()} == {("a", "i"), ("b", "s")}
    with pytest.raises(Exception, match="no handler for PDF_SEARCH"):
        feeds.dispatched(jobs, {"PDF_IMPORT": mark("i")}).collect()
    with pytest.raises(FolioError):
        feeds.dispatched(jobs, {"OTHER": mark("i")})
    pubs = spark.createDataFrame([("a", 1, None), ("b", None, "2024-01-01 00:00:00")], "guid string, times_read int, last_read string").withColumn("last_read", F.to_timestamp("last_read"))
    reads = spark.createDataFrame([("a", "2024-02-01 00:00:00"), ("a", "2024-03-01 00:00:00")], "guid string, at string").withColumn("at", F.to_timestamp("at"))
    got = {r["guid"]: (r["times_read"], str(r["last_read"])) for r in library.mark_read(pubs, reads).collect()}
    assert got == {"a": (3, "2024-03-01 00:00:00"), "b": (0, "2024-01-01 00:00:00")}
    row = spark.range(1).select(seconds_ago(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 01:00:30").cast("timestamp"), "Europe/Vienna").alias("s"), new_guid().alias("g")).first()
    assert row["s"] == 30 and len(row["g"]) == 32 and row["g"] == row["g"].upper()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text("x")
    (tmp_path / "in" / "b.txt").write_text("x")
    found = drained(feeds.watched_files(spark, str(tmp_path / "in"), "*.pdf")).collect()
    assert [r["path"].rpartition("/")[2] for r in found] == ["a.pdf"]
