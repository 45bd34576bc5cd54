"""String, name, pattern and hash functions against tables of known results."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import names, patterns, simhash, text

SPLITS = [
    ("Donald E. Knuth", ("Donald E.", None, "Knuth", None)), ("John Chris Smith", ("John Chris", None, "Smith", None)), ("Smith, John Chris", ("John Chris", None, "Smith", None)),
    ("Thomas von Neumann", ("Thomas", "von", "Neumann", None)), ("von Neumann, Thomas", ("Thomas", "von", "Neumann", None)), ("Lopez Fernandez, Miguel", ("Miguel", None, "Lopez Fernandez", None)),
    ("Pierre de la Porte", ("Pierre", "de la", "Porte", None)), ("Smith, Jr., Robert", ("Robert", None, "Smith", "Jr.")), ("von Smith, Jr., Robert", ("Robert", "von", "Smith", "Jr.")),
    ("Johannes Martinus Albertus van de Groene Heide", ("Johannes Martinus Albertus", "van de", "Groene Heide", None)), ("Maria-Victoria Delgrande", ("Maria-Victoria", None, "Delgrande", None)),
    ("Anonymous", (None, None, "Anonymous", None)), ("von Neumann", (None, "von", "Neumann", None)), ("N. Tetteh-Lartey", ("N.", None, "Tetteh-Lartey", None)), ("von Tetteh-Lartey, N.", ("N.", "von", "Tetteh-Lartey", None)),
    ("von Tetteh-Lartey, Jr.,  N.", ("N.", "von", "Tetteh-Lartey", "Jr.")), ("", (None,) * 4), ("   ", (None,) * 4), ("\n", (None,) * 4), ("al.", (None, None, "al.", None)), ("et. al.", (None, None, "et. al.", None)),
    ("O'Malley, A.", ("A.", None, "O'Malley", None)), ("A. O'Malley", ("A.", None, "O'Malley", None)), ("Arthur O'Malley", ("Arthur", None, "O'Malley", None)), ("O'Malley, Arthur", ("Arthur", None, "O'Malley", None)),
    ('L.M. M\\"uller', ("L.M.", None, 'M\\"uller', None)), ('M\\"uller, L.M.', ("L.M.", None, 'M\\"uller', None)), ('L.M. M"uller', ("L.M.", None, 'M"uller', None)), ('M"uller, L.M.', ("L.M.", None, 'M"uller', None)),
    ("{Barnes and Noble, Inc.}", (None, None, "Barnes and Noble, Inc.", None)),
    ("bb CC, AA", ("AA", "bb", "CC", None)), ("bb CC, aa", ("aa", "bb", "CC", None)), ("bb CC dd EE, AA", ("AA", "bb CC dd", "EE", None)), ("bb, AA", ("AA", None, "bb", None)), ("BB,", (None, None, "BB", None)),
    ("bb CC,XX, AA", ("AA", "bb", "CC", "XX")), ("BB,, AA", ("AA", None, "BB", None)),
]
INITIALS = {
    "": "", "Paul": "P", "P": "P", "P.": "P", " Paul ": "P", "Paul Florian": "PF", "Paul F.": "PF", "Paul F": "PF", "P.F.": "PF", "P. F.": "PF", "  P.F.  ": "PF", "P. Florian": "PF",
    "P.Florian": "PF", "Paul Florian Max": "PFM", "P F M": "PFM", "P. F. M.": "PFM", "P.F.M.": "PFM", "Paul FM": "PFM",
}


@pytest.mark.parametrize(("name", "parts"), SPLITS)
def test_split_name(name, parts):
    assert names.split_name(name) == parts


def test_braces_may_stay():
    assert names.split_name("{ENCODE consortium}", keep_braces=True)[2] == "{ENCODE consortium}"
    assert names.split_authors("A B and {C and D} and E, F") == ["A B", "{C and D}", "E, F"]
    assert names.freestyle_bibtex("Jeffrey D. Ullman") == "Ullman, Jeffrey D." and names.freestyle_bibtex(" ") is None


def test_name_columns(spark):
    df = spark.createDataFrame([(k, v) for k, v in INITIALS.items()], "first string, want string")
    assert df.where(names.initials(F.col("first")) != F.col("want")).count() == 0
    row = spark.createDataFrame([("Sandler, Paul F.",), (None,)], "n string").select(names.name_parts("n").alias("x"), names.authors_parts(F.lit("A, B and von C, D")).alias("all")).first()
    x = row["x"]
    one = spark.range(1).select(F.lit(x["last"]).alias("l"), F.lit(x["first"]).alias("f"), F.lit(None).cast("string").alias("v"))
    got = one.select(names.author_key(F.col("l"), F.col("f")), names.nice_name(F.col("v"), F.col("l"), F.col("f")), names.normalized_name(F.col("v"), F.col("l"), F.col("f")), names.bibtex_name(F.col("v"), F.col("l"), F.col("v"), F.col("f")), names.bibutils_name(F.col("l"), F.col("f"))).first()
    assert list(got) == ["SANDLER_PF", "Sandler PF", "Sandler, PF", "Sandler, Paul F.", "Sandler|Paul|F."]
    assert [p["von"] for p in row["all"]] == [None, "von"]
    back = spark.createDataFrame([("Oz|Wizard|V.", "Oz, Wizard V."), ("Phony-Baloney|F.|Phidias", "Phony-Baloney, F. Phidias")], "a string, b string")
    assert back.where(names.from_bibutils(F.col("a")) != F.col("b")).count() == 0


PATTERNS = {
    "[firstauthor]": "huber", "[Firstauthor]": "Huber", "[FIRSTAUTHOR]": "HUBER", "[Firstauthor:3]": "Hub", "[lastauthor]": "pichler", "[Lastauthor]": "Pichler", "[LASTAUTHOR]": "PICHLER",
    "[Authors]": "Huber_Lindner_Moser_Pichler", "[AUTHORS]": "HUBER_LINDNER_MOSER_PICHLER", "[Authors2]": "Huber_Lindner_et_al", "[authors3:4]": "hube_lind_mose_et_al",
    "[Title]": "Guidelines_to_counting_wet_pebbles_on_DRY_beaches", "[title]": "guidelines_to_counting_wet_pebbles_on_dry_beaches",
    "[TITLE]": "GUIDELINES_TO_COUNTING_WET_PEBBLES_ON_DRY_BEACHES", "[Title3]": "Guidelines_to_counting", "[Title3:3]": "Gui_to_cou", "[YY]": "15", "[YYYY]": "2015",
    "[journal]": "JIP_Pastimes", "[key]": "Test", "[Firstauthor][YYYY]": "Huber2015", "a [other] b": "a [other] b",
}


def test_patterns(spark):
    df = spark.createDataFrame([(["Huber", "Lindner", "Moser", "Pichler"], "Guidelines to counting wet pebbles on DRY beaches", "2015", "JIP Pastimes")], "a array<string>, t string, y string, j string")
    cols = [patterns.format_pattern(p, F.col("a"), F.col("t"), F.col("y"), F.col("j"), {"key": F.lit("Test")}) for p in PATTERNS]
    assert list(df.select(*cols).first()) == list(PATTERNS.values())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    cases = [
        (text.clean_doi(F.lit("DOI:  10.1234/abc.56")), "10.1234/abc.56"), (text.clean_doi(F.lit("none")), None), (text.clean_arxiv(F.lit("arXiv:1001.0001")), "1001.0001"),
        (text.single_dash(F.lit("40--52")), "40-52"), (text.double_dash(F.lit("40-52")), "40--52"), (text.year_of(F.lit("01.01.2011")), "2011"), (text.month_name(F.lit("nov")), "November"),
        (text.month_name(F.lit("03")), "03"), (text.strip_tex(F.lit(r"is \textbf{bold}")), "is bold"), (text.strip_short_tags(F.lit("<i>a</i><em>b</em>")), "a<em>b</em>"), (text.label_key(F.lit("a b")), "88a99b88"),
        (text.mid_ellipsis(F.lit("abcdefghij"), 4), "ab ... ij"), (text.mid_ellipsis(F.lit("abcd"), 4), "abcd"), (text.lock_name(F.lit("/home/a.b/c")), "home_a_b_c"), (text.lock_name(F.lit("C:\\x..y")), "C_x__y"),
        (text.elided_authors(F.lit(" and ".join("ABCDEFGH"))), "A, B, C,  ... (2 others) ... , F, G, H"), (text.elided_authors(F.lit("A and B")), "A, B"),
        (text.pubmed_id(F.lit("http://x.ncbi.nlm.nih.gov/pmc/articles/PMC12/")), "PMC12"), (text.pubmed_id(F.lit("http://a.b/")), None),
        (text.repair_bibtex(F.lit("@article{a, t={x}")), "@article{a, t={x}}"), (text.repair_bibtex(F.lit("@article{a} @book{b")), "@article{a} @book{b"), (text.local_date(F.lit("2011-01-02 10:11:12")), "2011-01-02 "),
        (text.overlay(F.lit("old"), F.lit("0")), "old"), (text.overlay(F.lit("old"), F.lit("new")), "new"), (text.quote_words(F.lit("The DNA of mRNAs")), "The {DNA} of {mRNAs}"),
    ]
    got = list(spark.range(1).select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(cases))).first())
    assert got == [w for _, w in cases]
    assert one(spark, text.path_parts(F.lit("/a/b/c.tar.gz"))).asDict() == {"dir": "/a/b", "file": "c.tar.gz", "base": "c.tar", "extension": "gz"}
    assert one(spark, text.ris_date(F.lit("2011/03/03/print"))).asDict() == {"year": "2011", "month": "03", "day": "03", "rest": "print"}


def test_identity(spark):
    import hashlib

    want = hashlib.sha1("Knuth, D.E.Fundamental Algorithms".encode()).hexdigest()[:15]
    assert one(spark, text.identity_sha1(F.lit("Knuth, D.E."), F.lit("Fundamental Algorithms"))) == want


@pytest.mark.parametrize(("seconds", "want"), [(30, "Just now"), (89, "1 minute ago"), (150, "3 minutes ago"), (4000, "1 hour ago"), (-7200, "2 hours"), (700_000, "1 week ago"), (40_000_000, "1 year ago"), (10**10, "2 Centuries ago")])
def test_pretty_date(spark, seconds, want):
    now = F.timestamp_seconds(F.lit(2 * 10**9))
    assert one(spark, text.pretty_date(F.timestamp_seconds(F.lit(2 * 10**9 - seconds)), now)) == want


def test_lookup3_known_answers():
    text_ = b"Four score and seven years ago"
    assert simhash.lookup3(b"") == (0xDEADBEEF, 0xDEADBEEF)
    assert simhash.lookup3(text_) == (0x17770551, 0xCE7226E6)
    assert simhash.lookup3(text_, 0, 1) == (0xE3607CAE, 0xBD371DE4)
    assert simhash.lookup3(text_, 1, 0) == (0xCD628161, 0x6CBEA4B3)


def test_simhash(spark):
    ones = 0xFFFFFFFFFFFFFFFF
    assert simhash.simhash("") == simhash.simhash("single") == simhash.simhash("one two") == ones
    assert simhash.simhash("Significance of nucleotide sequence alignments") == 0xBACD7EFEFB39F6F9
    assert simhash.simhash("sequence alignments nucleotide Significance of") == 0xBACD7EFEFB39F6F9  # order doesn't matter
    assert simhash.simhash_wide("alpha beta gamma") != simhash.simhash_wide("gamma beta alpha")
    row = spark.createDataFrame([("Significance of nucleotide sequence alignments",)], "t string").select(simhash.simhash64("t").alias("h")).select(simhash.binary_digits(F.col("h")).alias("b"), simhash.hamming(F.col("h"), F.lit(-1).cast("long")).alias("d")).first()
    assert int(row["b"], 2) == 0xBACD7EFEFB39F6F9 and row["d"] == 64 - bin(0xBACD7EFEFB39F6F9).count("1")


def test_many_hashes_at_once():
    import random

    r = random.Random(1)
    tokens = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(0, 60), 300]]
    assert simhash.token_hashes(tokens).tolist() == [simhash.token_hash(t) for t in tokens]
