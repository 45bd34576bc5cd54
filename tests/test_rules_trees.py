"""Rules as a table against every rule on every page; interval labels against a walk."""

import random
import re

import pytest

from folioflow.operators import trees, webpages
from folioflow.sources.records import QueryError


def test_literal_runs_are_in_every_match():
    cases = {
        r"http://www\.site(\d+)\.org/a+bc": ["http://www.site", ".org/a", "bc"], r"ab?cd": ["a", "cd"], r"ab{2,3}cd": ["a", "cd"], r"foo|bar": [], r"x(foo|bar)y": ["x", "y"], r"[a|b]name[^]x]Z": ["name", "z"],
        r"(?i)HELLO\s+world": ["hello", "world"], r"a.b\.c": ["a", "b.c"], r"": [], r"ab*": ["a"], r"\d{4}/full": ["/full"],
    }
    for pattern, want in cases.items():
        assert webpages.literal_runs(pattern) == want, pattern
    r = random.Random(1)
    for _ in range(300):
        pattern = "".join(r.choice(["ab", "c", r"\.", "[xy]", "(de|f)", "g?", "h+", ".", "i{2}", "j*"]) for _ in range(r.randint(1, 6)))
        text = "".join(r.choice("abc.xydefghij") for _ in range(60))
        if m := re.search(pattern, text):
            assert all(run in m[0] for run in webpages.literal_runs(pattern))


def test_first_rule_of_a_table(spark):
    r = random.Random(2)
    pages = [(k, f"http://www.host{r.randrange(60)}.org/{r.choice(['full', 'abs'])}/{k}", r.choice([None, "", f"<p>signed by maker{r.randrange(40)}</p>", "x" * 30])) for k in range(200)]
    rules = [(n, "url", rf"host{n % 90}\.org/{r.choice(['full', 'abs', '.*'])}", rf"/(full|abs)/(\d+)", f"/pdf{n}/$2") for n in range(1000)]
    rules += [(1000 + n, "html", f"MAKER{n}".lower() + "<", None, None) for n in range(40)] + [(2000, "url", "[0-9]7$", None, None), (2001, "url", "a|b", None, None), (2002, "html", None, None, None)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    t = spark.createDataFrame(rules, "rule long, field string, pattern string, search string, replacement string")
    want = {}
    for k, url, html in pages:
        hit = [x for x in rules if x[2] is not None and re.search(x[2], {"url": url, "html": html or ""}[x[1]])]
        if hit:
            x = min(hit)
            want[k] = (x[0], re.sub(x[3], x[4].replace("$", "\\"), url) if x[3] else url)
    got = webpages.ruled_links(p, t)
    assert {x["page_id"]: (x["rule"], x["address"]) for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_loose_rules_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(webpages, "LOOSE_RULES", 1)
    p = spark.createDataFrame([(1, "http://x", "")], "page_id long, url string, html string")
    with pytest.raises(QueryError):
        webpages.rule_hits(p, spark.createDataFrame([(1, "url", "a"), (2, "url", "b")], "rule long, field string, pattern string"))


def test_intervals_equal_a_walk(spark):
    r = random.Random(3)
    rows = [(f"n{k:03d}", None if k < 3 else "absent" if k == 3 else f"n{r.randrange(k):03d}", r.randrange(5)) for k in range(60)]
    rows += [(f"d{k:03d}", f"d{k - 1:03d}" if k else "n000", 0) for k in range(40)]  # a long chain
    rows += [("c1", "c2", 0), ("c2", "c1", 0), ("c3", "c1", 0), (None, "n000", 0)]
    df = spark.createDataFrame(rows, "guid string, parent string, sort_order int")
    got = {x["guid"]: (x["low"], x["high"]) for x in trees.interval_labels(df, order=["sort_order"]).collect()}
    parent = {k: p for k, p, _ in rows if k}

    def above(k):
        seen = [k]
        while (k := parent.get(k)) in parent and k not in seen:
            seen.append(k)
        return seen

    good = [k for k in parent if not k.startswith("c")]
    assert all(got[k] == (None, None) for k in ("c1", "c2", "c3", None))
    for a in good:
        for b in good:
            assert (got[a][0] <= got[b][0] <= got[a][1]) == (a in above(b))
    assert len({x for k in good for x in got[k]}) == 2 * len(good)
    # siblings in their order
    kids = sorted(((o, k) for k, p, o in rows if k and p == "n000"))
    assert sorted((got[k][0], k) for _, k in kids) == [(got[k][0], k) for _, k in sorted(kids)]


def test_members_below(spark):
    c = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", None)], "guid string, parent string")
    bridge = spark.createDataFrame([("a", "p1"), ("c", "p1"), ("c", "p2"), ("x", "p3")], "collection_guid string, publication_guid string")
    pubs = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "guid string")
    labelled = trees.interval_labels(c)
    found = lambda f: sorted(x["guid"] for x in trees.members_below(pubs, bridge, labelled, f).collect())
    assert found("a") == ["p1", "p2"] and found("b") == ["p1", "p2"] and found("x") == ["p3"] and found("none") == []
    assert trees.interval_labels(c.where("false")).count() == 0
