"""Bibliographic records from web pages.

A page is parsed once into its elements; a site's extractor is data: where the texts are and which
patterns take fields out of them. Pages run through an Arrow-batched map; pages of a site that needs a
second download get what the page itself holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from html.parser import HTMLParser
from itertools import pairwise, takewhile
from urllib.parse import urlencode, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import freestyle_bibtex
from ..functions.text import letter_runs
from ..plugins import register
from ..sources.bibtex import balanced_entry, read_bibtex
from ..sources.records import FIELDS, QueryError, UnknownSiteError
from ..sources.ris import read_ris
from ..store import written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass
class Element:
    tag: str
    attrs: dict
    parts: list = field(default_factory=list)

    @property
    def text(self) -> str:
        return re.sub(r"\s+", " ", "".join(self.parts)).strip()


class Page(HTMLParser):
    """All elements in document order, each with the text below it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self._open: list[Element] = []
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.elements.append(e)
        if tag not in VOID:
            self._open.append(e)

    def handle_endtag(self, tag):
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k].tag == tag:
                del self._open[k:]
                break

    def handle_data(self, data):
        for e in self._open:
            if e.tag not in ("script", "style"):
                e.parts.append(data)

    def texts(self, tag: str, key: str | None = None, value: str | None = None) -> list[str]:
        return [e.text for e in self.elements if e.tag == tag and (key is None or e.attrs.get(key) == value)]


def people(names: list[str]) -> str:
    """Names written in any way, as one author string."""
    return " and ".join(x for x in (freestyle_bibtex(n.strip()) for n in names) if x)


#: Record fields of citation meta tags. Fixed values.
META = {
    "citation_title": "title", "citation_journal_title": "journal", "citation_journal": "journal", "citation_volume": "volume", "citation_issue": "issue", "citation_doi": "doi",
    "citation_pmid": "pmid", "citation_issn": "issn", "citation_isbn": "isbn", "citation_publisher": "publisher", "citation_abstract": "abstract", "citation_arxiv_id": "arxivid",
    "dc.title": "title", "dc.publisher": "publisher", "dc.identifier": "doi", "prism.publicationname": "journal", "prism.volume": "volume", "prism.number": "issue", "prism.doi": "doi", "prism.issn": "issn",
}


def meta_record(page: Page) -> dict[str, str]:
    """The record in a page's meta tags."""
    out: dict[str, str] = {}
    authors, pages, date = [], {}, ""
    for e in page.elements:
        name, value = e.attrs.get("name", "").lower(), e.attrs.get("content", "").strip()
        if e.tag != "meta" or not value:
            continue
        if name in ("citation_author", "dc.creator"):
            authors.append(value)
        elif name == "citation_authors":
            authors += value.split(";")
        elif name in ("citation_firstpage", "citation_lastpage", "prism.startingpage", "prism.endingpage"):
            pages["first" if "first" in name or "start" in name else "last"] = value
        elif name in ("citation_date", "citation_publication_date", "dc.date", "prism.publicationdate"):
            date = date or value
        elif name in META:
            value = m[0] if META[name] == "doi" and (m := re.search(r"10\.\d{4,}/\S+", value)) else value
            if META[name] != "doi" or value.startswith("10."):
                out.setdefault(META[name], value)
    if authors:
        out["authors"] = people(authors)
    if pages:
        out["pages"] = "-".join(pages[k] for k in ("first", "last") if k in pages)
    if m := re.search(r"\d{4}", date):
        out["year"] = m[0]
    if out:
        out["pubtype"] = "ARTICLE" if "journal" in out else "MISC"
    return out


def sections(text: str, labels: tuple[str, ...]) -> dict[str, str]:
    """The text behind each label and its colon, up to whichever label of the list comes next."""
    places = sorted((at, label) for label in labels if (at := text.find(f"{label}:")) >= 0)
    ends = [at for at, _ in places[1:]] + [len(text)]
    return {label: text[at + len(label) + 1 : end].strip() for (at, label), end in zip(places, ends, strict=False)}


def _number(text: str | None) -> str | None:
    """The digits that a text begins with."""
    return "".join(takewhile(str.isdigit, (text or "").strip())) or None


def citation_parts(text: str) -> dict[str, str]:
    """A citation line's parts: numbers after the words volume, issue and pages, the journal before the first of
    them, and the date among the rest."""
    out, rest, at = {}, [], 0
    for m in re.finditer(r"\b(Volume|Issue|Page)s?\s+(\d+(?:\s*-\s*\d+)?)", text):
        out.setdefault({"Volume": "volume", "Issue": "issue", "Page": "pages"}[m[1]], re.sub(r"\s", "", m[2]))
        rest.append(text[at : m.start()])
        at = m.end()
    if not out:
        return {}
    rest.append(text[at:])
    out["journal"] = rest[0].strip(" ,")
    if date := re.search(r"(?:([A-Za-z]+)\s+)?\b(\d{4})\b", " ".join(rest[1:])):
        out |= {"year": date[2]} | ({"month": date[1]} if date[1] else {})
    return out


def lancet(page: Page, url: str) -> dict:
    cited = citation_parts(" ".join(page.texts("div", "id", "article_cite")[:1]))
    cited.pop("month", None)
    out = {"pubtype": "ARTICLE", "title": (page.texts("h1") or [""])[0], "authors": people(page.texts("a", "class", "ja50-ce-author"))} | cited
    for word in " ".join(page.texts("div", "id", "article_DOI")[:1]).split():
        if word.startswith("doi:"):
            out["doi"] = word.removeprefix("doi:").removesuffix("Cite")
    return out | {"abstract": " ".join(page.texts("div", "class", "ja50-ce-abstract-section"))}


#: Labels in a table of contents. Fixed values.
TOC_LABELS = ("Title", "Author(s)", "Journal", "Book Series", "Year", "Volume", "Issue", "Page", "ISSN", "DOI", "Chapter URL", "Article URL", "Publisher")


def emerald(page: Page, url: str) -> dict:
    """Everything stands behind a label; pages that name a book series are chapters."""
    toc = sections(" ".join(page.texts("div", "class", "toc")[:1]), TOC_LABELS)
    body = sections(" ".join(page.texts("div", "id", "centerLeft")[:1]), ("Abstract", "Keywords", "Article Type"))
    ends = [_number(x) for x in toc.get("Page", "").split("-")]
    same = {"title": "Title", "journal": "Journal", "series": "Book Series", "issn": "ISSN", "doi": "DOI", "publisher": "Publisher"}
    return {
        "pubtype": "INBOOK" if toc.get("Book Series") else "ARTICLE",
        "authors": people(toc.get("Author(s)", "").split(",")),
        "pages": "-".join(ends) if len(ends) == 2 and all(ends) else None,
        "abstract": body.get("Abstract", "").partition("Top of page")[0].strip(),
        **{name: _number(toc.get(name.title())) for name in ("year", "volume", "issue")},
        **{name: toc.get(label) for name, label in same.items()},
    }


def dovepress(page: Page, url: str) -> dict:
    """Below the heading stand the names, their places and then the abstract, a paragraph each, up to the keywords."""
    heading = next((k for k, e in enumerate(page.elements) if e.tag == "h1"), len(page.elements))
    below = (e.text for e in page.elements[heading:] if e.tag == "p")
    names, _places = next(below, ""), next(below, "")
    out = {"pubtype": "ARTICLE", "title": " ".join(page.texts("h1")[:1]), "abstract": "\n".join(takewhile(lambda p: not p.startswith("Keywords"), below))}
    out["authors"] = people("".join(c for c in names if not c.isdigit()).split(","))  # digits are marks of places
    for line in page.texts("h3"):
        label, _, numbers = line.partition(" ")
        year, _, volume = numbers.partition(":")
        if label == "Volume" and year.isdigit():
            out |= {"year": year, "volume": _number(volume)}
    return out | {"journal": sections(" ".join(page.texts("div", "id", "breadcrumb")[:1]), ("Journal",)).get("Journal")}


def google_books(page: Page, url: str) -> dict:
    """A table of labels, each with the value in the next cell."""
    info, label = {}, None
    for e in page.elements:
        if e.tag == "td" and e.attrs.get("class") == "metadata_label":
            label = e.text
        elif e.tag == "td" and e.attrs.get("class") == "metadata_value" and label:
            info.setdefault(label, e.text)
            label = None
    out = {"pubtype": "BOOK", "title": info.get("Title"), "url": url, "linkout": url, "abstract": " ".join(page.texts("div", "id", "synopsistext")[:1])}
    for name in ("authors", "editors"):
        out[name] = people(info.get(name.title(), "").split(","))
    house, _, year = info.get("Publisher", "").rpartition(", ")
    if year.isdigit():
        out |= {"publisher": house, "year": year}
    count, _, unit = info.get("Length", "").partition(" ")
    if unit.startswith("page"):
        out["pages"] = _number(count)
    return out | {"isbn": info.get("ISBN", "").split(",")[0]}


def science_direct(page: Page, url: str) -> dict:
    one = lambda *where: " ".join(page.texts("div", *where)[:1]).strip()
    out = {"pubtype": "ARTICLE", "title": one("class", "articleTitle")} | citation_parts(one("class", "artiHead"))
    links = [t for t in page.texts("a", "target", "doilink") if t.startswith("doi:10")]
    abstracts = [t for t in page.texts("div", "class", "articleText_indent") if t.startswith("Abstract")]
    if links:
        out["doi"] = links[-1].removeprefix("doi:")
    if abstracts:
        out["abstract"] = abstracts[-1].removeprefix("Abstract").strip()
    names = one("id", "authorsAnchors").replace(" and ", ",").split(",")
    # initials may stand without a blank; footnote letters are no names
    return out | {"authors": people([". ".join(x.strip() for x in n.split(".")).strip() for n in names if len(n.strip()) > 1])}


def nature(page: Page, url: str) -> dict | None:
    """The meta tags, and the text of the abstract's element without its heading and link."""
    if "doifinder/10." in url:
        return None
    out = meta_record(page)
    found = page.texts("div", "id", "abs")
    if found:
        out["abstract"] = re.sub(r"\s+", " ", found[0].removeprefix("Top of page").strip().removeprefix("Abstract").replace("Top of page", " ")).strip()
    return out


def landes(page: Page, url: str) -> dict:
    """The meta tags, and the identifier that stands in bold behind its label."""
    bold = [sections(t, ("DOI",)).get("DOI", "") for t in page.texts("b")]
    return meta_record(page) | {"doi": x for x in bold if x.startswith("10.")}


def ieee(page: Page, url: str) -> dict:
    out = meta_record(page)
    if texts := page.texts("div", "class", "abstract"):
        out["abstract"] = re.sub(r"^.*?\bAbstract\s*", "", texts[0], count=1)
    return out


def springer(page: Page, url: str) -> dict:
    """The page's own authors, with all given names; an export's list is reconciled with them."""
    names = re.split(r",\s+|\s+and\s+", " ".join(page.texts("p", "class", "authors")[:1]))
    return meta_record(page) | ({"authors": people(names)} if any(names) else {})


def embedded(html: str) -> dict | None:
    """A record given as BibTeX or RIS text in the page."""
    if (entry := balanced_entry(html)) and (found := read_bibtex(entry)):
        return found[0]
    if re.search(r"(?m)^TY\s+-\s", html) and (found := read_ris(html[re.search(r"(?m)^TY\s+-\s", html).start() :])):
        return found[0]
    return None


def default(page: Page, url: str, html: str = "") -> dict:
    """Meta tags, else embedded text; an error where neither has a title."""
    out = meta_record(page)
    if not out.get("title"):
        out = embedded(html) or {}
    if not out.get("title"):
        raise UnknownSiteError("no bibliographic information found")
    return out


def iop(page: Page, url: str) -> dict:
    """Meta tags without the abstract; the export completes them."""
    return meta_record(page) | {"abstract": ""}


def la_press(page: Page, url: str) -> dict:
    """The listing's last line has year and volume with a colon between them, then the pages; the export gives them less well."""
    out = meta_record(page)
    words = " ".join(page.texts("div", "class", "journalListingAuthor")[-1:]).split()
    for dated, pages in pairwise(words):
        year, colon, volume = dated.partition(":")
        first, dash, last = pages.partition("-")
        if colon and dash and len(year) == 4 and all(map(str.isdigit, (year, volume, first, last))):
            out |= {"volume": volume, "pages": pages}
    return out


#: Extractors by a pattern of the address, first one wins.
SITES = (
    (r"thelancet\.com", lancet), (r"emeraldinsight\.com", emerald), (r"dovepress\.com", dovepress), (r"books\.google\.", google_books), (r"sciencedirect\.com", science_direct),
    (r"nature\.com", nature), (r"landesbioscience\.com", landes), (r"ieeexplore\.ieee\.org", ieee), (r"springerlink\.com", springer),
    (r"iop\.org", iop), (r"la-press\.com", la_press), (r"liebertpub|lww\.com|onlinelibrary\.wiley\.com", default), (r".", default),
)
for _, _extract in SITES:
    register("extractor", _extract.__name__)(_extract)


def _link(page: Page, wanted: str) -> str | None:
    """The first link whose address has a text."""
    return next((e.attrs["href"] for e in page.elements if e.tag == "a" and wanted in e.attrs.get("href", "")), None)


#: What an article's export is asked for at one site. Fixed values.
IOP_EXPORT = {"exportFormat": "iopexport_bib", "exportType": "abs"}


def export_address(page: Page, url: str) -> str | None:
    """Where a page's site gives its record as BibTeX or RIS text."""
    at = urlsplit(url)
    host, article = at.hostname or "", at.path.strip("/")
    of = lambda site: host == site or host.endswith(f".{site}")
    if of("iop.org"):
        asked = urlencode({"articleId": article} | IOP_EXPORT, safe="/")
        return urlunsplit((at.scheme, at.netloc, "/export", asked, "")) if article else None
    if of("la-press.com"):
        found = [e.attrs.get("href", "") for e in page.elements if e.tag == "a" and e.attrs.get("class") == "endnote"]
    elif of("onlinelibrary.wiley.com"):
        found = [_link(page, "/documentcitationdownload")]
    elif host.startswith("books.google."):
        found = [_link(page, "output=bibtex")]
    elif of("sciencedirect.com") or of("lww.com"):
        found = [_link(page, "export") or _link(page, "Export")]
    else:
        found = []
    return urljoin(url, found[0]) if found and found[0] else None


def frame_addresses(page: Page) -> list[str]:
    return [src for e in page.elements if e.tag == "frame" and (src := e.attrs.get("src", "")).startswith("http")]


#: Steps that a linked page can belong to.
EXPORT, FRAME = "export", "frame"


def follow_ups(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, step, position and address of what a page's record may still need: its site's export, and its frames."""
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField("step", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("address", T.StringType())])

    def run(batches):
        for batch in batches:
            rows, steps, places, found = [], [], [], []
            for k, (u, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                page = Page(h or "")
                export = export_address(page, u or "")
                for step, n, address in [(EXPORT, 0, export)] * bool(export) + [(FRAME, n, f) for n, f in enumerate(frame_addresses(page))]:
                    rows.append(k)
                    steps.append(step)
                    places.append(n)
                    found.append(address)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(steps, pa.string()), pa.array(places, pa.int32()), pa.array(found, pa.string())], names=schema.names)

    return pages.select(key, url, html).mapInArrow(run, schema)


def exported(text: str) -> dict | None:
    """The first record of a BibTeX or RIS text."""
    found = read_bibtex(text) if re.search(r"@\w+\s*\{", text) else read_ris(text)
    return found[0] if found else None


def _with_linked(record: dict | None, linked: list[dict]) -> dict | None:
    """A record with what its export gives, or that of the first frame with a title where the page has none."""
    for x in linked:
        if x["step"] == EXPORT and (more := exported(x["content"] or "")):
            record = (record or {}) | {k: v for k, v in more.items() if v and not (k in ("volume", "pages") and (record or {}).get(k))}
    if not (record or {}).get("title"):
        for x in linked:
            if x["step"] == FRAME and (more := meta_record(Page(x["content"] or ""))).get("title"):
                return more
    return record if (record or {}).get("title") else None


def read_page(url: str | None, html: str | None, sites=SITES, linked: list[dict] = ()) -> tuple[dict | None, str | None]:
    """The record of a page, or the name of an error. Empty and word-processor addresses are refused.

    linked: step and content of what the page's follow-up addresses gave, in their order."""
    url, html = url or "", html or ""
    if not url or url.endswith(".doc"):
        return None, "UnknownSiteError"
    for pattern, extract in sites:
        if re.search(pattern, url):
            page = Page(html)
            try:
                out = extract(page, url, html) if "html" in extract.__code__.co_varnames[: extract.__code__.co_argcount] else extract(page, url)
            except UnknownSiteError:
                out = None
            out = _with_linked(out, linked)
            return ({k: v for k, v in out.items() if v}, None) if out else (None, "UnknownSiteError")
    return None, "UnknownSiteError"


def extract_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", linked: DataFrame | None = None, pubmed: DataFrame | None = None) -> DataFrame:
    """key, all record fields, and ``error`` of each page.

    linked: url and html of pages that were loaded for ``follow_ups``; pubmed: records by ``pmid`` that take the
    place of those found with that number. Nothing is loaded here."""
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), *(T.StructField(f, T.StringType()) for f in FIELDS), T.StructField("error", T.StringType())])
    rows = pages.select(key, F.col(url).alias("_url"), F.col(html).alias("_html"))
    if linked is not None:
        got = follow_ups(pages, key, url, html).join(linked.select(F.col("url").alias("address"), F.col("html").alias("content")), "address")
        per = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "position", "content"))).alias("_linked"))
        rows = rows.join(per, key, "left")

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(len(FIELDS) + 1)]
            more = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for u, h, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), more, strict=True):
                record, error = read_page(u, h, linked=x or ())
                for c, f in zip(cols, FIELDS, strict=False):
                    c.append((record or {}).get(f))
                cols[-1].append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], names=schema.names)

    out = rows.mapInArrow(run, schema)
    if pubmed is None:
        return out
    known = pubmed.where(F.col("pmid").isNotNull()).dropDuplicates(["pmid"])
    known = known.select("pmid", F.struct(*(F.col(f).cast("string").alias(f) if f in pubmed.columns else F.lit(None).cast("string").alias(f) for f in FIELDS)).alias("_known"))
    out = out.join(known, "pmid", "left")
    return out.select(key, *(F.when(F.col("_known").isNotNull(), F.col("_known")[f]).otherwise(F.col(f)).alias(f) for f in FIELDS), "error")


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def page_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)


@dataclass
class SiteRule:
    """A site's signatures, and where its documents are: a pattern in the body, or rewrites of the address."""

    site: str
    url: tuple[str, ...] = ()
    body: tuple[str, ...] = ()
    match: str | None = None
    rewrite: tuple[tuple[str, str], ...] = ()


def site_of(url: Column, body: Column, rules: list[SiteRule]) -> Column:
    """The first rule whose address or body signature is found: one expression, so no join is needed."""
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        hit = F.lit(False)
        for p in r.url:
            hit = hit | url.rlike(p)
        for p in r.body:
            hit = hit | body.rlike(p)
        out = out.when(hit, F.lit(r.site))
    return out


def document_link(url: Column, body: Column, rules: list[SiteRule]) -> Column:
    """The address of the document by the rule of the page's site."""
    site, out = site_of(url, body, rules), F.when(F.lit(False), F.lit(""))
    for r in rules:
        link = F.nullif(F.regexp_extract(body, r.match, 1), F.lit("")) if r.match else url
        for old, new in r.rewrite:
            link = F.regexp_replace(link, old, new)
        out = out.when(site == r.site, link)
    return out


#: Letters of the runs by which rules of a table meet pages.
RULE_GRAM = 4
#: Rules without a literal run of that length, at most: each is tried on every page.
LOOSE_RULES = 500


def literal_runs(pattern: str) -> list[str]:
    """Runs of letters that every text has in which the pattern is found, in lower case. Groups, classes, alternatives and
    letters that may be absent end a run; a pattern with alternatives at its top level has none."""
    out, run, k, depth = [], "", 0, 0
    while k < len(pattern):
        c, step = pattern[k], 1
        plain = None
        if c == "\\" and k + 1 < len(pattern):
            step = 2
            plain = pattern[k + 1] if not pattern[k + 1].isalnum() else None
        elif c == "[":
            end = k + 1 + (pattern[k + 1 : k + 2] == "^")
            end = pattern.find("]", end + 1)
            step = (end if end >= 0 else len(pattern)) + 1 - k
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return []
        elif c not in ".^$*+?{}|":
            plain = c
        if c == "{" and (end := pattern.find("}", k)) >= 0:
            step = end + 1 - k
        follows = pattern[k + step : k + step + 1]
        if plain is not None and depth == 0 and follows not in ("?", "*", "{"):
            run += plain.lower()
        else:
            out.append(run)
            run = ""
        if follows == "+" and plain is not None:
            out.append(run)
            run = ""
        k += step
    return [r for r in [*out, run] if r]


def rule_hits(pages: DataFrame, rules: DataFrame, key: str = "page_id", fields: tuple[str, ...] = ("url", "html")) -> DataFrame:
    """(key, rule): the first rule of each page, by the smallest number ``rule`` of those whose ``pattern`` is found in the page's ``field``.

    rules: a table (rule, field, pattern) of any length. Each pattern is looked for only where the rarest run of letters of its
    literal part stands, counted over all pages; patterns without such a run are tried on every page, in one expression."""
    schema = T.StructType([*(T.StructField(c, rules.schema[c].dataType) for c in ("rule", "field", "pattern")), T.StructField("gram", T.StringType())])

    def run(batches):
        for batch in batches:
            rows, grams = [], []
            for k, pattern in enumerate(batch.column(2).to_pylist()):
                longest = max(literal_runs(pattern or ""), key=len, default="")
                some = {longest[i : i + RULE_GRAM] for i in range(len(longest) - RULE_GRAM + 1)} or {None}
                rows += [k] * len(some)
                grams += sorted(some, key=str)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(grams, pa.string())], names=schema.names)

    known = written(rules.where("pattern is not null").select("rule", "field", "pattern").mapInArrow(run, schema), "rules")
    asked = {r["field"] for r in known.where("gram is not null").select("field").distinct().limit(len(fields) + 1).collect()}
    grams = lambda f: F.array_distinct(letter_runs(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(RULE_GRAM)))
    every = [pages.select(key, F.lit(f).alias("field"), F.explode(grams(f) if f in asked else F.array().cast("array<string>")).alias("gram")) for f in fields]
    every = reduce(DataFrame.unionByName, every).join(known.select("field", "gram").distinct(), ["field", "gram"])
    every = written(every.select(key, "field", "gram"), "grams")
    counts = every.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = known.where("gram is not null").join(counts, ["field", "gram"], "left").groupBy("rule", "field", "pattern").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    texts = reduce(DataFrame.unionByName, [pages.select(key, F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    met = rarest.join(every, ["field", "gram"]).select(key, "field", "rule", "pattern").join(texts, [key, "field"])
    found = met.where(F.rlike("text", F.col("pattern"))).select(key, "rule")
    loose = known.where("gram is null").select("rule", "field", "pattern").limit(LOOSE_RULES + 1).collect()  # bounded
    if len(loose) > LOOSE_RULES:
        raise QueryError(f"more than {LOOSE_RULES} rules without {RULE_GRAM} letters in a row")
    for f in fields:
        for r in sorted((r for r in loose if r["field"] == f), key=lambda r: r["rule"]):
            found = found.unionByName(pages.where(F.col(f).rlike(r["pattern"])).select(key, F.lit(r["rule"]).cast(rules.schema["rule"].dataType).alias("rule")))
    return found.groupBy(key).agg(F.min("rule").alias("rule"))


def ruled_links(pages: DataFrame, rules: DataFrame, key: str = "page_id", fields: tuple[str, ...] = ("url", "html")) -> DataFrame:
    """(key, rule, address): each page's first rule with the address that its ``search`` and ``replacement`` make of the page's own."""
    hits = rule_hits(pages, rules, key, fields).join(rules.select("rule", "search", "replacement"), "rule")
    address = F.when(F.col("search").isNull(), F.col("url")).otherwise(F.regexp_replace("url", F.col("search"), F.coalesce("replacement", F.lit(""))))
    return pages.select(key, "url").join(hits, key).select(key, "rule", address.alias("address"))


def redirect_allowed(method: Column) -> Column:
    """Requests that change something are not sent again elsewhere."""
    return F.upper(method).isin("GET", "HEAD")
