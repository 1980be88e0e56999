"""Readers of landed answers of the literature services, one candidate row for each paper.

Fetching is outside the engine: answers are files, or rows with one JSON text each. All sources end in the same columns
(COLUMNS), with identifiers in normal form; rows without a title are left out. Malformed texts give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx

COLUMNS = ["source", "external_id", "title", "abstract", "authors", "journal", "published_date", "doi", "pmid", "pmcid", "openalex_id", "pdf_url", "landing_url", "is_open_access"]

EUROPE_PMC = "id string, pmid string, pmcid string, doi string, title string, abstractText string, authorString string, journalTitle string, firstPublicationDate string, firstIndexDate string, journalUrl string, url string, isOpenAccess string, fullTextUrlList struct<fullTextUrl: array<struct<documentStyle: string, availability: string, url: string>>>"
OPENALEX = "id string, title string, display_name string, doi string, publication_date string, abstract_inverted_index map<string, array<int>>, authorships array<struct<author: struct<display_name: string>>>, primary_location struct<pdf_url: string, landing_page_url: string, source: struct<display_name: string>>, open_access struct<is_oa: boolean, oa_url: string>"
PREPRINT = "doi string, title string, abstract string, authors string, date string, version string, category string, license string"
PARTS = "struct<`date-parts`: array<array<int>>>"
CROSSREF = f"DOI string, URL string, title array<string>, `container-title` array<string>, abstract string, author array<struct<given: string, family: string>>, link array<struct<`content-type`: string, URL: string>>, license array<struct<URL: string>>, `published-print` {PARTS}, `published-online` {PARTS}, published {PARTS}, created {PARTS}, issued {PARTS}"
PUBMED = (
    "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, Journal: struct<Title: string, ISOAbbreviation: string, JournalIssue: struct<PubDate: struct<Year: string, Month: string, Day: string, MedlineDate: string>>>, "
    "AuthorList: struct<Author: array<struct<ForeName: string, LastName: string>>>, ArticleDate: struct<Year: string, Month: string, Day: string>>>, PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _two(c: Column) -> Column:
    return F.when(c != "", F.lpad(c, 2, "0"))


def _link(prefix: str, c: Column, suffix: str = "") -> Column:
    return F.when(c != "", F.concat(F.lit(prefix), c, F.lit(suffix))).otherwise("")


def candidates(rows: DataFrame, source, **fields: Column) -> DataFrame:
    """Rows in the common columns; what a source has no field for is empty."""
    get = lambda name: fields.get(name, F.lit(""))
    out = rows.select(
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        _or_empty(get("external_id")).alias("external_id"),
        tx.strip_tags(get("title")).alias("title"),
        tx.strip_tags(get("abstract")).alias("abstract"),
        F.filter(F.coalesce(fields["authors"], F.array().cast("array<string>")), lambda a: F.coalesce(F.trim(a) != "", F.lit(False))).alias("authors"),
        _or_empty(get("journal")).alias("journal"),
        _or_empty(get("published_date")).alias("published_date"),
        tx.doi(get("doi")).alias("doi"),
        tx.digits(get("pmid")).alias("pmid"),
        tx.pmcid(get("pmcid")).alias("pmcid"),
        tx.openalex_id(get("openalex_id")).alias("openalex_id"),
        _or_empty(get("pdf_url")).alias("pdf_url"),
        _or_empty(get("landing_url")).alias("landing_url"),
        F.coalesce(fields["is_open_access"], F.lit(False)).alias("is_open_access"),
    )
    return out.filter("title <> ''")


def _parsed(landed: DataFrame, schema: str, column: str) -> DataFrame:
    return landed.select(F.from_json(column, schema).alias("x")).select("x.*")


def europe_pmc(landed: DataFrame, column: str = "value") -> DataFrame:
    r, c = _parsed(landed, EUROPE_PMC, column), F.col
    is_open = F.upper(_or_empty(c("isOpenAccess"))) == "Y"
    pdfs = F.filter("fullTextUrlList.fullTextUrl", lambda u: (F.lower(u["documentStyle"]) == "pdf") & (F.contains(F.lower(u["availability"]), F.lit("open")) | (c("isOpenAccess") == "Y")))
    listed = F.get(pdfs, F.lit(0))["url"]
    pdf = F.coalesce(tx.filled(listed), _link("https://pmc.ncbi.nlm.nih.gov/articles/", _or_empty(c("pmcid")), "/pdf/"))
    return candidates(
        r, "europe_pmc", external_id=tx.first_filled(c("id"), c("pmid")), title=c("title"), abstract=c("abstractText"), authors=tx.authors(_or_empty(c("authorString"))), journal=c("journalTitle"),
        published_date=tx.first_filled(c("firstPublicationDate"), c("firstIndexDate")), doi=c("doi"), pmid=c("pmid"), pmcid=c("pmcid"), pdf_url=pdf, landing_url=tx.first_filled(c("journalUrl"), c("url")), is_open_access=is_open | (pdf != ""),
    )


def openalex(landed: DataFrame, column: str = "value") -> DataFrame:
    r, c = _parsed(landed, OPENALEX, column), F.col
    pdf = _or_empty(c("primary_location.pdf_url"))
    return candidates(
        r, "openalex", external_id=c("id"), title=tx.first_filled(c("title"), c("display_name")), abstract=tx.from_inverted_index(c("abstract_inverted_index")), authors=F.transform("authorships", lambda a: a["author"]["display_name"]), journal=c("primary_location.source.display_name"),
        published_date=c("publication_date"), doi=c("doi"), openalex_id=c("id"), pdf_url=pdf, landing_url=tx.first_filled(c("primary_location.landing_page_url"), c("open_access.oa_url"), c("id")), is_open_access=F.coalesce(c("open_access.is_oa"), F.lit(False)) | (pdf != ""),
    )


def preprints(landed: DataFrame, server: str, column: str = "value") -> DataFrame:
    r, c = _parsed(landed, PREPRINT, column), F.col
    version = F.trim(_or_empty(c("version")))
    page = _link(f"https://www.{server}.org/content/", F.when(_or_empty(c("doi")) != "", F.concat(c("doi"), F.when((version != "") & ~version.startswith("v"), F.concat(F.lit("v"), version)).otherwise(version))).otherwise(""))
    pdf = _link("", page, ".full.pdf")
    return candidates(r, server, external_id=c("doi"), title=c("title"), abstract=c("abstract"), authors=tx.authors(_or_empty(c("authors"))), journal=F.lit(server), published_date=c("date"), doi=c("doi"), pdf_url=pdf, landing_url=page, is_open_access=pdf != "")


def _date_parts(c: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD from the first list of parts; null where there is none."""
    parts = F.filter(F.get(c["date-parts"], F.lit(0)), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.lpad(p.cast("string"), 2, "0")).otherwise(p.cast("string"))), "-"))


def crossref(landed: DataFrame, column: str = "value") -> DataFrame:
    r, c = _parsed(landed, CROSSREF, column), F.col
    names = F.transform("author", lambda a: F.trim(F.concat_ws(" ", F.trim(a["given"]), F.trim(a["family"]))))
    pdf = _or_empty(F.get(F.filter("link", lambda x: F.contains(F.lower(x["content-type"]), F.lit("pdf"))), F.lit(0))["URL"])
    day = F.coalesce(*[_date_parts(c(f"`{k}`")) for k in ("published-print", "published-online", "published", "created", "issued")])
    plain = F.col("abstract")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return candidates(
        r, "crossref", external_id=c("DOI"), title=F.get(c("title"), F.lit(0)), abstract=plain, authors=names, journal=F.get(c("`container-title`"), F.lit(0)), published_date=day, doi=c("DOI"), pdf_url=pdf, landing_url=c("URL"),
        is_open_access=(pdf != "") & (F.coalesce(F.size("license"), F.lit(0)) > 0),
    )


def month_number(c: Column) -> Column:
    """Two digits of a month given as a number or by its English name; empty where it is neither."""
    low = F.lower(F.trim(_or_empty(c)))
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(low, 1, 3))
    return F.when(low.rlike(r"^\d{1,2}$"), F.lpad(low, 2, "0")).when(place > 0, F.lpad(place.cast("string"), 2, "0")).otherwise("")


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Landed PubMed XML. Elements inside of titles and abstracts lose their tags, not their text."""
    r = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED).load(path)
    c, a = F.col, "MedlineCitation.Article"
    ids = F.col("PubmedData.ArticleIdList.ArticleId")
    of = lambda kind: _or_empty(F.get(F.filter(ids, lambda i: F.lower(i["_IdType"]) == kind), F.lit(0))["_VALUE"])
    day, issue = F.col(f"{a}.ArticleDate"), F.col(f"{a}.Journal.JournalIssue.PubDate")
    electronic = F.concat_ws("-", day["Year"], _two(day["Month"]), _two(day["Day"]))
    month = month_number(issue["Month"])
    printed = F.concat_ws("-", F.coalesce(tx.filled(issue["Year"]), tx.filled(F.substring(issue["MedlineDate"], 1, 4))), F.when(month != "", month), _two(issue["Day"]))
    pmid, pmcid, doi = _or_empty(c("MedlineCitation.PMID")), of("pmc"), of("doi")
    abstract = F.array_join(F.transform(F.col(f"{a}.Abstract.AbstractText"), lambda t: tx.strip_tags(t)), " ")
    page = F.when(pmid != "", _link("https://pubmed.ncbi.nlm.nih.gov/", pmid, "/")).otherwise(_link("https://doi.org/", tx.doi(doi)))
    return candidates(
        r, "pubmed", external_id=pmid, title=c(f"{a}.ArticleTitle"), abstract=abstract, authors=F.transform(F.col(f"{a}.AuthorList.Author"), lambda x: F.concat_ws(" ", x["ForeName"], x["LastName"])),
        journal=F.coalesce(tx.filled(c(f"{a}.Journal.Title")), c(f"{a}.Journal.ISOAbbreviation")), published_date=F.when(tx.filled(day["Year"]).isNotNull(), electronic).otherwise(printed), doi=doi, pmid=pmid, pmcid=pmcid,
        pdf_url=_link("https://pmc.ncbi.nlm.nih.gov/articles/", pmcid, "/pdf/"), landing_url=page, is_open_access=pmcid != "",
    )


def united(*found: DataFrame) -> DataFrame:
    """The candidates of several sources, in the common columns."""
    out = found[0].select(*COLUMNS)
    for f in found[1:]:
        out = out.unionByName(f.select(*COLUMNS))
    return out


def run_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed lines of JSON; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parser_items(landed: DataFrame, column: str = "value") -> DataFrame:
    """Items of a parser's content list with a valid box: (type, page, box, content), content by the item's kind."""
    item = "type string, text string, list_items array<string>, table_caption array<string>, table_body string, table_footnote array<string>, content string, image_caption array<string>, chart_caption array<string>, img_path string, bbox array<double>, page_idx int"
    r = landed.select(F.explode(F.from_json(column, f"array<struct<{item}>>")).alias("x")).select("x.*")
    box = F.col("bbox")
    good = (F.size(box) == 4) & (box[2] > box[0]) & (box[3] > box[1])
    several = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "\n")
    content = (
        F.when(F.col("type") == "table", F.concat_ws("\n", *[tx.filled(x) for x in (several("table_caption"), F.col("table_body"), several("table_footnote"))]))
        .when(F.col("type") == "list", several("list_items"))
        .when(F.col("type").isin("image", "chart"), F.concat_ws("\n", *[tx.filled(x) for x in (several("image_caption"), several("chart_caption"), F.col("content"))]))
        .otherwise(F.coalesce(F.col("text"), F.col("content"), F.lit("")))
    )
    return r.filter(good).select("type", (F.col("page_idx") + 1).alias("page"), "bbox", content.alias("content"), "img_path")
