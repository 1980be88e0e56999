"""Readers of landed answers, and the splitting of texts, on small literal inputs."""

import json

import pytest

from foliant.functions import splitting as sp
from foliant.sources import literature as so


def landed(spark, *items):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in items], "value string")


def test_europe_pmc(spark):
    item = {
        "id": "1", "pmid": "123", "pmcid": "PMC9", "doi": "https://doi.org/10.1101/ABC.123", "title": "A <i>title</i>", "abstractText": "Text", "authorString": "Ann A; Bob B", "isOpenAccess": "Y",
        "fullTextUrlList": {"fullTextUrl": [{"documentStyle": "html", "availability": "Open access", "url": "h"}, {"documentStyle": "pdf", "availability": "Open access", "url": "p.pdf"}]},
    }
    got = so.europe_pmc(landed(spark, item, {"title": ""}, "{broken")).collect()
    assert len(got) == 1
    assert (got[0]["title"], got[0]["doi"], got[0]["pdf_url"], got[0]["authors"], got[0]["is_open_access"]) == ("A title", "10.1101/abc.123", "p.pdf", ["Ann A", "Bob B"], True)


def test_openalex(spark):
    item = {"id": "https://x.org/W12", "display_name": "T", "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "authorships": [{"author": {"display_name": "Ann"}}, {"author": None}], "open_access": {"is_oa": False, "oa_url": "u"}}
    got = so.openalex(landed(spark, item)).first()
    assert (got["abstract"], got["openalex_id"], got["authors"], got["landing_url"], got["is_open_access"]) == ("hello world hello", "W12", ["Ann"], "u", False)


def test_preprints(spark):
    got = so.preprints(landed(spark, {"doi": "10.1101/1", "title": "T", "version": "2", "authors": "A; B"}, {"title": "U"}), "biorxiv").orderBy("title").collect()
    assert got[0]["pdf_url"] == "https://www.biorxiv.org/content/10.1101/1v2.full.pdf" and got[0]["is_open_access"]
    assert got[1]["pdf_url"] == "" and not got[1]["is_open_access"]


def test_crossref(spark):
    item = {"DOI": "10.1101/X", "title": ["T"], "container-title": [], "author": [{"given": "Ann", "family": "A"}, {"family": "B"}], "abstract": "&lt;p&gt;x&lt;/p&gt;", "link": [{"content-type": "application/pdf", "URL": "p"}], "license": [{"URL": "l"}], "published": {"date-parts": [[2020, 3]]}, "issued": {"date-parts": [[2019]]}}
    got = so.crossref(landed(spark, item)).first()
    assert (got["authors"], got["abstract"], got["published_date"], got["journal"], got["pdf_url"], got["is_open_access"]) == (["Ann A", "B"], "x", "2020-03", "", "p", True)


def test_pubmed(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><JournalIssue><PubDate><Year>2021</Year><Month>Feb</Month><Day>3</Day></PubDate></JournalIssue><Title>J</Title></Journal>"
        "<ArticleTitle>On <i>E. coli</i> growth</ArticleTitle><Abstract><AbstractText Label='A'>One <b>two</b>.</AbstractText><AbstractText>Three.</AbstractText></Abstract>"
        "<AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author><Author><LastName>Kim</LastName></Author></AuthorList></Article></MedlineCitation>"
        "<PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/x</ArticleId><ArticleId IdType='pmc'>PMC5</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"
    )
    got = so.pubmed(spark, str(tmp_path)).first()
    assert (got["external_id"], got["title"], got["published_date"], got["authors"], got["pmcid"], got["is_open_access"]) == ("7", "On E. coli growth", "2021-02-03", ["Ann Lee", "Kim"], "PMC5", True)
    assert got["abstract"].startswith("One two") and got["abstract"].endswith("Three.")


def test_united(spark):
    a = so.preprints(landed(spark, {"doi": "1", "title": "T"}), "medrxiv")
    assert so.united(a, so.openalex(landed(spark, {"title": "U"}))).columns == so.COLUMNS


def test_run_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"run": 1}\n\n{broken\n{"run": 2}\n')
    assert sorted(r["run"] for r in so.run_log(spark, str(tmp_path / "log.jsonl"), "run int").collect()) == [1, 2]


def test_parser_items(spark):
    items = [
        {"type": "text", "text": "x", "bbox": [0, 0, 1, 1], "page_idx": 0},
        {"type": "table", "table_caption": ["c"], "table_body": "<table/>", "bbox": [0, 0, 1, 1], "page_idx": 1},
        {"type": "image", "bbox": [0, 0, 0, 1], "page_idx": 1},
        {"type": "list", "list_items": ["a", "b"], "bbox": [0, 0, 2, 2], "page_idx": 2},
    ]
    got = {r["page"]: r["content"] for r in so.parser_items(landed(spark, items)).collect()}
    assert got == {1: "x", 2: "c\n<table/>", 3: "a\nb"}


def test_pieces():
    assert [p[2] for p in sp.pieces("abcdef", 4, 1)] == ["abcd", "def"]
    assert sp.pieces("one\n\ntwo\n\n" + "x" * 9, 10, 2) == [(0, 8, "one\n\ntwo"), (10, 19, "x" * 9)]
    assert sp.pieces("   \n\n ", 4, 1) == []
    long = "\n".join("word " * 9 for _ in range(90)).strip()
    spans = [(a, b) for a, b, _ in sp.pieces(long, 200, 50)]
    assert spans[0][0] == 0 and spans[-1][1] == len(long) and all(b > c for (_, b), (c, _) in zip(spans, spans[1:]))
    with pytest.raises(ValueError):
        sp.pieces("x", 4, 4)


def test_split(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, None), (3, "")], "chunk_id long, text string")
    got = sp.split(df, "text", 4, 1).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["chunk_index"], r["chunk_count"], r["content"]) for r in got] == [(1, 0, 2, "abcd"), (1, 1, 2, "def")]
