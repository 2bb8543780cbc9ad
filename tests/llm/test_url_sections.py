"""Verdicts of pages without a rule do not depend on how many sections their host has."""

import pytest

from triagelake.llm import url_filter


@pytest.mark.parametrize("sections", [10, 32, 33, 40, 90])
@pytest.mark.parametrize("pages", [1, 3])
def test_pages_of_other_sections_stay(spark, sections, pages):
    letters = [chr(97 + k) for k in range(26)]
    names = ["es", "fr", *(f"s{a}{b}" for a in letters[:4] for b in letters)][:sections]
    urls = [f"http://h.net/{name}/{letters[k]}" for name in names for k in range(10 if name in ("es", "fr") else pages)]
    got = url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(got) == len(urls) and all(r["verdict"] == ("block" if r["path"][:4] in ("/es/", "/fr/") else "allow") for r in got)


def test_names_of_pages_are_one_template_for_each_verdict(spark):
    urls = [f"http://h.net/{name}/{a}{b}" for name in ("es", "de") for a in "abcdefg" for b in "abcdefg"] + ["http://h.net/7/x"]
    got = {(r["path"].split("/")[1], r["template"], r["verdict"]) for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {("es", "/es/?block", "block"), ("de", "/de/?", "allow"), ("7", "/*/x", "allow")}
