"""Derived inputs lose nothing of their tables."""

import re

from suite.views import Views

BASE = "/root/testdata/sf0.001"


def test_every_item_of_a_page_is_read(spark):
    v = Views(spark, BASE)
    pages = [r.html for r in v.table("pages").select("html").collect()]
    found = {r.label: r["count"] for r in v.html_items.groupBy("label").count().collect()}
    for tag, label in (("h1", "SECTION_HEADER"), ("p", "PARAGRAPH"), ("li", "LIST_ITEM")):
        assert found[label] == sum(len(re.findall(f"<{tag}[ >]", html)) for html in pages)
    items = v.html_items.where("label = 'LIST_ITEM'").collect()
    assert items and all(r.text and "<" not in r.text for r in items)


def test_every_tree_is_asked(spark):
    v = Views(spark, BASE)
    assert v.questions.count() == v.nodes.count()
    assert v.nodes.join(v.questions, "document_id", "left_anti").count() == 0
