"""The node table in versions."""

import pytest

from arbora.session import work_folder
from arbora.sources import versions as VN

COLUMNS = "id string, document_id string, content string"


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def content(spark, path, **only):
    return sorted(tuple(r) for r in VN.read_current(spark, path, **only).select("id", "document_id", "content").collect())


def test_replace_delete_compact(spark):
    path = work_folder(spark, "versions")
    first = [("a1", "a", "x"), ("a2", "a", "y"), ("b1", "b", "z"), ("n", None, "null id"), ("c1", "c", None), ("c1", "c", None)]
    VN.replace_documents(nodes(spark, *first), path, buckets=4)
    assert content(spark, path, document_id="a") == first[:2]
    VN.replace_documents(nodes(spark, ("a9", "a", "new")), path, buckets=9)
    made = VN.commits(spark, path)
    assert [m["buckets"] for m in made] == [4, 4]
    # the second write holds the document's own row only
    assert spark.read.parquet(f"{path}/rows/attempt={made[1]['attempt']}").count() == 1
    VN.delete_documents(spark, path, nodes(spark, ("", "b", ""), ("", "b", ""), ("", "unknown", "")))
    key = lambda t: tuple(x or "" for x in t)
    want = [("a9", "a", "new"), ("c1", "c", None), ("c1", "c", None), ("n", None, "null id")]
    read = lambda: sorted((tuple(r) for r in VN.read_current(spark, path).collect()), key=key)
    assert read() == want
    VN.compact(spark, path)
    assert len(VN.commits(spark, path)) == 1 and read() == want
    VN.replace_documents(nodes(spark, ("b5", "b", "back")), path)
    assert read() == sorted([*want, ("b5", "b", "back")], key=key)
    assert content(spark, path, document_id="b") == [("b5", "b", "back")]


def test_a_killed_write_is_not_seen(spark, monkeypatch):
    path = work_folder(spark, "versions")
    VN.replace_documents(nodes(spark, ("a1", "a", "x")), path)

    def killed(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(VN, "_commit", killed)
        with pytest.raises(RuntimeError):
            VN.replace_documents(nodes(spark, ("a2", "a", "y")), path)
    assert content(spark, path) == [("a1", "a", "x")]
    VN.replace_documents(nodes(spark, ("a2", "a", "y")), path)
    assert content(spark, path) == [("a2", "a", "y")]


def test_columns_come_later_and_types_stay(spark):
    path = work_folder(spark, "versions")
    VN.replace_documents(nodes(spark, ("a1", "a", "x")), path)
    VN.replace_documents(nodes(spark, ("b1", "b", "y")).selectExpr("id", "document_id", "7 AS level"), path)
    assert sorted(tuple(r) for r in VN.read_current(spark, path).select("id", "level").collect()) == [("a1", None), ("b1", 7)]
    with pytest.raises(ValueError):
        VN.replace_documents(nodes(spark, ("c1", "c", "z")).selectExpr("id", "document_id", "7 AS content"), path)


def test_empty(spark):
    path = work_folder(spark, "versions")
    VN.delete_documents(spark, path, nodes(spark))
    with pytest.raises(ValueError):
        VN.read_current(spark, path)
    VN.replace_documents(nodes(spark), path)
    assert VN.commits(spark, path) == []
    VN.replace_documents(nodes(spark, ("a1", "a", "x")), path)
    VN.replace_documents(nodes(spark), path)
    VN.delete_documents(spark, path, nodes(spark, ("", "a", "")))
    VN.compact(spark, path)
    assert VN.read_current(spark, path).count() == 0 and VN.read_current(spark, path).columns == ["id", "document_id", "content"]
