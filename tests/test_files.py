import hashlib

import pytest

from arbora.sources import files

DATA = {"small.bin": b"abc", "a b%20é.bin": bytes(range(256)) * 20}


@pytest.fixture
def folder(tmp_path):
    for name, data in DATA.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def rows(found):
    return {r.path.rsplit("/", 1)[1]: (r.length, r.content_sha256, r.content) for r in found.collect()}


def expected(most):
    return {n: (len(d), hashlib.sha256(d).hexdigest(), d if len(d) <= most else None) for n, d in DATA.items()}


def test_files_longer_than_a_value_are_digested(spark, folder):
    """Spark refuses a value over this limit (2 GB as given)."""
    name = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(name)
    spark.conf.set(name, "1000")
    try:
        assert rows(files.scan_files(spark, folder, "*.bin")) == expected(1000)
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("most", [None, 0, 3, 5120])
def test_digests_do_not_depend_on_the_limit(spark, folder, most):
    found = files.scan_files(spark, folder, "*.bin", most)
    assert rows(found) == expected(1 << 30 if most is None else most)
    assert found.columns == ["path", "modificationTime", "length", "content", "content_sha256"]


def test_paths_with_a_scheme(spark, folder):
    assert rows(files.scan_files(spark, f"file://{folder}", "*.bin", 3)) == expected(3)
