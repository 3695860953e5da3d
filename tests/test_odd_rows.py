"""Queries against their SQL on rows that the given tables lack at small scale."""

import os

import pytest

from newsloom.catalog import REGISTRY, Tables
from newsloom.schemas import TABLES
from tests.oracle import NAMES, ROOT, connect, differences

PAGES = [
    (1, "https://a.example/x", "<html><head><title>One title</title></head><body><p>A paragraph of sufficient length.</p></body></html>"),
    (2, "https://a.example/x", "<html><head><title>Two titles</title></head><body><div>Loose text of the body, and no paragraph.</div></body></html>"),
    (3, "https://a.example/y", "<html><head><title>Main</title></head><body><nav>menu</nav><main>Loose text of main, long enough.</main><p>short</p></body></html>"),
    (4, "https://a.example/z", "<html><head><title>Short</title></head><body>short</body></html>"),
]
DOCUMENTS = [
    (1, "the local ai of llm the rest", "en", "s", 28), (2, "Über", "de", "s", 4), (3, "a semantic store with episodic store, then Local AI.", "en", "s", 50), (4, "", "en", "s", 0),
    (5, "AI agents say the same and ai agents say the", "en", "s", 44),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    made = {"pages": PAGES, "documents": DOCUMENTS}
    for name in NAMES:
        if name in made:
            spark.createDataFrame(made[name], TABLES[name]).toPandas().to_parquet(path / f"{name}.parquet", index=False)
        else:
            os.symlink(f"{ROOT}/sf0.001/{name}.parquet", path / f"{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["item_concepts", "page_graph_edges", "page_text_spans", "web_items"])
def test_query(name, spark, odd):
    assert differences(REGISTRY[name], Tables(spark, odd), connect(odd)) is None
