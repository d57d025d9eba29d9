"""Each stage on what the one before it left, and the whole."""

from collections import defaultdict

import corpus_pipeline
from ledgerspark.llm import catalogue, common, secrets

from tests.llm.test_duplicates import lowered, near
from tests.llm.test_tokens import library


def test_stages_in_order(spark, documents, sf_dir):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs = common.stored(stage(spark, docs, sf_dir))
        if name != "packing":
            assert docs.columns == documents.columns
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in seen.items() if name != "packing"}
    source = {r.doc_id: r for r in documents.collect()}
    assert rows["language_id"].keys() == {i for i, r in source.items() if any(map(str.isalpha, r.text or ""))}
    first = {}
    for i, r in sorted(rows["language_id"].items()):
        first.setdefault(lowered(r.text), i)
    assert rows["exact_dedup"].keys() == set(first.values())
    assert rows["near_dedup"].keys() == {c for _, c in near([(i, r.text) for i, r in rows["exact_dedup"].items()]).values()}
    assert rows["secret_scan"].keys() == rows["near_dedup"].keys()
    for i, r in rows["secret_scan"].items():
        assert r.text == secrets.redacted_text(source[i].text) and r.n_chars == len(r.text)
    tokens = defaultdict(int)
    for p in seen["packing"].collect():
        tokens[p.doc_id] += p.length
    assert tokens == {i: len(library(r.text)) // 4 + 1 for i, r in rows["secret_scan"].items()}


def test_odd_and_empty_tables(spark, odd, nothing, sf_dir):
    for table in (odd.select("doc_id", "text", "lang", "source", "n_chars"), nothing.select("doc_id", "text", "lang", "source", "n_chars")):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, sf_dir))
        assert (docs.count() > 0) == (not table.isEmpty())


def test_every_operator_is_registered():
    names = catalogue.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
