import importlib.util
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[2]
SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_queries_with_sql(spark, name):
    from check import compare, connect

    assert compare(spark, connect(SF_DIR), name, SF_DIR) == ""


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR))
        assert docs.columns == columns, name
        if name != "mixing":
            assert docs.select("doc_id").distinct().count() == docs.count() < before
    words = sum(len(r.text.split()) for r in docs.select("text").collect())
    assert words > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}


def test_stages_against_plain_python(spark):
    """Every stage of the smallest table, worked out again without Spark."""
    import corpus_pipeline
    from test_minhash import brute
    from test_mixing import targets
    from test_quality import counted
    from tokenizers import Tokenizer

    quality, near_dedup, mixing, packing = [stage for _, stage in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = corpus_pipeline.stored(quality(spark, docs, SF_DIR))
    # Too few labels here for any cutoff: the base alone decides.
    passed = []
    for r in docs.collect():
        n_words, *_, n_repeat = counted(r.text)
        if n_words >= 10 and 100 * n_repeat <= 20 * n_words:
            passed.append(r)
    assert sorted(good.collect()) == sorted(passed)
    one_each = corpus_pipeline.stored(near_dedup(spark, good, SF_DIR))
    roots = {c for _, _, c in brute([(r.doc_id, r.text) for r in passed], 5, 80)}
    kept = [r for r in passed if r.doc_id in roots]
    assert sorted(one_each.collect()) == sorted(kept)
    mixed = corpus_pipeline.stored(mixing(spark, one_each, SF_DIR))
    sizes, taken, whole = {}, {}, {r.doc_id: r for r in kept}
    for r in kept:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    rows = mixed.collect()
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        assert r.text.split() == whole[r.doc_id].text.split()[: len(r.text.split())]
    wanted = targets(sizes)
    assert all(abs(taken.get(s, 0) - wanted[s]) <= 0.5 + 1e-6 for s in sizes)
    ids = Tokenizer.from_file(corpus_pipeline.WORD_TOKENIZER)
    lengths = sorted(len(ids.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows)
    pieces = packing(spark, mixed, SF_DIR).collect()
    assert sum(p.length for p in pieces) == sum(lengths)
    assert {p.doc_tokens for p in pieces} == set(lengths)


def test_run_is_the_stages_in_turn(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, SF_DIR).agg({"length": "sum"}).first()[0] > 0


def test_the_rest_imports_without_these_folders(tmp_path):
    """The entry module alone guards against absent operators."""
    for path in ("eventmill", "__spark_entry__.py"):
        (tmp_path / path).symlink_to(ROOT / path)
    spec = importlib.util.spec_from_file_location("bare_entry", tmp_path / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    held = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("eventmill.llm") or k == "corpus_pipeline"}
    blocked = _Blocked()
    sys.meta_path.insert(0, blocked)
    try:
        assert module.queries() and not any(n.startswith("op") for n in module.queries())
    finally:
        sys.meta_path.remove(blocked)
        sys.modules.update(held)


class _Blocked:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "eventmill.llm.queries"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return None
