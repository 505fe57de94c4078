import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventmill.llm import infill
from eventmill.llm.queries import op13_infill

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXT = st.text(alphabet=st.sampled_from("abZ .\n<>PSMé€𝄞日1"), max_size=40)


def plain(doc_id, text, unit="token"):
    """The contract on Python strings."""
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    n = len(units)
    hexes = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def got(doc_id, text, unit="token"):
    n, form, a, b, out = infill.split(text.encode(), 1, doc_id, 90, 20, unit)
    return n, form, a, b, out.decode()


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(0, 10**6), st.sampled_from(infill.UNITS))
def test_splits_like_python_strings(text, doc_id, unit):
    assert got(doc_id, text, unit) == plain(doc_id, text, unit)


@pytest.mark.parametrize("size", [1, 3, 7])
def test_slices_change_nothing(monkeypatch, size):
    monkeypatch.setattr(infill, "SLICE", size)
    for doc_id in range(60):
        text = "naïve ab€cd 𝄞𝄞 x"[: 1 + doc_id % 17]
        assert got(doc_id, text) == plain(doc_id, text)
        assert got(doc_id, text, "char") == plain(doc_id, text, "char")


@given(TEXT)
def test_index_turns_cuts_into_one_another(text):
    index = infill.ExceptionIndex(text.encode())
    assert index.n_chars == len(text)
    assert len(index.places) == sum(ord(c) > 127 for c in text)  # exceptions only
    for char in range(len(text) + 1):
        byte = len(text[:char].encode())
        assert (index.byte_of(char), index.char_of(byte)) == (byte, char)


def test_query_rows(spark, tmp_path, prose):
    texts = [None, "", "a", "é", "<P>x", "half <S", "ends <", "M> <M", "one\ntwo  three", "日本語 𝄞", "x" * 50_000, prose(3, 40_000)]
    rows = [(i, texts[i % len(texts)]) for i in range(300)] + [(None, "no id é"), (7, "twice"), (7, "twice"), (7, "again")]
    folder = tmp_path / "documents.parquet"
    data = spark.createDataFrame([(*r, 9, "x", "y") for r in rows], "doc_id long, text string, n long, form string, output string")
    data.write.parquet(str(folder))
    found = op13_infill(spark, str(tmp_path)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        n, form, a, b, out = plain(doc_id, text)
        want.append((doc_id, n, form, a, b, sha(out), sha(text or "")))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_no_rows_and_wrong_unit(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(docs).collect() == []
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, unit="byte")
