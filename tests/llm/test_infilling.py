"""Infilling: the wavelet matrix and the cuts against brute force, exact round trips, odd input."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideloom.llm import infilling

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "word": r"[^ \t\v\f\r\n]*[ \t\v\f\r\n]|[^ \t\v\f\r\n]+"}
TEXTS = [
    None, "", "\n", "\n\n\n", "a", "one\ntwo", "one\ntwo\n", "é𝒳\n ß? Ja!\nlast. ", "\r\n\r\n a\u2028b", "has <P> inside\nx", "<S>", "x<M>y\nz", "<\nP>\n<S\n>M>", "a b  c\td" * 50,
    "Zeile\n" * 4000, "x" * 300_000, "wörd " * 60_000 + "\nend",
]


def by_hand(doc_id, text, unit="line", rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i * 8 : i * 8 + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_ranks_by_brute_force(size):
    symbols = np.random.default_rng(size).integers(0, 8, size).astype(np.uint8)
    matrix = infilling.WaveletMatrix(symbols)
    at = np.arange(size + 1)
    for wanted in ((0,), (1, 3), (7,), tuple(range(8))):
        assert matrix.rank(wanted, at).tolist() == [int(np.isin(symbols[:i], wanted).sum()) for i in at]


@pytest.mark.parametrize("unit", ["line", "sentence", "word"])
@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (0, 100)])
def test_cuts_by_brute_force(spark, monkeypatch, unit, rate, spm):
    monkeypatch.setattr(infilling, "SLICE_BYTES", 1000)
    rows = [(i * 7 + k, t) for k in range(6) for i, t in enumerate(TEXTS[:-3])] + [(None, "a\nb\nc"), (1, "x\ny"), (1, "x\ny")] + [(500 + i, t) for i, t in enumerate(TEXTS[-3:])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit("clash")).withColumn("__text", F.lit(1))
    found = infilling.infilled(frame, unit, rate, spm).withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:6] for r in found), key=key) == sorted((by_hand(d, t, unit, rate, spm) for d, t in rows), key=key)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t or "")
    assert all(r.back in texts[r.doc_id] for r in found)


def test_other_sentinels_and_empty_tables(spark):
    frame = spark.createDataFrame([(i, f"a{i}\nb <P> c\nd") for i in range(20)], "id int, body string")
    marks = ("[pre]", "[suf]", "[mid]")
    made = infilling.infilled(frame, sentinels=marks, doc_id="id", text="body")
    rows = made.withColumn("back", infilling.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.back == f"a{r.doc_id}\nb <P> c\nd" for r in rows)
    assert infilling.infilled(frame.where("false"), doc_id="id", text="body").count() == 0
