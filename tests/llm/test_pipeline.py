"""The stages one by one, on the small fixture and on the smallest tables."""

from collections import Counter

import pytest

import corpus_pipeline as P
from studyloom.llm import langid, mixing, secret_scan
from studyloom.llm.common import stored
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, d = [docs], docs
    for name, stage in P.STAGES:
        d = stored(stage(spark, d, SF), "stage")
        out.append(d)
    return out


def test_columns(stages):
    assert [name for name, _ in P.STAGES] == ["language ID", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "BPE encoding and decoding"]
    assert all(tuple(d.columns) == P.COLUMNS for d in stages[1:-1])


def test_decisions_take_effect(stages):
    docs, known, single, clean, mixed, coded = ([r.asDict() for r in d.collect()] for d in stages)
    model = langid.trained(stages[0].select("lang", "text"))
    want = Counter(r["doc_id"] for r in langid.identified(stages[0], model).filter("not rejected").collect())
    assert Counter(r["doc_id"] for r in known) == want and {r["lang"] for r in known} <= {"en", "de"}
    groups = brute.near_components(list({r["doc_id"]: r["text"] for r in known if r["doc_id"] is not None}.items()), 5)
    assert sorted(r["doc_id"] for r in single if r["doc_id"] is not None) == sorted({i for i, c in groups.items() if i == c})
    assert sum(r["doc_id"] is None for r in single) == sum(r["doc_id"] is None for r in known) == 1
    before = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        t = before[r["doc_id"]]
        assert r["text"] == secret_scan.redacted(t, secret_scan.base_spans(t) + secret_scan.confirmed_spans(t)) and r["n_chars"] == len(r["text"])
    ids = {r["_row"]: r["doc_id"] for r in P.keyed(stages[3]).collect()}
    copies = {ids[r["_row"]]: r["copies"] for r in mixing.mixed(P.keyed(stages[3]), key="_row").collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({i: n for i, n in copies.items() if n})
    assert Counter(r["doc_id"] for r in coded) == Counter(r["doc_id"] for r in mixed)


def test_rows_without_an_id_or_under_one_id(spark, docs):
    """Different texts stay, near copies go, whatever their ids are; a run again keeps the same rows."""
    r = [docs.filter("doc_id = 7").first()["text"], docs.filter("doc_id = 8").first()["text"], docs.filter("doc_id = 10").first()["text"]]
    near = " ".join(["changed", *r[0].split()[1:]])
    rows = [(1, r[0], "en", "b", 5), (1, r[1], "en", "a", 5), (None, r[2], "en", None, 5), (None, near, "en", "a", 5), (2, r[1], "en", "a", 5), (1, r[0], "en", "a", 5), (None, r[2], "en", "z", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [sorted(map(str, map(tuple, P.near_duplicates(spark, x, SF).collect()))) for x in (d, d.repartition(3))]
    assert got[0] == got[1] == sorted(map(str, [(1, r[0], "en", "a", 5), (1, r[1], "en", "a", 5), (None, r[2], "en", None, 5)]))
    mixed = P.mixing_sources(spark, d, SF)
    assert {(x["doc_id"], x["text"]) for x in mixed.collect()} <= {(i, t) for i, t, *_ in rows}


def test_empty_table(spark, nothing):
    d = nothing
    for _, stage in P.STAGES:
        d = stored(stage(spark, d, SF), "stage")
    assert d.count() == 0


def test_run(spark):
    assert P.run(spark, SF).count() > 50
