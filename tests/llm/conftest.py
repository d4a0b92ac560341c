import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, row string, word string, `order` string, place string, component string"
EN = "the of and to in that with for was is on are by it from this which not have were their been has more when will would there what about into over time other only new some could these two may then do first any my now such like our people little long great after day same right still old where".split()
DE = "der die und das ist nicht ein eine mit auf für sich den von werden schön müssen können größe straße über zwischen während jahr zeit haben wurde durch gegen einer auch noch immer wieder sehr".split()


def prose(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def records():
    """Clean documents, copies, near copies, junk, nulls in every column, an empty and a very long text, repeated rows."""
    rows = [(i, prose(EN if i % 3 else DE, 60 + i % 40, i), "en" if i % 3 else "de", ("src%d" % (i % 4)) if i % 5 else "hot") for i in range(1, 61)]
    text = rows[6][1]
    near = text.split()
    near[5] = "changed"
    rows += [(101, text, "en", "src1"), (102, " ".join(near), "en", "src2"), (103, text.upper(), "en", "hot")]
    rows += [(200, None, "en", "src1"), (201, "", "de", "src2"), (202, " \t\n ", "en", None), (203, "12 34 !!", None, "src0"), (None, prose(EN, 70, 900), "en", "src3"), (204, prose(EN, 70, 901), None, None)]
    rows += [(205, prose(EN, 20_000, 902), "en", "src1"), (206, "word", "en", "src1"), (207, "word", "en", "src1"), (208, prose(DE, 55, 903) + "\n" + prose(DE, 55, 903), "de", "src2")]
    rows += [rows[0], rows[0], (209, "$$$ %%% " * 60, "en", "src0"), (210, " one\u0085two three\x1cfour five", "en", "src0"), (-5, prose(EN, 80, 904), "en", "src3")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, records):
    """With columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None, "x", "y", None, "z", "o", "p", None) for i, t, la, s in records], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
