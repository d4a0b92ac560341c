"""Texts of digits and letters, scripts without spaces, and signatures of unrelated texts."""

import numpy as np
import pytest

from studyloom.llm import langid, near_dups
from tests.llm.conftest import DE, EN, prose


@pytest.fixture(scope="module")
def model(spark):
    hanzi = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生"
    rows = [("en", prose(EN, 80, i)) for i in range(60)] + [("de", prose(DE, 80, 100 + i)) for i in range(60)]
    rows += [("zh", "\n".join("".join(hanzi[(7 * i + 3 * j * k + k) % len(hanzi)] for k in range(30)) for j in range(6))) for i in range(60)]
    return langid.trained(spark.createDataFrame(rows, "lang string, text string"))


def test_tokens_with_digits(spark, model):
    line = "的一是不了人我在有他这为之大来以个中上们到说"
    texts = [
        "9zq8k7w6j " * 500, "9zq8k7w6j " * 500 + "the of and to in", "½ ² ³ 42", "12 34", None,
        prose(EN, 60, 900) + " 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08", prose(DE, 60, 901),
        "\n".join(f"{line}{i}年" for i in range(8)), "\n".join(f"{line}{i}年" for i in range(8)) + " the",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.identified(d, model).collect()}
    assert got[0][1] and got[1][1]
    assert got[2] == got[3] == got[4] == ("und", True)
    assert got[5] == ("en", False) and got[6] == ("de", False)
    assert got[7][0] == got[8][0] == "zh"
    assert model.reject >= langid.REJECT


@pytest.mark.parametrize("n", [50, 500, 5000])
def test_unrelated_texts_are_pruned_by_their_signatures(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(60)]
    sig = near_dups.low_bytes(near_dups.signatures(sets))
    a, b = np.triu_indices(60, 1)
    assert near_dups.likely(sig[a], sig[b], 0.8).mean() < 0.01
    near = [np.unique(np.concatenate([s[: int(0.9 * len(s))], rng.integers(0, 1 << 63, len(s) // 12).astype(np.uint64)])) for s in sets]
    assert near_dups.likely(sig, near_dups.low_bytes(near_dups.signatures(near)), 0.8).all()
