"""Each operator against a plain version, with nulls, empty and very long texts, ties, repeated rows, an empty table and
clashing column names in one small table."""

import base64
import hashlib
import json
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from studyloom.llm import bpe, langid, lm, mixing, near_dups, quality, secret_scan, sharding, token_counts, top_k
from studyloom.llm.common import lower_words, numbered
from studyloom.llm.queries import vocabulary
from tests.llm import brute


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 1 -----------------------------------------------------------------------------------------------------------------


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + head + body


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([7] * k)) for k in (64, 3, 64, 32, 32, 32, 32, 32)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b"")) + der(4, RSA))
SSH = secret_scan.OPENSSH + b"".join(len(x).to_bytes(4) + x for x in (b"none", b"none", b"")) + (1).to_bytes(4) + b"".join(len(x).to_bytes(4) + x for x in (b"pub" * 9, b"private" * 20))


def token(header, payload):
    return ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps(header).encode(), json.dumps(payload).encode(), b"signature"))


@pytest.mark.parametrize("key", [RSA, PKCS8, SSH])
def test_keys_are_confirmed_by_their_lengths(key):
    assert secret_scan.is_key(key)
    assert not secret_scan.is_key(key[:-1]) and not secret_scan.is_key(key + b"\0")
    text = "a " + base64.b64encode(key).decode() + " b"
    kinds = {k for k, *_ in secret_scan.confirmed_spans(text)}
    assert kinds == {"key64"}
    assert {k for k, *_ in secret_scan.confirmed_spans(f"x {key.hex()} y")} == {"keyhex"}
    pem = f"-----BEGIN PRIVATE KEY-----\n{base64.encodebytes(key).decode()}-----END PRIVATE KEY-----"
    assert [(b, e) for k, b, e in secret_scan.confirmed_spans(f"é {pem}.") if k == "pem"] == [(2, 2 + len(pem))]
    broken = base64.b64encode(key[:40] + b"\x99" + key[41:-3]).decode()
    assert not secret_scan.confirmed_spans(f"-----BEGIN PRIVATE KEY-----{broken}-----END PRIVATE KEY----- {broken}")


@pytest.mark.parametrize("key", [RSA, PKCS8, SSH])
def test_keys_are_found_wherever_base64_stands(key):
    plain, url = base64.b64encode(key).decode(), base64.urlsafe_b64encode(key).decode().rstrip("=")
    lines = base64.encodebytes(key).decode().strip()
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----\n"
    nested = base64.b64encode(pem.encode()).decode()
    for found in (plain, url, lines, lines.replace("\n", "\\n"), nested):
        for before, after in (("PRIVATE_KEY=", "\nNEXT=1"), ("k: ", " b"), ("/", "&x"), ("\\n", "\n\nand words follow"), ('"', '"')):
            text = before + found + after
            got = [(text[b:e].rstrip("="), k) for k, b, e in secret_scan.confirmed_spans(text)]
            want = found if found != nested else text[len(before) :][: len(got[0][0])]
            assert got == [(want.rstrip("="), "key64")] and len(want) >= len(found) - 4, text
    assert not secret_scan.confirmed_spans(f"K={plain[:-8]}\n") and not secret_scan.confirmed_spans(f"K={nested[:200]}")


def test_encrypted_keys_with_headers_are_told_by_their_marks():
    body = base64.encodebytes(bytes(range(200))).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n{body}-----END RSA PRIVATE KEY-----"
    assert secret_scan.confirmed_spans(f"x {pem}\n") == [("pem", 2, 2 + len(pem))]


def test_tokens_are_confirmed_by_their_header():
    good, no_alg = token({"alg": "HS256"}, {"sub": 1}), token({"typ": "JWT"}, {"sub": 1})
    assert [k for k, *_ in secret_scan.confirmed_spans(f"{good} {no_alg} eyJhbGci.eyJzdWIi.x")] == ["jwt"]


def test_base_spans():
    text = 'ſecret: xxxxxxxxxxxx API_KEY = "abcdefghijkl" token:short AKIA0123456789ABCD AKIA0123 0123456789abcdef0 0123456789ABCDEF apikey=abcdefghijkl'
    got = {(k, text[b:e]) for k, b, e in secret_scan.base_spans(text)}
    assert got == {("assign", 'API_KEY = "abcdefghijkl'), ("assign", "apikey=abcdefghijkl"), ("access", "AKIA0123456789ABCD"), ("hex", "0123456789abcdef0")}
    assert secret_scan.redacted("a 0123456789abcdef b", [("hex", 2, 18), ("assign", 2, 10)]) == "a [secret] b"


def test_secrets(spark, docs, nothing, records):
    got = {r["doc_id"]: r for r in secret_scan.secrets(docs).collect()}
    assert got[200]["base_sha256"] == got[201]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[200]["spans"] == ""
    assert secret_scan.secrets(docs).count() == len(records) and not rows_of(secret_scan.secrets(nothing))
    clean = docs.filter("doc_id <> 209")
    assert sorted(map(str, rows_of(secret_scan.redacted_documents(clean)))) == sorted(map(str, rows_of(clean)))


# 2, 9 --------------------------------------------------------------------------------------------------------------


def test_merge_queue_equals_plain_merging():
    rng = np.random.default_rng(1)
    b = bpe.Bpe.__new__(bpe.Bpe)
    for _ in range(200):
        names, ranks = list("abc"), {}
        for _ in range(12):
            x, y = rng.choice(names, 2)
            if x + y not in names:
                ranks[x, y] = len(ranks)
                names.append(x + y)
        at = {s: i for i, s in enumerate(names)}
        b.width = len(names)
        b.merges = {at[x] * b.width + at[y]: (r, at[x + y]) for (x, y), r in ranks.items()}
        word = rng.choice(list("abc"), rng.integers(1, 30))
        assert [names[i] for i in b.piece([at[c] for c in word])] == brute.greedy_bpe(word, ranks)


TEXTS = ["", " ", "a", "a  b", "\n\nx \n y", "it's 42!! <|endoftext|> x  <|endoftext|>", "é中😀\x85\x1c ́", "a \t\n b\n", "x" * 5000, " '", "word.\nWord", " a"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(spark, docs, nothing, records, name):
    path = vocabulary(name)
    if name.endswith("model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda t: len(m.encode(t))
    else:
        from tokenizers import Tokenizer

        m = Tokenizer.from_file(path)
        n = lambda t: len(m.encode(t, add_special_tokens=False).ids)
    c = token_counts.Counter(path)
    assert c.counts(TEXTS) == [n(t) for t in TEXTS] == c.counts(TEXTS)
    if name.endswith("50k.json"):
        want = Counter((i, len((t or "").encode()), k := n(t or ""), k > 1024) for i, t, *_ in records)
        assert Counter(rows_of(token_counts.token_counts(docs, path))) == want
        assert not rows_of(token_counts.token_counts(nothing, path))


def test_bpe(spark, docs, nothing, records):
    from tokenizers import Tokenizer

    path = vocabulary()
    lib, own = Tokenizer.from_file(path), bpe.load(path)
    for t in TEXTS:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == np.array(ids, "<u4").tobytes() and "".join(bpe.segments(t, own.cut_special)) == t
        assert own.decode(own.encode(t)) == lib.decode(ids, skip_special_tokens=False) == t
    out = bpe.encoded(docs, path)
    for r in out.collect():
        assert len(r["ids"]) == r["n_tokens"] and hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"]
    back = bpe.decoded(out, path)
    assert Counter(rows_of(back)) == Counter((i, t or "") for i, t, *_ in records)
    assert not rows_of(bpe.encoded(nothing, path))
    assert rows_of(bpe.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), path)) == [(1, None), (2, "")]


# 3 -----------------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, nothing, records):
    got = quality.quality(docs).collect()
    assert len(got) == len(records)
    assert Counter(tuple(r)[:7] for r in got) == Counter((i, *brute.quality(t)) for i, t, *_ in records)
    for r in got:
        assert not (r["kept"] and r["base_failed"]) and r["kept"] == (not r["base_failed"] and not r["failed"])
        if r["doc_id"] is not None and 1 <= r["doc_id"] <= 60:
            assert r["kept"], r
    assert not rows_of(quality.quality(nothing))


def test_quality_thresholds_adapt(spark):
    """The same share of symbols is usual in one source and odd in the other."""
    code, prose = "a | b | c | d " * 15, "plain words go here and there " * 1
    words = [" ".join(f"{w}{i}x{j}" for j, w in enumerate((prose * 12).split())) for i in range(150)]
    coded = [" ".join(f"{w}{i}x{j}" if w != "|" else w for j, w in enumerate(code.split())) for i in range(150)]
    d = [(i, t, "en", "prose") for i, t in enumerate(words)] + [(1000 + i, t, "en", "code") for i, t in enumerate(coded)] + [(5000, coded[3], "en", "prose")]
    bad = {r["doc_id"] for r in quality.quality(spark.createDataFrame(d, "doc_id long, text string, lang string, source string")).filter("not kept").collect()}
    assert bad == {5000}


def test_quality_fences_of_groups_without_spread(spark):
    """One outlier of each measure in a source where no document has anything of it."""
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05}")
    lines = lambda k: [" ".join(word(k * 100 + j * 5 + x) for x in range(5)) for j in range(20)]
    text = lambda k, change: "\n".join(change(lines(k)))
    words = lambda k, change: " ".join(change(" ".join(lines(k)).split()))
    odd = {
        "symbol_share": words(501, lambda w: [x + "|" * (i < 19) for i, x in enumerate(w)]),
        "odd_share": words(502, lambda w: [x + ";" * (i < 60) for i, x in enumerate(w)]),
        "upper_share": words(503, lambda w: [x.upper() if i < 15 else x for i, x in enumerate(w)]),
        "dup_line_share": text(504, lambda x: [y for i in range(12) for y in [x[i], *["zzzzz"] * (i < 8)]]),
        "repeat_share": words(505, lambda w: w[:85] + w[:15]),
        "word_length": words(506, lambda w: [x * 2 for x in w]),
    }
    d = [(k, text(k, list), "en", "plain") for k in range(150)] + [(1000 + i, t, "en", "plain") for i, t in enumerate(odd.values())]
    bad = {r["doc_id"]: r["failed"] for r in quality.quality(spark.createDataFrame(d, "doc_id long, text string, lang string, source string")).filter("not kept").collect()}
    assert set(bad) == set(range(1000, 1006)) and all(m in bad[1000 + i] for i, m in enumerate(odd))


def test_repeated_words_of_random_words(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(list("abcd"), n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 8, 16, 17, 31, 32, 33, 64, 65, 200, 1000])]
    got = dict(rows_of(spark.createDataFrame(texts, "i long, t string").select("i", quality.repeated_words(quality.words_of(F.col("t"))))))
    assert got == {i: brute.quality(t)[4] for i, t in texts}


# 4 -----------------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)).round(2)
    x[50:90] = x[7]
    rows = [(int(i), [float(c) for c in v], "x") for i, v in enumerate(x)] + [(300, None, "x"), (301, [1.0, None], "x"), (302, [float("nan")] * 6, "x"), (303, [float("inf")] * 6, "x"), (304, [1.0], "x"), (None, [1.0] * 6, "x"), (5, [float(c) for c in x[5]], "x")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    ints = {i: [math.floor(64 * c) for c in v] for i, v, _ in rows[:301] if v} | {304: [64]}
    want = brute.top_k(ints, [i for i in ints if i % 20 == 0], 20)
    for sizes in (top_k.Sizes(), top_k.Sizes(pivots=9, queries=4, rows=50), top_k.Sizes(pivots=1)):
        assert sorted(rows_of(top_k.top_k(d, F.col("id") % 20 == 0, sizes=sizes))) == sorted(want)
    few = d.filter("vec_id in (0, 1, 20)")
    assert Counter(r[0] for r in rows_of(top_k.top_k(few, F.col("id") % 20 == 0))) == {0: 2, 20: 2}
    assert not rows_of(top_k.top_k(d.filter("false"), F.col("id") % 20 == 0)) and not rows_of(top_k.top_k(few, F.lit(False)))


# 5 -----------------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, nothing, records):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(records)
    size = Counter()
    for _, t, _, s in records:
        size[s] += len(brute.WORD.findall(t or ""))
    want = brute.mix_targets(size)
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    longest = Counter()
    for r in got:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s, t in want.items():
        # whole documents: half of one that holds most of its source, else a few words
        assert abs(taken[s] - t) <= (longest[s] / 2 if longest[s] > 1000 else 30), (s, taken[s], t)
    assert Counter(map(str, mixing.mixed(docs.repartition(3)).collect())) == Counter(map(str, got))
    assert not rows_of(mixing.mixed(nothing))


def test_newton_meets_the_targets(spark):
    counts = spark.createDataFrame([("a", s, 5) for s in range(0, 50)] + [("b", 10**s, 1) for s in range(5)] + [("c", 7, 3)], "source_key string, size long, n long")
    sizes = {"a": 5 * 49 * 25, "b": 11111, "c": 21}
    for share in (0.001, 0.3, 1.0, 1.7, 1.999):
        goals = spark.createDataFrame([(k, v, share * v) for k, v in sizes.items()], "source_key string, source_size long, target double")
        tilts = {r[0]: r[1:] for r in rows_of(mixing.balanced(counts, goals))}
        for key, total in sizes.items():
            mean, tilt = tilts[key]
            words = sum(n * s * min(2.0, math.exp(min(50, tilt * s / mean))) for k, s, n in rows_of(counts) if k == key)
            assert words == pytest.approx(share * total, rel=1e-6)


# 6 -----------------------------------------------------------------------------------------------------------------


def test_language_models_sum_to_one():
    m = langid.fitted([("a", "  x", 3), ("a", " xy", 2), ("a", " x ", 1), ("a", "xy ", 2), ("b", "  y", 4), ("b", " y ", 4)], 3)
    for context in ("  ", " x", "xy", "zz"):
        for k in range(2):
            keys = {g: None for g in "xy "}
            p = []
            for c in keys:
                codes = langid.codes_of(context + c)
                h = langid.gram_hashes(codes, 3)
                w, got = 1.0, None
                for o in (3, 2, 1):
                    i = langid.find(m.grams[o][0], h[o][-1:])[0]
                    if i >= 0:
                        got = w * m.grams[o][1][i, k]
                        break
                    j = langid.find(m.contexts[o - 1][0], h[o - 1][-2:-1])[0]
                    w *= m.contexts[o - 1][1][j, k] if j >= 0 else 1.0
                p.append(got if got is not None else w * m.floor[k])
            # one more character stands for all unseen ones
            assert 0.5 < sum(p) <= 1 + 1e-5


def test_language_id(spark, docs, nothing, records):
    model = langid.trained(docs.select("lang", "text"))
    assert model.langs == ["de", "en"]
    got = langid.identified(docs, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(records)
    for i in (200, 201, 202, 203):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"]
    right = [by[i]["lang_pred"] == la and not by[i]["rejected"] for i, _, la, _ in records[:60]]
    assert all(right) and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, "xq zvjx kqqz jjxwq zzzxq vvkxj qqqwx zxkjq xjqzk " * 9)], "doc_id long, text string")
    assert langid.identified(odd, model).first()["rejected"]
    assert langid.trained(nothing.select("lang", "text")) is None
    assert {r["lang_pred"] for r in langid.identified(docs, None).collect()} == {"und"}
    assert not rows_of(langid.identified(nothing, model))


# 7 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, nothing, records, width):
    got = rows_of(near_dups.near_duplicates(docs, width=width))
    assert len(got) == len(records)
    keyed = [(i, t) for i, t, *_ in records if i is not None]
    want = brute.near_components(list(dict.fromkeys(keyed)), width)
    sizes = Counter((i, len(brute.shingles(t, width))) for i, t, *_ in records)
    assert Counter(r[:2] for r in got) == sizes
    for i, _, c, kept in got:
        assert (c, kept) == (want[i], want[i] == i) if i is not None else (c is None and kept)
    assert not rows_of(near_dups.near_duplicates(nothing, width=width))


@pytest.mark.parametrize("size", [near_dups.BLOCK_BYTES, 20_000])
def test_near_duplicates_of_a_chain_and_a_cloud(spark, size):
    """Neighbours in a chain are linked but ends aren't; a cloud of copies with several edits each."""
    rng = np.random.default_rng(3)
    chain = [(i, " ".join(f"w{j}" for j in range(i * 4, i * 4 + 60))) for i in range(40)]
    base = [f"b{j}" for j in range(120)]
    cloud = []
    for i in range(150):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 12)):
            w[j] = f"e{rng.integers(10**6)}"
        cloud.append((1000 + i, " ".join(w)))
    d = chain + cloud
    got = {r[0]: r[2] for r in rows_of(near_dups.near_duplicates(spark.createDataFrame(d, "doc_id long, text string"), width=2, block=16, block_bytes=size))}
    assert got == brute.near_components(d, 2)


def test_least_matches_keep_similar_pairs():
    """At the threshold itself a pair is lost by one batch or another with less than the chosen chance, times batches."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (4000, near_dups.HASHES), np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape, np.uint8))
    assert near_dups.likely(a, b, 0.8).all()
    far = np.where(rng.random(a.shape) < 0.5, a, rng.integers(0, 256, a.shape, np.uint8))
    assert near_dups.likely(a, far, 0.8).mean() < 0.01


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(500, 3), (3, 700), (700, 701), (9, 9)]
    got = dict(rows_of(near_dups.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: 100 for i in range(100, 131)} | {500: 3, 3: 3, 700: 3, 701: 3}


# 8 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [lm.Size(), lm.Size(top_words=3, max_bytes=4096)])
def test_lm_scores(spark, docs, nothing, records, size):
    held = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    model, words = lm.trained(docs.filter(~held), size)
    got = lm.scored(docs, model, words, held).collect()
    is_held = lambda i: i is not None and brute.crc(i) % 5 == 1
    n, want = brute.base_scores([(k, i, t) for k, (i, t, *_) in enumerate(records)], is_held)
    pack = lambda i, h, a, b, c, s: (i, h, a, b, c, round(s, 6))
    assert Counter(pack(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == Counter(
        pack(i, is_held(i), *want[k][:2], n, want[k][2]) for k, (i, *_) in enumerate(records)
    )
    assert all(r["score"] < 0 for r in got)
    assert not rows_of(lm.scored(nothing, model, words))
    model, words = lm.trained(nothing, size)
    assert {r["n_known"] for r in lm.scored(docs, model, words).collect()} == {0}


@pytest.mark.parametrize("size", [lm.Size(), lm.Size(top_words=3, max_bytes=4096), lm.Size(top_words=40, tokens_per_segment=256)])
def test_lm_keeps_every_pair_at_any_size(spark, docs, records, size):
    """Pairs and words seen once count as much as in a plain model, however small the parts are in which counts are held."""
    more = [(i, f"rare{i} word{i} of the rare{i // 2} word{i // 2} again again again") for i in range(1000, 1400)]
    train = [(i, t) for i, t, *_ in records] + more
    model, words = lm.trained(spark.createDataFrame(train, "doc_id long, text string"), size)
    held = [*more[:50], (1, "rare1000 word1000 never seen of the"), (2, None), (3, train[0][1])]
    want = brute.pair_scores([t for _, t in train], held, lm.MU)
    got = {r["doc_id"]: r["score"] for r in lm.scored(spark.createDataFrame(held, "doc_id long, text string"), model, words).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_lm_sums_of_documents_go_by_slice(spark, docs, records, monkeypatch):
    """A task gives one row for all documents of a slice, not one for each, whatever the number of segments and blocks."""
    kept = {}

    def stored(df, name, store=lm.stored):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(lm, "stored", stored)
    monkeypatch.setattr(lm, "BLOCK", 20)
    monkeypatch.setattr(lm, "TASKS", 2)
    train = [(i, t) for i, t, *_ in records]
    model, words = lm.trained(spark.createDataFrame(train, "doc_id long, text string"), lm.Size(top_words=40, tokens_per_segment=256))
    held = [(k, t) for k, (_, t) in enumerate(train)]
    got = {r["doc_id"]: r["score"] for r in lm.scored(spark.createDataFrame(held, "doc_id long, text string").repartition(5), model, words).collect()}
    assert got == pytest.approx(brute.pair_scores([t for _, t in train], held, lm.MU), abs=1e-6)
    assert kept["scores"].filter(F.col("kind") == lm.PAIRS).count() <= 5 * 2
    assert kept["scores"].filter(F.col("kind") == lm.DOCUMENT).count() == len(held)


def test_lm_words_are_those_of_the_contract():
    texts = [" a  B\x1cc \u0130 \x85x\x0b\x0cY\u3000z", "", None, "  \t ", "\tA a\n"]
    numbers, first, hashes = lm.words_of(pa.array(["cut off", *texts], pa.string())[1:])
    want = [[*(xxh64_intdigest(w.encode()) for w in lower_words(t or "")), xxh64_intdigest(b" ")] for t in texts]
    assert [hashes[x].tolist() for x in np.split(numbers, first[1:])] == want


def test_filter_reads_levels_back():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 20_000, np.int64).astype(np.uint64)
    n = rng.integers(1, 500, len(x))
    f = lm.Filter(np.frombuffer(lm.made_segment(x, n, 3_000_000, 8.0), np.uint8), 1, 3_000_000)
    got = f.levels(x)
    assert (got >= lm.level(n)).all() and (got == lm.level(n)).mean() > 0.98
    other = rng.integers(0, 2**63, 20_000, np.int64).astype(np.uint64)
    assert (f.levels(other) == 0).mean() > 0.95
    tight = lm.made_segment(x, n, 900_000, 8.0)
    kept = lm.Filter(np.frombuffer(tight, np.uint8), 1, 900_000).levels(x)
    assert (kept >= lm.level(n))[n >= 256].all()


# 10 ----------------------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, nothing, records):
    got = sharding.shards(docs, [1.0] * 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in got) == Counter((i, len((t or "").encode()) + 1, brute.crc(t or ""), "key") for i, t, *_ in records)
    for s, slots in brute.groups_by((r["shard"], r["slot"]) for r in got).items():
        assert 0 <= s < 8 and sorted(slots) == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert not rows_of(sharding.shards(nothing, [1.0] * 8))


def test_shards_follow_weights_and_move_little(spark):
    d = spark.range(20_000).select("id", sharding.shard_of(F.col("id"), [1, 2, 0, 5]).alias("a"), sharding.shard_of(F.col("id"), [1, 2, 0, 4]).alias("b"))
    share = {s: n / 20_000 for s, n in rows_of(d.groupBy("a").count())}
    assert share == pytest.approx({0: 1 / 8, 1: 2 / 8, 3: 5 / 8}, abs=0.02)
    moved = d.filter("a <> b")
    assert moved.count() < 20_000 * 0.12 and not moved.filter("a <> 3").count()


def test_numbered_is_gapless_with_null_keys(spark):
    d = spark.createDataFrame([(None if i % 7 == 0 else i % 2, i // 3) for i in range(500)], "k long, v long")
    got = rows_of(numbered(d, ["k"], [F.col("v")], "n", F.floor(F.col("v") / 10)))
    for rows in brute.groups_by((k, (n, v)) for k, v, n in got).values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(len(rows))) and [v for _, v in rows] == sorted(v for _, v in rows)
