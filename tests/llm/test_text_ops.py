"""Quality, BPE, language and personal data against plain versions and hard rows."""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from pathlib import Path

import data
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.llm import bpe, langid, pii, quality, queries
from corvid.llm import textscan as ts

IDS = [r[0] for r in data.hard_rows()]


# --- quality ---
def plain_grams(text: str | None) -> list[bytes]:
    low = (text or "").lower().encode()
    words = re.findall(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+", low)
    return words + [a + b"\0" + b for a, b in zip(words, words[1:])]


def plain_llr(rows: list[tuple[int, str | None]], good: set[int], bits: int) -> dict[int, float | None]:
    """Exact counts by n-gram: with many buckets no two share one."""
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(plain_grams(t))
        if i in good:
            target.update(plain_grams(t))
    n, m, size = sum(raw.values()), sum(target.values()), 1 << bits
    weight = {g: math.log((target[g] + 1) / (m + size)) - math.log((raw[g] + 1) / (n + size)) for g in raw}
    return {i: (sum(weight[g] for g in plain_grams(t)) / len(plain_grams(t)) if plain_grams(t) else None) for i, t in rows}


def test_quality_is_the_plain_ratio(spark):
    rows = [(i, data.prose(i, 6, "en" if i % 2 else "de") + (" !!! ### " * 5 if i % 5 == 0 else "")) for i in range(40)] + [(40, None), (41, ""), (42, "one")]
    good = {i for i in range(40) if i % 5 and i % 3}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in quality.quality(df, spark.createDataFrame([(i,) for i in good], "doc_id long"), bits=22).collect()}
    want = plain_llr(rows, good, 22)
    for i, w in want.items():
        if w is None:
            assert got[i]["llr"] is None and got[i]["keep"] is False and got[i]["n_grams"] == 0
        else:
            # a few n-grams share a bucket
            assert got[i]["llr"] == pytest.approx(w, abs=2e-2)
            assert got[i]["keep"] == (got[i]["llr"] >= quality.THRESHOLD)
            assert got[i]["n_grams"] == len(plain_grams(dict(rows)[i]))


def test_quality_tells_junk_from_good(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {(r["quality"], r["toxic"]): r["kept"] for r in got}
    assert kept[1, 0] >= 0.98 and kept[0, 0] <= 0.1


def test_quality_stands_hard_rows(spark, hard, clashing, none):
    for df in (hard, clashing):
        assert sorted(r["doc_id"] or -1 for r in quality.quality(df, spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")).collect()) == sorted(i or -1 for i in IDS)
    no = spark.createDataFrame([], "doc_id long")
    assert {r["llr"] for r in quality.quality(hard, no).collect()} <= {0.0, None}
    assert quality.quality(none, no).count() == 0


def test_quality_counts_are_the_same_under_full_filters(spark):
    """Filters of one block pass nearly every id: what they leave open is joined, and the texts of the rest don't move."""
    rows = [(i, data.prose(i % 50, 4), None, None, None) for i in range(400)] + [(None, data.prose(1, 4), None, None, None), (3, data.prose(70, 2), None, None, None)]
    docs = spark.createDataFrame(rows, data.SCHEMA).repartition(3)
    good = docs.where("doc_id % 3 = 0").select("doc_id")
    sure, left_open = quality.trusted_texts(docs, good, 32)
    assert sure.count() == 402 and left_open.count() > 20
    assert sure.where("trusted").count() + left_open.count() == docs.where("doc_id % 3 = 0").count()
    assert "Join" not in quality.trusted_texts(docs, good)[0]._jdf.queryExecution().toString()
    assert (quality.fit(docs, good, filter_bytes=32) == quality.fit(docs, good)).all()


# --- BPE ---
@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(bpe.VOCABULARY).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    tokens = bpe.load()
    return bpe.Encoder(tokens, *bpe.splits(tokens))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_bpe_ids_are_exact(reference, encoder, text):
    text = text.encode("utf-8", "replace").decode()
    for latin in {False, not text or max(text) < "ɀ"}:
        assert encoder.encode([text], latin)[0].tolist() == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text("abeinrst", min_size=1, max_size=300))
def test_bpe_long_pieces_are_exact(reference, encoder, piece):
    assert encoder.piece(piece.encode()) == reference.encode_ordinary(piece)


def test_long_texts_are_encoded_by_parts(reference, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 50)
    text = data.prose(5, 60) + "  it's  " + "x" * 300 + "\n\n12 345 " + data.prose(6, 20, "de")
    assert len(list(encoder.parts(text))) > 20 and "".join(encoder.parts(text)) == text
    ids, first = encoder.encode([text, None, text], latin=True)
    assert ids[: first[1]].tolist() == reference.encode_ordinary(text) == ids[first[2] :].tolist()
    assert encoder.decode(ids[: first[1]])[0].tobytes().decode() == text
    parts = bpe.gathered(np.arange(50), np.array([3, 10, 40]), np.array([2, 0, 5]), np.array([2, 0, 1, 0]), 2)
    assert parts[0].tolist() == [40, 41, 42, 43, 44, 3, 4, 3, 4] and parts[1].tolist() == [0, 5, 7, 7, 9]


def test_bpe_over_a_table(spark, reference):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = bpe.encode(df).join(df.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == df.count()
    for r in rows:
        assert list(r["token_ids"]) == reference.encode_ordinary(r["text"]) and r["round_trip"] and r["n_tokens"] == len(r["token_ids"])


def test_bpe_stands_hard_rows(hard, clashing, none, reference):
    for df in (hard, clashing):
        rows = bpe.encode(df).collect()
        assert len(rows) == len(IDS) and all(r["round_trip"] for r in rows)
        back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).where("doc_id is not null").collect()}
        assert back == {r[0]: r[1] for r in data.hard_rows() if r[0] is not None}
        assert [(r["token_ids"], r["n_tokens"]) for r in rows if r["doc_id"] in (4, 5)].count((None, 0)) == 1
    assert bpe.encode(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0


def test_bpe_unknown_ids_give_null(spark):
    df = spark.createDataFrame([(1, [10**6]), (2, [None]), (3, []), (4, None)], "doc_id long, token_ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()} == {1: None, 2: None, 3: "", 4: None}


# --- language ---
def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    trained = langid.training_rows(df, "lang", langid.TRAIN_ROWS).select("doc_id").distinct()
    got = langid.identify(df).join(df.select("doc_id", "lang", "text"), "doc_id").join(trained, "doc_id", "left_anti").where("length(text) > 100")
    right, n, kept = got.agg(F.sum((F.col("language") == F.col("lang")).cast("int")), F.count(F.lit(1)), F.avg(F.col("accepted").cast("int"))).first()
    assert n > 5000 and right / n >= 0.97 and kept >= 0.99


def test_language_kernel_is_the_plain_one():
    texts = [data.prose(i, 3, lang) for i, lang in enumerate(["en", "de"] * 6)] + ["", "1 2", "Äb"]
    model = langid.fit_local(["en", "de"] * 6, texts[:12], 3)
    marks = texts[:6]

    def grams(t: str) -> set[bytes]:
        folded = b" " + re.sub(rb"[^a-z\x80-\xff]+", b" ", t.lower().encode()) + b" "
        return {folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)}

    known = set().union(*map(grams, marks))
    for t in texts:
        own = grams(t)
        seen, _, n = langid.Space(model.keys).presence(*ts.text_buffers(pa.array([t])))
        assert int(seen.sum()) == len(own & known) and n[0] == len(own)
        kernel = np.array([len(own & grams(m)) / math.sqrt(len(own) * len(grams(m))) for m in marks])
        got = model.score(*ts.text_buffers(pa.array([t])))[0][0]
        assert got == pytest.approx(kernel @ model.weights, abs=1e-4)


def test_language_of_long_texts_is_looked_up_by_pieces(monkeypatch):
    texts = [data.prose(i, 3, lang) for i, lang in enumerate(["en", "de"] * 6)]
    model = langid.fit_local(["en", "de"] * 6, texts, 3)
    long = data.prose(77, 60, "de") + "  Ωmega日本 " + data.prose(78, 20) + " 12 "
    buf, offsets = ts.text_buffers(pa.array([long]))
    whole = model.score(buf, offsets)
    for piece in (50, 333):
        monkeypatch.setattr(ts, "PIECE", piece)
        scores, share, n = model.score(buf, offsets)
        # the words that pieces share count twice in the share
        assert np.allclose(scores, whole[0], atol=1e-6) and n[0] == whole[2][0] and share[0] == pytest.approx(whole[1][0], abs=0.05)


def test_language_rejects_neighbours_of_known_languages(spark):
    """Sentences of languages without training rows, related to those that have some, at any length."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = [
        "De snelle bruine vos springt over de luie hond en loopt daarna naar huis om te slapen.", "Il cane corre nel parco e poi torna a casa per mangiare con tutta la famiglia.",
        "Questa mattina siamo andati al mercato per comprare frutta e verdura fresca.", "Szybki brązowy lis przeskakuje nad leniwym psem i biegnie do lasu.", "Hızlı kahverengi tilki tembel köpeğin üzerinden atlar ve ormana koşar.",
    ]
    odd = spark.createDataFrame([(-1 - i, t * k, None) for i, (t, k) in enumerate((t, k) for t in foreign for k in (1, 9))], "doc_id long, text string, lang string")
    assert langid.identify(docs.unionByName(odd)).where("doc_id < 0 and accepted").count() == 0


def test_language_fit_is_bounded(spark):
    rows = [(i, "ein kurzer text " * 3, "de") for i in range(5)] + [(9, "langer text " * 20_000, "de")]
    got = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", 10).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="labels"):
        langid.fit_local([f"l{i}" for i in range(langid.MAX_LANGUAGES + 1)], ["some text"] * (langid.MAX_LANGUAGES + 1))


def test_language_stands_hard_rows(spark, hard, clashing, none):
    rows = {r["doc_id"]: r for r in langid.identify(hard).collect() if r["doc_id"] is not None}
    for i in (4, 5, 6, 8):
        assert rows[i]["language"] is None and rows[i]["score"] is None and not rows[i]["accepted"]
    assert rows[1]["language"] == "en" and rows[11]["language"] == "de"
    assert rows[1]["accepted"] and rows[11]["accepted"]
    kept = langid.keep_identified(clashing, label="c0")
    assert kept.columns == clashing.columns and kept.count() == sum(r["accepted"] for r in langid.identify(clashing, label="c0").collect())
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0
    unlabelled = hard.withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(unlabelled).where("accepted or language is not null").count() == 0


def test_language_rejects_what_it_does_not_know(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "Все люди рождаются свободными и равными в своем достоинстве. " * 9, None), (-2, base64.b64encode(np.random.RandomState(0).bytes(3000)).decode(), None)], "doc_id long, text string, lang string")
    assert langid.identify(docs.unionByName(odd)).where("doc_id < 0 and accepted").count() == 0


# --- personal data ---
KEY = b"a key for tests"
VALUES = {
    "email": ["anna.berg@example.com", "x-1@mail.example.org"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
    "date": ["1984-02-29", "31/12/1999", "7.4.2001", "12/31/1999", "0001-01-01"],
    "ipv4": ["192.168.0.1", "8.8.8.8"],
    "ssn": ["123-45-6789", "899-99-9999", "667-01-0001"],
    "phone": ["+49 30 1234 5678", "(555) 123-4567", "555-123-4567"],
    "card": ["4111 1111 1111 1111", "5500005555555559"],
    "secret": ["9f86d081884c7d659a2feaa0c55ad015", "A94A8FE5CCB19BA61C4C0873D391E987982FBBD3"],
}


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_pseudonyms_keep_their_format_and_go_back(kind, value):
    new = pii.pseudonym(kind, value, KEY)
    back = pii.reveal_value(kind, new, KEY)
    # a date's pseudonym may need both digits where the date didn't, so leading zeros aren't kept
    assert new != value and (back == value or kind == "date" and re.sub(r"\b0", "", back) == value)
    assert pii.pseudonym(kind, new, KEY) != new, "a pseudonym must be a valid value again"
    assert pii.pseudonym(kind, value, b"other") != new
    if kind != "date" and kind != "ipv4":
        assert re.sub(r"[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))).translate(str.maketrans("aA", "00")) == re.sub(r"[0-9a-zA-Z]", "0", value)
    text = f"Write to {value}, or not."
    out, n = pii.replace(text, KEY)
    assert n == 1 and value not in out and new in out


@pytest.mark.parametrize("text", ["31/02/1999 1999-13-01", "999.1.1.1", "4111 1111 1111 1112", "DE00370400440532013000", "000-12-3456", "version 1.2.3", "no numbers at all", "1234567"])
def test_invalid_values_stay(text):
    assert pii.replace(text, KEY) == (text, 0)


@pytest.mark.parametrize(
    ("before", "card", "after"),
    [
        ("", "4111 1111 1111 1111", " 12/27"),
        ("", "4111111111111111", " 123"),
        ("order 12 ", "4111 1111 1111 1111", ""),
        ("order 12-", "4111-1111-1111-1111", ""),
        ("", "4111-1111-1111-1111", "-2024"),
        ("no. 7 ", "3782 822463 10005", " 12 27"),
        ("ref +12 ", "4111 1111 1111 1111", ", paid"),
        ("ref AB12 ", "4111 1111 1111 1111", " paid"),
        ("9 9 9 ", "4111 1111 1111 1111", " 8 8 8 8"),
    ],
)
def test_cards_beside_other_numbers_are_found(before, card, after):
    assert pii.replace(before + card + after, KEY) == (before + pii.pseudonym("card", card, KEY) + after, 1)


def test_values_beside_other_numbers_are_found():
    two = "4111-1111-1111-1111-5500-0000-0000-0004"
    assert pii.replace(two, KEY) == (pii.pseudonym("card", two[:19], KEY) + "-" + pii.pseudonym("card", two[20:], KEY), 2)
    for kind, value in (("iban", "BE68 5390 0754 7034"), ("phone", "+49 30 1234 5678")):
        assert pii.replace(f"{value} 2025 2026 2027", KEY) == (f"{pii.pseudonym(kind, value, KEY)} 2025 2026 2027", 1)


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 5000), st.integers(0, 10**6))
def test_permutation(size, seed):
    key = str(seed).encode()
    x = seed % size
    y = pii.permute(x, size, key, "t")
    assert 0 <= y < size and pii.permute(y, size, key, "t", back=True) == x
    if size < 200:
        assert sorted(pii.permute(i, size, key, "t") for i in range(size)) == list(range(size))


def test_equal_values_stay_linked(spark):
    df = spark.createDataFrame([(i, f"Card 4111 1111 1111 1111 of anna@example.com, {i}.") for i in range(20)], "doc_id long, text string").repartition(4)
    found = {re.search(r"Card ([0-9 ]+) of (\S+),", r["text"]).groups() for r in pii.pseudonymise(df).collect()}
    assert len(found) == 1


def test_every_byte_of_the_key_counts():
    long = b"k" * 64
    assert pii.pseudonym("ssn", "123-45-6789", long + b"a") != pii.pseudonym("ssn", "123-45-6789", long + b"b")


def test_the_key_comes_from_call_setting_or_application(spark):
    df = spark.createDataFrame([(1, "a@example.com 123-45-6789")], "doc_id long, text string")
    got = lambda *key: pii.pseudonymise(df, *key).first()["text"]
    drawn = got()
    assert drawn == got() != got(b"mine")
    spark.conf.set(pii.SETTING, "mine")
    try:
        assert got() == got(b"mine")
    finally:
        spark.conf.unset(pii.SETTING)
    with pytest.raises(ValueError, match="empty"):
        pii.session_key(spark, b"")


def test_phone_numbers_with_and_without_their_country_are_linked():
    digits = lambda t: re.sub(r"\D", "", pii.replace(t, KEY)[0])[-10:]
    assert digits("+1 (555) 234-5678") == digits("555-234-5678") == digits("(555) 234 5678") != "5552345678"
    assert digits("+44 5552345678") != digits("555-234-5678")


def plain_values(text: str) -> set[str]:
    """Personal values by their own rules, token by token: not the operator's patterns."""
    found = set()
    tokens = [t.strip(".,;:!?()[]\"'") for t in text.split()]
    for i, t in enumerate(tokens):
        local, at, domain = t.partition("@")
        if at and local and domain.count(".") and domain.replace(".", "").replace("-", "").isalnum() and domain.rsplit(".", 1)[1].isalpha():
            found.add(t)
        parts = t.split(".")
        if len(parts) == 4 and all(p.isdigit() and int(p) < 256 and p == str(int(p)) for p in parts):
            found.add(t)
        parts = t.split("-")
        if [len(p) for p in parts] == [3, 2, 4] and all(p.isdigit() for p in parts) and parts[0] not in ("000", "666") and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000":
            found.add(t)
        for n in (1, 4):
            digits = "".join(tokens[i : i + n])
            if len(digits) == 16 and digits.isdigit() and all(len(x) == 16 // n for x in tokens[i : i + n]) and sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(digits)) % 10 == 0:
                found.add(" ".join(tokens[i : i + n]))
    return found


def test_pii_finds_what_a_plain_detector_finds(spark):
    """Over a table with planted values beside numbers and words: no value of the plain detector is left, what isn't a value is, and the format is kept."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = ["card 4111 1111 1111 1111 12/27", "card 4111111111111111 123", "iban BE68 5390 0754 7034 PAID", "iban DE89370400440532013000, paid", "mail anna.berg@example.com now", "host 10.20.30.40 up", "ssn 123-45-6789 and 5500 0055 5555 5559", "9f86d081884c7d659a2feaa0c55ad015 key"]
    df = df.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(planted)], "doc_id long, text string"))
    before = {r["doc_id"]: r["text"] for r in df.collect()}
    after = {r["doc_id"]: r for r in pii.report(df, KEY).collect()}
    shape = lambda t: re.sub("[^\\W_]", "x", t)
    seen = 0
    for i, t in before.items():
        out = after[i]["text"]
        values = plain_values(t)
        seen += len(values)
        assert not any(re.search(rf"(?<![\w.-]){re.escape(v)}(?![\w-])", out) for v in values), (i, values)
        if not re.search("[0-9@]", t):
            assert out == t
        # letters and digits are replaced in place; only dates and addresses change their length
        assert shape(out) == shape(t) or re.search(r"\d[./]\d", t)
        assert (after[i]["n_replaced"] > 0) == (out != t)
    assert seen > 50
    assert all(after[-1 - i]["n_replaced"] == (2 if "and 5500" in t else 1) for i, t in enumerate(planted))
    assert after[-3]["text"].endswith(" PAID") and after[-1]["text"].endswith(" 12/27")


def test_pii_stands_hard_rows(hard, clashing, none):
    for df in (hard, clashing):
        out = pii.pseudonymise(df)
        assert out.columns == df.columns and out.count() == len(IDS)
        assert pii.report(df).where("text is null").count() == 2
    assert pii.report(none).count() == 0 and pii.pseudonymise(none).count() == 0
