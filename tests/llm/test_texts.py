"""Personal information, splitting and language."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.llm import language, pii, splitting

GIVEN, SUR = ["Anna", "Luca", "Rose"], [p + s for p in ("Holv", "Keld", "Skov", "Tolv", "Ulv") for s in ("mar", "edale", "holtz", "oux", "orio")] + ["Grimvoux", "Grimvorio", "Grimvmar"]
CASES = [
    ("Write to a.b+c@Ex.org or x (at) mail (dot) example.", {("EMAIL", "a.b+c@Ex.org"), ("EMAIL", "x (at) mail (dot) example")}),
    ("y[at]docs.example.org, z @ ex.net", {("EMAIL", "y[at]docs.example.org"), ("EMAIL", "z @ ex.net")}),
    ("Mention @Someone in the channel.", set()),
    ("Call +44 20 7946 0144 or (202) 555-0175 or 1-312-555-0199 ext. 20.", {("PHONE", "+44 20 7946 0144"), ("PHONE", "(202) 555-0175"), ("PHONE", "1-312-555-0199 ext. 20")}),
    ("030/23125870, 06.39.98.61.35, 6175550112", {("PHONE", "030/23125870"), ("PHONE", "06.39.98.61.35"), ("PHONE", "6175550112")}),
    ("Part 947-20-4490 and batch 1209 3177, serial SN57312133, order 2038, 2024-01-02. 37 pages", set()),
    ("my identity number is 978-35-3382. Your form: we received your form (QP5987217).", {("IDENTITY", "978-35-3382"), ("IDENTITY", "QP5987217")}),
    ("meine Ausweisnummer lautet 03 158 447 295.", {("IDENTITY", "03 158 447 295")}),
    ("Send it to 120 Falken Lane, 00565 Villaseca before Friday. 13 Street signs came.", {("ADDRESS", "120 Falken Lane, 00565 Villaseca")}),
    ("wohnhaft Merisierstraße 11, Grauwik. Der Rest", {("ADDRESS", "Merisierstraße 11, Grauwik")}),
    ("au 33 bis impasse Pradillo. en C/ Varenne 92, 2º B, Estrada", {("ADDRESS", "33 bis impasse Pradillo"), ("ADDRESS", "C/ Varenne 92, 2º B, Estrada")}),
    ("Present: Anna Holvmar, Luca Keldedale and R. Skovoux.", {("NAME", "Anna Holvmar"), ("NAME", "Luca Keldedale"), ("NAME", "R. Skovoux")}),
    ("Dear Holvmar, Anna, and Dr. Nadia Grimvedale", {("NAME", "Holvmar, Anna"), ("NAME", "Nadia Grimvedale")}),
    ("ANNA HOLVMAR-KELDOUX sat in the Rose hall. M. Luca Ulvorio", {("NAME", "Luca Ulvorio")}),
    ("My name is Berta Unknown.", {("NAME", "Berta Unknown")}),
    ("", set()), (None, set()), (" \n ", set()), ("@ 1 + (at) dot", set()),
]


def names(spark):
    return spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "surname") for n in SUR] + [(None, "given"), ("Anna", "given")], "name string, kind string")


def records(spark):
    rows = [("t", str(i), t) for i, (t, _) in enumerate(CASES)]
    return spark.createDataFrame(rows + rows[:2], "record_table string, record_id string, content string").withColumn("pii_value", F.lit("clash"))


def test_pii(spark):
    got = {}
    for r in pii.find_pii(records(spark), names(spark)).collect():
        got.setdefault(int(r.record_id), set()).add((r.entity_type, r.pii_value))
    for i, (text, want) in enumerate(CASES):
        if i == 13:
            assert want <= got[i] and any(v.startswith("ANNA HOLVMAR") for _, v in got[i])
        else:
            assert got.get(i, set()) == want, text


def test_redaction_keeps_the_rest(spark):
    rows = {r.record_id: r.content for r in pii.redact_pii(records(spark), names(spark)).collect()}
    assert rows["0"] == "Write to [EMAIL] or [EMAIL]." and rows["16"] is None and rows["5"] == CASES[5][0]
    long = "filler " * 200_000 + "anna@ex.org"
    one = spark.createDataFrame([("t", "1", long)], "record_table string, record_id string, content string")
    assert pii.redact_pii(one, names(spark)).first().content == "filler " * 200_000 + "[EMAIL]"
    assert pii.find_pii(one.limit(0), names(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        pii._names(names(spark), most=3)


def pieces_hold(text, limit=1000, overlap=200):
    p = splitting.pieces(text, limit, overlap, 300 if limit == 1000 else 10)
    assert "".join(text[s:e] for _, s, e in p) == text
    assert all(e - a <= limit and 0 <= s - a <= overlap for a, s, e in p)
    return p


def test_split_round_trip():
    rng = np.random.default_rng(2)
    words = ["alpha", "beta.", "gamma,", "delta\n", "ε", "👍🏽", "é"]
    for n in (0, 5, 300, 5000):
        pieces_hold(" ".join(words[i] for i in rng.integers(0, len(words), n)))
    assert len(pieces_hold("x" * 2501)) > 2 and len(pieces_hold(" " * 1001)) > 1 and len(pieces_hold("a" * 1000)) == 1
    pieces_hold("short text. " * 30, 100, 20)


def test_edits_move_only_near_cuts():
    rng = np.random.default_rng(4)
    text = " ".join(f"Word{i} says thing{j}." for i, j in rng.integers(0, 1000, (600, 2)))
    edited = text[:5000] + "An inserted sentence. " + text[5000:]
    a = {text[s:e] for _, s, e in splitting.pieces(text)}
    b = {edited[s:e] for _, s, e in splitting.pieces(edited)}
    assert len(a - b) <= 4 and len(a) > 12


def test_split_table(spark):
    rows = [(1, "a. " * 500, "H", 3), (1, "a. " * 500, "H", 3), (2, "b" * 1000, None, None), (3, None, None, None), (None, "c " * 600, None, None), (4, "", None, None)]
    df = spark.createDataFrame(rows, "id bigint, content string, section_header string, page_number int").withColumn("piece_no", F.lit(9))
    out = splitting.split_oversized(df)
    assert {r.chunk_id for r in splitting.oversized_ids(df).collect()} == {1}
    one = out.where("chunk_id = 1").orderBy("piece_no").collect()
    assert all(r.section_header == "H" and r.page_number == 3 for r in one) and [r.piece_no for r in one] == list(range(len(one)))
    assert "".join(r.content[r.core_char - r.start_char :] for r in one) == "a. " * 500
    assert out.where("chunk_id is null").count() > 1 and splitting.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, limit=100, overlap=100)


EN = ["The working group checks the invoice under the current terms.", "Please see the report on the storage unit and the contract.", "The data sheet was filed with the archive team before the review."]
DE = ["Die Arbeitsgruppe prüft die Rechnung zu den geltenden Bedingungen.", "Bitte lesen Sie den Bericht über das Lager und den Vertrag.", "Das Datenblatt wurde vor der Prüfung im Archiv abgelegt."]


def test_language_segments(spark):
    rows = [(i, " ".join(EN), "en") for i in range(40)] + [(100 + i, " ".join(DE), "de_AT") for i in range(40)]
    rows += [(200, "\n".join(EN * 3 + DE * 3), "en"), (201, " ".join(DE), "EN"), (202, " ".join(EN), None), (203, None, "en"), (204, "", "en"), (205, "123 --- 4", None), (206, " ".join(EN), "en-GB"), (206, " ".join(EN), "en-GB"), (None, "x", "en"), (207, "| a | 1 |\n" * 3 + " ".join(DE), "und")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("lang_code", F.lit("clash"))
    got = {}
    for r in language.label_faults(df).collect():
        got.setdefault(r.doc_id, {})[r.segment_no] = r.lang_code
    assert got == {200: {0: "en", 1: "de"}, 201: {0: "de"}, 202: {0: "en"}, 207: {0: "de"}}
    segs = language.language_segments(df).where("doc_id = 200").orderBy("segment_no").collect()
    assert all(0.5 < r.confidence <= 1 for r in segs) and segs[0].end_char <= segs[1].start_char
    assert language.label_faults(df.limit(0)).count() == 0
    assert language.label_faults(df.withColumn("lang", F.lit("??"))).count() == 0


def test_grams_do_not_cross_pieces():
    idx, starts = language.grams(["ab", "", "ab", "a\nb"])
    n = np.diff(starts)
    assert n[0] == n[2] and n[1] == 0 and (idx[starts[0] : starts[1]] == idx[starts[2] : starts[3]]).all()


def test_held_out_accuracy():
    rng = np.random.default_rng(0)
    en, de = "the of and to in is was for report unit team under with".split(), "der die das und zu ist war für bericht unter mit nicht".split()
    make = lambda ws: " ".join(rng.choice(ws, 8))
    texts = [make(en) for _ in range(150)] + [make(de) for _ in range(150)]
    y = np.array([0] * 150 + [2] * 150)
    y[:6] = 2  # wrong labels
    m = language.train(texts, y, np.ones(language.BUCKETS), language.Settings())
    test = [make(en) for _ in range(50)] + [make(de) for _ in range(50)]
    assert (m.log_probs(test).argmax(1) == np.array([0] * 50 + [2] * 50)).mean() > 0.97


def test_too_many_surname_combinations_raise():
    names = [a + b for a in ("Brandt", "Kessel", "Lindor", "Moraal", "Ostner", "Wittek") for b in ("mann", "heim", "stein", "feld")]
    assert set(names) <= pii.surnames_of(names)
    with pytest.raises(ValueError):
        pii.surnames_of(names, most=3)


def test_free_sentences():
    finder = pii.Finder(["John"], ["Smith"])

    def values(text):
        return [(pii.TYPES[k], text[s:e]) for k, s, e in finder.spans(text)]

    long = "a" * 80
    assert values(f"write to {long}@mail.example now") == [("EMAIL", f"{long}@mail.example")]
    assert values("see https://bob:pw@host.example for it") == [] and values("mailto:bob@host.example") == [("EMAIL", "bob@host.example")]
    assert values("IBAN DE89 3704 0044 0532 0130 00 is the account") == [] and values("card 4111 1111 1111 1111 was used") == []
    assert ("IDENTITY", "12-3456789") in values("The tax ID number 12-3456789 is on file.")
    assert values("Ihr Antrag (09 014 396 752) liegt vor") == [("IDENTITY", "09 014 396 752")] and values("The pallet (09 014 396 752) is here") == []
    assert values("call +49 30 1234567 today") == [("PHONE", "+49 30 1234567")]
    assert pii.iban_valid("DE89 3704 0044 0532 0130 00") and not pii.iban_valid("DE88 3704 0044 0532 0130 00") and pii.card_valid("4111 1111 1111 1111")


def test_plain_letters_are_those_of_the_regular_expression():
    pieces = ["Unter den x1 a/b c_d Linden.", "", "𝔘nter 𝟘 ab²c", "a\0b\nc", "\ud800abc/", "été/ ΟΔΟΣ"]
    want = [len("".join(re.findall(r"(?<![\w/])[^\W\d_]+(?![\w/])", x))) for x in pieces]
    assert language.plain_letters(pieces).tolist() == want and language.plain_letters([]).tolist() == []


def test_runs_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 9, 60)
    held = np.abs(rng.normal(0, 6, (counts.sum(), 6)))
    got = np.split(language.runs(held, 6.0, counts), np.cumsum(counts)[:-1])
    ends = np.cumsum(counts)
    for k, n in enumerate(counts):
        one = held[ends[k] - n : ends[k]]
        best, back = -one[:1].sum(0), []
        for row in one[1:]:
            move = best[:, None] - 6.0 * (1 - np.eye(6))
            back.append(move.argmax(0))
            best = move.max(0) - row
        y = int(best.argmax())
        path = [y] if n else []
        for b in reversed(back):
            y = int(b[y])
            path.append(y)
        assert got[k].tolist() == path[::-1]


def test_frequencies_of_short_texts_need_little_memory():
    # A matrix of texts by n-grams would have 131 MB.
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", "ab ab", "b"] * 667)], names=["text"])
    tracemalloc.start()
    (got,) = language._frequencies(language.Settings())(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32_000_000
    idx, starts = language.grams(["ab", "ab ab", "b"])
    want = np.bincount(np.concatenate([np.unique(idx[a:b]) for a, b in zip(starts, starts[1:])])) * 667
    df = dict(zip(*(c.to_pylist() for c in got.columns)))
    assert df.pop(-1) == 2001 and df == {int(k): int(want[k]) for k in np.flatnonzero(want)}
