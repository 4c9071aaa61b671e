import datetime
import re

import pytest

from tripleloom.llm.feistel import TRIAL_KEY, Permutation, luhn, pseudonymise, replace

TEXT = ("Mail Ann.Lee7@mail6.example.com, ANN.LEE7@MAIL6.EXAMPLE.COM!! call +1 (017) 555-7713, from 7.51.17.173. "
        "card 4111 1111 1111 1111 or 4111111111111111 on 2021-03-04 and 04/03/2021, 12/31/1999; "
        "DE89 3704 0044 0532 0130 00 ssn 219-09-9999 token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"")
CLEAN = ("4111111111111112 999.1.2.3 1.2.3 2021-13-04 31.02.2020 000-12-3456 DE88370400440532013000 a@b +1 22 "
         "1111111111111111 3.1415926535 version 2.0. 12345678901234567890123")


@pytest.mark.parametrize("bound", [2, 3, 10, 97, 1000])
def test_permutation_is_one_to_one(bound):
    there, back = Permutation(b"k"), Permutation(b"k", undo=True)
    image = [there(v, bound, "t") for v in range(bound)]
    assert sorted(image) == list(range(bound))
    assert [back(v, bound, "t") for v in image] == list(range(bound))


def test_round_trip_of_large_ranges():
    there, back = Permutation(b"k"), Permutation(b"k", undo=True)
    for bound in (10**15, 2**32, 26**40, 16**64):
        for v in (0, 1, bound // 3, bound - 1):
            assert back(there(v, bound, "x"), bound, "x") == v
    assert there(5, 10**15, "x") != Permutation(b"other")(5, 10**15, "x")


def test_formats_links_and_round_trip():
    new, found = replace(TEXT, Permutation(TRIAL_KEY))
    assert found == {"email": 2, "phone": 1, "ip": 1, "card": 2, "date": 3, "iban": 1, "ssn": 1, "key": 1}
    assert replace(new, Permutation(TRIAL_KEY, undo=True)) == (TEXT, found)
    low, high = re.findall(r"\S+@\S+m\b", new, re.I)
    assert low.lower() == high.lower() and low != high and high.isupper()
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"card ([\d ]+) or (\d+)", new)[0]]
    assert cards[0] == cards[1] and luhn(cards[0][:-1]) == int(cards[0][-1]) and cards[0] != "4111111111111111"
    iso, day, month = re.findall(r"on (\S+) and (\S+), (\S+);", new)[0]
    assert datetime.date.fromisoformat(iso) == datetime.datetime.strptime(day, "%d/%m/%Y").date()
    assert datetime.datetime.strptime(month, "%m/%d/%Y").day > 12
    for value in ("Ann", "017", "7713", "7.51.17.173", "2021-03-04", "0532", "219-09", "9233A8EC"):
        assert value not in new
    assert re.sub(r"[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new)))[:60] == \
        re.sub(r"[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", TEXT)))[:60]


def test_what_fails_validation_stays():
    assert replace(CLEAN, Permutation(TRIAL_KEY)) == (CLEAN, {})


@pytest.mark.parametrize("kind,value,text", [
    ("card", "4111 1111 1111 1111", "4111 1111 1111 1111 123"), ("card", "4111 1111 1111 1111", "4111 1111 1111 1111 12/27"),
    ("card", "4111111111111111", "4111111111111111 5 times"), ("card", "4111 1111 1111 1111", "no 12 4111 1111 1111 1111 x"),
    ("card", "3782 822463 10005", "3782 822463 10005 1234"), ("card", "4111-1111-1111-1111", "4111-1111-1111-1111 999"),
    ("iban", "ES91 2100 0418 4502 0005 1332", "IBAN ES91 2100 0418 4502 0005 1332 BIC"),
    ("iban", "BE68539007547034", "BE68539007547034 BIC"), ("iban", "BE68 5390 0754 7034", "BE68 5390 0754 7034 BELGIUM NR 5"),
    ("iban", "BE68 5390 0754 7034", "NR12 ABCD BE68 5390 0754 7034"), ("ssn", "219-09-9999", "1234 219-09-9999"),
    ("phone", "+49 30 1234 5678", "+49 30 1234 5678 9012 1234"), ("card", "4111111111111111", "+1 22 4111111111111111"),
    ("card", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 123")])
def test_values_beside_other_words(kind, value, text):
    for key in range(30):
        new, found = replace(text, Permutation(b"%d" % key))
        assert found == {kind: 1} and value not in new
        left, right = text.split(value)
        assert new.startswith(left) and new.endswith(right) and len(new) == len(text)
        assert replace(new, Permutation(b"%d" % key, undo=True)) == (text, found)


def test_what_follows_a_card_does_not_change_its_pseudonym():
    alone = replace("4111 1111 1111 1111", Permutation(TRIAL_KEY))[0]
    for n in range(200):
        assert replace(f"4111 1111 1111 1111 {n}", Permutation(TRIAL_KEY))[0] == f"{alone} {n}"
    two = "4111 1111 1111 1111 123 5500 0000 0000 0004 321"
    assert replace(two, Permutation(TRIAL_KEY))[1] == {"card": 2}


def test_long_texts_stay_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1-" * 200_000, "a." * 200_000 + "@", "1 " * 200_000):
        replace(text + " 1@", Permutation(TRIAL_KEY))


def test_rows(spark):
    rows = [(1, TEXT, "x", 5), (2, TEXT, "y", 6), (3, None, "z", 7), (4, "", None, 8), (None, CLEAN, "n", 9), (1, TEXT, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email string, n_ip int").repartition(2)
    made = pseudonymise(docs, TRIAL_KEY, carry=("n_email",))
    got = {r[0]: r for r in made.collect()}
    assert got[1].text == got[2].text and got[1].n_replaced == 12 and got[3].text is None and got[4].text == ""
    assert got[None].text == CLEAN and got[None].n_replaced == 0 and got[2][1] == "y"
    back = pseudonymise(made.select("doc_id", "text"), TRIAL_KEY, undo=True)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r[0], r[1]) for r in rows}
    assert pseudonymise(docs.limit(0), TRIAL_KEY).collect() == []


def test_documents_come_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = pseudonymise(docs, TRIAL_KEY)
    assert made.where("n_replaced > 0").count() > 50
    back = pseudonymise(made.select("doc_id", "text"), TRIAL_KEY, undo=True).select("doc_id", "text")
    assert back.exceptAll(docs.select("doc_id", "text")).isEmpty()
