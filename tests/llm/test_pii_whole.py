"""Names mentioned again, compressed addresses, and spellings of one value."""

from __future__ import annotations

import re

import pytest

from breakline.llm import pii_surrogates
from breakline.llm.pii_surrogates import Keyed, replace


def test_later_and_earlier_mentions_of_a_name():
    text, said = replace("WEBER, Weber's: My name is Alice Weber. Later Alice Weber wrote; so did Alice, Webern and Dr. Anne-Marie Lovelace. Marie left.", Keyed())
    assert not re.search("alice|weber\\b|marie|lovelace", text, re.I) and "Webern" in text
    new = dict((o, n) for _, o, n in said)
    given, family = new["Alice Weber"].split(" ")
    assert text.count(f"{given} {family}") == 2 and new["Alice"] == given and new["Weber"] == family and new["WEBER"] == family.upper()


@pytest.mark.parametrize("address", ["2001:db8::1", "fe80::1", "::1", "2001:db8::", "2001:DB8:0:0:8:800:200C:417A", "1:2:3:4:5:6::8", "dead::beef"])
def test_compressed_ip6(address):
    text, said = replace(f"from {address}, today", Keyed())
    assert [(k, o) for k, o, _ in said] == [("ip6", address)] and re.sub("[0-9A-Fa-f]", "x", said[0][2]) == re.sub("[0-9A-Fa-f]", "x", address)


@pytest.mark.parametrize("text", ["std::vector x::y", "at :: or a :: b"])
def test_not_ip6(text):
    assert replace(text, Keyed())[0] == text


def test_spellings_stay_distinct(spark):
    same = ["1.0.0.1 1.0.0.01 01.0.0.1 1.00.0.1", "2001:0db8:0:0:0:0:0:1 2001:0DB8:0:0:0:0:0:1 2001:db8:0:0:0:0:0:1 2001:Db8:0a:0:0:0:0:1 2001:db8:0A:0:0:0:0:1", "Mr Anna, Mr AnnA, Mr ANNA, Mr AnNa"]
    for text in same:
        _, said = replace(text, Keyed())
        assert len({o for _, o, _ in said}) == len({n for _, _, n in said}) >= 4
    df = spark.createDataFrame([(i, w) for i, w in enumerate(", ".join(same).replace(", ", " | ").replace(" 1", " | 1").replace(" 2", " | 2").split(" | "))], "doc_id long, text string")
    assert pii_surrogates.collisions(df).count() == 0 and pii_surrogates.surrogate_map(df).count() >= 12


def test_small_formats_are_one_to_one():
    k = Keyed()
    for all_of in ([f"0{a}.0{b}.0{c}.01" for a in range(10) for b in range(10) for c in range(10)], [f"::{a}{b}" for a in "09afAF" for b in "0123456789abcdefABCDEF"]):
        kind = "ip" if "." in all_of[0] else "ip6"
        assert len({k.surrogate(kind, x) for x in all_of}) == len(all_of)


@pytest.mark.parametrize("text", [
    "On 2024-01-15 we met, 1999-12-31 too", "12.04.2023 and 10 000 000 units", "versions 3.11.2 and 10.2024.100.7", "in 1939 - 1945 or 2010-2024", "3 500 000 of 12 000", "pages 100-200 300-400",
    "at 1700000000000 ms", "ISBN 978-3-16-148410-0", "10:30 to 12:45", "call me in 2024 or 2025",
])
def test_dates_and_numbers_stay(text):
    assert replace(text, Keyed()) == (text, [])


@pytest.mark.parametrize("text, phone", [
    ("or 212-555-0147.", "212-555-0147"), ("Tel. 030 1234567, Berlin", "030 1234567"), ("call 555-0147 now", "555-0147"), ("x 0049 30 901820 y", "0049 30 901820"), ("a +49 30 901820 b", "+49 30 901820"), ("(030) 901 8200", "(030) 901 8200"), ("mobile: 01701234567", "01701234567"), ("555.123.4567", "555.123.4567"),
])
def test_phones(text, phone):
    assert [(k, o) for k, o, _ in replace(text, Keyed())[1]] == [("phone", phone)]


@pytest.mark.parametrize("text", ["Mr. Anna met Mrs. AnNa today.", "Dear Mrs. Anna Petrova, hello. Petrova replied. Anna left.", "Mr. Rajesh Gupta and Frau Xu Li, Dr. O'Neil", "Mr. ۱۲, +٤٩ ٣٠ 901820 ²³"])
def test_nothing_raises_and_mentions_go(text):
    new, said = replace(text, Keyed())
    for _, original, surrogate in said:
        assert original != surrogate and not re.search(rf"(?<!\w){re.escape(original)}(?!\w)", new)
        assert original[-1] == surrogate[-1] or original.lower() in pii_surrogates._GIVEN_AT or original.split(" ")[-1].lower() in pii_surrogates._GIVEN_AT
    if "Petrova" in text:
        assert len(said) == 3 and said[0][2].split(" ") == [said[2][2], said[1][2]]


def test_nothing_stays_where_it_is():
    k = Keyed()
    for size in (2, 3, 5, 11, 100, 4097):
        got = [k.permute(i, size, "t") for i in range(size)]
        assert sorted(got) == list(range(size)) and all(i != x for i, x in enumerate(got))


def test_whole_table(spark):
    """Every finding of every document is replaced, all between them stays, and no surrogate stands for two originals."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: r for r in pii_surrogates.pii_report(docs).collect()}
    changed = 0
    for r in docs.collect():
        if r.text is None:
            assert new[r.doc_id].text is None
            continue
        found, at, out = pii_surrogates.find(r.text), 0, []
        for a, b, _ in found:
            out.append(re.escape(r.text[at:a]) + "(.+?)")
            at = b
        assert new[r.doc_id].n_entities == len(found)
        m = re.fullmatch("".join(out) + re.escape(r.text[at:]), new[r.doc_id].text, re.S)
        assert m and all(g != r.text[a:b] for g, (a, b, _) in zip(m.groups(), found, strict=True))
        changed += bool(found)
    assert changed > 20 and pii_surrogates.collisions(docs).count() == 0


def test_long_texts_take_time_in_proportion():
    import time

    took = []
    for n in (4_000, 16_000):
        text = "so it is said by a.b@c.example.com and others at 10.1.2.3 " * n
        t = time.perf_counter()
        assert len(pii_surrogates.find(text)) == 2 * n
        took.append(time.perf_counter() - t)
    assert took[1] < 8 * took[0]
