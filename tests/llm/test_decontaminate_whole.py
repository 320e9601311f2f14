"""What re-parameterised, verbatim and partly altered copies of benchmark items need to be found."""

from __future__ import annotations

import pytest

from breakline.llm import decontaminate

SOLD = "Tom has 12 apples. Tom buys 7 more and gives 3 to Anna. How many apples does Tom have?"
TRAIN = "The train from Berlin to Munich takes 4 hours and the one to Vienna takes 7 hours, so Clara waits."
LONG = "In 1990 the " + " ".join(f"{a}{b}" for a in ("mo", "lu", "ke", "ra", "ti") for b in ("bak", "dun", "fel", "gor", "hin", "jas", "kip", "lod")) + " came to an end, though 1990 was " + " ".join(f"so{b}" for b in ("bak", "dun", "fel", "gor"))


def found(spark, item, text):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "quite another text with 5 apples and nothing else to be found in it")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leak_report(docs, bench).collect()} <= {(1, 1)}
    return decontaminate.leak_report(docs, bench).count() == 1


@pytest.mark.parametrize("text", [SOLD.replace("Tom", "Peter").replace("Anna", "Olga").replace("12", "31").replace("7", "9").replace("3 ", "8 "), "»" + SOLD.replace("Tom", "Hugo").replace(" 12", "  15") + "«"])
def test_names_that_open_sentences(spark, text):
    assert found(spark, SOLD, "They asked: " + text + " Then they left.")


@pytest.mark.parametrize("item, text", [(TRAIN, TRAIN.lower()), (TRAIN, TRAIN.replace(" ", "\n")), (TRAIN, TRAIN.upper()), ("What is the capital of France?", "he asked what is the capital of france, again"), ("What is the capital of France?", "so What is the capital of France? she asked"), ("Name three primes.", "please name  three\nprimes now")])
def test_verbatim_and_short_items(spark, item, text):
    assert found(spark, item, text)


def test_short_items_need_all_tokens_in_order(spark):
    assert not found(spark, "Name three primes.", "three primes have a name")


def test_one_altered_slot_costs_its_windows_alone(spark):
    assert found(spark, LONG, LONG.replace("1990 was", "1991 was"))
