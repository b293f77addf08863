"""Values beside other digits and words."""

import random
import re

import pytest

from seqaudit.llm import pseudonyms

CARD, ACCOUNT = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"


@pytest.mark.parametrize("text, value", [
    ("card 4111 1111 1111 1111 12/27", CARD), ("4111111111111111 123", "4111111111111111"), ("2 4111 1111 1111 1111", CARD),
    ("AT611904300234573201 BIC", "AT611904300234573201"), ("AT61 1904 3002 3457 3201 2024", ACCOUNT),
    ("AT61 1904 3002 3457 3201 BKAUATWW", ACCOUNT), ("17 4111 1111 1111 1111 123 2", CARD), ("3782 822463 10005 1234", "3782 822463 10005"),
    ("id 99 411111 1111 111111 77", "411111 1111 111111")])
def test_value_beside_others(text, value):
    new, n = pseudonyms.Pseudonyms(b"k").text(text)
    assert n == 1 and value not in new
    before, after = text.split(value)
    assert new.startswith(before) and new.endswith(after)
    assert pseudonyms.Pseudonyms(b"k", back=True).text(new) == (text, 1)


def test_all_values_of_a_run_and_what_follows():
    tool, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", back=True)
    text = f"{CARD} 5500 0000 0000 0004 2024-05-06 and 10 20 30 40 50 60 70 2021-01-02"
    new, n = tool.text(text)
    assert n == 4 and back.text(new) == (text, 4)
    assert tool.text(CARD)[0] == tool.text(f"7 {CARD} 12/27")[0][2:21]  # linked
    assert tool.text("1 " * 50_000)[1] == 0 and tool.text("AT61 " * 20_000)[1] == 0


def test_rows_of_numbers_round_trip():
    rng = random.Random(1)
    tool, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", back=True)
    hits = 0
    for _ in range(2000):
        body = "".join(rng.choice("0123456789") for _ in range(rng.choice([12, 14, 15, 18])))
        card = body + str(pseudonyms.luhn_digit(body))
        size = rng.choice([4, 5, 20])
        card = " ".join(card[i:i + size] for i in range(0, len(card), size))
        text = f"{rng.randrange(1000)} {card} {rng.randrange(1000)}"
        new, n = tool.text(text)
        assert n >= 1 and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
        assert back.text(new) == (text, n)
        hits += n
    assert hits >= 2000
