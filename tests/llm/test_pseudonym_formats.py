"""Formats beyond American ones, and secrets at any place."""

import re

import pytest

from seqaudit.llm import pseudonyms

SECRET = "e3b3ed3cc8548923d6"


@pytest.mark.parametrize("text", [
    SECRET, f"a\n{SECRET}", f"a\t{SECRET}", f"({SECRET})", "tel +44 20 7946 0958", "+33 1 23 45 67 89.", "call (555)123-4567", "+442079460958",
    "+49 (0)30 1234567", "+49 1512 3456 7890", "on 1/2/2020 it", "1.2.2020", "12/1/2020", "1/02/2020", "12 March 2020", "March 12, 2020",
    "5. März 2020", "1 de enero de 2021", "12 MAI 2020", "le 12 mars 2020", "3 Jan 2020"])
def test_format_is_replaced_and_restored(text):
    new, n = pseudonyms.Pseudonyms(b"k").text(text)
    assert n == 1 and new != text and re.sub(r"[\dA-Za-zä-ü]+", "", new) == re.sub(r"[\dA-Za-zä-ü]+", "", text)
    assert pseudonyms.Pseudonyms(b"k", back=True).text(new) == (text, 1)


@pytest.mark.parametrize("text", ["+1 23", "32/1/2020", "13/13/2020", "31 February 2020", "+1234567890123456", "a1/2/20203"])
def test_invalid_stays(text):
    assert pseudonyms.Pseudonyms(b"k").text(text) == (text, 0)


def test_every_day_of_a_form_is_restored():
    tool, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", back=True)
    for d in range(1, 29):
        for text in (f"{d}/7/2001", f"{d}.12.2001", f"{d} avril 2001", f"May {d}, 2001", f"{d:02d} August 2001"):
            new, n = tool.text(text)
            assert n == 1 and back.text(new) == (text, 1), text
