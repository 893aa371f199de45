"""Values next to other text: what follows or precedes a valid value doesn't hide it."""

import hashlib
import re

import pytest

from steplake.llm.pseudonyms import luhn, permuted, pseudonymise

KEY = b"test"
CARD_19 = "404189497460879512"  # without its check digit
CARD_19 += str(luhn(CARD_19))
GROUPED_19 = " ".join([CARD_19[i:i + 4] for i in range(0, 19, 4)])
TOKEN = hashlib.sha256(b"x").hexdigest()


@pytest.mark.parametrize("before,value,after", [
    ("to ", "ES91 2100 0418 4502 0005 1332", " BANK"), ("", "ES9121000418450200051332", " BANK 2024"), ("pay ", "BE68 5390 0754 7034", " EUR 20"),
    ("", "AT61 1904 3002 3457 3201", " ABC"), ("", "SE45 5000 0000 0583 9825 7466", " 1000 SEK"), ("", "PL61 1090 1014 0000 0712 1981 2874", " PLN"),
    ("", "CZ65 0800 0000 1920 0014 5399", " 12"), ("AB13 ", "BE68 5390 0754 7034", ""), ("", "DE89 3704 0044 0532 0130 00", " BANK"),
    ("at ", "2024-05-06", "T12:00:00Z"), ("", "2024-05-06", "t12:00"), ("", GROUPED_19, ""), ("", GROUPED_19.replace(" ", "-"), "."),
    ("", "4041 8949 7460 8795", " 007"), ("", TOKEN[:32].upper(), ""), ("key=", TOKEN.upper(), ""), ("", TOKEN, ""), ("", TOKEN * 4, ""),
    ("", TOKEN[:20] + TOKEN[20:40].upper(), "")])
def test_values_are_found_beside_other_text(before, value, after):
    new, n = pseudonymise(before + value + after, KEY)
    assert n == 1 and new.startswith(before) and new.endswith(after) and len(new) == len(before + value + after)
    middle = new[len(before):len(new) - len(after)]
    assert middle != value and re.sub("[0-9A-Fa-f]", "x", middle) == re.sub("[0-9A-Fa-f]", "x", value)
    assert pseudonymise(value, KEY) == (middle, 1)


def test_written_in_other_ways_the_pseudonym_is_the_same():
    assert pseudonymise(TOKEN.upper(), KEY)[0] == pseudonymise(TOKEN, KEY)[0].upper()
    assert pseudonymise(GROUPED_19, KEY)[0].replace(" ", "") == pseudonymise(CARD_19, KEY)[0]
    assert pseudonymise("ES91 2100 0418 4502 0005 1332 BANK", KEY)[0] == pseudonymise("ES91 2100 0418 4502 0005 1332", KEY)[0] + " BANK"


@pytest.mark.parametrize("text", ["2024-05-06Tea", "2024-02-30T12:00:00", "ES91 2100 0418 4502 0005 1333 BANK", "AB13 ABCD EFGH IJKL",
                                  "4041 8949 7460 8796 12", "A" * 32, "1" * 32, "2024-05-06x"])
def test_invalid_candidates_stay_whole(text):
    assert pseudonymise(f"x {text} y", KEY) == (f"x {text} y", 0)


def test_long_numbers_are_permuted_both_ways():
    for size in (1 << 256, 16 ** 200, 10 ** 60):
        there = permuted(KEY, "x", size - 2, size)
        assert there < size and permuted(KEY, "x", there, size, True) == size - 2
    whole = 16 ** 200
    assert len({permuted(KEY, "x", i, whole) >> 700 for i in range(20)}) == 20 == len({permuted(KEY, "x", i, whole) % (1 << 90) for i in range(20)})
