"""Values of every kind inside running text."""

import pytest

from quillspan.llm import pii

from .test_data import SAMPLES

MORE = {
    "iban": ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "LU28 0019 4006 4475 0000", "PL61 1090 1014 0000 0712 1981 2874", "LT12 1000 0111 0100 1000", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"],
    "phone": ["+44 20 7946 0958", "+44 (0)20 7946 0958", "+49 30 901820", "+33 1 23 45 67 89", "+34912345678", "+351 21 123 4567"],
    "dmy": ["3/4/2021", "31/3/1999", "5.12.2001", "3/31/1999"],
    "ymd": ["2021-3-4", "2021/11/5"],
    "email": ["hein.19@mail5.example.com"],
}
CASES = [(k, v) for d in (SAMPLES, MORE) for k, vs in d.items() for v in vs]


@pytest.mark.parametrize("kind,value", CASES)
def test_values_in_running_text(kind, value):
    # a full stop before a mail name; short words, which could pass for groups of an IBAN, after the value
    before, after = ("see .", "see ") if kind == "email" else ("see ", "ab12 ")
    for lead in (before, after):
        for tail in (" was it", " and", " from me", " to be or not", ", no.", " (old)", "."):
            new, found = pii.pseudonymise_text(f"{lead}{value}{tail}")
            assert [f["kind"] for f in found] == [kind], (lead, value, tail)
            assert new.startswith(lead) and new.endswith(tail) and value not in new and len(new) == len(lead + value + tail)
            assert (found[0]["start"], found[0]["length"]) == (len(lead), len(value))
            back = pii.pseudonymise_text(new)[1]
            assert back == found  # still valid


def test_one_digit_dates_link_and_invalid_ones_stay():
    one, two, three = (pii.pseudonymise_text(x)[0] for x in ("3/4/2021", "03/04/2021", "2021-04-03"))
    d, m, y = one.split("/")
    assert two == f"0{d}/0{m}/{y}" and three == f"{y}-0{m}-0{d}"
    assert pii.pseudonymise_text("+44 (0)20 7946 0958")[0].replace("(0)", "") == pii.pseudonymise_text("+44 20 7946 0958")[0]
    for text in ("32/3/2021", "1.2.3.2021", "0/4/2021", "+999 12345678", "+44 123", "ES91 2100 0418 4502 0005 1333 was", "Chapter 1.2.3"):
        assert pii.pseudonymise_text(text) == (text, [])
