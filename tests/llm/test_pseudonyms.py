import datetime
import ipaddress
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pseudonyms
from graphloom.llm.pseudonyms import _mod97, luhn, permute
from graphloom.llm.pseudonyms import EXAMPLE_KEY as KEY
from tests.llm.common import empty, odd


def replace(text, key=KEY):
    return pseudonyms.replace(text, key)


def pseudonym(kind, value, key=KEY):
    return pseudonyms.pseudonym(kind, value, key)


def pseudonymised(docs, key=KEY, **more):
    return pseudonyms.pseudonymised(docs, key, **more)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 400), st.binary(min_size=1, max_size=8))
def test_permutes(size, key):
    assert sorted(permute(x, size, key, b"t") for x in range(size)) == list(range(size))


@pytest.mark.parametrize(
    "text, pattern, valid",
    [
        ("card 4111 1111 1111 1111.", r"card (\d{4} \d{4} \d{4} \d{4})\.", lambda v: luhn(v.replace(" ", "")) == 0 and v[0] == "4"),
        ("born 2001-02-28!", r"born (\d{4}-\d\d-\d\d)!", lambda v: datetime.date.fromisoformat(v)),
        ("on 31/12/1999, then", r"on (\d\d/\d\d/\d{4}), then", lambda v: datetime.datetime.strptime(v, "%d/%m/%Y")),
        ("ip 10.0.0.255 ok", r"ip (\d+\.\d+\.\d+\.\d+) ok", lambda v: all(int(x) < 256 for x in v.split("."))),
        ("ssn 078-05-1120.", r"ssn (\d{3}-\d\d-\d{4})\.", lambda v: v[:3] not in ("000", "666") and v[0] != "9"),
        ("call +1 (017) 555-7713 now", r"call (\+1 \(\d{3}\) \d{3}-\d{4}) now", lambda v: True),
        ("mail jo.Doe7@mail4.example.com,", r"mail ([a-z]{2}\.[A-Z][a-z]{2}\d@[a-z]{4}\d\.example\.com),", lambda v: True),
        ("GB82 WEST 1234 5698 7654 32", r"(GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d)", lambda v: _mod97(v.replace(" ", "")) == 1),
        ('token = "' + "0a" * 20 + '"', r'token = "([0-9a-f]{40})"', lambda v: True),
    ],
)
def test_formats(text, pattern, valid):
    new, n = replace(text)
    found = re.fullmatch(pattern, new)
    assert n == 1 and new != text and found and valid(found[1])
    assert replace(text)[0] == new and replace(text, b"another key")[0] != new


def test_links_equal_values():
    a, b = pseudonym("card", "4111 1111 1111 1111"), pseudonym("card", "4111-1111-1111-1111")
    assert a.replace(" ", "") == b.replace("-", "")


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "999.1.1.1", "2001-02-30", "000-12-3456", "0000000000000000", "version 1.2.3", "9.9.", "deadbeef", "1234567890123456789012", "GB82 WEST 1234 5698 7654 33", "price 12/13", "a@b"])
def test_what_is_not_valid_stays(text):
    assert replace(text) == (text, 0)


def test_tables(spark):
    docs = odd(spark)
    got = pseudonymised(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert sorted(repr(r.text) for r in got.collect()) == sorted(repr(r.text) for r in docs.collect())
    rows = [(1, "ip 10.0.0.1"), (2, "again 10.0.0.1 and 10.0.0.1"), (3, None), (None, "")]
    out = {r.doc_id: (r.text, r.n) for r in pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), count="n").collect()}
    value = out[1][0].split()[1]
    assert out[2] == (f"again {value} and {value}", 2) and out[3] == (None, 0) and out[None] == ("", 0) and value != "10.0.0.1"
    assert pseudonymised(empty(spark), count="n").collect() == []


@pytest.mark.parametrize(
    "text, pattern, valid",
    [
        ("call 555-123-4567.", r"call ([2-9]\d\d-\d{3}-\d{4})\.", lambda v: v[1:3] != "11"),
        ("call 555.123.4567 now", r"call ([2-9]\d\d\.\d{3}\.\d{4}) now", lambda v: v[1:3] != "11"),
        ("call 1-800-555-0199 now", r"call 1-([2-9]\d\d-\d{3}-\d{4}) now", lambda v: v[1:3] != "11"),
        ("on 12/31/1999, then", r"on (\d\d/\d\d/\d{4}), then", lambda v: datetime.datetime.strptime(v, "%m/%d/%Y")),
        ("at 2024-05-06T10:00Z", r"at (\d{4}-\d\d-\d\d)T10:00Z", lambda v: datetime.date.fromisoformat(v)),
        ("ip 2001:db8::1: up", r"ip ([0-9a-f:]+): up", lambda v: ipaddress.IPv6Address(v)),
        ("ip 2001:DB8:0:1:2:3:4:5.", r"ip ([0-9a-f:]+)\.", lambda v: ipaddress.IPv6Address(v)),
        ("end.2001-02-28 x", r"end\.(\d{4}-\d\d-\d\d) x", lambda v: datetime.date.fromisoformat(v)),
        ("ip -10.0.0.1 +", r"ip -(\d+\.\d+\.\d+\.\d+) \+", lambda v: ipaddress.IPv4Address(v)),
        ("sha256-" + "0a" * 20, r"sha256-([0-9a-f]{40})", lambda v: True),
    ],
)
def test_other_written_forms(text, pattern, valid):
    test_formats(text, pattern, valid)


def test_phones_are_linked():
    assert pseudonym("bare", "555-123-4567") == pseudonym("nanp", "(555) 123-4567").replace("(", "").replace(") ", "-")


@pytest.mark.parametrize("text", ["at 10:00:00", "std::add", "a::b", "dead::beef", "911-123-4567", "123-456-7890", "1.2.3.4.5", "2001-02-28Tx", "13/31/1999", "::1"])
def test_other_forms_that_stay(text):
    assert replace(text) == (text, 0)


def digits(text):
    return "".join(c for c in text if c.isdigit())


@pytest.mark.parametrize(
    "forms",
    [
        ["+14155552671", "+1 415 555 2671", "+1 (415) 555-2671", "+1.415.555.2671", "(415) 555-2671", "415-555-2671", "1-415-555-2671", "415.555.2671"],
        ["+442079460958", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+44-20-7946-0958"],
        ["+35312345678", "+353 1 234 5678"],
        ["+79161234567", "+7 916 123-4567", "+7 (916) 123 4567"],
    ],
)
def test_one_pseudonym_for_one_number(forms):
    """Country and national number, however they are written."""
    country = {"+1": "1", "+4": "44", "+3": "353", "+7": "7"}[forms[0][:2]]
    new = set()
    for form in forms:
        out, n = replace(f"call {form} now")
        assert n == 1 and out != f"call {form} now"
        value = out[5:-4].replace("(0)", "")
        assert re.sub(r"\d", "9", value) == re.sub(r"\d", "9", form.replace("(0)", ""))
        new.add(digits(value).removeprefix(country) if form[0] == "+" or form[0] == "1" else digits(value))
    assert len(new) == 1


def test_us_dates_do_not_stay():
    new, n = replace("born 03/14/2020.")
    assert n == 1 and new != "born 03/14/2020." and datetime.datetime.strptime(new, "born %m/%d/%Y.")


def test_cards_against_brute_force(monkeypatch):
    """All valid cards of 13 digits in a small range: valid, different, never one digit over and over; walked where the permutation gives that."""
    bodies = [f"4{i:011d}" for i in range(0, 3000, 7)]
    cards = [b + str(-luhn(b + "0") % 10) for b in bodies]
    new = [pseudonym("card", c) for c in cards]
    assert len(set(new)) == len(cards) and all(luhn(c) == 0 and c[0] == "4" and len(c) == 13 for c in new)
    same = iter([0, 5])
    monkeypatch.setattr(pseudonyms, "permute", lambda x, size, key, tweak: next(same))
    assert pseudonyms._card("0000000000018", b"k") == "0000000000059"


def test_dates_and_numbers_are_permutations():
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(n) for n in range(400)]
    assert len({pseudonym("date", d.isoformat()) for d in days}) == 400
    assert all(pseudonym("date", d.isoformat()) == datetime.datetime.strptime(pseudonym("date", d.strftime("%d.%m.%Y")), "%d.%m.%Y").date().isoformat() for d in days[:50])
    assert len({pseudonym("ssn", f"123-45-{n:04d}") for n in range(1, 500)}) == 499


def test_a_key_is_needed(spark):
    with pytest.raises(TypeError):
        pseudonyms.pseudonymised(empty(spark))


def test_no_key_is_an_error_but_for_the_example(spark):
    with pytest.raises(ValueError, match="secret key"):
        pseudonyms.key_of(spark)
    with pytest.warns(UserWarning, match="public key"):
        assert pseudonyms.key_or_example(spark) == pseudonyms.EXAMPLE_KEY
    spark.conf.set("spark.graphloom.pseudonymKey", "mine")
    try:
        assert pseudonyms.key_of(spark) == pseudonyms.key_or_example(spark) == b"mine"
    finally:
        spark.conf.unset("spark.graphloom.pseudonymKey")
