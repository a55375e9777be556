"""Pseudonyms: permutations, validity, links across documents and exact round trips."""

import ipaddress
import random
import re
from datetime import date, datetime

import pytest

from kiln.llm import pii as P

KEY = b"test key"


@pytest.mark.parametrize("size", [2, 3, 10, 26, 97, 260, 1000])
def test_permutation_is_a_bijection_without_fixed_points(size):
    p = P.Permutation(KEY, "x", size)
    got = [p.forward(i) for i in range(size)]
    assert sorted(got) == list(range(size))
    assert all(i != g and p.backward(g) == i for i, g in enumerate(got))


def cases(r):
    payload = "".join(r.choice("0123456789") for _ in range(15))
    card = payload + P.luhn_digit(payload)
    rest = "".join(r.choice("0123456789") for _ in range(18))
    day = date.fromordinal(r.randrange(P._FIRST, P._LAST + 1))
    return {
        "card": r.choice([card, " ".join(card[i:i + 4] for i in range(0, 16, 4))]),
        "iban": "DE" + P._iban_check("DE", rest) + rest,
        "ip": ".".join(str(r.randrange(256)) for _ in range(4)),
        "phone": r.choice(["+1 ({}) 555-{}", "({}) 555-{}", "{}-555-{}", "{}.555.{}"]).format(r.randrange(100, 999), r.randrange(1000, 9999)),
        "ssn": f"{r.randrange(1, 600):03d}-{r.randrange(1, 99):02d}-{r.randrange(1, 9999):04d}",
        "email": r.choice(["ann.42@mail8.example.com", "B_ob+x@host.org", f"u{r.randrange(999)}@a-b.net"]),
        "date": r.choice([day.isoformat(), day.strftime("%d.%m.%Y"), day.strftime("%m/%d/%Y"), day.strftime("%d/%m/%Y"), f"{day.day}.{day.month}.{day.year}"]),
    }


def test_values_stay_valid_and_come_back():
    r = random.Random(3)
    for _ in range(300):
        for kind, value in cases(r).items():
            text = f"é before {value}, after."
            new, counts = P.mapped(text, KEY)
            assert counts[kind] == 1 and sum(counts.values()) == 1, (kind, value, counts)
            assert value not in new and new.startswith("é before ") and new.endswith(", after.")
            again, seen = P.mapped(new, KEY, "backward")
            assert again == text and seen == counts, (kind, value, new, again)


@pytest.mark.parametrize("text", ["3/08/1999", "08.3.1999", "8.03.1999", "1999-08-03T10:00:00", "31/1/2000", "1/31/2000", "29.2.2000", "1.1.1900", "12/31/2099"])
def test_dates_of_every_spelling_are_mapped_within_it(text):
    new, counts = P.mapped(f"on {text}.", KEY)
    assert counts["date"] == 1 and new != f"on {text}."
    assert [len(w) for w in re.findall("[0-9]+", new)] == [len(w) for w in re.findall("[0-9]+", text)]
    assert P.mapped(new, KEY, "backward")[0] == f"on {text}."


def test_what_stays_in_clear_by_the_docstring():
    for text in ("12/31/1899", "2100-01-01", "123456789", "1999-08-03x", "30.2.2000", "1999-08-03T1"):
        assert P.mapped(text, KEY) == (text, dict.fromkeys(P.KINDS, 0))
    new, counts = P.mapped("josé.m@corp.de", KEY)
    assert counts["email"] == 1 and new[3] == "é" and new.endswith("@corp.de") and new[:3] != "jos"
    assert P.mapped(new, KEY, "backward")[0] == "josé.m@corp.de"


def plain_kind(token):
    """What a token is, by other means than the operator's patterns."""
    if token.count("@") == 1 and "." in token.split("@")[1]:
        return "email"
    digits = re.sub("[ -]", "", token)
    if digits.isdigit() and 13 <= len(digits) <= 19 and (digits == token or re.fullmatch(r"(\d{4}[ -]){3}\d{4}", token)):
        rest = [int(c) for c in digits[::-1]]
        if (sum(rest[::2]) + sum(sum(divmod(2 * c, 10)) for c in rest[1::2])) % 10 == 0:
            return "card"
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
        try:
            if 1900 <= datetime.strptime(token, form).year < 2100 and (form[1] != "Y" or len(token) == 10):
                return "date"
        except ValueError:
            pass
    try:
        ipaddress.IPv4Address(token)
        return "ip"
    except ValueError:
        pass
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", token):
        a, b, c = token.split("-")
        return "ssn" if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else None
    if len(token) >= 15 and token[:2].isalpha() and token[:2].isupper() and token[2:].isdigit():
        moved = token[4:] + token[:4]
        return "iban" if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else None
    return None


def test_counts_are_those_of_a_plain_finder():
    r = random.Random(17)
    seen = dict.fromkeys(P.KINDS, 0)
    for _ in range(400):
        tokens = []
        for kind, value in cases(r).items():
            if kind == "phone":
                continue
            if r.random() < .3:  # broken on purpose: a digit changed
                at = r.choice([i for i, c in enumerate(value) if c.isdigit()] or [0])
                value = value[:at] + r.choice("0123456789") + value[at + 1:]
            tokens.append(value)
        r.shuffle(tokens)
        text = " and ".join(["words", *tokens, "more"])
        want = dict.fromkeys(P.KINDS, 0)
        for t in tokens:
            if (k := plain_kind(t)):
                want[k] += 1
                seen[k] += 1
        assert P.mapped(text, KEY)[1] == want, text
    assert all(n > 100 for k, n in seen.items() if k != "phone")


def test_invalid_values_and_clean_text_are_left_alone():
    for text in ("", "no data 12 here", "4111111111111112", "999.1.1.1", "31.02.2020", "000-12-3456", "1.2.3.4.5", "x@y", "DE00123456789012345678",
                 "deadbeef4111111111111111", "2020-13-01"):
        assert P.mapped(text, KEY) == (text, dict.fromkeys(P.KINDS, 0))


def test_operator_links_documents_and_handles_odd_rows(spark):
    rows = [(1, "mail ann.42@mail8.example.com", "x"), (2, "or ann.42@mail8.example.com!", None), (None, "4111 1111 1111 1111", "y"),
            (3, None, "z"), (3, "", "z"), (4, "word " * 60_000 + "10.0.0.1", "z"), (4, "word " * 60_000 + "10.0.0.1", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email string")
    got = {(r.doc_id, i): r for i, r in enumerate(P.pseudonymise(df.coalesce(1), KEY).collect())}
    a, b = got[(1, 0)].text.split()[1], got[(2, 1)].text.split()[1][:-1]
    assert a == b != "ann.42@mail8.example.com"
    assert got[(None, 2)].n_card == 1 and got[(3, 3)].text is None and got[(3, 4)].text == ""
    assert got[(4, 5)].text == got[(4, 6)].text and "10.0.0.1" not in got[(4, 5)].text
    back = P.restore(P.pseudonymise(df, KEY).select("doc_id", "text"), KEY).select("doc_id", "text")
    assert sorted(back.collect(), key=str) == sorted(df.select("doc_id", "text").collect(), key=str)
    assert P.pseudonymise(df.limit(0), KEY).count() == 0


def test_round_trip_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    new = P.pseudonymise(docs, KEY)
    back = {r.doc_id: r.text for r in P.restore(new.select("doc_id", "text"), KEY).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert sum(r.n_email + r.n_card + r.n_phone for r in new.collect()) > 20
