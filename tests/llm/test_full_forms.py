"""Surrogates of entities that fill their own form: every one still gets a distinct surrogate."""

import re

from shellac.llm import pii

FORMS = {"email": re.compile(r"[a-z]{1,10}@mail[0-9a-f]{10}\.example"), "ip": re.compile(r"\d{1,3}(\.\d{1,3}){3}")}


def test_full_forms(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("email", f"{a}{b}@example.com") for a in letters for b in letters] + [("email", f"{a}@example.org") for a in letters]
    rows += [("ip", f"192.168.{a}.{b}") for a in range(1, 255) for b in range(1, 255)]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, norm string"), "k").collect()
    assert sorted((r.kind, r.norm) for r in got) == sorted(rows)
    new = {(r.kind, r.surrogate) for r in got}
    assert len(new) == len(rows) and not new & set(rows)
    assert all(FORMS[r.kind].fullmatch(r.surrogate) for r in got)


def test_first_attempts_keep_the_form(spark):
    rows = [("ip", "192.168.1.2"), ("ip", "10.1.2.3"), ("email", "ab.c1@example.com"), ("ssn", "123456789")]
    got = {r.norm: r.surrogate for r in pii.surrogates(spark.createDataFrame(rows, "kind string, norm string"), "k").collect()}
    assert got["192.168.1.2"].startswith("192.168.") and got["10.1.2.3"].startswith("10.") and got["123456789"][0] == "1"
    box = got["ab.c1@example.com"].split("@")[0]
    assert len(box) == 5 and box[2] == "." and box[4].isdigit()
