import random

import pytest

from postmill.llm.licenses import NOTICES, TEMPLATES, Scanner, scan_licenses, wordings

NOTICE = TEMPLATES["Apache-2.0"]


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_every_template_is_found_exactly(name):
    text = f"Some prose.\n{TEMPLATES[name]}\nMore prose about nothing."
    n, found = Scanner(TEMPLATES).scan(text)
    assert n >= 1 and [(x["license"], x["status"]) for x in found] == [(name, "exact")]
    assert text[found[0]["start"] : found[0]["end"]].rstrip(".") == TEMPLATES[name].rstrip(".")


def test_wording_differences():
    scan = Scanner(TEMPLATES).scan
    assert scan("RELEASED   under the\tMIT license")[1][0]["status"] == "exact"
    lesser = scan("This work is licensed under the GNU Lesser General Public License, version 3.")[1][0]
    assert (lesser["license"], lesser["status"], lesser["added"], lesser["missing"]) == ("GPL-3.0", "variant", ["lesser"], [])
    short = scan("Licensed under Apache License Version 2.0")[1][0]
    assert (short["license"], short["missing"]) == ("Apache-2.0", ["the"])
    assert scan("His driving license was lost in the park last year")[1] == []
    assert scan("Released under the terms of some other unheard license")[1] == []
    assert scan("")[0] == scan("no cue here")[0] == 0


def test_long_lines_and_many_notices():
    scan = Scanner(TEMPLATES).scan
    long = "word " * 50_000 + NOTICE + " word" * 50_000
    assert [(x["license"], x["status"]) for x in scan(long)[1]] == [("Apache-2.0", "exact")]
    assert len(scan((NOTICE + "\n") * 500)[1]) == 500
    assert scan("license" * 20_000)[1] == []
    n, found = scan("x" * 100_000 + " license " + "y" * 100_000)
    assert n == 1 and found == []


def test_memo_does_not_change_results():
    small, large = Scanner(TEMPLATES, memo=1), Scanner(TEMPLATES)
    texts = [f"{TEMPLATES[k]} {i}" for k in TEMPLATES for i in range(3)] * 2
    assert [small.scan(t) for t in texts] == [large.scan(t) for t in texts]


def test_frames(spark, docs):
    rows = [(1, f"a\n{NOTICE}"), (2, None), (3, ""), (None, NOTICE), (5, "nothing"), (5, "nothing"), (6, "LICENCE? None.")]
    got = sorted(((r.doc_id, r.n_candidates, [x.license for x in r.licenses]) for r in scan_licenses(docs(*rows)).collect()), key=str)
    assert got == sorted([(1, 1, ["Apache-2.0"]), (2, 0, []), (3, 0, []), (None, 1, ["Apache-2.0"]), (5, 0, []), (5, 0, []), (6, 1, [])], key=str)
    assert scan_licenses(docs()).count() == 0
    wide = scan_licenses(docs((1, NOTICE, 1, "x"), schema="doc_id long, text string, licenses int, lang string"))
    assert wide.columns == ["doc_id", "text", "lang", "n_candidates", "licenses"]
    assert [r.n_candidates for r in scan_licenses(docs((1, NOTICE)), {}).collect()] == [1]


PROSE = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "su") for b in ("dar", "len", "ron", "tis", "vum", "the", "under")] + ["this", "the", "under", "work", "is", "and"]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(PROSE, k=n))


@pytest.mark.parametrize("name", list(TEMPLATES))
@pytest.mark.parametrize("around", [5, 15, 36, 200])
def test_notices_inside_prose_on_one_line(name, around):
    scan = Scanner(TEMPLATES).scan
    for seed in range(20):
        text = f"{prose(around, seed)} {TEMPLATES[name]} {prose(around, -seed - 1)}"
        [found] = scan(text)[1]
        assert (found["license"], found["status"]) == (name, "exact")
        assert text[found["start"] : found["end"]] == TEMPLATES[name].rstrip(".")


def test_several_notices_in_one_line():
    scan = Scanner(TEMPLATES).scan
    for a in TEMPLATES:
        for b in TEMPLATES:
            for between in (" ", f" {prose(7, 1)} "):
                found = scan(f"{prose(9, 2)} {TEMPLATES[a]}{between}{TEMPLATES[b]} {prose(9, 3)}")[1]
                assert [(x["license"], x["status"]) for x in found] == [(a, "exact"), (b, "exact")]
    many = [x for _ in range(300) for x in TEMPLATES]
    assert [x["license"] for x in scan(" ".join(TEMPLATES[x] for x in many))[1]] == many
    mixed = scan(f"{NOTICE} Licensed under Apache License Version 2.0 {TEMPLATES['MIT']}")[1]
    assert [(x["license"], x["status"]) for x in mixed] == [("Apache-2.0", "exact"), ("Apache-2.0", "variant"), ("MIT", "exact")]


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_wrapped_notices(name):
    scan, template = Scanner(TEMPLATES).scan, TEMPLATES[name]
    for i in (i for i, c in enumerate(template) if c == " "):
        for line_break in ("\n", "\r\n", "\n# ", "\n> > "):
            text = f"{prose(50, i)}\n{template[:i]}{line_break}{template[i + 1:]}\n{prose(50, -i)}"
            [found] = scan(text)[1]
            assert (found["license"], found["status"], found["start"]) == (name, "exact", text.index(template[:i]))
    every = template.replace(" ", "\n * ")
    assert [(x["license"], x["status"]) for x in scan(f"/*\n * {every}\n */")[1]] == [(name, "exact")]


def test_every_wording_of_every_license(spark, docs):
    texts = [(k, x.lstrip("=")) for k, x in wordings(NOTICES)]
    scan = Scanner(NOTICES).scan
    for name, text in texts:
        for found in (scan(text)[1], scan(f"{prose(70, 4)} {text} {prose(70, 5)}")[1]):
            assert [(x["license"], x["status"]) for x in found] == [(name, "exact")], text
    rows = scan_licenses(docs(*enumerate(x for _, x in texts))).collect()
    assert {r.doc_id: [x.license for x in r.licenses] for r in rows} == {i: [k] for i, (k, _) in enumerate(texts)}


def test_short_wordings_count_word_for_word():
    scan = Scanner(NOTICES).scan
    names = lambda text: [x["license"] for x in scan(text)[1]]
    assert names("Copyright (c) 1999-2024 Jane Doe. All rights reserved.") == ["Copyright", "All-Rights-Reserved"]
    assert names("Copyright © 2024 Jane Doe") == ["Copyright"]
    assert names("SPDX-License-Identifier: MIT") == ["MIT"] and names("SPDX-License-Identifier: Unheard-1.0") == []
    assert names("all rights of the people, a copyright law, a reserved seat, licensed under the license") == []
    assert names("SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0"]
    assert Scanner(NOTICES).scan("Seats are reserved.") == (1, [])
