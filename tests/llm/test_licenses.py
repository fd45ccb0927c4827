from riftsplit.llm import licenses

APACHE = "Licensed under the Apache License, Version 2.0."
TEXTS = [
    (1, None),
    (2, ""),
    (3, "Copyright (c) 2020 Someone\n\n" + licenses.MIT),
    (4, licenses.MIT.replace(" ", "\n\n").upper()),
    (5, "words\n" + APACHE + "\nmore words"),
    (6, "  licenced under the apache licence version 2.0 "),
    (7, "LICENSED under the APACHE License, v2.0\n" + APACHE),
    (8, "a licence of another kind"),
    (9, "word " * 50_000),
    (5, "words\n" + APACHE + "\nmore words"),
    (None, APACHE),
]


def test_digests(docs):
    got = {r["doc_id"]: (r["text_license"], r["n_lines"], r["notices"]) for r in licenses.scan_licenses(docs(TEXTS)).collect()}
    assert got[1] == got[2] == got[9] == (None, 0, "")
    assert got[3][0] == got[4][0] == "MIT"
    assert got[5] == (None, 2, "Apache-2.0")  # two equal rows
    assert got[6] == ("Apache-2.0", 1, "Apache-2.0")
    assert got[7] == (None, 2, "Apache-2.0")
    assert got[8] == (None, 1, "")
    assert got[None] == ("Apache-2.0", 1, "Apache-2.0")


def test_empty_table(docs):
    assert licenses.scan_licenses(docs([])).count() == 0
