import re
from collections import Counter, defaultdict

import pytest
from oracle import connect, rows_of

from siftwell.llm.license_rules import BASE, build_rules
from siftwell.llm.license_scan import license_digest, scan_licenses
from siftwell.llm.line_dedup import drop_frequent_lines
from siftwell.llm.queries import ORACLES, QUERIES

BLANKS = " \t\n\x0b\x0c\r"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_line_query_equals_sql(spark, data):
    got = QUERIES["op10_line_dedup"](spark, data).toArrow()
    assert rows_of(got) == rows_of(connect(data).sql(ORACLES["op10_line_dedup"]).to_arrow_table())


def plain_lines(texts, min_docs):
    keys = [[low(x).strip(BLANKS) for x in (t or "").split("\n")] for t in texts]
    df = Counter(k for own in keys for k in set(own))
    out = []
    for text, own in zip(texts, keys):
        kept = [x for x, k in zip((text or "").split("\n"), own) if not k or df[k] < min_docs]
        out.append(("\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out)


def test_lines_equal_brute_force(spark):
    texts = ["A\nb\n c \n", "a \nx\n\n", "\tA\r\nÄ\nb", "ä\nÄ\nä", None, "", "\n\n", "c\nC\nc", "K\nk", " a\na"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for least in (1, 2, 3, 4):
        got = drop_frequent_lines(docs, min_docs=least).collect()
        assert sorted((r.text or "", r.n_lines, r.n_dropped) for r in got) == plain_lines(texts, least)


def test_odd_rows_of_lines(odd_docs, no_docs):
    got = drop_frequent_lines(odd_docs, min_docs=2)
    assert sorted(got.columns) == sorted(odd_docs.columns)
    rows = got.collect()
    texts = [r.text for r in odd_docs.select("text").collect()]
    assert sorted((r.text or "", r.n_lines, r.n_dropped) for r in rows) == plain_lines(texts, 2)
    assert drop_frequent_lines(no_docs).collect() == []


def plain_scan(text, rules):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    line = " ".join(words)
    hits = []
    for n, rule in enumerate(rules):
        if rule.gate in line:
            for m in re.finditer(rule.pattern, line):
                first = line[: m.start()].count(" ")
                hits.append((first, first + m.group().count(" "), rule.priority, n))
    kept = [
        x for x in hits
        if not any(
            y[2] >= x[2] and y[0] <= x[0] and y[1] >= x[1] and ((y[:2] != x[:2]) or y[2] > x[2] or y[3] < x[3])
            for y in hits if y is not x
        )
    ]
    phrases = defaultdict(list)
    for label, phrase in BASE:
        own = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(own)] == own:
                phrases[label].append(i)
    places = sorted(i for own in phrases.values() for i in own)
    covered = {w for a, b, _, _ in hits for w in range(a, b + 1)}
    return (
        len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(phrases)),
        ",".join(sorted({rules[n].label for *_, n in kept} | set(phrases))), len(covered) / len(words) if words else 0.0,
    )


SNIPPETS = [
    "Licensed under the Apache License, Version 2.0", "Released under the MIT license.", "CC BY-NC 4.0", "cc by cc by",
    "All rights reserved.", "This work is licensed under the GNU General Public License, version 3 or any later version",
    "SPDX-License-Identifier: MIT", "Copyright (c) 2001, 2003", "Creative Commons Attribution Share Alike 3.0 Unported",
    "General Public License", "© 1999", "provided AS IS without warranty of any kind", "tous droits réservés", "xcc by", "cc byx",
]


def test_scan_equals_brute_force(spark):
    rules = build_rules()
    assert len(rules) > 200
    texts = [*SNIPPETS, " ".join(SNIPPETS), "\n".join(SNIPPETS * 20), "all rights reserved " * 300, None, "", "--- !!", "Wort mit"]
    texts += [f"{a} {b}" for a in SNIPPETS for b in SNIPPETS]
    got = license_digest(scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for row in got:
        want = plain_scan(texts[row.doc_id], rules)
        assert tuple(row)[1:-1] == want[:-1], texts[row.doc_id]
        assert row.score == pytest.approx(want[-1])
    assert len(got) == len(texts)


def test_odd_rows_of_licenses(odd_docs, no_docs):
    got = license_digest(scan_licenses(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    assert {r.n_words for r in got if r.doc_id in (3, 4, 5)} == {0} and {r.labels for r in got} == {""}
    assert license_digest(scan_licenses(no_docs)).collect() == []
