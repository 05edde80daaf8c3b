"""Secrets, licences, benchmark leaks."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from packetloom.llm import decontaminate, licenses, secrets

ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


def scan(docs, store):
    return {r.doc_id: r for r in secrets.digest(secrets.find_secrets(docs, store)).collect()}


def test_strong_secrets(make_docs, store, odd_rows):
    texts = [
        'Token: token = abcdefgh secret=secret=abcdefgh', 'PASSWORD="short" passwd:longenough', "AKIA" + "A" * 15 + " AKIA" + "B" * 16,
        "f" * 23 + "g" + "0" * 24, "é日 api_key: 'abc.def' apikey=abcdefg", "ſecret=abcdefgh toKen=abcdefgh",
    ]
    rows = [r for r in odd_rows if r[0] is not None] + [(1000 + i, t) for i, t in enumerate(texts)]
    got = scan(make_docs(rows, clash=True), store)
    names = ("assign", "access", "hex")
    for doc_id, text in rows:
        want = brute_spans(text or "")
        r = got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        listed = ",".join(f"{names[k]}:{b}:{e}" for b, k, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_weak_parts_need_each_other(make_docs, store):
    opaque = "Ab3dEf6hIj9lMn2pQr5t"
    rows = [
        (1, f"username: bobby {opaque} https://host.example.com/x"),
        (2, f"{opaque} alone"),
        (3, "username: bobby https://host.example.com"),
        (4, f"username: bobby {'. ' * 150}{opaque}"),  # too far apart
        (5, f"AKIA{'A' * 16} {opaque}"),
        (6, f"{'. ' * 95}{opaque} host.example.com:8080"),  # over the border of a cell
    ]
    got = {d: re.sub(r":\d+:\d+", "", r.spans) for d, r in scan(make_docs(rows), store).items()}
    assert got == {1: "identifier,opaque,endpoint", 2: "", 3: "", 4: "", 5: "access,opaque", 6: "opaque,endpoint"}


def test_assigned_secrets_are_linked(make_docs, store):
    rows = [
        (1, f"AWS_ACCESS_KEY_ID=AKIA{'A' * 16}\nAWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
        (2, "https://host.example.com/x?sig=Ab3dEf6hIj9lMn2pQr5t"),
        (3, "username: bob password=hunter22 db.host.com:5432"),
        (4, f"login: bob {'0f' * 12}"),
        (5, f"password=hunter22 {'. ' * 150}username: bob"),  # too far apart
        (6, f"password=hunter22 AKIA{'A' * 16}"),
    ]
    got = {d: re.sub(r":\d+:\d+", "", r.spans) for d, r in scan(make_docs(rows), store).items()}
    assert got == {
        1: "identifier,access,opaque", 2: "endpoint,opaque", 3: "identifier,assign,endpoint", 4: "identifier,hex", 5: "assign", 6: "assign,access",
    }


def test_secrets_of_an_empty_table(make_docs, store):
    assert scan(make_docs([]), store) == {}


def test_licences(make_docs, odd_rows):
    rows = odd_rows + [
        (1000, "LICENSED under the  apache licence, v2.0"),
        (1001, "Copyright (c) 2020 Someone\nLicensed under the MIT Licence.\nmore"),
        (1002, "x\nLicensed under CC BY-NC 4.0.\n\nLicensed under CC BY-NC 4.0."),
        (1003, "not licensed under the MIT License."),
        (1004, "© 2021 me\nReleased under the MIT license."),
    ]
    found = licenses.license_units(make_docs(rows, clash=True)).collect()
    assert sorted((r.doc_id, r.unit, r.line or 0, r.license) for r in found) == [
        (1000, "document", 0, "Apache-2.0"),
        (1001, "line", 2, "MIT"),
        (1002, "line", 2, "CC-BY-NC-4.0"),
        (1002, "line", 4, "CC-BY-NC-4.0"),
        (1004, "document", 0, "MIT"),
        (1004, "line", 2, "MIT"),
    ]


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licences_of_several_lines(make_docs):
    commented = "".join(f"# {line}\n" for line in MIT.splitlines())
    notice = "This work is licensed under the\n  GNU General Public License,\n  version 3."
    rows = [
        (1, MIT), (2, f"first\n\n{notice}\n\nlast"), (3, f"#!/bin/x\n\n{commented}\nx = 1\n"), (4, f"first\n{notice}\n\nlast"),
        (5, "int x;\n// Licensed under the\n// MIT License.\nint y;"), (6, f"a\n\n{MIT}\nb"),
    ]
    found = licenses.license_units(make_docs(rows, clash=True)).collect()
    assert sorted((r.doc_id, r.unit, r.line or 0, r.license) for r in found) == [
        (1, "document", 0, "MIT"), (1, "paragraph", 5, "MIT"), (2, "paragraph", 3, "GPL-3.0"), (3, "comment", 3, "MIT"),
        (3, "paragraph", 7, "MIT"), (5, "comment", 2, "MIT"), (6, "paragraph", 7, "MIT"),
    ]


def test_licences_like_the_twin(make_docs, odd_rows):
    docs = make_docs(odd_rows + [(1001, "(c) x\nLicensed under the MIT Licence.\nAll rights reserved")])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.execute(licenses.twin_sql()).fetchall(), key=str)
    order = [d[0] for d in con.execute(licenses.twin_sql()).description]
    assert sorted((tuple(r) for r in licenses.license_units(docs).select(*order).collect()), key=str) == want
    assert licenses.license_units(make_docs([])).count() == 0


ITEMS = [
    (1, "Tom has 5 red apples and buys 3 more apples from the market. How many does Tom have in 2 days?"),
    (2, "short item"),
    (3, None),
    (4, "what is the big capital city of france"),
    (5, "12 13 14 15 16 17 18 19 20 21 22 23 24 25"),
]


def leaks(spark, docs, store, items=ITEMS):
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.exact) for r in decontaminate.leaks(docs, items, store).collect())


def test_leaks(spark, make_docs, store, odd_rows):
    rows = odd_rows + [
        (1000, "before it. " + ITEMS[0][1] + " And after."),
        (1001, "Ann has 7 red apples and buys 9 more apples from the market. How many does Ann have in 4 weeks?"),
        (1002, "Ann has 7 red apples and buys 9 more apples from the market. How many does Bob have in 4 weeks?"),
        (1003, "so what is the big capital city of france"),
        (1004, "so what is the big capital town of france"),
        (1005, ITEMS[4][1]),
    ]
    docs = make_docs(rows, clash=True)
    # the rows 100 to 139 hold item 5 word for word
    copies = [(100 + i, 5, True) for i in range(40)]
    assert leaks(spark, docs, store) == [*copies, (1000, 1, True), (1001, 1, False), (1003, 4, True), (1005, 5, True)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.drop_leaks(docs, items, store)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 44


def test_verbatim_copies_of_any_item_leak(spark, make_docs, store):
    items = [*ITEMS, (6, "7 + 5"), (7, "Anna Bob Carl Dora Emil Frida Gustav Hanna Ida Jon Karl Lena Max Nora"), (8, "日本の首都はどこですか"),
             (9, "Red apples cost two euros")]
    rows = [
        (1, "so " + ITEMS[4][1] + " and on"), (2, "a short item indeed"), (3, "what is 7 + 5 here"), (4, "7 + 6"),
        (5, "with " + items[6][1] + " there"), (6, "問題。日本の首都はどこですか？答え"), (7, "日本の首都はどこだ"),
        (8, "b) Red apples cost two euros"), (9, ITEMS[4][1].replace("18", "81")),
    ]
    assert leaks(spark, make_docs(rows), store, items) == [(1, 5, True), (2, 2, True), (3, 6, True), (5, 7, True), (6, 8, True), (8, 9, True)]


def test_same_words_leak_beside_an_edited_number(spark, make_docs, store):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    words[3] = words[20] = words[50] = "5"
    edited = [*words]
    edited[50] = "7"
    renamed = [w.replace("5", "7") for w in words[:48]] + words[48:50] + ["8"] + words[51:]
    docs = make_docs([(1, " ".join(edited)), (2, " ".join(renamed)), (3, " ".join(words))])
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.n_windows, r.exact) for r in decontaminate.leaks(docs, items, store).collect()}
    # in the first text 5 is 5 or, in windows 38 to 47, 7; in the second windows 4 to 7 and 21 to 37 have the same words
    assert got == {1: (48, False), 2: (21, True), 3: (48, True)}


def plain_template(text):
    """(word, code) per token: the code is the word or its kind."""
    out, opens = [], True
    for raw in text.split():
        word = re.sub("^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "", raw)
        if word:
            low = word.lower()
            code = "<unit>" if low in decontaminate.UNITS else low
            if word[0].isupper():
                code = "<start>" if opens else "<name>"
            if word[0].isdigit() or low in decontaminate.NUMBER_WORDS:
                code = "<number>"
            out.append((low, code))
        opens = raw[-1] in ".!?:"
    return out


def plain_windows(tokens, length):
    """(place, what must agree, slots) of the windows by words and by template."""
    for at in range(len(tokens) - length + 1):
        span = tokens[at : at + length]
        yield at, ("words", *(w for w, _ in span)), []
        slots = [w for w, c in span if c[0] == "<"]
        if length >= decontaminate.LEAST_ITEM and 2 * (length - len(slots)) >= length:
            yield at, ("template", *(c for _, c in span)), slots


def brute_leaks(rows, items):
    """All windows of all pairs of a document and an item."""
    out = {}
    for doc_id, text in rows:
        for item_id, item in items:
            doc, of = plain_template(text or ""), plain_template(item or "")
            length = min(decontaminate.WINDOW, len(of))
            shifts = {}
            for at, same, slots in plain_windows(doc, length) if length else []:
                for item_at, item_same, item_slots in plain_windows(of, length):
                    if same == item_same:
                        shifts.setdefault(at - item_at, []).append((item_at, list(zip(item_slots, slots))))
            best, exact = 0, False
            for found in shifts.values():
                pairs = {p for _, zipped in found if any(a != b for a, b in zipped) for p in zipped}
                fits = len(pairs) == len({a for a, _ in pairs})
                n = len({at for at, zipped in found if fits or all(a == b for a, b in zipped)})
                best, exact = max(best, n), exact or (n > 0 and (not fits or not pairs))
            if best:
                out[doc_id, item_id] = (best, exact)
    return out


def test_leaks_like_brute_force(spark, make_docs, store):
    rng = random.Random(3)
    words = "red blue apples buys sells from the market house Tom Ann Bob 3 5 7 two km kg days How has.".split()
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 3, 4, 5, 6, 8, 12, 13, 14, 20, 25, 40, 40])]
    rows = [(1000, None), (1001, "")]
    for i in range(160):
        text = rng.choices(words, k=rng.randint(0, 30))
        for _, item in rng.sample(items, 2):
            item = item.split()
            names = {w: rng.choice(["Tom", "Ann", "Bob"]) for w in ("Tom", "Ann", "Bob")} | {w: rng.choice("3579") for w in "357"}
            kind = rng.random()
            if kind < 0.5:  # other parameters
                item = [names.get(w, w) for w in item]
            if kind > 0.3:  # an edited word
                item[rng.randrange(len(item))] = rng.choice(words)
            text += item + rng.choices(words, k=3)
        rows.append((i, rng.choice([" ", "\n", " - "]).join(text)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.exact) for r in decontaminate.leaks(make_docs(rows), table, store).collect()}
    want = brute_leaks(rows, items)
    assert len(want) > 200 and sum(not exact for _, exact in want.values()) >= 10
    assert got == want


def test_texts_go_for_a_short_item_only_where_it_stands_alone(spark, make_docs, store):
    rows = [
        (1, "is a short item in here"), (2, "First line.\n* short item\nlast"), (3, "So. Short item! Well"), (4, "short item"),
        (5, "a short item\nnext"), (6, "short items"), (7, "one short\nitem two"), (8, "Short\nitem"), (9, "\n\n  short item  \n\nx"),
        (10, "x.\r\n7 + 5 = ?\r\ny"), (11, "7 + 5 is asked"),
    ]
    items = spark.createDataFrame([(1, "short item"), (2, "7 + 5 = ?")], "item_id long, text string")
    docs = make_docs(rows)
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items, store).collect()} == {1, 5, 6, 7, 11}
    hits = {r.doc_id for r in decontaminate.leaks(docs, items, store).collect()}
    assert hits == {i for i, _ in rows} - {6}


def test_leaks_of_empty_tables(spark, make_docs, store):
    assert leaks(spark, make_docs([]), store) == []
    assert leaks(spark, make_docs([(1, ITEMS[0][1])]), store, []) == []


@pytest.mark.parametrize("unit", ["0123456789abcdef", "a.", "user", "Aa0+", "://", "a://", "password "])
def test_secrets_of_long_texts_take_linear_time(unit):
    text = unit * (5_000_000 // len(unit))
    began = time.perf_counter()
    list(secrets.strong(text)), list(secrets.weak(text))
    assert time.perf_counter() - began < 10


def test_endpoints():
    text = "Xhttp://a.b:1 1+http://c git+ssh://d. ://e http://f://g db.host.com:5432 x.y:1 p://db.host.com:5432/"
    assert [text[a:b] for a, b in secrets.endpoints(text)] == [
        "http://a.b:1", "http://c", "git+ssh://d.", "http://f", "db.host.com:5432", "p://db.host.com:5432",
    ]


@pytest.mark.parametrize("text", ["POSTGRES_USER=bobby\nPOSTGRES_PASSWORD=hunter2222", "DB_USERNAME=alice\nDB_PASSWORD=hunter2222"])
def test_names_of_env_files_are_linked(make_docs, store, text):
    (row,) = secrets.find_secrets(make_docs([(1, text)]), store).collect()
    assert [s.kind for s in row.weak] == ["identifier"] and [s.kind for s in row.strong] == ["assign"]


def linked_by_hand(text):
    """Weak parts beside a secret, by comparing every part with every other."""
    parts = [*secrets.strong(text), *secrets.weak(text)]
    kept = set()
    for a in parts:
        for b in parts:
            if a[0] in secrets.SECRETS and b[0] in secrets.PARTNERS and 0 <= max(a[1] - b[2], b[1] - a[2]) <= secrets.SCOPE:
                kept |= {a, b}
    return sorted(p for p in kept if p[0] not in secrets.KINDS)


def test_links_match_all_pairs(make_docs, store):
    rng = random.Random(5)
    bits = ["user=bob12 ", "password: hunter2222 ", "https://db.example.org ", "AKIA" + "A1" * 9 + " ", "deadbeef" * 4 + " ", "aB3" * 9 + " ", "word " * 30, "x" * 150 + " ", "login: é_9 "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    got = {r.doc_id: sorted(tuple(s) for s in r.weak) for r in secrets.find_secrets(make_docs(rows), store).collect()}
    assert got == {i: linked_by_hand(t) for i, t in rows}
