"""Language-model scores, token counts, licences and URL lists against brute force."""

import datetime as dt

import duckdb
import pytest

from clickmart.llm import license_rules, license_scan, lm_interpolation, queries, token_counts, url_lists
from tests.llm import brute
from tests.llm.conftest import BASE, LONG, ODD, PLAIN, expected, rows_of

LM = [*ODD, *[(100 + i, f"{BASE} {'again' if i % 2 else 'never'} w{i % 5} {BASE if i % 3 else ''}") for i in range(60)]]


def close(found, wanted):
    found, wanted = (sorted(rows, key=lambda r: repr(r[:5])) for rows in (found, wanted))
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    for a, b in zip(found, wanted, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize(("order", "chunk", "span"), [(2, 1 << 21, 1 << 21), (2, 500, 300), (3, 900, 2000), (1, 700, 900)])
def test_interpolated_scores(as_documents, order, chunk, span):
    found = lm_interpolation.interpolated_scores(as_documents(LM), order=order, chunk_tokens=chunk, range_tokens=span)
    close([tuple(r) for r in found.collect()], brute.lm_scores([r for r in LM], order))


@pytest.mark.parametrize(("order", "step"), [(2, 2), (3, 1)])
def test_ranges_in_several_steps(as_documents, monkeypatch, order, step):
    """Groups of chunks that ask finer ranges together get what each chunk would get alone."""
    monkeypatch.setattr(lm_interpolation, "STEP_BITS", step)
    docs = LM if step == 2 else [r for r in LM if r[1] is None or len(r[1]) < 2000]
    span = 1200 if step == 2 else 300
    assert sum(len((t or "").split()) + 1 for _, t in docs) > span << (2 * step)  # three levels
    found = lm_interpolation.interpolated_scores(as_documents(docs), order=order, chunk_tokens=100, range_tokens=span)
    close([tuple(r) for r in found.collect()], brute.lm_scores(docs, order))


def test_probabilities_add_up_to_one(as_documents):
    """Of all known tokens, the end among them, and one for the unknown; single tokens, so that a text's is theirs times the end's."""
    train = [(i, "a b a c b a") for i in range(10, 40)]
    held = [i for i in range(1000, 1100) if brute.zlib.crc32(str(i).encode()) % 7 == 2]
    texts = ["", "a", "b", "c", "unknown"]
    docs = as_documents(train + list(zip(held, texts, strict=False)))
    score = {r["doc_id"]: r["score"] for r in lm_interpolation.interpolated_scores(docs, order=1).collect()}
    end, *others = (score[i] for i in held[:5])
    assert 10**end + sum(10 ** (s - end) for s in others) == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(brute_id, "a b") for brute_id in range(300) if brute.zlib.crc32(str(brute_id).encode()) % 7 == 2]], ids=["empty", "untrained"])
def test_nothing_to_learn_from(as_documents, rows):
    docs = as_documents(rows or [(1, "x")])
    docs = docs if rows else docs.where("doc_id = 2")
    found = [tuple(r) for r in lm_interpolation.interpolated_scores(docs).collect()]
    assert len(found) == len(rows)
    if rows:
        close(found, brute.lm_scores(rows))


PIECES = [("<unk>", 0.0), ("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("▁a", -5.0), ("aba", -6.0), ("bab", -6.0), ("é", -2.5), ("▁ab", -7.0)]


def test_ties_are_decided_as_by_the_tokenizer(spark):
    """Scores that add up alike in many ways, unknown characters, and pieces' own marks in the text."""
    own = token_counts.Counter(PIECES)
    texts = [(0, "abab baba ababab bababa aabb"), (1, "x xx axa éxé ▁ab <unk> a<unk>x"), (2, ""), (3, None), (4, "ab" * 3000)]
    found = [(i, *own.text((t or "").encode())) for i, t in texts]
    assert expected(found) == expected(brute.unigram_counts(texts, PIECES))


def test_token_counts(as_documents):
    rows = [r for r in ODD if r[1] != LONG]
    path = queries._tokenizer("piece_bpe_32k.model")
    found = token_counts.token_counts(as_documents(rows), path)
    assert rows_of(found, "*") == expected(brute.unigram_counts(rows, token_counts.vocabulary(path)))


def test_token_counts_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED_WORDS", 2)
    own = token_counts.Counter(PIECES)
    assert own.text(b"a b ab ba a b ab ba") == own.text(b"a b ab ba a b ab ba")


LICENCES = [
    *ODD,
    (40, "This work is licensed under the GNU General Public License, version 3."),
    (41, "Licensed under CC BY-NC 4.0. cc by cc by"),
    (42, "Released under the MIT License. All rights reserved."),
    (43, "SPDX-License-Identifier: GPL-3.0-or-later"),
    (44, "all rights all rights reserved reserved GENERAL PUBLIC LICENSE"),
    (45, "mit der Lizenz"),
    (46, "https://www.apache.org/licenses/LICENSE-2.0"),
    (47, ("see the Apache License, Version 2.0 and the MIT license; " * 300)),
]


def test_license_places(as_documents):
    found = license_scan.scan(as_documents(LICENCES))
    columns = "doc_id n_words n_base first_word last_word base_labels".split()
    assert rows_of(found, *columns) == expected(brute.license_base(LICENCES))
    for row in found.collect():
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == (row["labels"] != "")


def test_license_labels(as_documents):
    found = {r["doc_id"]: r for r in license_scan.scan(as_documents(LICENCES)).collect()}
    labels = {i: found[i]["labels"] for i in range(40, 48)}
    assert labels == {
        40: "gpl,gpl-3.0",
        41: "cc-by,cc-by-nc-4.0",
        42: "mit,reserved",
        43: "gpl-3.0-or-later",
        44: "gpl,reserved",
        45: "",
        46: "apache-2.0",
        47: "apache-2.0,mit",
    }
    assert [tuple(d) for d in found[43]["detections"]] == [("gpl-3.0-or-later", "tag", 0, 8)]
    assert len(found[47]["detections"]) == 600


def test_gates_and_suppression_change_nothing_else():
    """Without gates the same rules find the same; what is suppressed lies inside something of no lower priority."""
    scanner = license_scan.Scanner(license_rules.rules())
    assert len(scanner.rules) > 300
    for line in license_rules.LICENCES.strip().splitlines():
        label, gates, name, identifier, address = line.split(" | ")
        for shape in ("spdx license identifier " + identifier, "licensed under the " + name, address, "subject to the " + name, name):
            text = license_rules.re.sub(r"#(\d)", r"v\1", shape)
            text = license_rules.re.sub(r"\[(.).*?\]", r"\1", text)
            while "(?:" in text:
                text = license_rules.re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)
            words = license_scan.words_of(text.replace("?", "").encode())
            joined = " " + " ".join(w.decode() for w in words) + " "
            free = [(m.start(), m.end(), r.priority) for r in scanner.rules for m in r.pattern.finditer(joined)]
            kept = scanner.detections(words)
            assert kept, shape
            assert len(kept) <= len(free)
            cover = [(a, a + n) for a, n in ((a, b - a) for a, b, _ in kept)]
            at = lambda p: joined.count(" ", 1, p)
            assert all(any(a <= at(s) and at(e) < b for a, b in cover) for s, e, _ in free), shape


DAY = dt.date(2024, 3, 1)
ENTRIES = [
    ("spam", "host", "bad.example.org", "add", DAY),
    ("spam", "host", "bad.example.org", "remove", DAY + dt.timedelta(10)),
    ("spam", "host", "bad.example.org", "add", DAY + dt.timedelta(20)),
    ("spam", "host", "bad.example.org", "add", DAY + dt.timedelta(20)),
    ("adult", "domain", "Example.NET", "add", DAY),
    ("adult", "domain", "example.net", "remove", DAY + dt.timedelta(5)),
    ("adult", "domain", "example.net", "add", DAY + dt.timedelta(5)),
    ("phish", "path", "good.example.org/login", "add", DAY),
    ("allow", "domain", "example.org", "add", DAY + dt.timedelta(25)),
    ("spam", "domain", "org", "add", DAY + dt.timedelta(30)),
    (None, "host", "x.example.com", "add", DAY),
    ("spam", "host", None, "add", DAY),
    ("spam", "host", "x.example.com", None, DAY),
    ("spam", "host", "x.example.com", "add", None),
    ("spam", "regex", "x.example.com", "add", DAY),
]
URLS = [
    "http://bad.example.org/a",
    "HTTPS://user@BAD.example.org.:8080/a?b#c",
    "http://sub.bad.example.org/",
    "http://a.b.example.net",
    "http://example.net/x",
    "http://notexample.net/x",
    "https://good.example.org/login/",
    "https://good.example.org/LOGIN/now?x=1",
    "https://good.example.org/loginx",
    "http://x.example.com/",
    "no url",
    "",
    None,
    "http:///path",
    "http://x/" + "a/" * 200,
]


def test_lists_as_of_the_day(spark):
    captures = [(u, DAY + dt.timedelta(n)) for u in URLS for n in (-1, 0, 4, 5, 9, 10, 19, 20, 25, 31)]
    captures += [(URLS[0], None), (URLS[0], DAY), (URLS[0], DAY)]
    table = spark.createDataFrame([(*c, "mine", "h") for c in captures], "url string, day date, lists string, _host string")
    entries = spark.createDataFrame(ENTRIES, "list string, kind string, key string, action string, day date")
    found = url_lists.on_lists(table, entries, "url", "day")
    assert found.columns == ["url", "day", "lists", "_host", "host", "lists_", "blocked"]
    assert {tuple(r) for r in found.select("lists", "_host").collect()} == {("mine", "h")}
    assert rows_of(found, "url", "day", "host", "lists_", "blocked") == expected(brute.active_lists(captures, ENTRIES))
    kept = url_lists.keep_allowed(table, entries, "url", "day")
    assert kept.columns == table.columns
    assert kept.count() == sum(not r[-1] for r in brute.active_lists(captures, ENTRIES))
    assert url_lists.on_lists(table, entries.where("false"), "url", "day").where("blocked").count() == 0
    assert url_lists.on_lists(table.where("false"), entries, "url", "day").count() == 0


def test_url_lists_stay_in_the_engine(spark):
    plan = queries.url_lists_query(spark, PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian"))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_url_lists_against_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    found = queries.url_lists_query(spark, folder)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    wanted = connection.execute(queries.URL_LISTS_SQL).fetchall()
    assert rows_of(found, "*") == expected(wanted) and any(r[3] for r in wanted)
