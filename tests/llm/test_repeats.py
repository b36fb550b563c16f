"""Repeated text against brute force without borders: all common runs, and all lines at Jaccard 0.8."""

import numpy as np

from clickmart.llm import queries, repeats
from tests.llm import brute
from tests.llm.conftest import ODD, rows_of
from tests.llm.test_passages import brute_passages, planted, random_words

COLUMNS = ["doc_id", "class_id", "n_repeated", "n_removed", "words_removed"]


def places():
    """Passages of 51 to 60 words at random places, of frequent words and rare ones, in lines of any length."""
    random = np.random.default_rng(3)
    docs = []
    for i in range(24):
        pool = ["the", "of", "|", "a"] * 12 + random_words(50 + i // 2, 30)
        passage = [pool[k] for k in np.random.default_rng(i // 2).integers(0, len(pool), 51 + i // 2 % 10)]
        own = random_words(200 + i, 120)
        at = int(random.integers(0, 100))
        words = own[:at] + passage + own[at:]
        wrap = int(random.integers(2, 5)) if i % 3 else 1000
        docs.append((i, "\n".join(" ".join(words[k : k + wrap]) for k in range(0, len(words), wrap))))
    return docs


def edited():
    """Long lines with a few words changed, so that Jaccard similarity stays over 0.8."""
    docs = []
    for i, (n, edits) in enumerate([(60, 1), (100, 2), (200, 4)]):
        line = random_words(400 + i, n)
        other = list(line)
        for k in range(edits):
            other[(2 * k + 1) * n // (2 * edits)] = f"edit{k}"
        docs += [(2 * i, " ".join(line)), (2 * i + 1, "own words of this one\n" + " ".join(other))]
    return docs


def brute_words(docs, n):
    """(doc_id, word) of all windows of n words that a smaller doc_id has."""
    first, gone = {}, set()
    for doc_id, text in sorted(docs):
        words = text.lower().split()
        for k in range(len(words) - n + 1):
            if first.setdefault(tuple(words[k : k + n]), doc_id) < doc_id:
                gone |= {(doc_id, j) for j in range(k, k + n)}
    return gone


def lines_of(docs):
    """doc_id, start and number of words, and shingles of every line of five words or more."""
    out = []
    for doc_id, text in docs:
        at = 0
        for line in brute.ascii_lower(text or "").split("\n"):
            words = brute.WORD.findall(line)
            if doc_id is not None and len(words) >= 5:
                out.append((doc_id, at, len(words), frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))))
            at += len(words)
    return out


def runs_of(marked):
    """How many runs of following numbers there are."""
    return sum(k - 1 not in marked for k in marked)


def brute_repeats(docs, n=16):
    """All lines compared with all, all windows of n words, and what they mark, without any of the operator's borders."""
    places, links = brute_passages(lines_of(docs), n)
    every, gone = {}, {}
    for doc_id, least in places.items():
        for (a, size), first in least.items():
            every.setdefault(doc_id, set()).update(range(a, a + size))
            if first < doc_id:
                gone.setdefault(doc_id, set()).update(range(a, a + size))
    holders, windows = {}, []
    for doc_id, text in docs:
        words = brute.WORD.findall(brute.ascii_lower(text or "")) if doc_id is not None else []
        for k in range(len(words) - n + 1):
            windows.append((doc_id, k, tuple(words[k : k + n])))
            holders.setdefault(windows[-1][2], set()).add(doc_id)
    for doc_id, k, window in windows:
        if len(holders[window]) > 1:
            every.setdefault(doc_id, set()).update(range(k, k + n))
            if min(holders[window]) < doc_id:
                gone.setdefault(doc_id, set()).update(range(k, k + n))
                links.append((doc_id, min(holders[window])))
    classes = brute.smallest_reachable({d for d, _ in docs if d is not None}, links)
    mine = lambda d: (runs_of(every.get(d, ())), runs_of(gone.get(d, ())), len(gone.get(d, ())))
    return sorted(((d, classes.get(d), *mine(d)) for d, _ in docs), key=repr)


def test_report_of_everything(as_documents, given):
    """With many bands no similar line is missed, so that brute force must agree."""
    odd = [r for r in ODD if r[0] not in (9, 10)]
    for rows in (odd, planted(), edited(), given):
        assert rows_of(repeats.report(as_documents(rows), recall=1 - 1e-9), *COLUMNS) == brute_repeats(rows)


def test_a_full_filter_changes_nothing(as_documents, monkeypatch):
    rows = planted() + edited()
    wanted = brute_repeats(rows)
    small = repeats.filter_of
    monkeypatch.setattr(repeats, "filter_of", lambda found, mb: type(small(found, mb))(np.full(2, 2**64 - 1, np.uint64)))
    assert rows_of(repeats.report(as_documents(rows), recall=1 - 1e-9), *COLUMNS) == wanted


def test_odd_texts_and_nothing(as_documents):
    """NULL and empty texts, repeated and NULL ids, further columns, no rows."""
    docs = as_documents(ODD)
    assert repeats.report(docs).count() == len(ODD)
    kept = repeats.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert kept.where("doc_id is null").count() == 2 and kept.where("text is null").count() == 2
    assert repeats.report(docs.where("false")).count() == 0 and repeats.drop_repeats(docs.where("false")).count() == 0


def test_recall_of_similar_lines(spark):
    """Lines of 16 words or more that are similar to a line of an earlier document go whole."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    held = [h for h in lines_of(docs) if h[2] >= 16]
    places, _ = brute_passages(held)
    wanted = {(d, k) for d, least in places.items() for (a, n), first in least.items() if first < d for k in range(a, a + n)}
    found = removed(repeats.repeats(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    assert len(wanted) > 1000 and len(wanted & found) >= 0.98 * len(wanted)


def removed(df):
    rows = repeats.spans(df).collect()
    return {(r["doc_id"], k) for r in rows for s in r["gone"] for k in range(s["start"], s["start"] + s["n_words"])}


def test_all_common_runs_are_found(as_documents, given):
    for rows in (places(), [r for r in given if r[0] is not None and r[1]]):
        wanted = brute_words(rows, 16)
        assert wanted and removed(repeats.runs(as_documents(rows), 16)) == wanted


def test_passages_go_whole(as_documents):
    rows = places()
    found = {r["doc_id"]: r["words_removed"] for r in repeats.report(as_documents(rows)).collect()}
    assert all(found[i] >= 51 + i // 2 % 10 for i in range(1, 24, 2))
    assert not any(found[i] for i in range(0, 24, 2))


def test_similar_lines_go_with_their_edits(as_documents):
    docs = as_documents(edited())
    found = {r["doc_id"]: r["words_removed"] for r in repeats.report(docs, recall=1 - 1e-9).collect()}
    assert found == {0: 0, 1: 60, 2: 0, 3: 100, 4: 0, 5: 200}
    kept = {r["doc_id"]: r["text"] for r in repeats.drop_repeats(docs, recall=1 - 1e-9).collect()}
    assert all(kept[i] == "own words of this one" for i in (1, 3, 5))


def test_the_query_finds_them(spark, as_documents, tmp_path):
    as_documents(places()).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["words_removed"] for r in queries.substring_dedup_query(spark, str(tmp_path)).collect()}
    assert all(found[i] >= 51 for i in range(1, 24, 2))
